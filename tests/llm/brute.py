"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def last(key):
    """Sorts None after everything."""
    return (key is None, key if key is not None else 0)


def exact(rows):
    groups = defaultdict(list)
    for k, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), last(k), k))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:2])
        out += [(m[2], members[0][2], len(members), i == 0, sha(norm)) for i, m in enumerate(members)]
    return out


def leaks(rows, items, window=10):
    parsed = [(str(k), LEAK_WORD.findall(lower(t or ""))) for k, t in items]
    parsed = [(k, w, min(window, len(w))) for k, w in parsed if w]
    windows = defaultdict(set)
    for k, w, n in parsed:
        for i in range(len(w) - n + 1):
            windows[tuple(w[i : i + n])].add(k)
    sizes = sorted({len(w) for w in windows})
    out = []
    for k, text in rows:
        words = LEAK_WORD.findall(lower(text or ""))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= owners
        out.append((k, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def near_leaks(rows, items, window=10, slop=2):
    texts = [(k, LEAK_WORD.findall(lower(t or ""))) for k, t in rows]
    often = Counter(w for _, words in texts for w in words)
    windows = defaultdict(set)
    for k, t in items:
        w = LEAK_WORD.findall(lower(t or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(k))
    exact = {k: x[5] for k, x in enumerate(leaks(rows, items, window))}
    out = []
    for row, (k, words) in enumerate(texts):
        n, names, own = 0, set(), set(words)
        for win, owners in windows.items():
            if not own.issuperset(win):
                continue
            first = min(range(len(win)), key=lambda i: (often[win[i]], i))
            for p in (p for p, w in enumerate(words) if w == win[first]):
                spans = (words[max(0, p + i - first - slop) : max(0, p + i - first + slop + 1)] for i in range(len(win)))
                if all(w in span for w, span in zip(win, spans)):
                    n, names = n + 1, names | owners
        out.append((k, len(words), n, len(names), sha(",".join(sorted(names))), bool(n) and not exact[row]))
    return out


def token_files(rows, tokenizer, end=0):
    out, start = [], 0
    for k, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((k, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def substrings(rows, window=35):
    split = [(k, SPACE_WORD.findall(t or "")) for k, t in rows]
    starts = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingle_set(text, n=4):
    words = SPACE_WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def components(rows, percent=85, n=4):
    sets = [(k, shingle_set(t, n)) for k, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        r = root(i)
        least[r] = k if least.get(r) is None else min(least[r], k) if k is not None else least[r]
    return [(k, len(s), least[root(i)] if s else k) for i, (k, s) in enumerate(sets)]


def shared_lines(rows, min_chars=20, min_documents=3):
    split = [(k, (t or "").split("\n")) for k, t in rows]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, lines in split:
        for line in lines:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(k)
    keeper = {x: max(own, key=lambda k: (k is not None, k if k is not None else 0)) for x, own in holders.items() if len(own) >= min_documents}
    out = []
    for k, lines in split:
        kept = [line for line in lines if key(line) not in keeper or keeper[key(line)] == k]
        out.append((k, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def whitened(rows, components=8):
    """rows: (id, vector). Cells of the result by id: n, deviation, and the covariance, eigenvalues and whitened values by numpy."""
    import math

    import numpy as np

    kept = [(k, [math.floor(1024 * float(c)) + 100_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, x = len(kept), [v for _, v in kept]
    sums = [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [k for k, _ in kept], n, deviation, values / np.trace(v), centred @ vectors / np.sqrt(values)


def damaged_conversations(rows):
    """rows: (conv, turn, role, text), as the damage leaves them, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda c: " " if c is None else str(c)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text, copies = name(role), name(text), 1
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        copies = {0: 0, 3: 2}.get(kind, 1)
        out[conv] += [(turn, role, text)] * copies
    return {c: sorted(own, key=lambda m: (m[0] is not None, m[0] or 0, m[1], sha(m[2]))) for c, own in out.items()}


def repairs(rows):
    """One row per conversation by trying every sequence of edits whose cost is within that of deleting everything."""
    return sorted(((c, *repair(own)) for c, own in damaged_conversations(rows).items()), key=repr)


def faults_of(own):
    faults, seen = [], set()
    for _, role, text in own:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def repair(own):
    faults = faults_of(own)
    best = [4 * len(own), "D" * len(own), []]

    def walk(i, cost, audit, said, inserted):
        if cost > best[0]:
            return
        if i == len(own) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)) and (cost, audit) < (best[0], best[1]):
            best[:] = [cost, audit, said]
        if inserted < 2:
            for role in ("user", "assistant"):
                walk(i, cost + 3, audit + "I", [*said, (role, "")], inserted + 1)
        if i < len(own):
            _, role, text = own[i]
            walk(i + 1, cost + 4, audit + "D", said, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                walk(i + 1, cost + more, audit + "K", [*said, (role, text)], 0)
                for other in ("user", "assistant"):
                    walk(i + 1, cost + 3 + more, audit + "R", [*said, (other, text)], 0)

    walk(0, 0, "", [], 0)
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(own, own[1:])]
    illegal = sum("".join(p) not in ("su", "ua", "au") for p in pairs)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, best[0], best[1], sha("\n".join(f"{r}:{t}" for r, t in best[2]))
