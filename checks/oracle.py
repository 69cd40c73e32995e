"""DuckDB SQL for the registered queries, written from the definitions, not from the Spark plans."""

from __future__ import annotations

import math

from rankaudit.functions import cut_matrices, fixed

ORACLE: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def cnt(letters: str, s: str = "sequence") -> str:
    return f"(length({s}) - length(regexp_replace({s}, '[{letters}]', '', 'g')))"


def frac(letters: str, s: str = "sequence") -> str:
    return f"({cnt(letters, s)} / CAST(length({s}) AS DOUBLE))"


def clamp(expr: str) -> str:
    return f"least({d(1.0)}, greatest({d(0.0)}, {expr}))"


def tri(expr: str, target: float, width: float) -> str:
    return clamp(f"{d(1.0)} - abs(({expr}) - {d(target)}) / {d(width)}")


def in_set(expr: str, letters: str) -> str:
    return "CASE WHEN {} IN ({}) THEN {} ELSE {} END".format(
        expr, ", ".join(f"'{x}'" for x in letters), d(1.0), d(0.0)
    )


def charge_of(letter: str, ph: float) -> float:
    if letter in fixed.PKA_POSITIVE:
        return 1.0 / (1.0 + 10 ** (ph - fixed.PKA_POSITIVE[letter]))
    if letter in fixed.PKA_NEGATIVE:
        return -1.0 / (1.0 + 10 ** (fixed.PKA_NEGATIVE[letter] - ph))
    return 0.0


def ends(ph: float) -> float:
    return 1.0 / (1.0 + 10 ** (ph - fixed.PKA_FIRST)) + -1.0 / (1.0 + 10 ** (fixed.PKA_LAST - ph))


CHARGED = list(fixed.PKA_POSITIVE) + list(fixed.PKA_NEGATIVE)
KD = "(" + " + ".join(f"{cnt(a)} * {d(v)}" for a, v in fixed.HYDROPATHY.items()) + ") / CAST(length(sequence) AS DOUBLE)"
NET = f"{d(ends(7.4))} + (" + " + ".join(f"{cnt(a)} * {d(charge_of(a, 7.4))}" for a in CHARGED) + ")"

# ---- shared inputs -------------------------------------------------------------

POS = "label IN ('known_positive', 'digestome_known_positive')"


FOLDED = (
    "translate(text, 'àâäáãåçéèêëíìîïñóòôöõøúùûüýÿßœæÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝŒÆ', "
    "'aaaaaaceeeeiiiinoooooouuuuyysoaAAAAAACEEEEIIIINOOOOOOUUUUYOA')"
)


def words(table: str, keep: str) -> str:
    split = f"string_split(trim(upper(regexp_replace({FOLDED}, '[^A-Za-z]+', ' ', 'g'))), ' ')"
    return f"(SELECT * FROM (SELECT {keep}, unnest({split}) AS word FROM {table}) WHERE word <> '')"


def residues(table: str, keep: str) -> str:
    return (
        f"(SELECT * EXCLUDE (word), translate(word, 'BJOUXZ', 'DLPCAE') AS sequence FROM {words(table, keep)})"
    )


DOCW = f"docw AS (SELECT sequence, min(doc_id) AS min_doc_id, count(*) AS n FROM {residues('documents', 'doc_id')} GROUP BY 1)"
PANELW = f"panelw AS (SELECT sequence, min(item_id) AS item_id FROM {residues('benchmark', 'item_id')} GROUP BY 1)"
PRIORW = f"priorw AS (SELECT DISTINCT role AS panel, sequence FROM {residues('conversations', 'role')})"
CID = "'CAND-' || substr(sha256('rankaudit-v1:' || sequence), 1, 16)"
LETTERS = "array_to_string(list_sort(string_split(sequence, '')), '')"
UNI = f"""anagrams AS (SELECT {LETTERS} AS letters, min(sequence) AS parent FROM panelw GROUP BY 1),
uni AS (SELECT {CID} AS candidate_id, sequence, length(sequence) AS length, coalesce(n, 0) AS n,
  CASE WHEN item_id IS NOT NULL AND min_doc_id IS NOT NULL THEN 'digestome_known_positive'
       WHEN item_id IS NOT NULL THEN 'known_positive'
       WHEN parent IS NOT NULL THEN 'matched_decoy' ELSE 'digestome_background' END AS label
  FROM (SELECT coalesce(a.sequence, b.sequence) AS sequence, min_doc_id, item_id, n
        FROM docw a FULL JOIN panelw b ON a.sequence = b.sequence) u
  LEFT JOIN anagrams ON letters = {LETTERS})"""
BASE = f"{DOCW},\n{PANELW},\n{UNI}"

COMPS = (
    "wide AS (SELECT vec_id AS candidate_id, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS sequence, "
    "CAST(2 + vec_id % 11 AS INTEGER) AS length, CASE WHEN label = 0 THEN 'known_positive' "
    "WHEN label BETWEEN 1 AND 4 THEN 'matched_decoy' ELSE 'random_background' END AS label, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS c{i:02d}" for i in range(1, 9))
    + ", round_even(CAST(embedding[9] AS DOUBLE) * 1e1, 0) / 1e1 AS c09, CAST(0 AS DOUBLE) AS c10 FROM embeddings),\n"
    "comps AS (UNPIVOT wide ON c01, c02, c03, c04, c05, c06, c07, c08, c09, c10 INTO NAME component VALUE score)"
)
PAIRS = (
    f"{COMPS},\npairs AS (SELECT candidate_id, sequence, length, label, candidate_id % 50 AS parent, c01 AS s1, c02 AS s2 FROM wide)"
)


def tail(hits: str, pop: str, suc: str, drw: str) -> str:
    """P(X >= hits) by summing the mass function."""
    def lc(n, k):
        return f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
    term = f"exp({lc(suc, 'x')} + ({lc(f'({pop} - {suc})', f'({drw} - x)')}) - ({lc(pop, drw)}))"
    xs = f"list_filter(range({hits}, CAST(least({suc}, {drw}) + 1 AS BIGINT)), lambda x: {drw} - x <= {pop} - {suc})"
    total = f"list_sum(list_transform({xs}, lambda x: {term}))"
    return f"CASE WHEN {hits} <= 0 THEN {d(1.0)} WHEN {hits} > least({suc}, {drw}) THEN {d(0.0)} ELSE least({d(1.0)}, coalesce({total}, {d(0.0)})) END"


def cut(n: str, percent: float) -> str:
    return f"CAST(greatest(1, ceil({n} * {int(round(percent * 1000))} / 100000.0)) AS BIGINT)"


def tag(percent: float) -> str:
    return f"{percent:g}".replace(".", "_")


def evaluation(source: str, by: list[str], percents=(1.0, 5.0, 10.0), length: bool = True, drop=(), prefix="", round_it=True) -> str:
    """CTEs and a final SELECT that evaluate `source` (by..., score, sequence, length, label)."""
    keys = ", ".join(by)
    order = "score DESC, length, sequence" if length else "score DESC, sequence"
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in by)
    counts = [f"count(*) FILTER (rank <= {cut('n_rows', p)}) AS top_{tag(p)}pct_count" for p in percents]
    counts += [f"count(*) FILTER (rank <= {k}) AS top_{k}_count" for k in (10, 25, 50, 100)]
    P = prefix
    q = f"""{P}ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank,
  count(*) OVER (PARTITION BY {keys}) AS n_rows FROM {source}),
{P}hits AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rank) AS hit FROM {P}ranked WHERE {POS}),
{P}stats AS (SELECT {keys}, {', '.join(counts)}, avg(rank) AS mean_rank, quantile_cont(CAST(rank AS DOUBLE), 0.5) AS median_rank,
  CAST(list_sort(list(rank))[count(*) // 2 + 1] AS DOUBLE) AS upper_median_rank, min(rank) AS best_rank,
  avg(hit / CAST(rank AS DOUBLE)) AS ap_ranked FROM {P}hits GROUP BY {keys}),
{P}tot AS (SELECT {keys}, count(*) AS n_rows, count(*) FILTER ({POS}) AS n_positive FROM {P}ranked GROUP BY {keys}),
{P}mid AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS mr FROM {P}ranked),
{P}auc1 AS (SELECT {keys}, (sum(mr) FILTER ({POS}) - count(*) FILTER ({POS}) * (count(*) FILTER ({POS}) + 1) / 2.0)
  / nullif(count(*) FILTER ({POS}) * CAST(count(*) FILTER (NOT ({POS})) AS DOUBLE), 0) AS auroc_all FROM {P}mid GROUP BY {keys}),
{P}midm AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS mr
  FROM {P}ranked WHERE {POS} OR label = 'matched_decoy'),
{P}auc2 AS (SELECT {keys}, (sum(mr) FILTER ({POS}) - count(*) FILTER ({POS}) * (count(*) FILTER ({POS}) + 1) / 2.0)
  / nullif(count(*) FILTER ({POS}) * CAST(count(*) FILTER (NOT ({POS})) AS DOUBLE), 0) AS auroc_matched FROM {P}midm GROUP BY {keys}),
{P}tied AS (SELECT {keys}, score, count(*) FILTER ({POS}) AS p, count(*) AS c FROM {P}ranked GROUP BY {keys}, score),
{P}steps AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS rows_so_far FROM {P}tied WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
{P}ap1 AS (SELECT {keys}, sum(p * CAST(tp AS DOUBLE) / rows_so_far) / nullif(sum(p), 0) AS ap_step FROM {P}steps GROUP BY {keys}),
{P}firsts AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, CASE WHEN {POS} THEN 0 ELSE 1 END) AS place FROM {P}ranked),
{P}firsts2 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY place) AS hit FROM {P}firsts WHERE {POS}),
{P}ap2 AS (SELECT {keys}, avg(hit / CAST(place AS DOUBLE)) AS ap_positives_first FROM {P}firsts2 GROUP BY {keys})
"""
    cols = [f"t.{k}" for k in by] + ["t.n_rows", "t.n_positive"]
    names = [f"top_{tag(p)}pct_count" for p in percents] + [f"top_{k}_count" for k in (10, 25, 50, 100)]
    cols += [f"coalesce(s.{n}, 0) AS {n}" for n in names] + ["best_rank"]
    f = (lambda e: r(e)) if round_it else (lambda e: e)
    doubles = {n: n for n in ("mean_rank", "median_rank", "upper_median_rank", "ap_ranked", "auroc_all", "auroc_matched", "ap_step", "ap_positives_first")}
    for p in percents:
        n = f"top_{tag(p)}pct"
        k = f"coalesce({n}_count, 0)"
        doubles[f"{n}_fraction"] = f"{k} / CAST(nullif(t.n_positive, 0) AS DOUBLE)"
        doubles[f"{n}_enrichment"] = f"{k} / greatest(1e-12, t.n_positive * {cut('t.n_rows', p)} / CAST(t.n_rows AS DOUBLE))"
        doubles[f"{n}_p"] = tail(k, "t.n_rows", "t.n_positive", cut("t.n_rows", p))
    cols += [f"{f(e)} AS {n}" for n, e in doubles.items() if n not in drop]
    joins = "".join(f"\nLEFT JOIN {P}{x} ON {on('t', P + x)}" for x in ("auc1", "auc2", "ap1", "ap2"))
    return q, f"SELECT {', '.join(cols)} FROM {P}tot t LEFT JOIN {P}stats s ON {on('t', 's')}{joins}"


# ---- candidates ------------------------------------------------------------------

AA = fixed.ALPHABET
ORACLE["clean_ids"] = f"""WITH w AS (SELECT DISTINCT word AS sequence FROM {words('documents', 'doc_id')})
SELECT {CID} AS candidate_id, 'VAR-' || substr(sha256(sequence || ':' || length(sequence)), 1, 16) AS stable_id,
  sequence, length(sequence) AS length FROM w WHERE regexp_full_match(sequence, '[{AA}]+') AND length(sequence) BETWEEN 2 AND 12"""

EXPORT = f"""raw AS (SELECT word AS sequence, source, count(*) AS n, min(doc_id) AS id FROM {words('documents', 'doc_id, source')} GROUP BY 1, 2),
export AS (SELECT sequence, source, id, CASE WHEN right(sequence, 1) IN ('A', 'E', 'I') THEN n || ' uM'
  WHEN right(sequence, 1) IN ('N', 'S') THEN n || '.5 mM' WHEN right(sequence, 1) = 'T' THEN n || ' mg/ml'
  WHEN right(sequence, 1) = 'D' THEN n || ' ug/ml' WHEN right(sequence, 1) = 'R' THEN n || ' %' ELSE 'ND' END AS ic50,
  CASE WHEN right(sequence, 1) = 'D' THEN NULL ELSE length(sequence) * 110 END AS mass, n FROM raw),
parsed AS (SELECT *, CASE right(ic50, 2) WHEN 'uM' THEN CAST(n AS DOUBLE) WHEN 'mM' THEN (n + 0.5) * 1000.0::DOUBLE
  WHEN 'ml' THEN CASE WHEN ic50 LIKE '%mg/ml' THEN CAST(n AS DOUBLE) / mass * 1e6 END END AS ic50_um FROM export),
judged AS (SELECT p.*, CASE WHEN NOT regexp_full_match(p.sequence, '[{AA}]+') THEN 'invalid_sequence'
  WHEN length(p.sequence) NOT BETWEEN 2 AND 12 THEN 'length_outside_range'
  WHEN p.sequence IN (SELECT sequence FROM panelw) THEN 'excluded_eval_sequence'
  WHEN ic50_um IS NULL THEN 'unparsed_ic50' WHEN ic50_um > 20000 THEN 'above_max_ic50_um' ELSE 'accepted' END AS reason FROM parsed p)"""
ORACLE["reject_reasons"] = f"""WITH {PANELW}, {EXPORT}
SELECT reason, count(*) AS n, count(DISTINCT sequence) AS n_sequences FROM judged GROUP BY 1"""
ORACLE["export_best_potency"] = f"""WITH {PANELW}, {EXPORT}
SELECT sequence, source, id, ic50, {r('ic50_um')} AS ic50_um FROM judged WHERE reason = 'accepted'
QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY ic50_um, id, source) = 1"""

PROT = f"prot AS (SELECT doc_id AS accession, source AS source_class, translate(upper(regexp_replace({FOLDED}, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'DLPCAE') AS sequence FROM documents)"


def pieces(missed: int, low: int, high: int) -> str:
    leads = " UNION ALL ".join(
        f"SELECT accession, source_class, rule, rule_order, cut, next{k} AS stop FROM nexts WHERE next{k} IS NOT NULL" for k in range(1, missed + 2)
    )
    nexts = ", ".join(f"lead(cut, {k}) OVER w AS next{k}" for k in range(1, missed + 2))
    return f"""{PROT},
letters AS (SELECT accession, source_class, unnest(string_split(sequence, '')) AS a, generate_subscripts(string_split(sequence, ''), 1) AS i, length(sequence) AS size, sequence AS whole FROM prot WHERE sequence <> ''),
pairs2 AS (SELECT accession, source_class, a, i, size, CASE WHEN i < size THEN substr(whole, i + 1, 1) ELSE '' END AS b FROM letters),
cuts AS (SELECT accession, source_class, 'trypsin' AS rule, 0 AS rule_order, i AS cut FROM pairs2 WHERE a IN ('K', 'R') AND b <> 'P' AND i < size
 UNION ALL SELECT accession, source_class, 'chymotrypsin', 1, i FROM pairs2 WHERE a IN ('F', 'W', 'Y', 'L') AND b <> 'P' AND i < size
 UNION ALL SELECT accession, source_class, 'pepsin_like', 2, i FROM pairs2 WHERE a IN ('F', 'L', 'W', 'Y') AND i < size
 UNION ALL SELECT accession, source_class, 'thermolysin_like', 3, i - 1 FROM pairs2 WHERE a IN ('A', 'F', 'I', 'L', 'M', 'V') AND i > 1
 UNION ALL SELECT accession, source_class, rule, rule_order, e FROM prot, (VALUES ('trypsin', 0), ('chymotrypsin', 1), ('pepsin_like', 2), ('thermolysin_like', 3)) v(rule, rule_order),
   unnest([0, length(sequence)]) t(e) WHERE sequence <> ''),
nexts AS (SELECT *, {nexts} FROM cuts WINDOW w AS (PARTITION BY accession, rule ORDER BY cut)),
spans AS ({leads}),
found AS (SELECT DISTINCT s.accession, s.source_class, rule, rule_order, substr(sequence, cut + 1, stop - cut) AS sequence
  FROM spans s JOIN prot p ON s.accession = p.accession WHERE stop - cut BETWEEN {low} AND {high})"""


ORACLE["digest_fragments"] = f"""WITH {pieces(2, 2, 12)},
per AS (SELECT source_class, rule, sequence, count(*) AS n FROM found GROUP BY 1, 2, 3)
SELECT source_class, rule, length(sequence) AS length, CAST(sum(n) AS BIGINT) AS n_fragments, count(*) AS n_distinct,
  min(sequence) AS first_fragment, max(sequence) AS last_fragment FROM per GROUP BY 1, 2, 3"""

# Shuffles and draws: four hex digits of the digest per position (all strings here have at most 12).
SHUF = """parents AS (SELECT sequence FROM panelw WHERE length(sequence) BETWEEN 2 AND 12),
tried AS (SELECT sequence AS parent, t.attempt, sha256('shuffle:' || sequence || ':' || t.attempt || ':0') AS hex FROM parents, range(1, 1001) t(attempt)),
mixed AS (SELECT parent, attempt, array_to_string(list_transform(list_sort(list_transform(range(0, length(parent)),
  lambda i: {'k': substr(hex, CAST(i * 4 + 1 AS BIGINT), 4), 'i': i, 'x': substr(parent, CAST(i + 1 AS BIGINT), 1)})), lambda s: s.x), '') AS sequence FROM tried),
firsts0 AS (SELECT parent, sequence, min(attempt) AS attempt FROM mixed WHERE sequence <> parent GROUP BY 1, 2),
shuffled AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY attempt) AS ordinal FROM firsts0 QUALIFY ordinal <= 20)"""
ORACLE["shuffled_decoys"] = f"WITH {PANELW}, {SHUF} SELECT parent, sequence, CAST(attempt AS INTEGER) AS attempt, CAST(ordinal AS INTEGER) AS ordinal FROM shuffled"
DRAW = "array_to_string(list_transform(range(0, {n}), lambda i: substr('ACDEFGHIKLMNPQRSTVWY', CAST(('0x' || substr({hex}, CAST(i * 4 + 1 AS BIGINT), 4))::INTEGER % 20 + 1 AS BIGINT), 1)), '')"
#: Two rounds of draws (to twice, then a hundred times the quota), then free strings of the lengths that are short.
def rand(taken: str) -> str:
    draw = DRAW.format(n='length(parent)', hex="sha256('random:' || parent || ':' || t.attempt || ':0')")
    letters = "(SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS x)"
    return f"""shufacc AS (SELECT sequence, min(parent) AS parent FROM shuffled WHERE sequence NOT IN (SELECT sequence FROM {taken}) GROUP BY 1),
have AS (SELECT parent, count(*) AS have FROM shufacc GROUP BY 1),
quotas AS (SELECT sequence AS parent, 80 - coalesce(have, 0) AS quota FROM parents LEFT JOIN have ON parent = sequence),
blocked AS (SELECT sequence FROM {taken} UNION ALL SELECT sequence FROM shufacc),
drawn1 AS (SELECT parent, quota, t.attempt, {draw} AS sequence FROM quotas, range(1, 161) t(attempt) WHERE t.attempt <= 2 * quota),
owned1 AS (SELECT * FROM drawn1 QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY attempt, parent) = 1),
acc1 AS (SELECT parent, sequence, attempt, quota, row_number() OVER (PARTITION BY parent ORDER BY attempt) AS ordinal FROM owned1
  WHERE sequence NOT IN (SELECT sequence FROM blocked) QUALIFY ordinal <= quota),
short1 AS (SELECT q.parent, any_value(quota) AS quota, any_value(q.quota) - count(a.sequence) AS need, count(a.sequence) AS have1
  FROM quotas q LEFT JOIN (SELECT parent, sequence FROM acc1) a ON a.parent = q.parent GROUP BY 1 HAVING need > 0),
drawn2 AS (SELECT parent, need, have1, t.attempt, {draw} AS sequence FROM short1, range(1, 8001) t(attempt) WHERE t.attempt > 2 * quota AND t.attempt <= 100 * quota),
owned2 AS (SELECT * FROM drawn2 QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY attempt, parent) = 1),
acc2 AS (SELECT parent, sequence, attempt, need, have1, row_number() OVER (PARTITION BY parent ORDER BY attempt) AS ordinal FROM owned2
  WHERE sequence NOT IN (SELECT sequence FROM blocked) AND sequence NOT IN (SELECT sequence FROM acc1) QUALIFY ordinal <= need),
short2 AS (SELECT s.parent, length(s.parent) AS n, any_value(need) - count(a.sequence) AS need2, any_value(have1) + count(a.sequence) AS have2
  FROM short1 s LEFT JOIN (SELECT parent, sequence FROM acc2) a ON a.parent = s.parent GROUP BY 1 HAVING need2 > 0),
slots AS (SELECT *, sum(need2) OVER (PARTITION BY n ORDER BY parent) AS upto FROM short2),
space AS (SELECT a.x || b.x AS sequence FROM {letters} a, {letters} b UNION ALL SELECT a.x || b.x || c.x FROM {letters} a, {letters} b, {letters} c),
free AS (SELECT sequence, length(sequence) AS n, row_number() OVER (PARTITION BY length(sequence) ORDER BY sha256('fill:' || sequence), sequence) AS slot FROM space
  WHERE sequence NOT IN (SELECT sequence FROM blocked) AND sequence NOT IN (SELECT sequence FROM acc1) AND sequence NOT IN (SELECT sequence FROM acc2)),
randoms AS (SELECT parent, sequence, attempt, ordinal FROM acc1 UNION ALL SELECT parent, sequence, attempt, ordinal + have1 FROM acc2
  UNION ALL SELECT parent, sequence, NULL, slot - (upto - need2) + have2 FROM slots s JOIN free f ON f.n = s.n AND f.slot > upto - need2 AND f.slot <= upto)"""


WORDS_TAKEN = "words_taken AS (SELECT sequence FROM docw UNION ALL SELECT sequence FROM panelw)"
ORACLE["random_decoys"] = f"WITH {DOCW}, {PANELW}, {SHUF}, {WORDS_TAKEN}, {rand('words_taken')} SELECT parent, sequence, CAST(attempt AS INTEGER) AS attempt, CAST(ordinal AS INTEGER) AS ordinal FROM randoms"


def background(blocked: str) -> str:
    return f"""sized AS (SELECT doc_id AS key, t.draw, 'background:' || doc_id || ':' || t.draw AS name FROM documents, range(1, 7) t(draw)),
sized2 AS (SELECT *, ('0x' || substr(sha256(name || ':length'), 1, 8))::BIGINT % 11 + 2 AS n FROM sized),
bdrawn AS (SELECT key, draw, {DRAW.format(n='n', hex="sha256(name || ':0')")} AS sequence FROM sized2),
bowned AS (SELECT * FROM bdrawn QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY draw, key) = 1),
noise AS (SELECT sequence, draw, key, row_number() OVER (ORDER BY draw, key) AS ordinal FROM bowned
  WHERE sequence NOT IN (SELECT sequence FROM {blocked}) QUALIFY ordinal <= (SELECT count(*) FROM documents))"""


ORACLE["random_background"] = f"""WITH {DOCW}, {PANELW}, {WORDS_TAKEN}, {background('words_taken')}
SELECT sequence, CAST(draw AS INTEGER) AS draw, key, ordinal FROM noise"""
UNIVERSE = f"""{PANELW}, {SHUF}, {pieces(2, 2, 12)},
dig AS (SELECT sequence, source_class, rule, accession FROM found QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY source_class, rule_order, accession) = 1),
digested AS (SELECT sequence FROM dig UNION ALL SELECT sequence FROM parents), {rand('digested')},
seen AS (SELECT sequence FROM blocked UNION ALL SELECT sequence FROM randoms), {background('seen')}"""
ORACLE["priority_universe"] = f"""WITH {UNIVERSE},
every AS (
 SELECT sequence, CASE WHEN sequence IN (SELECT sequence FROM panelw) THEN 'digestome_known_positive' ELSE 'digestome_background' END AS label,
   source_class || ':' || accession || ':' || rule AS origin, 'document' AS provenance, 0 AS priority, '' AS o FROM dig
 UNION ALL SELECT sequence, 'known_positive', 'panel_spike', 'benchmark', 1, '' FROM parents
 UNION ALL SELECT sequence, 'matched_decoy', 'composition_shuffle:' || parent, 'private matched decoy', 2, parent FROM shufacc
 UNION ALL SELECT sequence, 'matched_decoy', 'length_matched_random:' || parent, 'private matched decoy', 3, parent FROM randoms
 UNION ALL SELECT sequence, 'random_background', 'random_background', 'synthetic', 4, '' FROM noise),
universe AS (SELECT {CID} AS candidate_id, * FROM every QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY priority, o) = 1)
SELECT label, length(sequence) AS length, count(*) AS n,
  CAST(sum(CAST(('0x' || substr(sha256(candidate_id || '|' || sequence || '|' || label || '|' || origin || '|' || provenance), 1, 12))::BIGINT AS HUGEINT)) AS VARCHAR) AS digest
FROM universe GROUP BY 1, 2"""
ORACLE["universe_shortage"] = f"""WITH {UNIVERSE},
got AS (SELECT parent, count(*) AS n FROM (SELECT parent FROM shufacc UNION ALL SELECT parent FROM randoms) GROUP BY 1),
asked AS (SELECT 'matched_decoy' AS kind, q.parent AS owner, CAST(80 AS BIGINT) AS requested, coalesce(n, 0) AS accepted FROM quotas q LEFT JOIN got g ON g.parent = q.parent
 UNION ALL SELECT 'random_background', '', (SELECT count(*) FROM documents), (SELECT count(*) FROM noise))
SELECT *, requested - accepted AS short, CASE WHEN requested > accepted THEN 'no free string of this length' ELSE '' END AS reason FROM asked"""

# ---- features -----------------------------------------------------------------------

ORACLE["composition_features"] = f"""WITH {DOCW} SELECT sequence, length(sequence) AS length, {r(KD)} AS hydropathy, {r(NET)} AS charge,
  {r(frac('FWY'))} AS frac_aromatic, {r(frac('P'))} AS frac_proline, {r(frac('DE'))} AS frac_acidic,
  {', '.join(f'{r(frac(a))} AS frac_{a.lower()}' for a in AA)} FROM docw"""


def letter(i: int) -> str:
    return f"substr(sequence, {i}, 1)" if i > 0 else f"(CASE WHEN length(sequence) >= {-i} THEN substr(sequence, length(sequence) - {-i - 1}, 1) ELSE '' END)"


STEPS = " ".join(f"WHEN length BETWEEN {a} AND {b} THEN {d(v)}" for a, b, v in fixed.LENGTH_STEPS)


def feats(source: str, keep: str = "sequence") -> str:
    return f"""f0 AS (SELECT {keep}, length(sequence) AS length, {frac('AILMFWYV')} AS hyd, {frac('FWY')} AS aro, {frac('KRH')} AS bas,
  {frac('DE')} AS aci, {frac('P')} AS pro, {NET} AS chg, {KD} AS kd, {cnt('C')} AS cys FROM {source}),
f1 AS (SELECT {keep}, length, CASE {STEPS} ELSE {d(0.0)} END AS short_score,
  {in_set(letter(-1), 'PAILMFWYV')} AS cterm_anchor, {in_set(letter(-1), 'P')} AS cterm_proline, {in_set(letter(-1), 'FWY')} AS cterm_aromatic,
  {in_set(letter(-2), 'P')} AS penultimate_proline, {in_set(letter(-3), 'AILMFWYVKRH')} AS antepenult_anchor,
  {in_set(letter(1), 'AILMFWYV')} AS nterm_hydrophobic, {in_set(letter(2), 'KRHP')} AS second_basic_or_proline, {in_set(letter(3), 'P')} AS third_proline,
  {r('hyd')} AS hydrophobic_fraction, {r('aro')} AS aromatic_fraction, {r('bas')} AS basic_fraction, {r('aci')} AS acidic_fraction, {r('pro')} AS proline_fraction,
  {r(tri('hyd', 0.38, 0.38))} AS hydrophobic_balance, {r(tri('pro', 0.32, 0.32))} AS proline_balance, {r('chg')} AS net_charge,
  {r(tri('abs(chg)', 0.45, 1.25))} AS charge_balance, {r('aci')} AS acidic_penalty, CASE WHEN cys > 0 THEN {d(1.0)} ELSE {d(0.0)} END AS cysteine_penalty,
  {r(f"greatest({d(0.0)}, abs(chg) - {d(2.0)}) / {d(3.0)}")} AS extreme_charge_penalty, {r('kd')} AS hydropathy,
  {in_set(letter(-1), 'AILMFWYV')} AS cterm_hydrophobic, {in_set(letter(2), 'KRH')} AS second_basic,
  CASE WHEN length BETWEEN 2 AND 14 THEN {tri('length', 5.0, 7.0)} ELSE {d(0.0)} END AS length_balance,
  {tri('hyd', 0.38, 0.38)} AS x_hyd, {tri('pro', 0.32, 0.32)} AS x_pro, {tri('abs(chg)', 0.45, 1.25)} AS x_chg, aci AS x_aci,
  greatest({d(0.0)}, abs(chg) - {d(2.0)}) / {d(3.0)} AS x_ext FROM f0),
f2 AS (SELECT *, nterm_hydrophobic * second_basic_or_proline * third_proline * CASE WHEN length BETWEEN 3 AND 6 THEN {d(1.0)} ELSE {d(0.0)} END AS triad,
  {tri('aromatic_fraction', 0.12, 0.22)} AS aromatic_balance, {d(1.0)} - acidic_penalty AS acid_free, {d(1.0)} - cysteine_penalty AS cysteine_free FROM f1)"""


ORACLE["domain_features"] = f"""WITH {DOCW}, {feats('docw')} SELECT * EXCLUDE (x_hyd, x_pro, x_chg, x_aci, x_ext) REPLACE ({', '.join(f'{r(c)} AS {c}' for c in
  ('cterm_hydrophobic', 'second_basic', 'length_balance', 'aromatic_balance', 'acid_free', 'cysteine_free'))}) FROM f2"""


def lin(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{d(w)} * {n}" for n, w in weights.items()) + ")"


# The full score takes these features before they are rounded.
EXACT = {"hydrophobic_balance": "x_hyd", "proline_balance": "x_pro", "charge_balance": "x_chg", "acidic_penalty": "x_aci",
         "extreme_charge_penalty": "x_ext"}


def full_score() -> str:
    return r(clamp(lin({EXACT.get(n, n): w for n, w in fixed.MODE_WEIGHTS["sar"].items()})))


def modes(keep: str) -> str:
    cols = ", ".join(f"{full_score() if n == 'sar' else r(clamp(lin(w)))} AS {n}" for n, w in fixed.MODE_WEIGHTS.items())
    names = ", ".join(fixed.MODE_WEIGHTS)
    return f"mw AS (SELECT {keep}, length, {cols} FROM f2), ml AS (UNPIVOT mw ON {names} INTO NAME mode VALUE score)"


ORACLE["score_modes_long"] = f"WITH {DOCW}, {feats('docw')}, {modes('sequence')} SELECT sequence, mode, score FROM ml"
ORACLE["blind_rank"] = f"""WITH {DOCW}, {feats('docw')}, {modes('sequence')}
SELECT {CID} AS candidate_id, sequence, length, score, row_number() OVER (ORDER BY score DESC, length, sequence) AS rank FROM ml WHERE mode = 'sar'"""
_q, _s = evaluation("ml", ["mode"])
ORACLE["mode_sweep_summary"] = f"""WITH {BASE}, {feats('uni', 'candidate_id, sequence, label')}, {modes('sequence, label')}, {_q},
final AS ({_s}) SELECT *, top_1pct_count >= 2 AND top_1pct_fraction >= 0.012 AND (auroc_matched IS NULL OR auroc_matched >= 0.5) AS endpoint_pass FROM final"""
FULL = fixed.MODE_WEIGHTS["sar"]


def ablations() -> str:
    cols = {"full": "sar"}
    for name, removed in fixed.ABLATION_REMOVES.items():
        cols[name] = clamp(f"sar - {lin({k: FULL[k] for k in removed})}")
    cols["composition_only"] = clamp(lin({k: FULL[k] for k in fixed.COMPOSITION_TERMS}))
    cols["hash_control"] = "CAST(('0x' || substr(sha256(candidate_id), 1, 12))::BIGINT AS DOUBLE) / 281474976710655.0::DOUBLE"
    parts = ", ".join(f"{r(e, 9)} AS {n}" for n, e in cols.items())
    return f"""a0 AS (SELECT *, {full_score()} AS sar FROM f2), aw AS (SELECT sequence, label, length, {parts} FROM a0),
al AS (UNPIVOT aw ON {', '.join(f'"{c}"' for c in cols)} INTO NAME ablation VALUE score)"""


_q, _s = evaluation("al", ["ablation"])
ORACLE["ablation_summary"] = f"WITH {BASE}, {feats('uni', 'candidate_id, sequence, label')}, {ablations()}, {_q} {_s}"


def baseline() -> str:
    n = "length(sequence)"
    window = f"CASE WHEN {n} BETWEEN 4 AND 20 THEN {d(1.0)} WHEN {n} BETWEEN 2 AND 3 THEN {d(0.55)} + {d(0.15)} * ({n} - 2) WHEN {n} BETWEEN 21 AND 35 THEN greatest({d(0.0)}, {d(1.0)} - ({n} - 20) / {d(15.0)}) ELSE {d(0.0)} END"
    parts = [f"{d(w)} * {tri(frac(l), t, wd)}" for l, t, wd, w in fixed.BASELINE_TARGETS]
    parts += [f"{d(w)} * ({d(1.0)} - least({d(1.0)}, {frac(l)} / {d(lim)}))" for l, lim, w in fixed.BASELINE_LIMITS]
    return r(clamp(f"{d(0.35)} * ({window}) + {d(0.65)} * ({' + '.join(parts)})"), 10)


_q, _s = evaluation("bl", ["baseline"], drop=("median_rank",))
ORACLE["baseline_score_rank"] = f"WITH {BASE}, bl AS (SELECT 'composition' AS baseline, sequence, length, label, {baseline()} AS score FROM uni), {_q} {_s}"

# ---- components ------------------------------------------------------------------------

RANKED = f"{COMPS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, length, sequence) AS rank, count(*) OVER (PARTITION BY component) AS n_rows FROM comps)"
ORACLE["topk_flags"] = f"""WITH {RANKED} SELECT component, candidate_id, sequence, {r('score')} AS score, rank,
  CAST(rank <= {cut('n_rows', 1.0)} AS INTEGER) AS top_1pct, {', '.join(f'CAST(rank <= {k} AS INTEGER) AS top_{k}' for k in (10, 25, 50, 100))} FROM ranked"""
ORACLE["rank_histogram"] = f"WITH {RANKED} SELECT component, ((rank - 1) // 100 + 1) * 100 AS bucket, count(*) AS n FROM ranked WHERE {POS} GROUP BY 1, 2"
_q, _s = evaluation("comps", ["component"], (0.5, 1.0, 2.0, 5.0, 10.0))
ORACLE["recovery_by_component"] = f"WITH {COMPS}, {_q} {_s}"


def pct(source: str, by: str, constant: float = 0.0) -> str:
    return f"""SELECT * REPLACE (CASE WHEN lo = hi THEN {d(constant)} ELSE (ar - 1) / CAST(greatest(1, cn - 1) AS DOUBLE) END AS score) FROM (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / CAST(2 AS DOUBLE) AS ar,
  count(*) OVER (PARTITION BY {by}) AS cn, min(score) OVER (PARTITION BY {by}) AS lo, max(score) OVER (PARTITION BY {by}) AS hi FROM {source})"""


ORACLE["percentile_components"] = f"WITH {COMPS}, p AS ({pct('comps', 'component')}) SELECT candidate_id, component, {r('score', 9)} AS score FROM p"
ORACLE["lenrank_components"] = f"WITH {COMPS}, p AS ({pct('comps', 'component, length', 0.5)}) SELECT candidate_id, component, {r('score', 9)} AS score FROM p"
ORACLE["component_average_ranks"] = f"WITH {COMPS}, p AS ({pct('comps', 'component')}) SELECT candidate_id, component, ar AS avg_rank FROM p"
ORACLE["minmax_scale"] = f"""WITH {COMPS}, b AS (SELECT component, min(score) AS lo, max(score) AS hi FROM comps GROUP BY 1)
SELECT candidate_id, component, {r('CASE WHEN hi = lo THEN 0.5::DOUBLE ELSE (score - lo) / (hi - lo) END')} AS score FROM comps JOIN b USING (component)"""


def lz(source: str, value: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    o = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT *, ({value} - avg({value}) OVER (PARTITION BY {g}length)) / coalesce(nullif(stddev_pop({value}) OVER (PARTITION BY {g}length), 0),
  nullif(stddev_pop({value}) OVER ({o}), 0), 1) AS z FROM {source})"""


ORACLE["length_z"] = f"WITH {COMPS} SELECT candidate_id, component, {r('z')} AS z FROM {lz('comps', 'score', 'component')}"
ORACLE["score_matrix"] = f"""WITH {COMPS} SELECT 'ml:a:c01' AS component, count(*) AS n, {r('sum(c01)')} AS total FROM wide
UNION ALL SELECT 'ml:a:c02', count(*), {r('sum(c02)')} FROM wide UNION ALL SELECT 'ml:b:c03', count(*), {r('sum(c03)')} FROM wide WHERE label <> 'known_positive'
UNION ALL SELECT 'unscored', count(*), 0 FROM wide WHERE label = 'known_positive' UNION ALL SELECT 'misaligned', count(*), 0 FROM wide WHERE label = 'known_positive'"""

# ---- fusion ----------------------------------------------------------------------------

SCALED = f"{COMPS}, scaled AS ({pct('comps', 'component')})"
MIXW = "mixw AS (SELECT * FROM (VALUES ('c01', 0.5::DOUBLE), ('c02', 0.25::DOUBLE), ('c09', 0.2::DOUBLE), ('c10', 0.1::DOUBLE)) v(component, weight))"
FUSED = "fused AS (SELECT candidate_id, any_value(length) AS length, any_value(sequence) AS sequence, any_value(label) AS label, round_even((sum(weight * score) / sum(weight)) * 1e12, 0) / 1e12 AS score FROM scaled JOIN mixw USING (component) GROUP BY 1)"
ORACLE["weighted_fusion"] = f"WITH {SCALED}, {MIXW}, {FUSED} SELECT 'mix' AS fusion_id, candidate_id, {r('score', 9)} AS score FROM fused"
NAMES = "(SELECT DISTINCT component FROM comps)"
WEIGHTS = f"""wts AS (SELECT 'single__' || component AS fusion_id, component, 1.0::DOUBLE AS weight FROM {NAMES}
 UNION ALL SELECT 'mean__all', component, 0.1::DOUBLE FROM {NAMES}
 UNION ALL SELECT 'mean__low', component, 0.25::DOUBLE FROM {NAMES} WHERE component IN ('c01', 'c02', 'c03', 'c04')
 UNION ALL SELECT 'mean__high', component, 1.0::DOUBLE / 6 FROM {NAMES} WHERE component NOT IN ('c01', 'c02', 'c03', 'c04'))"""
_q, _s = evaluation("kept", ["fusion_id"])
ORACLE["fusion_search"] = f"""WITH {SCALED}, {WEIGHTS},
fz AS (SELECT fusion_id, candidate_id, any_value(length) AS length, any_value(sequence) AS sequence, any_value(label) AS label,
  {r("sum(weight * " + r('score', 9) + ") / sum(weight)", 12)} AS score FROM scaled JOIN wts USING (component) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY fusion_id ORDER BY score DESC, length, sequence) AS rk, count(*) OVER (PARTITION BY fusion_id) AS nn FROM fz),
fc AS (SELECT fusion_id, count(*) FILTER ({POS} AND rk <= {cut('nn', 1.0)}) AS one, count(*) FILTER ({POS} AND rk <= {cut('nn', 10.0)}) AS ten FROM fr GROUP BY 1),
best AS (SELECT fusion_id FROM fc ORDER BY one DESC, ten DESC, fusion_id LIMIT 6),
kept AS (SELECT fusion_id, candidate_id, length, sequence, label, score FROM fz WHERE fusion_id IN (SELECT fusion_id FROM best)), {_q} {_s}"""
# Random sets: gamma(0.55) from gamma(1.55) by the cube of a normal and a squeeze, times a uniform to the power 1 / 0.55.
UNI = lambda kind, more="": f"((('0x' || substr(sha256('20260101:' || grp || ':' || t || ':' || component || ':{kind}'{more}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"
SHAPE = "(1.55::DOUBLE - 1.0::DOUBLE / 3.0::DOUBLE)"
RANDOM = f"""members AS (SELECT 'all' AS grp, component FROM {NAMES} UNION ALL SELECT 'low', component FROM {NAMES} WHERE component IN ('c01', 'c02', 'c03', 'c04')
 UNION ALL SELECT 'high', component FROM {NAMES} WHERE component NOT IN ('c01', 'c02', 'c03', 'c04') UNION ALL SELECT 'preferred', component FROM {NAMES} WHERE component IN ('c01', 'c07')),
tries AS (SELECT grp, component, t, k, sqrt(-2 * ln({UNI('r', " || ':' || k")})) * cos(2 * pi() * {UNI('a', " || ':' || k")}) AS x, {UNI('u', " || ':' || k")} AS u, {UNI('p')} AS p
 FROM members, range(0, 20) a(t), range(1, 17) b(k)),
cubes AS (SELECT *, pow(1 + x / sqrt(9 * {SHAPE}), 3) AS v FROM tries),
gam AS (SELECT grp, component, t, {SHAPE} * min_by(v, k) * pow(any_value(p), 1 / 0.55::DOUBLE) AS g FROM cubes
 WHERE CASE WHEN v > 0 THEN ln(u) < 0.5 * x * x + {SHAPE} * (1 - v + ln(v)) ELSE false END GROUP BY 1, 2, 3),
rnd AS (SELECT 'dirichlet__' || grp || '__' || lpad(t::VARCHAR, 4, '0') AS fusion_id, component, {r('g / sum(g) OVER (PARTITION BY grp, t)', 8)} AS weight FROM gam),
sets AS (SELECT * FROM wts UNION ALL SELECT 'mean__preferred', component, 0.5 FROM {NAMES} WHERE component IN ('c01', 'c07')
 UNION ALL SELECT 'mean__alone', 'c01', 1.0 UNION ALL SELECT * FROM rnd WHERE weight > 1e-5)"""
_q, _s = evaluation("kept", ["fusion_id"])
ORACLE["random_fusion_search"] = f"""WITH {SCALED}, {WEIGHTS}, {RANDOM},
fz AS (SELECT fusion_id, candidate_id, any_value(length) AS length, any_value(sequence) AS sequence, any_value(label) AS label,
  {r("sum(weight * " + r('score', 9) + ") / sum(weight)", 12)} AS score FROM scaled JOIN sets USING (component) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY fusion_id ORDER BY score DESC, length, sequence) AS rk, count(*) OVER (PARTITION BY fusion_id) AS nn FROM fz),
fc AS (SELECT fusion_id, count(*) FILTER ({POS} AND rk <= {cut('nn', 1.0)}) AS one, count(*) FILTER ({POS} AND rk <= {cut('nn', 10.0)}) AS ten FROM fr GROUP BY 1),
maps AS (SELECT fusion_id, string_agg(component || '=' || weight, ',' ORDER BY component) AS map FROM sets GROUP BY 1),
first_sets AS (SELECT fusion_id, map, row_number() OVER (ORDER BY one DESC, ten DESC, fusion_id) AS place FROM fc JOIN maps USING (fusion_id)),
best AS (SELECT min_by(fusion_id, place) AS fusion_id FROM first_sets WHERE place <= 120 GROUP BY map ORDER BY min(place) LIMIT 40),
kept AS (SELECT fusion_id, candidate_id, length, sequence, label, score FROM fz WHERE fusion_id IN (SELECT fusion_id FROM best)), {_q} {_s}"""
GATE = lambda p: f"CAST(greatest({cut('gn', 1.0)}, ceil(round(gn * {p} / 100.0::DOUBLE, 9))) AS BIGINT)"
_q, _s = evaluation("kept", ["rerank_id", "gate_component", "rank_component", "gate_percent"])
ORACLE["two_stage_rerank"] = f"""WITH {SCALED},
gates AS (SELECT candidate_id, component AS gate_component, row_number() OVER (PARTITION BY component ORDER BY score DESC, length, sequence) AS gr,
  count(*) OVER (PARTITION BY component) AS gn FROM scaled WHERE component IN ('c01', 'c02', 'c09')),
staged AS (SELECT gate_component, component AS rank_component, gate_percent, candidate_id, length, sequence, label, gn,
  CASE WHEN gr <= {GATE('gate_percent')} THEN score ELSE score - 2 END AS score
  FROM scaled JOIN gates USING (candidate_id), (VALUES (2.0::DOUBLE), (5.0), (10.0), (15.0)) g(gate_percent) WHERE component IN ('c03', 'c04', 'c10')),
sr AS (SELECT *, row_number() OVER (PARTITION BY gate_component, rank_component, gate_percent ORDER BY score DESC, length, sequence) AS rk FROM staged),
sc AS (SELECT gate_component, rank_component, gate_percent, 'gate' || gate_percent || '__' || gate_component || '__rank__' || rank_component AS rerank_id,
  count(*) FILTER ({POS} AND rk <= {cut('gn', 1.0)}) AS one, count(*) FILTER ({POS} AND rk <= least({cut('gn', 10.0)}, {GATE('gate_percent')})) AS ten
  FROM sr GROUP BY 1, 2, 3),
best AS (SELECT * FROM sc ORDER BY one DESC, ten DESC, rerank_id LIMIT 8),
kept AS (SELECT rerank_id, s.gate_component, s.rank_component, s.gate_percent, candidate_id, length, sequence, label, score FROM staged s JOIN best b
  ON s.gate_component = b.gate_component AND s.rank_component = b.rank_component AND s.gate_percent = b.gate_percent), {_q} {_s}"""
RECIPE = f"""{COMPS},
rawall AS (SELECT candidate_id, length, sequence, label, component, score FROM comps UNION ALL
  SELECT candidate_id, length, sequence, label, 'lenrank:' || component, score FROM ({pct('comps', 'component, length', 0.5)})),
scaled AS (SELECT candidate_id, length, sequence, label, component, score FROM ({pct('rawall', 'component')})), {MIXW}, {FUSED},
allc AS (SELECT * FROM scaled UNION ALL SELECT candidate_id, length, sequence, label, 'fusion:mix', score FROM fused),
again AS ({pct('allc', 'component')}),
gates AS (SELECT candidate_id, row_number() OVER (ORDER BY score DESC, length, sequence) AS gr, count(*) OVER () AS gn FROM again WHERE component = 'fusion:mix'),
rec AS (SELECT candidate_id, length, sequence, label, gr <= {GATE('7.5::DOUBLE')} AS gated,
  CASE WHEN gr <= {GATE('7.5::DOUBLE')} THEN score ELSE score - 2 END AS score, 'mix-gate' AS recipe_id FROM again JOIN gates USING (candidate_id) WHERE component = 'lenrank:c02')"""
ORACLE["frozen_recipe"] = f"""WITH {RECIPE} SELECT candidate_id, row_number() OVER (ORDER BY score DESC, length, sequence) AS rank, {r('score', 9)} AS score,
  CAST(gated AS INTEGER) AS gated FROM rec"""
_q, _s = evaluation("rec", ["recipe_id"])
ORACLE["frozen_recipe_summary"] = f"WITH {RECIPE}, {_q} {_s}"

# ---- strata --------------------------------------------------------------------------------

LABELLED = """ld AS (SELECT doc_id, lang, source, n_chars, toxic, quality = 1 AS pos, row_number() OVER (ORDER BY n_chars DESC, lpad(CAST(doc_id AS VARCHAR), 10, '0')) AS rank,
  count(*) OVER () AS n_rows FROM documents JOIN labels USING (doc_id)), lp AS (SELECT * FROM ld WHERE pos)"""


def strata(source: str, extra: str = "") -> str:
    return f"""nums AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY rank) AS hit FROM {source}),
summ AS (SELECT tag, count(*) AS n_positive, max(n_rows) AS n_rows, count(*) FILTER (rank <= {cut('n_rows', 1.0)}) AS top_1pct_count,
  count(*) FILTER (rank <= {cut('n_rows', 10.0)}) AS top_10pct_count, count(*) FILTER (rank <= 100) AS top_100_count,
  {r('avg(rank)')} AS mean_rank, {r('quantile_cont(CAST(rank AS DOUBLE), 0.5)')} AS median_rank,
  {r('CAST(list_sort(list(rank))[count(*) // 2 + 1] AS DOUBLE)')} AS upper_median_rank, min(rank) AS best_rank, {r('avg(hit / CAST(rank AS DOUBLE))')} AS ap_ranked
  FROM nums GROUP BY 1)"""


def lifted(percents) -> str:
    """Columns of enrichment and tail at the percent cuts, over a stratum's counts."""
    out = []
    for p in percents:
        n = f"top_{tag(p)}pct"
        out.append(f"{r(f'{n}_count / CAST(n_positive AS DOUBLE)')} AS {n}_fraction, "
                   f"{r(f'{n}_count / greatest(1e-12, n_positive * ' + cut('n_rows', p) + ' / CAST(n_rows AS DOUBLE))')} AS {n}_enrichment, "
                   f"{r(tail(f'{n}_count', 'n_rows', 'n_positive', cut('n_rows', p)))} AS {n}_p")
    return ", ".join(out)


ORACLE["stratified_recovery"] = f"""WITH {LABELLED}, tagged AS (SELECT 'all' AS tag, * FROM lp UNION ALL SELECT 'english', * FROM lp WHERE lang = 'en'
 UNION ALL SELECT 'short', * FROM lp WHERE n_chars <= 500 UNION ALL SELECT 'short_english', * FROM lp WHERE n_chars <= 500 AND lang = 'en'
 UNION ALL SELECT 'toxic', * FROM lp WHERE toxic = 1 UNION ALL SELECT 'first_source', * FROM lp WHERE source = 'src0'), {strata('tagged')}
SELECT w.tag, coalesce(n_positive, 0) AS n_positive, coalesce(top_1pct_count, 0) AS top_1pct_count, coalesce(top_10pct_count, 0) AS top_10pct_count,
  coalesce(top_100_count, 0) AS top_100_count, mean_rank, median_rank, upper_median_rank, best_rank, ap_ranked, top_1pct_fraction, top_1pct_enrichment, top_1pct_p
FROM (VALUES ('all'), ('english'), ('short'), ('short_english'), ('toxic'), ('first_source'), ('empty')) w(tag) LEFT JOIN (SELECT *, {lifted([1.0])} FROM summ) summ ON summ.tag = w.tag"""
ORACLE["failure_strata"] = f"""WITH {LABELLED}, tagged AS (SELECT 'all' AS tag, * FROM lp UNION ALL SELECT 'source:' || source, * FROM lp UNION ALL SELECT 'lang:' || lang, * FROM lp
 UNION ALL SELECT 'chars_le_1000', * FROM lp WHERE n_chars <= 1000 UNION ALL SELECT 'chars_le_3000', * FROM lp WHERE n_chars <= 3000
 UNION ALL SELECT 'toxic', * FROM lp WHERE toxic = 1), {strata('tagged')} SELECT *, {lifted([1.0])} FROM summ"""
_by_mode = strata("tagged").replace("PARTITION BY tag", "PARTITION BY mode, tag").replace("(SELECT tag,", "(SELECT mode, tag,").replace("GROUP BY 1)", "GROUP BY 1, 2)")
ORACLE["mode_failure_strata"] = f"""WITH {BASE}, {feats('uni', 'candidate_id, sequence, label')}, {modes('sequence, label')},
rk AS (SELECT mode, sequence, label, row_number() OVER (PARTITION BY mode ORDER BY score DESC, length, sequence) AS rank, count(*) OVER (PARTITION BY mode) AS n_rows FROM ml),
bw AS (SELECT item_id, w.word, w.place FROM (SELECT item_id, unnest(list_zip(split, range(len(split)))) AS z FROM
  (SELECT item_id, string_split(trim(upper(regexp_replace({FOLDED}, '[^A-Za-z]+', ' ', 'g'))), ' ') AS split FROM benchmark)), LATERAL (SELECT z[1] AS word, z[2] AS place) w WHERE w.word <> ''),
lastrow AS (SELECT translate(word, 'BJOUXZ', 'DLPCAE') AS sequence, item_id % 4 AS material FROM bw
  QUALIFY row_number() OVER (PARTITION BY translate(word, 'BJOUXZ', 'DLPCAE') ORDER BY item_id DESC, place DESC) = 1),
hit AS (SELECT rk.*, material, length(rk.sequence) AS size FROM rk JOIN lastrow USING (sequence) WHERE {POS}),
tagged AS (SELECT *, 'all' AS tag FROM hit UNION ALL SELECT *, 'material:' || material FROM hit UNION ALL SELECT *, 'length_le_3' FROM hit WHERE size <= 3
 UNION ALL SELECT *, 'length_4_6' FROM hit WHERE size BETWEEN 4 AND 6 UNION ALL SELECT *, 'length_gt_6' FROM hit WHERE size > 6
 UNION ALL SELECT *, 'ends_proline' FROM hit WHERE sequence LIKE '%P'), {_by_mode} SELECT *, {lifted([1.0, 10.0])} FROM summ"""
ORACLE["panel_composition"] = f"""WITH rows0 AS (SELECT 'benchmark' AS panel, item_id AS reference, word FROM {words('benchmark', 'item_id')}
 UNION ALL SELECT 'conversations_' || role, conv_id, word FROM {words('conversations', 'conv_id, role')})
SELECT panel, count(*) AS n, count(DISTINCT reference) AS reference_count, count(DISTINCT substr(word, 1, 1)) AS material_count,
  count(*) FILTER (length(word) <= 5) AS length_le_5_count, count(*) FILTER (length(word) > 5) AS length_gt_5_count,
  count(*) FILTER (word LIKE '%P') AS ends_proline_count, count(*) FILTER (word NOT LIKE '%P') AS ends_other_count FROM rows0 GROUP BY 1"""

# ---- overlap and neighbours ------------------------------------------------------------------

ORACLE["overlap_audit"] = f"""WITH {PANELW}, {PRIORW}, o AS (SELECT count(*) AS candidate_count, count(*) FILTER (sequence IN (SELECT sequence FROM priorw)) AS overlap_count FROM panelw)
SELECT candidate_count, overlap_count, (SELECT count(DISTINCT sequence) FROM priorw) AS excluded_count, (SELECT count(DISTINCT panel) FROM priorw) AS panel_count,
  CASE WHEN overlap_count = 0 THEN 'pass' ELSE 'fail' END AS status FROM o"""
ORACLE["overlap_panels"] = f"""WITH {PANELW}, {PRIORW} SELECT sequence, string_agg(panel, ';' ORDER BY panel) AS panels FROM priorw JOIN panelw USING (sequence) GROUP BY 1"""
ORACLE["exclusion_antijoin"] = f"WITH {DOCW}, {PRIORW} SELECT sequence, min_doc_id, n FROM docw WHERE sequence NOT IN (SELECT sequence FROM priorw)"
NEAR = f"""{PANELW}, {PRIORW}, pr AS (SELECT DISTINCT sequence AS other FROM priorw),
dist AS (SELECT sequence, other, levenshtein(sequence, other) AS dd FROM panelw, pr),
distid AS (SELECT *, greatest(0.0::DOUBLE, 1 - dd / CAST(greatest(length(sequence), length(other)) AS DOUBLE)) AS ident FROM dist),
cnts AS (SELECT sequence, count(*) FILTER (dd = 1) AS one_edit, count(*) FILTER (dd BETWEEN 1 AND 2) AS two_edit, count(*) FILTER (dd > 0 AND ident >= 0.8::DOUBLE) AS high_identity FROM distid GROUP BY 1),
near AS (SELECT * FROM distid QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY dd, -ident, abs(length(sequence) - length(other)), other) = 1),
aud AS (SELECT n.sequence, n.other AS nearest, n.dd AS nearest_distance, {r('n.ident', 4)} AS nearest_identity, one_edit, two_edit, high_identity,
  (SELECT count(*) FROM pr WHERE length(n.sequence) >= 2 AND length(pr.other) >= 2 AND right(pr.other, 2) = right(n.sequence, 2)) AS suffix2_count,
  (SELECT count(*) FROM pr WHERE length(n.sequence) >= 3 AND length(pr.other) >= 3 AND right(pr.other, 3) = right(n.sequence, 3)) AS suffix3_count,
  (SELECT string_agg(panel, ';' ORDER BY panel) FROM priorw p WHERE p.sequence = n.other) AS nearest_panels FROM near n JOIN cnts c ON n.sequence = c.sequence),
classed AS (SELECT *, CASE WHEN nearest_distance = 0 THEN 'exact_overlap' WHEN one_edit > 0 THEN 'single_edit_neighbor' WHEN high_identity > 0 THEN 'high_similarity_neighbor'
  WHEN suffix3_count > 0 THEN 'shared_suffix3' WHEN suffix2_count > 0 THEN 'shared_suffix2' ELSE 'distant' END AS neighborhood_class FROM aud)"""
ORACLE["nearest_neighbor_audit"] = f"WITH {NEAR} SELECT * REPLACE (CAST(nearest_distance AS INTEGER) AS nearest_distance) FROM classed"
_CLASSES = ("exact_overlap", "single_edit_neighbor", "high_similarity_neighbor", "shared_suffix3", "shared_suffix2", "distant")
ORACLE["neighborhood_report"] = f"""WITH {DOCW}, {NEAR},
{UNI}, {feats('uni', 'candidate_id, sequence, label')}, {modes('sequence, label')},
rk AS (SELECT sequence, row_number() OVER (ORDER BY score DESC, length, sequence) AS rank, CAST(greatest(1, ceil(count(*) OVER () / 100.0)) AS BIGINT) AS threshold FROM ml WHERE mode = 'sar'),
au AS (SELECT c.*, threshold, coalesce(rank <= threshold, false) AS top FROM classed c JOIN rk USING (sequence))
SELECT count(*) AS positive_count, max(threshold) AS threshold, count(*) FILTER (top) AS top_1pct_count,
  {', '.join(f"count(*) FILTER (neighborhood_class = '{c}') AS {c}_count, count(*) FILTER (top AND neighborhood_class = '{c}') AS top_1pct_{c}_count" for c in _CLASSES)},
  {r('avg(nearest_identity)', 6)} AS mean_identity, {r('quantile_cont(CAST(nearest_identity AS DOUBLE), 0.5)', 6)} AS median_identity FROM au"""
ORACLE["neighborhood_summary"] = f"WITH {NEAR} SELECT neighborhood_class, count(*) AS n, {r('avg(nearest_identity)', 4)} AS mean_identity FROM classed GROUP BY 1"
ORACLE["suffix_sharing"] = f"""WITH {DOCW}, {PRIORW}, pr AS (SELECT DISTINCT sequence AS other FROM priorw),
s2 AS (SELECT right(other, 2) AS e, count(*) AS c FROM pr WHERE length(other) >= 2 GROUP BY 1), s3 AS (SELECT right(other, 3) AS e, count(*) AS c FROM pr WHERE length(other) >= 3 GROUP BY 1)
SELECT sequence, coalesce(s2.c, 0) AS suffix2_count, coalesce(s3.c, 0) AS suffix3_count FROM docw
LEFT JOIN s2 ON length(sequence) >= 2 AND s2.e = right(sequence, 2) LEFT JOIN s3 ON length(sequence) >= 3 AND s3.e = right(sequence, 3)"""

# ---- notes ------------------------------------------------------------------------------------

NOTES = """nt AS (SELECT event_id, user_id, event_type, value, CASE event_type WHEN 'click' THEN 'Reported IC50 ' || value || ' uM after digestion'
  WHEN 'view' THEN 'IC50 of ' || value || ' mg per mL for the synthesis product' WHEN 'purchase' THEN 'IC50 from ' || value || '-' || (value + 10.0::DOUBLE) || ' mM'
  WHEN 'signup' THEN value || ' percent ACE inhibition' ELSE 'activity seen in a hydrolysate' END AS notes FROM events)"""
# What each note kind must parse to, from the kind itself.
META = f"""{NOTES}, md AS (SELECT event_id, user_id, notes,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value END AS ic50_value_low,
  CASE WHEN event_type = 'purchase' THEN value + 10.0::DOUBLE END AS ic50_value_high,
  CASE event_type WHEN 'click' THEN 'uM' WHEN 'view' THEN 'mg/mL' WHEN 'purchase' THEN 'mM' END AS ic50_unit,
  CASE event_type WHEN 'click' THEN value WHEN 'purchase' THEN value * 1000.0::DOUBLE END AS ic50_um_low,
  CASE event_type WHEN 'purchase' THEN (value + 10.0::DOUBLE) * 1000.0::DOUBLE END AS ic50_um_high,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'IC50' WHEN event_type = 'signup' THEN 'fixed_concentration_inhibition' ELSE 'activity_reported' END AS readout,
  CASE WHEN event_type = 'signup' THEN value END AS inhibition_percent,
  CASE event_type WHEN 'click' THEN 'post_digestive_assay' WHEN 'error' THEN 'hydrolysate_or_digest_context' ELSE 'not_specified' END AS digestive_context,
  CASE event_type WHEN 'view' THEN 'synthesized_peptide_ic50' WHEN 'click' THEN 'reported_ic50' WHEN 'purchase' THEN 'reported_ic50'
    WHEN 'signup' THEN 'fixed_concentration_activity' ELSE 'reported_activity' END AS evidence,
  CASE WHEN event_type = 'click' THEN value END AS potency_um FROM nt)"""
SHORT = lambda v: f"regexp_replace(CAST(CAST({v} AS DECIMAL(24, 6)) AS VARCHAR), '\\.?0+$', '')"
ORACLE["assay_metadata"] = f"""WITH {META} SELECT event_id, notes, {r('ic50_value_low')} AS ic50_value_low, {r('ic50_value_high')} AS ic50_value_high, ic50_unit,
  CASE WHEN ic50_value_high IS NOT NULL THEN {SHORT('ic50_value_low')} || '-' || {SHORT('ic50_value_high')} WHEN ic50_value_low IS NOT NULL THEN {SHORT('ic50_value_low')} END AS ic50_value_text,
  {r('ic50_um_low')} AS ic50_um_low, {r('ic50_um_high')} AS ic50_um_high, readout, {r('inhibition_percent')} AS inhibition_percent,
  digestive_context, evidence, {r('potency_um')} AS potency_um FROM md"""
ORACLE["metadata_counts"] = f"""WITH {META} SELECT readout, evidence, digestive_context, count(*) AS n, count(DISTINCT user_id) AS users, count(ic50_um_low) AS with_um,
  count(*) FILTER (lower(ic50_unit) IN ('mg/ml', 'ug/ml')) AS with_mass FROM md GROUP BY 1, 2, 3"""


def pw(v: str, ref: float, top: float) -> str:
    return f"CASE WHEN {v} <= 0 THEN {d(top)} ELSE greatest({d(1.0)}, least({d(top)}, {d(1.0)} + greatest({d(0.0)}, log10({d(ref)} / greatest({v}, {d(1e-6)}))))) END"


ORACLE["potency_weights"] = f"WITH {META} SELECT user_id AS sequence, {r('max(' + pw('ic50_um_low', 1000.0, 3.0) + ')')} AS weight FROM md WHERE ic50_um_low IS NOT NULL GROUP BY 1"
ORACLE["training_merge"] = f"""WITH {BASE}, bg AS (SELECT sequence, label, row_number() OVER (PARTITION BY label ORDER BY
  CAST(('0x' || substr(sha256('train:' || sequence), 1, 12))::BIGINT AS DOUBLE), sequence) AS rk FROM uni WHERE label = 'digestome_background'),
np AS (SELECT greatest(1, count(*)) * 4 AS quota FROM uni WHERE {POS})
SELECT sequence, label, CASE WHEN {POS} THEN {r(pw('CAST(n AS DOUBLE)', 100.0, 3.0))} ELSE 1.0::DOUBLE END AS weight FROM uni WHERE {POS} OR label = 'matched_decoy'
UNION ALL SELECT sequence, label, 1.0::DOUBLE FROM bg, np WHERE rk <= quota // 2"""

# ---- strings ---------------------------------------------------------------------------------------

GRAMS = " UNION ALL ".join(
    f"SELECT sequence, 'kmer_{k}=' || substr(sequence, CAST(i AS BIGINT), {k}) AS token, length(sequence) - {k - 1} AS size FROM docw, unnest(range(1, CAST(length(sequence) - {k - 2} AS BIGINT))) t(i)"
    for k in (2, 3)
)
ORACLE["kmer_frequencies"] = f"WITH {DOCW}, g AS ({GRAMS}) SELECT sequence, token, {r('count(*) / CAST(any_value(size) AS DOUBLE)')} AS value FROM g GROUP BY 1, 2"
EDGES = " UNION ALL ".join(
    f"SELECT 'first_{k}=' || left(sequence, {k}) AS token, n FROM docw WHERE length(sequence) >= {k} UNION ALL SELECT 'last_{k}=' || right(sequence, {k}), n FROM docw WHERE length(sequence) >= {k}"
    for k in (1, 2, 3)
)
ORACLE["edge_ngrams"] = f"WITH {DOCW}, e AS ({EDGES}) SELECT token, count(*) AS n_sequences, CAST(sum(n) AS BIGINT) AS n_occurrences FROM e GROUP BY 1"
PLACES = [
    f"SELECT 'first_pos_{i + 1}=' || CASE WHEN length(sequence) > {i} THEN substr(sequence, {i + 1}, 1) ELSE '_' END AS token FROM docw UNION ALL "
    f"SELECT 'last_pos_{i + 1}=' || CASE WHEN length(sequence) > {i} THEN substr(sequence, length(sequence) - {i}, 1) ELSE '_' END FROM docw"
    for i in range(5)
] + [
    f"SELECT 'first_pair_{i + 1}=' || CASE WHEN length(sequence) > {i + 1} THEN substr(sequence, {i + 1}, 2) ELSE '_' END FROM docw UNION ALL "
    f"SELECT 'last_pair_{i + 1}=' || CASE WHEN length(sequence) > {i + 1} THEN substr(sequence, length(sequence) - {i + 1}, 2) ELSE '_' END FROM docw"
    for i in range(3)
]
ORACLE["position_categories"] = f"WITH {DOCW}, e AS ({' UNION ALL '.join(PLACES)}) SELECT token, count(*) AS n_sequences FROM e GROUP BY 1"
ORACLE["motif_counts"] = f"""WITH {DOCW} SELECT length(sequence) AS length, count(*) FILTER (sequence LIKE '%P') AS ends_proline,
  count(*) FILTER (right(sequence, 1) IN ('F', 'W', 'Y')) AS ends_aromatic, count(*) FILTER (right(sequence, 1) IN ('K', 'R', 'H')) AS ends_basic,
  count(*) FILTER (right(sequence, 1) IN ('D', 'E')) AS ends_acidic, {', '.join(f"count(*) FILTER (contains(sequence, '{m}')) AS contains_{m.lower()}" for m in ('PP', 'GP', 'PR', 'LRP', 'YY'))},
  CAST(sum(length(sequence) * length(sequence)) AS BIGINT) AS length_squared FROM docw GROUP BY 1"""

NUMBERS = (
    "short_score, cterm_anchor, cterm_proline, cterm_aromatic, penultimate_proline, antepenult_anchor, nterm_hydrophobic, second_basic_or_proline, "
    "third_proline, hydrophobic_fraction, aromatic_fraction, basic_fraction, acidic_fraction, proline_fraction, hydrophobic_balance, proline_balance, "
    "net_charge, charge_balance, triad, acidic_penalty, cysteine_penalty, extreme_charge_penalty, hydropathy, length"
).split(", ")
FLAGS = {
    "ends_proline": "right(sequence, 1) = 'P'", "ends_aromatic": "right(sequence, 1) IN ('F', 'W', 'Y')", "ends_basic": "right(sequence, 1) IN ('K', 'R', 'H')",
    "ends_acidic": "right(sequence, 1) IN ('D', 'E')", **{f"contains_{m.lower()}": f"contains(sequence, '{m}')" for m in ("PP", "GP", "PR", "LRP", "YY")},
}
SINGLE = {n: f"CASE WHEN {c} THEN 1 ELSE 0 END" for n, c in FLAGS.items()} | {"length_squared": "length(sequence) * length(sequence)"}
SINGLE |= {f"count_{a}": cnt(a) for a in AA} | {f"share_{a}": frac(a) for a in AA}
TOKENS = f"""{PANELW}, docw AS (SELECT sequence, 1 AS n FROM panelw), {feats('docw')}, {modes('sequence')},
numbers AS (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in NUMBERS)} FROM f2),
singles AS (SELECT {', '.join(f'({c})::DOUBLE AS {n}' for n, c in SINGLE.items())} FROM docw),
grams AS (SELECT sequence, token, count(*) / CAST(any_value(size) AS DOUBLE) AS value FROM ({GRAMS}) GROUP BY 1, 2),
tok AS (SELECT * FROM (UNPIVOT numbers ON {', '.join(NUMBERS)} INTO NAME token VALUE value) UNION ALL SELECT * FROM (UNPIVOT singles ON {', '.join(SINGLE)} INTO NAME token VALUE value)
  UNION ALL SELECT 'mode_' || mode, score FROM ml UNION ALL SELECT token, 1 FROM ({EDGES}) UNION ALL SELECT token, 1 FROM ({' UNION ALL '.join(PLACES)}) UNION ALL SELECT token, value FROM grams)"""
ORACLE["training_tokens"] = f"WITH {TOKENS} SELECT token, count(*) AS n, {r('sum(value)', 4)} AS total FROM tok GROUP BY 1"

PWM_ROWS = []
for _name, _m in cut_matrices.CUT_MATRICES.items():
    for _off, _w in _m["positions"].items():
        for _a in AA + "_":
            PWM_ROWS.append(f"('{_name}', {_off}, '{_a}', {float(_w.get(_a, _w.get('*', 0.0)))!r}::DOUBLE)")
PWM_META = ", ".join(f"('{n}', {float(m['intercept'])!r}::DOUBLE, {m['min_probability']!r}::DOUBLE)" for n, m in cut_matrices.CUT_MATRICES.items())
PWM = f"""{DOCW}, pwm AS (SELECT * FROM (VALUES {', '.join(PWM_ROWS)}) v(enzyme, off, residue, weight)), pm AS (SELECT * FROM (VALUES {PWM_META}) v(enzyme, intercept, threshold)),
places AS (SELECT sequence, i AS position FROM docw, unnest(range(1, CAST(length(sequence) AS BIGINT))) t(i)),
offs AS (SELECT DISTINCT enzyme, off FROM pwm),
scored AS (SELECT sequence, position, enzyme, CASE WHEN position + off BETWEEN 1 AND length(sequence) THEN substr(sequence, CAST(position + off AS BIGINT), 1) ELSE '_' END AS residue, off FROM places, offs),
logits AS (SELECT sequence, position, enzyme, sum(weight) AS total FROM scored JOIN pwm USING (enzyme, off, residue) GROUP BY 1, 2, 3),
sites AS (SELECT sequence, enzyme, position, 1 / (1 + exp(-(total + intercept))) AS probability, substr(sequence, CAST(position AS BIGINT), 1) AS residue,
  substr(sequence, CAST(position + 1 AS BIGINT), 1) AS next_residue FROM logits JOIN pm USING (enzyme) WHERE 1 / (1 + exp(-(total + intercept))) >= threshold)"""
ORACLE["pwm_sites"] = f"WITH {PWM} SELECT sequence, enzyme, CAST(position AS INTEGER) AS position, {r('probability')} AS probability, residue, next_residue FROM sites"
ORACLE["pwm_profile"] = f"""WITH {PWM}, a AS (SELECT sequence, enzyme, count(*) AS k, 1 - product(1 - probability) AS p FROM sites GROUP BY 1, 2)
SELECT sequence, enzyme, CAST(coalesce(k, 0) AS INTEGER) AS n_sites, {r('coalesce(p, 0::DOUBLE)')} AS probability FROM docw CROSS JOIN pm LEFT JOIN a USING (sequence, enzyme)"""
ORACLE["pwm_stability"] = f"""WITH {PWM}, a AS (SELECT sequence, {', '.join(f"count(*) FILTER (enzyme = '{n}') AS {n}" for n in cut_matrices.CUT_MATRICES)} FROM sites
  WHERE probability >= 0.2 AND next_residue <> 'P' GROUP BY 1)
SELECT sequence, {', '.join(f'CAST(coalesce({n}, 0) AS INTEGER) AS {n}_sites' for n in cut_matrices.CUT_MATRICES)},
  {r("1.0::DOUBLE - least((coalesce(trypsin, 0) + coalesce(chymotrypsin, 0) + coalesce(pepsin, 0)) / CAST(greatest(1, length(sequence) - 1) AS DOUBLE), 1.0::DOUBLE)")} AS stability
FROM docw LEFT JOIN a USING (sequence)"""

RES = "rt AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {fixed.HYDROPATHY[a]!r}::DOUBLE, {charge_of(a, 6.8)!r}::DOUBLE)" for a in AA) + ") v(a, kd, ch))"
POSN = f"{DOCW}, {RES}, ps AS (SELECT sequence, i, kd, ch, a FROM (SELECT sequence, i, substr(sequence, CAST(i AS BIGINT), 1) AS a FROM docw, unnest(range(1, CAST(length(sequence) + 1 AS BIGINT))) t(i)) JOIN rt USING (a))"
ORACLE["uptake_index"] = f"""WITH {POSN}, win AS (SELECT p.sequence, p.i, w.w, sum(q.kd) AS kd, sum(q.ch) AS ch, any_value(p.kd) AS k0 FROM ps p, (VALUES (2), (3)) w(w), ps q
  WHERE p.sequence = q.sequence AND q.i BETWEEN p.i AND p.i + w.w - 1 AND p.i + w.w - 1 <= length(p.sequence) GROUP BY 1, 2, 3),
s AS (SELECT sequence, avg((1 - least(abs({d(ends(6.8))} + ch) / 2, 1) + greatest(0, least(1, k0 / 2.5::DOUBLE)) + 1 - least(abs(kd / w - 0.5::DOUBLE) / 3, 1)) / 3) AS u FROM win GROUP BY 1)
SELECT sequence, coalesce({r(clamp('u'))}, {d(0.0)}) AS uptake FROM docw LEFT JOIN s USING (sequence)"""
ORACLE["hydrophobic_moment"] = f"""WITH {POSN}, m AS (SELECT sequence, sqrt(pow(sum(kd * cos({d(math.radians(100.0))} * (i - 1))), 2) + pow(sum(kd * sin({d(math.radians(100.0))} * (i - 1))), 2)) / length(sequence) AS moment FROM ps GROUP BY 1)
SELECT sequence, {r('moment')} AS moment, {r(clamp('moment / 4.5::DOUBLE'))} AS moment_norm FROM m"""
ORACLE["engagement"] = f"""WITH {DOCW} SELECT sequence, {r(clamp(f"{d(0.4)} * least({frac('KRH')} / {d(0.35)}, 1) + {d(0.3)} * least({frac('FWY')} / {d(0.25)}, 1) + {d(0.3)} * least({frac('AILMFWYV')} / {d(0.6)}, 1)"))} AS engagement FROM docw"""
ORACLE["exposure"] = f"WITH {DOCW} SELECT sequence, {r(clamp(f'({d(4.5)} - {KD}) / {d(9.0)}'))} AS exposure FROM docw"
ORACLE["property_trace"] = f"""WITH {POSN} SELECT sequence, CAST(i AS INTEGER) AS position, a AS residue, {r('avg(kd) OVER w')} AS hydropathy, {r('avg(ch) OVER w')} AS charge FROM ps
WINDOW w AS (PARTITION BY sequence ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


def runs(letters: str, least: int, s: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({s}, '[{letters}]{{{least},}}'), lambda x: length(x) - {least - 1})), 0)"


def run_sql(s: str) -> dict[str, str]:
    n = f"CAST(length({s}) AS DOUBLE)"
    pairs = f"(length({s}) - length(replace({s}, 'CW', 'C')) + length({s}) - length(replace({s}, 'HW', 'H')))"
    return {
        "aromatic_fraction": frac("FWY", s),
        "basic_fraction": f"({cnt('RK', s)} + least({cnt('H', s)}, 0.5::DOUBLE * length({s}))) / {n}",
        "turn_score": f"least(1.0::DOUBLE, CASE WHEN contains({s}, 'P') THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN contains({s}, 'GP') OR contains({s}, 'PG') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches({s}, '[FWY]..[FWY]') THEN 0.2::DOUBLE ELSE 0 END)",
        "length_score": f"greatest(0.0::DOUBLE, 1 - abs({n} - 8) / 4)",
        "net_charge": f"({cnt('RK', s)} + 0.1::DOUBLE * {cnt('H', s)} - {cnt('DE', s)})",
        "charge_score": f"exp(-abs({cnt('RK', s)} + 0.1::DOUBLE * {cnt('H', s)} - {cnt('DE', s)}) / 3.0::DOUBLE)",
        "solubility_input": f"({frac('STNQY', s)} - {frac('AILMVFWY', s)})",
        "toxicity_raw": f"({runs('KR', 3, s)} + 0.5::DOUBLE * {pairs}) / {n}",
        "bitterness_raw": f"({runs('AILMVFWY', 3, s)} + {runs('FW', 2, s)}) / {n}",
    }


RUNS = ", ".join(f"{e} AS {n}" for n, e in run_sql("sequence").items())
ORACLE["run_features"] = f"WITH {DOCW} SELECT sequence, {', '.join(f'{r(e)} AS {n}' for n, e in run_sql('sequence').items())} FROM docw"


def logit(v: str, key: str) -> str:
    c, s = fixed.LOGISTIC[key]
    return f"1 / (1 + exp(-(({v}) - {d(c)}) / {d(s)}))"


TRANS = {
    "aromatic": logit("aromatic_fraction", "aromatic"), "basic": logit("basic_fraction", "basic"), "turn": "turn_score", "length": "length_score",
    "charge": "charge_score", "solubility": logit("solubility_input", "solubility"), "toxicity": logit("toxicity_raw", "toxicity"), "bitterness": logit("bitterness_raw", "bitterness"),
}
RSCORE = "(" + " + ".join(f"{d(abs(w))} * " + (f'"{n}"' if w > 0 else f'(1 - "{n}")') for n, w in fixed.RUN_WEIGHTS.items()) + f") / {d(sum(abs(w) for w in fixed.RUN_WEIGHTS.values()))}"
TCOLS = ", ".join(f'{e} AS "{n}"' for n, e in TRANS.items())
ORACLE["logistic_score"] = f"""WITH {DOCW}, a AS (SELECT sequence, {RUNS} FROM docw), t AS (SELECT sequence, {TCOLS} FROM a)
SELECT sequence, {', '.join(r(f'"{n}"') + f' AS "{n}"' for n in TRANS)}, {r(RSCORE)} AS score FROM t"""
ORACLE["shuffle_zscore"] = f"""WITH {PANELW}, tries AS (SELECT sequence AS parent, array_to_string(list_transform(range(0, CAST((length(sequence) - 1) // 16 + 1 AS BIGINT)), lambda b: sha256('zscore:' || sequence || ':' || t.k || ':' || b)), '') AS hex FROM panelw, range(1, 201) t(k) WHERE length(sequence) > 1),
mixed AS (SELECT parent, array_to_string(list_transform(list_sort(list_transform(range(0, length(parent)),
  lambda i: {{'k': substr(hex, CAST(i * 4 + 1 AS BIGINT), 4), 'i': i, 'x': substr(parent, CAST(i + 1 AS BIGINT), 1)}})), lambda s: s.x), '') AS sequence FROM tries),
every AS (SELECT NULL AS parent, sequence FROM panelw UNION ALL SELECT * FROM mixed), a AS (SELECT parent, sequence, {RUNS} FROM every), t AS (SELECT parent, sequence, {TCOLS} FROM a),
sc AS (SELECT parent, sequence, {RSCORE} AS score FROM t),
st AS (SELECT parent, avg(score) AS m, CASE WHEN min(score) = max(score) THEN 0 ELSE stddev_pop(score) END AS sd FROM sc WHERE parent IS NOT NULL GROUP BY 1)
SELECT sequence, {r('score', 5)} AS score, {r('m', 5)} AS shuffle_mean, {r('sd', 5)} AS shuffle_sd, {r('CASE WHEN sd = 0 THEN 0 WHEN sd > 1e-6 THEN (score - m) / sd END', 5)} AS z_score
FROM sc LEFT JOIN st ON st.parent = sequence WHERE sc.parent IS NULL"""
MW = " + ".join(f"{cnt(a)} * {d(m)}" for a, m in fixed.RESIDUE_MASS.items()) + f" + {d(fixed.WATER_MASS)}"
ORACLE["residue_descriptors"] = f"""WITH {DOCW} SELECT sequence, {r(MW)} AS molecular_weight, {r(frac('FWY'))} AS aromaticity, {r(KD)} AS mean_hydropathy,
  {r(f"{d(100.0)} * ({frac('A')} + {d(2.9)} * {frac('V')} + {d(3.9)} * {frac('IL')})")} AS aliphatic_index,
  {r(frac('VIYFWL'))} AS helix_fraction, {r(frac('NPGS'))} AS turn_fraction, {r(frac('EMAL'))} AS sheet_fraction FROM docw"""
FOUR = " OR ".join(f"contains(sequence, '{a * 4}')" for a in AA)
ORACLE["developability"] = f"""WITH {DOCW} SELECT CASE WHEN length(sequence) <= 2 THEN 'descriptor_unavailable' WHEN {MW} NOT BETWEEN 250 AND 1500 THEN 'mw_outside_peptide_screen'
  WHEN length(sequence) * 60 > 650 THEN 'high_tpsa' WHEN 8 * {frac('AILMFWYV')} > 6 THEN 'high_logp' WHEN {FOUR} THEN 'homopolymer_run' ELSE 'screen_pass' END AS flag, count(*) AS n FROM docw GROUP BY 1"""

# ---- conditional model ---------------------------------------------------------------------------------


def neighbours(source: str, keep: str) -> str:
    return f"""(SELECT {keep}, i AS position, substr(sequence, CAST(i AS BIGINT), 1) AS residue, CASE WHEN i > 1 THEN substr(sequence, CAST(i - 1 AS BIGINT), 1) ELSE '_' END AS l,
  CASE WHEN i < length(sequence) THEN substr(sequence, CAST(i + 1 AS BIGINT), 1) ELSE '_' END AS rr FROM {source}, unnest(range(1, CAST(length(sequence) + 1 AS BIGINT))) t(i))"""


MODEL = f"""{DOCW}, {PANELW}, aa AS (SELECT unnest(string_split('{AA}', '')) AS residue),
seen AS (SELECT l, rr, residue, sum(n) AS n FROM {neighbours('docw', 'n')} GROUP BY 1, 2, 3),
grid AS (SELECT l, rr, cn, residue FROM (SELECT l, rr, sum(n) AS cn FROM seen GROUP BY 1, 2), aa),
lefts AS (SELECT l, residue, sum(n) AS ln FROM seen GROUP BY 1, 2), ltot AS (SELECT l, sum(n) AS lt FROM seen GROUP BY 1),
model AS (SELECT g.l, g.rr, g.residue, ln((coalesce(s.n, 0) + 20.0::DOUBLE * ((coalesce(ln, 0) + 1.0::DOUBLE) / (lt + 20.0::DOUBLE))) / (cn + 20.0::DOUBLE)) AS log_p
  FROM grid g LEFT JOIN seen s ON g.l = s.l AND g.rr = s.rr AND g.residue = s.residue LEFT JOIN lefts f ON f.l = g.l AND f.residue = g.residue JOIN ltot t ON t.l = g.l)"""
ORACLE["kmer_lm_score"] = f"""WITH {MODEL}, pl AS (SELECT p.sequence, sum(coalesce(log_p, -3.0::DOUBLE)) AS total FROM {neighbours('panelw', 'sequence')} p
  LEFT JOIN model m ON p.l = m.l AND p.rr = m.rr AND p.residue = m.residue GROUP BY 1)
SELECT sequence, {r('total')} AS total_ll, {r('total / length(sequence)')} AS mean_ll, {r('exp(-total / length(sequence))')} AS pseudo_perplexity FROM pl"""
SUBS = f"""{MODEL}, subs AS (SELECT p.sequence, position, p.residue, m.residue AS substitute, log_p,
  row_number() OVER (PARTITION BY p.sequence, position ORDER BY log_p DESC, m.residue) AS choice
  FROM {neighbours('panelw', 'sequence')} p JOIN model m ON p.l = m.l AND p.rr = m.rr AND p.residue <> m.residue QUALIFY choice <= 3)"""
ORACLE["top_substitutions"] = f"WITH {SUBS} SELECT sequence, CAST(position AS INTEGER) AS position, residue, substitute, {r('log_p')} AS log_p, CAST(choice AS INTEGER) AS choice FROM subs"
ORACLE["variants"] = f"""WITH {SUBS},
single AS (SELECT sequence AS parent, left(sequence, CAST(position - 1 AS BIGINT)) || substitute || substr(sequence, CAST(position + 1 AS BIGINT)) AS sequence, 1 AS edit_count,
  residue || position || substitute AS mutations, log_p AS support, position AS a, 0 AS b, choice AS c, 0 AS dd FROM subs),
dbl AS (SELECT x.sequence AS parent, left(x.sequence, CAST(x.position - 1 AS BIGINT)) || x.substitute || substr(x.sequence, CAST(x.position + 1 AS BIGINT), CAST(y.position - x.position - 1 AS BIGINT))
  || y.substitute || substr(x.sequence, CAST(y.position + 1 AS BIGINT)) AS sequence, 2 AS edit_count, x.residue || x.position || x.substitute || ';' || y.residue || y.position || y.substitute AS mutations,
  (x.log_p + y.log_p) / 2 AS support, x.position AS a, y.position AS b, x.choice AS c, y.choice AS dd FROM subs x JOIN subs y ON x.sequence = y.sequence AND x.position < y.position AND x.choice <= 2 AND y.choice <= 2),
every AS (SELECT * FROM single UNION ALL SELECT * FROM dbl)
SELECT sequence, parent, edit_count, mutations, {r('support')} AS support, 'VAR-' || substr(sha256(parent || ':' || sequence || ':' || mutations), 1, 16) AS variant_id
FROM every WHERE sequence NOT IN (SELECT sequence FROM docw UNION ALL SELECT sequence FROM panelw)
QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY edit_count, parent DESC, a DESC, b DESC, c DESC, dd DESC) = 1"""

FLAG = f"""CASE WHEN length(sequence) <= 2 THEN 'descriptor_unavailable' WHEN {MW} NOT BETWEEN 250 AND 1500 THEN 'mw_outside_peptide_screen'
  WHEN length(sequence) * 60 > 650 THEN 'high_tpsa' WHEN 8 * {frac('AILMFWYV')} > 6 THEN 'high_logp' WHEN {FOUR} THEN 'homopolymer_run' ELSE 'screen_pass' END"""
TERMS = lambda source, name: f"""{name} AS (SELECT p.sequence, sum(coalesce(log_p, -3.0::DOUBLE)) / max(length(p.sequence)) AS mean_ll FROM {neighbours(source, 'sequence')} p
  LEFT JOIN model m ON p.l = m.l AND p.rr = m.rr AND p.residue = m.residue GROUP BY 1)"""
ORACLE["variant_table"] = f"""WITH {BASE}, {feats('uni', 'candidate_id, sequence, label')}, {modes('sequence, label')},
ranked AS (SELECT sequence, label, row_number() OVER (ORDER BY score DESC, length, sequence) AS rank FROM ml WHERE mode = 'sar'),
chosen AS (SELECT sequence, rank AS po FROM ranked WHERE {POS} AND sequence IN (SELECT sequence FROM panelw) ORDER BY rank LIMIT 40),
{MODEL.removeprefix(f"{DOCW}, {PANELW}, ")},
subs AS (SELECT p.sequence, po, position, p.residue, m.residue AS substitute, log_p, row_number() OVER (PARTITION BY p.sequence, position ORDER BY log_p DESC, m.residue) AS choice
  FROM {neighbours('chosen', 'sequence, po')} p JOIN model m ON p.l = m.l AND p.rr = m.rr AND p.residue <> m.residue QUALIFY choice <= 3),
single AS (SELECT sequence AS parent, po, left(sequence, CAST(position - 1 AS BIGINT)) || substitute || substr(sequence, CAST(position + 1 AS BIGINT)) AS sequence, 1 AS edit_count,
  residue || position || substitute AS mutations, log_p AS support, position AS a, 0 AS b, choice AS c, 0 AS dd FROM subs),
dbl AS (SELECT x.sequence AS parent, x.po, left(x.sequence, CAST(x.position - 1 AS BIGINT)) || x.substitute || substr(x.sequence, CAST(x.position + 1 AS BIGINT), CAST(y.position - x.position - 1 AS BIGINT))
  || y.substitute || substr(x.sequence, CAST(y.position + 1 AS BIGINT)) AS sequence, 2 AS edit_count, x.residue || x.position || x.substitute || ';' || y.residue || y.position || y.substitute AS mutations,
  (x.log_p + y.log_p) / 2 AS support, x.position AS a, y.position AS b, x.choice AS c, y.choice AS dd FROM subs x JOIN subs y ON x.sequence = y.sequence AND x.position < y.position AND x.choice <= 2 AND y.choice <= 2),
every AS (SELECT * FROM single UNION ALL SELECT * FROM dbl),
fresh AS (SELECT * FROM every WHERE sequence NOT IN (SELECT sequence FROM docw UNION ALL SELECT sequence FROM panelw)
  QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY edit_count, po DESC, a DESC, b DESC, c DESC, dd DESC) = 1),
{TERMS('fresh', 'own')}, {TERMS('chosen', 'parentll')},
near AS (SELECT f.sequence, k.sequence AS nearest, levenshtein(f.sequence, k.sequence) AS nd FROM fresh f, panelw k WHERE abs(length(f.sequence) - length(k.sequence)) <= 2
  QUALIFY row_number() OVER (PARTITION BY f.sequence ORDER BY levenshtein(f.sequence, k.sequence), abs(length(f.sequence) - length(k.sequence)), k.sequence) = 1),
whole AS (SELECT f.*, own.mean_ll, p.mean_ll AS parent_mean_ll, own.mean_ll - p.mean_ll AS delta_mean_ll, nearest, nd FROM fresh f JOIN own ON own.sequence = f.sequence
  JOIN parentll p ON p.sequence = f.parent JOIN near n ON n.sequence = f.sequence),
flagged AS (SELECT *, {FLAG} AS flag FROM whole)
SELECT row_number() OVER (ORDER BY edit_count < 2, flag <> 'screen_pass', {r('mean_ll', 9)} DESC, {r('delta_mean_ll', 9)} DESC, sequence) AS rank, sequence, parent, po AS parent_rank, edit_count, mutations,
  {r('support')} AS support, 'VAR-' || substr(sha256(parent || ':' || sequence || ':' || mutations), 1, 16) AS variant_id, {r('mean_ll')} AS mean_ll, {r('parent_mean_ll')} AS parent_mean_ll,
  {r('delta_mean_ll')} AS delta_mean_ll, {r('exp(-mean_ll)')} AS pseudo_perplexity, nearest, CAST(nd AS INTEGER) AS nearest_distance, flag FROM flagged QUALIFY rank <= 300"""

ORACLE["recipe_from_file"] = f"""WITH {COMPS},
rawall AS (SELECT candidate_id, length, sequence, label, component, score FROM comps UNION ALL
  SELECT candidate_id, length, sequence, label, 'lenrank:' || component, score FROM ({pct('comps', 'component, length', 0.5)})),
scaled AS (SELECT candidate_id, length, sequence, label, component, score FROM ({pct('rawall', 'component')})),
mixw AS (SELECT * FROM (VALUES ('fusion:mix', 'c01', 0.5::DOUBLE), ('fusion:mix', 'c02', 0.25), ('fusion:mix', 'lenrank:c09', 0.25), ('fusion:pair', 'c05', 1.0), ('fusion:pair', 'c06', 1.0)) v(fusion_id, component, weight)),
fused AS (SELECT fusion_id, candidate_id, any_value(length) AS length, any_value(sequence) AS sequence, any_value(label) AS label, {r('sum(weight * score) / sum(weight)', 12)} AS score FROM scaled JOIN mixw USING (component) GROUP BY 1, 2),
allc AS (SELECT * FROM scaled UNION ALL SELECT candidate_id, length, sequence, label, fusion_id, score FROM fused),
again AS ({pct('allc', 'component')}),
gates AS (SELECT candidate_id, row_number() OVER (ORDER BY score DESC, length, sequence) AS gr, count(*) OVER () AS gn FROM again WHERE component = 'lenrank:c03'),
rec AS (SELECT candidate_id, length, sequence, gr <= {GATE('12.5::DOUBLE')} AS gated, CASE WHEN gr <= {GATE('12.5::DOUBLE')} THEN score ELSE score - 2 END AS score
  FROM again JOIN gates USING (candidate_id) WHERE component = 'fusion:mix')
SELECT candidate_id, row_number() OVER (ORDER BY score DESC, length, sequence) AS rank, {r('score', 9)} AS score, CAST(gated AS INTEGER) AS gated, 'file-gate' AS recipe_id,
  'lenrank:c03' AS gate_component, 'fusion:mix' AS rank_component, 12.5::DOUBLE AS gate_percent FROM rec"""

# ---- two-score fusion -----------------------------------------------------------------------------------------

MM = lambda v, o="": f"CASE WHEN abs(max({v}) OVER ({o}) - min({v}) OVER ({o})) <= 1e-9 * greatest(abs(min({v}) OVER ({o})), abs(max({v}) OVER ({o}))) THEN 0.5::DOUBLE ELSE ({v} - min({v}) OVER ({o})) / (max({v}) OVER ({o}) - min({v}) OVER ({o})) END"
GRID = "(SELECT i / 20.0::DOUBLE AS weight FROM range(0, 21) t(i))"
_q, _s = evaluation("mixed", ["weight"], length=False)
ORACLE["lm_fusion_curve"] = f"""WITH {PAIRS}, ev AS (SELECT * FROM pairs WHERE label <> 'random_background'), zs AS (SELECT * FROM {lz('ev', 's2')}),
ab AS (SELECT *, {MM('s1')} AS fa, {MM('z')} AS fb FROM zs), mixed AS (SELECT weight, sequence, label, {r('weight * fa + (1 - weight) * fb', 9)} AS score FROM ab, {GRID}), {_q} {_s}"""
ORACLE["correlations"] = f"""WITH {PAIRS}, q AS (SELECT label, s1, round_even(s2 * 20.0::DOUBLE, 0) / 20.0::DOUBLE AS s2 FROM pairs),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY s1) + (count(*) OVER (PARTITION BY label, s1) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY label ORDER BY s2) + (count(*) OVER (PARTITION BY label, s2) - 1) / 2.0 AS r2 FROM q)
SELECT label, {r('corr(s1, s2)')} AS pearson, {r('corr(r1, r2)')} AS spearman, count(*) AS n_rows FROM k GROUP BY 1"""
AUC = lambda on: f"(sum(mr) FILTER ({POS}) - count(*) FILTER ({POS}) * (count(*) FILTER ({POS}) + 1) / 2.0) / nullif(count(*) FILTER ({POS}) * CAST(count(*) FILTER (NOT ({POS})) AS DOUBLE), 0)"
CV = f"""{PAIRS}, rf AS (SELECT pairs.*, rep AS repeat, fold, (('0x' || substr(sha256('cv:' || rep || ':' || parent), 1, 8))::BIGINT % 5 + 1) = fold AS held
  FROM pairs, range(1, 4) a(rep), range(1, 6) b(fold) WHERE label <> 'random_background'),
fl AS (SELECT repeat, fold, length, avg(s2) AS m, stddev_pop(s2) AS sd FROM rf WHERE NOT held GROUP BY 1, 2, 3),
fg AS (SELECT repeat, fold, avg(s2) AS gm, stddev_pop(s2) AS gsd FROM rf WHERE NOT held GROUP BY 1, 2),
zz AS (SELECT rf.*, (s2 - coalesce(m, gm)) / coalesce(nullif(sd, 0), nullif(gsd, 0), 1) AS z FROM rf JOIN fg USING (repeat, fold) LEFT JOIN fl USING (repeat, fold, length)),
bb AS (SELECT repeat, fold, min(s1) AS a0, max(s1) AS a1, min(z) AS b0, max(z) AS b1 FROM zz WHERE NOT held GROUP BY 1, 2),
gr AS (SELECT repeat, fold, held, label, weight, {r('weight * ((s1 - a0) / (a1 - a0)) + (1 - weight) * ((z - b0) / (b1 - b0))', 9)} AS score FROM zz JOIN bb USING (repeat, fold), {GRID}),
mm AS (SELECT *, rank() OVER (PARTITION BY repeat, fold, held, weight ORDER BY score) + (count(*) OVER (PARTITION BY repeat, fold, held, weight, score) - 1) / 2.0 AS mr FROM gr),
au AS (SELECT repeat, fold, held, weight, {AUC('')} AS auc FROM mm GROUP BY 1, 2, 3, 4),
td AS (SELECT repeat, fold, held, weight, score, count(*) FILTER ({POS}) AS p, count(*) AS c FROM gr GROUP BY 1, 2, 3, 4, 5),
sp AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS nn FROM td WINDOW w AS (PARTITION BY repeat, fold, held, weight ORDER BY score DESC)),
ap AS (SELECT repeat, fold, held, weight, sum(p * CAST(tp AS DOUBLE) / nn) / nullif(sum(p), 0) AS ap FROM sp GROUP BY 1, 2, 3, 4),
pick AS (SELECT repeat, fold, weight AS selected_weight, auc AS train_auroc FROM au WHERE NOT held QUALIFY row_number() OVER (PARTITION BY repeat, fold ORDER BY auc DESC, weight) = 1),
sz AS (SELECT repeat, fold, count(*) FILTER (NOT held) AS train_rows, count(*) FILTER (held) AS test_rows, count(*) FILTER (NOT held AND {POS}) AS train_positives,
  count(*) FILTER (held AND {POS}) AS test_positives FROM rf GROUP BY 1, 2),
cv AS (SELECT CAST(sz.repeat AS INTEGER) AS repeat, CAST(sz.fold AS INTEGER) AS fold, train_rows, test_rows, train_positives, test_positives, selected_weight, train_auroc, t.auc AS test_auroc, ap.ap AS test_ap,
  f.auc AS test_first_auroc, s.auc AS test_second_auroc FROM sz JOIN pick USING (repeat, fold) JOIN au t ON t.repeat = sz.repeat AND t.fold = sz.fold AND t.held AND t.weight = selected_weight
  JOIN ap ON ap.repeat = sz.repeat AND ap.fold = sz.fold AND ap.held AND ap.weight = selected_weight
  JOIN au f ON f.repeat = sz.repeat AND f.fold = sz.fold AND f.held AND f.weight = 1 JOIN au s ON s.repeat = sz.repeat AND s.fold = sz.fold AND s.held AND s.weight = 0)"""
ORACLE["grouped_cv_fusion"] = f"""WITH {CV} SELECT repeat, fold, train_rows, test_rows, train_positives, test_positives, {r('selected_weight')} AS selected_weight,
  {', '.join(f'{r(c)} AS {c}' for c in ('train_auroc', 'test_auroc', 'test_ap', 'test_first_auroc', 'test_second_auroc'))} FROM cv"""
ORACLE["cv_summary"] = f"""WITH {CV}, s AS (SELECT count(*) AS fold_results, avg(selected_weight) AS mean_selected_weight, median(selected_weight) AS median_selected_weight, avg(test_auroc) AS mean_test_auroc,
  coalesce(stddev_samp(test_auroc), 0) AS sd_test_auroc, avg(test_first_auroc) AS mean_first_auroc, avg(test_second_auroc) AS mean_second_auroc, avg(test_auroc - test_first_auroc) AS mean_delta,
  median(test_auroc - test_first_auroc) AS median_delta, count(*) FILTER (test_auroc - test_first_auroc > 0) AS win_count, avg(test_ap) AS mean_test_ap FROM cv)
SELECT fold_results, win_count, {', '.join(f'{r(c)} AS {c}' for c in ('mean_selected_weight', 'median_selected_weight', 'mean_test_auroc', 'sd_test_auroc', 'mean_first_auroc', 'mean_second_auroc', 'mean_delta', 'median_delta', 'mean_test_ap'))},
  {r('win_count / CAST(fold_results AS DOUBLE)')} AS win_rate,
  {r('least(1.0::DOUBLE, 2 * list_sum(list_transform(range(greatest(win_count, fold_results - win_count), fold_results + 1), lambda k: exp(lgamma(fold_results + 1) - lgamma(k + 1) - lgamma(fold_results - k + 1) - fold_results * ln(2.0::DOUBLE)))))')} AS sign_test_p FROM s"""
K3 = "scenario_id, repeat, fold"
SCV = f"""{PAIRS}, evr AS (SELECT * FROM pairs WHERE label <> 'random_background'),
gs AS (SELECT parent, row_number() OVER (ORDER BY count(*) FILTER ({POS}) DESC, count(*) DESC, parent) AS place FROM evr GROUP BY parent),
gf AS (SELECT parent, repeat, (row_number() OVER (PARTITION BY repeat, (place - 1) // 5 ORDER BY sha256('cv:' || repeat || ':' || place)) - 1
  + ('0x' || substr(sha256('cv:' || repeat), 1, 8))::BIGINT) % 5 + 1 AS own FROM gs, range(1, 4) a(repeat)),
rf AS (SELECT evr.*, repeat, fold, own = fold AS held FROM evr JOIN gf USING (parent), range(1, 6) b(fold)),
fl AS (SELECT repeat, fold, length, avg(s2) AS m, stddev_pop(s2) AS sd FROM rf WHERE NOT held GROUP BY 1, 2, 3),
fg AS (SELECT repeat, fold, avg(s2) AS gm, stddev_pop(s2) AS gsd FROM rf WHERE NOT held GROUP BY 1, 2),
lz AS (SELECT rf.*, (s2 - coalesce(m, gm)) / coalesce(nullif(sd, 0), nullif(gsd, 0), 1) AS z FROM rf JOIN fg USING (repeat, fold) LEFT JOIN fl USING (repeat, fold, length)),
zz AS (SELECT 'raw' AS scenario_id, * REPLACE (s2 AS z) FROM lz UNION ALL SELECT 'length_z', * FROM lz),
bb AS (SELECT {K3}, min(s1) AS a0, max(s1) AS a1, min(z) AS b0, max(z) AS b1 FROM zz WHERE NOT held GROUP BY ALL),
gr AS (SELECT {K3}, held, label, sequence, weight, {r('weight * ((s1 - a0) / (a1 - a0)) + (1 - weight) * ((z - b0) / (b1 - b0))', 9)} AS score FROM zz JOIN bb USING ({K3}), {GRID}),
mm AS (SELECT *, rank() OVER (PARTITION BY {K3}, held, weight ORDER BY score) + (count(*) OVER (PARTITION BY {K3}, held, weight, score) - 1) / 2.0 AS mr,
  row_number() OVER (PARTITION BY {K3}, held, weight ORDER BY score DESC, sequence) AS rk, count(*) OVER (PARTITION BY {K3}, held, weight) AS nn FROM gr),
au AS (SELECT {K3}, held, weight, {AUC('')} AS auc, count(*) FILTER ({POS} AND rk <= {cut('nn', 10.0)}) AS top FROM mm GROUP BY ALL),
td AS (SELECT {K3}, held, weight, score, count(*) FILTER ({POS}) AS p, count(*) AS c FROM gr GROUP BY ALL),
sp AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS nn FROM td WINDOW w AS (PARTITION BY {K3}, held, weight ORDER BY score DESC)),
ap AS (SELECT {K3}, held, weight, sum(p * CAST(tp AS DOUBLE) / nn) / nullif(sum(p), 0) AS ap FROM sp GROUP BY ALL),
pick AS (SELECT {K3}, weight AS selected_weight, auc AS train_auroc FROM au WHERE NOT held QUALIFY row_number() OVER (PARTITION BY {K3} ORDER BY auc DESC, weight) = 1),
sz AS (SELECT {K3}, count(*) FILTER (NOT held) AS train_rows, count(*) FILTER (held) AS test_rows, count(*) FILTER (NOT held AND {POS}) AS train_positives,
  count(*) FILTER (held AND {POS}) AS test_positives FROM zz GROUP BY ALL),
hel AS (SELECT {K3}, weight, auc, ap, top FROM au JOIN ap USING ({K3}, held, weight) WHERE held),
scv AS (SELECT scenario_id, CAST(repeat AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, any_value(train_rows) AS train_rows, any_value(test_rows) AS test_rows,
  any_value(train_positives) AS train_positives, any_value(test_positives) AS test_positives, any_value(selected_weight) AS selected_weight, any_value(train_auroc) AS train_auroc,
  {', '.join(f"max({c}) FILTER (weight = {w}) AS test_{k}{n}" for k, w in (('', 'selected_weight'), ('first_', '1'), ('second_', '0')) for c, n in (('auc', 'auroc'), ('ap', 'ap'), ('top', 'top_10pct')))}
  FROM sz JOIN pick USING ({K3}) JOIN hel USING ({K3}) GROUP BY 1, 2, 3)"""
ORACLE["stratified_cv"] = f"""WITH {SCV} SELECT {K3}, train_rows, test_rows, train_positives, test_positives, test_top_10pct, test_first_top_10pct, test_second_top_10pct,
  {', '.join(f'{r(c)} AS {c}' for c in ('selected_weight', 'train_auroc', *(f'test_{k}{n}' for k in ('', 'first_', 'second_') for n in ('auroc', 'ap'))))} FROM scv"""
_means = {"mean_selected_weight": "selected_weight", "mean_test_auroc": "test_auroc", "mean_first_auroc": "test_first_auroc", "mean_second_auroc": "test_second_auroc",
  "mean_test_ap": "test_ap", "mean_first_ap": "test_first_ap", "mean_second_ap": "test_second_ap", "mean_top_10pct": "test_top_10pct", "mean_first_top_10pct": "test_first_top_10pct",
  "mean_delta": "test_auroc - test_first_auroc"}
ORACLE["stratified_cv_summary"] = f"""WITH {SCV}, s AS (SELECT scenario_id, count(*) AS fold_results, {', '.join(f'{r(f"avg({c})")} AS {n}' for n, c in _means.items())},
  {r('median(selected_weight)')} AS median_selected_weight, {r('coalesce(stddev_samp(test_auroc), 0)')} AS sd_test_auroc, {r('median(test_auroc - test_first_auroc)')} AS median_delta,
  count(*) FILTER (test_auroc - test_first_auroc > 0) AS win_count FROM scv GROUP BY 1)
SELECT *, {r('win_count / CAST(fold_results AS DOUBLE)')} AS win_rate, (SELECT count(*) FILTER ({POS}) FROM evr) AS n_positive, (SELECT count(*) FILTER (NOT ({POS})) FROM evr) AS n_matched,
  (SELECT count(DISTINCT parent) FROM evr) AS n_groups,
  {r('least(1.0::DOUBLE, 2 * list_sum(list_transform(range(greatest(win_count, fold_results - win_count), fold_results + 1), lambda k: exp(lgamma(fold_results + 1) - lgamma(k + 1) - lgamma(fold_results - k + 1) - fold_results * ln(2.0::DOUBLE)))))')} AS sign_test_p FROM s"""
FROZEN = f"""{PAIRS}, zs AS (SELECT * FROM {lz('pairs', 's2')}), ab AS (SELECT *, {MM('s1')} AS first_norm, {MM('z')} AS second_norm FROM zs),
fz AS (SELECT *, {r('0.65::DOUBLE * first_norm + (1.0::DOUBLE - 0.65::DOUBLE) * second_norm', 10)} AS score FROM ab), fr AS (SELECT *, row_number() OVER (ORDER BY score DESC, sequence) AS rank FROM fz)"""
ORACLE["frozen_lm_fusion"] = f"WITH {FROZEN} SELECT candidate_id, rank, {r('first_norm')} AS first_norm, {r('z')} AS length_z, {r('second_norm')} AS second_norm, {r('score')} AS score FROM fr"
ORACLE["shortlist"] = f"WITH {FROZEN} SELECT candidate_id, rank, label, {r('score')} AS score FROM fr WHERE label = 'random_background' ORDER BY rank LIMIT 40"
JOINS = lambda c: f"array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), ';')"
ORACLE["consensus"] = f"""WITH {RANKED}, li AS (SELECT component AS model_id, sequence, rank, score, candidate_id, label, length FROM ranked WHERE component IN ('c01', 'c02', 'c03') AND rank <= 60),
cs AS (SELECT sequence, count(DISTINCT model_id) AS models_present, {JOINS('model_id')} AS model_ids, avg(rank) AS mean_rank, min(rank) AS best_rank, avg(score) AS mean_score, avg(score - 0.1::DOUBLE) AS mean_delta,
  {JOINS('candidate_id % 7')} AS parents, {JOINS('1 + candidate_id % 2')} AS edit_counts, array_to_string(list_sort(list(model_id || ':A' || length || 'V')), ';') AS mutations_by_model,
  'P' || any_value(candidate_id % 7) AS nearest, CAST(any_value(candidate_id % 5) AS INTEGER) AS nearest_distance, {JOINS('label')} AS flags FROM li GROUP BY 1)
SELECT * REPLACE ({r('mean_rank')} AS mean_rank, {r('mean_score')} AS mean_score, {r('mean_delta')} AS mean_delta),
  row_number() OVER (ORDER BY models_present DESC, mean_rank, mean_delta DESC, sequence) AS consensus_rank FROM cs QUALIFY consensus_rank <= 80"""
ORACLE["scoring_panel"] = f"""WITH {RANKED}, o AS (SELECT * FROM ranked WHERE component = 'c01'), g AS (SELECT candidate_id, rank, CASE WHEN label <> 'random_background' THEN 'matched_eval'
  WHEN rank <= 60 THEN 'top_background' ELSE 'random_background_probe' END AS scenario_group FROM o),
pb AS (SELECT * FROM g WHERE scenario_group = 'random_background_probe' ORDER BY ('0x' || substr(sha256('panel:' || candidate_id), 1, 12))::BIGINT, candidate_id LIMIT 50)
SELECT candidate_id, scenario_group, rank FROM g WHERE scenario_group <> 'random_background_probe' UNION ALL SELECT candidate_id, scenario_group, rank FROM pb"""
ORACLE["role_panel"] = f"""WITH {RANKED}, o AS (SELECT * FROM ranked WHERE component = 'c02' AND length <= 8),
p AS (SELECT candidate_id, rank FROM o WHERE {POS} ORDER BY CASE WHEN candidate_id IN (1, 9, 60) THEN 0 ELSE 1 END, rank LIMIT 12),
m AS (SELECT candidate_id, rank FROM o WHERE label = 'matched_decoy' QUALIFY row_number() OVER (ORDER BY rank) <= 2 * (SELECT count(*) FROM p))
SELECT candidate_id, 'positive' AS panel_role, rank FROM p UNION ALL SELECT candidate_id, 'hard_matched_decoy', rank FROM m"""
_q, _s = evaluation("comps", ["component"])
_drop = ["auroc_all", "auroc_matched", "ap_step", "ap_positives_first", "top_10_count", "top_25_count", "top_50_count", "top_100_count"]
ORACLE["rank_list_eval"] = f"WITH {COMPS}, {_q}, f AS ({_s}) SELECT * EXCLUDE ({', '.join(_drop)}) FROM f"
ORACLE["expectations"] = f"""WITH {COMPS}, {_q}, f AS (SELECT n_rows, auroc_all, auroc_matched FROM ({_s}) WHERE component = 'c01'),
e AS (SELECT 'n_rows' AS metric, CAST(n_rows AS DOUBLE) AS actual, (SELECT CAST(count(*) AS DOUBLE) FROM embeddings) AS expected, 0.0::DOUBLE AS tolerance FROM f UNION ALL SELECT 'auroc_all', auroc_all, 0.5, 0.1 FROM f
 UNION ALL SELECT 'auroc_matched', auroc_matched, 0.9, 0.01 FROM f) SELECT *, coalesce(abs(actual - expected) <= tolerance, FALSE) AS met FROM e"""

# ---- geometry and manifests ------------------------------------------------------------------------------------------

ATOMS = """atoms AS (SELECT CAST(vec_id // 10 AS BIGINT) AS pose, vec_id % 3 AS residue_number, ['C', 'O', 'N', 'S', 'H', 'C', 'O', 'H', 'N', 'C'][label + 1] AS element,
  CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings),
hv AS (SELECT *, sqrt((x - 0.5::DOUBLE) * (x - 0.5::DOUBLE) + (y + 0.5::DOUBLE) * (y + 0.5::DOUBLE) + (z - 0.25::DOUBLE) * (z - 0.25::DOUBLE)) AS dd,
  max(residue_number) OVER (PARTITION BY pose) AS last FROM atoms WHERE element <> 'H'),
geo AS (SELECT pose, min(dd) AS min_heavy, min(dd) FILTER (element IN ('O', 'N', 'S')) AS min_polar, min(dd) FILTER (element = 'O') AS min_oxygen,
  min(dd) FILTER (element = 'O' AND residue_number = last) AS min_terminal_oxygen, count(*) FILTER (element IN ('O', 'N', 'S') AND dd <= 3.2::DOUBLE) AS polar_near,
  count(*) FILTER (element = 'O' AND dd <= 3.2::DOUBLE) AS oxygen_near, count(*) FILTER (element = 'O' AND residue_number = last) AS terminal_oxygens FROM hv GROUP BY 1)"""
ORACLE["contact_geometry"] = f"WITH {ATOMS} SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in ('min_heavy', 'min_polar', 'min_oxygen', 'min_terminal_oxygen'))}) FROM geo"
CS = lambda v: f"coalesce({tri(v, 2.3, 2.2)}, 0)" if False else f"CASE WHEN {v} IS NULL THEN 0 ELSE {tri(v, 2.3, 2.2)} END"
ORACLE["contact_metrics"] = f"""WITH {ATOMS}, po AS (SELECT *, CASE WHEN pose % 2 = 0 THEN 'known_positive' ELSE 'matched_decoy' END AS label, 4.0::DOUBLE + pose % 9 AS raw,
  (4.0::DOUBLE + pose % 9) / (3 + pose % 4) AS per FROM geo),
sh AS (SELECT *, {CS('min_polar')} AS contact, {CS('min_terminal_oxygen')} AS tc, {MM('raw')} AS raw_share, {MM('per')} AS per_residue_share FROM po),
al AS (SELECT label, min_heavy, contact, raw_share, per_residue_share, 0.35::DOUBLE * tc + 0.25::DOUBLE * contact + 0.25::DOUBLE * raw_share + 0.15::DOUBLE * per_residue_share AS pose_score FROM sh),
lo AS (UNPIVOT al ON min_heavy, contact, raw_share, per_residue_share, pose_score INTO NAME metric VALUE v),
mr AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS mr FROM lo)
SELECT metric, {r("avg(v) FILTER (label = 'known_positive')")} AS positive_mean, {r("avg(v) FILTER (label = 'matched_decoy')")} AS decoy_mean, count(*) AS n, {r(AUC(''))} AS auroc_matched FROM mr GROUP BY 1"""
ORACLE["table_manifest"] = f"""WITH {NOTES} SELECT event_type, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(event_id || '|' || user_id || '|' || notes), 1, 12))::BIGINT AS HUGEINT)) AS VARCHAR) AS digest FROM nt GROUP BY 1"""
ORACLE["fasta_scan"] = f"""WITH {PROT} SELECT 'doc' || accession AS accession, 'doc' || accession || ' ' || source_class AS header,
  length(sequence) AS n, CASE WHEN sequence = '' THEN '' ELSE sha256(sequence) END AS sha256 FROM prot"""
ORACLE["tsv_scan"] = f"WITH {NOTES} SELECT event_id, notes FROM nt"
