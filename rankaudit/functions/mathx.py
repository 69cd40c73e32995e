"""Numeric column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int = 6) -> Column:
    """Half-even rounding on the scaled double; keeps NaN and NULL."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clamp01(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def triangular(value: Column, target: float, width: float) -> Column:
    """1 at the target, falling linearly to 0 at `width` from it."""
    if width <= 0:
        return F.lit(0.0)
    return clamp01(F.lit(1.0) - F.abs(value - F.lit(target)) / F.lit(width))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), value))))


def logistic(value: Column, center: float, scale: float) -> Column:
    return sigmoid((value - F.lit(center)) / F.lit(scale))


def safe_double(value: Column, default: float = 0.0) -> Column:
    number = value.try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(default)), F.lit(default))


def safe_int(value: Column, default: int = 0) -> Column:
    """Whole part of a number in text; the default where there is none."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(default))


def potency_weight(potency: Column, reference: float, maximum: float) -> Column:
    raw = F.lit(1.0) + F.greatest(F.lit(0.0), F.log10(F.lit(reference) / F.greatest(potency, F.lit(1e-6))))
    return F.when(potency <= 0, F.lit(maximum)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(maximum), raw)))


def hash_uniform(key: Column) -> Column:
    """A repeatable number in [0, 1] from the first 48 bits of the key's digest."""
    bits = F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double")
    return bits / F.lit(float(16**12 - 1))


def euclidean(a: tuple, b: tuple) -> Column:
    squares = [(p - q) * (p - q) for p, q in zip(a, b)]
    return F.sqrt(squares[0] + squares[1] + squares[2])


_SHIFT = 8


def log_gamma(x: str) -> str:
    """SQL of log-gamma for x > 0: a Stirling series at x + 8, walked back by a product.

    Written as SQL text because it is used inside larger expressions: one parse is much
    cheaper to plan than some hundred column calls.
    """
    y = f"({x} + {float(_SHIFT)}D)"
    product = " * ".join(f"({x} + {float(step)}D)" for step in range(_SHIFT))
    z = f"(1.0D / ({y} * {y}))"
    series = f"(1.0D/12 + {z} * (-1.0D/360 + {z} * (1.0D/1260 - {z} * 1.0D/1680))) / {y}"
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {series} - ln({product}))"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digamma(x: Column) -> Column:
    """Digamma for x > 0, by the same shift."""
    y = x + F.lit(float(_SHIFT))
    steps = F.lit(1.0) / x
    for step in range(1, _SHIFT):
        steps = steps + F.lit(1.0) / (x + F.lit(float(step)))
    inverse = F.lit(1.0) / (y * y)
    series = inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * F.lit(1 / 252)))
    return F.log(y) - F.lit(0.5) / y - series - steps


_FAR = 64.0


def harmonic_span(before: Column, count: Column) -> tuple[Column, Column]:
    """Sums over k = 1..count of 1 / (before + k) and of k / (before + k), for counts of any size.

    Far from the origin both come from differences that are taken before rounding: the first through log1p, the second
    through u - log1p(u), so neither loses its digits however large `before` is.
    """
    x = F.greatest(before, F.lit(_FAR))
    y, u = x + count, count / x
    square, fourth = (x + y) / (x * x * y * y), (F.lit(1.0) / (y * y * y * y) - F.lit(1.0) / (x * x * x * x))
    tail = count * square / F.lit(12.0) + fourth / F.lit(120.0)
    far = F.log1p(u) - count / (F.lit(2.0) * x * y) + tail
    series = u * u * (F.lit(0.5) - u * (F.lit(1 / 3) - u * (F.lit(0.25) - u * (F.lit(0.2) - u * F.lit(1 / 6)))))
    bend = F.when(u < 0.01, series).otherwise(u - F.log1p(u))
    far_ramp = x * bend + count / (F.lit(2.0) * y) - x * tail
    near = digamma(before + count + F.lit(1.0)) - digamma(before + F.lit(1.0))
    is_far = before >= _FAR
    return F.when(is_far, far).otherwise(near), F.when(is_far, far_ramp).otherwise(count - before * near)


def signed_log_gammas(*terms: tuple[int, str]) -> str:
    """SQL of the sum of sign * log_gamma(x) with a single copy of the series."""
    pairs = ", ".join(f"named_struct('s', {float(sign)}D, 'x', double({x}))" for sign, x in terms)
    return f"aggregate(array({pairs}), 0.0D, (lg, g) -> lg + g.s * {log_gamma('g.x')})"


def _stirling_rest(x: str) -> str:
    """SQL of ln(x!) less Stirling's formula, for x > 0."""
    z = f"(1.0D / ({x} * {x}))"
    series = f"(1.0D/12 - {z} * (1.0D/360 - {z} * (1.0D/1260 - {z} * (1.0D/1680 - {z} * 1.0D/1188)))) / {x}"
    small = f"{log_gamma(f'({x} + 1)')} - ({x} + 0.5D) * ln({x}) + {x} - {0.5 * math.log(2 * math.pi)!r}D"
    return f"if({x} < 16, {small}, {series})"


def _deviance(x: str, mean: str) -> str:
    """SQL of x ln(x / mean) + mean - x, by a series where the two are near."""
    v = f"(({x} - {mean}) / ({x} + {mean}))"
    powers = ", ".join(f"{j}" for j in range(1, 9))
    near = f"({x} - {mean}) * {v} + 2.0D * {x} * {v} * aggregate(array({powers}), 0.0D, (dv, j) -> dv + pow({v} * {v}, j) / (2 * j + 1))"
    return f"if(abs({x} - {mean}) < 0.1D * ({x} + {mean}), {near}, {x} * ln({x} / {mean}) + {mean} - {x})"


def signed_binomials(share: str, *terms: tuple[int, str, str]) -> str:
    """SQL of the sum of sign * ln of the binomial mass at x of n, all with one share, with a single copy of the formula.

    The saddle-point form: Stirling remainders and deviances are small numbers, so nothing of size n ln n is subtracted.
    """
    pairs = ", ".join(f"named_struct('s', {float(s)}D, 'x', double({x}), 'n', double({n}))" for s, x, n in terms)
    middle = (
        f"{_stirling_rest('b.n')} - ({_stirling_rest('b.x')}) - ({_stirling_rest('(b.n - b.x)')}) "
        f"- ({_deviance('b.x', f'(b.n * {share})')}) - ({_deviance('(b.n - b.x)', f'(b.n * (1 - {share}))')}) "
        f"+ 0.5D * ln(b.n / ({2 * math.pi!r}D * b.x * (b.n - b.x)))"
    )
    mass = f"CASE WHEN b.n <= 0 THEN 0.0D WHEN b.x <= 0 THEN b.n * log1p(-{share}) WHEN b.x >= b.n THEN b.n * ln({share}) ELSE {middle} END"
    return f"aggregate(array({pairs}), 0.0D, (bm, b) -> bm + b.s * ({mass}))"


def log_choose(n: str, k: str) -> str:
    return signed_log_gammas((1, f"{n} + 1"), (-1, f"{k} + 1"), (-1, f"{n} - {k} + 1"))


def hypergeometric_tail(hits: str, population: str, successes: str, draws: str) -> str:
    """SQL of P(X >= hits) when drawing `draws` rows from `population` with `successes` marked.

    Terms further than 10 sqrt(draws) from both the mean and the start add less than
    exp(-200) of the sum, so they are left out; what remains is exact to double precision.
    The sum walks the ratio of neighbouring terms in log space, scaled by the largest term.
    A one-element transform binds each intermediate once.
    """
    def log_term(x: str) -> str:
        return signed_binomials("p.share", (1, x, "p.suc"), (1, f"p.drw - {x}", "p.pop - p.suc"), (-1, "p.drw", "p.pop"))

    inputs = (
        f"named_struct('hits', double({hits}), 'pop', double({population}), "
        f"'suc', double({successes}), 'drw', double({draws}), 'share', double({draws}) / double({population}))"
    )
    mean, width = "(p.drw * p.suc / p.pop)", "(10.0D * sqrt(p.drw) + 60.0D)"
    start = f"greatest(p.hits, rint({mean} - {width}), p.drw - (p.pop - p.suc))"
    bounds = f"named_struct('a', {start}, 'b', least(p.suc, p.drw, rint(greatest({start}, {mean}) + {width})))"
    mode = "rint((p.drw + 1) * (p.suc + 1) / (p.pop + 2))"
    peak = f"least(greatest({mode}, q.a), q.b)"
    ratio = "((p.suc - x) * (p.drw - x) / ((x + 1) * (p.pop - p.suc - p.drw + x + 1)))"
    walk = f"""aggregate(
        transform(sequence(bigint(q.a), bigint(q.b)), i -> double(i)),
        named_struct('term', {log_term('q.a')} - top, 'total', 0.0D),
        (acc, x) -> named_struct(
            'term', acc.term + if({ratio} > 0, ln({ratio}), -1000000.0D), 'total', acc.total + exp(acc.term)),
        acc -> least(1.0D, acc.total * exp(top)))"""
    tail = f"""transform(array({inputs}), p -> transform(array({bounds}), q -> if(q.a > q.b, 0.0D,
        transform(array({log_term(peak)}), top -> {walk})[0]))[0])[0]"""
    return f"""CASE WHEN {population} IS NULL OR {population} <= 0 THEN double('NaN') WHEN {hits} <= 0 THEN 1.0D
        WHEN {hits} > least({successes}, {draws}) THEN 0.0D WHEN {draws} >= {population} THEN 1.0D ELSE {tail} END"""


def sign_test(wins: str, trials: str) -> str:
    """SQL of the two-sided exact sign test, capped at 1."""
    term = f"exp({log_choose(f'double({trials})', 'double(k)')} - {trials} * {math.log(2.0)!r}D)"
    terms = f"transform(sequence(bigint(greatest({wins}, {trials} - {wins})), bigint({trials})), k -> {term})"
    tail = f"aggregate({terms}, 0.0D, (a, b) -> a + b)"
    return f"if({trials} <= 0, 1.0D, least(1.0D, 2.0D * {tail}))"
