"""Exact discrete tests as SQL expressions over column names.

Probabilities are taken relative to the mode of the distribution: ratios of neighbouring terms
are multiplied outward, tails are nested sums of such ratios, and everything is divided by the
total mass in the same units. No factorials are needed and small tails keep full relative
precision. Walks end where terms drop below the smallest double, so the work follows the standard
deviation and not the counts.

Arguments are SQL expressions, usually column names. Intermediate values are bound once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_TOLERANCE = 1e-7  # relative: outcomes this close to the observed one count as equally likely

Ratio = Callable[[str], str]


def _let(name: str, values: dict[str, str], body: str) -> str:
    fields = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"element_at(transform(array(struct({fields})), {name} -> {body}), 1)"


def _fold(first: str, last: str, step: int, start: str, body: str) -> str:
    """Fold `body` (over accumulator a and index i) from first to last; start if the range is empty."""
    ahead = f"{last} >= {first}" if step > 0 else f"{last} <= {first}"
    return (f"CASE WHEN {ahead} THEN aggregate(sequence({first}, {last}, {step}L), {start}, (a, i) -> {body}) "
            f"ELSE {start} END")


def _height(k: str, up: Ratio) -> str:
    """mass(k) / mass(mode)."""
    rise = _fold("s.mode + 1", f"least({k}, s.high)", 1, "1D", f"a * {up('i')}")
    fall = _fold("s.mode", f"greatest({k}, s.low) + 1", -1, "1D", f"a / ({up('i')})")
    return f"CASE WHEN {k} > s.high OR {k} < s.low THEN 0D WHEN {k} >= s.mode THEN {rise} ELSE {fall} END"


def _above(k: str, up: Ratio) -> str:
    """Sum of mass(i) / mass(k) over i > k, for k at or above the mode."""
    return _fold("s.high", f"{k} + 1", -1, "0D", f"{up('i')} * (1 + a)")


def _below(k: str, up: Ratio) -> str:
    """Sum of mass(i) / mass(k) over i < k, for k at or below the mode."""
    return _fold("s.low", f"{k} - 1", 1, "0D", f"(1 + a) / ({up('(i + 1)')})")


def _total(up: Ratio) -> str:
    return f"(1 + {_above('s.mode', up)} + {_below('s.mode', up)})"


def _bounded(values: dict[str, str], body: str) -> str:
    """Bind the ends of the walk around the mode; values give N-like parameters, lo, hi, peak and spread as s0.*."""
    reach = "CAST(ceil(480 + 38 * sqrt(greatest(s0.spread, 0D))) AS BIGINT)"
    mode = "least(greatest(CAST(s0.peak AS BIGINT), s0.lo), s0.hi)"
    params = {k: f"s1.s0.{k}" for k in values if k not in ("lo", "hi", "peak", "spread")}
    inner = {**params, "low": "greatest(s1.s0.lo, s1.mode - s1.reach)", "high": "least(s1.s0.hi, s1.mode + s1.reach)",
             "mode": "s1.mode"}
    return _let("s0", values, _let("s1", {"s0": "s0", "mode": mode, "reach": reach}, _let("s", inner, body)))


def _at_least(values: dict[str, str], up: Ratio) -> str:
    upper = f"({_height('s.k', up)}) * (1 + {_above('s.k', up)}) / {_total(up)}"
    lower = f"1 - ({_height('(s.k - 1)', up)}) * (1 + {_below('(s.k - 1)', up)}) / {_total(up)}"
    return _bounded(values, f"CASE WHEN s.k <= s.low THEN 1D WHEN s.k > s.high THEN 0D WHEN s.k > s.mode THEN {upper} "
                            f"ELSE {lower} END")


def _two_sided(values: dict[str, str], up: Ratio) -> str:
    """Mass of all outcomes no likelier than k; rounding noise just below 1 is taken as 1."""
    def side(first, last, step, ratio):
        add = _let("r", {"v": f"a.r * {ratio}"}, "named_struct('r', r.v, 'sum', a.sum + IF(r.v <= t.bar, r.v, 0D))")
        return f"({_fold(first, last, step, _START, add)}).sum"
    down = side("s.mode", "s.low + 1", -1, f"(1 / ({up('i')}))")
    rise = side("s.mode + 1", "s.high", 1, f"({up('i')})")
    share = f"({down} + {rise} + IF(t.bar >= 1, 1D, 0D)) / {_total(up)}"
    p = _bounded(values, _let("t", {"bar": f"({_height('s.k', up)}) * (1 + {TIE_TOLERANCE}D)"}, share))
    return _let("q", {"p": p}, "IF(q.p > 1 - 1e-12D, 1D, q.p)")


_START = "named_struct('r', 1D, 'sum', 0D)"


def _hypergeometric(k: str, N: str, K: str, n: str) -> tuple[dict[str, str], Ratio]:
    N, K, n = (f"CAST({x} AS BIGINT)" for x in (N, K, n))
    spread = (f"CAST({n} AS DOUBLE) * {K} / greatest({N}, 1) * (1 - {K} / greatest({N}, 1)) "
              f"* ({N} - {n}) / greatest({N} - 1, 1)")
    values = {"all": f"CAST({N} AS DOUBLE)", "held": f"CAST({K} AS DOUBLE)", "drawn": f"CAST({n} AS DOUBLE)",
              "k": f"CAST({k} AS BIGINT)", "lo": f"greatest(0L, {n} + {K} - {N})", "hi": f"least({K}, {n})",
              "peak": f"floor(({n} + 1D) * ({K} + 1D) / ({N} + 2D))", "spread": spread}
    return values, lambda i: f"((s.held - {i} + 1) * (s.drawn - {i} + 1) / ({i} * (s.all - s.held - s.drawn + {i})))"


def _binomial(k: str, n: str, p: str) -> tuple[dict[str, str], Ratio]:
    n, p = f"CAST({n} AS BIGINT)", f"CAST({p} AS DOUBLE)"
    values = {"trials": f"CAST({n} AS DOUBLE)", "odds": f"{p} / (1 - {p})", "k": f"CAST({k} AS BIGINT)", "lo": "0L", "hi": n,
              "peak": f"floor(({n} + 1) * {p})", "spread": f"{n} * {p} * (1 - {p})"}
    return values, lambda i: f"((s.trials - {i} + 1) / {i} * s.odds)"


def hypergeometric_tail(k: str, N: str, K: str, n: str) -> Column:
    """P(X >= k) when n items are drawn from N of which K carry the term."""
    return F.expr(_at_least(*_hypergeometric(k, N, K, n)))


def fisher_two_sided(a: str, b: str, P: str, N: str) -> Column:
    """Two-sided exact p of the table [[a, P-a], [b, N-b]]."""
    return F.expr(_two_sided(*_hypergeometric(a, f"({P} + {N})", f"({a} + {b})", P)))


def binomial_two_sided(k: str, n: str, p: str) -> Column:
    """Two-sided exact p of k successes in n trials with success rate 0 < p < 1."""
    return F.expr(_two_sided(*_binomial(k, n, p)))


def neg_log10(p: Column, cap: float = 300.0) -> Column:
    """-log10 p with p floored at 10**-cap."""
    return -F.log10(F.greatest(p, F.lit(10.0 ** -cap)))
