"""Fuzzy inference: membership, rules, spread update. As in `geo`, functions of
columns take and give SQL text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from roadpulse.functions.geo import number

# Fixed values.
DEFAULT_SD = 1.0
MAX_SD = 2.75
MIN_SD = 0.15
DENSE_BELOW = 1.45
DENSE = "DENSE"
SPARSE = "SPARSE"
UNSET = "NONE"

# Density levels.
LEVELS = {"VL": 0.1, "L": 0.35, "M": 0.55, "H": 0.75, "VH": 1.0}

# Fixed values: (count term, distance term) -> density level. The tight base
# has no rule for a low count at a low distance.
RULES = {
    "tight": {
        ("med", "low"): "H",
        ("high", "low"): "VH",
        ("low", "med"): "VL",
        ("med", "med"): "L",
        ("high", "med"): "L",
        ("low", "high"): "VL",
        ("med", "high"): "VL",
        ("high", "high"): "L",
    },
    "initial": {
        ("low", "low"): "M",
        ("med", "low"): "H",
        ("high", "low"): "VH",
        ("low", "med"): "L",
        ("med", "med"): "M",
        ("high", "med"): "H",
        ("low", "high"): "VL",
        ("med", "high"): "L",
        ("high", "high"): "M",
    },
}

# Corners of the triangles (foot, peak, foot), and the value from
# which a high term is flat at one. Below it the rising side is not capped.
COUNT_TERMS = {"low": (None, 0.0, 3.0), "med": (0.0, 3.0, 8.0), "high": (3.0, 8.0, None)}
COUNT_FLAT = 10.0
DISTANCE_TERMS = {"low": (None, 0.0, 0.75), "med": (0.25, 1.0, 1.75), "high": (1.25, 2.0, None)}
DISTANCE_FLAT = 2.0


def spread(sd: str) -> str:
    return f"(case when {sd} > 0 then {sd} else {number(DEFAULT_SD)} end)"


def membership(miles: str, sd: str, max_miles: float) -> str:
    """Gaussian in the distance; 0 without a match or beyond `max_miles`. A hot
    spot that has no spread yet counts as the default one."""
    gauss = f"least(exp(pow({miles} / {spread(sd)}, 2D) * -0.5D), 1D)"
    return f"case when {miles} <= {number(max_miles)} then {gauss} else 0D end"


def _term(x: str, corners: tuple, flat_from: float) -> str:
    foot, peak, end = corners
    sides = []
    if foot is not None:
        sides.append(f"({x} - {number(foot)}) / {number(peak - foot)}")
    if end is not None:
        sides.append(f"({number(end)} - {x}) / {number(end - peak)}")
    inside = f"greatest({sides[0]}, 0D)"
    if len(sides) == 2:
        inside = f"greatest(least({', '.join(sides)}), 0D)"
    if end is None:
        return f"case when {x} >= {number(flat_from)} then 1D else {inside} end"
    return inside


def count_term(n: str, term: str) -> str:
    return _term(f"cast({n} as double)", COUNT_TERMS[term], COUNT_FLAT)


def distance_term(miles: str, term: str) -> str:
    return _term(miles, DISTANCE_TERMS[term], DISTANCE_FLAT)


def rule_strength(n: str, miles: str, rule: tuple[str, str]) -> str:
    return f"least({count_term(n, rule[0])}, {distance_term(miles, rule[1])})"


def with_density(df: DataFrame, n: str, mean_miles: str, rule_base: str = "tight") -> DataFrame:
    """Adds `density`, the strength-weighted mean of the rule outputs; null
    where no rule applies, which needs a count of zero."""
    rules = RULES[rule_base]
    weights = [f"{rule_strength(n, mean_miles, r)} as _w{i}" for i, r in enumerate(rules)]
    total = " + ".join(f"_w{i}" for i in range(len(rules)))
    weighted = " + ".join(f"_w{i} * {number(LEVELS[v])}" for i, v in enumerate(rules.values()))
    return df.selectExpr("*", *weights).selectExpr(
        *[c for c in df.columns], f"try_divide({weighted}, {total}) as density"
    )


def round2(x: str) -> str:
    """Two places, halves up."""
    return f"(floor({x} * 100D + 0.5D) / 100D)"


def raw_sd(sd: str, n: str, density: str, decay_rate: float) -> str:
    """Spread before rounding: from the density where incidents came, grown by
    the decay rate where none did. A new hot spot (null) takes the fresh value."""
    fresh = (
        f"({number(MIN_SD)} + (1D - least(greatest({density}, 0.01D), 1D))"
        f" * {number(MAX_SD - MIN_SD)})"
    )
    grown = f"coalesce(({sd} * 0.5D + {fresh}) / 1.5D, {fresh})"
    idle = _idle(f"coalesce({sd}, {number(DEFAULT_SD)})", decay_rate)
    return f"case when {n} > 0 then {grown} else {idle} end"


def _idle(sd: str, decay_rate: float) -> str:
    return f"least({sd} * {number(1.0 + decay_rate)}, {number(MAX_SD)})"


def density_label(raw: str) -> str:
    return f"case when {raw} < {number(DENSE_BELOW)} then '{DENSE}' else '{SPARSE}' end"


def update_sd(df: DataFrame, decay_rate: float, rule_base: str = "tight") -> DataFrame:
    """New `sd`, rounded, and `density_label`, taken before rounding, from the
    columns sd, n_added and dist_sum."""
    keep = [c for c in df.columns if c not in ("sd", "density_label")]
    with_mean = df.selectExpr("*", "case when n_added > 0 then dist_sum / n_added end as _mean")
    return (
        with_density(with_mean, "n_added", "_mean", rule_base)
        .selectExpr("*", f"{raw_sd('sd', 'n_added', 'density', decay_rate)} as _raw")
        .selectExpr(*keep, f"{round2('_raw')} as sd", f"{density_label('_raw')} as density_label")
    )


def idle_spread(df: DataFrame, decay_rate: float, steps: int) -> DataFrame:
    """`sd` and `density_label` after `steps` intervals without incidents. Each
    step rounds, so they are folded one by one inside the expression."""
    keep = [c for c in df.columns if c not in ("sd", "density_label")]
    step = round2(_idle("s", decay_rate))
    start = f"coalesce(sd, {number(DEFAULT_SD)})"
    before = f"aggregate(array_repeat(0, {max(steps - 1, 0)}), {start}, (s, i) -> {step})"
    return df.selectExpr("*", f"{_idle(before, decay_rate)} as _raw").selectExpr(
        *keep, f"{round2('_raw')} as sd", f"{density_label('_raw')} as density_label"
    )


def effective_radius(sd: str, max_miles: float, conf_threshold: float) -> str:
    """Miles beyond which a hot spot of this spread takes no incident."""
    widths = math.sqrt(-2.0 * math.log(conf_threshold)) * (1.0 + 1e-9)
    return f"least({spread(sd)} * {number(widths)}, {number(max_miles)})"
