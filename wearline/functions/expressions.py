"""Column expressions (native Spark SQL, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.schema import RISK_LEVELS, WEAR_BOUNDS, WEAR_STATES


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold_decision(p, threshold: float = 0.5) -> Column:
    """``int(p >= threshold)``."""
    return (col(p) >= F.lit(threshold)).cast("bigint")


def risk_level(p) -> Column:
    """< 0.3 LOW, < 0.5 MEDIUM, < 0.75 HIGH, else CRITICAL (the code's
    rule: 0.75 itself is CRITICAL)."""
    p = col(p)
    e = None
    for name, _, hi, _, _ in RISK_LEVELS:
        if hi is None:
            e = e.otherwise(F.lit(name))
        else:
            e = F.when(p < hi, F.lit(name)) if e is None else e.when(p < hi, F.lit(name))
    return F.when(p.isNull(), F.lit(None)).otherwise(e)


def wear_state(rul) -> Column:
    """P10: > 100 healthy, > 50 moderate_wear, > 20 severe_wear, else failed."""
    r = col(rul)
    h, m, s = WEAR_BOUNDS
    return (F.when(r > h, WEAR_STATES[0]).when(r > m, WEAR_STATES[1])
            .when(r > s, WEAR_STATES[2]).otherwise(WEAR_STATES[3]))


def seeded_hash(seed, *keys) -> Column:
    """Deterministic pseudo-random integer in [0, 2^32): the first 8 hex
    digits of ``md5(seed|k1|k2...)``. DuckDB gives the same number with
    ``('0x' || substr(md5(...), 1, 8))::BIGINT``."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("|"), col(k).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed, *keys) -> Column:
    """``seeded_hash / 2^32`` in [0, 1)."""
    return seeded_hash(seed, *keys).cast("double") / F.lit(4294967296.0)


def percent(x, digits: int = 1) -> Column:
    """``f"{x:.1%}"`` (half-even on the binary value, like Python)."""
    return F.concat(F.regexp_replace(F.format_number(col(x) * 100, digits), ",", ""), F.lit("%"))
