"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: Column | str) -> Column:
    """Nearest long, ties upwards, also below zero."""
    return F.floor(col(x) + 0.5)


def round2(x: Column | str) -> Column:
    return F.floor(col(x) * 100.0 + 0.5) / 100.0


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def finite(x: Column | str) -> Column:
    """Null for NaN and infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def positive(x: Column | str) -> Column:
    """Null unless finite and above zero."""
    return F.when(finite(x) > 0, col(x))


def epoch_day(ts: Column | str) -> Column:
    """UTC day number of epoch milliseconds."""
    return F.floor(col(ts) / DAY_MS)


def bucket_start(ts: Column | str, width_ms: int) -> Column:
    return (F.floor(col(ts) / width_ms) * width_ms).cast("long")


def non_blank(x: Column | str) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(col(x)), F.lit(""))


def norm_product_id(x: Column | str) -> Column:
    return F.upper(non_blank(x))


def mid(buy: Column | str, sell: Column | str) -> Column:
    return (col(buy) + col(sell)) / 2.0


def rel_spread(buy: Column | str, sell: Column | str) -> Column:
    """(high - low) / mid, 1 where a price is missing or not positive."""
    a, b = positive(buy), positive(sell)
    return F.coalesce((F.greatest(a, b) - F.least(a, b)) / F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2.0), F.lit(1.0))


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """0.6745 (x - median) / MAD; a MAD of zero counts as 1e-9, so that other floors decide."""
    return 0.6745 * (x - median) / F.greatest(F.lit(1e-9), mad)


def last_per(order: Column, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))
