"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.shared import kept

SYMBOL = ("symbol_id",)


def along(*keys: str, order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(*(keys or SYMBOL)).orderBy(order)


def trailing(n: int, *keys: str, order: str = "trade_date", skip: int = 0) -> WindowSpec:
    """The last ``n`` rows, the current one included unless ``skip`` rows are left out."""
    return along(*keys, order=order).rowsBetween(-(n - 1) - skip, -skip)


def full(value: Column, spec: WindowSpec, n: int, of: Column | None = None) -> Column:
    """A window value where the frame holds at least ``n`` rows (or non-null values of ``of``), else null."""
    return F.when(F.count(F.lit(1) if of is None else of).over(spec) >= n, value)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def pct_rank(value: str | Column, *keys: str | Column) -> Column:
    """Tie-averaged percentile in (0, 1] within the keys; nulls stay null and do not count."""
    col = F.col(value) if isinstance(value, str) else value
    part = Window.partitionBy(*keys)
    ranked = F.rank().over(part.orderBy(col.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, col)) - 1) / 2
    return F.when(col.isNotNull(), ranked / F.count(col).over(part))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def nearest(value: Column, digits: int = 6) -> Column:
    """A number rounded as SQL engines do it: its product with a power of ten to the nearest whole number, halves away from zero.

    ``F.round`` rounds the shortest decimal text of the number instead, so that
    262.0771875 goes up although its product with a million lies below the half.
    """
    scale = 10.0**digits
    product = value * scale
    size = F.abs(product)
    whole = F.floor(size).cast("double")
    up = whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)
    # from 2 ** 52 on all numbers are whole
    near = F.when(size < 2.0**52, F.when(product < 0, -up).otherwise(up)).otherwise(product)
    return F.when(size == float("inf"), value).otherwise(near / scale)


def deviation(value: Column, spec: WindowSpec) -> Column:
    """How many population deviations a value is from the mean of a frame, null where the frame has none.

    Frames of whole numbers (volumes) are summed as such, so that a value exactly
    two deviations away gives exactly 2 whatever the order of its frame.
    """
    n, total, squares = F.count(value).over(spec), F.sum(value).over(spec), F.sum(value * value).over(spec)
    exact = (F.min(value == F.floor(value)).over(spec)) & (value == F.floor(value)) & (n * squares < 2.0**53)
    mean, spread = F.avg(value).over(spec), F.stddev_pop(value).over(spec)
    return F.when(exact, ratio(n * value - total, F.sqrt(n * squares - total * total))).otherwise(ratio(value - mean, spread))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order; unknown conditions do not hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def places(rows: DataFrame, value: str, name: str, *keys: str, pieces: int = 64) -> DataFrame:
    """Tie-averaged percentile in (0, 1] of each distinct value within a few large groups, without a window over any of them.

    Distinct values are dealt into pieces of about equal size by cut points;
    a piece knows how many rows lie before it, and a window places the values
    within it. Rows are read a few times, so they should be a table. Cut points
    and pieces are broadcast: ``pieces`` rows for each of the keys, which must
    be few (factors, horizons, bands).
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 1000).alias("_cuts"))
    dealt = (counts.join(F.broadcast(cuts), [*keys]) if keys else counts.join(F.broadcast(cuts))).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_piece").agg(F.sum("_c").alias("_size"))
    sizes = sizes.select(*keys, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*keys)).alias("_all"))
    within = Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(sizes), [*keys, "_piece"]).withColumn(name, (F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)) + (F.col("_c") + 1) / 2) / F.col("_all")).select(*keys, value, name)


def spread_rank(rows: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """Rows, written once, with the percentile of a value within a few large groups; nulls stay null."""
    rows = kept(rows)
    return rows.join(places(rows, value, name, *keys), [*keys, value], "left")


def rank_pairs(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Pairs of known values, written once, with their percentiles ``_a`` and ``_b`` within a few large groups."""
    both = kept(rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b))
    return both.join(places(both, a, "_a", *keys), [*keys, a]).join(places(both, b, "_b", *keys), [*keys, b])
