"""The computation behind each kind of plot, as DataFrames; drawing is up to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonspark.functions.numeric import number
from axonspark.operators.predicates import cell

KINDS = ("scatter", "line", "bar", "hist", "violin", "bubble", "heatmap")
#: Areas of the smallest and largest bubble, and of all where the sizes are equal.
BUBBLE = (20.0, 240.0, 130.0)


def require(**columns: str | None) -> None:
    missing = [k for k, v in columns.items() if not v]
    if missing:
        raise ValueError("needed: " + ", ".join(missing))


def _color(df: DataFrame, color: str | None) -> Column:
    return cell(df, color) if color else F.lit("")


def points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Scatter: x, y and the group."""
    require(x=x, y=y)
    return df.select(number(cell(df, x)).alias("x"), number(cell(df, y)).alias("y"), _color(df, color).alias("color"))


def lines(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Line: the points of each group, which whoever draws them joins by x."""
    return points(df, x, y, color)


def bars(df: DataFrame, x: str, y: str) -> DataFrame:
    require(x=x, y=y)
    return df.select(cell(df, x).alias("label"), number(cell(df, y)).alias("height"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """bin, low, high, count over equal widths from the least to the greatest value; bins without values are left out.

    There are min(40, max(8, floor(sqrt(n)))) bins and the last is closed. One
    value alone is centred in a width of 1, as plotting libraries do.
    """
    require(value=value)
    v = df.select(number(cell(df, value)).alias("v"))
    least, most, n = (v.agg(f.alias("x")).scalar() for f in (F.min("v"), F.max("v"), F.count("*")))
    lo, hi = F.when(least == most, least - 0.5).otherwise(least), F.when(least == most, most + 0.5).otherwise(most)
    bins = F.least(F.lit(40), F.greatest(F.lit(8), F.floor(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))))).cast("long")
    placed = v.select("v", lo.alias("lo"), bins.alias("bins"), ((hi - lo) / bins).alias("w"))
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("bins") - 1).cast("long")
    counted = placed.groupBy(bin_.alias("bin"), "lo", "w").agg(F.count("*").alias("count"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "count").orderBy("bin")


#: Rank error of a quantile sketch, in parts of a group's rows.
SKETCH = 10_000
QUARTERS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def quantiles(df: DataFrame, by: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """``by``, count, low, high and exact quantiles, interpolated between neighbours, of every group; values aren't null.

    A sketch of each group, of bounded size, gives two values that a quantile is
    certain to lie between. Rows below them are counted, and only the values
    between them, a few thousandths of the group, are counted one by one; both
    add up inside tasks before anything moves.
    """
    v = df.select(F.col(by).alias("g"), F.col(value).alias("v"))
    names = list(wanted)
    off = 3 / SKETCH
    parts = [min(max(q + d, 0.0), 1.0) for q in wanted.values() for d in (-off, off)]
    known = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", parts, SKETCH).alias("cuts"))
    few = F.col("n") < 3 * SKETCH  # where the sketch may be off by more than a part, all values count
    bounds = [F.when(few, F.col("low")).otherwise(F.col("cuts")[2 * k]).alias(f"lo{k}") for k in range(len(names))] + [F.when(few, F.col("high")).otherwise(F.col("cuts")[2 * k + 1]).alias(f"hi{k}") for k in range(len(names))]
    known = known.select(F.col("g").alias("kg"), "n", "low", "high", *bounds)
    edges = [c for k in range(len(names)) for c in (f"lo{k}", f"hi{k}")]
    rows = v.join(known.select("kg", *edges), F.col("g").eqNullSafe(F.col("kg"))).select("g", "v", *edges)
    # every value between the bounds by itself; those between stretches as one number
    near = reduce(lambda a, b: a | b, [F.col("v").between(F.col(f"lo{k}"), F.col(f"hi{k}")) for k in range(len(names))])
    stretch = sum((F.col("v") > F.col(f"hi{k}")).cast("int") for k in range(len(names)))
    counted = rows.groupBy("g", stretch.alias("s"), F.when(near, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("g").orderBy("s", F.col("v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = ranked.join(known.select("kg", "n", "low", "high"), F.col("g").eqNullSafe(F.col("kg")))
    at = {m: F.lit(q) * (F.col("n") - 1) for m, q in wanted.items()}
    pick = lambda rank: F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))
    found = ranked.groupBy("g", "n", "low", "high").agg(*[x for m in names for x in (pick(F.floor(at[m])).alias(f"{m}_a"), pick(F.ceil(at[m])).alias(f"{m}_b"))])
    between = lambda m: F.when(F.floor(at[m]) == F.ceil(at[m]), F.col(f"{m}_a")).otherwise((F.ceil(at[m]) - at[m]) * F.col(f"{m}_a") + (at[m] - F.floor(at[m])) * F.col(f"{m}_b"))
    return found.select(F.col("g").alias(by), F.col("n").alias("count"), "low", "high", *[between(m).alias(m) for m in names])


def violins(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per group: count, extremes, quartiles and median."""
    require(x=x, y=y)
    return quantiles(df.select(cell(df, x).alias("group"), number(cell(df, y)).alias("value")), "group", "value", QUARTERS).orderBy("group")


def bubbles(df: DataFrame, x: str, y: str, size: str, color: str | None = None) -> DataFrame:
    """Points with an area between the smallest and the largest; equal sizes get the middle one."""
    require(x=x, y=y, size=size)
    s = df.select(number(cell(df, x)).alias("x"), number(cell(df, y)).alias("y"), number(cell(df, size)).alias("s"), _color(df, color).alias("color"))
    lo, hi = s.agg(F.min("s").alias("x")).scalar(), s.agg(F.max("s").alias("x")).scalar()
    low, high, middle = BUBBLE
    area = F.when(lo == hi, F.lit(middle)).otherwise(low + (F.col("s") - lo) / (hi - lo) * (high - low))
    return s.select("x", "y", "color", area.alias("area"))


def heatmap(df: DataFrame, x: str, y: str, value: str, order: str = "_ordinal") -> DataFrame:
    """(y, x, value) of every cell that has rows; of several the last by ``order`` counts."""
    require(x=x, y=y, value=value)
    at = F.col(order) if order in df.columns else F.lit(0)
    return df.groupBy(cell(df, y).alias("y"), cell(df, x).alias("x")).agg(F.max_by(number(cell(df, value)), at).alias("value")).orderBy("y", "x")


def heatmap_table(df: DataFrame, x: str, y: str, value: str, order: str = "_ordinal") -> DataFrame:
    """The cells as a table with a column per x; missing ones are null."""
    return heatmap(df, x, y, value, order).groupBy("y").pivot("x").agg(F.first("value")).orderBy("y")


def top_labels(df: DataFrame, label: str, n: int) -> DataFrame:
    """The labels of the first ``n`` rows."""
    out = df.orderBy("_ordinal") if "_ordinal" in df.columns else df
    return out.select(cell(df, label).alias("label")).limit(n)


def first_in_file(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every file."""
    w = Window.partitionBy("_file").orderBy("_ordinal")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
