"""Places, ranks and percentiles of whole leagues without a task that sorts a league.

Rows are dealt to ranges of the order (Spark samples the splitters), numbered within their
range, and the sizes of the ranges before are added: a group of any size is many ranges.
Ranks and percentiles first sum equal values, so a value that many rows share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.sources.shared import written

#: Bins of a round of ``percentiles``: what a group keeps in memory for each place asked.
BINS = 1024


def numbered(frame: DataFrame, keys: list[str], order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """frame with a row's place in its group: 1 and up, or with ``weight`` the weights of all
    rows before.  ``order`` must tell rows of a group apart, or equal ones are numbered as they come."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(frame.repartitionByRange(parts, *map(F.col, keys), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    own = F.lit(1) if weight is None else F.col(weight)
    sizes = ranged.groupBy(*keys, "__range").agg(F.sum(own).alias("__size"))  # a row a group and range
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "__range", F.coalesce(F.sum("__size").over(until(Window.partitionBy(*keys).orderBy("__range"))), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order)
    place = F.row_number().over(within) if weight is None else F.coalesce(F.sum(weight).over(until(within)), F.lit(0))
    placed = ranged.withColumn("__place", place)
    before = before.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__range").alias("__of"), "__before")
    condition = F.col("__range") == F.col("__of")
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return placed.join(before, condition).withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).select(*frame.columns, name)


def value_ranks(frame: DataFrame, keys: list[str], value: str, name: str, descending: bool = True) -> DataFrame:
    """frame with the rank of its value in its group (equal values share the first place) and
    the group's size as ``<name>_of``."""
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    placed = numbered(counts, keys, [order], "__before", "__n")
    total = counts.groupBy(*keys).agg(F.sum("__n").alias(f"{name}_of"))
    table = placed.join(total, keys).select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col(value).alias("__value"), (F.col("__before") + 1).alias(name), f"{name}_of")
    condition = F.col(value).eqNullSafe(F.col("__value"))
    for k in keys:
        condition &= F.col(k) == F.col(f"__of_{k}")
    return frame.join(table, condition).select(*frame.columns, name, f"{name}_of")


def percentiles(frame: DataFrame, keys: list[str], value: str, shares: dict[str, float], least: int = 1) -> DataFrame:
    """(keys, n, one column a share): exact percentiles with linear interpolation on
    (n - 1) p, of groups with ``least`` values.  Nulls count as no values.

    The places asked are narrowed round by round: a histogram between the smallest and the
    largest value that are left tells in which bin a place lies, and that bin's own smallest and
    largest value are the next bounds, until they are one.  A round is one aggregate of at most
    ``BINS`` rows for each place asked, whatever the group's size.
    """
    rows = written(frame.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")), "values")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).filter(F.col("n") >= least)
    sides = [F.struct(F.lit(name).alias("share"), F.lit(side).alias("side"), f((F.col("n") - 1) * p).cast("long").alias("place"), ((F.col("n") - 1) * p % 1).alias("part")) for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    asked = written(groups.select(*keys, "n", "low", "high", F.inline(F.array(*sides))), "places")
    done, left = asked.filter("low = high"), asked.filter("low < high")
    bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("__v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int")
    while left.limit(1).count():
        # several shares may ask one place: it is looked for once
        wanted = left.select(*keys, "place", "low", "high").distinct()
        inside = rows.join(wanted, keys).filter("__v >= low and __v <= high")
        bins = inside.groupBy(*keys, "place", "low", "high", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        below = Window.partitionBy(*keys, "place", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = bins.withColumn("before", F.coalesce(F.sum("c").over(below), F.lit(0)))
        hit = counted.filter("place >= before and place < before + c").select(*keys, "place", "low", "high", F.col("least").alias("new_low"), F.col("most").alias("new_high"), "before")
        # from here on a place is counted from the bin's first value
        left = left.join(hit, [*keys, "place", "low", "high"]).select(*keys, "n", F.col("new_low").alias("low"), F.col("new_high").alias("high"), "share", "side", (F.col("place") - F.col("before")).alias("place"), "part")
        left = written(left, "places")
        done, left = done.unionByName(left.filter("low = high")), left.filter("low < high")
    at = lambda name, side: F.max(F.when((F.col("share") == name) & (F.col("side") == side), F.col("low")))
    share = lambda name: F.max(F.when(F.col("share") == name, F.col("part")))
    return done.groupBy(*keys, "n").agg(*[(at(name, "low") + (at(name, "high") - at(name, "low")) * share(name)).alias(name) for name in shares])
