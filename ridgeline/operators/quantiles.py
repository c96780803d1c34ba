"""Exact percentiles by group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: an exact pass looks at about 4 in so many values.
ACCURACY = 10_000


def quantiles(df: DataFrame, by: str = "map_id", **wanted: tuple[Column, float]) -> DataFrame:
    """by, and for each name=(column, p) the p-quantile of the column's values, interpolated linearly; nulls and NaN don't count.

    A sketch brackets each quantile between two values whose ranks are sure.  A second pass counts
    what is below the bracket and each value inside it, with partial aggregation, so that no task
    holds all values of a group.  df is read twice.
    """
    value = {n: F.when(~F.isnan(c.cast("double")), c.cast("double")) for n, (c, _) in wanted.items()}
    margin = 2.0 / ACCURACY
    sketch = [F.percentile_approx(value[n], [max(0.0, p - margin), min(1.0, p + margin)], ACCURACY).alias(f"{n}_in") for n, (_, p) in wanted.items()]
    known = df.groupBy(by).agg(*sketch, *(F.count(value[n]).alias(f"{n}_n") for n in wanted))
    below = float("-inf")
    keys = []
    for n in wanted:
        v, small = value[n], F.col(f"{n}_n") < ACCURACY  # a margin of less than a rank: all values count
        low, high = (F.when(~small, F.get(f"{n}_in", F.lit(i))).otherwise(F.lit(b)) for i, b in ((0, below), (1, -below)))
        keys.append(F.struct(F.lit(n).alias("name"), F.when(v < low, F.lit(below)).when(v <= high, v).alias("key")))
    one = df.join(known, by).select(by, F.explode(F.array(*keys)).alias("k")).select(by, "k.name", "k.key").filter("key is not null")
    steps = one.groupBy(by, "name", "key").agg(F.count("*").alias("here"))
    steps = steps.withColumn("upto", F.sum("here").over(Window.partitionBy(by, "name").orderBy("key"))).join(known, by)
    out = []
    for n, (_, p) in wanted.items():
        place = F.lit(p) * (F.col(f"{n}_n") - 1)
        mine = F.col("name") == n
        out += [F.min(F.when(mine & (F.col("upto") > F.floor(place)), F.col("key"))).alias(f"{n}_a"), F.min(F.when(mine & (F.col("upto") > F.ceil(place)), F.col("key"))).alias(f"{n}_b"), F.max(place - F.floor(place)).alias(f"{n}_f")]
    ends = steps.groupBy(by).agg(*out)
    return ends.select(by, *((F.col(f"{n}_a") + (F.coalesce(F.col(f"{n}_b"), F.col(f"{n}_a")) - F.col(f"{n}_a")) * F.col(f"{n}_f")).alias(n) for n in wanted))
