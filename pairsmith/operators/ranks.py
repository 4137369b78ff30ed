"""Ranks and running sums within groups of any size.

Rows are dealt out by ranges of (group, order), so a group of any size lies in as many
partitions as it fills.  Each partition needs only what stands before it in its group:
one head row for each partition and group, carried in front of the partition's own rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions.predicates import named
from pairsmith.sources import interim


def segmented(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column] | None = None, rank: str = "rank", size: str = "size") -> DataFrame:
    """The rows with their rank in their group (from 0), the size of the group, and each sum's running total up to the row itself.

    The order is ascending; negate a number to descend.  Null is a group like any other; no
    columns in ``by`` make one group of all rows.  Rows
    that tie in the whole order share the ranks between them in no stated way.  The new
    columns replace those of their names.
    """
    sums, taken = dict(sums or {}), {rank, size, *(sums or {})}
    keys, places, values = [f"b{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))], [f"s{i}" for i in range(len(sums))]
    row = F.struct(*(named(c) for c in df.columns if c not in taken))
    dealt = df.select(row.alias("row"), *(named(c).alias(k) for c, k in zip(by, keys, strict=True)), *(o.alias(p) for o, p in zip(order, places, strict=True)), *(v.alias(s) for v, s in zip(sums.values(), values, strict=True)))
    placed = interim.stored(dealt.repartitionByRange(*keys, *places).withColumn("part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("part", *keys).agg(F.count("*").alias("n"), *(F.sum(s).alias(s) for s in values))
    # one row for each partition and group in it
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select("part", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), *(F.sum(s).over(before).alias(s) for s in values), F.sum("n").over(group).alias("size"))
    own = placed.select("part", *keys, F.lit(True).alias("own"), *places, "row", F.lit(1).cast("long").alias("n"), *values, F.lit(None).cast("long").alias("size"))
    both = own.unionByName(heads.withColumn("own", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("part", *keys).orderBy("own", *places).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.select("own", "row", (F.sum("n").over(w) - 1).alias("n"), F.max("size").over(w).alias("size"), *(F.sum(s).over(w).alias(s) for s in values))
    return counted.filter("own").select("row.*", F.col("n").alias(rank), F.col("size").alias(size), *(F.col(s).alias(name) for name, s in zip(sums, values, strict=True)))
