"""Downsampling, splitting and stratified samples, by keyed hashes: the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions.predicates import Rule, first_hit, named, truth
from pairsmith.operators.evaluate import census


def keyed_hash(seed: int, keys: Sequence[str]) -> Column:
    """An order of rows that looks random but depends on the keys alone."""
    return hashed(seed, map(named, keys))


def hashed(seed: int, keys: Iterable[Column]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def sampling_step(n_pos: int, n_labelled_neg: int, n_unlabelled: int, positive_rate: float) -> int | None:
    """Keep every so many rows; None keeps no unlabelled row."""
    want_neg = int(n_pos * (1 - positive_rate) / positive_rate)
    want = max(0, want_neg - n_labelled_neg)
    return max(1, n_unlabelled // want) if want else None


def downsample(df: DataFrame, keys: Sequence[str], positive_rate: float | None, label: str = "label") -> DataFrame:
    """All labelled rows, and every n-th row in the order of the keys.

    Row numbers are dealt out by range partitions: each needs only the counts of those before it.
    """
    if positive_rate is None:
        return df
    c = census(df, label).first()
    step = sampling_step(c.n_pos, c.n_labelled_neg, c.n_unlabelled, positive_rate)
    labelled = named(label).isNotNull()
    if step is None:
        return df.filter(labelled)
    return with_row_index(df, keys).filter(labelled | (F.col("row_index") % step == 0)).drop("row_index")


def with_row_index(df: DataFrame, keys: Sequence[str], order: Callable[[Callable[[str], Column]], Sequence[Column]] | None = None) -> DataFrame:
    """row_index 0, 1, ... in the order of the keys, without one task that sorts all rows.

    order: makes the columns to order by, in place of the keys, from those of the row; they
    are made anew behind each shuffle and not carried through it.
    """
    from pairsmith.sources import interim

    short = {c: f"c{i}" for i, c in enumerate(df.columns)}
    by = [F.col(short[k]) for k in keys] if order is None else list(order(lambda c: F.col(short[c])))
    dealt = df.toDF(*short.values()).repartitionByRange(*by)
    placed = interim.stored(dealt.withColumn("part", F.spark_partition_id()), "row-index")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = [f"o{i}" for i in range(len(by))]
    together = placed.repartition("part").select("*", *(o.alias(p) for o, p in zip(by, places, strict=True)))
    numbered = together.withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy(*places))).join(F.broadcast(bases), "part")
    return numbered.select(*(F.col(s).alias(c) for c, s in short.items()), (F.col("base") + F.col("number") - 1).alias("row_index"))


def train_test_split(df: DataFrame, keys: Sequence[str], test_split: float | None, seed: int = 42, label: str = "label") -> DataFrame:
    """The rows with a column is_train; of each class the first share in hashed order is for training, null labels count as negative."""
    if not test_split:
        return df.withColumn("is_train", F.lit(True))
    sizes = {r.y: r["count"] for r in df.groupBy(truth(label).alias("y")).count().collect()}
    negatives = sizes.get(False, 0)
    train = {y: int(n * (1 - test_split)) for y, n in sizes.items()}
    true = lambda y: F.coalesce(y.cast("boolean"), F.lit(False))
    # negatives first
    placed = with_row_index(df, keys, lambda own: [true(own(label)), hashed(seed, map(own, keys)), *map(own, keys)])
    in_class = F.col("row_index") - F.when(truth(label), negatives).otherwise(0)
    return placed.select(*map(named, df.columns), (in_class < F.when(truth(label), train.get(True, 0)).otherwise(train.get(False, 0))).alias("is_train"))


def with_stratum(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Stratum: the first rule that fires, or -1."""
    return df.withColumn("stratum_k", first_hit(rules))


def allocation(df: DataFrame, size: int = 500) -> DataFrame:
    """(stratum_k, n_total, n_sample): proportional, at least 1 and at most the stratum; halves are rounded away from 0."""
    counts = df.filter("stratum_k >= 0").groupBy("stratum_k").agg(F.count("*").alias("n_total"))
    share = F.round(F.col("n_total") / F.sum("n_total").over(Window.partitionBy()) * size)
    return counts.withColumn("n_sample", F.least("n_total", F.greatest(F.lit(1), share)).cast("long"))


def stratified_sample(df: DataFrame, keys: Sequence[str], size: int = 500, seed: int = 42) -> DataFrame:
    """Exactly n_sample rows of each stratum, the first in hashed order.

    The fixed bound on ranks lets each partition drop all but its first rows before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("stratum_k").orderBy(keyed_hash(seed, keys), *map(named, keys)))
    return df.filter("stratum_k >= 0").join(F.broadcast(allocation(df, size)), "stratum_k").withColumn("rank", rank).filter((F.col("rank") <= size) & (F.col("rank") <= F.col("n_sample"))).drop("rank")
