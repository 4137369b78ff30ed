"""The data behind each plot of an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.config import PairColumns
from pairsmith.functions.predicates import Rule, any_fires, named, truth
from pairsmith.operators.evaluate import ratio

#: Days between two documents that reports look at, and the width of a bin of the savings report.
MAX_DAYS = 730
BIN_DAYS = 60


def days_between(c: PairColumns) -> Column:
    """Whole days from the second document to the first."""
    return F.timestamp_diff("DAY", named(c.import_time + c.suffix), named(c.import_time)).cast("int")


def _apart(df: DataFrame, c: PairColumns) -> DataFrame:
    return df.withColumn("days", days_between(c)).filter((F.col("days") > 0) & (F.col("days") < MAX_DAYS))


def time_histogram(df: DataFrame, rules: Sequence[Rule], c: PairColumns = PairColumns()) -> DataFrame:
    """(days, pos_pred, tp) for every day from 0 to the greatest found, with 0 where there is none."""
    counts = _apart(df.filter(any_fires(rules)), c).groupBy("days").agg(F.count("*").alias("pos_pred"), F.count_if(truth(c.label)).alias("tp"))
    most = counts.agg(F.max("days").alias("most")).filter("most IS NOT NULL")
    spine = most.select(F.explode(F.sequence(F.lit(0), "most")).alias("days"))
    return spine.join(counts, "days", "left").fillna(0)


def savings_by_time(df: DataFrame, rules: Sequence[Rule], c: PairColumns = PairColumns()) -> DataFrame:
    """(kind, bin_days, n, mean_saving) of positives and of true positives: the smaller known amount of a pair, by bins of days."""
    saving = F.least(named(c.reimbursement), named(c.reimbursement + c.suffix)).cast("decimal(18,2)")
    near = _apart(df.filter(truth(c.label)), c).withColumn("saving", saving).filter("saving IS NOT NULL").withColumn("bin_days", (F.floor(F.col("days") / BIN_DAYS) * BIN_DAYS).cast("int"))
    kinds = F.when(any_fires(rules), F.array(F.lit("positives"), F.lit("true_positives"))).otherwise(F.array(F.lit("positives")))
    each = near.select("bin_days", "saving", F.explode(kinds).alias("kind"))
    return each.groupBy("kind", "bin_days").agg(F.count("*").alias("n"), (F.sum("saving").cast("double") / F.count("*")).alias("mean_saving"))


def precision_recall(steps: DataFrame, total_positives: int, optimum_step: int | None) -> DataFrame:
    """(m, precision, recall, pp, is_optimum) of each prefix."""
    return steps.select("m", ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.lit(total_positives)).alias("recall"), "pp", (F.col("m") == F.lit(-1 if optimum_step is None else optimum_step)).alias("is_optimum"))
