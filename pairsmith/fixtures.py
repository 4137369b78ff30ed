"""A pair table derived from TPC-H-like tables: documents are orders, pairs two orders of one customer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.config import Config, Filters, Learning  # noqa: F401
from pairsmith.functions import predicates as P

PREDICATES = {
    "calculate_equality": ["status", "priority", "month"],
    "calculate_lev_dist": {"date": [{"thresh": 1}, {"thresh": 2}]},
    "calculate_proportion": {"price": [{"thresh": 0.95}, {"thresh": 0.8}]},
    "calculate_overlap": {"brands": [{"thresh": 0.5}, {"thresh": 0}]},
}
GROUPS = P.build_groups(PREDICATES)
NAMES = [p for _, names in GROUPS for p in names]
RULES: list[P.Rule] = [
    ("eq_status", "prop_0.95_price"),
    ("eq_priority", "dist_1_date"),
    ("dist_2_date", "prop_0.8_price"),
    ("eq_month", "overlap_0.5_brands"),
    ("eq_status", "eq_priority"),
]
CONFIG = Config(
    predicates=PREDICATES,
    filters=Filters("3", "4-NOT SPECIFIED", datetime(1997, 1, 1), datetime(1999, 1, 1), (datetime(1998, 11, 1), datetime(1998, 12, 1), datetime(1996, 11, 1), datetime(1998, 12, 1)), datetime(1998, 10, 1)),
    learning=Learning(2, 1000, 0.99, 5),
    min_reimbursement_threshold=1000.0,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    brands = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brands"))
    return o.join(brands, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("agreement_id"),
        F.year("o_orderdate").cast("string").alias("stack_id"),
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.lit("1").alias("sub_doc_id"),
        F.col("o_orderpriority").alias("lar"),
        F.col("o_orderdate").alias("import_time"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_str"),
        F.month("o_orderdate").alias("month"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("reimbursement"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("paid_out"),
        "brands",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents of one agreement, with predicates and a three-valued label."""
    d = documents(spark, sf_dir)
    both = d.join(d.select(*(F.col(c).alias(f"{c}_2") for c in d.columns)), (F.col("agreement_id") == F.col("agreement_id_2")) & (F.col("k") > F.col("k_2")))
    side = lambda c: (F.col(c), F.col(f"{c}_2"))
    values = {
        "eq_status": F.when((F.col("k") % 17 != 0) & (F.col("k_2") % 17 != 0), P.equality(*side("status"))),
        "eq_priority": P.equality(*side("lar")),
        "eq_month": P.equality(*side("month")),
        "dist_1_date": P.distance_within(*side("date_str"), 1),
        "dist_2_date": P.distance_within(*side("date_str"), 2),
        "prop_0.95_price": P.proportion_at_least(*side("price"), 0.95),
        "prop_0.8_price": P.proportion_at_least(*side("price"), 0.8),
        "overlap_0.5_brands": P.overlap_at_least(*side("brands"), 0.5),
        "overlap_0_brands": P.overlap_at_least(*side("brands"), 0),
    }
    assert list(values) == NAMES
    out = both.select("k", "k_2", "agreement_id", *(c + s for c in ("stack_id", "doc_id", "sub_doc_id", "lar", "import_time", "reimbursement", "paid_out") for s in ("", "_2")), ((F.col("k") + F.col("k_2")) % 13 == 0).alias("legacy_rule"), *(v.alias(n) for n, v in values.items()))
    score = sum((P.truth(n).cast("int") for n in ("eq_status", "eq_priority", "prop_0.8_price", "dist_2_date")), F.lit(0))
    h = (F.col("k") * 7 + F.col("k_2") * 13) % 10
    return out.withColumn("label", F.when(h >= 5, F.when(score >= 2, h != 9).otherwise(h == 8)))
