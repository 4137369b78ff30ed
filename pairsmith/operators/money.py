"""Evaluation in money: documents of found pairs form components, of each component all but the dearest are saved.

Sums are taken in decimals of two places, so they do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.config import PairColumns
from pairsmith.functions.predicates import Rule, any_fires, first_hit, named, truth
from pairsmith.operators.components import connected_components, dealt_join, hub_size
from pairsmith.operators.merges import merges
from pairsmith.operators.ranks import segmented
from pairsmith.sources import interim


def node(columns: Sequence[str]) -> Column:
    """The key of a document as one string: its parts joined by bars, with bars and backslashes in them escaped and null as \\N."""
    bar, slash = F.lit("|"), F.lit("\\")
    parts = (F.replace(F.replace(named(c).cast("string"), slash, F.lit("\\\\")), bar, F.lit("\\|")) for c in columns)
    return F.concat_ws("|", *(F.coalesce(p, F.lit("\\N")) for p in parts))


def money(c: Column) -> Column:
    return F.coalesce(c.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def flagged_documents(df: DataFrame, rules: Sequence[Rule], c: PairColumns = PairColumns()) -> DataFrame:
    """Distinct documents on either side of a pair that the composition finds."""
    found = df.filter(any_fires(rules))
    left = found.select(*map(named, c.key))
    right = found.select(*(named(k2).alias(k) for k, k2 in zip(c.key, c.key_2, strict=True)))
    return left.union(right).distinct()


def enriched(documents: DataFrame, dimension: DataFrame, c: PairColumns = PairColumns()) -> DataFrame:
    """The documents with their amount from a dimension; several rows of one document count as their greatest."""
    wanted = dimension.join(documents, list(c.key), "left_semi")
    amounts = wanted.groupBy(*c.key).agg(F.max(c.reimbursement).alias(c.reimbursement))
    return documents.join(amounts, list(c.key), "left")


def join_money(pairs: DataFrame, amounts: DataFrame, c: PairColumns = PairColumns()) -> DataFrame:
    """The pairs with the amounts of both documents; an amount is null where the dimension has none."""
    bare = pairs.drop(c.reimbursement, c.reimbursement + c.suffix)
    once = amounts.groupBy(*c.key).agg(F.max(c.reimbursement).alias(c.reimbursement))
    right = once.select(*(named(k).alias(k2) for k, k2 in zip(c.key, c.key_2, strict=True)), named(c.reimbursement).alias(c.reimbursement + c.suffix))
    return bare.join(once, list(c.key), "left").join(right, list(c.key_2), "left")


def document_values(pairs: DataFrame, c: PairColumns = PairColumns(), nodes: DataFrame | None = None) -> DataFrame:
    """(node, reimbursement, paid_out) of the documents of both sides, or of the given nodes: greatest amount (0 if unknown), paid if any row says so."""
    sides = [pairs.select(node(k).alias("node"), money(named(c.reimbursement + s)).alias("r"), truth(c.paid_out + s).alias("p")) for k, s in ((c.key, ""), (c.key_2, c.suffix))]
    # one row for each document before the join, which sorts
    each = sides[0].union(sides[1]).groupBy("node").agg(F.max("r").cast("double").alias("reimbursement"), F.bool_or("p").alias("paid_out"))
    return each if nodes is None else each.join(nodes, "node", "left_semi")


def component_labels(pairs: DataFrame, c: PairColumns = PairColumns()) -> DataFrame:
    """(node, component) of the documents that the pairs connect; the component is its least document."""
    return connected_components(pairs.select(node(c.key).alias("a"), node(c.key_2).alias("b")))


def _savings(labels: DataFrame, values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Savings of all components: every document but the dearest (least key on a tie), and of those the paid ones."""
    joined = labels.join(values, "node", "left").select(*by, "component", "node", money(F.col("reimbursement")).alias("r"), F.coalesce("paid_out", F.lit(False)).alias("p"))
    # the dearest document of each component, as one row; the rest is a difference of sums
    top = joined.groupBy(*by, "component").agg(F.sum("r").alias("s"), F.sum(F.when(F.col("p"), F.col("r")).otherwise(0)).alias("paid"), F.max("r").alias("most"))
    ties = joined.join(top.select(*by, "component", F.col("most").alias("r")), [*by, "component", "r"]).groupBy(*by, "component").agg(F.min_by("p", "node").alias("top_paid"))
    each = top.join(ties, [*by, "component"]).select(*by, (F.col("s") - F.col("most")).alias("total"), (F.col("paid") - F.when(F.col("top_paid"), F.col("most")).otherwise(0)).alias("paid"))
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(f"savings_{x}") for x in ("total", "paid")]
    return each.groupBy(*by).agg(*sums) if by else each.agg(*sums)


def component_savings(pairs: DataFrame, values: DataFrame, c: PairColumns = PairColumns()) -> DataFrame:
    """One row (savings_total, savings_paid) over the components of the pairs; 0 for no pairs, unknown documents count 0."""
    return _savings(component_labels(pairs, c), values)


def component_members(pairs: DataFrame, values: DataFrame, c: PairColumns = PairColumns()) -> DataFrame:
    """(component, place, node, reimbursement, paid_out, n_docs, savings_total, savings_paid): the documents of each component from the dearest (place 0) down.

    The savings are running totals without the first document, so the last row has those of
    the component.  One row for each document: a component may have any number of them.
    """

    def made() -> DataFrame:
        joined = component_labels(pairs, c).join(values, "node", "left").select("component", "node", F.coalesce("reimbursement", F.lit(0.0)).alias("reimbursement"), F.coalesce("paid_out", F.lit(False)).alias("paid_out"))
        amount = money(F.col("reimbursement"))
        settled = F.when(F.col("paid_out"), amount).otherwise(money(F.lit(0)))
        # the first document's own amounts are in the running totals; every row subtracts its component's
        ranked = interim.stored(segmented(joined, ["component"], [-F.col("reimbursement"), F.col("node")], {"total": amount, "settled": settled}, rank="place", size="n_docs"), "members")
        first = ranked.filter("place = 0").select("component", F.col("total").alias("first_total"), F.col("settled").alias("first_settled"))
        out = dealt_join(ranked, first, ["component"], hub_size(ranked.count()))
        less = lambda x: (F.col(x) - F.col(f"first_{x}")).cast("double")
        return out.select("component", "place", "node", "reimbursement", "paid_out", "n_docs", less("total").alias("savings_total"), less("settled").alias("savings_paid"))

    return interim.settled(pairs.sparkSession, made, "component-members")


def component_table(pairs: DataFrame, values: DataFrame, c: PairColumns = PairColumns(), page: int = 10_000) -> DataFrame:
    """For each component its documents from the dearest down, with amounts, paid flags and the sums without the first.

    A component of more than ``page`` documents has a row for each so many, in the order of
    ``page``; the sums are those of the documents up to the row's last.
    """
    members = component_members(pairs, values, c)
    docs = F.sort_array(F.collect_list(F.struct("place", "node", "reimbursement", "paid_out", "savings_total", "savings_paid")))
    out = members.groupBy("component", "n_docs", F.expr(f"place div {page}").alias("page")).agg(docs.alias("docs"))
    part = lambda x: F.transform("docs", lambda d: d[x])
    last = lambda x: F.element_at("docs", -1)[x].alias(x)
    return out.select("component", "page", "n_docs", part("node").alias("nodes"), part("reimbursement").alias("reimbursements"), part("paid_out").alias("paid_flags"), last("savings_total"), last("savings_paid"))


def composition_steps(df: DataFrame, rules: Sequence[Rule], label: str = "label") -> DataFrame:
    """(m, pp, tp) of each prefix of the composition: one count by first rule, then running sums over the few rules."""
    return _steps(df.select(first_hit(rules).alias("m"), truth(label).alias("y")), len(rules))


def _steps(hits: DataFrame, n_rules: int) -> DataFrame:
    """hits: (m, y) of every pair."""
    counts = hits.filter("m >= 0").groupBy("m").agg(F.count("*").alias("n"), F.count_if("y").alias("t"))
    spine = hits.sparkSession.range(n_rules).select(F.col("id").cast("int").alias("m"))
    w = Window.partitionBy(F.lit(0)).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(F.broadcast(counts), "m", "left").fillna(0).select("m", F.sum("n").over(w).alias("pp"), F.sum("t").over(w).alias("tp"))


def stepwise_net_value(df: DataFrame, rules: Sequence[Rule], review_cost: float, c: PairColumns = PairColumns()) -> DataFrame:
    """(m, pp, tp, savings_total, savings_paid, nv_total, nv_paid) of each prefix.

    The pairs are read once.  Only true pairs that a rule finds are edges, each pair of
    documents once, with its first rule; values are looked up for their documents only.
    Each merge of components is one row with its rule, so the savings of all prefixes are
    running sums over as many rows as there are documents at most, however many rules.
    """

    def made() -> DataFrame:
        sides = [F.struct(money(named(c.reimbursement + s)).alias("r"), truth(c.paid_out + s).alias("p")).alias(v) for v, s in (("va", ""), ("vb", c.suffix))]
        pairs = df.select(first_hit(rules).alias("m"), truth(c.label).alias("y"), node(c.key).alias("a"), node(c.key_2).alias("b"), *sides)
        pairs = interim.stored(pairs, "pairs")
        edges = pairs.filter("m >= 0 AND y AND a <> b").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.min("m").alias("m"))
        edges = interim.stored(edges.select("m", "a", "b"), "first-edges")
        found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "va"), F.struct(F.col("b").alias("node"), F.col("vb").alias("va")))).alias("x")).select("x.node", "x.va.*")
        # a document is in many pairs: it is one row, summed up within the tasks that read them, before anything is sorted
        each = both.groupBy("node").agg((F.max("r") * 100).cast("long").alias("cents"), F.bool_or("p").alias("paid"))
        merged = merges(edges, interim.stored(each.join(found, "node", "left_semi"), "values"), len(rules))
        saved = merged.groupBy("m").agg(F.sum("cents").alias("total"), F.sum(F.when(F.col("paid"), F.col("cents")).otherwise(0)).alias("settled"))
        w = Window.partitionBy(F.lit(0)).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
        money_of = lambda x: (F.sum(F.coalesce(x, F.lit(0))).over(w).cast("decimal(20,0)") / 100).cast("double")
        # one row for each rule
        out = _steps(pairs, len(rules)).join(F.broadcast(saved), "m", "left").select("m", "pp", "tp", money_of("total").alias("savings_total"), money_of("settled").alias("savings_paid"))
        return out.withColumns({f"nv_{x}": F.col(f"savings_{x}") - F.col("pp") * F.lit(float(review_cost)) for x in ("total", "paid")})

    return interim.settled(df.sparkSession, made, "steps")


def optimum(steps: DataFrame) -> DataFrame:
    """The step of the greatest net value, the first on a tie; no row for no steps."""
    return steps.orderBy(F.desc("nv_total"), "m").limit(1)
