"""How components grow as rules are added: the merge tree of all prefixes of a composition.

An edge carries its first rule.  When rule m joins components, the dearest document of the
new one stays and the dearest of each other stops being one: that is one row, the merge of
that document at m.  A document saves its amount in every prefix from its merge on, so the
savings of a prefix are sums over the rows up to it, and nothing is repeated for later rules.

Merges at m depend on the components of the rules before m only, and those on a minimum
spanning forest.  Components of few edges are merged edge by edge in the order of rules,
each in one task (Kruskal's way).  The others are halved by rules, again and again: the
lower half's components are found, the upper half's edges are linked to them, and both
halves go on by themselves, all halves of a level in one run.  So an edge takes part once a
level, and there are as many levels as doublings of the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.operators.components import connected_components, dealt_join, hub_size
from pairsmith.sources import interim

#: Edges of a component that one task merges; greater ones are halved.
FEW_EDGES = 100_000
_MERGE = "m int, node string, cents long, paid boolean"


def _edge_by_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges of (component, m, a, b, cents and paid of both) in the order of component and m; holds one component at a time."""
    above: dict[str, str] = {}
    value: dict[str, tuple[int, bool]] = {}
    now, out = None, []

    def dearest(x: str) -> str:
        top = x
        while (up := above[top]) != top:
            top = up
        while (up := above[x]) != top:
            above[x], x = top, up
        return top

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["m", "node", "cents", "paid"])
        out.clear()
        return made

    for batch in batches:
        for component, m, a, b, a_cents, a_paid, b_cents, b_paid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != now:
                now = component
                above.clear()
                value.clear()
            for x, cents, paid in ((a, a_cents, a_paid), (b, b_cents, b_paid)):
                if x not in above:
                    above[x], value[x] = x, (cents, paid)
            a, b = dearest(a), dearest(b)
            if a != b:
                stays, goes = sorted((a, b), key=lambda x: (-value[x][0], x))
                above[goes] = stays
                out.append((m, goes, *value[goes]))
        yield rows()


def _few(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Merges within components of few edges.  edges: (component, m, a, b)."""
    for side in ("a", "b"):
        edges = edges.join(values.select(F.col("node").alias(side), F.col("cents").alias(f"{side}_cents"), F.col("paid").alias(f"{side}_paid")), side)
    rows = edges.select("component", "m", "a", "b", "a_cents", "a_paid", "b_cents", "b_paid")
    return rows.repartition("component").sortWithinPartitions("component", "m").mapInArrow(_edge_by_edge, _MERGE)


def _key(part: Column, node: str) -> Column:
    return F.concat_ws("~", F.lpad(part.cast("string"), 10, "0"), node)


def _labels(edges: DataFrame, part: Column) -> DataFrame:
    """(part, node, top): components within each part of the rules."""
    found = connected_components(edges.select(_key(part, "a").alias("a"), _key(part, "b").alias("b")))
    return found.select(F.substring("node", 1, 10).cast("long").alias("part"), F.substr("node", F.lit(12)).alias("node"), F.substr("component", F.lit(12)).alias("top"))


def _halved(edges: DataFrame, values: DataFrame, n_rules: int) -> DataFrame:
    """Merges within components of any size.  edges: (m, a, b)."""
    # the dearest document of what a node stands for
    elder = F.struct((-F.col("cents")).alias("minus"), F.col("node").alias("doc"), "paid")
    nodes = values.select(F.lit(0).cast("long").alias("part"), "node", elder.alias("elder"))
    size = 1 << max(0, n_rules - 1).bit_length()
    edges = edges.select("m", "a", "b")
    while size > 1:
        half, most = size // 2, hub_size(edges.count())
        part, upper = F.expr(f"cast(m AS long) div {size}"), F.expr(f"cast(m AS long) div {half}") % 2 == 1
        labels = interim.stored(_labels(edges.filter(~upper), part), "labels")
        linked = edges.filter(upper).withColumn("part", part)
        for side in ("a", "b"):
            looked = dealt_join(linked, labels.select("part", F.col("node").alias(side), "top"), ["part", side], most, "left")
            linked = looked.withColumn(side, F.coalesce("top", side)).drop("top")
        linked = linked.filter("a <> b").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "part").agg(F.min("m").alias("m"))
        tops = labels.join(nodes, ["part", "node"]).groupBy("part", F.col("top").alias("node")).agg(F.min("elder").alias("elder"))
        lower_nodes = nodes.select(F.col("part") * 2, "node", "elder").toDF("part", "node", "elder")
        alone = nodes.join(labels.select("part", "node"), ["part", "node"], "left_anti")
        upper_nodes = tops.unionByName(alone).select(F.col("part") * 2 + 1, "node", "elder").toDF("part", "node", "elder")
        edges = interim.stored(edges.filter(~upper).unionByName(linked.select("m", "a", "b")), "edges")
        ends = edges.select(F.expr(f"cast(m AS long) div {half}").alias("part"), F.explode(F.array("a", "b")).alias("node")).distinct()
        nodes = interim.stored(lower_nodes.unionByName(upper_nodes).join(ends, ["part", "node"], "left_semi"), "nodes")
        size = half
    members = _labels(edges, F.col("m").cast("long")).join(nodes, ["part", "node"])
    stays = members.groupBy("part", "top").agg(F.min("elder").alias("stays"))
    gone = members.join(stays, ["part", "top"]).filter(F.col("elder.doc") != F.col("stays.doc"))
    return gone.select(F.col("part").cast("int").alias("m"), F.col("elder.doc").alias("node"), (-F.col("elder.minus")).alias("cents"), "elder.paid")


def merges(edges: DataFrame, values: DataFrame, n_rules: int, few_edges: int = FEW_EDGES) -> DataFrame:
    """(m, node, cents, paid): each document that stops being the dearest of its component, and the first prefix in which it does.

    edges: (m, a, b) with the first rule of a pair of documents, no loops; values: (node,
    cents, paid) of every end.  On equal amounts the least node counts as the dearer.
    """

    def made() -> DataFrame:
        labels = connected_components(edges)
        most = hub_size(edges.count())
        placed = interim.stored(dealt_join(edges, labels.select(F.col("node").alias("a"), "component"), ["a"], most).select("component", "m", "a", "b"), "placed")
        many = placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > few_edges).select("component")
        if many.isEmpty():
            return _few(placed, values)
        # at most one for each ``few_edges`` edges
        few = placed.join(many, "component", "left_anti")
        rest = dealt_join(placed, many, ["component"], most)
        own = values.join(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        return _few(few, values).unionByName(_halved(interim.stored(rest, "rest"), interim.stored(own, "own"), n_rules))

    return interim.settled(edges.sparkSession, made, "merges")
