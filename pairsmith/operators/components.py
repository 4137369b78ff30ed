"""Connected components of an edge table.

Every task first contracts the edges that it holds to stars.  Then rounds of large-star and
small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014):
every node hands its neighbours to the least node it knows, until each component is a star
around its least member, which one more aggregation sees.  Every round is two
map-side-combined aggregations and two joins, written to the shared folder, so lineage stays
short and long chains take logarithmically many rounds.

A node of very many neighbours is split: its least neighbour is found in two levels, within
tasks and over them, and handed to sub-hubs, each of which has a share of its edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.sources import interim

#: A node with more than this share of all edges is split, and none with fewer edges than the other number.
PARTS = 512
LEAST_HUB = 50_000
#: Edges that a task contracts at a time.
_AT_ONCE = 500_000


def hub_size(n_rows: int) -> int:
    """Rows of one key that may meet in a task; at most ``PARTS`` keys of a table have more."""
    return max(LEAST_HUB, n_rows // PARTS)


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """A join with a table of unique keys in which the left rows of a heavy key are dealt over several tasks.

    sizes: (keys, n), how many left rows there are of each key, if that is known already.
    The heavy keys are few, as ``hub_size`` bounds them, so they are broadcast.
    """
    keys = list(keys)
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes
    heavy = F.broadcast(sizes.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("splits")))
    others = [c for c in left.columns if c not in keys]
    splits = F.coalesce("splits", F.lit(1))
    dealt = left.join(heavy, keys, "left").select(*left.columns, F.when(splits > 1, F.pmod(F.hash(*(others or keys)), splits)).otherwise(0).alias("salt"))
    spread = right.join(heavy, keys, "left").select(*right.columns, F.explode(F.sequence(F.lit(0), splits - 1)).alias("salt"))
    return dealt.join(spread, [*keys, "salt"], how).drop("salt")


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Link each node's neighbours (large: greater ones; small: the others and itself) to the least of them and it."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = known.select("a", F.least("a", "m").alias("m") if large else "m")
    joined = dealt_join(edges, least, ["a"], most, sizes=known.select("a", "n"))
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    linked = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars around the least nodes of the components of some edges at a time."""
    above: dict = {}

    def root(x):
        top = x
        while (up := above[top]) != top:
            top = up
        while (up := above[x]) != top:
            above[x], x = top, up
        return top

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        nodes = [x for x, up in above.items() if x != up]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(1).type)], names=["a", "b"])
        above.clear()
        return out

    schema, n = None, 0
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= _AT_ONCE:
            yield stars(schema)
            n = 0
    if schema is not None:
        yield stars(schema)


def _all_stars(edges: DataFrame) -> bool:
    """Every node is the lesser end of its edges, or the greater end of only one: then all components are stars around their least nodes."""
    ends = edges.select("a", F.lit(1).alias("greater")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("greater")))
    each = ends.groupBy("a").agg(F.sum("greater").alias("greater"), F.count("*").alias("n"))
    return each.filter((F.col("greater") > 0) & (F.col("n") > 1)).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Self-loops add no node of their own; rows with a null end are ignored.
    """
    return interim.settled(edges.sparkSession, lambda: _rounds(edges, a, b, max_rounds), "component-labels")


def _rounds(edges: DataFrame, a: str, b: str, max_rounds: int) -> DataFrame:
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().filter(F.col("a") != F.col("b"))
    now = interim.stored(_tidy(both.mapInArrow(_contracted, both.schema)), "components")
    for _ in range(max_rounds):
        if _all_stars(now):
            break
        most = hub_size(now.count())
        now = interim.stored(_tidy(_stars(_tidy(_stars(now, True, most)), False, most)), "components")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
