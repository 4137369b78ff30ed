"""A Merkle manifest of a dataset, with proofs as parent-preimage paths.

A leaf is the hash of a row.  Within a group of rows, leaves ascend by key, and every 16
consecutive nodes of a level become one node of the next: their hashes side by side are
its preimage, the preimage's hash is its own.  The groups' tops, in the order of groups,
make the dataset's tree in the same way.

The manifest stores preimages, one row for each parent, not proofs.  A path of preimages is
handed down from each parent to its children, so a join's key has 16 rows at most, however
large a group is.  A leaf's siblings at a level are its ancestor's preimage without its own
64 characters; folding puts the running hash in their place and hashes again.

Nulls hash as ``-``, any value as its length in bytes, a colon and itself, so null, empty
text and text that looks like either differ.  Null keys come first, null groups too.  Rows
of one key are ordered by their leaf; equal rows have equal leaves at neighbouring places
and proofs of their own.  A text of any length is hashed whole.  Columns that the manifest
does not name take no part.  An empty table has no nodes, no root and no proofs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.functions.predicates import named
from pairsmith.operators.ranks import segmented
from pairsmith.sources import interim

#: Nodes of one level that become one of the next, and characters of a hash.
FAN = 16
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<preimage:string,slot:int>>"


def hashed(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """One value of a leaf's input."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: Sequence[str] = COLUMNS, **changed: Column) -> Column:
    """The hash of a row's named columns, with some of them changed."""
    return hashed([field(changed.get(c, named(c))) for c in columns])


@dataclass(frozen=True)
class Manifest:
    """Leaves (row, leaf, tree, idx, n), and preimages (tree, level, idx, n, preimage, hash) of the groups' trees and of the dataset's.

    ``n`` is the number of nodes on the node's level of its tree: 1 at the top.
    """

    leaves: DataFrame
    groups: list[DataFrame]
    top: list[DataFrame]


def _tree(group: Column) -> Column:
    """A group as text that is never null and orders as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def _levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The parents of each level, stored; trees that have come to one node go no further."""
    out = []
    while largest > 1:
        child = F.struct("idx", "hash")
        children = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.max("n").alias("n"))
        parents = children.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), F.array_join(F.transform("children", lambda c: c["hash"]), "").alias("preimage"))
        nodes = interim.stored(parents.withColumn("hash", F.sha2("preimage", 256)), "preimages")
        out.append(nodes)
        largest = -(-largest // FAN)
    return out


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree's top."""
    out = leaves.filter("n = 1").select("tree", "hash")
    for nodes in levels:
        out = out.unionByName(nodes.filter("n = 1").select("tree", "hash"))
    return out


def build(rows: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf") -> Manifest:
    """The manifest of rows with their leaves; other columns of the rows travel along.

    Stored tables are the caller's to delete: run this within ``interim.settled``.
    """
    placed = rows.select(F.struct("*").alias("row"), named(key).alias("key"), _tree(named(group)).alias("tree"), named(leaf).alias("hash"))
    ranked = segmented(placed, ["tree"], [F.col("key"), F.col("hash")], rank="idx", size="n")
    leaves = interim.stored(ranked.select("row", "tree", "idx", "n", "hash"), "leaves")
    groups = _levels(leaves, _largest(leaves))
    tops = segmented(_tops(leaves, groups), [], [F.col("tree")], rank="idx", size="n")
    tops = interim.stored(tops.select(F.lit("").alias("tree"), "idx", "n", "hash", F.col("tree").alias("group")), "subroots")
    return Manifest(leaves, groups, [tops, *_levels(tops, _largest(tops))])


def _handed_down(nodes: DataFrame, parents: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The nodes that have a parent, with its path lengthened by its preimage and their own slot, and what it carries."""
    above = parents.select("tree", F.col("idx").alias("parent"), "preimage", F.col("path").alias("above"), *carried)
    below = nodes.withColumn("parent", F.expr(f"idx div {FAN}"))
    joined = below.join(above.withColumnRenamed("preimage", "over"), ["tree", "parent"])
    step = F.struct(F.col("over").alias("preimage"), (F.col("idx") % FAN).cast("int").alias("slot"))
    return joined.withColumn("path", F.concat(F.array(step), "above")).drop("over", "above", "parent")


def paths(manifest: Manifest) -> DataFrame:
    """(row, leaf, subroot, root, path): the ancestors' preimages from the parent up to the root, each with the place of the node below."""
    nothing = F.array().cast(_PATH)
    leaves, *levels = manifest.top
    above = None
    for nodes in [*levels[::-1], leaves]:  # from the root down to the groups' tops
        top = nodes.filter("n = 1").withColumns({"path": nothing, "root": F.col("hash")})
        above = top if above is None else top.unionByName(_handed_down(nodes.filter("n > 1"), above, ["root"]))
    tops = above.select(F.col("group").alias("tree"), "path", "root", F.col("hash").alias("subroot"))
    above = None
    for nodes in [*manifest.groups[::-1], manifest.leaves]:  # from the groups' tops down to the leaves
        top = nodes.filter("n = 1").join(tops, "tree")
        above = top if above is None else top.unionByName(_handed_down(nodes.filter("n > 1"), above, ["root", "subroot"]))
    return above.select("row", F.col("hash").alias("leaf"), "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """All siblings' hashes side by side, level by level from the leaf up, each level left to right."""
    own = lambda p: F.concat(F.substring(p["preimage"], F.lit(1), HEX * p["slot"]), F.substr(p["preimage"], HEX * (p["slot"] + 1) + 1))
    return F.array_join(F.transform(path, own), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.overlay(p["preimage"], h, HEX * p["slot"] + 1), 256))


def proofs(manifest: Manifest, changed: Column | None = None) -> DataFrame:
    """(row, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``changed``, over the columns of ``row``, is a leaf as recomputed from data that may
    have been tampered with; where it is null, the manifest's own is folded.
    """
    found = paths(manifest)
    now = F.col("leaf") if changed is None else F.coalesce(changed, F.col("leaf"))
    out = found.select("row", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(now, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_tampering(df: DataFrame, every: int = 5) -> DataFrame:
    """Proofs of all rows; of the keys whose crc32 is divisible by ``every`` the recomputed leaf has text in lower case."""
    spark: SparkSession = df.sparkSession
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def made() -> DataFrame:
        tampered = F.crc32(named("doc_id").cast("string")) % every == 0
        rows = df.select(named("doc_id").alias("doc_id"), named("source").alias("source"), leaf().alias("leaf"), F.when(tampered, leaf(text=F.translate(named("text"), upper, upper.lower()))).alias("changed"))
        manifest = build(interim.stored(rows, "leaves"))
        return proofs(manifest, F.col("row.changed")).select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    return interim.settled(spark, made, "proofs")
