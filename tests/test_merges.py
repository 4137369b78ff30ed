"""Merge trees of prefixes, split hubs, and ranks over range partitions, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairsmith.operators import components as C
from pairsmith.operators import merges as M
from pairsmith.operators import money
from pairsmith.operators.ranks import segmented

from .test_money import pair_table


def plain_components(edges):
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {x: root(x) for x in top}


def plain_merges(edges, cents, n_rules):
    """For each prefix anew: who is not the dearest of its component, and since when."""
    since = {}
    for m in range(n_rules):
        groups = defaultdict(list)
        for x, top in plain_components([e[1:] for e in edges if e[0] <= m]).items():
            groups[top].append(x)
        for own in groups.values():
            stays = min(own, key=lambda x: (-cents[x], x))
            since |= {x: since.get(x, m) for x in own if x != stays}
    return since


@pytest.mark.parametrize(("n_rules", "few"), [(1, 0), (5, 0), (5, 12)])
def test_merges(spark, n_rules, few):
    rng = random.Random(n_rules)
    names = [f"d{i}" for i in range(60)]
    edges = {tuple(sorted(rng.sample(names[:40], 2))) for _ in range(34)} | {tuple(sorted(rng.sample(names[40:], 2))) for _ in range(15)}
    edges = [(rng.randrange(n_rules), *e) for e in sorted(edges)] + [(rng.randrange(n_rules), f"e{i}", f"e{i + 1}") for i in range(10, 40)]
    cents = {x: rng.choice([0, 5, 700, 700, 800]) for _, a, b in edges for x in (a, b)}
    values = spark.createDataFrame([(x, v, v == 700) for x, v in cents.items()], "node string, cents long, paid boolean")
    df = spark.createDataFrame(edges, "m int, a string, b string").repartition(3)
    found = M.merges(df, values, n_rules, few_edges=few).collect()
    assert {r.node: r.m for r in found} == plain_merges(edges, cents, n_rules) and len(found) == len({r.node for r in found})
    assert all((r.cents, r.paid) == (cents[r.node], cents[r.node] == 700) for r in found)


def test_no_merges(spark):
    values = spark.createDataFrame([], "node string, cents long, paid boolean")
    assert M.merges(spark.createDataFrame([], "m int, a string, b string"), values, 3).count() == 0


def test_components_after_contraction(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)]
    expected = {x: top for x, top in plain_components(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    for at_once in (1, C._AT_ONCE):
        monkeypatch.setattr(C, "_AT_ONCE", at_once)
        found = C.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5))
        assert {r.node: r.component for r in found.collect()} == expected


def test_a_hub_is_dealt_over_tasks(spark):
    """Of a node with 40,000 neighbours no task gets more than twice the median."""
    hub = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    least = spark.createDataFrame([(0, 7)], "a long, m long")
    # without handling at run time, so that the plan is what counts
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = C.dealt_join(hub, least, ["a"], 40_000 // 512)
        each = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("part")).count().collect())
        assert sum(each) == 40_000 and len(each) == 8 and each[-1] < 2 * each[4]
        star = hub.select(F.col("b").alias("a"), F.col("a").alias("b"))
        assert C._tidy(C._stars(star, True, 100)).groupBy("b").count().collect() == [(0, 40_000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dealt_joins_are_joins(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine")], "k long, name string")
    for how in ("inner", "left"):
        rows = lambda df: Counter(tuple(r) for r in df.select("k", "v", "name").collect())
        assert rows(C.dealt_join(left, right, ["k"], 7, how)) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("by", [["g", "h"], ["g"], []])
def test_segmented_ranks(spark, by):
    rng = random.Random(len(by))
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2]), i, rng.randint(-5, 5)) for i in range(400)] + [("one", 1, 999, 3)]
    df = spark.createDataFrame(rows, "g string, h int, k int, v int").repartition(6)
    found = {r.k: (r.rank, r.size, r.run) for r in segmented(df, by, [-F.col("k")], {"run": F.col("v")}).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: -r[2]):
        groups[tuple(dict(zip("gh", r[:2]))[x] for x in by)].append(r)
    assert found == {r[2]: (i, len(own), sum(x[3] for x in own[: i + 1])) for own in groups.values() for i, r in enumerate(own)}
    assert segmented(df.limit(0), by, [F.col("k")]).count() == 0


def test_members_of_a_large_component_are_one_row_each(spark):
    n = 3000
    edges = [(f"{0:05}", f"{i:05}") for i in range(1, n)]
    amounts = {f"{i:05}": float(i % 100) for i in range(n)}
    df, _ = pair_table(spark, edges, amounts, {x: v > 50 for x, v in amounts.items()})
    values = money.document_values(df)
    found = money.component_members(df, values).orderBy("place").collect()
    order = sorted(amounts, key=lambda x: (-amounts[x], x))
    assert [r.node for r in found] == [f"s|{x}|1" for x in order] and [r.place for r in found] == list(range(n))
    assert (found[-1].savings_total, found[-1].savings_paid) == (sum(amounts.values()) - 99, sum(v for v in amounts.values() if v > 50) - 99)
    pages = money.component_table(df, values, page=1000).orderBy("page").collect()
    assert [len(r.nodes) for r in pages] == [1000] * 3 and sum((r.nodes for r in pages), []) == [r.node for r in found]
    assert {r.n_docs for r in pages} == {n} and pages[-1].savings_total == found[-1].savings_total
