"""Components, savings, net value, filters and estimates on small tables."""

import random
from datetime import datetime

import pytest

from pairsmith import fixtures as X
from pairsmith.config import Config, Filters, Learning
from pairsmith.operators import money, sampling, strata
from pairsmith.operators.components import connected_components
from pairsmith.plans import pipeline
from pairsmith.sources import interim
from pairsmith.sources import pairs as S


def pair_table(spark, edges, amounts, paid, masks=None, labels=None):
    names = [f"r{i}" for i in range(len(masks or []))]
    rows = []
    for k, (a, b) in enumerate(edges):
        rows.append(("s", a, "1", "s", b, "1", amounts.get(a), amounts.get(b), paid.get(a), paid.get(b), labels is None or labels[k] == "1", *(m[k] == "1" for m in masks or [])))
    schema = "stack_id string, doc_id string, sub_doc_id string, stack_id_2 string, doc_id_2 string, sub_doc_id_2 string, reimbursement double, reimbursement_2 double, paid_out boolean, paid_out_2 boolean, label boolean"
    return spark.createDataFrame(rows, schema + "".join(f", {n} boolean" for n in names)), [(n,) for n in names]


def plain_savings(edges, amounts, paid):
    """Components by flooding; all but the dearest document of each are saved, the least key staying on a tie."""
    left, total, settled = {x for e in edges for x in e}, 0.0, 0.0
    while left:
        own = {min(left)}
        while more := {y for e in edges for y in e if set(e) & own} - own:
            own |= more
        left -= own
        top = min(own, key=lambda x: (-(amounts.get(x) or 0.0), x))
        total += sum(amounts.get(x) or 0.0 for x in own - {top})
        settled += sum(amounts.get(x) or 0.0 for x in own - {top} if paid.get(x))
    return total, settled


def random_graph(rng, n):
    names = "abcdefghijkl"[:n]
    edges = [tuple(rng.choices(names, k=2)) for _ in range(rng.randint(1, n))]
    return edges, {x: rng.choice([None, 10.0, 20.0, 35.5]) for x in names}, {x: rng.choice([True, False, None]) for x in names}


@pytest.mark.parametrize("seed", range(4))
def test_component_savings(spark, seed):
    edges, amounts, paid = random_graph(random.Random(seed), 12)
    df, _ = pair_table(spark, edges, amounts, paid)
    row = money.component_savings(df, money.document_values(df)).first()
    assert (row.savings_total, row.savings_paid) == plain_savings(edges, amounts, paid)


def test_no_pairs_save_nothing(spark):
    df, _ = pair_table(spark, [], {}, {})
    row = money.component_savings(df, money.document_values(df)).first()
    assert (row.savings_total, row.savings_paid) == (0, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_stepwise_net_value(spark, seed):
    """Each prefix of three random rules against flooding over the true pairs that it finds."""
    rng = random.Random(seed)
    edges, amounts, paid = random_graph(rng, 10)
    masks = ["".join(rng.choice("001") for _ in edges) for _ in range(3)]
    labels = "".join(rng.choice("011") for _ in edges)
    df, rules = pair_table(spark, edges, amounts, paid, masks, labels)
    expected = []
    for m in range(3):
        found = [k for k in range(len(edges)) if any(mask[k] == "1" for mask in masks[: m + 1])]
        true = [edges[k] for k in found if labels[k] == "1"]
        total, settled = plain_savings(true, amounts, paid)
        expected.append((len(found), len(true), total, settled, total - 3.0 * len(found), settled - 3.0 * len(found)))
    rows = money.stepwise_net_value(df, rules, 3.0).orderBy("m").collect()
    assert [(r.pp, r.tp, r.savings_total, r.savings_paid, r.nv_total, r.nv_paid) for r in rows] == expected


def test_a_document_of_many_pairs_is_one_row_before_anything_is_sorted(spark, monkeypatch):
    """The join with the documents of true pairs stands above the sums, so its sort has documents and not sides of pairs."""
    edges = [("hub", f"d{i}") for i in range(40)]
    df, rules = pair_table(spark, edges, {"hub": 9.0, "d1": 2.0}, {"d1": True}, ["1" * 40], "1" * 20 + "0" * 20)
    plans, stored = {}, money.interim.stored
    monkeypatch.setattr(money.interim, "stored", lambda x, name: plans.setdefault(name, x._jdf.queryExecution().optimizedPlan().toString()) and stored(x, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        row = money.stepwise_net_value(df, rules, 1.0).first()
        nodes = df.select(money.node(["stack_id", "doc_id_2", "sub_doc_id"]).alias("node")).distinct()
        looked = money.document_values(df, nodes=nodes)
        plans["looked"] = looked._jdf.queryExecution().optimizedPlan().toString()
        assert {r.node: r.reimbursement for r in looked.collect()} == {f"s|d{i}|1": 2.0 if i == 1 else 0.0 for i in range(40)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (row.pp, row.tp, row.savings_total, row.savings_paid) == (40, 20, 2.0, 2.0)
    assert all(plans[x].startswith("Join LeftSemi") for x in ("values", "looked"))


def test_keys_with_nulls_and_bars_are_documents_of_their_own(spark):
    keys = [("a", None, "b"), ("a", "b", None), ("a|b", "c", "d"), ("a", "b|c", "d"), ("a", "\\N", "b"), ("a\\", "|b", "c"), ("a", "\\|b", "c"), ("s", "k", "1")]
    df = spark.createDataFrame(keys, "stack_id string, doc_id string, sub_doc_id string")
    nodes = [r.n for r in df.select(money.node(["stack_id", "doc_id", "sub_doc_id"]).alias("n")).collect()]
    assert len(set(nodes)) == len(keys) and nodes[-1] == "s|k|1"
    pairs = [(*a, *b, 1.0, 2.0, True, True, True) for a, b in zip(keys[::2], keys[1::2], strict=True)]
    table = spark.createDataFrame(pairs, "stack_id string, doc_id string, sub_doc_id string, stack_id_2 string, doc_id_2 string, sub_doc_id_2 string, reimbursement double, reimbursement_2 double, paid_out boolean, paid_out_2 boolean, label boolean")
    assert money.component_labels(table).select("component").distinct().count() == 4
    row = money.component_savings(table, money.document_values(table)).first()
    assert (row.savings_total, row.savings_paid) == (4.0, 4.0)


def test_document_values(spark):
    df, _ = pair_table(spark, [("a", "b"), ("b", "c")], {"a": 5.0, "c": 7.0}, {"a": True})
    assert {(r.node, r.reimbursement, r.paid_out) for r in money.document_values(df).collect()} == {("s|a|1", 5.0, True), ("s|b|1", 0.0, False), ("s|c|1", 7.0, False)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[1000 + i] for i in range(300)} == {1000} and len(found) == 501


@pytest.mark.parametrize(("amounts", "threshold", "kept"), [((5.0, None), 10, False), ((50.0, None), 10, True), ((None, None), 10, True), ((5.0, 50.0), 10, False), ((5.0, 5.0), 0, True), ((5.0, 5.0), None, True)])
def test_min_reimbursement(spark, amounts, threshold, kept):
    df = spark.createDataFrame([amounts], "reimbursement double, reimbursement_2 double")
    assert (df.filter(S.min_reimbursement_filter(threshold)).count() == 1) is kept


def test_nowhere_labelled(spark):
    values = [True, False, None]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    assert {(r.a, r.b) for r in df.filter(S.nowhere_labelled(["a", "b"])).collect()} == {(True, None), (None, True), (None, None)}


def test_base_filter(spark):
    rows = [("1", "1", False), ("3a", "3b", False), ("3a", "1", False), ("141", "1", False), ("1", "141", False), (None, "1", False), ("1", "1", True)]
    df = spark.createDataFrame(rows, "lar string, lar_2 string, legacy_rule boolean")
    assert [tuple(r) for r in df.filter(S.base_filter(Filters())).collect()] == [("1", "1", False), ("3a", "1", False), ("1", "141", False)]


def test_sampling_step():
    assert sampling.sampling_step(100, 50, 2000, 0.1) == 2
    assert sampling.sampling_step(10, 500, 100, 0.5) is None
    assert sampling.sampling_step(1000, 0, 10, 0.1) == 1


def test_mining_deals_out_only_what_it_reads(spark, sf, monkeypatch):
    """Tables of rows in order hold keys, label and predicates once, and no hash of them."""
    tables, stored = [], interim.stored
    monkeypatch.setattr(interim, "stored", lambda x, name: (tables.append(x) if name == "row-index" else None) or stored(x, name))
    config = Config(predicates=X.PREDICATES, filters=X.CONFIG.filters, learning=Learning(2, 50, 0.9, 5), positive_rate=0.25, test_split=0.2)
    result = pipeline.mine(X.pairs(spark, sf), config)
    assert result.metrics["train_pair_count"] > 0 and len(tables) == 2
    for t in tables:
        assert len(t.columns) == len(X.NAMES) + 4 and {kind for _, kind in t.dtypes} == {"bigint", "boolean", "int"}


def test_row_index_and_split(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(500)], "k long, label boolean").repartition(7)
    assert [r.row_index for r in sampling.with_row_index(df, ["k"]).orderBy("k").collect()] == list(range(500))
    split = sampling.train_test_split(df, ["k"], 0.2)
    assert {(r.label, r.is_train): r["count"] for r in split.groupBy("label", "is_train").count().collect()} == {(True, True): 80, (True, False): 20, (False, True): 320, (False, False): 80}


def test_allocation_and_sample(spark):
    df = spark.createDataFrame([(i, 0 if i < 900 else 1 if i < 999 else 2) for i in range(1000)] + [(2000, -1)], "k long, stratum_k int")
    assert {r.stratum_k: r.n_sample for r in sampling.allocation(df, 50).collect()} == {0: 45, 1: 5, 2: 1}
    sample = sampling.stratified_sample(df, ["k"], 50)
    assert {r.stratum_k: r["count"] for r in sample.groupBy("stratum_k").count().collect()} == {0: 45, 1: 5, 2: 1}
    assert sorted(r.k for r in sample.collect()) == sorted(r.k for r in sampling.stratified_sample(df.repartition(5), ["k"], 50).collect())


def test_estimates_without_evidence(spark):
    df = spark.createDataFrame([(0, None), (0, None), (1, True), (1, False), (1, True), (2, True)], "stratum_k int, label boolean")
    found = strata.stratum_precision(df, 4)
    rows = {r.stratum_k: r for r in found.collect()}
    assert rows[0].p_hat is None and rows[1].p_hat == pytest.approx(2 / 3) and rows[2].se == 0 and rows[3].n_total == 0
    curve = strata.cumulative_precision(found).orderBy("m").collect()
    assert (curve[0].n_1_to_m, curve[0].p_strat) == (0, None)
    assert (curve[1].n_1_to_m, curve[1].p_strat) == (5, pytest.approx(2 / 3))
    assert curve[2].p_strat == pytest.approx((3 * 2 / 3 + 1) / 4)
    lab = strata.labelled_cumulative(df.filter("stratum_k = 2"), 4)
    both = strata.combined_precision(lab, strata.cumulative_precision(found)).orderBy("m").collect()
    assert both[0].p_combined is None and not both[0].has_historic_evidence
    assert both[1].p_combined is None and both[1].has_historic_evidence
    assert both[3].p_combined == pytest.approx((1 + 6 * 0.75) / 7)


def test_config_is_checked():
    with pytest.raises(ValueError):
        Config(positive_rate=0.0)
    with pytest.raises(ValueError):
        Config(test_split=1.0)
    with pytest.raises(ValueError):
        Config(learning=Learning(max_predicates_per_rule=0))
    assert Filters(train_start=datetime(2020, 1, 1)).train_end is None


def test_a_database_gives_back_what_it_got(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(1, "one"), (2, "two"), (3, None)]
    S.write_database(spark.createDataFrame(rows, "code int, name string"), url, "mapping", driver=driver)
    assert sorted(map(tuple, S.read_database(spark, url, 'SELECT * FROM mapping WHERE "code" > 1', driver=driver).collect())) == rows[1:]


def test_a_database_is_read_in_parts(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/parts;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    S.write_database(spark.range(100).selectExpr("id AS code", "id % 7 AS kind", "CAST(id AS string) AS name"), url, "mapping", driver=driver)
    parts = S.read_database(spark, url, "SELECT * FROM mapping", key="code", partitions=5, driver=driver)
    assert parts.rdd.getNumPartitions() == 5 and sorted(r.code for r in parts.collect()) == list(range(100))
    assert max(len(x) for x in parts.rdd.glom().collect()) <= 25
    none = S.read_database(spark, url, 'SELECT * FROM mapping WHERE "code" < 0', key="code", driver=driver)
    assert none.count() == 0
    keys = spark.createDataFrame([(3, 3), (8, 1), (8, 1), (9, 9), (None, 2)], "code long, kind long")
    found = S.read_matching(spark, url, "mapping", keys, "wanted", key="code", partitions=3, driver=driver)
    assert sorted((r.code, r.name) for r in found.collect()) == [(3, "3"), (8, "8")] and found.rdd.getNumPartitions() == 3
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "EXISTS (SELECT 1 FROM wanted" in scan


def test_bucketed_pairs_are_joined_without_moving_them(spark):
    n = 40
    keys = ["stack_id", "doc_id", "sub_doc_id"]
    edges = [(f"{i}", f"{i + 1}") for i in range(n)]
    df, _ = pair_table(spark, edges, {}, {})
    amounts = spark.createDataFrame([("s", f"{i}", "1", float(i)) for i in range(n + 1)], "stack_id string, doc_id string, sub_doc_id string, reimbursement double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, dimension = S.write_bucketed(df, "bucketed_pairs", keys, 3), S.write_bucketed(amounts, "bucketed_amounts", keys, 3)
        joined = money.join_money(pairs, dimension)
        assert {(r.doc_id, r.reimbursement, r.reimbursement_2) for r in joined.collect()} == {(a, float(a), float(b)) for a, b in edges}
        plan = pairs.join(dimension.groupBy(*keys).agg({"reimbursement": "max"}), keys, "left")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        # only the second join moves the pairs
        whole = joined._jdf.queryExecution().executedPlan().toString()
        assert whole[whole.index("Initial Plan") if "Initial Plan" in whole else 0 :].count("Exchange hashpartitioning(stack_id_2") == 1
        assert "Exchange hashpartitioning(stack_id#" not in whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS bucketed_pairs")
        spark.sql("DROP TABLE IF EXISTS bucketed_amounts")
