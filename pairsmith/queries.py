"""Queries over the derived pair table, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith import fixtures as X
from pairsmith.functions import predicates as P
from pairsmith.operators import evaluate as E
from pairsmith.operators import mining as M
from pairsmith.operators import money, sampling, strata
from pairsmith.plans import pipeline, reports
from pairsmith.sources import pairs as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RULES = X.RULES
CONFIG = X.CONFIG
#: Rules with some that others dominate.
NESTED = [("eq_status", "eq_priority"), ("dist_2_date",), ("dist_1_date",), ("eq_priority", "eq_status"), ("dist_1_date", "eq_month"), ("prop_0.8_price", "eq_status"), ("prop_0.95_price", "eq_status"), ("overlap_0_brands",), ("overlap_0.5_brands", "eq_month")]
COST = 20.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _WITH + sql
        return f

    return add


def _b(name: str) -> str:
    return f'coalesce("{name}", false)'


def _fires(rule) -> str:
    return "(" + " AND ".join(map(_b, rule)) + ")"


def _any(rules) -> str:
    return "(" + " OR ".join(map(_fires, rules)) + ")"


def _first(rules) -> str:
    return "CASE " + " ".join(f"WHEN {_fires(r)} THEN {i}" for i, r in enumerate(rules)) + " ELSE -1 END"


_SIDES = ", ".join(f"a.{c}, b.{c} AS {c}_2" for c in ("stack_id", "doc_id", "sub_doc_id", "lar", "import_time", "reimbursement", "paid_out"))
_WITH = f"""
WITH RECURSIVE brands AS (SELECT l_orderkey, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
docs AS (
  SELECT o_orderkey AS k, o_custkey AS agreement_id, year(o_orderdate)::VARCHAR AS stack_id, o_orderkey::VARCHAR AS doc_id, '1' AS sub_doc_id,
    o_orderpriority AS lar, o_orderdate AS import_time, strftime(o_orderdate, '%Y-%m-%d') AS date_str, month(o_orderdate) AS month, o_orderstatus AS status, o_totalprice AS price,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS reimbursement, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS paid_out, brands
  FROM orders LEFT JOIN brands ON o_orderkey = l_orderkey
),
raw_pairs AS (
  SELECT a.k, b.k AS k_2, a.agreement_id, {_SIDES}, (a.k + b.k) % 13 = 0 AS legacy_rule,
    CASE WHEN a.k % 17 <> 0 AND b.k % 17 <> 0 THEN a.status = b.status END AS eq_status, a.lar = b.lar AS eq_priority, a.month = b.month AS eq_month,
    levenshtein(a.date_str, b.date_str) <= 1 AS dist_1_date, levenshtein(a.date_str, b.date_str) <= 2 AS dist_2_date,
    least(a.price, b.price) / greatest(a.price, b.price) >= 0.95::DOUBLE AS "prop_0.95_price", least(a.price, b.price) / greatest(a.price, b.price) >= 0.8::DOUBLE AS "prop_0.8_price",
    CASE WHEN a.brands IS NOT NULL AND b.brands IS NOT NULL THEN 2 * len(list_intersect(a.brands, b.brands)) >= least(len(a.brands), len(b.brands)) END AS "overlap_0.5_brands",
    CASE WHEN a.brands IS NOT NULL AND b.brands IS NOT NULL THEN len(list_intersect(a.brands, b.brands)) > 0 END AS overlap_0_brands
  FROM docs a JOIN docs b ON a.agreement_id = b.agreement_id AND a.k > b.k
),
pairs AS MATERIALIZED (
  SELECT *, CASE WHEN (k * 7 + k_2 * 13) % 10 >= 5 THEN
      CASE WHEN coalesce(eq_status, false)::INT + eq_priority::INT + coalesce("prop_0.8_price", false)::INT + dist_2_date::INT >= 2 THEN (k * 7 + k_2 * 13) % 10 <> 9 ELSE (k * 7 + k_2 * 13) % 10 = 8 END END AS label
  FROM raw_pairs
),
"""
_BASE = "NOT legacy_rule AND (NOT starts_with(lar, '3') OR NOT starts_with(lar_2, '3')) AND lar <> '4-NOT SPECIFIED'"
_WINDOW = "import_time >= TIMESTAMP '1998-11-01' AND import_time < TIMESTAMP '1998-12-01' AND import_time_2 >= TIMESTAMP '1996-11-01' AND import_time_2 < TIMESTAMP '1998-12-01'"
_Y = "coalesce(label, false)"
_ONE = "one AS (SELECT 1 AS x)\n"


def _rows(items) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in items) + ")"


# scans and filters


@query(_ONE + f"SELECT k, k_2, label FROM pairs WHERE {_BASE} AND (label IS NOT NULL OR (import_time >= TIMESTAMP '1997-01-01' AND import_time < TIMESTAMP '1999-01-01' AND import_time_2 >= TIMESTAMP '1997-01-01' AND import_time_2 < TIMESTAMP '1999-01-01'))")
def pairs_scan_filtered(spark, sf):
    return X.pairs(spark, sf).filter(S.train_filter(CONFIG.filters)).select("k", "k_2", "label")


@query(_ONE + "SELECT count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_labelled_neg, count(*) FILTER (label IS NULL) AS n_unlabelled, count(*) AS n_total FROM pairs")
def label_census(spark, sf):
    return E.census(X.pairs(spark, sf))


@query(_ONE + f"SELECT k, k_2, label FROM pairs WHERE {_BASE} AND {_WINDOW}")
def eval_window(spark, sf):
    return X.pairs(spark, sf).filter(S.base_filter(CONFIG.filters) & S.window_filter(CONFIG.filters)).select("k", "k_2", "label")


@query(_ONE + f"SELECT k, k_2 FROM pairs WHERE {_BASE} AND label IS NULL AND import_time >= TIMESTAMP '1998-11-01' AND import_time < TIMESTAMP '1998-12-01' AND import_time_2 >= TIMESTAMP '1996-11-01' AND import_time_2 < TIMESTAMP '1998-10-01'")
def historic_window(spark, sf):
    return X.pairs(spark, sf).filter(S.base_filter(CONFIG.filters) & S.historic_filter(CONFIG.filters)).select("k", "k_2")


@query(_ONE + "SELECT k, k_2, reimbursement, reimbursement_2 FROM pairs WHERE least(reimbursement, reimbursement_2) IS NULL OR least(reimbursement, reimbursement_2) > 150000")
def min_reimbursement(spark, sf):
    return X.pairs(spark, sf).filter(S.min_reimbursement_filter(150_000)).select("k", "k_2", "reimbursement", "reimbursement_2")


_SIM = " + ".join(f"coalesce({q}::INT, 0)" for q in (f'"{n}"' for n in X.NAMES if not n.startswith("prop")))


@query(_ONE + f"SELECT k, k_2, ({_SIM})::INT AS sum_sim FROM pairs ORDER BY sum_sim DESC, k, k_2 LIMIT 100")
def sum_sim_rank(spark, sf):
    df = X.pairs(spark, sf)
    return df.select("k", "k_2", P.similarity_sum(df)).orderBy(F.desc("sum_sim"), "k", "k_2").limit(100)


# counts of rules and compositions


@query("r AS (" + " UNION ALL ".join(f"SELECT '{p}' AS predicate, count(*) FILTER ({_b(p)} AND {_Y}) AS tp, count(*) FILTER ({_b(p)}) AS pp FROM pairs" for p in X.NAMES) + ") SELECT * FROM r")
def predicate_support(spark, sf):
    names = spark.createDataFrame(list(enumerate(X.NAMES)), "rule_id int, predicate string")
    return E.rule_counts(X.pairs(spark, sf), [(p,) for p in X.NAMES]).join(F.broadcast(names), "rule_id").select("predicate", "tp", "pp")


@query("r AS (" + " UNION ALL ".join(f"SELECT {i} AS rule_id, count(*) FILTER ({_fires(r)} AND {_Y}) AS tp, count(*) FILTER ({_fires(r)}) AS pp FROM pairs" for i, r in enumerate(RULES)) + ") SELECT rule_id, tp, pp, CASE WHEN pp = 0 THEN 0 ELSE tp::DOUBLE / pp END AS precision FROM r")
def rule_confusion(spark, sf):
    return E.rule_counts(X.pairs(spark, sf), RULES)


@query(f"c AS (SELECT count(*) FILTER ({_any(RULES)} AND {_Y}) AS tp, count(*) FILTER ({_any(RULES)}) AS pp, count(*) FILTER ({_Y}) AS p FROM pairs) SELECT tp::DOUBLE / pp AS precision, tp::DOUBLE / p AS recall FROM c")
def composition_eval(spark, sf):
    return E.evaluate(X.pairs(spark, sf), RULES)


_STEPS = f"hits AS (SELECT {_first(RULES)} AS m, count(*) AS n, count(*) FILTER ({_Y}) AS t FROM pairs GROUP BY 1), spine AS (SELECT range::INT AS m FROM range({len(RULES)})), steps AS (SELECT spine.m, sum(coalesce(n, 0)) OVER (ORDER BY spine.m)::BIGINT AS pp, sum(coalesce(t, 0)) OVER (ORDER BY spine.m)::BIGINT AS tp FROM spine LEFT JOIN hits ON spine.m = hits.m)"


@query(_STEPS + " SELECT * FROM steps")
def composition_steps(spark, sf):
    return money.composition_steps(X.pairs(spark, sf), RULES)


@query(_STEPS + f", t AS (SELECT count(*) FILTER ({_Y}) AS p FROM pairs) SELECT m, CASE WHEN pp = 0 THEN 0 ELSE tp::DOUBLE / pp END AS precision, tp::DOUBLE / p AS recall, pp, m = 2 AS is_optimum FROM steps, t")
def precision_recall_curve(spark, sf):
    df = X.pairs(spark, sf)
    return reports.precision_recall(money.composition_steps(df, RULES), E.census(df).first().n_pos, 2)


@query(_ONE + "SELECT " + ", ".join(f"count(*) FILTER (stack_id {op} stack_id_2 AND {what})::DOUBLE AS {side}_stack_{name}" for side, op in (("in", "="), ("out", "<>")) for name, what in (("total_positives", _Y), ("pos_pred", _any(RULES)), ("true_positives", f"{_any(RULES)} AND {_Y}"))) + " FROM pairs")
def stack_split(spark, sf):
    return E.stack_split(X.pairs(spark, sf), RULES)


_CELLS = f"cells AS (SELECT lar, lar_2, count(*) AS n_total, count(*) FILTER ({_Y}) AS total_pos, count(*) FILTER ({_any(RULES)}) AS pos_pred, count(*) FILTER ({_any(RULES)} AND {_Y}) AS tp FROM pairs GROUP BY 1, 2)"


@query(_CELLS + " SELECT *, 100 * CASE WHEN pos_pred = 0 THEN 0 ELSE tp::DOUBLE / pos_pred END AS precision_pct, 100 * CASE WHEN total_pos = 0 THEN 0 ELSE tp::DOUBLE / total_pos END AS recall_pct FROM cells")
def class_heatmap(spark, sf):
    return E.class_table(X.pairs(spark, sf), RULES)


_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(_CELLS + " SELECT lar, " + ", ".join(f"coalesce(max(tp) FILTER (lar_2 = '{c}'), 0) AS \"{c}\"" for c in _CLASSES) + " FROM cells GROUP BY lar")
def class_pivot(spark, sf):
    return E.class_matrix(E.class_table(X.pairs(spark, sf), RULES), "tp", _CLASSES)


_DAYS = "date_sub('day', import_time_2, import_time)"


@query(f"c AS (SELECT {_DAYS}::INT AS days, count(*) AS pos_pred, count(*) FILTER ({_Y}) AS tp FROM pairs WHERE {_any(RULES)} AND {_DAYS} > 0 AND {_DAYS} < 730 GROUP BY 1), s AS (SELECT unnest(range(0, (SELECT max(days) FROM c) + 1))::INT AS days) SELECT s.days, coalesce(pos_pred, 0) AS pos_pred, coalesce(tp, 0) AS tp FROM s LEFT JOIN c ON s.days = c.days")
def time_diff_hist(spark, sf):
    return reports.time_histogram(X.pairs(spark, sf), RULES)


@query(f"e AS (SELECT (floor({_DAYS} / 60.0) * 60)::INT AS bin_days, least(reimbursement, reimbursement_2)::DECIMAL(18,2) AS saving, {_any(RULES)} AS fire FROM pairs WHERE {_Y} AND {_DAYS} > 0 AND {_DAYS} < 730 AND least(reimbursement, reimbursement_2) IS NOT NULL), u AS (SELECT 'positives' AS kind, bin_days, saving FROM e UNION ALL SELECT 'true_positives', bin_days, saving FROM e WHERE fire) SELECT kind, bin_days, count(*) AS n, sum(saving)::DOUBLE / count(*) AS mean_saving FROM u GROUP BY 1, 2")
def savings_by_time(spark, sf):
    return reports.savings_by_time(X.pairs(spark, sf), RULES)


# mining


def _level(n: int) -> str:
    """Rules of n predicates that extend level n - 1."""
    old = [f"p{i}" for i in range(n - 1)]
    if n == 1:
        return f"l1 AS (SELECT idx AS p0, grp, sum(n_pos)::BIGINT AS tp, sum(n)::BIGINT AS pp FROM pred JOIN pat ON b[idx + 1] GROUP BY ALL HAVING tp >= {CONFIG.learning.min_new_tp})"
    on = " AND ".join(f"b[{c} + 1]" for c in old)
    return f"l{n} AS (SELECT {', '.join(f'l.{c}' for c in old)}, q.idx AS p{n - 1}, q.grp, sum(n_pos)::BIGINT AS tp, sum(n)::BIGINT AS pp FROM l{n - 1} l JOIN pred q ON q.grp > l.grp JOIN pat ON {on} AND b[q.idx + 1] GROUP BY ALL HAVING tp >= {CONFIG.learning.min_new_tp})"


def _candidates(levels: int) -> str:
    group_of, _ = P.build_lookups(X.GROUPS)
    pred = f"pred AS (SELECT * FROM {_rows([(i, group_of[p], p) for i, p in enumerate(X.NAMES)])} AS t(idx, grp, name))"
    pat = f"pat AS (SELECT [{', '.join(map(_b, X.NAMES))}] AS b, count(*) AS n, count(*) FILTER ({_Y}) AS n_pos FROM pairs GROUP BY 1)"
    union = " UNION ALL ".join(f"SELECT {n} AS level, " + ", ".join(f"p{i}" if i < n else f"NULL::INT AS p{i}" for i in range(levels)) + f", tp, pp FROM l{n}" for n in range(1, levels + 1))
    name = " || ".join([f"(SELECT name FROM pred WHERE idx = p{i})" if i == 0 else f"coalesce(' & ' || (SELECT name FROM pred WHERE idx = p{i}), '')" for i in range(levels)])
    order = ", ".join(f"p{i}" for i in range(levels))
    return f"{pred}, {pat}, {', '.join(_level(n) for n in range(1, levels + 1))}, u AS ({union}), placed AS (SELECT (row_number() OVER (ORDER BY level, {order}) - 1)::INT AS rule_id, {name} AS rule, tp, pp, tp::DOUBLE / pp AS precision, {order} FROM u), cand AS (SELECT rule_id, rule, tp, pp, precision FROM placed)"


_CANDIDATE = "rule_id int, rule string, tp long, pp long, precision double"


def _mined(spark, sf, levels: int):
    patterns = M.Patterns(X.pairs(spark, sf), X.NAMES)
    return patterns, M.candidate_rules(patterns, X.GROUPS, levels, CONFIG.learning.min_new_tp)


def _candidate_rows(candidates) -> list[tuple]:
    return [(i, " & ".join(c.predicates), c.true_positives, c.positive_predictions, c.precision) for i, c in enumerate(candidates)]


@query(_candidates(2) + " SELECT * FROM cand")
def candidate_rules_k2(spark, sf):
    return spark.createDataFrame(_candidate_rows(_mined(spark, sf, 2)[1]), _CANDIDATE)


@query(_candidates(3) + " SELECT * FROM cand")
def candidate_rules_k3(spark, sf):
    return spark.createDataFrame(_candidate_rows(_mined(spark, sf, 3)[1]), _CANDIDATE)


@query(_candidates(2) + " SELECT rule, tp, pp, precision, (row_number() OVER (ORDER BY tp DESC, rule_id) - 1)::INT AS rule_id FROM cand ORDER BY tp DESC, cand.rule_id LIMIT 20")
def candidate_cutoff(spark, sf):
    return spark.createDataFrame(_candidate_rows(M.cut_candidates(_mined(spark, sf, 2)[1], 20)), _CANDIDATE)


def _greedy(table: str = "pairs", most: int | None = None) -> str:
    """The greedy composition on the rows of a table; of more candidates than ``most`` the first by true positives."""
    cut = "" if most is None else f", cut AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN count(*) OVER () > {most} THEN row_number() OVER (ORDER BY tp DESC, rule_id) - 1 ELSE rule_id END AS rule_id) FROM placed) WHERE rule_id < {most})"
    return f"""{_candidates(2).replace("FROM pairs", f"FROM {table}")}{cut}, fired AS MATERIALIZED (
  SELECT pid, any_value(n) AS n, any_value(n_pos) AS n_pos, list(rule_id) AS rules FROM (SELECT row_number() OVER () AS pid, * FROM pat) JOIN {"placed" if most is None else "cut"} ON b[p0 + 1] AND coalesce(b[p1 + 1], true) GROUP BY 1
), goal AS (SELECT sum(n_pos) AS p, ceil(0.9::DOUBLE * sum(n_pos)) AS target FROM pat),
greedy AS (
  SELECT 0 AS step, []::INT[] AS chosen, NULL::INT AS rule_id, 0::BIGINT AS tp, 0::BIGINT AS pp
  UNION ALL
  SELECT step + 1, list_append(chosen, best), best, tp, pp FROM (
    SELECT step, chosen, best, greedy.tp + sum(n_pos)::BIGINT AS tp, greedy.pp + sum(n)::BIGINT AS pp
    FROM greedy, goal, (SELECT n, n_pos, rules, unnest(rules) AS best FROM fired)
    WHERE greedy.tp < target AND NOT list_has_any(rules, chosen)
    GROUP BY step, chosen, best, greedy.tp, greedy.pp, target
    HAVING sum(n_pos) >= greatest(5, floor((target - greedy.tp) * 0.01::DOUBLE))
  ) QUALIFY row_number() OVER (ORDER BY tp::DOUBLE / pp DESC, best) = 1
)"""


_COMPOSED = " SELECT (step - 1)::INT AS step, rule, greedy.tp::DOUBLE / greedy.pp AS precision, greedy.tp::DOUBLE / p AS recall, greedy.tp, greedy.pp FROM greedy JOIN {} c ON greedy.rule_id = c.rule_id, goal"


@query(_greedy() + _COMPOSED.format("cand"))
def greedy_composition(spark, sf):
    patterns, found = _mined(spark, sf, 2)
    return spark.createDataFrame(M.find_composition(found, patterns, 0.9, 5).rows(), M.Composition.SCHEMA)


#: Rules that the exact composition chooses from.
CHOICE: list[P.Rule] = [*RULES, *((p,) for p in X.NAMES[:7])]


def _names(rules) -> str:
    return f"{_rows([(i, ' & '.join(r)) for i, r in enumerate(rules)])} AS t(rule_id, rule)"


def _exact() -> str:
    """All sets of the rules: the most precise that reaches the recall."""
    mask = " + ".join(f"{_fires(r)}::INT * {1 << i}" for i, r in enumerate(CHOICE))
    size = len(CHOICE)
    return f"""sets AS MATERIALIZED (SELECT {mask} AS fired, count(*) AS n, count(*) FILTER ({_Y}) AS n_pos FROM pairs GROUP BY 1), goal AS (SELECT ceil(0.6::DOUBLE * sum(n_pos)) AS target FROM sets),
tried AS (SELECT s.m, sum(n_pos)::BIGINT AS tp, sum(n)::BIGINT AS pp, list_filter(range({size}), lambda i: s.m & (1 << i) > 0) AS chosen FROM (SELECT range::INT AS m FROM range(1, {1 << size})) s JOIN sets ON fired & s.m > 0 GROUP BY s.m),
won AS (SELECT tp, pp, chosen FROM tried, goal WHERE tp >= target ORDER BY tp::DOUBLE / pp DESC, tp DESC, len(chosen), chosen LIMIT 1)
SELECT rule, tp, pp, tp::DOUBLE / pp AS precision FROM (SELECT unnest(chosen) AS rule_id, tp, pp FROM won) w JOIN {_names(CHOICE)} ON t.rule_id = w.rule_id"""


@query(_exact())
def exact_composition(spark, sf):
    patterns = M.Patterns(X.pairs(spark, sf), X.NAMES)
    best = M.exact_composition(CHOICE, patterns, 0.6)
    chosen = [(" & ".join(CHOICE[i]), best.true_positives, best.positive_predictions, best.true_positives / best.positive_predictions) for i in best.chosen] if best else []
    return spark.createDataFrame(chosen, "rule string, tp long, pp long, precision double")


@query()
def beam_composition(spark, sf):
    patterns, found = _mined(spark, sf, 1)
    return spark.createDataFrame(M.beam_composition(found, patterns, 0.9, 5, 2).rows(), M.Composition.SCHEMA)


def _nested() -> str:
    group_of, loose = P.build_lookups(X.GROUPS)
    rows = _rows([(i, p, group_of[p], loose[p], len(r)) for i, r in enumerate(NESTED) for p in r])
    return f"rp AS (SELECT * FROM {rows} AS t(rule_id, predicate, grp, loose, n)), ids AS (SELECT DISTINCT rule_id, n FROM rp), dom AS (SELECT a.rule_id AS i, b.rule_id AS j FROM ids a, ids b WHERE a.rule_id <> b.rule_id AND a.n <= b.n AND NOT EXISTS (SELECT 1 FROM rp x WHERE x.rule_id = a.rule_id AND NOT EXISTS (SELECT 1 FROM rp y WHERE y.rule_id = b.rule_id AND y.grp = x.grp AND x.loose >= y.loose)))"


@query(_nested() + " SELECT rule_id::INT AS rule_id FROM ids WHERE NOT EXISTS (SELECT 1 FROM dom d WHERE d.j = ids.rule_id AND (d.i < d.j OR NOT EXISTS (SELECT 1 FROM dom e WHERE e.i = d.j AND e.j = d.i)))")
def subsumed_rules(spark, sf):
    left = M.remove_subsumed(NESTED, X.GROUPS)
    return spark.createDataFrame([(i,) for i, r in enumerate(NESTED) if any(r is x for x in left)], "rule_id int")


@query("f AS (SELECT [" + ", ".join(map(_fires, RULES)) + f"] AS f, {_Y} AS y FROM pairs), s AS (SELECT unnest(range({len(RULES)})) AS rule_id) SELECT rule_id::INT AS rule_id, count(*) FILTER (y AND f[rule_id + 1] AND len(list_filter(f, lambda x: x)) = 1) AS unique_tp FROM s, f GROUP BY 1")
def unique_tp(spark, sf):
    patterns = M.Patterns(X.pairs(spark, sf), X.NAMES)
    return spark.createDataFrame(list(enumerate(M.unique_true_positives(RULES, patterns))), "rule_id int, unique_tp long")


def _pruned(rules, start: str, table: str) -> str:
    """kept: the rules left of the list ``start`` after removing, again and again, the first without a positive of its own."""
    return f"""positive AS MATERIALIZED (SELECT list_filter([{", ".join(f"CASE WHEN {_fires(r)} THEN {i} END" for i, r in enumerate(rules))}], lambda x: x IS NOT NULL) AS fired FROM {table} WHERE {_Y} GROUP BY 1),
pruning AS (
  SELECT 0 AS step, {start} AS kept
  UNION ALL
  SELECT step + 1, list_filter(kept, lambda x: x <> idle) FROM (
    SELECT step, kept, idle FROM (SELECT step, kept, unnest(kept) AS idle FROM pruning) LEFT JOIN positive ON list_contains(fired, idle) AND len(list_intersect(fired, kept)) = 1
    GROUP BY 1, 2, 3 HAVING count(fired) = 0
  ) QUALIFY row_number() OVER (ORDER BY list_position(kept, idle)) = 1
), kept AS (SELECT unnest(kept) AS rule_id FROM (SELECT arg_max(kept, step) AS kept FROM pruning))"""


@query(_pruned(NESTED, f"range({len(NESTED)})::INT[]", "pairs") + f" SELECT rule FROM kept JOIN {_names(NESTED)} ON t.rule_id = kept.rule_id")
def redundant_removed(spark, sf):
    patterns = M.Patterns(X.pairs(spark, sf), X.NAMES)
    return spark.createDataFrame([(" & ".join(r),) for r in M.remove_redundant(NESTED, patterns)], "rule string")


# joins


@query("d AS (SELECT stack_id, doc_id, sub_doc_id, max(reimbursement) AS r FROM docs GROUP BY ALL) SELECT k, k_2, a.r AS reimbursement, b.r AS reimbursement_2 FROM pairs p LEFT JOIN d a ON p.stack_id = a.stack_id AND p.doc_id = a.doc_id AND p.sub_doc_id = a.sub_doc_id LEFT JOIN d b ON p.stack_id_2 = b.stack_id AND p.doc_id_2 = b.doc_id AND p.sub_doc_id_2 = b.sub_doc_id")
def money_join(spark, sf):
    amounts = X.documents(spark, sf).select("stack_id", "doc_id", "sub_doc_id", "reimbursement")
    return money.join_money(X.pairs(spark, sf), amounts).select("k", "k_2", "reimbursement", "reimbursement_2")


@query(f"f AS (SELECT stack_id, doc_id, sub_doc_id FROM pairs WHERE {_any(RULES)} UNION SELECT stack_id_2, doc_id_2, sub_doc_id_2 FROM pairs WHERE {_any(RULES)}) SELECT f.stack_id, f.doc_id, f.sub_doc_id, reimbursement FROM f LEFT JOIN docs ON f.doc_id = docs.doc_id")
def flagged_doc_lookup(spark, sf):
    return money.enriched(money.flagged_documents(X.pairs(spark, sf), RULES), X.documents(spark, sf).select("stack_id", "doc_id", "sub_doc_id", "reimbursement"))


_FLAT = "flat AS (SELECT l_orderkey::VARCHAR AS doc_id, '1' AS sub_doc_id, count(*) AS n_lines, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity FROM lineitem GROUP BY 1)"


@query(_FLAT + " SELECT k, k_2, a.n_lines, b.n_lines AS n_lines_2, a.quantity, b.quantity AS quantity_2 FROM pairs p LEFT JOIN flat a ON p.doc_id = a.doc_id AND p.sub_doc_id = a.sub_doc_id LEFT JOIN flat b ON p.doc_id_2 = b.doc_id AND p.sub_doc_id_2 = b.sub_doc_id")
def flatfile_join(spark, sf):
    lines = S.read_pairs(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_quantity"])
    flat = lines.groupBy(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("1").alias("sub_doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    right = flat.select(*(F.col(c).alias(f"{c}_2") for c in flat.columns))
    return X.pairs(spark, sf).join(flat, ["doc_id", "sub_doc_id"], "left").join(right, ["doc_id_2", "sub_doc_id_2"], "left").select("k", "k_2", "n_lines", "n_lines_2", "quantity", "quantity_2")


_FILED = "filed AS (SELECT year(o_orderdate)::VARCHAR AS year, o_orderkey::VARCHAR AS number, '1' AS part_no, o_orderpriority AS urgency, max(o_orderstatus) AS status FROM orders GROUP BY ALL)"


@query(_FILED + " SELECT k, k_2, a.status, b.status AS status_2 FROM pairs p LEFT JOIN filed a ON p.stack_id = a.year AND p.doc_id = a.number AND p.sub_doc_id = a.part_no AND p.lar = a.urgency LEFT JOIN filed b ON p.stack_id_2 = b.year AND p.doc_id_2 = b.number AND p.sub_doc_id_2 = b.part_no AND p.lar_2 = b.urgency")
def four_key_join(spark, sf):
    """Attributes from a glob of files, by four keys that have other names there."""
    orders = S.read_pairs(spark, f"{sf}/order*.parquet", columns=["o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus"])
    filed = orders.groupBy(F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderkey").cast("string").alias("number"), F.lit("1").alias("part_no"), F.col("o_orderpriority").alias("urgency")).agg(F.max("o_orderstatus").alias("status"))
    out, keys = X.pairs(spark, sf), ("stack_id", "doc_id", "sub_doc_id", "lar")
    for side in ("", "_2"):
        other = filed.select(*(F.col(c).alias(f"f_{c}{side}") for c in filed.columns))
        on = [F.col(k + side) == F.col(f"f_{c}{side}") for k, c in zip(keys, ("year", "number", "part_no", "urgency"), strict=True)]
        out = out.join(other, on, "left")
    return out.select("k", "k_2", F.col("f_status").alias("status"), F.col("f_status_2").alias("status_2"))


@query(_ONE + "SELECT k, k_2, c_name FROM pairs LEFT JOIN customer ON agreement_id::VARCHAR = c_custkey::VARCHAR")
def string_key_join(spark, sf):
    mapping = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    pairs = X.pairs(spark, sf)
    return pairs.join(mapping, pairs.agreement_id.cast("string") == mapping.c_custkey.cast("string"), "left").select("k", "k_2", "c_name")


@query("j AS (SELECT k, k_2, label, CASE WHEN label IS NOT NULL AND (k + k_2) % 3 <> 0 THEN (k * 3 + k_2) % 4 <> 1 END AS other_label FROM pairs) SELECT * FROM j WHERE (label AND other_label) IS NULL")
def unlabelled_export(spark, sf):
    pairs = X.pairs(spark, sf)
    labels = pairs.filter("label IS NOT NULL AND (k + k_2) % 3 <> 0").select("k", "k_2", ((F.col("k") * 3 + F.col("k_2")) % 4 != 1).alias("other_label"))
    return pairs.select("k", "k_2", "label").join(labels, ["k", "k_2"], "left").filter(S.nowhere_labelled(["label", "other_label"]))


# components and money

_NODE, _NODE_2 = "stack_id || '|' || doc_id || '|' || sub_doc_id", "stack_id_2 || '|' || doc_id_2 || '|' || sub_doc_id_2"
_VALUES = f"sides AS (SELECT {_NODE} AS node, reimbursement AS r, paid_out AS p FROM pairs UNION ALL SELECT {_NODE_2}, reimbursement_2, paid_out_2 FROM pairs), vals AS (SELECT node, max(coalesce(r, 0))::DECIMAL(18,2) AS r, coalesce(bool_or(p), false) AS p FROM sides GROUP BY 1)"
_GRAPH = f"e AS (SELECT {_NODE} AS a, {_NODE_2} AS b FROM pairs WHERE {_Y} AND {_any(RULES)}), es AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, a AS b FROM es UNION SELECT reach.a, es.b FROM reach JOIN es ON reach.b = es.a), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)"


def _true_pairs(spark, sf) -> DataFrame:
    return X.pairs(spark, sf).filter(P.truth("label") & P.any_fires(RULES))


@query(_GRAPH + " SELECT node, component FROM comp")
def doc_components(spark, sf):
    return money.component_labels(_true_pairs(spark, sf))


@query(_VALUES + " SELECT node, r::DOUBLE AS reimbursement, p AS paid_out FROM vals")
def doc_values(spark, sf):
    return money.document_values(X.pairs(spark, sf))


_RANKED = "ranked AS (SELECT component, comp.node, r, p, row_number() OVER (PARTITION BY component ORDER BY r DESC, comp.node) AS place FROM comp JOIN vals ON comp.node = vals.node)"


@query(f"{_VALUES}, {_GRAPH}, {_RANKED} SELECT component, count(*) AS n_docs, string_agg(node, ',' ORDER BY place) AS nodes, coalesce(sum(r) FILTER (place > 1), 0)::DOUBLE AS savings_total, coalesce(sum(r) FILTER (place > 1 AND p), 0)::DOUBLE AS savings_paid FROM ranked GROUP BY 1")
def component_table(spark, sf):
    out = money.component_table(_true_pairs(spark, sf), money.document_values(X.pairs(spark, sf)))
    return out.select("component", "n_docs", F.array_join("nodes", ",").alias("nodes"), "savings_total", "savings_paid")


@query(f"{_VALUES}, {_GRAPH}, {_RANKED} SELECT component, (place - 1)::BIGINT AS place, node, r::DOUBLE AS reimbursement, p AS paid_out, count(*) OVER (PARTITION BY component) AS n_docs, coalesce(sum(r) FILTER (place > 1) OVER w, 0)::DOUBLE AS savings_total, coalesce(sum(r) FILTER (place > 1 AND p) OVER w, 0)::DOUBLE AS savings_paid FROM ranked WINDOW w AS (PARTITION BY component ORDER BY place)")
def component_members(spark, sf):
    return money.component_members(_true_pairs(spark, sf), money.document_values(X.pairs(spark, sf)))


@query(f"{_VALUES}, {_GRAPH}, {_RANKED} SELECT coalesce(sum(r) FILTER (place > 1), 0)::DOUBLE AS savings_total, coalesce(sum(r) FILTER (place > 1 AND p), 0)::DOUBLE AS savings_paid FROM ranked")
def component_savings(spark, sf):
    return money.component_savings(_true_pairs(spark, sf), money.document_values(X.pairs(spark, sf)))


_STEPWISE = f"""{_STEPS}, {_VALUES}, fe AS (SELECT {_first(RULES)} AS m0, {_NODE} AS a, {_NODE_2} AS b FROM pairs WHERE {_Y}),
me AS (SELECT spine.m, a, b FROM fe JOIN spine ON m0 >= 0 AND m0 <= spine.m), mes AS (SELECT m, a, b FROM me UNION SELECT m, b, a FROM me),
reach AS (SELECT m, a, a AS b FROM mes UNION SELECT reach.m, reach.a, mes.b FROM reach JOIN mes ON reach.m = mes.m AND reach.b = mes.a), comp AS (SELECT m, a AS node, min(b) AS component FROM reach GROUP BY 1, 2),
ranked AS (SELECT m, r, p, row_number() OVER (PARTITION BY m, component ORDER BY r DESC, comp.node) AS place FROM comp JOIN vals ON comp.node = vals.node),
sav AS (SELECT m, coalesce(sum(r) FILTER (place > 1), 0)::DOUBLE AS savings_total, coalesce(sum(r) FILTER (place > 1 AND p), 0)::DOUBLE AS savings_paid FROM ranked GROUP BY 1),
nv AS (SELECT steps.m, pp, tp, coalesce(savings_total, 0) AS savings_total, coalesce(savings_paid, 0) AS savings_paid, coalesce(savings_total, 0) - pp * 20.0::DOUBLE AS nv_total, coalesce(savings_paid, 0) - pp * 20.0::DOUBLE AS nv_paid FROM steps LEFT JOIN sav ON steps.m = sav.m)"""


@query(_STEPWISE + " SELECT * FROM nv")
def stepwise_net_value(spark, sf):
    return money.stepwise_net_value(X.pairs(spark, sf), RULES, COST)


@query(_STEPWISE + " SELECT * FROM nv ORDER BY nv_total DESC, m LIMIT 1")
def optimum_step(spark, sf):
    return money.optimum(money.stepwise_net_value(X.pairs(spark, sf), RULES, COST))


# samples and estimates


@query(f"c AS (SELECT count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n, count(*) FILTER (label IS NULL) AS u FROM pairs), w AS (SELECT greatest(0, trunc(p * (1 - 0.25::DOUBLE) / 0.25::DOUBLE)::BIGINT - n) AS want, u FROM c), r AS (SELECT k, k_2, label, row_number() OVER (ORDER BY k, k_2) - 1 AS i FROM pairs) SELECT k, k_2, label FROM r, w WHERE label IS NOT NULL OR (want > 0 AND i % greatest(1, u // want) = 0)")
def downsample(spark, sf):
    return sampling.downsample(X.pairs(spark, sf).select("k", "k_2", "label"), ["k", "k_2"], 0.25)


@query(f"r AS (SELECT k, k_2, {_Y} AS y, row_number() OVER (PARTITION BY {_Y} ORDER BY md5('42|' || k || '|' || k_2), k, k_2) AS i, count(*) OVER (PARTITION BY {_Y}) AS n FROM pairs) SELECT k, k_2, i <= trunc(n * (1 - 0.2::DOUBLE)) AS is_train FROM r")
def train_test_split(spark, sf):
    return sampling.train_test_split(X.pairs(spark, sf).select("k", "k_2", "label"), ["k", "k_2"], 0.2).select("k", "k_2", "is_train")


_STRATA = f"st AS (SELECT k, k_2, label, {_first(RULES)} AS stratum_k FROM pairs)"
_ALLOC = _STRATA + ", cnt AS (SELECT stratum_k, count(*) AS n_total FROM st WHERE stratum_k >= 0 GROUP BY 1), alloc AS (SELECT stratum_k, n_total, least(n_total, greatest(1, round(n_total / (SELECT sum(n_total) FROM cnt)::DOUBLE * 500)))::BIGINT AS n_sample FROM cnt)"


@query(_STRATA + " SELECT stratum_k, count(*) AS n FROM st GROUP BY 1")
def first_hit_strata(spark, sf):
    return sampling.with_stratum(X.pairs(spark, sf), RULES).groupBy("stratum_k").agg(F.count("*").alias("n"))


@query(_ALLOC + " SELECT * FROM alloc")
def stratum_allocation(spark, sf):
    return sampling.allocation(sampling.with_stratum(X.pairs(spark, sf), RULES), 500)


@query(_ALLOC + ", r AS (SELECT st.stratum_k, k, k_2, n_sample, row_number() OVER (PARTITION BY st.stratum_k ORDER BY md5('42|' || k || '|' || k_2), k, k_2) AS i FROM st JOIN alloc ON st.stratum_k = alloc.stratum_k) SELECT stratum_k, k, k_2 FROM r WHERE i <= n_sample")
def stratified_sample(spark, sf):
    df = sampling.with_stratum(X.pairs(spark, sf).select("k", "k_2", *map(P.named, X.NAMES)), RULES)
    return sampling.stratified_sample(df, ["k", "k_2"], 500).select("stratum_k", "k", "k_2")


def _estimates(where: str) -> str:
    return f"sp AS (SELECT range::INT AS stratum_k FROM range({len(RULES)})), sc AS (SELECT stratum_k, count(*) AS n_total, count(label) AS n_labelled, count(*) FILTER (label) AS tp FROM st WHERE stratum_k >= 0 AND {where} GROUP BY 1), sx AS (SELECT sp.stratum_k, coalesce(n_total, 0) AS n_total, coalesce(n_labelled, 0) AS n_labelled, coalesce(tp, 0) AS tp FROM sp LEFT JOIN sc ON sp.stratum_k = sc.stratum_k), sq AS (SELECT *, CASE WHEN n_labelled > 0 THEN tp::DOUBLE / n_labelled END AS p_hat FROM sx), strat AS (SELECT *, CASE WHEN n_labelled > 0 THEN sqrt(p_hat * (1 - p_hat) / n_labelled) END AS se FROM sq)"


_OLD = "k % 2 = 0 AND (label IS NULL OR k % 3 = 0)"
_CUM = f"{_STRATA}, {_estimates(_OLD)}, cw AS (SELECT stratum_k AS m, sum(n_total) OVER w AS n, sum(CASE WHEN n_labelled > 0 THEN n_total::DOUBLE ELSE 0 END) OVER w AS w, sum(CASE WHEN n_labelled > 0 THEN n_total::DOUBLE * p_hat ELSE 0 END) OVER w AS wp, sum(CASE WHEN n_labelled > 0 THEN n_total::DOUBLE * n_total * se * se ELSE 0 END) OVER w AS wv FROM strat WINDOW w AS (ORDER BY stratum_k)), cum AS (SELECT m, CASE WHEN w > 0 THEN n ELSE 0 END::BIGINT AS n_1_to_m, CASE WHEN w > 0 THEN wp / w END AS p_strat, CASE WHEN w > 0 THEN sqrt(wv) / w END AS se_strat FROM cw)"
_LAB = f"lc AS (SELECT stratum_k AS m, count(*) AS n, count(*) FILTER (label) AS t FROM st WHERE stratum_k >= 0 AND label IS NOT NULL AND k % 2 = 1 GROUP BY 1), ls AS (SELECT stratum_k AS m, sum(coalesce(n, 0)) OVER (ORDER BY stratum_k)::BIGINT AS n_lab, sum(coalesce(t, 0)) OVER (ORDER BY stratum_k)::BIGINT AS tp_lab FROM (SELECT range::INT AS stratum_k FROM range({len(RULES)})) s LEFT JOIN lc ON s.stratum_k = lc.m), lab AS (SELECT *, CASE WHEN n_lab > 0 THEN tp_lab::DOUBLE / n_lab END AS p_lab FROM ls)"
_COMB = f"{_CUM}, {_LAB}, comb AS (SELECT lab.m, n_lab, n_1_to_m, CASE WHEN p_strat IS NOT NULL THEN n_lab + n_1_to_m ELSE n_lab END AS n_all, CASE WHEN p_strat IS NOT NULL THEN (n_lab * p_lab + n_1_to_m * p_strat) / (n_lab + n_1_to_m)::DOUBLE ELSE p_lab END AS p_combined, CASE WHEN p_strat IS NOT NULL THEN se_strat * (n_1_to_m / (n_lab + n_1_to_m)::DOUBLE) ELSE 0 END AS se_combined, p_strat IS NOT NULL AS has_historic_evidence FROM lab JOIN cum ON lab.m = cum.m)"
_ROUND = "round({0}, 9) AS {0}"


def _rounded(df: DataFrame) -> DataFrame:
    """Estimates to nine places: sums of squares may differ in the last."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes))


def _historic(spark, sf) -> DataFrame:
    return sampling.with_stratum(X.pairs(spark, sf), RULES).filter(_OLD)


def _recent(spark, sf) -> DataFrame:
    return sampling.with_stratum(X.pairs(spark, sf), RULES).filter("k % 2 = 1")


@query(f"{_STRATA}, {_estimates(_OLD)} SELECT stratum_k, n_total, n_labelled, tp, {_ROUND.format('p_hat')}, {_ROUND.format('se')} FROM strat")
def stratum_precision(spark, sf):
    return _rounded(strata.stratum_precision(_historic(spark, sf), len(RULES)))


@query(f"{_CUM} SELECT m, n_1_to_m, {_ROUND.format('p_strat')}, {_ROUND.format('se_strat')} FROM cum")
def cumulative_precision(spark, sf):
    return _rounded(strata.cumulative_precision(strata.stratum_precision(_historic(spark, sf), len(RULES))))


@query(f"{_STRATA}, {_LAB} SELECT m, n_lab, tp_lab, {_ROUND.format('p_lab')} FROM lab")
def labelled_cumulative(spark, sf):
    return _rounded(strata.labelled_cumulative(_recent(spark, sf), len(RULES)))


def _combined(spark, sf) -> DataFrame:
    old = strata.cumulative_precision(strata.stratum_precision(_historic(spark, sf), len(RULES)))
    return strata.combined_precision(strata.labelled_cumulative(_recent(spark, sf), len(RULES)), old)


@query(f"{_COMB} SELECT m, n_lab, n_1_to_m, n_all, {_ROUND.format('p_combined')}, {_ROUND.format('se_combined')}, has_historic_evidence FROM comb")
def combined_precision(spark, sf):
    return _rounded(_combined(spark, sf))


@query(f"{_COMB} SELECT m, n_all, round(n_all * p_combined, 6) AS tp_est, round(n_all * p_combined * 150.0::DOUBLE - n_all * 20.0::DOUBLE, 4) AS nv_est, round(n_all * se_combined * 150.0::DOUBLE, 4) AS se_nv FROM comb")
def expected_savings(spark, sf):
    out = strata.expected_savings(_combined(spark, sf), 150.0, COST)
    return out.select("m", "n_all", F.round("tp_est", 6).alias("tp_est"), F.round("nv_est", 4).alias("nv_est"), F.round("se_nv", 4).alias("se_nv"))


# runs


_TRAIN = f"""narrow AS MATERIALIZED (SELECT * FROM pairs WHERE {_BASE} AND (label IS NOT NULL OR (import_time >= TIMESTAMP '1997-01-01' AND import_time < TIMESTAMP '1999-01-01' AND import_time_2 >= TIMESTAMP '1997-01-01' AND import_time_2 < TIMESTAMP '1999-01-01'))),
census AS (SELECT count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n, count(*) FILTER (label IS NULL) AS u FROM narrow), wanted AS (SELECT greatest(0, trunc(p * (1 - 0.25::DOUBLE) / 0.25::DOUBLE)::BIGINT - n) AS want, u FROM census),
numbered AS (SELECT *, row_number() OVER (ORDER BY k, k_2) - 1 AS i FROM narrow), thinned AS (SELECT numbered.* EXCLUDE (i) FROM numbered, wanted WHERE label IS NOT NULL OR (want > 0 AND i % greatest(1, u // want) = 0)),
train AS MATERIALIZED (SELECT * EXCLUDE (i, size) FROM (SELECT *, row_number() OVER (PARTITION BY {_Y} ORDER BY md5('42|' || k || '|' || k_2), k, k_2) AS i, count(*) OVER (PARTITION BY {_Y}) AS size FROM thinned) WHERE i <= trunc(size * (1 - 0.2::DOUBLE)))"""


@query(f"{_TRAIN}, {_greedy('train', 50)}{_COMPOSED.format('cut')}")
def mining_run(spark, sf):
    config = X.Config(predicates=X.PREDICATES, filters=CONFIG.filters, learning=X.Learning(2, 50, 0.9, 5), positive_rate=0.25, test_split=0.2)
    return spark.createDataFrame(pipeline.mine(X.pairs(spark, sf), config).composition.rows(), M.Composition.SCHEMA)


def _evaluated(spark, sf) -> pipeline.EvaluationResult:
    amounts = X.documents(spark, sf).select("stack_id", "doc_id", "sub_doc_id", "reimbursement")
    return pipeline.evaluate(X.pairs(spark, sf), amounts, RULES, CONFIG)


def _evaluation() -> str:
    """The window with the amounts of the documents that the rules find, the steps on it, and the best of them."""
    keys = ("stack_id", "doc_id", "sub_doc_id")
    same = lambda t, s: " AND ".join(f"p.{k}{s} = {t}.{k}" for k in keys)
    window = f"""narrow AS (SELECT * FROM pairs WHERE {_BASE} AND {_WINDOW}),
flagged AS (SELECT {", ".join(keys)} FROM narrow WHERE {_any(RULES)} UNION SELECT {", ".join(k + "_2" for k in keys)} FROM narrow WHERE {_any(RULES)}),
amounts AS (SELECT {", ".join("docs." + k for k in keys)}, max(docs.reimbursement) AS amount FROM docs JOIN flagged USING ({", ".join(keys)}) GROUP BY ALL),
win AS MATERIALIZED (
  SELECT p.* EXCLUDE (reimbursement, reimbursement_2), a.amount AS reimbursement, b.amount AS reimbursement_2
  FROM narrow p LEFT JOIN amounts a ON {same("a", "")} LEFT JOIN amounts b ON {same("b", "_2")} WHERE least(a.amount, b.amount) IS NULL OR least(a.amount, b.amount) > 1000
)"""
    return f"{window}, {_STEPWISE.replace('FROM pairs', 'FROM win')}, best AS (SELECT * FROM nv ORDER BY nv_total DESC, m LIMIT 1)"


_SPLIT = ", ".join(f"count(*) FILTER (stack_id {op} stack_id_2 AND {what})::DOUBLE AS {side}_stack_{name}" for side, op in (("in", "="), ("out", "<>")) for name, what in (("total_positives", _Y), ("pos_pred", "chosen"), ("true_positives", f"chosen AND {_Y}")))


@query(
    _evaluation()
    + f""", judged AS (SELECT *, {_first(RULES)} BETWEEN 0 AND (SELECT m FROM best) AS chosen FROM win), split AS (SELECT {_SPLIT}, count(*)::DOUBLE AS window_total_pairs, count(*) FILTER ({_Y})::DOUBLE AS window_total_positives FROM judged)
SELECT (m + 1)::DOUBLE AS optimum_step, pp::DOUBLE AS optimum_pos_pred_pair_count, tp::DOUBLE AS optimum_true_positive_pair_count, savings_total AS optimum_total_savings, savings_paid AS optimum_paid_out_savings,
  nv_total AS optimum_net_value_total, nv_paid AS optimum_net_value_paid_out, split.* FROM best, split"""
)
def evaluation_metrics(spark, sf):
    return _evaluated(spark, sf).metrics


def _undominated(rules) -> str:
    """left_over: rules of the best prefix that no other one of it dominates, of equal ones the first."""
    group_of, loose = P.build_lookups(X.GROUPS)
    rows = _rows([(i, p, group_of[p], loose[p], len(r)) for i, r in enumerate(rules) for p in r])
    return f"""rp AS (SELECT t.* FROM {rows} AS t(rule_id, predicate, grp, loose, n), best WHERE rule_id <= best.m), ids AS (SELECT DISTINCT rule_id, n FROM rp),
dom AS (SELECT a.rule_id AS i, b.rule_id AS j FROM ids a, ids b WHERE a.rule_id <> b.rule_id AND a.n <= b.n AND NOT EXISTS (SELECT 1 FROM rp x WHERE x.rule_id = a.rule_id AND NOT EXISTS (SELECT 1 FROM rp y WHERE y.rule_id = b.rule_id AND y.grp = x.grp AND x.loose >= y.loose))),
left_over AS (SELECT rule_id FROM ids WHERE NOT EXISTS (SELECT 1 FROM dom d WHERE d.j = ids.rule_id AND (d.i < d.j OR NOT EXISTS (SELECT 1 FROM dom e WHERE e.i = d.j AND e.j = d.i))))"""


@query(f"{_evaluation()}, {_undominated(RULES)}, {_pruned(RULES, '(SELECT list(rule_id ORDER BY rule_id)::INT[] FROM left_over)', 'win')} SELECT (row_number() OVER (ORDER BY kept.rule_id) - 1)::INT AS place, rule FROM kept JOIN {_names(RULES)} ON t.rule_id = kept.rule_id")
def optimum_rules(spark, sf):
    return spark.createDataFrame([(i, " & ".join(r)) for i, r in enumerate(_evaluated(spark, sf).optimum_rules)], "place int, rule string")


_HISTORIC = f"st AS (SELECT k, k_2, ({_SIM})::INT AS sum_sim, {_first(RULES)} AS stratum_k FROM pairs WHERE {_BASE} AND label IS NULL AND import_time >= TIMESTAMP '1998-11-01' AND import_time < TIMESTAMP '1998-12-01' AND import_time_2 >= TIMESTAMP '1996-11-01' AND import_time_2 < TIMESTAMP '1998-10-01')"


@query(_ALLOC.replace(_STRATA, _HISTORIC).replace("* 500)", f"* {CONFIG.sample_size})") + ", r AS (SELECT st.stratum_k, k, k_2, sum_sim, n_sample, row_number() OVER (PARTITION BY st.stratum_k ORDER BY md5('42|' || k || '|' || k_2), k, k_2) AS i FROM st JOIN alloc ON st.stratum_k = alloc.stratum_k) SELECT k, k_2, stratum_k, sum_sim FROM r WHERE i <= n_sample AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.k = r.k AND p.k_2 = r.k_2 AND p.label IS NOT NULL)")
def review_sample(spark, sf):
    pairs = X.pairs(spark, sf)
    labels = pairs.filter("label IS NOT NULL").select("k", "k_2", F.col("label").alias("other_label"))
    return pipeline.review_sample(pairs, RULES, CONFIG, labels).select("k", "k_2", "stratum_k", "sum_sim")
