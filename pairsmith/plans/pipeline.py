"""The runs: mine rules, evaluate a composition in money, draw a sample for review."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsmith.config import Config
from pairsmith.functions import predicates as P
from pairsmith.operators import evaluate as E
from pairsmith.operators import mining as M
from pairsmith.operators import money, sampling
from pairsmith.plans import reports
from pairsmith.sources import interim
from pairsmith.sources import pairs as S


@dataclass
class MiningResult:
    candidates: list[M.Candidate]
    composition: M.Composition
    metrics: dict[str, float]


@dataclass
class EvaluationResult:
    """optimum_step counts from 0 here and from 1 in the metrics; None without any rule."""

    steps: DataFrame
    optimum_step: int | None
    optimum_rules: list[P.Rule]
    metrics: DataFrame
    reports: dict[str, DataFrame]


def mine(pairs: DataFrame, config: Config, keys: Sequence[str] = ("k", "k_2")) -> MiningResult:
    """Filter, downsample, split, compress to patterns, mine, cut off and compose."""
    groups = P.build_groups(config.predicates)
    names = [p for _, own in groups for p in own]
    # the rows are dealt out in order twice; only these columns go with them
    wanted = dict.fromkeys([*keys, config.columns.label, *names])
    rows = pairs.filter(S.train_filter(config.filters, config.columns)).select(*map(P.named, wanted))
    rows = sampling.downsample(rows, keys, config.positive_rate, config.columns.label)
    rows = sampling.train_test_split(rows, keys, config.test_split, config.seed, config.columns.label)
    patterns = M.Patterns(rows.filter("is_train"), names, config.columns.label)
    learning = config.learning
    found = M.candidate_rules(patterns, groups, learning.max_predicates_per_rule, learning.min_new_tp)
    found = M.cut_candidates(found, learning.max_candidate_rules)
    composition = M.find_composition(found, patterns, learning.min_recall, learning.min_new_tp)
    n, p = patterns.table.agg(F.sum("n"), F.sum("n_pos")).first()
    last = lambda x: x[-1] if x else 0
    metrics = {
        "train_pair_count": n or 0,
        "train_total_positives": p or 0,
        "train_pos_pred_pair_count": last(composition.positive_predictions),
        "train_true_positive_count": last(composition.true_positives),
        "train_precision": last(composition.precision),
        "train_recall": last(composition.recall),
        "greedy_rule_count": len(composition.rules),
    }
    return MiningResult(found, composition, metrics)


def evaluate(pairs: DataFrame, dimension: DataFrame | None, rules: Sequence[P.Rule], config: Config, enrich: str = "flagged") -> EvaluationResult:
    """Evaluate prefixes of a composition on the window.

    dimension: amounts of documents, or None if the pairs hold them.  enrich 'flagged'
    looks up the documents of found pairs only, 'all' those of every pair.
    """
    c = config.columns
    rules = [tuple(r) for r in rules]
    window = pairs.filter(S.base_filter(config.filters, c))
    if config.filters.window:
        window = window.filter(S.window_filter(config.filters, c))
    if dimension is not None:
        documents = money.flagged_documents(window, rules if enrich == "flagged" else [()], c)
        window = money.join_money(window, money.enriched(documents, dimension, c), c)
    window = interim.stored(window.filter(S.min_reimbursement_filter(config.min_reimbursement_threshold, c)), "window")
    spark = window.sparkSession
    groups = P.build_groups(config.predicates)
    positives = window.filter(P.truth(c.label)).count()
    if rules:
        steps = interim.stored(money.stepwise_net_value(window, rules, config.review_cost, c), "steps")
        best = money.optimum(steps).first()
        optimum_step = best.m
        prefix = rules[: optimum_step + 1]
        patterns = M.Patterns(window, [p for _, own in groups for p in own], c.label)
        chosen = M.remove_redundant(M.remove_subsumed(prefix, groups), patterns)
    else:
        steps = spark.createDataFrame([], "m int, pp long, tp long, savings_total double, savings_paid double, nv_total double, nv_paid double")
        best, optimum_step, prefix, chosen = None, None, [], []
    figures = {
        "optimum_step": float(optimum_step + 1 if optimum_step is not None else 0),
        "optimum_pos_pred_pair_count": float(best.pp if best else 0),
        "optimum_true_positive_pair_count": float(best.tp if best else 0),
        "optimum_total_savings": best.savings_total if best else 0.0,
        "optimum_paid_out_savings": best.savings_paid if best else 0.0,
        "optimum_net_value_total": best.nv_total if best else 0.0,
        "optimum_net_value_paid_out": best.nv_paid if best else 0.0,
        "window_total_pairs": float(window.count()),
        "window_total_positives": float(positives),
    }
    metrics = E.stack_split(window, prefix, c).select(*(F.lit(v).alias(k) for k, v in figures.items()), "*")
    plots = {
        "precision_recall": reports.precision_recall(steps, positives, optimum_step),
        "net_value": steps,
        "class_heatmap": E.class_table(window, prefix, c),
        "time_difference": reports.time_histogram(window, prefix, c),
        "savings_by_time": reports.savings_by_time(window, prefix, c),
    }
    return EvaluationResult(steps, optimum_step, chosen, metrics, plots)


def run(pairs: DataFrame, dimension: DataFrame | None, config: Config, keys: Sequence[str] = ("k", "k_2")) -> tuple[MiningResult, EvaluationResult]:
    """Mine on the training rows, then evaluate what was found on the window."""
    mined = mine(pairs, config, keys)
    evaluated = evaluate(pairs, dimension, mined.composition.rules, config)
    mined.metrics["optimum_rule_count"] = len(evaluated.optimum_rules)
    return mined, evaluated


def review_sample(pairs: DataFrame, rules: Sequence[P.Rule], config: Config, labelled: DataFrame | None = None, keys: Sequence[str] = ("k", "k_2")) -> DataFrame:
    """Unlabelled historic pairs that the rules find, sampled by first rule, most similar first.

    labelled: (keys, other_label) of labels collected elsewhere; rows with one of them false, or all known, go.
    """
    rows = pairs.filter(S.base_filter(config.filters, config.columns) & S.historic_filter(config.filters, config.columns))
    rows = sampling.with_stratum(rows, rules).filter("stratum_k >= 0")
    rows = rows.withColumn("sum_sim", P.similarity_sum(rows))
    out = sampling.stratified_sample(rows, keys, config.sample_size, config.seed)
    if labelled is not None:
        out = out.join(labelled, list(keys), "left").filter(S.nowhere_labelled([config.columns.label, "other_label"]))
    return out.orderBy(F.desc("sum_sim"), *keys)
