"""Predicates, rules and compositions as column expressions.

A predicate is one boolean column.  A rule is an AND of predicates, a composition an OR
of rules.  A group holds one feature's predicates from strict to loose.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Groups = list[tuple[str, list[str]]]
Rule = tuple[str, ...]

#: Configuration section, prefix of the names, and whether larger thresholds are stricter.
FAMILIES = (("calculate_equality", "eq", None), ("calculate_lev_dist", "dist", False), ("calculate_proportion", "prop", True), ("calculate_overlap", "overlap", True))


def build_groups(config: dict) -> Groups:
    """One group for each feature and family, in the order of the families; a missing section is empty."""
    groups: Groups = []
    for section, prefix, larger_is_stricter in FAMILIES:
        entries = config.get(section) or {}
        if larger_is_stricter is None:
            groups += [(f, [f"{prefix}_{f}"]) for f in entries]
            continue
        for feature, thresholds in entries.items():
            values = sorted((t["thresh"] if isinstance(t, dict) else t for t in thresholds), reverse=larger_is_stricter)
            groups.append((feature, [f"{prefix}_{t}_{feature}" for t in values]))
    return groups


def build_lookups(groups: Groups) -> tuple[dict[str, int], dict[str, int]]:
    """(predicate -> group index, predicate -> looseness)."""
    places = [(p, g, i) for g, (_, names) in enumerate(groups) for i, p in enumerate(names)]
    return {p: g for p, g, _ in places}, {p: i for p, _, i in places}


def named(name: str) -> Column:
    """A column by its whole name; names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def truth(name: str) -> Column:
    """The column as a boolean, null as false."""
    return F.coalesce(named(name).cast("boolean"), F.lit(False))


def fires(rule: Sequence[str]) -> Column:
    """All predicates of the rule hold; the empty rule holds everywhere."""
    return reduce(operator.and_, map(truth, rule), F.lit(True))


def any_fires(rules: Sequence[Sequence[str]]) -> Column:
    """Some rule holds; of no rules none does."""
    return reduce(operator.or_, map(fires, rules), F.lit(False))


def first_hit(rules: Sequence[Sequence[str]]) -> Column:
    """Index of the first rule that holds, or -1."""
    return F.coalesce(*(F.when(fires(r), F.lit(i)) for i, r in enumerate(rules)), F.lit(-1)).cast("int")


def columns_like(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def similarity_sum(df: DataFrame, prefixes: Sequence[str] = ("eq", "overlap", "dist")) -> Column:
    """How many predicates of these families hold, null as none; proportions are not counted."""
    return reduce(operator.add, (F.coalesce(named(c).cast("int"), F.lit(0)) for c in columns_like(df, *prefixes)), F.lit(0)).alias("sum_sim")


# The families' values.


def equality(a: Column, b: Column) -> Column:
    return a == b


def distance_within(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b) <= most


def proportion_at_least(a: Column, b: Column, least: float) -> Column:
    return F.try_divide(F.least(a, b), F.greatest(a, b)) >= least


def overlap_at_least(a: Column, b: Column, share: float) -> Column:
    """Common members over the smaller list; a share of 0 asks for any common member; null if a list is."""
    common = F.size(F.array_intersect(a, b))
    held = common > 0 if share == 0 else common >= share * F.least(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), held)
