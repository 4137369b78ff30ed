"""Rule mining over compressed predicate patterns.

Every statistic of mining is a sum over rows of a function of (predicate bits, label).
So one aggregation by the bits, with counts of rows and of positives, is a lossless and
small input for all later steps, however many rows there were.  Candidate lists are
bounded and live on the driver; patterns stay a table.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.functions.predicates import Groups, Rule, build_lookups, truth
from pairsmith.operators import fired
from pairsmith.sources import interim

log = logging.getLogger(__name__)
_WORD = 62
#: Candidate rules that are counted at a time.
CHUNK = 20_000


@dataclass(frozen=True)
class Candidate:
    """A rule with its counts on the training rows."""

    predicates: Rule
    true_positives: int
    positive_predictions: int

    @property
    def precision(self) -> float:
        return self.true_positives / self.positive_predictions if self.positive_predictions else 0.0


@dataclass
class Composition:
    """Chosen rules and the cumulative figures after each."""

    rules: list[Rule] = field(default_factory=list)
    precision: list[float] = field(default_factory=list)
    recall: list[float] = field(default_factory=list)
    true_positives: list[int] = field(default_factory=list)
    positive_predictions: list[int] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        return [(i, " & ".join(r), p, q, t, n) for i, (r, p, q, t, n) in enumerate(zip(self.rules, self.precision, self.recall, self.true_positives, self.positive_predictions, strict=True))]

    SCHEMA = "step int, rule string, precision double, recall double, tp long, pp long"


class Patterns:
    """(bits0, bits1, ..., n, n_pos): one row for each combination of predicate values that occurs."""

    def __init__(self, pairs: DataFrame, names: Sequence[str], label: str = "label"):
        self.place = {p: i for i, p in enumerate(names)}
        words = [[p for p in names if self.place[p] // _WORD == w] for w in range(max(1, -(-len(names) // _WORD)))]
        bits = [sum((F.when(truth(p), F.lit(1 << self.place[p] % _WORD)).otherwise(F.lit(0)).cast("long") for p in word), F.lit(0).cast("long")).alias(f"bits{w}") for w, word in enumerate(words)]
        self.columns = [f"bits{w}" for w in range(len(words))]
        table = pairs.select(*bits, truth(label).alias("y")).groupBy(*self.columns).agg(F.count("*").alias("n"), F.count_if("y").alias("n_pos"))
        self.table = interim.stored(table, "patterns")
        self.spark = pairs.sparkSession

    def masks(self, rule: Rule) -> list[int]:
        out = [0] * len(self.columns)
        for p in rule:
            out[self.place[p] // _WORD] |= 1 << self.place[p] % _WORD
        return out

    def fires(self, rule: Rule) -> Column:
        out = F.lit(True)
        for c, m in zip(self.columns, self.masks(rule), strict=True):
            if m:
                out = out & (F.col(c).bitwiseAND(F.lit(m)) == m)
        return out

    def positives(self) -> int:
        return self.table.agg(F.sum("n_pos")).first()[0] or 0

    def places(self, rules: Sequence[Rule]) -> list[list[int]]:
        return [[self.place[p] for p in r] for r in rules]

    def counts(self, rules: Sequence[Rule], where: Column | None = None) -> list[tuple[int, int]]:
        """(true positives, positive predictions) of each rule over the patterns that meet ``where``."""
        if not rules:
            return []
        table = self.table if where is None else self.table.filter(where)
        found = {r.rule_id: (r.tp, r.pp) for r in fired.counted(table, self.columns, _WORD, self.places(rules)).collect()}
        return [found.get(i, (0, 0)) for i in range(len(rules))]

    def fired(self, rules: Sequence[Rule]) -> DataFrame:
        """(rules, n_pos, n): which of the rules fire on each pattern on which any does."""
        return fired.indexed(self.table, self.columns, _WORD, self.places(rules))


def candidate_rules(patterns: Patterns, groups: Groups, max_predicates: int = 2, min_new_tp: int = 5) -> list[Candidate]:
    """Rules level by level; a rule is only extended by predicates of later groups, and only while its support suffices.

    A level is counted in chunks of ``CHUNK`` rules: the driver holds those of one chunk and
    those that survived.
    """
    group_of, _ = build_lookups(groups)
    names = [p for _, own in groups for p in own]
    out: list[Candidate] = []
    level: Iterator[Rule] = ((p,) for p in names)
    for size in range(1, max(1, max_predicates) + 1):
        survivors: list[Rule] = []
        for chunk in itertools.batched(level, CHUNK):
            for rule, (tp, pp) in zip(chunk, patterns.counts(chunk), strict=True):
                if tp >= min_new_tp:
                    survivors.append(rule)
                    out += [Candidate(rule, tp, pp)] if pp > 0 else []
        if not survivors or size == max_predicates:
            break
        level = ((*r, p) for r in survivors for p in names if group_of[p] > group_of[r[-1]])
    return out


def cut_candidates(candidates: list[Candidate], most: int) -> list[Candidate]:
    """The first ``most`` by true positives; order only changes where the limit is exceeded."""
    return candidates if len(candidates) <= most else sorted(candidates, key=lambda c: -c.true_positives)[:most]


def diverse_candidates(candidates: list[Candidate], most: int) -> list[Candidate]:
    """The best half by precision and the best half by true positives, in their old order."""
    if len(candidates) <= most:
        return candidates
    half = most // 2
    chosen = {i for key in (lambda c: -c.precision, lambda c: -c.true_positives) for i in sorted(range(len(candidates)), key=lambda i: key(candidates[i]))[:half]}
    return [c for i, c in enumerate(candidates) if i in chosen]


def merge_most_frequent_pair(rules: Sequence[Rule]) -> list[Rule]:
    """Rules that share the most frequent pair of predicates become one with all their predicates; recall may fall."""
    together = Counter(pair for r in rules for pair in itertools.combinations(sorted(r), 2))
    if not together or (top := together.most_common(1)[0])[1] < 2:
        return list(rules)
    sharing = [r for r in rules if set(top[0]) <= set(r)]
    merged = tuple(dict.fromkeys(p for r in sharing for p in r))
    return [merged if r is sharing[0] else r for r in rules if r is sharing[0] or r not in sharing]


#: (Pattern, rule) entries that the driver holds for the greedy composition; of more, each step is a job.
MOST_ENTRIES = 5_000_000


def find_composition(candidates: Sequence[Candidate], patterns: Patterns, min_recall: float = 0.99, min_new_tp: int = 5, most_entries: int = MOST_ENTRIES) -> Composition:
    """Greedy OR by cumulative precision until the target recall.

    Which rules fire on a pattern is found once and stored.  Each rule's count of what is not
    yet covered is kept on the driver; a step lowers the counts by the patterns that its rule
    newly covers, each of which is met once in all steps.
    """
    total = patterns.positives()
    if not total or not candidates:
        return Composition()
    with interim.scope(patterns.spark):
        index = interim.stored(patterns.fired([c.predicates for c in candidates]), "fired")
        entries = index.agg(F.sum(F.size("rules"))).first()[0] or 0
        cover = _Held(index, len(candidates)) if entries <= most_entries else _Stored(index)
        return _greedy(candidates, cover, total, min_recall, min_new_tp)


def _sums(index: DataFrame) -> dict[int, tuple[int, int]]:
    """rule -> (true positives, positive predictions) over the rows."""
    each = index.select(F.explode("rules").alias("rule"), "n_pos", "n").groupBy("rule").agg(F.sum("n_pos").alias("n_pos"), F.sum("n").alias("n"))
    return {r.rule: (r.n_pos, r.n) for r in each.collect()}


class _Stored:
    """The index as a stored table; covered patterns are left out of it whenever they have become the greater part."""

    def __init__(self, index: DataFrame):
        self.index, self.since, self.covered = index, [], 0
        self.counts = _sums(index)
        self.rows = sum(n for _, n in self.counts.values())

    def _fresh(self) -> Column:
        """Not yet covered; names the rules since the table was last stored, however many steps there were."""
        return ~F.arrays_overlap("rules", F.lit(self.since).cast("array<int>")) if self.since else F.lit(True)

    def by(self, rule: int) -> dict[int, tuple[int, int]]:
        """What the rule newly covers, for each rule that fires there too."""
        found = _sums(self.index.filter(F.array_contains("rules", rule) & self._fresh()))
        self.since.append(rule)
        self.covered += sum(n for _, n in found.values())
        if 2 * self.covered > self.rows:
            self.index = interim.stored(self.index.filter(self._fresh()), "fired")
            self.rows, self.covered, self.since = self.rows - self.covered, 0, []
        return found


class _Held:
    """The index as arrays, for few entries: those of each pattern, and the patterns of each rule."""

    def __init__(self, index: DataFrame, n_rules: int):
        table = index.toArrow().combine_chunks()
        rules = table.column("rules").combine_chunks()
        self.start, self.rules = rules.offsets.to_numpy(), rules.values.to_numpy()
        self.weights = np.stack([table.column(c).to_numpy() for c in ("n_pos", "n")])
        self.fresh = np.ones(table.num_rows, dtype=bool)
        self.of = np.repeat(np.arange(table.num_rows), np.diff(self.start))
        order = np.argsort(self.rules, kind="stable")
        self.patterns, self.first = self.of[order], np.searchsorted(self.rules[order], np.arange(n_rules + 1))
        self.counts = self._sums(np.arange(len(self.rules)))

    def _sums(self, entries: np.ndarray) -> dict[int, tuple[int, int]]:
        some, at = np.unique(self.rules[entries], return_inverse=True)
        sums = np.zeros((2, len(some)), dtype=np.int64)
        for k in (0, 1):
            np.add.at(sums[k], at, self.weights[k][self.of[entries]])
        return dict(zip(some.tolist(), zip(*sums.tolist(), strict=True), strict=True))

    def by(self, rule: int) -> dict[int, tuple[int, int]]:
        own = self.patterns[self.first[rule] : self.first[rule + 1]]
        own = own[self.fresh[own]]
        self.fresh[own] = False
        sizes = self.start[own + 1] - self.start[own]
        entries = np.repeat(self.start[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(own) else np.arange(0)
        return self._sums(entries.astype(np.int64))


def _greedy(candidates: Sequence[Candidate], cover: _Stored | _Held, total: int, min_recall: float, min_new_tp: int) -> Composition:
    out, target = Composition(), math.ceil(min_recall * total)
    left = dict(cover.counts)
    tp = pp = 0
    while tp < target:
        need = max(min_new_tp, int((target - tp) * 0.01))
        best = None
        for i in sorted(left):
            new_tp, new_pp = left[i]
            if new_tp >= max(1, need) and (best is None or (tp + new_tp) / (pp + new_pp) > best[0]):
                best = ((tp + new_tp) / (pp + new_pp), i, new_tp, new_pp)
        if best is None:
            break
        precision, i, new_tp, new_pp = best
        tp, pp = tp + new_tp, pp + new_pp
        rule = candidates[i].predicates
        out.rules.append(rule)
        out.precision.append(precision)
        out.recall.append(tp / total)
        out.true_positives.append(tp)
        out.positive_predictions.append(pp)
        log.info("step %d: %s, precision %.4f, recall %.4f", len(out.rules), " & ".join(rule), precision, tp / total)
        if tp >= target:
            break
        for r, (a, b) in cover.by(i).items():
            if r in left:
                left[r] = (left[r][0] - a, left[r][1] - b)
        left = {r: (a, b) for r, (a, b) in left.items() if a and r != i}
    return out


def dominates(a: Rule, b: Rule, group_of: dict[str, int], looseness: dict[str, int]) -> bool:
    """a fires wherever b does, by the order of thresholds: each predicate of a has a stricter or equal one in b."""
    strictness = {group_of[p]: looseness[p] for p in b if p in group_of}
    return all(p in group_of and group_of[p] in strictness and looseness[p] >= strictness[group_of[p]] for p in a)


def remove_subsumed(rules: Sequence[Rule], groups: Groups) -> list[Rule]:
    """Without rules that a shorter or equally long rule dominates; of identical rules the first stays.

    A rule that dominates has, in some of the other's groups, a predicate as loose or looser.
    There are few such combinations for short rules, and each is looked up; where they are
    more than the rules, the rules are gone through instead.
    """
    lookups = group_of, looseness = build_lookups(groups)
    levels = [len(names) for _, names in groups]
    index: dict[frozenset[tuple[int, int]], list[int]] = {}
    for i, r in enumerate(rules):
        if all(p in group_of for p in r):
            tightest: dict[int, int] = {}
            for p in r:
                tightest[group_of[p]] = min(looseness[p], tightest.get(group_of[p], looseness[p]))
            index.setdefault(frozenset(tightest.items()), []).append(i)

    def dominators(j: int) -> Iterator[int]:
        own = {group_of[p]: looseness[p] for p in rules[j] if p in group_of}
        choices = [[None, *((g, x) for x in range(least, levels[g]))] for g, least in own.items()]
        if math.prod(map(len, choices)) > len(rules):
            return (i for i in range(len(rules)) if dominates(rules[i], rules[j], *lookups))
        return (i for choice in itertools.product(*choices) for i in index.get(frozenset(x for x in choice if x), ()))

    def goes(j: int) -> bool:
        shorter = (i for i in dominators(j) if i != j and len(rules[i]) <= len(rules[j]))
        return any(i < j or len(rules[i]) < len(rules[j]) or not dominates(rules[j], rules[i], *lookups) for i in shorter)

    return [r for j, r in enumerate(rules) if not goes(j)]


def unique_true_positives(rules: Sequence[Rule], patterns: Patterns) -> list[int]:
    """For each rule the positives that no other rule of the list covers."""
    if not rules:
        return []
    alone = patterns.fired(rules).filter(F.size("rules") == 1).select(F.col("rules")[0].alias("i"), "n_pos").collect()
    found = {r.i: r.n_pos for r in alone}
    return [found.get(i, 0) for i in range(len(rules))]


#: Different sets of rules that cover a positive, as the driver holds them for pruning.
MOST_SETS = 1_000_000


def remove_redundant(rules: Sequence[Rule], patterns: Patterns, most_sets: int = MOST_SETS) -> list[Rule]:
    """Again and again without the first rule that covers no positive alone.

    Removing a rule leaves the others no fewer positives of their own, so one pass over the
    rules finds them all: a rule stays if some positive has it as the last of its rules and
    all its others were removed.  That takes one job, which finds the different sets of rules
    on positives.  Where there are more sets than the driver is to hold, each removal asks anew.
    """
    if not rules:
        return []
    sets = patterns.fired(rules).filter("n_pos > 0").select("rules").limit(most_sets + 1).toArrow().column(0)
    if len(sets) > most_sets:
        return _remove_one_by_one(rules, patterns)
    last: dict[int, list[list[int]]] = {}
    for own in sets.to_pylist():
        last.setdefault(own[-1], []).append(own[:-1])
    removed: set[int] = set()
    for i in range(len(rules)):
        if not any(removed.issuperset(others) for others in last.get(i, ())):
            removed.add(i)
    return [r for i, r in enumerate(rules) if i not in removed]


def _remove_one_by_one(rules: Sequence[Rule], patterns: Patterns) -> list[Rule]:
    left = list(rules)
    while (idle := next((i for i, n in enumerate(unique_true_positives(left, patterns)) if n == 0), None)) is not None:
        del left[idle]
    return left


def beam_composition(candidates: Sequence[Candidate], patterns: Patterns, min_recall: float = 0.99, min_new_tp: int = 5, width: int = 4) -> Composition:
    """Beam search over compositions: the ``width`` best sets by cumulative precision are extended side by side."""
    total = patterns.positives()
    if not total:
        return Composition()
    target = math.ceil(min_recall * total)
    beam: list[Composition] = [Composition()]
    while True:
        reached = [c for c in beam if c.rules and c.true_positives[-1] >= target]
        if reached:
            return max(reached, key=lambda c: c.precision[-1])
        states: dict[frozenset, Composition] = {}
        for c in beam:
            tp, pp = (c.true_positives[-1], c.positive_predictions[-1]) if c.rules else (0, 0)
            uncovered = F.lit(True)
            for r in c.rules:
                uncovered = uncovered & ~patterns.fires(r)
            rest = [x.predicates for x in candidates if x.predicates not in c.rules]
            for r, (a, b) in zip(rest, patterns.counts(rest, uncovered), strict=True):
                if a >= min_new_tp:
                    extended = Composition([*c.rules, r], [*c.precision, (tp + a) / (pp + b)], [*c.recall, (tp + a) / total], [*c.true_positives, tp + a], [*c.positive_predictions, pp + b])
                    states.setdefault(frozenset(extended.rules), extended)
        if not states:
            return beam[0]
        beam = sorted(states.values(), key=lambda c: -c.precision[-1])[:width]


@dataclass(frozen=True)
class Exact:
    """The best composition: the rules' places, and its counts."""

    chosen: tuple[int, ...]
    true_positives: int
    positive_predictions: int


#: Rules that the exact search chooses from: their sets are bits of one number.
MOST_RULES = 62
#: Nodes of the search that stay on the driver until they are dealt out, and nodes that a task goes through before it reports.
_SPREAD = 256
_STEP = 20_000


def _union(fired_sets: np.ndarray, n_pos: np.ndarray, n: np.ndarray, masks: Sequence[int]) -> np.ndarray:
    """(tp, pp) of each set of rules."""
    out = np.empty((len(masks), 2), dtype=np.int64)
    for k, m in enumerate(masks):
        hit = (fired_sets & np.int64(m)) != 0
        out[k] = n_pos[hit].sum(), n[hit].sum()
    return out


def _better(a: tuple[int, int, int], b: tuple[int, int, int] | None) -> bool:
    """(tp, pp, mask): greater precision, then more true positives, then fewer rules, then the earlier ones."""
    if b is None:
        return True
    key = lambda x: (-x[0], x[2].bit_count(), [i for i in range(MOST_RULES) if x[2] >> i & 1])
    left, right = a[0] * b[1], b[0] * a[1]
    return left > right or (left == right and key(a) < key(b))


def _search(data: tuple[np.ndarray, np.ndarray, np.ndarray], order: Sequence[int], target: int, best: tuple[int, int, int] | None, nodes: list[tuple[int, int]], most: int) -> tuple[tuple[int, int, int] | None, list[tuple[int, int]]]:
    """Depth first over (mask, depth) for at most ``most`` nodes: the best set, and the nodes that are left.

    A node has decided on the first rules of ``order``.  No set below it has more true
    positives than it has with all rules that are left, nor fewer false ones than it has
    now; so both its recall and its precision are bounded.
    """
    rest = [0] * (len(order) + 1)
    for d in reversed(range(len(order))):
        rest[d] = rest[d + 1] | 1 << order[d]
    while nodes and most > 0:
        most -= 1
        mask, depth = nodes.pop()
        (tp, pp), (reach, _) = _union(*data, [mask, mask | rest[depth]]).tolist()
        if mask and tp >= target and _better((tp, pp, mask), best):
            best = (tp, pp, mask)
        if depth == len(order) or reach < target or (best and reach * best[1] < best[0] * (pp - tp + reach)):
            continue
        nodes += [(mask, depth + 1), (mask | 1 << order[depth], depth + 1)]
    return best, nodes


def exact_composition(rules: Sequence[Rule], patterns: Patterns, min_recall: float = 0.9, most_sets: int = MOST_SETS) -> Exact | None:
    """The OR of some of the rules with the greatest precision among those that reach the recall, by branch and bound.

    On equal precision more true positives win, then fewer rules, then earlier ones.  None if
    all rules together fall short of the recall, or there are no positives.  Which rules fire
    on a pattern is all that counts; the different sets of them, with their counts, go to every
    task, so they must be at most ``most_sets``.  The open nodes of the search are a table: tasks search some nodes on and
    return the best set and the nodes that they left open, and every round starts from the best set of the one before.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    total = patterns.positives()
    if not rules or not total:
        return None
    target, spark = math.ceil(min_recall * total), patterns.spark
    mask = F.aggregate("rules", F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    sets = patterns.fired(rules).select(mask.alias("mask"), "n_pos", "n").limit(most_sets + 1).toArrow()
    if sets.num_rows > most_sets:
        raise ValueError(f"more than {most_sets} sets of rules that fire together: raise most_sets or give fewer rules")
    data = tuple(sets.column(c).to_numpy() for c in ("mask", "n_pos", "n"))
    alone = _union(*data, [1 << i for i in range(len(rules))]).tolist()
    # precise rules first, so that good sets are found early
    order = sorted(range(len(rules)), key=lambda i: (-(alone[i][0] / alone[i][1] if alone[i][1] else 0), i))
    best, nodes = None, [(0, 0)]
    while nodes and len(nodes) < _SPREAD and best is None:
        best, nodes = _search(data, order, target, best, nodes, _STEP)
    shared = spark.sparkContext.broadcast(data)
    schema = "mask long, depth int, tp long, pp long"

    def rounds(nodes: DataFrame, best: tuple[int, int, int] | None) -> DataFrame:
        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Nodes left open, and the best set with depth -1."""
            mine = best
            for batch in batches:
                found, left = _search(shared.value, order, target, mine, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), _STEP)
                mine = found
                rows = [(m, d, 0, 0) for m, d in left] + ([(found[2], -1, found[0], found[1])] if found else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["mask", "depth", "tp", "pp"])

        return nodes.mapInArrow(searched, schema)

    with interim.scope(spark):
        open_nodes = spark.createDataFrame(nodes, "mask long, depth int") if nodes else None
        while open_nodes is not None:
            after = interim.stored(rounds(open_nodes.repartition(spark.sparkContext.defaultParallelism), best), "search")
            for r in after.filter("depth = -1").distinct().toLocalIterator():  # one for each task at most
                best = (r.tp, r.pp, r.mask) if _better((r.tp, r.pp, r.mask), best) else best
            open_nodes = after.filter("depth >= 0").select("mask", "depth")
            if open_nodes.isEmpty():
                break
    shared.destroy()
    return Exact(tuple(i for i in range(len(rules)) if best[2] >> i & 1), best[0], best[1]) if best else None
