"""Quality rules as learned decision lists, in DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds on measures of a text.
It grows by the condition that separates bad from good best among the rows that it
covers (labelled rows of the growing part), loses trailing conditions that do not
help on the pruning part, and is kept if precise enough there.  The rows that it
covers are then set aside for the next rule.  The list becomes one ordered
``when(...).when(...).otherwise(...)`` expression.

Only labelled statistics reach the driver: counts for each measure and bucket.

Null text has no words.  A text of any length is measured whole, as arrays of its words
within one row.  Texts of one word, empty tables and tables without labels give
defined results: no labels, no learned rules.  Rows are judged one by one, so repeated
rows get equal verdicts.  The row's own columns travel in a struct and cannot clash.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.sources import interim

#: Labelled rows that rules are learned from, the first by a hash of the identifier.
LABELLED_ROWS = 20_000
_WHITE = " \t\n\x0b\x0c\r"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """(row struct, base measures): one pass over the text of each row, no shuffle."""
    t = F.col("t")
    out = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim(t, F.lit(_WHITE))
    out = out.select("row", "t", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "").alias("lines"))
    out = out.select("row", "t", "words", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    w = F.col("words")
    window = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    out = out.select(
        "row",
        "n_words",
        "n_lines",
        "n_dup_lines",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace("t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # texts without a repeated window, which a set shows, need no sorting
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    keep = [c for c in out.columns if c != "windows"]
    out = out.select(*keep, placed.alias("s"))
    s = F.col("s")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    out = out.select(*keep, F.sort_array(F.transform(again, lambda x: x["i"])).alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return out.select(*keep, covered.cast("long").alias("n_repeat_words"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def measures() -> dict[str, Column]:
    """What learned conditions may compare with thresholds."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "marks_per_word": _share("n_marks", "n_words"),
        "capitals_per_char": _share("n_capitals", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """measure >= threshold, or measure < threshold."""

    measure: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        m = measures()[self.measure]
        return m >= self.threshold if self.at_least else m < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Reject a text that meets all conditions."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return reduce(operator.and_, (c.column() for c in self.conditions))


def learn(
    documents: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    label: str = "quality",
    max_rows: int = LABELLED_ROWS,
    max_rules: int = 6,
    max_conditions: int = 3,
    cuts: int = 24,
    min_precision: float = 0.9,
    min_cover: int = 8,
) -> list[Rule]:
    """A decision list of rejecting rules from rows labelled 1 (good) or 0 (bad)."""
    with interim.scope(documents.sparkSession):
        return _learn(documents, labels, text, id, label, max_rows, max_rules, max_conditions, cuts, min_precision, min_cover)


def _learn(documents: DataFrame, labels: DataFrame, text: str, id: str, label: str, max_rows: int, max_rules: int, max_conditions: int, cuts: int, min_precision: float, min_cover: int) -> list[Rule]:
    chosen = labels.select(F.col(id).alias("label_id"), (F.col(label) == 0).alias("bad")).dropna().orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = documents.select(F.col(id).alias("label_id"), F.col(text)).join(F.broadcast(chosen), "label_id")
    names = list(measures())
    values = measured(rows, text).select(base_failed().alias("failed"), F.col("row.bad").alias("bad"), (F.pmod(F.xxhash64(F.col("row.label_id"), F.lit("part")), F.lit(3)) != 0).alias("grow"), *(c.alias(n) for n, c in measures().items()))
    # the list decides on texts that pass the base rules, so it learns from those
    values = interim.stored(values, "quality-measures").filter("NOT failed")
    shares = [i / cuts for i in range(1, cuts)]  # exact, so that the rules are the same however rows are dealt
    found = values.agg(*(F.percentile(n, shares).alias(n) for n in names), *(F.percentile(F.when(F.col("bad"), F.col(n)), shares).alias(f"{n}_bad") for n in names)).first()
    grid = {n: sorted({*(found[n] or []), *(found[f"{n}_bad"] or [])}) for n in names}
    if not any(grid.values()):
        return []

    def bucket(name: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid[name])), lambda cut: cut <= F.col(name)))

    bucketed = interim.stored(values.select("bad", "grow", F.array(*map(bucket, names)).alias("b")).coalesce(4), "quality-buckets")

    def covers(conditions: list[tuple[int, bool, int]]) -> Column:
        return reduce(operator.and_, ((F.col("b")[m] >= k) if up else (F.col("b")[m] < k) for m, up, k in conditions), F.lit(True))

    rules, taken = [], F.lit(False)
    for _ in range(max_rules):
        left = bucketed.filter(~taken)
        conditions: list[tuple[int, bool, int]] = []
        for _ in range(max_conditions):
            cells = left.filter(F.col("grow") & covers(conditions)).select("bad", F.posexplode("b").alias("m", "k")).groupBy("m", "k").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).collect()
            best = _best_condition(cells, min_cover)
            if best is None or best in conditions:
                break
            conditions.append(best)
        if not conditions:
            break
        held = left.filter(~F.col("grow"))
        counts = held.agg(*(F.count_if(covers(conditions[: i + 1]) & c).alias(f"{kind}{i}") for i in range(len(conditions)) for kind, c in (("bad", F.col("bad")), ("n", F.lit(True))))).first()
        score = [((counts[f"bad{i}"] + 0.5) / (counts[f"n{i}"] + 1), counts[f"n{i}"]) for i in range(len(conditions))]
        length = max(range(len(conditions)), key=lambda i: (score[i][0], -i)) + 1
        precision, n = score[length - 1]
        conditions = conditions[:length]
        taken = taken | covers(conditions)
        if precision < min_precision or n < max(2, min_cover // 2):
            continue  # not sure enough to reject; the next rule looks elsewhere
        rules.append(Rule(tuple(Condition(names[m], up, float(grid[names[m]][k - 1])) for m, up, k in conditions), precision, n))
    return rules


def _best_condition(cells: list, min_cover: int) -> tuple[int, bool, int] | None:
    """The (measure, at least?, bucket) of the largest gain over the rows in ``cells``."""
    import math

    best, best_gain = None, 1e-9
    for m in {c.m for c in cells}:
        own = sorted((c for c in cells if c.m == m), key=lambda c: c.k)
        bad, n = sum(c.bad for c in own), sum(c.n for c in own)
        if not bad or bad == n:
            return None
        before = math.log2(bad / n)
        below_bad = below_n = 0
        for i, c in enumerate(own[:-1]):
            below_bad, below_n = below_bad + c.bad, below_n + c.n
            cut = own[i + 1].k
            for up, b, k in ((False, below_bad, below_n), (True, bad - below_bad, n - below_n)):
                if b >= min_cover and k and (gain := b * (math.log2(b / k) - before)) > best_gain:
                    best, best_gain = (m, up, cut), gain
    return best


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects: an ordered conditional expression."""
    out = None
    for r in rules:
        out = (F.when if out is None else out.when)(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(row struct, base measures, base_failed, kept) for every row."""
    out = measured(documents, text)
    return out.select("row", *BASE_COLUMNS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def accepted(documents: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns.

    The row number keeps the optimizer from moving the filter below the measures, where
    it would split the text again for every word.
    """
    out = measured(documents, text)
    out = out.select("row", (~base_failed() & verdict(rules)).alias("kept"), F.monotonically_increasing_id().alias("place"))
    return out.filter(F.col("kept") & (F.col("place") >= 0)).select("row.*")
