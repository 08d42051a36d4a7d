"""Quality rules (operator 4): learned decision lists over text statistics, in Spark expressions.

Statistics are computed inside the row. The list is learned by sequential covering as RIPPER does
it (Cohen, 1995): a rule grows by the threshold condition of the greatest information gain on two
thirds of the labelled rows, loses its last conditions as long as the other third is better
covered without them, and takes the rows it covers away. Every choice is made from one histogram
of (statistic, bin) counts over all labelled rows; only histograms reach the driver. The result is
an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.columns import indexes, let
from tracelight.llm.common import stored

#: Statistics that conditions may test; all but the first are shares or means.
FEATURES = [
    "n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
    "mark_share", "digit_share", "pipe_share", "distinct_share", "words_per_line",
]
BLANK = r"[ \t\n\x0B\f\r]+"
BINS = 40


def kept_length(text: Column, characters: str) -> Column:
    """How many characters of ``text`` the class ``characters`` holds."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first occurrences included.

    Windows are compared by 64-bit hash, sorted with their places, and the places of equal ones
    merged; a text whose windows all differ stops after one hash set.
    """
    windows = F.transform(
        indexes(F.size(words) - 2),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(sorted_windows: Column) -> Column:
        same = F.filter(
            sorted_windows,
            lambda x, i: F.coalesce(F.get(sorted_windows, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(sorted_windows, i + 1)["h"] == x["h"], F.lit(False)),
        )
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))),
                F.lit(0),
                lambda total, step: total + step,
            ),
        )

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(placed), covered)
        )

    return let(windows, count).cast("long")


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with one struct column ``stats``; null text counts as empty."""
    text = F.coalesce(F.col(text_column), F.lit(""))

    def measure(words: Column) -> Column:
        return let(
            F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]")),
            lambda lines: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                kept_length(text, "#*$%&|<>").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeat_words(words).alias("n_repeat_words"),
                F.size(lines).alias("n_lines"),
                F.size(F.array_distinct(words)).alias("n_distinct"),
                kept_length(text, r"\p{Lu}").alias("n_upper"),
                kept_length(text, "!?").alias("n_marks"),
                kept_length(text, "0-9").alias("n_digits"),
                kept_length(text, "|").alias("n_pipes"),
            ),
        )

    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    return docs.withColumn("stats", let(words, measure))


def feature(name: str) -> Column:
    def share(part: str, whole: str) -> Column:
        return F.col(f"stats.{part}") / F.greatest(F.col(f"stats.{whole}"), F.lit(1))

    return {
        "n_words": F.col("stats.n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "pipe_share": share("n_pipes", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }[name]


def base_failed() -> Column:
    n, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


@dataclass(frozen=True)
class Condition:
    """``feature`` above (or not above) ``threshold``, the upper end of ``bin``."""

    feature: str
    above: bool
    bin: int
    threshold: float

    def on_bins(self) -> Column:
        at = F.col(f"bin_{self.feature}")
        return at > self.bin if self.above else at <= self.bin

    def on_statistics(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def every(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def binned(labelled: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """One row per distinct vector of bins with its counts, stored; and the thresholds."""
    values = stored(labelled.select("bad", "fold", *[feature(f).alias(f) for f in FEATURES]))
    probabilities = [k / BINS for k in range(BINS)] + [0.99, 0.995, 0.999, 1.0]
    found = values.approxQuantile(FEATURES, probabilities, 0.0005) or [[] for _ in FEATURES]
    # half-way between values, so that a rule keeps its distance from what it was learned on
    thresholds = {
        f: [(a + b) / 2 for a, b in pairwise(sorted(set(q)))]
        for f, q in zip(FEATURES, found, strict=True)
    }

    def bin_of(f: str) -> Column:
        limits = F.array(*map(F.lit, thresholds[f])).cast("array<double>")
        return F.size(F.filter(limits, lambda t: F.col(f) > t)).alias(f"bin_{f}")

    bins = [bin_of(f) for f in FEATURES]
    rows = values.select("bad", "fold", *bins)
    table = rows.groupBy(*[f"bin_{f}" for f in FEATURES]).agg(
        *[
            F.count(F.when((F.col("bad") == bad) & (grow == (F.col("fold") > 0)), 1)).alias(name)
            for name, bad, grow in (
                ("grow_bad", True, F.lit(True)), ("grow_good", False, F.lit(True)),
                ("prune_bad", True, F.lit(False)), ("prune_good", False, F.lit(False)),
            )
        ]
    )
    return stored(table), thresholds


def best_condition(
    rows: DataFrame, thresholds: dict[str, list[float]], bad: int, good: int
) -> Condition | None:
    """The condition of the greatest gain (FOIL) on the growing rows; ties take the first."""
    pairs = ", ".join(f"'{f}', bin_{f}" for f in FEATURES)
    histogram = (
        rows.select("grow_bad", "grow_good", F.expr(f"stack({len(FEATURES)}, {pairs}) AS (f, b)"))
        .groupBy("f", "b")
        .agg(F.sum("grow_bad").alias("bad"), F.sum("grow_good").alias("good"))
        .collect()
    )
    counts = {(r["f"], r["b"]): (r["bad"], r["good"]) for r in histogram}
    before = math.log2(bad / (bad + good))
    best, found = 1e-9, None
    for f in FEATURES:
        low_bad = low_good = 0
        for b, threshold in enumerate(thresholds[f]):
            here = counts.get((f, b), (0, 0))
            low_bad, low_good = low_bad + here[0], low_good + here[1]
            for above in (True, False):
                p, n = (bad - low_bad, good - low_good) if above else (low_bad, low_good)
                gain = p * (math.log2(p / (p + n)) - before) if p else 0
                if gain > best:
                    best, found = gain, Condition(f, above, b, threshold)
    return found


def learn(
    labelled: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_rows: int = 10,
) -> list[list[Condition]]:
    """Rules for bad rows of ``labelled`` (stats, bad, fold), in the order found.

    A rule is taken if at least ``min_rows`` labelled rows fall under it and, on the rows it was
    not grown on, at least ``min_precision`` of them are bad; otherwise learning ends. No labelled
    or no bad rows give no rule.
    """
    left, thresholds = binned(labelled)
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        total = left.agg(*[F.sum(c).alias(c) for c in ("grow_bad", "grow_good")]).first()
        bad, good = total["grow_bad"] or 0, total["grow_good"] or 0
        rule: list[Condition] = []
        rows = left
        while bad and good and len(rule) < max_conditions:
            chosen = best_condition(rows, thresholds, bad, good)
            if chosen is None:
                break
            rule.append(chosen)
            rows = rows.filter(chosen.on_bins())
            now = rows.agg(F.sum("grow_bad"), F.sum("grow_good")).first()
            bad, good = now[0] or 0, now[1] or 0
        if not rule:
            break
        tests = [every([c.on_bins() for c in rule[: k + 1]]) for k in range(len(rule))]
        sums = left.agg(
            *[
                F.coalesce(F.sum(F.when(t, F.col(c))), F.lit(0)).alias(f"{c}{k}")
                for k, t in enumerate(tests)
                for c in ("prune_bad", "prune_good", "grow_bad", "grow_good")
            ]
        ).first()

        def worth(k: int, sums=sums) -> float:
            p, n = sums[f"prune_bad{k}"], sums[f"prune_good{k}"]
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(len(rule)), key=lambda k: (worth(k), -k))
        p, n = sums[f"prune_bad{k}"], sums[f"prune_good{k}"]
        covered = p + n + sums[f"grow_bad{k}"] + sums[f"grow_good{k}"]
        if covered < min_rows or p < min_precision * (p + n) or not p:
            break
        rules.append(rule[: k + 1])
        left = left.filter(~tests[k])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered conditional: true keeps the row."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(every([c.on_statistics() for c in rule]), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(measured: DataFrame, labels: DataFrame, id_column: str = "doc_id", **limits) -> DataFrame:
    """The stored table ``measured`` (id, stats, ...) with base_failed, rule_verdict and kept.

    Rules are learned from rows that ``labels`` (id, quality) names and that do not fail the base
    rules; several labels of an id count as their lowest, null labels not at all. The fold that
    prunes is taken by hash of the id.
    """
    marks = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("_quality"))
    labelled = (
        measured.filter(~base_failed())
        .join(marks, F.col(id_column) == F.col("_id"))
        .filter("_quality IS NOT NULL")
        .select(
            "stats",
            (F.col("_quality") == 0).alias("bad"),
            F.pmod(F.xxhash64(id_column), F.lit(3)).alias("fold"),
        )
    )
    keep = verdict(learn(labelled, **limits))
    return measured.withColumns(
        {"base_failed": base_failed(), "rule_verdict": keep, "kept": ~base_failed() & keep}
    )


def apply_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    **limits,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row for each row of ``docs``. Null and empty texts have no word and fail the base rules.
    """
    measured = stored(
        with_statistics(docs.select(id_column, text_column), text_column).select(id_column, "stats")
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(measured, labels, id_column, **limits).select(
        id_column, *[F.col(f"stats.{n}").alias(n) for n in names], "base_failed", "kept"
    )
