"""URL filters (operator 2): a character language-model ratio beside longest-prefix rules.

Two Markov models of variable order, one of accepted and one of rejected URLs, give each character
a probability after up to ``ORDER`` characters of context; contexts that were never seen fall back
to shorter ones (Witten-Bell weights). The difference of log-likelihoods over the length is the
score; the threshold is calibrated on labelled URLs that the models have not seen.

Every distinct gram is scored once, in millionths so that sums are exact, and every distinct URL
once. Grams that all URLs share are a hot join key; the model is a stored table, so adaptive
execution can split that side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.columns import indexes, let
from tracelight.llm.common import stored

ORDER = 4
ALPHABET = 256  # the lowest order gives every character 1 / ALPHABET
CLASSES = ("accepted", "rejected")
#: Terms in a host that mark a URL as rejected where no labels exist: common spam trades.
REJECTED_TERMS = (
    "adult", "bets", "casino", "cheap", "click", "free-", "loans", "pills", "poker", "porn",
    "spam", "track", "viagra", "xxx",
)


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (host and path in one string) that fits, else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = (host == own) | host.endswith(f".{own}")
        out = out.when(fits & path.startswith(slash + rest), F.lit(rule))
    return out


def grams(text: Column) -> Column:
    """Each character of ``text`` and an end mark, after the ORDER characters before it."""
    marked = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return let(
        marked,
        lambda t: F.transform(
            indexes(F.length(t) - ORDER), lambda i: F.substring(t, i + 1, F.lit(ORDER + 1))
        ),
    )


def order_table(counts: DataFrame, order: int) -> DataFrame:
    """(suffix, n_*, all_*, kinds_*): counts of each suffix and of its context, by class."""
    suffixes = counts.groupBy(F.expr(f"right(gram, {order + 1})").alias("suffix")).agg(
        *[F.sum(c).alias(f"n_{c}") for c in CLASSES]
    )
    context = F.expr(f"left(suffix, {order})")
    contexts = suffixes.groupBy(context.alias("context")).agg(
        *[F.sum(f"n_{c}").alias(f"all_{c}") for c in CLASSES],
        *[F.count(F.when(F.col(f"n_{c}") > 0, 1)).alias(f"kinds_{c}") for c in CLASSES],
    )
    return suffixes.join(contexts, context == F.col("context")).drop("context")


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, micro): millionths of log P(last | accepted) - log P(last | rejected).

    ``counts`` is the stored table (gram, accepted, rejected) of all grams to be scored.
    """
    rows = counts.select("gram", *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in CLASSES])
    for order in range(ORDER + 1):
        level = order_table(counts, order)
        rows = rows.withColumn("suffix", F.expr(f"right(gram, {order + 1})")).join(level, "suffix")
        rows = rows.select(
            "gram",
            *[
                F.when(
                    F.col(f"all_{c}") > 0,
                    (F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"p_{c}"))
                    / (F.col(f"all_{c}") + F.col(f"kinds_{c}")),
                )
                .otherwise(F.col(f"p_{c}"))
                .alias(f"p_{c}")
                for c in CLASSES
            ],
        )
    ratio = F.log("p_accepted") - F.log("p_rejected")
    return rows.select("gram", F.round(ratio * 1e6).cast("long").alias("micro"))


def in_calibration(text: Column) -> Column:
    """One fifth of the texts, by their md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int") % 5 == 0


def score_texts(texts: DataFrame) -> DataFrame:
    """(text, label, micro, length) of the stored distinct ``texts`` (text, label).

    The models learn from labelled texts outside the calibration fifth.
    """
    learned = F.when(~in_calibration(F.col("text")), F.col("label"))
    each = texts.select(learned.alias("label"), F.explode(grams(F.col("text"))).alias("gram"))
    counts = stored(
        each.groupBy("gram").agg(
            *[F.count(F.when(F.col("label") == c, 1)).alias(c) for c in CLASSES]
        )
    )
    model = stored(gram_scores(counts))
    spelled = texts.select("text", "label", F.explode(grams(F.col("text"))).alias("gram"))
    return (
        spelled.join(model, "gram")
        .groupBy("text", "label")
        .agg(F.sum("micro").alias("micro"), F.count(F.lit(1)).alias("length"))
    )


def calibrated(scored: DataFrame) -> float:
    """The threshold of the best balance on the calibration fifth of the labelled texts.

    Read off a histogram of scores in thousandths, middle of the best stretch; without both
    labels in that fifth nothing is below it.
    """
    score = F.floor(F.col("micro") / F.col("length") / 1000)
    rows = (
        scored.filter(F.col("label").isNotNull() & in_calibration(F.col("text")))
        .groupBy(score.alias("step"))
        .agg(*[F.count(F.when(F.col("label") == c, 1)).alias(c) for c in CLASSES])
        .collect()
    )
    steps = sorted((r["step"], r["accepted"], r["rejected"]) for r in rows)
    good, bad = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not good or not bad:
        return float("-inf")
    best, low, high = -1.0, None, None
    kept_bad, kept_good = bad, good
    for i, (step, a, r) in enumerate(steps):
        balance = kept_good / good - kept_bad / bad  # threshold just below this step
        if balance > best:
            best, high, low = balance, step, steps[i - 1][0] if i else step
        kept_good, kept_bad = kept_good - a, kept_bad - r
    return (low + high + 1) / 2 / 1000


def filter_urls(
    pages: DataFrame,
    rules: dict[str, str],
    labels: Column | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row of ``pages``.

    ``rules`` maps host/path prefixes to 'allow' or 'block'; the longest that fits decides, else
    the model. ``labels`` is a string column over (host, path, rule): 'accepted', 'rejected' or
    null. Its default rejects hosts with one of REJECTED_TERMS and accepts other URLs that no
    block rule covers. A null URL, or one without '://', has an empty host and path.
    """
    host, path = host_of(F.col(url_column)), path_of(F.col(url_column))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    if labels is None:
        spam = F.lit(False)
        for term in REJECTED_TERMS:
            spam = spam | F.contains(F.col("host"), F.lit(term))
        labels = F.when(spam, "rejected").when(
            (F.col("host") != "") & ~F.coalesce(blocked, F.lit(False)), "accepted"
        )
    rows = rows.withColumn("text", F.concat("host", "path"))
    texts = stored(rows.select("text", labels.alias("label")).groupBy("text").agg(F.min("label").alias("label")))
    scored = stored(score_texts(texts))
    threshold = calibrated(scored)
    score = F.col("micro") / F.col("length") / 1e6
    worth = scored.select("text", score.alias("score"))
    by_rule = F.when(blocked, "block").when(F.col("rule").isNotNull(), "allow")
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return rows.join(worth, "text", "left").select(
        id_column, "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "score"
    )
