"""Per-document text jobs. One scan each, no shuffle: a document is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.functions.columns import count_runs, first_by_key, let, ngrams, ratio, rounded

# English function words that carry no weight in phrase selection.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "by",
    "from", "as", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these",
    "those", "it", "its", "they", "them", "their", "we", "our", "you", "your", "he", "she", "his",
    "her", "not", "no", "yes", "if", "then", "than", "so", "such", "very", "can", "could", "may",
    "might", "will", "would", "shall", "should", "do", "does", "did", "have", "has", "had",
    "into", "over", "under", "about", "after", "before", "between", "through", "during",
    "without", "within",
]
# Openings that mark a sentence as a greeting.
GREETING = r"(?i)^(dear|regards|sincerely|thanks|thank you|hello|hi)\b"
# Secret patterns and their replacements, in the order they apply.
SECRETS = [
    ("bearer", r"(?i)\b(bearer\s+)[a-z0-9._~+/=-]+", "$1[redacted]"),
    ("authorization", r"(?i)\b(authorization\s*[:=]\s*)[^\s,;]+", "$1[redacted]"),
    (
        "keyvalue",
        r"(?i)\b((?:sig|signature|token|access_token|refresh_token|api_key|apikey|password|"
        r"secret|secret_key)=)[^&\s\"'#]+",
        "$1[redacted]",
    ),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\b", "[redacted]"),
    ("apikey", r"\bsk-[A-Za-z0-9_-]{12,}\b", "[redacted]"),
]
HEADING = r"^\s{0,3}#{1,6}\s+\S"
BULLET = r"^\s*[-*•–]\s+\S"
NUMBERED = r"^\s*\d+[.)]\s+\S"


def admit_documents(
    df: DataFrame, max_chars: int = 200_000, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): empty after trimming, or over the size cap."""
    body = F.col(text)
    reason = F.when(body.isNull() | ~body.rlike(T.NON_SPACE), "EMPTY").when(
        F.length(body) > max_chars, "TOO_LARGE"
    )
    judged = df.withColumn("reason", reason)
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()),
    )


def normalize_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``normalized``, one count per rule, the zero-width kinds and ``changed``.

    The original column stays as it is. The order of the rules matters. Character rules only
    run where one regex finds any such character.
    """
    removed = "".join(T.ZERO_WIDTH) + T.BIDI + T.CONTROLS
    raw = F.col(text)
    staged = (
        df.withColumn("crlf_replaced", T.matches(raw, "\\r\\n"))
        .withColumn(
            "_lines", F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        )
        .withColumn("_nfc", T.nfc(F.col("_lines")))
        .withColumn("_special", F.col("_nfc").rlike(T.HIDDEN))
    )
    composed = F.col("_nfc")

    def count(chars: str) -> Column:
        return F.when(F.col("_special"), T.char_count(composed, chars)).otherwise(F.lit(0))

    kinds = F.array_compact(
        F.array(
            *[
                F.when(F.instr(composed, ch) > 0, F.lit(name))
                for ch, name in sorted(T.ZERO_WIDTH.items(), key=lambda kv: kv[1])
            ]
        )
    )
    staged = (
        staged.withColumn("zero_width_removed", count("".join(T.ZERO_WIDTH)))
        .withColumn("bidi_controls_removed", count(T.BIDI))
        .withColumn("special_spaces_replaced", count(T.SPECIAL_SPACES))
        .withColumn("control_chars_removed", count(T.CONTROLS))
        .withColumn(
            "zero_width_kinds",
            F.when(F.col("_special"), kinds).otherwise(F.array().cast("array<string>")),
        )
        .withColumn(
            "_plain",
            F.when(
                F.col("_special"),
                F.translate(
                    composed, T.SPECIAL_SPACES + removed, " " * len(T.SPECIAL_SPACES)
                ),
            ).otherwise(composed),
        )
        .withColumn("trailing_whitespace_lines", T.matches(F.col("_plain"), "[ \\t]+(?=\\n|\\z)"))
        .withColumn("_tight", F.regexp_replace("_plain", "[ \\t]+(?=\\n|\\z)", ""))
        .withColumn("blank_runs_collapsed", T.matches(F.col("_tight"), "\\n{3,}"))
        .withColumn(
            "normalized",
            F.btrim(F.regexp_replace("_tight", "\\n{3,}", "\n\n"), F.lit("\n")),
        )
        .withColumn("changed", F.col("normalized") != raw)
    )
    return staged.drop("_lines", "_nfc", "_special", "_plain", "_tight")


def canonicalize(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("canonical", T.canonical(F.col(text)))


def redact_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``redacted`` and one hit count per pattern; a pattern sees the earlier redactions."""
    out = df.withColumn("redacted", F.col(text))
    for name, pattern, replacement in SECRETS:
        out = out.withColumn(f"{name}_hits", T.matches(F.col("redacted"), pattern)).withColumn(
            "redacted", F.regexp_replace("redacted", pattern, replacement)
        )
    return out


def text_statistics(df: DataFrame, text: str = "normalized") -> DataFrame:
    body = F.col(text)
    wide = (
        df.withColumn("_words", T.words(body))
        .withColumn("_sentences", T.sentences(body))
        .withColumn("_lengths", F.transform("_sentences", lambda s: F.size(T.words(s))))
        .withColumn("_unique", F.size(F.array_distinct(F.transform("_words", F.lower))))
        .withColumn("paragraph_count", F.size(T.paragraphs(body)))
        .withColumn("_punct", T.char_count(body, T.PUNCTUATION))
        .withColumn("character_count", F.length(body))
    )
    words, lengths = F.col("_words"), F.col("_lengths")
    n_words, n_sent, n_chars = F.size(words), F.size("_sentences"), F.col("character_count")
    mean = F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / n_sent
    variance = let(
        mean,
        lambda m: F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n_sent,
    )
    letters = T.matches(body, r"\p{L}")
    some = n_sent > 0
    return wide.select(
        *[c for c in df.columns],
        n_chars.alias("character_count"),
        F.length(F.regexp_replace(body, T.SPACE, "")).alias("character_count_no_spaces"),
        n_words.alias("word_count"),
        F.col("_unique").alias("unique_word_count"),
        ratio(F.col("_unique"), n_words, 4).alias("type_token_ratio"),
        n_sent.alias("sentence_count"),
        F.col("paragraph_count"),
        F.when(body == "", 0).otherwise(T.char_count(body, "\n") + 1).alias("line_count"),
        F.when(some, rounded(mean, 2)).otherwise(0.0).alias("avg_sentence_length_words"),
        F.when(some, F.array_max(lengths)).otherwise(0).alias("longest_sentence_words"),
        F.when(some, F.array_min(lengths)).otherwise(0).alias("shortest_sentence_words"),
        F.when(some, rounded(F.sqrt(variance), 2)).otherwise(0.0).alias("sentence_length_stddev"),
        ratio(F.length(F.array_join(words, "")), n_words, 2).alias("avg_word_length"),
        ratio(n_sent, F.col("paragraph_count"), 2).alias("avg_paragraph_length_sentences"),
        F.when(n_words > 0, rounded(F.col("_punct") / n_words * 100, 2))
        .otherwise(0.0)
        .alias("punctuation_per_100_words"),
        ratio(T.matches(body, r"\p{Lu}"), letters, 4).alias("uppercase_ratio"),
        ratio(T.matches(body, "[\\p{Nd}²³¹⁰⁴-⁹₀-₉]"), n_chars, 4).alias("digit_ratio"),
        ratio(T.matches(body, "[^\\x00-\\x7f]"), n_chars, 4).alias("non_ascii_ratio"),
        T.matches(body, T.EMOJI).alias("emoji_count"),
        T.matches(body, T.URL).alias("url_count"),
        T.matches(body, T.EMAIL).alias("email_count"),
        (n_sent - F.size(F.array_distinct(F.transform("_sentences", F.lower)))).alias(
            "repeated_sentence_count"
        ),
    )


def punctuation_profile(df: DataFrame, text: str = "normalized", id_col: str = "doc_id") -> DataFrame:
    """(doc, mark, n, rank): marks in use, most frequent first, then by first place."""
    body = F.col(text)
    marks = F.filter(
        F.array(
            *[
                F.struct(
                    (-T.char_count(body, m)).alias("neg_n"),
                    F.instr(body, m).alias("pos"),
                    F.lit(m).alias("mark"),
                )
                for m in T.PUNCTUATION
            ]
        ),
        lambda m: m["neg_n"] < 0,
    )
    return df.select(id_col, F.posexplode_outer(F.sort_array(marks)).alias("rank", "m")).select(
        id_col,
        F.col("m.mark").alias("mark"),
        (-F.col("m.neg_n")).alias("n"),
        (F.col("rank") + 1).alias("rank"),
    ).filter(F.col("mark").isNotNull())


def repeated_sentences(df: DataFrame, text: str = "normalized", id_col: str = "doc_id") -> DataFrame:
    return df.select(
        id_col,
        let(
            T.sentences(F.col(text)),
            lambda s: F.size(s) - F.size(F.array_distinct(F.transform(s, F.lower))),
        ).alias("repeated_sentence_count"),
    )


def _top_tokens(df: DataFrame, tokens: Column, k: int, min_n: int, id_col: str, name: str) -> DataFrame:
    top = F.slice(F.filter(count_runs(tokens), lambda r: r["neg_n"] <= -min_n), 1, k)
    return (
        df.select(id_col, F.posexplode_outer(top).alias("rank", "r"))
        .select(
            id_col,
            F.col("r.token").alias(name),
            (-F.col("r.neg_n")).alias("n"),
            (F.col("rank") + 1).alias("rank"),
        )
        .filter(F.col(name).isNotNull())
    )


def repeated_trigrams(
    df: DataFrame, k: int = 10, text: str = "normalized", id_col: str = "doc_id"
) -> DataFrame:
    lowered = F.transform(T.words(F.col(text)), F.lower)
    return _top_tokens(df, ngrams(lowered, 3), k, 2, id_col, "phrase")


def top_words(
    df: DataFrame, k: int = 10, text: str = "normalized", id_col: str = "doc_id"
) -> DataFrame:
    lowered = F.transform(T.words(F.col(text)), F.lower)
    return _top_tokens(df, F.filter(lowered, lambda w: F.length(w) > 3), k, 1, id_col, "word")


def text_structure(df: DataFrame, text: str = "normalized") -> DataFrame:
    lines = F.split(F.col(text), "\n")

    def hits(pattern: str) -> Column:
        return F.size(F.filter(F.col("_lines"), lambda x: x.rlike(pattern)))

    return (
        df.withColumn("_lines", lines)
        .withColumn("markdown_headings", hits(HEADING))
        .withColumn("bullet_lines", hits(BULLET))
        .withColumn("numbered_lines", hits(NUMBERED))
        .withColumn(
            "blank_line_count",
            F.size(F.filter(F.col("_lines"), lambda x: ~x.rlike(T.NON_SPACE))),
        )
        .withColumn("max_line_length", F.array_max(F.transform("_lines", F.length)))
        .withColumn("has_multiple_paragraphs", F.size(T.paragraphs(F.col(text))) > 1)
        .withColumn("starts_with_heading", F.get("_lines", F.lit(0)).rlike(HEADING))
        .drop("_lines")
    )


def hidden_char_audit(normalized: DataFrame, *by: str) -> DataFrame:
    """Roll-up of hidden characters over ``normalize_corpus`` output, with natural totals."""
    hidden = (
        F.col("zero_width_removed") + F.col("bidi_controls_removed") + F.col("control_chars_removed")
    )
    return normalized.rollup(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(hidden > 0).alias("flagged"),
        F.sum(hidden).alias("hidden"),
        F.sum("zero_width_removed").alias("zero_width"),
        F.sum("bidi_controls_removed").alias("bidi"),
        F.sum("control_chars_removed").alias("controls"),
        F.sum("special_spaces_replaced").alias("special_spaces"),
    )


def distinctive_phrases(
    df: DataFrame,
    k: int = 5,
    text: str = "normalized",
    id_col: str = "doc_id",
    min_words: int = 6,
    phrase_words: int = 10,
) -> DataFrame:
    """(doc, phrase_index, phrase, score): sentences ranked by weight of their content words.

    Score = mean content-word length x share of content words; ties keep document order; equal
    phrases (ignoring case) count once, before the top-k cut.
    """
    def scored(s: Column, i: Column) -> Column:
        def body(w: Column) -> Column:
            content = F.filter(w, lambda x: ~F.lower(x).isin(*STOPWORDS))  # one look-up, no scan
            return let(
                content,
                lambda c: F.struct(
                    F.when(
                        F.size(c) > 0,
                        -(F.length(F.array_join(c, "")) / F.size(c) * (F.size(c) / F.size(w))),
                    )
                    .otherwise(F.lit(0.0))
                    .alias("neg_score"),
                    i.alias("pos"),
                    F.array_join(F.slice(w, 1, phrase_words), " ").alias("phrase"),
                    F.size(w).alias("n_words"),
                ),
            )

        return let(T.words(s), body)

    candidates = F.filter(
        F.transform(
            T.sentences(F.col(text)),
            lambda s, i: F.when(~s.rlike(GREETING), scored(s, i)),
        ),
        lambda x: x["n_words"] >= min_words,
    )
    best = F.slice(
        first_by_key(F.sort_array(candidates), lambda x: F.lower(x["phrase"])), 1, k
    )
    return (
        df.select(id_col, F.posexplode_outer(best).alias("i", "p"))
        .filter(F.col("p").isNotNull())
        .select(
            id_col,
            (F.col("i") + 1).alias("phrase_index"),
            F.col("p.phrase").alias("phrase"),
            (-F.col("p.neg_score")).alias("score"),
        )
    )


def text_profile_view(df: DataFrame, excerpt_chars: int = 4000, text: str = "text") -> DataFrame:
    """The reader's view of a normalised document: excerpts, flags, hashes and counts."""
    norm = F.col("normalized")
    return df.select(
        *[c for c in df.columns if c not in (text, "normalized")],
        F.substring(text, 1, excerpt_chars).alias("original_excerpt"),
        F.substring(norm, 1, excerpt_chars).alias("normalized_excerpt"),
        F.greatest(F.length(text) > excerpt_chars, F.length(norm) > excerpt_chars).alias(
            "truncated"
        ),
        F.sha2(text, 256).alias("original_sha256"),
        F.sha2(norm, 256).alias("normalized_sha256"),
    )
