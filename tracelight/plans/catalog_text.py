"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.operators import text as op
from tracelight.plans.derive import (
    CANON_SQL,
    DIRTY_NORM_SQL,
    SENTENCES_SQL,
    WORDS_SQL,
    dirty_documents,
    dirty_normalized,
    q,
)
from tracelight.plans.registry import Tables, query

_W = WORDS_SQL % "normalized"


@query(
    "admit_documents",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) ELSE text END AS text
      FROM documents)
    SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'EMPTY'
      WHEN length(text) > 4000 THEN 'TOO_LARGE' ELSE 'ACCEPTED' END AS outcome FROM d""",
)
def _(t: Tables):
    blanked = t.documents.withColumn(
        "text", F.when(F.col("doc_id") % 9 == 0, F.lit("  \n")).otherwise(F.col("text"))
    )
    accepted, rejected = op.admit_documents(blanked, max_chars=4000)
    return accepted.select("doc_id", F.lit("ACCEPTED").alias("outcome")).unionByName(
        rejected.select("doc_id", F.col("reason").alias("outcome"))
    )


_COUNTS = [
    "crlf_replaced", "zero_width_removed", "bidi_controls_removed", "control_chars_removed",
    "special_spaces_replaced", "trailing_whitespace_lines", "blank_runs_collapsed",
]


@query(
    "normalize_corpus",
    f"""WITH {DIRTY_NORM_SQL}
    SELECT doc_id, md5(normalized) AS digest, {', '.join(_COUNTS)}, zero_width_kinds,
      normalized <> text AS changed FROM norm""",
)
def _(t: Tables):
    return dirty_normalized(t.documents).select(
        "doc_id",
        F.md5("normalized").alias("digest"),
        *_COUNTS,
        F.array_join("zero_width_kinds", ",").alias("zero_width_kinds"),
        "changed",
    )


@query(
    "canonicalize",
    f"WITH {DIRTY_NORM_SQL} SELECT doc_id, md5({CANON_SQL}) AS digest, length({CANON_SQL}) AS n FROM norm",
)
def _(t: Tables):
    return op.canonicalize(dirty_normalized(t.documents), "normalized").select(
        "doc_id", F.md5("canonical").alias("digest"), F.length("canonical").alias("n")
    )


def _n(pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all(normalized, {q(flags + pattern)}))"


_PUNCT = f"(length(normalized) - length(translate(normalized, {q(T.PUNCTUATION)}, '')))"


@query(
    "text_statistics",
    f"""WITH {DIRTY_NORM_SQL}, {SENTENCES_SQL},
    m AS (SELECT *, {_W} AS w, list_transform(ss, lambda s: len({WORDS_SQL % 's'})) AS sl,
      len(list_filter(string_split_regex(normalized, '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\S'))) AS np,
      length(normalized) AS nc, {_PUNCT} AS punct, {_n('[' + chr(92) + 'p{L}]')} AS letters
      FROM sents),
    x AS (SELECT *, len(w) AS nw, len(ss) AS ns,
      len(list_distinct(list_transform(w, lambda a: lower(a)))) AS nu FROM m)
    SELECT doc_id, nc::BIGINT AS character_count,
      length(regexp_replace(normalized, '\\s', '', 'g'))::BIGINT AS character_count_no_spaces,
      nw::BIGINT AS word_count, nu::BIGINT AS unique_word_count,
      CASE WHEN nw > 0 THEN round(nu / nw, 4) ELSE 0 END AS type_token_ratio,
      ns::BIGINT AS sentence_count, np::BIGINT AS paragraph_count,
      CASE WHEN normalized = '' THEN 0 ELSE len(string_split(normalized, chr(10))) END::BIGINT AS line_count,
      CASE WHEN ns > 0 THEN round(list_sum(sl) / ns, 2) ELSE 0 END AS avg_sentence_length_words,
      CASE WHEN ns > 0 THEN list_max(sl) ELSE 0 END::BIGINT AS longest_sentence_words,
      CASE WHEN ns > 0 THEN list_min(sl) ELSE 0 END::BIGINT AS shortest_sentence_words,
      CASE WHEN ns > 0 THEN round(list_stddev_pop(sl), 2) ELSE 0 END AS sentence_length_stddev,
      CASE WHEN nw > 0 THEN round(length(array_to_string(w, '')) / nw, 2) ELSE 0 END AS avg_word_length,
      CASE WHEN np > 0 THEN round(ns / np, 2) ELSE 0 END AS avg_paragraph_length_sentences,
      CASE WHEN nw > 0 THEN round(punct / nw * 100, 2) ELSE 0 END AS punctuation_per_100_words,
      CASE WHEN letters > 0 THEN round({_n('[' + chr(92) + 'p{Lu}]')} / letters, 4) ELSE 0 END AS uppercase_ratio,
      CASE WHEN nc > 0 THEN round({_n('[' + chr(92) + 'p{Nd}]')} / nc, 4) ELSE 0 END AS digit_ratio,
      CASE WHEN nc > 0 THEN round({_n('[^' + chr(92) + 'x00-' + chr(92) + 'x7f]')} / nc, 4) ELSE 0 END AS non_ascii_ratio,
      {_n(T.EMOJI)}::BIGINT AS emoji_count, {_n(T.URL)}::BIGINT AS url_count,
      {_n(T.EMAIL)}::BIGINT AS email_count,
      (ns - len(list_distinct(list_transform(ss, lambda a: lower(a)))))::BIGINT AS repeated_sentence_count
    FROM x""",
)
def _(t: Tables):
    return op.text_statistics(dirty_normalized(t.documents).select("doc_id", "normalized")).drop(
        "normalized"
    )


@query(
    "punctuation_profile",
    f"""WITH {DIRTY_NORM_SQL},
    c AS (SELECT doc_id, unnest(string_split(normalized, '')) AS mark,
      generate_subscripts(string_split(normalized, ''), 1) AS pos FROM norm),
    g AS (SELECT doc_id, mark, count(*) AS n, min(pos) AS p FROM c
      WHERE length(mark) = 1 AND contains({q(T.PUNCTUATION)}, mark) GROUP BY 1, 2)
    SELECT doc_id, mark, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM g""",
)
def _(t: Tables):
    return op.punctuation_profile(dirty_normalized(t.documents))


@query(
    "repeated_sentences",
    f"""WITH {DIRTY_NORM_SQL}, {SENTENCES_SQL},
    g AS (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, lower(unnest(ss)) AS s FROM sents) GROUP BY 1, 2)
    SELECT norm.doc_id, coalesce(sum(c - 1), 0)::BIGINT AS repeated_sentence_count
    FROM norm LEFT JOIN g USING (doc_id) GROUP BY 1""",
)
def _(t: Tables):
    return op.repeated_sentences(dirty_normalized(t.documents))


@query(
    "repeated_trigrams",
    f"""WITH {DIRTY_NORM_SQL},
    w AS (SELECT doc_id, list_transform({_W}, lambda a: lower(a)) AS w FROM norm),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS phrase
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    c AS (SELECT doc_id, phrase, count(*) AS n, min(i) AS p FROM g GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT doc_id, phrase, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank
    FROM c QUALIFY rank <= 10""",
)
def _(t: Tables):
    return op.repeated_trigrams(dirty_normalized(t.documents))


@query(
    "top_words",
    f"""WITH {DIRTY_NORM_SQL},
    w AS (SELECT doc_id, list_transform({_W}, lambda a: lower(a)) AS w FROM norm),
    g AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
    c AS (SELECT doc_id, word, count(*) AS n, min(i) AS p FROM g WHERE length(word) > 3 GROUP BY 1, 2)
    SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank
    FROM c QUALIFY rank <= 10""",
)
def _(t: Tables):
    return op.top_words(dirty_normalized(t.documents))


@query(
    "text_structure",
    f"""WITH marked AS (SELECT doc_id, lang, source, CASE doc_id % 4
        WHEN 0 THEN '# Title' || chr(10) || text
        WHEN 1 THEN text || chr(10) || '- first' || chr(10) || '* second' || chr(10) || chr(10) || '  '
        WHEN 2 THEN '1. one' || chr(10) || '2) two' || chr(10) || chr(10) || '## Sub' || chr(10) || text
        ELSE text END AS text FROM documents),
    l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM marked)
    SELECT doc_id,
      len(list_filter(ls, lambda x: regexp_matches(x, {q(op.HEADING)})))::BIGINT AS markdown_headings,
      len(list_filter(ls, lambda x: regexp_matches(x, {q(op.BULLET)})))::BIGINT AS bullet_lines,
      len(list_filter(ls, lambda x: regexp_matches(x, {q(op.NUMBERED)})))::BIGINT AS numbered_lines,
      len(list_filter(ls, lambda x: NOT regexp_matches(x, '\\S')))::BIGINT AS blank_line_count,
      list_max(list_transform(ls, lambda x: length(x)))::BIGINT AS max_line_length,
      len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\S'))) > 1
        AS has_multiple_paragraphs,
      regexp_matches(ls[1], {q(op.HEADING)}) AS starts_with_heading
    FROM l""",
)
def _(t: Tables):
    kind, text = F.col("doc_id") % 4, F.col("text")
    marked = t.documents.withColumn(
        "text",
        F.when(kind == 0, F.concat(F.lit("# Title\n"), text))
        .when(kind == 1, F.concat(text, F.lit("\n- first\n* second\n\n  ")))
        .when(kind == 2, F.concat(F.lit("1. one\n2) two\n\n## Sub\n"), text))
        .otherwise(text),
    )
    return op.text_structure(marked, "text").drop("text", "lang", "source", "n_chars")


@query(
    "hidden_char_audit",
    f"""WITH {DIRTY_NORM_SQL},
    h AS (SELECT *, zero_width_removed + bidi_controls_removed + control_chars_removed AS h FROM norm)
    SELECT lang, source, count(*) AS documents, count(*) FILTER (WHERE h > 0) AS flagged,
      sum(h)::BIGINT AS hidden, sum(zero_width_removed)::BIGINT AS zero_width,
      sum(bidi_controls_removed)::BIGINT AS bidi, sum(control_chars_removed)::BIGINT AS controls,
      sum(special_spaces_replaced)::BIGINT AS special_spaces
    FROM h GROUP BY ROLLUP (lang, source)""",
)
def _(t: Tables):
    return op.hidden_char_audit(dirty_normalized(t.documents), "lang", "source")


_STOP = ", ".join(q(w) for w in op.STOPWORDS)


@query(
    "distinctive_phrases",
    f"""WITH {DIRTY_NORM_SQL}, {SENTENCES_SQL},
    s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sents),
    w AS (SELECT doc_id, i, {WORDS_SQL % 's'} AS w FROM s
      WHERE NOT regexp_matches(s, '(?i)^(dear|regards|sincerely|thanks|thank you|hello|hi)\\b')),
    c AS (SELECT *, list_filter(w, lambda x: NOT list_contains([{_STOP}], lower(x))) AS c FROM w WHERE len(w) >= 6),
    p AS (SELECT doc_id, i, array_to_string(w[1:10], ' ') AS phrase,
      CASE WHEN len(c) > 0 THEN length(array_to_string(c, '')) / len(c) * (len(c) / len(w)) ELSE 0 END AS score
      FROM c),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(phrase) ORDER BY score DESC, i) AS first FROM p)
    SELECT doc_id, phrase, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS phrase_index
    FROM d WHERE first = 1 QUALIFY phrase_index <= 5""",
)
def _(t: Tables):
    return op.distinctive_phrases(dirty_normalized(t.documents))


_SECRET_SUFFIX = [
    " Bearer abc.def-123_x/y+z=",
    " authorization: Zm9vYmFy, next",
    " see https://host/p?token=s3cr3t&x=1 now",
    " eyJabcdefgh.ijklmnop.qrstuvwx end",
    " key sk-0123456789abcdef end",
    "",
]


def _redacted_sql() -> str:
    ctes, previous = [], "r"
    for i, (name, pattern, replacement) in enumerate(op.SECRETS):
        sql = replacement.replace("$1", "\\1")
        ctes.append(
            f"s{i} AS (SELECT * REPLACE (regexp_replace(r, {q(pattern)}, {q(sql)}, 'g') AS r), "
            f"len(regexp_extract_all(r, {q(pattern)}))::BIGINT AS {name}_hits FROM {previous})"
        )
        previous = f"s{i}"
    return ", ".join(ctes)


@query(
    "redact_text",
    f"""WITH r AS (
      SELECT 'doc-' || doc_id AS id, text || [{', '.join(q(s) for s in _SECRET_SUFFIX)}][doc_id % 6 + 1] AS r FROM documents
      UNION ALL SELECT 'event-' || event_id, props FROM events), {_redacted_sql()}
    SELECT id, md5(r) AS digest, {', '.join(f'{n}_hits' for n, _, _ in op.SECRETS)}
    FROM s{len(op.SECRETS) - 1}""",
)
def _(t: Tables):
    suffix = F.get(F.array(*[F.lit(s) for s in _SECRET_SUFFIX]), (F.col("doc_id") % 6).cast("int"))
    texts = t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"), F.concat("text", suffix).alias("text")
    ).unionByName(
        t.events.select(
            F.concat(F.lit("event-"), F.col("event_id")).alias("id"), F.col("props").alias("text")
        )
    )
    return (
        op.redact_text(texts)
        .withColumn("digest", F.md5("redacted"))
        .drop("text", "redacted")
    )


@query(
    "text_profile_view",
    f"""WITH {DIRTY_NORM_SQL}
    SELECT doc_id, md5(substr(text, 1, 4000)) AS original_digest,
      md5(substr(normalized, 1, 4000)) AS normalized_digest,
      length(text) > 4000 OR length(normalized) > 4000 AS truncated,
      sha256(text) AS original_sha256, sha256(normalized) AS normalized_sha256,
      len({_W})::BIGINT AS word_count
    FROM norm""",
)
def _(t: Tables):
    stats = op.text_statistics(dirty_normalized(t.documents).select("doc_id", "text", "normalized"))
    return op.text_profile_view(stats).select(
        "doc_id",
        F.md5("original_excerpt").alias("original_digest"),
        F.md5("normalized_excerpt").alias("normalized_digest"),
        "truncated",
        "original_sha256",
        "normalized_sha256",
        "word_count",
    )
