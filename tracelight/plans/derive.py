"""Engine tables derived from the supplied ones, each as a Spark plan and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.operators.fingerprints import permutations, text_fingerprints, text_hashes
from tracelight.operators.text import normalize_corpus


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# -- texts with injected characters, by id ------------------------------------------------------

_ACCENTS = {"é": "e" + chr(0x301), "è": "e" + chr(0x300), "ê": "e" + chr(0x302),
            "ä": "a" + chr(0x308), "ö": "o" + chr(0x308), "ü": "u" + chr(0x308)}


def dirty_documents(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    bare = text
    for whole, parts in _ACCENTS.items():
        bare = F.replace(bare, F.lit(whole), F.lit(parts))
    kind = F.col("doc_id") % 8
    return documents.withColumn(
        "text",
        F.when(kind == 0, F.replace(text, F.lit(". "), F.lit(".\r\n")))
        .when(kind == 1, F.regexp_replace(text, r"^(\S+\s+\S+\s+\S+)", "$1" + chr(0x200B)))
        .when(kind == 2, F.concat(F.lit(chr(0x202E)), text))
        .when(kind == 3, F.concat(text, F.lit(chr(7))))
        .when(kind == 4, F.regexp_replace(text, r"^(\S+) ", "$1" + chr(0xA0)))
        .when(kind == 5, F.concat(F.replace(text, F.lit("\n"), F.lit("  \n")), F.lit("  ")))
        .when(kind == 6, F.replace(text, F.lit(". "), F.lit(".\n\n\n\n")))
        .otherwise(bare),
    )


def _dirty_sql() -> str:
    bare = "text"
    for whole, parts in _ACCENTS.items():
        bare = f"replace({bare}, {q(whole)}, {q(parts)})"
    return f"""dirty AS (
  SELECT doc_id, lang, source, CASE doc_id % 8
    WHEN 0 THEN replace(text, '. ', '.' || chr(13) || chr(10))
    WHEN 1 THEN regexp_replace(text, '^(\\S+\\s+\\S+\\s+\\S+)', '\\1' || chr(8203))
    WHEN 2 THEN chr(8238) || text
    WHEN 3 THEN text || chr(7)
    WHEN 4 THEN regexp_replace(text, '^(\\S+) ', '\\1' || chr(160))
    WHEN 5 THEN replace(text, chr(10), '  ' || chr(10)) || '  '
    WHEN 6 THEN replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10))
    ELSE {bare} END AS text
  FROM documents)"""


_ZW, _CT = "".join(T.ZERO_WIDTH), T.CONTROLS.replace("\x00", "")


def _norm_sql(source: str) -> str:
    spaces = " " * len(T.SPECIAL_SPACES)
    gone = q(T.SPECIAL_SPACES + _ZW + T.BIDI + _CT)
    kinds = ", ".join(
        f"CASE WHEN contains(c, {q(ch)}) THEN {q(name)} END"
        for ch, name in sorted(T.ZERO_WIDTH.items(), key=lambda kv: kv[1])
    )
    return f"""norm0 AS (
  SELECT *, nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS c
  FROM {source}),
norm1 AS (SELECT *, translate(c, {gone}, {q(spaces)}) AS p FROM norm0),
norm2 AS (SELECT *, regexp_replace(p, '(?m)[ \\t]+$', '', 'g') AS t FROM norm1),
norm AS (
  SELECT doc_id, lang, source, text,
    trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS normalized,
    (length(text) - length(replace(text, chr(13) || chr(10), chr(10))))::BIGINT AS crlf_replaced,
    (length(c) - length(translate(c, {q(_ZW)}, '')))::BIGINT AS zero_width_removed,
    (length(c) - length(translate(c, {q(T.BIDI)}, '')))::BIGINT AS bidi_controls_removed,
    (length(c) - length(translate(c, {q(_CT)}, '')))::BIGINT AS control_chars_removed,
    (length(c) - length(translate(c, {q(T.SPECIAL_SPACES)}, '')))::BIGINT AS special_spaces_replaced,
    len(regexp_extract_all(p, '(?m)[ \\t]+$'))::BIGINT AS trailing_whitespace_lines,
    len(regexp_extract_all(t, '\\n{{3,}}'))::BIGINT AS blank_runs_collapsed,
    array_to_string(list_filter([{kinds}], lambda k: k IS NOT NULL), ',') AS zero_width_kinds
  FROM norm2)"""


def dirty_normalized(documents: DataFrame) -> DataFrame:
    return normalize_corpus(dirty_documents(documents))


DIRTY_NORM_SQL = f"{_dirty_sql()},\n{_norm_sql('dirty')}"
NORM_SQL = _norm_sql("documents")
WORDS_SQL = f"regexp_extract_all(%s, {q(T.WORD)})"


def sentences_sql(text: str) -> str:
    marked = f"regexp_replace({text}, '\\n\\s*\\n', chr(2), 'g')"
    marked = f"regexp_replace({marked}, {q(T.SPACE + '+')}, ' ', 'g')"
    marked = f"trim(regexp_replace({marked}, ' ?\\x02 ?', chr(2), 'g'), ' ')"
    end = T.SENTENCE_END
    marked = f"regexp_replace({marked}, {q(end)}, '\\1' || chr(1), 'g')"
    return f"list_filter(string_split_regex({marked}, '[\\x01\\x02]'), lambda s: s <> '')"


SENTENCES_SQL = f"sents AS (SELECT *, {sentences_sql('normalized')} AS ss FROM norm)"


# -- fingerprints ---------------------------------------------------------------------------------


def copies_with_variants(documents: DataFrame) -> DataFrame:
    """The documents plus, for every fifth one, a re-spaced and an upper-cased copy, so that all
    relations of the ladder occur."""
    fifth = F.col("doc_id") % 5 == 0
    spaced = documents.filter(fifth).select(
        (F.col("doc_id") + 1_000_000_000).alias("doc_id"),
        F.concat("text", F.lit("   ")).alias("text"),
        "lang",
        "source",
    )
    shouted = documents.filter(fifth).select(
        (F.col("doc_id") + 2_000_000_000).alias("doc_id"),
        F.concat(F.lit("-- "), "text").alias("text"),
        "lang",
        "source",
    )
    return (
        documents.select("doc_id", "text", "lang", "source").unionByName(spaced).unionByName(shouted)
    )


VARIANTS_SQL = """variants AS (
  SELECT doc_id, text, lang, source FROM documents
  UNION ALL SELECT doc_id + 1000000000, text || '   ', lang, source FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id + 2000000000, '-- ' || text, lang, source FROM documents WHERE doc_id % 5 = 0)"""


def hashes(documents: DataFrame) -> DataFrame:
    return text_hashes(normalize_corpus(documents), keep=("doc_id", "source")).drop("canonical")


def fingerprints(documents: DataFrame) -> DataFrame:
    return text_fingerprints(normalize_corpus(documents), keep=("doc_id", "source"))


CANON_SQL = f"""array_to_string(regexp_extract_all(
    replace(lower(nfc_normalize(normalized)), 'ß', 'ss'), {q(T.PLAIN_WORD)}), ' ')"""


def fp_sql(source: str = "documents") -> str:
    """CTEs up to ``fp`` (hashes, canonical) and ``shingle`` (doc_id, distinct h)."""
    return f"""{_norm_sql(source)},
fp AS (
  SELECT *, sha256(text) AS sha256, sha256(normalized) AS normalized_sha256,
    sha256(canonical) AS canonical_sha256
  FROM (SELECT *, {CANON_SQL} AS canonical FROM norm)),
toks AS (SELECT doc_id, CASE WHEN canonical = '' THEN [] ELSE string_split(canonical, ' ') END AS w FROM fp),
gram AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM toks),
shingle AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM gram)"""


def sig_sql() -> str:
    values = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(permutations()))
    return f"""perm(pos, a, b) AS (VALUES {values}),
slot AS (
  SELECT doc_id, pos, min((a::BIGINT * h + b) % 4294967311) AS v
  FROM shingle, perm GROUP BY doc_id, pos)"""
