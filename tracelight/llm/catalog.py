"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import (
    context_mixing,
    cost_packing,
    language_codes,
    lsh_forest,
    packing,
    pii_segments,
    quality_rules,
    secret_forest,
    target_resampling,
    token_counts,
    url_model,
    vector_codes,
    winnowing,
)
from tracelight.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


#: Lower-cases A-Z only.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op6_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
  dw AS (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
  hit AS (SELECT doc_id, item_id, s, k FROM dw JOIN iw USING (k, g)),
  n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
  m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLES["op9_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d WHERE len(w) > 0),
  z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hold FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * hold >= 80 * (x.n + y.n - hold)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, reach FROM r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS c FROM r GROUP BY 1) USING (doc_id)"""


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    part = fold(F.col("doc_id"))
    model = language_codes.train(docs.filter(part != 0), part == 1)
    return language_codes.predict_language(docs, model).withColumn("held_out", part == 0)


#: Host and path prefixes of the contract.
URL_RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}


def url_sql(rules: dict[str, str], terms: tuple[str, ...], order: int) -> str:
    """The whole of op2 in SQL: rules, labels, both models, calibration and verdicts."""

    def fits(rule: str) -> str:
        host, slash, rest = rule.partition("/")
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{rest}')"

    by_length = sorted(rules, key=lambda r: (-len(r), r))
    cases = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in by_length)
    blocked = ", ".join(f"'{r}'" for r, v in rules.items() if v == "block")
    spam = " OR ".join(f"contains(host, '{t}')" for t in terms)
    levels = f"p0 AS (SELECT gram, 1.0::DOUBLE / {url_model.ALPHABET} AS pa, 1.0::DOUBLE / {url_model.ALPHABET} AS pr FROM c)"
    for k in range(order + 1):

        def step(p: str, all_: str, n: str, kinds: str) -> str:
            return f"CASE WHEN {all_} > 0 THEN ({n} + {kinds} * {p}) / ({all_} + {kinds}) ELSE {p} END AS {p}"

        levels += f""",
  s{k} AS (SELECT right(gram, {k + 1}) AS s, sum(a)::BIGINT AS na, sum(r)::BIGINT AS nr FROM c GROUP BY 1),
  x{k} AS (SELECT left(s, {k}) AS x, sum(na)::BIGINT AS ta, sum(nr)::BIGINT AS tr, count(*) FILTER (na > 0) AS ka, count(*) FILTER (nr > 0) AS kr FROM s{k} GROUP BY 1),
  p{k + 1} AS (SELECT gram, {step('pa', 'ta', 'na', 'ka')}, {step('pr', 'tr', 'nr', 'kr')} FROM p{k} JOIN s{k} ON s = right(gram, {k + 1}) JOIN x{k} ON x = left(s, {k}))"""
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  v AS (SELECT *, host || path AS text, CASE {cases} END AS rule FROM u),
  t AS (SELECT text, min(CASE WHEN {spam} THEN 'rejected' WHEN host <> '' AND coalesce(rule NOT IN ({blocked}), true) THEN 'accepted' END) AS label,
    ('0x' || substr(md5(text), 1, 4))::INT % 5 = 0 AS cal FROM v GROUP BY text),
  g AS (SELECT text, CASE WHEN NOT cal THEN label END AS l, substr(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}) AS gram
    FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM t)),
  c AS (SELECT gram, count(*) FILTER (l = 'accepted') AS a, count(*) FILTER (l = 'rejected') AS r FROM g GROUP BY 1),
  {levels},
  m AS (SELECT gram, round((ln(pa) - ln(pr)) * 1e6)::BIGINT AS micro FROM p{order + 1}),
  z AS (SELECT text, sum(micro)::BIGINT AS micro, count(*) AS n FROM g JOIN m USING (gram) GROUP BY 1),
  h AS (SELECT floor(micro::DOUBLE / n / 1000) AS step, count(*) FILTER (label = 'accepted') AS a, count(*) FILTER (label = 'rejected') AS r
    FROM z JOIN t USING (text) WHERE cal AND label IS NOT NULL GROUP BY 1),
  w AS (SELECT *, sum(a) OVER () AS ga, sum(r) OVER () AS gr, sum(a) OVER (ORDER BY step DESC) AS sa, sum(r) OVER (ORDER BY step DESC) AS sr,
    coalesce(lag(step) OVER (ORDER BY step), step) AS low FROM h),
  b AS (SELECT coalesce((SELECT (low + step + 1) / 2 / 1000 FROM w WHERE ga > 0 AND gr > 0 ORDER BY sa / ga - sr / gr DESC, step LIMIT 1), '-infinity'::DOUBLE) AS least)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN coalesce(micro::DOUBLE / n / 1e6, 0) >= least THEN 'allow' ELSE 'block' END AS verdict, micro::DOUBLE / n / 1e6 AS score
FROM v LEFT JOIN z USING (text), b"""


ORACLES["op2_url_filters"] = url_sql(URL_RULES, url_model.REJECTED_TERMS, url_model.ORDER)


@query
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_model.filter_urls(table(spark, folder, "pages"), URL_RULES)


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii_segments.find_personal_data(docs, pii_segments.train(docs))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_quality_rules(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.decontaminate(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


@query
def op8_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_forest.scan_secrets(table(spark, folder, "documents"))


@query
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, folder, "documents"), width=2)


@query
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    parts = docs.withColumn("train", fold(F.col("doc_id")) != 1)
    return context_mixing.score_texts(parts).select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, folder, "embeddings"))


ORACLES["op11_vector_codes"] = vector_codes.compress_sql()


@query
def op12_cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    return cost_packing.pack_by_cost(table(spark, folder, "documents"))


@query
def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return target_resampling.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


#: CRC-32 bit by bit over the hex digits of a feature; everything else as the contract says it.
ORACLES["op13_target_resampling"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  e AS MATERIALIZED (SELECT regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  g AS MATERIALIZED (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM d),
  h AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM e),
  x AS (SELECT DISTINCT f, hex(encode(f)) AS hx FROM (SELECT f FROM g UNION ALL SELECT f FROM h)),
  b AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(4 * len(hx)),
      lambda k: (('0x' || substr(hx, 2 * (k // 8) + 1, 2))::BIGINT >> (k % 8)) & 1)),
      lambda c, v: xor(c >> 1, 3988292384::BIGINT * (xor(c, v) & 1))), 4294967295::BIGINT) % 10000 AS bucket FROM x),
  s AS (SELECT bucket, count(*) AS s FROM g JOIN b USING (f) GROUP BY 1),
  t AS (SELECT bucket, count(*) AS t FROM h JOIN b USING (f) GROUP BY 1),
  n AS (SELECT (SELECT count(*) FROM g) + 10000 AS alls, (SELECT count(*) FROM h) + 10000 AS allt),
  a AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * alls / ((s + 1)::DOUBLE * allt)))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), n),
  m AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM g JOIN b USING (f) JOIN a USING (bucket) GROUP BY 1),
  z AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
      ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS noise FROM d LEFT JOIN m USING (doc_id)),
  y AS (SELECT *, weight + floor(-1000 * ln(-ln((noise + 0.5) / 4294967296)))::BIGINT AS score FROM z),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE words >= 20
    QUALIFY rank <= 25 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM y LEFT JOIN r USING (doc_id)"""
