"""Source queries: pages, URLs, phrase search, matches, timestamps, storage and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.functions import urls
from tracelight.operators import sources as op
from tracelight.operators import text as text_op
from tracelight.plans.derive import NORM_SQL, SENTENCES_SQL, WORDS_SQL, q
from tracelight.plans.registry import Tables, query
from tracelight.sources import files as fileop

_PLAIN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(html, '<[^>]+>', '', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'),
    '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"""
_HOST = f"lower(regexp_extract(url, {q(urls.HOST)}, 1))"


@query("html_to_text", f"SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, {_PLAIN} AS t FROM pages)")
def _(t: Tables):
    return op.html_to_text(t.pages).select(
        "page_id", F.md5("text").alias("digest"), F.length("text").alias("n")
    )


def _mixed_urls(t: Tables) -> DataFrame:
    """The page URLs, some turned into relative, script, data and credential forms."""
    k, url = F.col("page_id") % 9, F.col("url")
    return t.pages.select(
        "page_id",
        F.when(k == 0, F.concat(F.lit("javascript:"), url))
        .when(k == 1, F.regexp_replace(url, "^https?://", "/"))
        .when(k == 2, F.regexp_replace(url, "^https?://", "HTTPS://user:pw@WWW."))
        .when(k == 3, F.lit("http://"))
        .otherwise(url)
        .alias("url"),
    )


_MIXED = """mixed AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'javascript:' || url
    WHEN 1 THEN regexp_replace(url, '^https?://', '/')
    WHEN 2 THEN regexp_replace(url, '^https?://', 'HTTPS://user:pw@WWW.') WHEN 3 THEN 'http://' ELSE url END AS url FROM pages)"""


@query("web_urls", f"WITH {_MIXED} SELECT page_id, url, regexp_replace({_HOST}, '^www\\.', '') AS host FROM mixed WHERE {_HOST} <> ''")
def _(t: Tables):
    return op.web_urls(_mixed_urls(t)).withColumn("host", urls.host_of(F.col("url")))


@query(
    "allowlisted_hosts",
    f"""WITH {_MIXED} SELECT page_id, url FROM mixed WHERE {_HOST} IN ('example.com', 'example.org')
      OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.org'""",
)
def _(t: Tables):
    allow = t.spark.createDataFrame([("example.com",), (" Example.ORG. ",), ("",)], "host string")
    return op.allowlisted_hosts(_mixed_urls(t), allow)


@query(
    "clean_names",
    """WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '..hidden "' || page_id || '".txt '
      WHEN 1 THEN 'C:\\dir\\a' || chr(9) || 'b''c.png' WHEN 2 THEN '..' ELSE url END AS name FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(name, '[\\x00-\\x1f\\x7f]', '', 'g'), '^[\\s\\S]*[\\\\/]', '') AS n FROM n)
    SELECT page_id, nullif(left(trim(regexp_replace(trim(regexp_replace(n, '["'']', '', 'g')), '^\\.+', '')), 255), '') AS clean_name FROM b""",
)
def _(t: Tables):
    k, pid = F.col("page_id") % 5, F.col("page_id")
    named = t.pages.select(
        "page_id",
        F.when(k == 0, F.concat(F.lit('..hidden "'), pid, F.lit('".txt ')))
        .when(k == 1, F.lit("C:\\dir\\a\tb'c.png"))
        .when(k == 2, F.lit(".."))
        .otherwise(F.col("url"))
        .alias("name"),
    )
    return op.clean_names(named, "name").drop("name")


@query(
    "bounded_payload",
    """SELECT page_id, octet_length(encode(html)) > 2000 AS cut,
      CASE WHEN octet_length(encode(html)) > 2000 THEN octet_length(encode(html)) END AS bytes,
      md5(CASE WHEN octet_length(encode(html)) > 2000 THEN substr(html, 1, 2048) ELSE html END) AS digest FROM pages""",
)
def _(t: Tables):
    out = op.bounded_payload(t.pages, "html", 2000)
    cut = F.coalesce(F.get_json_object("html", "$._truncated") == "true", F.lit(False))
    return out.select(
        "page_id",
        cut.alias("cut"),
        F.when(cut, F.get_json_object("html", "$._bytes").cast("long")).alias("bytes"),
        F.md5(F.when(cut, F.get_json_object("html", "$._preview")).otherwise(F.col("html"))).alias("digest"),
    )


def corpus(t: Tables) -> DataFrame:
    """Pages first, then the benchmark passages, as places where a phrase can be found."""
    pages = op.html_to_text(t.pages).select(
        F.col("page_id").alias("source_id"), F.lit(0).alias("backend"), "url", "text"
    )
    passages = t.benchmark.select(
        F.col("item_id").alias("source_id"),
        F.lit(1).alias("backend"),
        F.concat(F.lit("https://passages.example.net/"), F.col("item_id")).alias("url"),
        "text",
    )
    return pages.unionByName(passages)


def document_matches(t: Tables) -> DataFrame:
    phrases = text_op.distinctive_phrases(text_op.normalize_corpus(t.documents))
    return op.phrase_search(phrases, corpus(t))


PHRASES_SQL = f"""{NORM_SQL}, {SENTENCES_SQL},
    s0 AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sents),
    w0 AS (SELECT doc_id, i, {WORDS_SQL % 's'} AS w FROM s0
      WHERE NOT regexp_matches(s, '(?i)^(dear|regards|sincerely|thanks|thank you|hello|hi)\\b')),
    c0 AS (SELECT *, list_filter(w, lambda x: NOT list_contains([{', '.join(q(w) for w in text_op.STOPWORDS)}], lower(x))) AS c FROM w0 WHERE len(w) >= 6),
    p0 AS (SELECT doc_id, i, array_to_string(w[1:10], ' ') AS phrase,
      CASE WHEN len(c) > 0 THEN length(array_to_string(c, '')) / len(c) * (len(c) / len(w)) ELSE 0 END AS score FROM c0),
    d0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(phrase) ORDER BY score DESC, i) AS first FROM p0),
    phrases AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS phrase_index
      FROM d0 WHERE first = 1 QUALIFY phrase_index <= 5)"""
MATCHES_SQL = f"""{PHRASES_SQL},
    corpus AS (SELECT page_id AS source_id, 0 AS backend, url, {_PLAIN} AS text FROM pages
      UNION ALL SELECT item_id, 1, 'https://passages.example.net/' || item_id, text FROM benchmark),
    cw AS (SELECT source_id, backend, url, list_transform({WORDS_SQL % 'text'}, lambda x: lower(x)) AS w,
      lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM corpus),
    win AS (SELECT DISTINCT source_id, backend, url, body, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM cw, (VALUES (6), (7), (8), (9), (10)) l(n) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, url, phrase, phrase_index, backend, source_id,
      CASE WHEN contains(body, lower(phrase)) THEN 1.0::DOUBLE END AS similarity
      FROM phrases JOIN win ON win.k = lower(phrase)),
    firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, url ORDER BY phrase_index, backend, source_id) = 1),
    matches AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phrase_index, backend, source_id) AS rank
      FROM firsts QUALIFY rank <= 50)"""


@query("phrase_search", f"WITH {MATCHES_SQL} SELECT doc_id, rank, url, phrase, similarity FROM matches")
def _(t: Tables):
    return document_matches(t).select("doc_id", "rank", "url", "phrase", "similarity")


def planted_hits(t: Tables) -> DataFrame:
    """Order lines as hits: item = part, url from the supplier, several backends per url."""
    return t.lineitem.select(
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_suppkey") % 11 == 0, F.lit("data:x"))
        .otherwise(F.concat(F.lit("https://www.s"), F.col("l_suppkey") % 40, F.lit(".example.com/")))
        .alias("url"),
        F.struct(
            (F.col("l_linenumber") % 3).alias("backend"), F.col("l_orderkey"), F.col("l_linenumber"),
            F.col("l_extendedprice"),
        ).alias("order"),
        F.col("l_returnflag").alias("source_kind"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("similarity"),
        F.when(
            F.col("l_quantity") % 3 == 0, F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")
        )
        .when(F.col("l_quantity") % 3 == 1, F.lit("unknown"))
        .alias("published_at"),
    )


_HITS = """hits AS (SELECT l_partkey AS item_id,
    CASE WHEN l_suppkey % 11 = 0 THEN 'data:x' ELSE 'https://www.s' || l_suppkey % 40 || '.example.com/' END AS url,
    l_linenumber % 3 AS backend, l_orderkey, l_linenumber, l_extendedprice, l_returnflag AS source_kind,
    CASE WHEN l_linestatus = 'F' THEN l_discount END AS similarity,
    CASE WHEN l_quantity % 3 = 0 THEN strftime(l_shipdate, '%Y:%m:%d %H:%M:%S') WHEN l_quantity % 3 = 1 THEN 'unknown' END AS published_at
    FROM lineitem),
  firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY item_id, url ORDER BY backend, l_orderkey, l_linenumber, l_extendedprice) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY backend, l_orderkey, l_linenumber, l_extendedprice) AS rank
    FROM firsts WHERE url <> 'data:x' QUALIFY rank <= 20)"""


def ranked_hits(t: Tables) -> DataFrame:
    return op.rank_matches(op.match_pages_by_first_url(planted_hits(t), ["item_id"]), 20)


@query("match_pages_by_first_url", f"WITH {_HITS} SELECT item_id, url, l_orderkey AS chosen, source_kind FROM firsts")
def _(t: Tables):
    merged = op.match_pages_by_first_url(planted_hits(t), ["item_id"])
    return merged.select("item_id", "url", F.col("order.l_orderkey").alias("chosen"), "source_kind")


@query("rank_matches", f"WITH {_HITS} SELECT item_id, url, rank FROM ranked")
def _(t: Tables):
    return ranked_hits(t).select("item_id", "url", "rank")


@query(
    "matches_summary",
    f"""WITH {_HITS},
    h AS (SELECT *, regexp_replace({_HOST}, '^www\\.', '') AS host, try_strptime(published_at, '%Y:%m:%d %H:%M:%S') AS pub FROM ranked),
    d AS (SELECT item_id, host, count(*) AS n, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, host) AS i FROM h GROUP BY 1, 2),
    k AS (SELECT item_id, source_kind, count(*) AS n FROM h GROUP BY 1, 2)
    SELECT item_id, count(*) AS match_count, min(similarity) AS similarity_min, max(similarity) AS similarity_max,
      count(published_at) AS dated_count, epoch(min(pub))::BIGINT AS earliest_at, arg_min(url, (pub, rank)) FILTER (pub IS NOT NULL) AS earliest_url,
      (SELECT count(*) FROM d WHERE d.item_id = h.item_id) AS domain_count,
      (SELECT string_agg(host, ',' ORDER BY i) FROM d WHERE d.item_id = h.item_id) AS domains,
      (SELECT string_agg(source_kind || '=' || n, ',' ORDER BY source_kind) FROM k WHERE k.item_id = h.item_id) AS kinds
    FROM h GROUP BY item_id""",
)
def _(t: Tables):
    out = op.matches_summary(ranked_hits(t))
    return out.withColumns(
        {
            "earliest_at": F.unix_timestamp("earliest_at"),
            "domains": F.array_join("domains", ","),
            "kinds": F.array_join(
                F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
            ),
        }
    )


def rendered_times(t: Tables) -> DataFrame:
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 6
    return t.events.select(
        "event_id",
        F.when(k == 0, F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
        .when(k == 1, F.concat(F.date_format(ts, "yyyy:MM:dd HH:mm:ss"), F.lit("+02:30")))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-0500")))
        .when(k == 4, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.array_join(F.array(F.lit("0000"), F.date_format(ts, "MM:dd HH:mm:ss")), ":"))
        .alias("raw"),
    )


@query(
    "parse_timestamps",
    """SELECT event_id, event_id % 6 IN (1, 2, 3) AS tz_known, CASE event_id % 6
      WHEN 0 THEN epoch(date_trunc('second', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) - 9000
      WHEN 2 THEN epoch(date_trunc('second', ts)) WHEN 3 THEN epoch(date_trunc('second', ts)) + 18000
      WHEN 4 THEN epoch(date_trunc('day', ts)) END::BIGINT AS event_time FROM events""",
)
def _(t: Tables):
    out = op.parse_timestamps(rendered_times(t), "raw")
    return out.select("event_id", "tz_known", F.unix_timestamp("event_time").alias("event_time"))


@query(
    "validity_at",
    """WITH w AS (SELECT o_custkey AS signer, min(o_orderdate) + INTERVAL 200 DAY AS a, max(o_orderdate) - INTERVAL 200 DAY AS b
      FROM orders WHERE o_custkey % 10 <> 0 GROUP BY 1)
    SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate BETWEEN a AND b END AS valid
    FROM orders LEFT JOIN w ON w.signer = o_custkey""",
)
def _(t: Tables):
    day = F.expr("INTERVAL 200 DAYS")
    when = F.col("o_orderdate").cast("timestamp")
    windows = (
        t.orders.filter(F.col("o_custkey") % 10 != 0)
        .groupBy(F.col("o_custkey").alias("signer"))
        .agg((F.min(when) + day).alias("not_before"), (F.max(when) - day).alias("not_after"))
    )
    signed = t.orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_custkey").alias("signer"),
        F.when(F.col("o_orderkey") % 13 != 0, when).alias("signed_at"),
    )
    return op.validity_at(signed, windows, "signer", "signed_at").select("item_id", "valid")


@query(
    "time_conflicts",
    """WITH s AS (SELECT l_orderkey AS k, min(l_shipdate) AS p FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey AS item_id, o_orderdate + to_seconds(30 * (o_orderkey % 8)) AS cap, o_orderdate AS sig, p
      FROM orders LEFT JOIN s ON k = o_orderkey)
    SELECT item_id, 'capture-after-signing' AS conflict, (epoch(cap) - epoch(sig))::BIGINT AS gap_s FROM c WHERE epoch(cap) - epoch(sig) > 60
    UNION ALL SELECT item_id, 'published-before-capture', (epoch(cap) - epoch(p))::BIGINT FROM c WHERE epoch(cap) - epoch(p) > 60""",
)
def _(t: Tables):
    when = F.col("o_orderdate").cast("timestamp")
    shift = F.expr("make_dt_interval(0, 0, 0, 30 * (o_orderkey % 8))")
    captured = t.orders.select(F.col("o_orderkey").alias("item_id"), (when + shift).alias("captured_at"))
    signed = t.orders.select(F.col("o_orderkey").alias("item_id"), when.alias("signed_at"))
    published = t.lineitem.select(
        F.col("l_orderkey").alias("item_id"), F.col("l_shipdate").cast("timestamp").alias("published_at")
    )
    return op.time_conflicts(captured, signed, published)


@query(
    "verify_integrity",
    """SELECT doc_id AS item_id, CASE WHEN doc_id % 10 = 1 THEN 'MISSING' WHEN doc_id % 10 = 2 THEN 'UNRECORDED'
      WHEN doc_id % 10 = 3 THEN 'HASH_MISMATCH' ELSE 'BAD_ENCODING' END AS problem FROM documents WHERE doc_id % 10 BETWEEN 1 AND 4""",
)
def _(t: Tables):
    k = F.col("item_id") % 10
    base = t.documents.select(F.col("doc_id").alias("item_id"), F.encode("text", "UTF-8").alias("content"))
    content = F.when(k == 4, F.concat(F.col("content"), F.unhex(F.lit("C328")))).otherwise(F.col("content"))
    stored = base.withColumn("content", content)
    records = stored.filter(k != 2).select(
        "item_id",
        F.sha2(F.when(k == 3, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content")), 256).alias("sha256"),
    )
    return fileop.verify_integrity(stored.filter(k != 1), records)


@query(
    "replace_by_key",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS v FROM lineitem WHERE l_orderkey % 3 <> 0
    UNION ALL SELECT DISTINCT l_orderkey, 0, 1.5 FROM lineitem WHERE l_orderkey % 3 = 0""".replace("l_linenumber AS n", "l_linenumber::BIGINT AS n"),
)
def _(t: Tables):
    existing = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("v")
    )
    fresh = existing.filter(F.col("k") % 3 == 0).select("k", F.lit(0).alias("n"), F.lit(1.5).alias("v")).distinct()
    return fileop.replace_by_key(existing, fresh, "k")


@query(
    "merge_columns",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 9 END AS quality, doc_id * 2 AS checked FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, coalesce(p.quality, l.quality)::BIGINT AS quality, l.toxic::BIGINT AS toxic, checked
    FROM labels l FULL JOIN p USING (doc_id)""",
)
def _(t: Tables):
    key = F.col("doc_id")
    patch = t.documents.filter(key % 3 == 0).select(
        "doc_id", F.when(key % 2 == 0, 9).alias("quality"), (key * 2).alias("checked")
    )
    return fileop.merge_columns(t.labels, patch, "doc_id")
