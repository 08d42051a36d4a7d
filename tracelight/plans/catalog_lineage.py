"""Lineage, graph, outlier, language and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.columns import indexes
from tracelight.operators import graph, language, lineage, outliers
from tracelight.operators.text import canonicalize, normalize_corpus
from tracelight.plans.derive import fp_sql
from tracelight.plans.registry import Tables, query
from tracelight.sources.files import ingest_files

# Tags per item of six events; the expressions read the same in both engines but for {TS}.
_IT = "CAST(floor(event_id / 6.0) AS BIGINT)"
_TAG_KEY = f"""CASE event_id % 6 WHEN 0 THEN 'EXIF:Make' WHEN 1 THEN 'XMP:Make'
    WHEN 2 THEN CASE WHEN {_IT} % 3 <> 0 THEN 'EXIF:DateTimeOriginal' ELSE 'XMP:Software' END
    WHEN 3 THEN 'XMP:CreatorTool'
    WHEN 4 THEN CASE WHEN {_IT} % 5 = 0 THEN 'PNG:parameters' WHEN {_IT} % 5 IN (1, 2) THEN 'PNG:Comment' ELSE 'EXIF:GPSLatitude' END
    ELSE CASE WHEN {_IT} % 2 = 0 THEN 'EXIF:OffsetTimeOriginal' ELSE 'XMP:History' END END"""
_TAG_VALUE = f"""CASE event_id % 6 WHEN 0 THEN CASE WHEN {_IT} % 5 = 0 THEN '' ELSE concat('Make', {_IT} % 7) END
    WHEN 1 THEN concat('XMake', {_IT} % 3)
    WHEN 2 THEN CASE WHEN {_IT} % 3 <> 0 THEN {{TS}} ELSE 'Soft' END
    WHEN 3 THEN CASE {_IT} % 4 WHEN 0 THEN 'Midjourney v6' WHEN 1 THEN 'comfyui  build' ELSE concat('Editor ', {_IT} % 9) END
    WHEN 4 THEN CASE WHEN {_IT} % 5 = 0 THEN 'Steps: 20' WHEN {_IT} % 5 = 1 THEN 'Seed: 42 x' WHEN {_IT} % 5 = 2 THEN 'plain' ELSE '48.5' END
    ELSE CASE WHEN {_IT} % 2 = 0 THEN '+02:00' ELSE concat('[{{"Action":"saved","softwareAgent":"Ed","when":"', {{TS}}, '"}},{{"ACTION":"cropped"}},{{"when":"x"}}]') END END"""
_TS_SPARK = "date_format(ts, 'yyyy:MM:dd HH:mm:ss')"
_TS_SQL = "strftime(ts, '%Y:%m:%d %H:%M:%S')"


def tags(t: Tables) -> DataFrame:
    value = _TAG_VALUE.replace("{TS}", _TS_SPARK).replace("{{", "{").replace("}}", "}")
    return t.events.select(
        F.expr(_IT).alias("item_id"),
        F.expr(f"split_part({_TAG_KEY}, ':', 1)").alias("grp"),
        F.expr(f"split_part({_TAG_KEY}, ':', 2)").alias("tag"),
        F.expr(value).alias("value"),
    )


_TAGS = f"""tags AS (SELECT {_IT} AS item_id, split_part({_TAG_KEY}, ':', 1) AS grp, split_part({_TAG_KEY}, ':', 2) AS tag,
    {_TAG_VALUE.replace('{TS}', _TS_SQL).replace('{{', '{').replace('}}', '}')} AS value FROM events)"""


def _pick(*keys: str) -> str:
    parts = [
        f"max(nullif(value, '')) FILTER (grp = '{k.split(':')[0]}' AND tag = '{k.split(':')[1]}')" for k in keys
    ]
    return f"coalesce({', '.join(parts)})"


@query(
    "normalize_tags",
    f"""WITH {_TAGS}, w AS (SELECT item_id, {_pick('EXIF:Make', 'XMP:Make')} AS camera_make,
      {_pick('EXIF:Software', 'XMP:CreatorTool', 'XMP:Software')} AS software,
      {_pick('EXIF:DateTimeOriginal', 'XMP:DateTimeOriginal', 'EXIF:CreateDate')} AS captured_raw,
      {_pick('EXIF:OffsetTimeOriginal', 'EXIF:OffsetTime')} AS o, bool_or(grp = 'EXIF') AS has_exif, bool_or(grp = 'XMP') AS has_xmp,
      bool_or(grp = 'IPTC') AS has_iptc, bool_or(grp = 'EXIF' AND tag LIKE 'GPS%' AND value <> '') AS gps_present, count(*) AS tag_count
      FROM tags GROUP BY 1)
    SELECT item_id, camera_make, software, captured_raw, has_exif, has_xmp, has_iptc, gps_present, tag_count,
      (epoch(strptime(captured_raw, '%Y:%m:%d %H:%M:%S')) - CASE WHEN o IS NULL THEN 0 ELSE 7200 END)::BIGINT AS captured_at,
      captured_raw IS NOT NULL AND o IS NOT NULL AS captured_tz_known FROM w""",
)
def _(t: Tables):
    out = lineage.normalize_tags(tags(t))
    return out.select(
        "item_id", "camera_make", "software", "captured_raw", "has_exif", "has_xmp", "has_iptc", "gps_present", "tag_count",
        F.unix_timestamp("captured_at").alias("captured_at"), "captured_tz_known",
    )


_GPS = {
    "GPSLatitude": "CASE k % 4 WHEN 0 THEN '[48, 30, 36]' WHEN 1 THEN '48.5' WHEN 2 THEN '95' ELSE 'junk' END",
    "GPSLatitudeRef": "CASE WHEN k % 2 = 0 THEN 'N' ELSE 's' END",
    "GPSLongitude": "CASE k % 3 WHEN 0 THEN '[2, 20]' WHEN 1 THEN '200' ELSE '11.25' END",
    "GPSLongitudeRef": "CASE WHEN k % 5 = 0 THEN 'W' ELSE 'E' END",
    "GPSAltitude": "CASE WHEN k % 7 <> 0 THEN '120.5' END",
    "GPSAltitudeRef": "CASE WHEN k % 11 = 0 THEN '1' ELSE '0' END",
}


@query(
    "gps_positions",
    """WITH g AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 48 + 30 / 60 + 36 / 3600 WHEN 1 THEN -48.5::DOUBLE WHEN 2 THEN 95 END AS la,
        CASE o_orderkey % 3 WHEN 0 THEN 2 + 20 / 60 WHEN 1 THEN 200 ELSE 11.25::DOUBLE END * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS lo FROM orders),
      j AS (SELECT *, coalesce(la BETWEEN -90 AND 90, false) AS a, coalesce(lo BETWEEN -180 AND 180, false) AS b FROM g)
    SELECT k AS item_id, CASE WHEN a AND b THEN floor(la * 1000000 + 0.5) END::BIGINT AS lat_e6, CASE WHEN a AND b THEN floor(lo * 1000000 + 0.5) END::BIGINT AS lon_e6,
      CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 11 = 0 THEN -120.5 ELSE 120.5 END END::DOUBLE AS altitude_m,
      array_to_string(list_filter([CASE WHEN NOT (la BETWEEN -90 AND 90) THEN 'latitude out of range' END,
        CASE WHEN NOT (lo BETWEEN -180 AND 180) THEN 'longitude out of range' END, CASE WHEN a <> b THEN 'position incomplete' END], lambda x: x IS NOT NULL), ',') AS warnings FROM j""",
)
def _(t: Tables):
    rows = t.orders.select(
        F.col("o_orderkey").alias("k"),
    ).select(
        F.col("k").alias("item_id"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("tag"), F.expr(e).alias("value")) for n, e in _GPS.items()])).alias("x"),
    ).select("item_id", F.lit("EXIF").alias("grp"), "x.*")
    micro = lambda c: F.floor(F.col(c) * 1000000 + 0.5)
    return lineage.gps_positions(rows).select(
        "item_id", micro("latitude").alias("lat_e6"), micro("longitude").alias("lon_e6"), "altitude_m", F.array_join("warnings", ",").alias("warnings")
    )


@query(
    "generator_markers",
    f"""WITH {_TAGS}, m AS (SELECT item_id, grp || ':' || tag AS tag, regexp_replace(value, '\\s+', ' ', 'g') AS excerpt, CASE
      WHEN grp = 'PNG' AND tag = 'parameters' THEN 'Stable Diffusion WebUI'
      WHEN grp = 'PNG' AND value LIKE 'Seed: 42%' THEN 'unspecified AI generator'
      WHEN tag = 'CreatorTool' AND value LIKE 'Mid%' THEN 'Midjourney' WHEN tag = 'CreatorTool' AND value LIKE 'comfy%' THEN 'ComfyUI' END AS generator FROM tags)
    SELECT * FROM m WHERE generator IS NOT NULL""",
)
def _(t: Tables):
    return lineage.generator_markers(tags(t))


@query(
    "edit_history",
    f"""WITH e AS (SELECT {_IT} AS item_id, ts FROM events WHERE event_id % 6 = 5 AND {_IT} % 2 = 1)
    SELECT item_id, 0::BIGINT AS position, 'saved' AS action, 'Ed' AS software, epoch(date_trunc('second', ts))::BIGINT AS event_time FROM e
    UNION ALL SELECT item_id, 1, 'cropped', NULL, NULL FROM e""",
)
def _(t: Tables):
    return lineage.edit_history(tags(t)).select(
        "item_id", "position", "action", "software", F.unix_timestamp("event_time").alias("event_time")
    )


_URIS = ["http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia", " algorithmicMedia/ ", "http://x.example/a/digitalCapture//"]


@query(
    "source_types",
    """SELECT o_orderkey AS item_id, ['trainedAlgorithmicMedia', 'algorithmicMedia', 'digitalCapture'][o_orderkey % 3 + 1] AS short,
      o_orderkey % 3 < 2 AS algorithmic FROM orders""",
)
def _(t: Tables):
    uri = F.get(F.array(*[F.lit(u) for u in _URIS]), (F.col("o_orderkey") % 3).cast("int"))
    return lineage.source_types(t.orders.select(F.col("o_orderkey").alias("item_id"), uri.alias("uri"))).drop("uri")


_CODES = [
    ("claimSignature.validated", None, "info"),
    ("assertion.dataHash.mismatch", None, "integrity"),
    ("signingCredential.untrusted", None, "trust"),
    ("timeStamp.mismatch", None, "trust"),
    ("cawg.identity.validated", None, "identity"),
    ("general.error", "certificate is Untrusted", "trust"),
    ("general.error", "bad box", "integrity"),
    ("assertion.missing", None, "integrity"),
    ("manifest.unknownNote", None, "info"),
]


@query(
    "classify_codes",
    f"""WITH c AS (SELECT user_id AS item_id, [{', '.join(repr(f) for _, _, f in _CODES)}][event_id % 9 + 1] AS f FROM events)
    SELECT item_id, {', '.join(f"count(*) FILTER (f = '{f}') AS {f}" for f in ('integrity', 'trust', 'identity', 'info'))} FROM c GROUP BY 1""",
)
def _(t: Tables):
    listed = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(e).cast("string").alias("explanation")) for c, e, _ in _CODES])
    codes = t.events.select(F.col("user_id").alias("item_id"), F.get(listed, (F.col("event_id") % 9).cast("int")).alias("c"))
    return lineage.classify_codes(codes.select("item_id", "c.*"))


def manifest_stores(t: Tables) -> DataFrame:
    """One manifest store per order in JSON, with (key % 6) ingredients; every fifth one failed."""

    def ingredient(i):
        label = F.concat(F.lit("urn:"), F.col("item_id"), F.lit("/"), i)
        code = F.when((F.col("item_id") + i) % 5 == 0, "assertion.hashedURI.mismatch").otherwise("assertion.dataHash.match")
        return F.struct(
            label.alias("title"), label.alias("active_manifest"), F.lit("componentOf").alias("relationship"),
            F.array(F.struct(code.alias("code"), F.lit("x").alias("explanation"))).alias("validation_status"),
        )

    n = (F.col("item_id") % 6).cast("int")
    per_order = t.orders.select(F.col("o_orderkey").alias("item_id")).withColumn(
        "ingredients", F.transform(indexes(n), lambda i: ingredient(i + 1))
    )
    k = F.col("item_id")
    actions = F.when(
        k % 2 == 0,
        F.lit('{"actions":[{"action":"c2pa.created","when":"2024-01-01T00:00:00Z","softwareAgent":"Tool","digitalSourceType":"http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"},{"action":"c2pa.edited","softwareAgent":{"name":"Ed","version":"2"}}]}'),
    ).otherwise(F.lit('{"actions":[{"action":"c2pa.opened","softwareAgent":"Tool"}]}'))
    training = F.when(k % 3 == 0, F.lit('{"label":"cawg.training-mining","data":{"entries":{"ai_train":{"use":"notAllowed"}}}},')).otherwise("")
    identity = F.when(k % 5 == 0, F.lit('{"label":"cawg.identity","data":{}},')).otherwise("")
    store = F.concat(
        F.lit('{"active_manifest":"urn:'), k, F.lit('","manifests":{"urn:'), k,
        F.lit('":{"claim_generator":"gen/1","claim_generator_info":[{"name":"Tool"}],"signature_info":{"issuer":"Signer","time":"2024-01-02T00:00:00Z"},"ingredients":'),
        F.to_json("ingredients"), F.lit(',"assertions":['), training, identity,
        F.lit('{"label":"c2pa.hash.data","data":{"alg":"sha256","exclusions":[{"start":1,"length":2}]}},{"label":"c2pa.actions","data":'), actions,
        F.lit("}]},"), F.lit('"urn:'), k, F.lit('/1":{"claim_generator":"old"}},"validation_status":['),
        F.when(k % 7 == 0, F.lit('{"code":"assertion.dataHash.mismatch"},')).otherwise(""),
        F.lit('{"code":"claimSignature.validated"}]}'),
    )
    return per_order.select("item_id", store.alias("store"))


@query(
    "flatten_manifests",
    """WITH k AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS item_id, 2::BIGINT AS manifest_count, k % 6 AS ingredient_count,
      len(list_filter(range(1, k % 6 + 1), lambda i: (k + i) % 5 = 0))::BIGINT AS ingredient_failures,
      CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS action_count, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS agent_count,
      CASE WHEN k % 2 = 0 THEN 'trainedAlgorithmicMedia' ELSE '' END AS source_types, k % 3 = 0 AS training,
      k % 5 = 0 AS identity_present, 'sha256' AS hash_alg, 1::BIGINT AS excluded_ranges, k % 7 <> 0 AS valid_signature,
      nullif(k % 6, 0) AS edges FROM k""",
)
def _(t: Tables):
    flat = lineage.flatten_manifests(manifest_stores(t))
    edges = flat.edges.groupBy("item_id").agg(F.count(F.lit(1)).alias("edges"))
    return flat.summary.join(edges, "item_id", "left").select(
        "item_id", "manifest_count", "ingredient_count", "ingredient_failures", "action_count", "agent_count",
        F.array_join("source_types", ",").alias("source_types"), F.coalesce(F.size("training_mining") > 0, F.lit(False)).alias("training"),
        "identity_present", "hash_alg", "excluded_ranges", "valid_signature", "edges",
    )


@query(
    "flatten_manifest_actions",
    """WITH k AS (SELECT o_orderkey AS k FROM orders)
    SELECT k AS item_id, 0::BIGINT AS position, CASE WHEN k % 2 = 0 THEN 'c2pa.created' ELSE 'c2pa.opened' END AS action, 'Tool' AS agent, NULL AS version FROM k
    UNION ALL SELECT k, 1, 'c2pa.edited', 'Ed', '2' FROM k WHERE k % 2 = 0""",
)
def _(t: Tables):
    return lineage.flatten_manifests(manifest_stores(t)).actions.select(
        "item_id", "position", "action", F.col("agent.name").alias("agent"), F.col("agent.version").alias("version")
    )


# -- graph ----------------------------------------------------------------------------------------

_THIRD = "CAST(floor(doc_id / 3.0) AS BIGINT)"
_GRAPH = f"""edges AS (SELECT {_THIRD} AS parent, doc_id AS child FROM documents WHERE doc_id >= 3),
    roots AS (SELECT doc_id AS root FROM documents WHERE doc_id NOT IN (SELECT child FROM edges)),
    chain(root, node, parent, depth) AS (SELECT root, root, NULL::BIGINT, 0::BIGINT FROM roots
      UNION ALL SELECT root, child, node, depth + 1 FROM chain JOIN edges ON edges.parent = chain.node)"""


def _edges(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("doc_id") >= 3).select(F.expr(_THIRD).alias("parent"), F.col("doc_id").alias("child"))


def _roots(t: Tables) -> DataFrame:
    """Documents that nothing contains."""
    return t.documents.select(F.col("doc_id").alias("root")).join(
        _edges(t).select(F.col("child").alias("root")), "root", "left_anti"
    )


@query("manifest_chain", f"WITH RECURSIVE {_GRAPH} SELECT * FROM chain")
def _(t: Tables):
    return graph.manifest_chain(_edges(t), _roots(t))


@query(
    "ingredient_tree_failures",
    f"""WITH RECURSIVE {_GRAPH} SELECT root, count(*) AS nodes, count(*) FILTER (node % 7 = 3) AS failures FROM chain
    WHERE depth BETWEEN 1 AND 8 GROUP BY 1""",
)
def _(t: Tables):
    failed = t.documents.filter(F.col("doc_id") % 7 == 3).select(F.col("doc_id").alias("node"))
    return graph.ingredient_tree_failures(_edges(t), failed, _roots(t), 8)


_SIGNED = f"CASE WHEN doc_id % 17 = 0 THEN 1700000000 - {_THIRD} + 7200 ELSE 1700000000 - doc_id END"


@query(
    "order_conflicts",
    f"""WITH RECURSIVE {_GRAPH}, s AS (SELECT doc_id, {_SIGNED} AS at_s FROM documents)
    SELECT root, parent, node, (c.at_s - p.at_s)::BIGINT AS gap_s FROM chain JOIN s c ON c.doc_id = node JOIN s p ON p.doc_id = parent WHERE c.at_s - p.at_s > 60""",
)
def _(t: Tables):
    signed = t.documents.select(F.col("doc_id").alias("node"), F.expr(f"timestamp_seconds({_SIGNED})").alias("signed_at"))
    return graph.order_conflicts(graph.manifest_chain(_edges(t), _roots(t)), signed)


def cells(t: Tables) -> DataFrame:
    """Supplier grids of 16 x 16 cells; a cell is flagged when its mean quantity is above 29."""
    return (
        t.lineitem.groupBy(
            F.col("l_suppkey").alias("grid_id"), (F.col("l_partkey") % 16).alias("x"), (F.col("l_orderkey") % 16).alias("y")
        )
        .agg(F.avg("l_quantity").alias("value"))
        .withColumn("flagged", F.col("value") > 29)
    )


@query(
    "connected_regions",
    """WITH RECURSIVE c AS (SELECT l_suppkey AS g, l_partkey % 16 AS x, l_orderkey % 16 AS y, avg(l_quantity) AS v FROM lineitem GROUP BY ALL HAVING avg(l_quantity) > 29),
    e AS (SELECT a.g, a.x * 16 + a.y AS u, b.x * 16 + b.y AS w FROM c a JOIN c b ON a.g = b.g AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    walk(g, node, reach) AS (SELECT g, x * 16 + y, x * 16 + y FROM c UNION SELECT walk.g, e.w, reach FROM walk JOIN e ON e.g = walk.g AND e.u = walk.node),
    l AS (SELECT g, node, min(reach) AS comp FROM walk GROUP BY 1, 2),
    r AS (SELECT c.g AS grid_id, comp, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS cells
      FROM c JOIN l ON l.g = c.g AND l.node = c.x * 16 + c.y GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT grid_id, x, y, width, height, cells, row_number() OVER (PARTITION BY grid_id ORDER BY cells DESC, comp) AS region FROM r QUALIFY region <= 8""",
)
def _(t: Tables):
    return graph.connected_regions(cells(t)).drop("value")


# -- outliers -------------------------------------------------------------------------------------


@query(
    "sigma_outliers",
    """WITH s AS (SELECT l_partkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1),
    j AS (SELECT l.*, l_quantity > m + 1.5 * d AND l_quantity > 4 AS o FROM lineitem l JOIN s USING (l_partkey))
    SELECT l_partkey, count(*) AS n, count(*) FILTER (o) AS outliers, floor(count(*) FILTER (o) / count(*) * 10000 + 0.5) / 10000 AS share,
      count(*) FILTER (o) / count(*) BETWEEN 0.005 AND 0.2 AS flagged FROM j GROUP BY 1""",
)
def _(t: Tables):
    judged = outliers.sigma_outliers(t.lineitem.select("l_partkey", "l_quantity"), "l_partkey", "l_quantity", k=1.5)
    return judged.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("outlier").alias("outliers"),
        (F.floor(F.first("share") * 10000 + 0.5) / 10000).alias("share"), F.first("flagged").alias("flagged"),
    )


@query(
    "robust_outliers",
    """WITH s AS (SELECT user_id, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1),
    j AS (SELECT e.*, m, abs(value - m) > greatest(3 * (b - a), 1.0, 0.5 * m) AS o FROM events e JOIN s USING (user_id))
    SELECT user_id, floor(any_value(m) * 10000 + 0.5) / 10000 AS median, count(*) FILTER (o) AS outliers,
      count(*) FILTER (o) / count(*) BETWEEN 0.005 AND 0.25 AS flagged FROM j GROUP BY 1""",
)
def _(t: Tables):
    judged = outliers.robust_outliers(t.events.select("user_id", "value"), "user_id", "value")
    return judged.groupBy("user_id").agg(
        (F.floor(F.first("median") * 10000 + 0.5) / 10000).alias("median"),
        F.count_if("outlier").alias("outliers"), F.first("flagged").alias("flagged"),
    )


# -- language and scoring -------------------------------------------------------------------------

_GRAMS = """lt AS (SELECT doc_id, lang, text, trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) AS l FROM documents),
    wd AS (SELECT doc_id, lang, ' ' || unnest(string_split(l, ' ')) || ' ' AS p FROM lt WHERE l <> ''),
    wc AS (SELECT doc_id, lang, p, count(*) AS c FROM wd GROUP BY ALL),
    gr AS (SELECT doc_id, lang, substr(p, i, n) AS g, sum(c)::BIGINT AS n
      FROM (SELECT doc_id, lang, p, c, n, unnest(range(1, length(p) - n + 2)) AS i FROM wc, (VALUES (1), (2), (3)) v(n)) GROUP BY 1, 2, 3),
    lg AS (SELECT lang, g, sum(n)::BIGINT AS n FROM gr GROUP BY 1, 2),
    kept AS (SELECT * FROM lg),
    tot AS (SELECT lang, sum(n) + count(*) AS size FROM kept GROUP BY 1),
    prof AS (SELECT kept.lang, g, (floor(ln((n + 1) / size) * 1e6 + 0.5) - floor(ln(1.0::DOUBLE / size) * 1e6 + 0.5))::BIGINT AS gain,
      floor(ln(1.0::DOUBLE / size) * 1e6 + 0.5)::BIGINT AS unseen FROM kept JOIN tot USING (lang))"""
_DETECT = f"""{_GRAMS},
    sc AS (SELECT doc_id, p.lang, sum(gr.n * gain) AS gain FROM gr JOIN prof p USING (g) GROUP BY 1, 2),
    sz AS (SELECT doc_id, sum(n) AS n FROM gr GROUP BY 1),
    fl AS (SELECT DISTINCT lang, unseen FROM prof),
    s AS (SELECT doc_id, lang, (gain + n * unseen)::BIGINT AS s FROM sc JOIN sz USING (doc_id) JOIN fl USING (lang)),
    r AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM s),
    d AS (SELECT doc_id, arg_max(lang, s) AS language, floor(1 / sum(exp((s - best) / 1e6)) * 10000 + 0.5) / 10000 AS confidence FROM r GROUP BY 1)"""


@query("language_profiles", f"WITH {_GRAMS} SELECT lang, g AS gram, gain, unseen FROM prof")
def _(t: Tables):
    return language.language_profiles(t.documents)


@query(
    "detect_language",
    f"""WITH {_DETECT} SELECT lt.doc_id, language, confidence, CASE WHEN length(trim(text)) < 20 THEN 'fewer than 20 characters' WHEN l = '' THEN 'no letters' END AS reason
    FROM lt LEFT JOIN d ON d.doc_id = lt.doc_id AND length(trim(text)) >= 20""",
)
def _(t: Tables):
    return language.detect_language(t.documents, language.language_profiles(t.documents)).drop("candidates")


@query(
    "language_agreement",
    f"WITH {_DETECT} SELECT lt.lang, language, count(*) AS n FROM lt JOIN d ON d.doc_id = lt.doc_id AND length(trim(text)) >= 20 GROUP BY 1, 2",
)
def _(t: Tables):
    detected = language.detect_language(t.documents, language.language_profiles(t.documents))
    return language.language_agreement(detected.filter(F.col("language").isNotNull()), t.documents)


@query(
    "window_scores",
    f"""WITH {fp_sql()}, w AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, greatest(len(w), 1), 510)) AS s FROM toks),
    k AS (SELECT doc_id, len(w[s + 1:s + 510]) AS l, len(list_distinct(w[s + 1:s + 510])) AS u FROM w WHERE n >= 50 AND (s = 0 OR n - s >= 50)),
    a AS (SELECT doc_id, count(*) AS windows, sum((u / l) * l) / sum(l) AS score FROM k GROUP BY 1)
    SELECT toks.doc_id, coalesce(windows, 0) AS windows, floor(score * 10000 + 0.5) / 10000 AS score FROM toks LEFT JOIN a USING (doc_id)""",
)
def _(t: Tables):
    canon = canonicalize(normalize_corpus(t.documents), "normalized").select("doc_id", "canonical")
    return language.window_scores(canon)


@query("train_and_score")
def _(t: Tables):
    return language.train_and_score(t.documents, t.labels)


@query("ingest_files")
def _(t: Tables):
    files = ingest_files(t.spark, f"{t.folder}/*.parquet")
    return files.withColumn("path", F.element_at(F.split("path", "/"), -1))
