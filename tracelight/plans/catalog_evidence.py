"""Evidence, timeline and grounding queries over items derived from orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators import evidence as op
from tracelight.operators import rules as rule_op
from tracelight.operators import timeline as timeline_op
from tracelight.operators.language import calibration_table, score_levels
from tracelight.plans.observations import assemble_observations, search_struct, signal_map
from tracelight.plans.registry import Tables, query
from tracelight.thresholds import Thresholds

# Flat image observations. Every expression reads the same in Spark and in the checking SQL;
# k is the order key, ts its date.
FLAT = {
    "p_ran": "k % 6 <> 0",
    "p_has": "k % 6 IN (1, 2, 3, 4)",
    "p_valid": "CASE WHEN k % 6 IN (1, 2, 3) THEN true WHEN k % 6 = 4 THEN false END",
    "p_eval": "k % 4 <> 0",
    "p_trusted": "CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 IN (1, 2) END",
    "p_at": "CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 = 1 END",
    "p_type": "CASE WHEN k % 7 IN (1, 2) THEN 1 WHEN k % 7 IN (3, 4, 5) THEN 2 ELSE 0 END",
    "p_train": "k % 8 = 1",
    "p_ident": "k % 9 IN (1, 4)",
    "p_identok": "k % 9 = 1",
    "p_fail": "CASE WHEN k % 11 = 3 THEN 2 ELSE 0 END",
    "p_loc": "CASE WHEN k % 12 = 5 THEN 'remote' WHEN k % 10 = 1 THEN 'sidecar' ELSE 'embedded' END",
    "p_host": "CASE WHEN k % 12 = 5 OR k % 20 = 1 THEN 'cai.example.org' END",
    "p_order": "k % 17 = 1",
    "p_action": "k % 2 = 1",
    "p_chain": "k % 3 = 1",
    "m_ran": "k % 14 <> 0",
    "m_soft": "CASE WHEN k % 3 = 0 THEN 'Editor 9' END",
    "m_make": "CASE WHEN k % 4 = 1 THEN 'Acme' END",
    "m_cap": "CASE WHEN k % 50 = 0 THEN 2 WHEN k % 5 <> 2 THEN 1 ELSE 0 END",
    "m_mod": "k % 10 = 4",
    "m_gps": "k % 9 = 2",
    "m_fix": "k % 18 = 2",
    "m_gen": "k % 16 = 3",
    "m_type": "CASE WHEN k % 10 = 3 THEN 2 WHEN k % 10 = 6 THEN 1 ELSE 0 END",
    "m_edits": "CASE WHEN k % 15 = 4 THEN 2 ELSE 0 END",
    "m_derived": "k % 30 = 7",
    "m_exif": "k % 2 = 1",
    "m_xmp": "k % 3 = 0",
    "s_same": "CASE WHEN k % 25 = 0 THEN 2 ELSE 0 END",
    "s_near": "CASE WHEN k % 10 = 5 THEN 1 ELSE 0 END",
    "a_ran": "k % 10 <> 9",
    "a_score": "CASE WHEN k % 11 = 0 THEN NULL ELSE ((k * 37) % 101) / 100.0 END",
    "a_cal": "k % 2 = 0",
    "q_ran": "k % 4 <> 3",
    "q_n": "k % 4",
    "f_ran": "k % 13 <> 12",
}
METHODS = [
    "ela", "compression", "resampling", "noise", "copy_move", "double_compression", "thumbnail",
    "c2pa_thumbnail",
]
# Flags of method number j (0..7).
FLAGS = {
    "applicable": "(k + j) % 5 <> 0",
    "anomaly": "(k + 3 * j) % 7 = 1",
    "detected": "(k + j) % 6 = 2",
    "measured": "(k + 2 * j) % 4 <> 1",
    "prior_grid": "(k + j) % 8 = 3",
    "encoding": "(k + j) % 2 = 0",
    "mismatch": "(k + j) % 11 = 4",
    "orientation": "(k + j) % 13 = 5",
    "aspect": "(k + j) % 17 = 6",
}


def image_observations(t: Tables) -> DataFrame:
    base = t.orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )
    flat = base.select("k", "ts", *[F.expr(e).alias(n) for n, e in FLAT.items()])
    c, lit, none = F.col, F.lit, F.lit(None).cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exif = F.date_format(c("ts") + F.expr("make_dt_interval(0, 0, 0, 30 * (k % 8))"), "yyyy:MM:dd HH:mm:ss")
    earlier = F.date_format(c("ts") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")
    kinds = F.when(c("p_type") == 1, F.array(lit("digitalCapture"))).when(
        c("p_type") == 2, F.array(lit("digitalCapture"), lit("trainedAlgorithmicMedia"))
    ).otherwise(F.array().cast("array<string>"))
    action = F.struct(lit("c2pa.created").alias("action"), F.when(c("p_action"), iso).alias("when"), lit("tool").alias("agent"))
    link = F.struct(lit("b").alias("label"), F.when(c("p_chain"), "a").alias("parent"), earlier.alias("signed_at"))
    edits = F.when(
        c("m_edits") > 0,
        F.array(
            F.struct(lit("saved").alias("action"), lit("Editor").alias("software"), iso.alias("when")),
            F.struct(lit("cropped").alias("action"), lit("Editor").alias("software"), lit("not a time").alias("when")),
        ),
    )
    captured = F.when(c("m_cap") == 1, exif).when(c("m_cap") == 2, "not a time")
    parts = {
        "file": (lit(True), F.struct(F.sha2(c("k").cast("string"), 256).alias("sha256"), (c("k") * 10).alias("size_bytes"), lit("image/png").alias("mime_type"))),
        "provenance": (c("p_ran"), F.struct(
            c("p_has"), c("p_valid"), c("p_eval"), c("p_trusted"), c("p_at"), iso, lit("Signer"), kinds,
            F.when(c("p_train"), F.create_map(lit("ai_training"), lit("notAllowed"))),
            c("p_ident"), F.array(F.when(c("p_identok"), "cawg.ica.credential_valid").otherwise("cawg.other")),
            c("p_fail"), c("p_loc"), c("p_host"), c("p_order"), F.array(action), F.array(link))),
        "metadata": (c("m_ran"), F.struct(
            c("m_soft"), c("m_make"), none, captured, F.when(c("m_cap") == 1, captured), F.when(c("m_mod"), earlier), none,
            F.when(c("m_gps"), exif), none, F.when(c("m_gen"), "ComfyUI"),
            F.when(c("m_gen"), F.array(lit("PNG:prompt"))),
            F.when(c("m_type") == 2, "trainedAlgorithmicMedia").when(c("m_type") == 1, "digitalCapture"),
            edits, F.when(c("m_derived"), "doc-1"), c("m_gps"), F.when(c("m_fix"), 10.5), F.when(c("m_fix"), 20.5),
            c("m_exif"), c("m_xmp"), lit(False), none)),
        "similar": (lit(True), F.struct(c("s_same"), c("s_near"))),
        "ai": (c("a_ran"), F.struct(c("a_score"), c("a_cal"))),
    }
    tables = {
        name: flat.filter(ran).select(c("k").alias("item_id"), body.alias(name))
        for name, (ran, body) in parts.items()
    }
    matches = flat.filter("q_ran").withColumn("rank", F.explode(F.sequence(lit(0), lit(2)))).filter("rank < q_n").select(
        c("k").alias("item_id"),
        "rank",
        F.concat(lit("https://s.example.com/"), c("rank")).alias("url"),
        F.when(c("rank") == 0, F.date_format(c("ts") - F.expr("INTERVAL 10 DAYS"), "yyyy-MM-dd")).alias("published_at"),
        lit("2024-06-01T00:00:00Z").alias("discovered_at"),
    )
    tables["search"] = search_struct(matches, flat.filter("q_ran").select(c("k").alias("item_id")))
    tables["signals"] = signal_map(signals(t))
    items = flat.select(c("k").alias("item_id"), lit("image").alias("analysis_type"), c("ts").alias("submitted_at"))
    return assemble_observations(items, **tables)


def signals(t: Tables) -> DataFrame:
    """The long table: eight methods per item for which forensics ran."""
    methods = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(m).alias("method")) for i, m in enumerate(METHODS)]))
    rows = t.orders.select(F.col("o_orderkey").alias("k")).filter(FLAT["f_ran"]).select("k", methods.alias("x")).select("k", "x.*")
    return rows.select(
        F.col("k").alias("item_id"),
        "method",
        *[F.expr(FLAGS[n]).alias(n) for n in ("applicable", "anomaly", "detected", "measured", "prior_grid", "encoding")],
        F.expr("(k + j) % 3").alias("smooth_blocks"),
        *[F.expr(FLAGS[n]).alias(n) for n in ("mismatch", "orientation", "aspect")],
    )


def _flag(method: str, name: str) -> str:
    return "(" + FLAGS[name].replace("j", str(METHODS.index(method))) + ")"


def _image_rules_sql() -> str:
    """(rule, condition, level) of every image rule over the flat row, in report order."""
    has, bare, intact = "p_ran AND p_has", "p_ran AND NOT p_has", "coalesce(p_valid, false)"
    decl = f"CASE WHEN {intact} THEN 'STRONG' ELSE 'POSSIBLE' END"

    def ap(m: str) -> str:
        return f"f_ran AND {_flag(m, 'applicable')}"

    def na(m: str) -> str:
        return f"f_ran AND NOT {_flag(m, 'applicable')}"

    an = lambda m: _flag(m, "anomaly")
    th = "thumbnail"
    geo = f"({_flag(th, 'orientation')} OR {_flag(th, 'aspect')})"
    fam = [
        " OR ".join(f"({ap(m)} AND {an(m)})" for m in ("ela", "compression", "double_compression")),
        f"{ap('noise')} AND {an('noise')}",
        f"{ap('copy_move')} AND {_flag('copy_move', 'detected')}",
        f"({ap(th)} AND ({_flag(th, 'mismatch')} OR {an(th)} OR {geo})) OR "
        f"({ap('c2pa_thumbnail')} AND ({_flag('c2pa_thumbnail', 'mismatch')} OR {an('c2pa_thumbnail')}))",
    ]
    n_fam = " + ".join(f"CASE WHEN {f} THEN 1 ELSE 0 END" for f in fam)
    V, S, P, U = "'VERIFIED'", "'STRONG'", "'POSSIBLE'", "'UNKNOWN'"
    cp, dc, ct, rs, no, cm = "compression", "double_compression", "c2pa_thumbnail", "resampling", "noise", "copy_move"
    alg = f"CASE WHEN p_type = 2 THEN {decl} ELSE 'POSSIBLE' END"
    idl = f"CASE WHEN p_identok THEN {decl} ELSE 'POSSIBLE' END"
    ai = "CASE WHEN a_score >= 0.85 AND a_cal THEN 'PROBABLE' WHEN a_score >= 0.6 THEN 'POSSIBLE' ELSE 'UNKNOWN' END"
    smooth = f"(k + {METHODS.index('noise')}) % 3"
    rows = [
        ("file.identity", "true", V),
        ("provenance.uninspected", "NOT p_ran", U),
        ("provenance.absent", f"{bare} AND p_loc <> 'remote'", U),
        ("provenance.valid", f"{has} AND {intact}", V),
        ("provenance.invalid", f"{has} AND NOT {intact}", P),
        ("provenance.trusted", f"{has} AND p_eval AND p_trusted", V),
        ("provenance.untrusted-signer", f"{has} AND p_eval AND NOT p_trusted", U),
        ("provenance.certificate.outside-validity", f"{has} AND NOT p_at", P),
        ("provenance.source-type", f"{has} AND p_type > 0", alg),
        ("provenance.training-mining", f"{has} AND p_train", decl),
        ("provenance.identity", f"{has} AND p_ident", idl),
        ("provenance.ingredient.invalid", f"{has} AND p_fail > 0", P),
        ("provenance.remote", "p_ran AND p_host IS NOT NULL", U),
        ("metadata.unavailable", "NOT m_ran", U),
        ("metadata.software", "m_ran AND m_soft IS NOT NULL", S),
        ("metadata.camera", "m_ran AND m_make IS NOT NULL", P),
        ("metadata.captured", "m_ran AND m_cap > 0", P),
        ("metadata.generator", "m_ran AND m_gen", S),
        ("metadata.source-type", "m_ran AND m_type > 0", "CASE WHEN m_type = 2 THEN 'STRONG' ELSE 'POSSIBLE' END"),
        ("metadata.edit-history", "m_ran AND (m_edits > 0 OR m_derived)", S),
        ("metadata.gps", "m_ran AND m_gps", P),
        ("metadata.none", "m_ran AND NOT m_exif AND NOT m_xmp AND NOT m_gen", U),
        ("matches.exact", "s_same > 0", V),
        ("matches.near", "s_near > 0", P),
        ("forensics.unavailable", "NOT f_ran", U),
        ("forensics.multiple", f"f_ran AND ({n_fam}) >= 2", S),
        ("forensics.ela.na", na("ela"), U),
        ("forensics.ela.anomaly", f"{ap('ela')} AND {an('ela')}", P),
        ("forensics.ela.none", f"{ap('ela')} AND NOT {an('ela')}", U),
        ("forensics.compression.offset-grid", f"{ap(cp)} AND {an(cp)}", P),
        ("forensics.compression.prior-jpeg", f"{ap(cp)} AND NOT {an(cp)} AND {_flag(cp, 'prior_grid')}", P),
        ("forensics.compression.encoding", f"{ap(cp)} AND NOT {an(cp)} AND NOT {_flag(cp, 'prior_grid')} AND {_flag(cp, 'encoding')}", U),
        ("forensics.compression.none", f"{ap(cp)} AND NOT {an(cp)} AND NOT {_flag(cp, 'prior_grid')} AND NOT {_flag(cp, 'encoding')}", U),
        ("forensics.resampling.detected", f"{ap(rs)} AND {_flag(rs, 'detected')}", P),
        ("forensics.resampling.none", f"{ap(rs)} AND NOT {_flag(rs, 'detected')} AND {_flag(rs, 'measured')}", U),
        ("forensics.resampling.unmeasured", f"{ap(rs)} AND NOT {_flag(rs, 'detected')} AND NOT {_flag(rs, 'measured')}", U),
        ("forensics.noise.anomaly", f"{ap(no)} AND {an(no)}", P),
        ("forensics.noise.consistent", f"{ap(no)} AND NOT {an(no)} AND {_flag(no, 'measured')} AND {smooth} > 0", U),
        ("forensics.noise.unmeasured", f"{ap(no)} AND NOT {an(no)} AND NOT ({_flag(no, 'measured')} AND {smooth} > 0)", U),
        ("forensics.copy-move.detected", f"{ap(cm)} AND {_flag(cm, 'detected')}", P),
        ("forensics.copy-move.none", f"{ap(cm)} AND NOT {_flag(cm, 'detected')} AND {_flag(cm, 'measured')}", U),
        ("forensics.copy-move.unmeasured", f"{ap(cm)} AND NOT {_flag(cm, 'detected')} AND NOT {_flag(cm, 'measured')}", U),
        ("forensics.double-compression.na", na(dc), U),
        ("forensics.double-compression.localized", f"{ap(dc)} AND {an(dc)}", P),
        ("forensics.double-compression.global", f"{ap(dc)} AND NOT {an(dc)} AND {_flag(dc, 'detected')}", P),
        ("forensics.double-compression.none", f"{ap(dc)} AND NOT {an(dc)} AND NOT {_flag(dc, 'detected')}", U),
        ("forensics.thumbnail.na", na(th), U),
        ("forensics.thumbnail.mismatch", f"{ap(th)} AND {_flag(th, 'mismatch')}", P),
        ("forensics.thumbnail.region", f"{ap(th)} AND NOT {_flag(th, 'mismatch')} AND {an(th)}", P),
        ("forensics.thumbnail.geometry", f"{ap(th)} AND {geo}", P),
        ("forensics.thumbnail.consistent", f"{ap(th)} AND NOT ({_flag(th, 'mismatch')} OR {an(th)} OR {geo})", U),
        ("forensics.c2pa-thumbnail.na", na(ct), U),
        ("forensics.c2pa-thumbnail.mismatch", f"{ap(ct)} AND {_flag(ct, 'mismatch')}", P),
        ("forensics.c2pa-thumbnail.region", f"{ap(ct)} AND NOT {_flag(ct, 'mismatch')} AND {an(ct)}", P),
        ("forensics.c2pa-thumbnail.consistent", f"{ap(ct)} AND NOT {_flag(ct, 'mismatch')} AND NOT {an(ct)}", U),
        ("ai.unavailable", "NOT a_ran", U),
        ("ai.noscore", "a_ran AND a_score IS NULL", U),
        ("ai.weak", "a_ran AND a_score < 0.6", U),
        ("ai.signal", "a_ran AND a_score >= 0.6", ai),
        ("sources.unavailable", "NOT q_ran", U),
        ("sources.none", "q_ran AND q_n = 0", U),
        ("sources.matches", "q_ran AND q_n > 0", P),
    ]
    selects = " UNION ALL ".join(
        f"SELECT k AS item_id, {i} AS pos, '{r}' AS rule, {level} AS level, a_score FROM flat WHERE {cond}"
        for i, (r, cond, level) in enumerate(rows)
    )
    flat = ", ".join(f"{e} AS {n}" for n, e in FLAT.items())
    return f"""flat AS (SELECT k, ts, {flat} FROM (SELECT o_orderkey AS k, o_orderdate AS ts FROM orders)),
    fired AS ({selects}),
    ruled AS (SELECT item_id, pos, rule, level, CASE WHEN rule IN ('ai.weak', 'ai.signal') THEN floor(a_score * 10000 + 0.5) / 10000
      ELSE CASE level WHEN 'VERIFIED' THEN 1.0 WHEN 'STRONG' THEN 0.8 WHEN 'PROBABLE' THEN 0.65 WHEN 'POSSIBLE' THEN 0.4 END END::DOUBLE AS confidence
      FROM fired)"""


OVERRIDES = {
    "matches.exact": "POSSIBLE",
    "metadata.software": "VERIFIED",
    "ai.signal": "POSSIBLE",
    "forensics.multiple": "PROBABLE",
    "forensics.ela.none": "STRONG",
}
RULED = _image_rules_sql()
EVIDENCE = f"""{RULED},
    conf AS (
      SELECT k AS item_id, 'conflict.capture-after-signing' AS rule FROM flat WHERE p_ran AND p_has AND p_valid AND m_ran AND m_cap = 1 AND 30 * (k % 8) > 60
      UNION ALL SELECT k, 'conflict.published-before-capture' FROM flat WHERE m_ran AND m_cap = 1 AND q_ran AND q_n > 0
      UNION ALL SELECT k, 'conflict.source-type' FROM flat WHERE p_ran AND p_has AND p_type > 0 AND m_ran AND m_type > 0 AND p_type <> m_type
      UNION ALL SELECT k, 'conflict.manifest-order' FROM flat WHERE p_ran AND p_has AND p_order
      UNION ALL SELECT item_id, 'conflict.provenance-vs-forensics' FROM ruled r WHERE rule = 'forensics.multiple' AND level IN ('STRONG', 'PROBABLE')
        AND EXISTS (FROM ruled v WHERE v.item_id = r.item_id AND v.rule = 'provenance.valid')
      UNION ALL SELECT item_id, 'conflict.provenance-vs-ai' FROM ruled r WHERE rule = 'ai.signal' AND level IN ('STRONG', 'PROBABLE')
        AND EXISTS (FROM ruled v WHERE v.item_id = r.item_id AND v.rule = 'provenance.valid')),
    evidence AS (SELECT item_id, rule, level, confidence, 'x' AS kind FROM ruled
      UNION ALL SELECT item_id, rule, 'UNKNOWN', NULL, 'conflict' FROM conf)"""


@query(
    "assemble_observations",
    f"""SELECT o_orderkey AS item_id, true AS has_file, k_p AS has_provenance, k_m AS has_metadata, k_a AS has_ai,
      k_q AS has_search, k_f AS has_signals, CASE WHEN k_q THEN least(n, 3) ELSE 0 END::BIGINT AS matches
    FROM (SELECT k AS o_orderkey, {FLAT['p_ran']} AS k_p, {FLAT['m_ran']} AS k_m, {FLAT['a_ran']} AS k_a, {FLAT['q_ran']} AS k_q,
      {FLAT['f_ran']} AS k_f, {FLAT['q_n']} AS n FROM (SELECT o_orderkey AS k FROM orders))""",
)
def _(t: Tables):
    obs = image_observations(t)
    return obs.select(
        "item_id",
        *[F.col(n).isNotNull().alias(f"has_{n}") for n in ("file", "provenance", "metadata", "ai", "search", "signals")],
        F.coalesce("search.match_count", F.lit(0)).alias("matches"),
    )


@query(
    "apply_rules",
    f"""WITH {RULED} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1)::BIGINT AS position,
      rule, level, confidence FROM ruled""",
)
def _(t: Tables):
    return op.apply_rules(image_observations(t)).select("item_id", "position", "rule", "level", "confidence")


@query(
    "apply_overrides",
    f"""WITH {RULED}, w(rule, wanted) AS (VALUES ('matches.exact', 'POSSIBLE'), ('metadata.software', 'STRONG'),
      ('ai.signal', 'POSSIBLE'), ('forensics.multiple', 'PROBABLE'), ('forensics.ela.none', 'UNKNOWN'))
    SELECT item_id, rule, coalesce(wanted, level) AS level,
      CASE WHEN rule = 'ai.signal' OR wanted IS NULL OR wanted = level THEN confidence
        ELSE CASE wanted WHEN 'POSSIBLE' THEN 0.4 WHEN 'PROBABLE' THEN 0.65 END END::DOUBLE AS confidence
    FROM ruled LEFT JOIN w USING (rule)""",
)
def _(t: Tables):
    evidence = op.apply_rules(image_observations(t))
    return op.apply_overrides(evidence, Thresholds(overrides=OVERRIDES)).select("item_id", "rule", "level", "confidence")


@query("conflict_records", f"WITH {EVIDENCE} SELECT item_id, rule FROM conf")
def _(t: Tables):
    return op.conflict_records(image_observations(t)).select("item_id", "rule")


@query(
    "level_counts",
    f"""WITH {EVIDENCE} SELECT item_id, {', '.join(f"count(*) FILTER (level = '{n}') AS {n.lower()}" for n in ('VERIFIED', 'STRONG', 'PROBABLE', 'POSSIBLE', 'UNKNOWN'))}
    FROM evidence GROUP BY 1""",
)
def _(t: Tables):
    return op.level_counts(op.build_evidence(image_observations(t)))


_CONFIDENCE = """floor(least(1.0, greatest(0.0, coalesce(max(CASE WHEN kind <> 'conflict' AND level <> 'UNKNOWN' THEN confidence END), 0.0)
      - 0.25 * count(*) FILTER (kind = 'conflict')))::DOUBLE * 10000 + 0.5) / 10000"""


@query(
    "synthesis_confidence",
    f"""WITH {EVIDENCE} SELECT item_id, {_CONFIDENCE} AS confidence, count(*) FILTER (kind = 'conflict') AS conflicts FROM evidence GROUP BY 1""",
)
def _(t: Tables):
    return op.synthesis_confidence(op.build_evidence(image_observations(t)))


@query(
    "overview",
    f"""WITH {EVIDENCE} SELECT item_id, count(*) FILTER (kind <> 'conflict' AND level = 'VERIFIED') AS verified,
      count(*) FILTER (kind <> 'conflict' AND level = 'STRONG') AS strong,
      count(*) FILTER (kind <> 'conflict' AND level IN ('PROBABLE', 'POSSIBLE')) AS probabilistic,
      count(*) FILTER (kind = 'conflict') AS conflicts,
      count(*) FILTER (kind <> 'conflict' AND level = 'UNKNOWN') AS unknown, {_CONFIDENCE} AS confidence
    FROM evidence GROUP BY 1""",
)
def _(t: Tables):
    out = op.overview(op.build_evidence(image_observations(t)))
    return out.select(
        "item_id", *[F.size(b).alias(b) for b in ("verified", "strong", "probabilistic", "conflicts", "unknown")], "confidence"
    )


@query(
    "independent_families",
    f"""WITH s AS (SELECT k, j, CASE j {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METHODS))} END AS m,
        {', '.join(f'{e} AS {n}' for n, e in FLAGS.items())}
      FROM (SELECT o_orderkey AS k, unnest(range(8)) AS j FROM orders) WHERE {FLAT['f_ran']}),
    f AS (SELECT k, CASE WHEN NOT applicable THEN NULL
      WHEN m IN ('ela', 'compression', 'double_compression') AND anomaly THEN 'error-level/compression'
      WHEN m = 'noise' AND anomaly THEN 'noise' WHEN m = 'copy_move' AND detected THEN 'copy-move'
      WHEN m = 'thumbnail' AND (mismatch OR anomaly OR orientation OR aspect) THEN 'thumbnail'
      WHEN m = 'c2pa_thumbnail' AND (mismatch OR anomaly) THEN 'thumbnail' END AS family FROM s)
    SELECT k AS item_id, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS families, count(DISTINCT family) >= 2 AS strong
    FROM f GROUP BY 1""",
)
def _(t: Tables):
    return op.independent_families(signals(t)).withColumn("families", F.array_join("families", ","))


@query("evidence_fingerprint")
def _(t: Tables):
    return op.evidence_fingerprint(op.build_evidence(image_observations(t)))


@query("stale_syntheses", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 3")
def _(t: Tables):
    evidence = op.build_evidence(image_observations(t))
    stored = op.evidence_fingerprint(evidence)
    changed = evidence.filter(~((F.col("item_id") % 10 == 0) & (F.col("rule") == "file.identity"))).withColumn(
        "claim", F.when(F.col("item_id") % 7 == 3, F.concat("claim", F.lit("!"))).otherwise(F.col("claim"))
    )
    return op.stale_syntheses(stored, changed).select("item_id")


TIMELINE_TAIL = """
    q AS (SELECT *, unnest([0, 1, 2]) AS rank FROM flat WHERE q_ran),
    tl AS (
      SELECT k AS item_id, 0 AS g, 'provenance.signed' AS event_type, CASE WHEN p_valid THEN 'VERIFIED' ELSE 'POSSIBLE' END AS certainty, ts AS moment, true AS tz FROM flat WHERE p_ran AND p_has
      UNION ALL SELECT k, 1, 'provenance.action:c2pa.created', CASE WHEN p_valid THEN 'VERIFIED' ELSE 'POSSIBLE' END, ts, true FROM flat WHERE p_ran AND p_has AND p_action
      UNION ALL SELECT k, 2, 'provenance.ingredient-signed', CASE WHEN p_valid THEN 'VERIFIED' ELSE 'POSSIBLE' END, ts - INTERVAL 1 DAY, false FROM flat WHERE p_ran AND p_has AND p_chain
      UNION ALL SELECT k, 3, 'metadata.captured', 'POSSIBLE', CASE WHEN m_cap = 1 THEN ts + to_seconds(30 * (k % 8)) END, false FROM flat WHERE m_ran AND m_cap > 0
      UNION ALL SELECT k, 4, 'metadata.modified', 'POSSIBLE', ts - INTERVAL 1 DAY, false FROM flat WHERE m_ran AND m_mod
      UNION ALL SELECT k, 5, 'metadata.gps_time', 'POSSIBLE', ts + to_seconds(30 * (k % 8)), false FROM flat WHERE m_ran AND m_gps
      UNION ALL SELECT k, 6, 'metadata.edit', 'STRONG', ts, true FROM flat WHERE m_ran AND m_edits > 0
      UNION ALL SELECT k, 7, 'metadata.edit', 'STRONG', NULL, false FROM flat WHERE m_ran AND m_edits > 0
      UNION ALL SELECT k, 8, 'source.published', 'POSSIBLE', ts - INTERVAL 10 DAY, false FROM q WHERE rank = 0 AND rank < q_n
      UNION ALL SELECT k, 9 + rank, 'source.discovered', 'VERIFIED', TIMESTAMP '2024-06-01', true FROM q WHERE rank < q_n
      UNION ALL SELECT k, 20, 'analysis.submitted', 'VERIFIED', ts, true FROM flat)"""
TIMELINE = f"{RULED}, {TIMELINE_TAIL}"


@query(
    "build_timeline",
    f"""WITH {TIMELINE} SELECT item_id, event_type, certainty, epoch(tl.moment)::BIGINT AS event_time, tz AS tz_known,
      (row_number() OVER (PARTITION BY item_id ORDER BY tl.moment IS NULL, tl.moment, g) - 1)::BIGINT AS position FROM tl""",
)
def _(t: Tables):
    out = timeline_op.build_timeline(image_observations(t))
    return out.select("item_id", "event_type", "certainty", F.unix_timestamp("event_time").alias("event_time"), "tz_known", "position")


@query(
    "earliest_known",
    f"""WITH {TIMELINE} SELECT item_id, event_type, certainty, epoch(tl.moment)::BIGINT AS event_time FROM tl WHERE tl.moment IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tl.moment, g) = 1""",
)
def _(t: Tables):
    out = timeline_op.earliest_known(timeline_op.build_timeline(image_observations(t)))
    return out.select("item_id", "event_type", "certainty", F.unix_timestamp("event_time").alias("event_time"))


@query(
    "synthesis_inputs",
    f"""WITH {EVIDENCE}, {TIMELINE_TAIL},
    e AS (SELECT item_id, count(*) AS records, count(*) FILTER (kind = 'conflict') AS conflicts FROM evidence GROUP BY 1),
    n AS (SELECT item_id, count(*) AS events FROM tl GROUP BY 1)
    SELECT item_id, records, conflicts, events FROM e LEFT JOIN n USING (item_id)""",
)
def _(t: Tables):
    obs = image_observations(t)
    out = op.synthesis_inputs(op.build_evidence(obs), timeline_op.build_timeline(obs))
    return out.select("item_id", F.size("evidence").alias("records"), "conflicts", F.size("timeline").alias("events"))


@query("export_report")
def _(t: Tables):
    obs = image_observations(t)
    items = obs.select("item_id", "analysis_type", "submitted_at")
    return op.export_report(items, op.build_evidence(obs), timeline_op.build_timeline(obs))


@query(
    "check_grounding",
    r"""WITH s AS (SELECT conv_id AS item_id, role || '-' || turn AS section,
        text || CASE turn % 4 WHEN 0 THEN ' This is STRONG and VERIFIED.' WHEN 1 THEN ' It proves nothing is edited.' ELSE '' END AS text,
        CASE turn % 3 WHEN 0 THEN ['e1', 'zz'] WHEN 1 THEN ['zz'] ELSE [] END AS cited FROM conversations),
    e AS (SELECT DISTINCT conv_id AS item_id, unnest(CASE WHEN conv_id % 2 = 0 THEN ['VERIFIED', 'STRONG'] ELSE ['POSSIBLE', 'STRONG'] END) AS level FROM conversations),
    j AS (SELECT s.*, CASE WHEN list_contains(cited, 'e1') THEN 1 ELSE 0 END AS valid, CASE WHEN list_contains(cited, 'zz') THEN 1 ELSE 0 END AS dropped,
        list_sort(list_filter(list_distinct(regexp_extract_all(text, '\b(VERIFIED|STRONG|PROBABLE|POSSIBLE|UNKNOWN)\b', 1)),
          lambda l: l NOT IN ('STRONG') AND NOT (item_id % 2 = 0 AND l = 'VERIFIED') AND NOT (item_id % 2 = 1 AND l = 'POSSIBLE'))) AS inv,
        item_id % 2 = 1 AND regexp_matches(text, '(?i)\b(?:proves?|proof that|definitively|certainly|confirmed to be|is (?:ai[- ]generated|manipulated|edited|fake|authentic|the original)|was (?:ai[- ]generated|manipulated|edited|faked))\b') AS cu
      FROM s),
    g AS (SELECT *, valid > 0 OR length(trim(text)) < 120 OR section = 'user-0' AS grounded FROM j)
    SELECT item_id, section, valid::BIGINT AS valid, dropped::BIGINT AS dropped, grounded, array_to_string(inv, ',') AS invented_levels,
      cu AS certainty_unsupported, bool_and(grounded AND len(inv) = 0) OVER (PARTITION BY item_id) AS item_grounded FROM g""",
)
def _(t: Tables):
    turn = F.col("turn")
    sections = t.conversations.select(
        F.col("conv_id").alias("item_id"),
        F.concat_ws("-", "role", "turn").alias("section"),
        F.concat(
            "text",
            F.when(turn % 4 == 0, " This is STRONG and VERIFIED.")
            .when(turn % 4 == 1, " It proves nothing is edited.")
            .otherwise(""),
        ).alias("text"),
        F.when(turn % 3 == 0, F.array(F.lit("e1"), F.lit("zz")))
        .when(turn % 3 == 1, F.array(F.lit("zz")))
        .otherwise(F.array().cast("array<string>"))
        .alias("cited"),
    )
    ids = t.conversations.select(F.col("conv_id").alias("item_id")).distinct()
    even = F.col("item_id") % 2 == 0
    evidence = ids.select(
        "item_id", F.lit("e1").alias("evidence_id"), F.when(even, "VERIFIED").otherwise("POSSIBLE").alias("level")
    ).unionByName(ids.select("item_id", F.lit("e2").alias("evidence_id"), F.lit("STRONG").alias("level")))
    out = op.check_grounding(sections, evidence, exempt=("user-0",))
    return out.withColumn("invented_levels", F.array_join("invented_levels", ",")).drop("text", "cited")


_SCORES = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ((doc_id * 37) % 101) / 100 END AS score, doc_id % 2 = 0 AS calibrated FROM documents"


def detections(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        F.when(key % 11 != 0, (key * 37) % 101 / 100).alias("score"),
        (key % 2 == 0).alias("calibrated"),
    )


@query(
    "score_levels",
    f"""WITH s AS ({_SCORES}) SELECT doc_id, CASE WHEN score IS NULL THEN 'unavailable' WHEN score >= 0.85 THEN 'likely_ai'
      WHEN score >= 0.6 THEN 'uncertain' ELSE 'likely_human' END AS label,
      CASE WHEN score >= 0.85 AND calibrated THEN 'PROBABLE' WHEN score >= 0.6 THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS level FROM s""",
)
def _(t: Tables):
    return score_levels(detections(t)).select("doc_id", "label", "level")


@query(
    "calibration_table",
    f"""WITH s AS ({_SCORES}) SELECT least(9, floor(score * 10))::BIGINT AS bin, count(*) AS n, sum(toxic)::BIGINT AS positives,
      floor(sum(toxic) / count(*) * 10000 + 0.5) / 10000 AS observed, floor(sum(round(score * 100)) / count(*) * 100 + 0.5) / 10000 AS expected
    FROM s JOIN labels USING (doc_id) WHERE score IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return calibration_table(detections(t), t.labels, "toxic")
