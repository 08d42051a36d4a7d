"""Lineage that software declares: tags, positions, generator markers, histories, manifests."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import timeparse
from tracelight.functions.columns import let
from tracelight.operators.rules import ALGORITHMIC
from tracelight.session import cut_lineage

# Where each field is looked up, first match wins.
PRECEDENCE = {
    "camera_make": ["EXIF:Make", "XMP:Make"],
    "camera_model": ["EXIF:Model", "XMP:Model"],
    "lens": ["EXIF:LensModel", "XMP:Lens", "Composite:LensID"],
    "software": ["EXIF:Software", "XMP:CreatorTool", "XMP:Software"],
    "captured_raw": ["EXIF:DateTimeOriginal", "XMP:DateTimeOriginal", "EXIF:CreateDate"],
    "captured_offset": ["EXIF:OffsetTimeOriginal", "EXIF:OffsetTime"],
    "modified_raw": ["EXIF:ModifyDate", "XMP:ModifyDate"],
    "modified_offset": ["EXIF:OffsetTime"],
    "orientation": ["EXIF:Orientation"],
    "color_profile": ["ICC_Profile:ProfileDescription"],
    "document_id": ["XMP:DocumentID"],
    "derived_from": ["XMP:DerivedFromDocumentID"],
    "source_type": ["XMP:DigitalSourceType", "IPTC:DigitalSourceType"],
    "provenance_url": ["XMP:provenance"],
}
GROUPS = {"exif": "EXIF", "xmp": "XMP", "iptc": "IPTC", "icc": "ICC_Profile", "makernotes": "MakerNotes"}
SOURCE_TYPE_PREFIX = "http://cv.iptc.org/newscodes/digitalsourcetype/"

# Generator names by pattern, first match wins.
GENERATOR_NAMES = [
    (r"stable[\s_-]?diffusion|sd[\s_-]?webui|automatic1111|a1111|forge", "Stable Diffusion"),
    (r"comfy[\s_-]?ui", "ComfyUI"),
    (r"novel[\s_-]?ai", "NovelAI"),
    (r"midjourney", "Midjourney"),
    (r"dall[\s·._-]?e", "DALL-E"),
    (r"adobe firefly|firefly", "Adobe Firefly"),
    (r"fooocus", "Fooocus"),
    (r"invoke[\s_-]?ai", "InvokeAI"),
    (r"leonardo\.?ai|leonardo ai", "Leonardo AI"),
    (r"ideogram", "Ideogram"),
    (r"\bflux(\.1|[\s_-]?(dev|schnell|pro))?\b", "FLUX"),
    (r"imagen|gemini image|nano banana", "Google Imagen"),
    (r"bing image creator|designer\.microsoft", "Bing Image Creator"),
    (r"playground ?ai|playgroundai", "Playground AI"),
    (r"\bnijijourney\b", "Niji Journey"),
    (r"krea\.ai|krea ai", "Krea"),
    (r"\bai[\s_-]?generated\b", "unspecified AI generator"),
]
# Text keys that generators write.
GENERATOR_KEYS = {
    "parameters": "Stable Diffusion WebUI",
    "prompt": "ComfyUI",
    "workflow": "ComfyUI",
    "sd-metadata": "InvokeAI",
    "invokeai_metadata": "InvokeAI",
    "invokeai_graph": "InvokeAI",
    "dream": "InvokeAI",
    "fooocus_scheme": "Fooocus",
    "generation_data": "unspecified AI generator",
}
# What generation parameters look like, and the tags searched for them.
PAYLOAD = (
    r'(?i)"(steps|sampler|cfg_scale|scale|seed|uc|prompt|denoising_strength|model_hash)"\s*:'
    r"|\bSteps:\s*\d+|\bSampler:|\bCFG scale:|\bSeed:\s*\d+|\bModel hash:"
)
FREE_TEXT_KEYS = ["comment", "description", "software", "source", "title"]
NAMED_TAGS = [
    "EXIF:Software", "EXIF:ImageDescription", "EXIF:UserComment", "XMP:CreatorTool",
    "XMP:Description", "XMP:Credit",
]


def _tag_name() -> Column:
    return F.element_at(F.split("tag", ":"), -1)


def normalize_tags(tags: DataFrame) -> DataFrame:
    """One row per item from the long tag table (item_id, grp, tag, value).

    One aggregation picks every candidate tag at once; precedence is a coalesce over them.
    """
    key = F.concat_ws(":", "grp", _tag_name())
    rows = tags.withColumn("_key", key).withColumn("_value", F.nullif("value", F.lit("")))
    wanted = sorted({k for ks in PRECEDENCE.values() for k in ks})
    position = (F.col("grp") == "EXIF") & _tag_name().startswith("GPS") & F.col("_value").isNotNull()
    composite = F.col("_key") == "Composite:GPSPosition"
    picked = rows.groupBy("item_id").agg(
        *[F.max(F.when(F.col("_key") == k, F.col("_value"))).alias(k) for k in wanted],
        *[F.bool_or(F.col("grp") == g).alias(f"has_{n}") for n, g in GROUPS.items()],
        F.bool_or(position | composite).alias("gps_present"),
        F.count(F.lit(1)).alias("tag_count"),
    )
    fields = {
        name: F.nullif(
            F.trim(F.coalesce(*[F.col(f"`{k}`") for k in keys])), F.lit("")
        )
        for name, keys in PRECEDENCE.items()
    }
    out = picked.select(
        "item_id",
        *[c.alias(n) for n, c in fields.items()],
        *[f"has_{n}" for n in GROUPS],
        "gps_present",
        "tag_count",
    )

    def with_offset(raw: str, offset: str) -> Column:
        """The raw time with its offset tag, unless it names a zone itself."""
        joined = F.concat(raw, F.coalesce(offset, F.lit("")))
        return F.when(~timeparse.tz_known(F.col(raw)), joined).otherwise(F.col(raw))

    zoned = with_offset("captured_raw", "captured_offset")
    return out.withColumns(
        {
            "orientation": F.col("orientation").try_cast("int"),
            "source_type": short_source_type(F.col("source_type")),
            "captured_at": timeparse.instant(zoned),
            "captured_tz_known": timeparse.tz_known(zoned),
            "modified_at": timeparse.instant(with_offset("modified_raw", "modified_offset")),
        }
    )


def degrees(value: Column) -> Column:
    """Decimal degrees from '48.5', or from a '[deg, min, sec]' list of one to three numbers."""
    parts = F.transform(
        F.split(F.regexp_replace(value, "[\\[\\]\\s]", ""), ","), lambda x: x.try_cast("double")
    )
    whole = F.forall(parts, lambda x: x.isNotNull()) & (F.size(parts) <= 3)

    def at(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))

    return F.when(whole, at(0) + at(1) / 60 + at(2) / 3600)


def gps_positions(tags: DataFrame) -> DataFrame:
    """(item, latitude, longitude, altitude_m, warnings, received_at): signed, in range, both or
    neither; the receiver's UTC time from the composite tag, else from date and time stamps."""
    names = ["GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "GPSAltitudeRef", "GPSDateStamp", "GPSTimeStamp"]
    composite = ["GPSLatitude", "GPSLongitude", "GPSDateTime"]
    keys = [f"EXIF:{n}" for n in names] + [f"Composite:{n}" for n in composite]
    key = F.concat_ws(":", "grp", _tag_name())
    wide = (
        tags.withColumn("_key", key)
        .filter(F.col("_key").isin(*keys))
        .groupBy("item_id")
        .agg(*[F.max(F.when(F.col("_key") == k, F.col("value"))).alias(k.replace(":", "_")) for k in keys])
    )

    def coordinate(axis: str, negative: str) -> Column:
        raw = degrees(F.col(f"EXIF_GPS{axis}"))
        ref = F.upper(F.left(F.trim(f"EXIF_GPS{axis}Ref"), F.lit(1)))
        signed = F.when((ref == negative) & (raw > 0), -raw).otherwise(raw)
        return F.coalesce(degrees(F.col(f"Composite_GPS{axis}")), signed)

    lat, lon = coordinate("Latitude", "S"), coordinate("Longitude", "W")
    altitude = degrees(F.col("EXIF_GPSAltitude"))
    below = F.lower(F.trim("EXIF_GPSAltitudeRef")).isin("1", "below sea level")
    numbers = F.transform(
        F.split(F.regexp_replace("EXIF_GPSTimeStamp", "[\\[\\]\\s]", ""), ","),
        lambda x: F.lpad(x.try_cast("double").cast("int").cast("string"), 2, "0"),
    )
    listed = F.when(
        (F.size(numbers) == 3) & F.forall(numbers, lambda x: x.isNotNull()), F.array_join(numbers, ":")
    )
    clock = F.coalesce(listed, F.substring(F.trim("EXIF_GPSTimeStamp"), 1, 8))
    stamped = F.concat(F.trim("EXIF_GPSDateStamp"), F.lit(" "), clock)
    received = timeparse.instant(F.coalesce(F.nullif("Composite_GPSDateTime", F.lit("")), stamped))
    staged = wide.select("item_id", lat.alias("_lat"), lon.alias("_lon"), received.alias("received_at"), F.when(below, -F.abs(altitude)).otherwise(altitude).alias("altitude_m"))
    ok_lat, ok_lon = F.col("_lat").between(-90, 90), F.col("_lon").between(-180, 180)
    both = F.coalesce(ok_lat, F.lit(False)) & F.coalesce(ok_lon, F.lit(False))
    one = F.coalesce(ok_lat, F.lit(False)) != F.coalesce(ok_lon, F.lit(False))
    return staged.select(
        "item_id",
        F.when(both, F.col("_lat")).alias("latitude"),
        F.when(both, F.col("_lon")).alias("longitude"),
        "altitude_m",
        F.array_compact(
            F.array(
                F.when(~ok_lat, F.lit("latitude out of range")),
                F.when(~ok_lon, F.lit("longitude out of range")),
                F.when(one, F.lit("position incomplete")),
            )
        ).alias("warnings"),
        "received_at",
    )


def generator_name(text: Column) -> Column:
    out = F
    for pattern, label in GENERATOR_NAMES:
        out = out.when(text.rlike("(?i)" + pattern), F.lit(label))
    return out


def generator_markers(tags: DataFrame) -> DataFrame:
    """(item, tag, generator, excerpt): keyed markers, named generators, generation payloads."""
    value = F.col("value")
    name = F.lower(_tag_name())
    tag = F.concat_ws(":", "grp", _tag_name())
    keyed = F.create_map(*[F.lit(x) for kv in GENERATOR_KEYS.items() for x in kv])[name]
    free_text = name.isin(*FREE_TEXT_KEYS)

    def judged(named: Column) -> Column:
        png = (
            F.when(keyed.isNotNull(), F.coalesce(named, keyed))
            .when(free_text & named.isNotNull(), named)
            .when(free_text & value.rlike(PAYLOAD), F.lit("unspecified AI generator"))
        )
        return F.when(F.col("grp") == "PNG", png).otherwise(named)

    eligible = ((F.col("grp") == "PNG") & (keyed.isNotNull() | free_text)) | tag.isin(*NAMED_TAGS)
    found = F.when(eligible, let(generator_name(value), judged))
    rows = (
        tags.filter(F.coalesce(value, F.lit("")) != "")
        .select(
            "item_id",
            tag.alias("tag"),
            found.alias("generator"),
            F.substring(F.trim(F.regexp_replace(value, "\\s+", " ")), 1, 240).alias("excerpt"),
        )
        .filter(F.col("generator").isNotNull())
    )
    return (
        rows.groupBy("item_id", "tag")
        .agg(F.min(F.struct("excerpt", "generator")).alias("m"))
        .select("item_id", "tag", "m.generator", "m.excerpt")
    )


def edit_history(tags: DataFrame) -> DataFrame:
    """(item, position, action, software, when, event_time, tz_known) from history lists.

    The value is a JSON list of objects whose keys are matched without regard to case.
    """
    entries = F.from_json(
        F.when(F.left(F.trim("value"), F.lit(1)) == "[", F.col("value")).otherwise(
            F.concat(F.lit("["), "value", F.lit("]"))
        ),
        "array<map<string,string>>",
    )
    lowered = F.transform(
        entries,
        lambda m: F.map_from_entries(
            F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
        ),
    )

    def text(key: str) -> Column:
        return F.nullif(F.trim(F.col("m")[key]), F.lit(""))

    return (
        tags.filter((F.col("grp") == "XMP") & (F.lower(_tag_name()) == "history"))
        .select("item_id", F.posexplode_outer(lowered).alias("position", "m"))
        .select(
            "item_id",
            "position",
            text("action").alias("action"),
            text("softwareagent").alias("software"),
            text("when").alias("when"),
            text("changed").alias("changed"),
        )
        .filter(F.col("action").isNotNull())
        .withColumns(
            {
                "event_time": timeparse.instant(F.col("when")),
                "tz_known": timeparse.tz_known(F.col("when")),
            }
        )
    )


def short_source_type(uri: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(uri), "^" + SOURCE_TYPE_PREFIX, ""), "/+$", "")
    return F.element_at(F.split(bare, "/"), -1)


def source_types(df: DataFrame, uri: str = "uri") -> DataFrame:
    short = short_source_type(F.col(uri))
    return df.withColumns({"short": short, "algorithmic": short.isin(*ALGORITHMIC)})


# -- validation codes -----------------------------------------------------------------------------

# Codes that are neutral or successes, and wording that marks a failure.
SUCCESS_CODES = [
    "claimSignature.validated", "assertion.hashedURI.match", "assertion.dataHash.match",
    "assertion.bmffHash.match", "assertion.boxesHash.match", "assertion.collectionHash.match",
    "ingredient.manifest.validated", "ingredient.claimSignature.validated",
    "timeStamp.validated", "claim.signature.validated",
]
FAILURE = "(?i)(mismatch|invalid|expired|revoked|error|missing|failure|malformed|notFound|unsupported)"


def code_family(code: Column, explanation: Column) -> Column:
    """Which question a code answers: trust, identity, info or integrity."""
    return (
        F.when(code.startswith("signingCredential.") | code.startswith("timeStamp."), "trust")
        .when(code.startswith("cawg."), "identity")
        .when(code.isin(*SUCCESS_CODES), "info")
        .when(
            code == "general.error",
            F.when(F.contains(F.lower(F.coalesce(explanation, F.lit(""))), F.lit("trust")), "trust").otherwise("integrity"),
        )
        .when(code.rlike(FAILURE), "integrity")
        .otherwise("info")
    )


def classify_codes(codes: DataFrame) -> DataFrame:
    """Counts per family for every item of (item_id, code, explanation)."""
    family = codes.withColumn("family", code_family(F.col("code"), F.col("explanation")))
    return family.groupBy("item_id").agg(
        *[F.count_if(F.col("family") == f).alias(f) for f in ("integrity", "trust", "identity", "info")]
    )


# -- manifest stores ------------------------------------------------------------------------------

_MANIFEST = """struct<claim_generator:string,title:string,
  claim_generator_info:array<struct<name:string,version:string>>,
  signature_info:struct<issuer:string,common_name:string,alg:string,time:string>,
  ingredients:array<struct<title:string,active_manifest:string,relationship:string,
    validation_status:array<struct<code:string,explanation:string>>>>,
  assertions:array<struct<label:string,data:string>>>"""
STORE = f"struct<active_manifest:string,manifests:map<string,{_MANIFEST}>,validation_status:array<struct<code:string,explanation:string>>>"
_ACTIONS = "struct<actions:array<struct<action:string,when:string,softwareAgent:string,digitalSourceType:string>>>"
_ACTION_LIST = "array<struct<action:string,when:string,softwareAgent:string,digitalSourceType:string>>"
_AGENT = "struct<name:string,version:string>"
# Assertion labels.
ACTION_LABELS = ["c2pa.actions", "c2pa.actions.v2"]
TRAINING_LABELS = ["c2pa.training-mining", "cawg.training-mining"]
HASH_LABELS = ["c2pa.hash.data", "c2pa.hash.boxes", "c2pa.hash.bmff", "c2pa.hash.bmff.v2"]


class ManifestTables(NamedTuple):
    summary: DataFrame
    actions: DataFrame
    agents: DataFrame
    edges: DataFrame
    codes: DataFrame


def _agent(value: Column) -> Column:
    """Name and version of a software agent given as JSON object or as plain text."""
    as_json = value.startswith("{")
    return let(
        F.from_json(F.when(as_json, value), _AGENT),
        lambda nested: F.struct(
            F.coalesce(nested["name"], F.when(~as_json, value)).alias("name"),
            nested["version"].alias("version"),
        ),
    )


def _actions_of(assertions: Column) -> Column:
    """The actions of all action assertions, read once, in order."""
    lists = F.transform(
        F.filter(assertions, lambda x: x["label"].isin(*ACTION_LABELS)),
        lambda x: F.coalesce(F.from_json(x["data"], _ACTIONS)["actions"], F.array().cast(_ACTION_LIST)),
    )
    return F.transform(
        F.flatten(lists),
        lambda x: F.struct(
            x["action"].alias("action"),
            x["when"].alias("when"),
            _agent(x["softwareAgent"]).alias("agent"),
            F.when(F.trim(x["digitalSourceType"]) != "", short_source_type(x["digitalSourceType"])).alias("source_type"),
        ),
    )


def _integrity(statuses: Column) -> Column:
    return F.filter(statuses, lambda c: code_family(c["code"], c["explanation"]) == "integrity")


def _summary(store: Column, active: Column, actions: Column, named: Column) -> Column:
    assertions = active["assertions"]

    def data_of(labels: list[str], shape: str) -> Column:
        first = F.get(F.filter(assertions, lambda x: x["label"].isin(*labels)), F.lit(0))
        return F.from_json(first["data"], shape)

    statuses = F.coalesce(
        store["validation_status"], F.array().cast("array<struct<code:string,explanation:string>>")
    )
    bad_ingredients = F.filter(active["ingredients"], lambda i: F.size(_integrity(i["validation_status"])) > 0)
    training = F.map_entries(data_of(TRAINING_LABELS, "struct<entries:map<string,struct<use:string>>>")["entries"])
    hash_shape = "struct<alg:string,exclusions:array<struct<start:bigint,length:bigint>>>"

    def counted(n: Column) -> Column:
        return F.coalesce(n, F.lit(0))

    def verdict(hashed: Column, failures: Column) -> Column:
        signed = F.exists(statuses, lambda c: c["code"] == "claimSignature.validated")
        return F.struct(
            F.size(F.map_keys(store["manifests"])).alias("manifest_count"),
            store["active_manifest"].alias("active_manifest"),
            active["claim_generator"].alias("claim_generator"),
            active["signature_info"]["issuer"].alias("signer"),
            active["signature_info"]["time"].alias("signed_at"),
            counted(F.size(active["ingredients"])).alias("ingredient_count"),
            counted(F.size(bad_ingredients)).alias("ingredient_failures"),
            counted(F.size(actions)).alias("action_count"),
            F.size(named).alias("agent_count"),
            F.array_compact(F.transform(actions, lambda x: x["source_type"])).alias("source_types"),
            F.map_from_entries(
                F.transform(training, lambda e: F.struct(e["key"].alias("k"), e["value"]["use"].alias("v")))
            ).alias("training_mining"),
            F.coalesce(F.exists(assertions, lambda x: x["label"] == "cawg.identity"), F.lit(False)).alias("identity_present"),
            hashed["alg"].alias("hash_alg"),
            counted(F.size(hashed["exclusions"])).alias("excluded_ranges"),
            failures.alias("integrity_failures"),
            (signed & (failures == 0)).alias("valid_signature"),
        )

    return let(
        data_of(HASH_LABELS, hash_shape),
        lambda hashed: let(F.size(_integrity(statuses)), lambda failures: verdict(hashed, failures)),
    )


def _flattened(store: Column) -> Column:
    """One parsed store as a struct of its summary row and the rows of the four other tables."""
    edges = F.flatten(
        F.transform(
            F.map_entries(store["manifests"]),
            lambda m: F.transform(
                F.coalesce(m["value"]["ingredients"], F.array()),
                lambda i: F.struct(m["key"].alias("parent"), i["active_manifest"].alias("child")),
            ),
        )
    )

    def packed(active: Column, actions: Column) -> Column:
        listed = F.coalesce(active["claim_generator_info"], F.array().cast(f"array<{_AGENT}>"))
        used = F.coalesce(F.transform(actions, lambda x: x["agent"]), F.array().cast(f"array<{_AGENT}>"))
        agents = F.array_distinct(
            F.filter(F.concat(used, listed), lambda x: F.coalesce(x["name"], F.lit("")) != "")
        )
        return let(
            agents,
            lambda named: F.struct(
                _summary(store, active, actions, named).alias("summary"),
                actions.alias("actions"),
                named.alias("agents"),
                F.filter(edges, lambda e: e["child"].isNotNull()).alias("edges"),
                F.filter(store["validation_status"], lambda c: c["code"].isNotNull()).alias("codes"),
            ),
        )

    active = F.coalesce(
        store["manifests"][store["active_manifest"]], F.get(F.map_values(store["manifests"]), F.lit(0))
    )
    return let(active, lambda a: let(_actions_of(a["assertions"]), lambda acts: packed(a, acts)))


def flatten_manifests(raw: DataFrame) -> ManifestTables:
    """Raw manifest JSON (item_id, store) as flat tables.

    summary: one row per item; actions: (item, position, action, when, agent, source_type);
    agents: distinct (item, name, version); edges: (item, parent, child)
    manifest labels; codes: (item, code, explanation).

    Each store is parsed once into a row that holds what all five tables need; that row is stored
    and the tables are read from it.
    """
    rows = cut_lineage(
        raw.select("item_id", let(F.from_json("store", STORE), _flattened).alias("f"))
    )

    def listed(name: str) -> DataFrame:
        return rows.select("item_id", F.posexplode_outer(f"f.{name}").alias("position", "x")).filter(
            F.col("x").isNotNull()
        )

    return ManifestTables(
        rows.select("item_id", "f.summary.*"),
        listed("actions").select("item_id", "position", "x.*"),
        listed("agents").select("item_id", "x.name", "x.version"),
        listed("edges").select("item_id", "x.parent", "x.child"),
        listed("codes").select("item_id", "x.code", "x.explanation"),
    )
