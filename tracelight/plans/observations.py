"""Assembles the wide observation row: one left join per subsystem, all on the item id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The struct each subsystem contributes; null = it did not run.
SHAPES = {
    "file": "struct<sha256:string,size_bytes:bigint,mime_type:string>",
    "provenance": "struct<has_manifest:boolean,valid_signature:boolean,trust_evaluated:boolean,"
    "trusted:boolean,valid_at_signing:boolean,signed_at:string,signer:string,"
    "source_types:array<string>,training_mining:map<string,string>,identity_present:boolean,"
    "identity_codes:array<string>,ingredient_failures:bigint,manifest_location:string,"
    "remote_host:string,order_conflict:boolean,"
    "actions:array<struct<action:string,when:string,agent:string>>,"
    "chain:array<struct<label:string,parent:string,signed_at:string>>>",
    "metadata": "struct<software:string,camera_make:string,camera_model:string,"
    "captured_raw:string,captured_parsed:string,modified_raw:string,modified_parsed:string,"
    "gps_raw:string,gps_parsed:string,generator:string,marker_tags:array<string>,"
    "source_type:string,edit_history:array<struct<action:string,software:string,when:string>>,"
    "derived_from:string,gps_present:boolean,latitude:double,longitude:double,has_exif:boolean,"
    "has_xmp:boolean,has_iptc:boolean,provenance_host:string>",
    "similar": "struct<identical:bigint,near:bigint>",
    "text": "struct<word_count:bigint,sentence_count:bigint,paragraph_count:bigint,"
    "language:string,language_confidence:double,hidden:bigint,repeated_sentences:bigint>",
    "ai": "struct<score:double,calibrated:boolean>",
    "search": "struct<match_count:bigint,dated_count:bigint,"
    "matches:array<struct<url:string,published_at:string,discovered_at:string>>>",
    "signals": "map<string,struct<applicable:boolean,anomaly:boolean,detected:boolean,"
    "measured:boolean,prior_grid:boolean,encoding:boolean,smooth_blocks:bigint,mismatch:boolean,"
    "orientation:boolean,aspect:boolean>>",
}


def signal_map(signals: DataFrame) -> DataFrame:
    """The long signals table (item_id, method, flags...) as one map per item: eight methods."""
    flags = [c for c in signals.columns if c not in ("item_id", "method")]
    # the struct is made before the aggregate, which would interpret it once a row
    entries = signals.select("item_id", F.struct("method", F.struct(*flags).alias("s")).alias("_e"))
    return entries.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list("_e")).alias("signals")
    )


def similar_counts(similar: DataFrame, id_col: str) -> DataFrame:
    """Ranked similarity rows to (item_id, similar): how many other items per kind."""
    near = F.col("relation") == "near"
    return similar.groupBy(F.col(id_col).alias("item_id")).agg(
        F.struct(
            F.coalesce(F.sum(F.when(~near, F.col("members"))), F.lit(0)).alias("identical"),
            F.coalesce(F.sum(F.when(near, F.col("members"))), F.lit(0)).alias("near"),
        ).alias("similar")
    )


def search_struct(matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Matches (at most 50 per item by rank) and the items a search ran for, to one struct."""
    match = F.struct("rank", "url", "published_at", "discovered_at")
    listed = matches.withColumn("_m", match).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("match_count"),
        F.count_if(F.coalesce("published_at", F.lit("")) != "").alias("dated_count"),
        F.transform(
            F.sort_array(F.collect_list("_m")),
            lambda x: F.struct(x["url"].alias("url"), x["published_at"].alias("published_at"),
                               x["discovered_at"].alias("discovered_at")),
        ).alias("matches"),
    )
    joined = runs.select("item_id").distinct().join(listed, "item_id", "left")
    return joined.select(
        "item_id",
        F.struct(
            F.coalesce("match_count", F.lit(0)).alias("match_count"),
            F.coalesce("dated_count", F.lit(0)).alias("dated_count"),
            "matches",
        ).alias("search"),
    )


def assemble_observations(items: DataFrame, **parts: DataFrame) -> DataFrame:
    """``items`` (item_id, analysis_type, submitted_at) with one struct column per subsystem.

    Each part is (item_id, <its name>); a part that is not given is null for everyone. All joins
    share one key, so the items are shuffled once.
    """
    unknown = set(parts) - set(SHAPES)
    if unknown:
        raise ValueError(f"unknown subsystems: {sorted(unknown)}")
    out = items.select("item_id", "analysis_type", "submitted_at")
    for name, shape in SHAPES.items():
        if name in parts:
            part = parts[name].select("item_id", F.col(name).cast(shape).alias(name))
            out = out.join(part, "item_id", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast(shape))
    return out
