"""Dated events of an item, each with the certainty of the record it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import timeparse
from tracelight.functions.columns import let
from tracelight.operators.rules import is_true, outcomes
from tracelight.thresholds import Thresholds


def _event(kind: Column, certainty: Column, text: Column, source: str, raw: Column, rule: Column,
           parse: Column | None = None, tz: Column | None = None) -> Column:
    def event(read: Column) -> Column:
        return F.struct(
            kind.alias("event_type"),
            certainty.alias("certainty"),
            text.alias("description"),
            F.lit(source).alias("source"),
            read["at"].alias("event_time"),
            raw.cast("string").alias("raw_time"),
            (F.coalesce(read["zoned"], F.lit(False)) if tz is None else tz).alias("tz_known"),
            rule.alias("source_rule"),
        )

    return let(timeparse.reading(raw if parse is None else parse), event)


def _said(t: Thresholds) -> dict[str, Column]:
    """What the events of an item repeat of its records, each read once as a column."""
    said = outcomes(t)
    valid, invalid = said["provenance.valid"], said["provenance.invalid"]
    edited, identity = said["metadata.edit-history"], said["file.identity"]
    return {
        "_head_rule": F.when(valid.fired, "provenance.valid").when(invalid.fired, "provenance.invalid"),
        "_head": F.when(valid.fired, valid.level).otherwise(invalid.level),
        "_captured": said["metadata.captured"].level,
        "_gps": said["metadata.gps"].level,
        "_edit": edited.level,
        "_found": said["sources.matches"].fired,
        "_identity": F.when(identity.fired, "file.identity"),
    }


def _events() -> Column:
    p, m, s, lit = F.col("provenance"), F.col("metadata"), F.col("search"), F.lit
    head_rule, head, none = F.col("_head_rule"), F.col("_head"), F.lit(None).cast("string")
    manifest = head_rule.isNotNull()

    def some(when: Column, event: Column) -> Column:
        return F.when(is_true(when), F.array(event))

    def many(items: Column, when, event) -> Column:
        kept = F.filter(items, lambda x: is_true(when(x)))
        return F.coalesce(F.transform(kept, event), F.array())

    def recorded(key: str, kind: str, label: str, rule: str, level: Column) -> Column:
        return some(
            m.isNotNull() & (m[f"{key}_raw"] != ""),
            _event(
                lit(kind),
                F.coalesce(level, lit("POSSIBLE")),
                lit(label),
                "metadata",
                m[f"{key}_raw"],
                F.when(level.isNotNull(), rule),
                F.coalesce(m[f"{key}_parsed"], m[f"{key}_raw"]),
            ),
        )

    edit_level = F.coalesce(F.col("_edit"), lit("POSSIBLE"))
    edit_rule = F.when(F.col("_edit").isNotNull(), "metadata.edit-history")
    found = F.col("_found")
    groups = [
        some(
            manifest & (p["signed_at"] != ""),
            _event(lit("provenance.signed"), head, lit("Manifest signed."), "manifest", p["signed_at"], head_rule),
        ),
        F.when(manifest, many(
            p["actions"],
            lambda x: x["when"] != "",
            lambda x: _event(
                F.concat(lit("provenance.action:"), F.coalesce(x["action"], lit("action"))), head,
                F.concat(lit("The manifest records "), F.coalesce(x["action"], lit("an action")), lit(".")),
                "manifest", x["when"], head_rule,
            ),
        )),
        F.when(manifest, many(
            p["chain"],
            lambda x: (x["parent"] != "") & (x["signed_at"] != ""),
            lambda x: _event(lit("provenance.ingredient-signed"), head, lit("An ingredient's manifest was signed."),
                             "manifest", x["signed_at"], head_rule),
        )),
        recorded("captured", "metadata.captured", "Capture time in metadata.", "metadata.captured", F.col("_captured")),
        recorded("modified", "metadata.modified", "Modification time in metadata.", "metadata.modified", none),
        recorded("gps", "metadata.gps_time", "Receiver time in metadata.", "metadata.gps", F.col("_gps")),
        many(
            m["edit_history"],
            lambda x: lit(True),
            lambda x: _event(lit("metadata.edit"), edit_level,
                             F.concat(lit("Edit: "), F.coalesce(x["action"], lit("edit")), lit(".")),
                             "metadata", x["when"], edit_rule),
        ),
        F.when(found, many(
            s["matches"],
            lambda x: x["published_at"] != "",
            lambda x: _event(lit("source.published"), lit("POSSIBLE"), lit("A source reports a publication date."),
                             "search", x["published_at"], lit("sources.matches")),
        )),
        F.when(found, many(
            s["matches"],
            lambda x: x["discovered_at"] != "",
            lambda x: _event(lit("source.discovered"), lit("VERIFIED"), lit("The search returned a source."),
                             "search", x["discovered_at"], lit("sources.matches"), tz=lit(True)),
        )),
        some(
            F.col("file").isNotNull() & F.col("submitted_at").isNotNull(),
            _event(lit("analysis.submitted"), lit("VERIFIED"), lit("Submitted for analysis."), "ledger",
                   F.col("submitted_at"), F.col("_identity"), tz=lit(True)),
        ),
    ]
    return F.concat(*[F.coalesce(g, F.array()) for g in groups])


def build_timeline(obs: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Events in time order, undated last; nothing is inferred, only recorded times appear.

    An item's events come from its own row and are sorted inside it.
    """
    events = obs.withColumns(_said(t or Thresholds())).withColumn("_events", _events())
    ordered = F.sort_array(
        F.transform(
            "_events",
            lambda e, i: F.struct(e["event_time"].isNull().alias("undated"), e["event_time"].alias("at"), i.alias("i"), e.alias("e")),
        )
    )
    return (
        events.select("item_id", F.posexplode_outer(ordered).alias("position", "o"))
        .filter(F.col("o").isNotNull())
        .select("item_id", "position", "o.e.*")
    )


def earliest_known(timeline: DataFrame) -> DataFrame:
    """First dated event per item and where it comes from."""
    dated = timeline.filter(F.col("event_time").isNotNull())
    first = F.struct("event_time", "position")
    return dated.groupBy("item_id").agg(
        F.min("event_time").alias("event_time"),
        F.min_by("event_type", first).alias("event_type"),
        F.min_by("source", first).alias("source"),
        F.min_by("certainty", first).alias("certainty"),
    )
