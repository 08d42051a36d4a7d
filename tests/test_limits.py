"""Nothing is cut off: long lists, long hosts, phrases of any length, streams of several files."""

import pytest
from pyspark.sql import functions as F

from tracelight.functions import timeparse
from tracelight.operators import evidence, lineage, percept, sources
from tracelight.streaming import jobs


def corpus_of(spark, rows):
    return spark.createDataFrame(rows, "source_id long, backend int, url string, text string")


def test_phrase_search_counts_urls_not_rows(spark):
    phrase = "one two three four five six"
    rows = [(i, 0, "http://a.example/same", phrase) for i in range(300)]
    rows += [(1000 + i, 0, f"http://a.example/{i}", phrase) for i in range(10)]
    phrases = spark.createDataFrame([(1, 0, phrase)], "doc_id long, phrase_index int, phrase string")
    assert sources.phrase_search(phrases, corpus_of(spark, rows)).count() == 11


def test_phrase_search_takes_lengths_from_phrases(spark):
    words = [f"w{k}" for k in range(11)]
    given = [(1, 0, " ".join(words[:5])), (2, 0, " ".join(words)), (3, 0, "w3")]
    phrases = spark.createDataFrame(given, "doc_id long, phrase_index int, phrase string")
    found = sources.phrase_search(phrases, corpus_of(spark, [(1, 0, "http://a.example/", " ".join(words))]))
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 2, 3]


def test_every_phrase_can_fill_the_list(spark):
    """The first phrase has as many URLs as the list less one; the second adds the last."""
    rows = [(i, 0, f"http://a.example/{i}", "p q r s t u") for i in range(49)]
    rows += [(i, 1, f"http://a.example/{i}", "a b c d e f") for i in range(60)]
    given = [(1, 0, "p q r s t u"), (1, 1, "a b c d e f")]
    phrases = spark.createDataFrame(given, "doc_id long, phrase_index int, phrase string")
    found = sources.phrase_search(phrases, corpus_of(spark, rows)).orderBy("rank").collect()
    assert [r["url"] for r in found] == [f"http://a.example/{i}" for i in range(50)]


def test_allowlist_keeps_equal_rows_and_long_hosts(spark):
    long = ".".join(["a"] * 70) + ".example.com"
    rows = [("http://x.example.com/1", "k")] * 3 + [(f"http://{long}/", "k"), ("http://other.org/", "k")]
    df = spark.createDataFrame(rows, "url string, parent string")
    allow = spark.createDataFrame([("example.com",)], "host string")
    got = sources.allowlisted_hosts(df, allow).collect()
    assert len(got) == 4 and {r["parent"] for r in got} == {"k"}


def test_sixty_edits_and_domains(spark):
    edits = ",".join(f'{{"action": "a{k}", "when": "2024-01-01T00:00:00Z"}}' for k in range(60))
    tags = spark.createDataFrame([(1, "XMP", "History", f"[{edits}]")], "item_id long, grp string, tag string, value string")
    assert lineage.edit_history(tags).count() == 60
    rows = [(1, k + 1, f"http://d{k}.example/", "web", 1.0, None) for k in range(25)]
    matches = spark.createDataFrame(
        rows, "item_id long, rank int, url string, source_kind string, similarity double, published_at string"
    )
    assert len(sources.matches_summary(matches).first()["domains"]) == 25
    assert len(sources.matches_summary(matches, max_domains=20).first()["domains"]) == 20


def test_modified_time_with_its_own_zone(spark):
    rows = [(1, "EXIF", "ModifyDate", "2024:01:01 10:00:00Z"), (1, "EXIF", "OffsetTime", "+02:00")]
    tags = spark.createDataFrame(rows, "item_id long, grp string, tag string, value string")
    got = lineage.normalize_tags(tags).select(F.unix_timestamp("modified_at").alias("t")).first()["t"]
    assert got == 1704103200


def test_a_signer_with_two_windows_gives_one_row(spark):
    events = spark.createDataFrame([("s", 5), ("s", 15), ("t", 5)], "signer string, at int")
    windows = spark.createDataFrame([("s", 0, 9), ("s", 20, 30)], "signer string, not_before int, not_after int")
    got = {(r["signer"], r["at"]): r["valid"] for r in sources.validity_at(events, windows, "signer", "at").collect()}
    assert got == {("s", 5): True, ("s", 15): False, ("t", 5): None}


def test_streams_of_folders_and_of_nothing(spark, tmp_path):
    rows = spark.range(30).select("id", (F.col("id") % 3).alias("v"))
    rows.repartition(5).write.parquet(str(tmp_path / "many.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "none.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path), "many", files_per_trigger=1)
    out = jobs.run_available(stream, str(tmp_path / "a"))
    assert out.count() == 30 and out.select("batch").distinct().count() == 5
    again = jobs.run_available(jobs.table_stream(spark, str(tmp_path), "many"), str(tmp_path / "a"))
    assert again.count() == 30
    empty = jobs.run_available(jobs.table_stream(spark, str(tmp_path), "none"), str(tmp_path / "b"))
    assert empty.count() == 0 and set(empty.columns) == {"id", "v", "batch"}


def test_newest_row_of_a_batch_goes_by_version(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, 7, "c"), (1, 1, 6, "b")], "k int, batch int, at int, x string")
    assert jobs.latest_by_key(rows, "k", version="at").first()["x"] == "c"


def test_wait_is_rounded_up():
    kept, allowed, _, wait = jobs.decide([1_000_500], 2_000_000 - 2_000_000 + 1_000_500, 1, 1_000_500)
    assert kept == [1_000_500] and not allowed and wait == 2


def test_iso_offsets_and_weeks(spark):
    want = {"2024-01-01T10:00:00+02": 1704096000, "2024-W01-1": 1704067200, "2020W537": 1609632000,
            "2024-W53-1": None, "2024:01:01 10:00:00+02": None, "2024-01-01 10:00-0130": 1704108600}
    df = spark.createDataFrame([(k,) for k in want], "raw string")
    got = df.select("raw", F.unix_timestamp(timeparse.instant(F.col("raw"))).alias("t")).collect()
    assert {r["raw"]: r["t"] for r in got} == want


def test_receiver_time(spark):
    rows = [(1, "EXIF", "GPSDateStamp", "2024:01:01"), (1, "EXIF", "GPSTimeStamp", "[10, 0, 5.7]"),
            (2, "EXIF", "GPSDateStamp", "2024:01:01"), (2, "EXIF", "GPSTimeStamp", "10:00:06.25"),
            (3, "Composite", "GPSDateTime", "2024:01:01 10:00:07Z"), (4, "EXIF", "GPSLatitude", "1")]
    tags = spark.createDataFrame(rows, "item_id long, grp string, tag string, value string")
    got = lineage.gps_positions(tags).select("item_id", F.unix_timestamp("received_at").alias("t")).collect()
    assert {r["item_id"]: r["t"] for r in got} == {1: 1704103205, 2: 1704103206, 3: 1704103207, 4: None}


def test_new_instructions_make_syntheses_stale(spark):
    fields = "item_id int, position int, rule string, level string, kind string, claim string, conflicts_with string"
    rows = spark.createDataFrame([(1, 0, "r", "POSSIBLE", "fact", "c", None)], fields)
    stored = evidence.evidence_fingerprint(rows, "1")
    assert evidence.stale_syntheses(stored, rows, "1").count() == 0
    assert evidence.stale_syntheses(stored, rows, "2").count() == 1


def test_other_grids_are_refused(spark):
    with pytest.raises(ValueError):
        percept.percept_hashes(spark.range(1), "id", width=32)
