"""Keyed tables of streams: versions, replays, rejected rows."""

from tracelight.streaming import jobs
from tracelight.streaming.keyed import KeyedTable


def test_versions_and_replays(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], ["version"], buckets=4)
    assert table.read() is None

    def state():
        return {r["id"]: (r["version"], r["v"]) for r in table.read().collect()}

    def put(rows, batch):
        table.upsert(spark.createDataFrame(rows, "id long, version int, v string"), batch)

    put([(i, 1, "a") for i in range(20)], 0)
    put([(3, 3, "c"), (3, 2, "b"), (5, 0, "old"), (40, 1, "n")], 1)
    want = {i: (1, "a") for i in range(20)} | {3: (3, "c"), 40: (1, "n")}
    assert state() == want
    put([(3, 3, "c"), (3, 2, "b"), (5, 0, "old"), (40, 1, "n")], 1)  # replayed
    assert state() == want and table.batches() == [0, 1]
    put([], 2)
    assert state() == want
    put([(3, 3, "same version, later batch")], 3)
    assert state() == want | {3: (3, "same version, later batch")}
    folders = sorted(p.parent.name + "/" + p.name for p in (tmp_path / "t/data").glob("*/_bucket=*"))
    assert len(folders) <= 8  # two states of four buckets at most


def test_ingest(spark, tmp_path):
    schema = "doc_id long, text string, source string, version int"
    good, better = "Some words of a first text here.", "Other words of a second text here."
    files = [
        [(1, good, "s", 1), (2, good, "s", 1), (3, "  ", "s", 1)],
        [(1, better, "s", 3), (1, good, "s", 2), (2, None, "s", 2)],
        [(1, good, "s", 1), (4, "x" * 200_001, "s", 1)],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )
    rows, rejected = jobs.stream_ingest(stream, f"{tmp_path}/out", "version", buckets=3)
    found = {r["doc_id"]: (r["version"], r["canonical_sha256"]) for r in rows.collect()}
    assert {k: v for k, (v, _) in found.items()} == {1: 3, 2: 1}
    assert found[1][1] != found[2][1]
    told = {(r["doc_id"], r["version"], r["reason"]) for r in rejected.collect()}
    assert told == {(3, 1, "EMPTY"), (2, 2, "EMPTY"), (4, 1, "TOO_LARGE")}
    assert rejected.select("batch").distinct().count() == 3
    again, _ = jobs.stream_ingest(stream, f"{tmp_path}/out", "version", buckets=3)
    assert {r["doc_id"] for r in again.collect()} == {1, 2}


def test_ingest_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    rows, rejected = jobs.stream_ingest(stream, f"{tmp_path}/out")
    assert rows.count() == 0 == rejected.count() and "canonical_sha256" in rows.columns
