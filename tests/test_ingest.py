"""The registered ingestion reads every file up to the operator's own limit."""

import hashlib

from tracelight.plans.catalog import QUERIES


def test_digests_of_files_above_one_mebibyte(spark, tmp_path):
    bodies = {"a.parquet": b"PAR1" + b"x" * (2 << 20), "b.parquet": b"PAR1" + b"y" * 100}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    with (tmp_path / "c.parquet").open("wb") as f:
        f.truncate((20 << 20) + 1)
    got = {r["path"]: r for r in QUERIES["ingest_files"](spark, str(tmp_path)).collect()}
    for name, body in bodies.items():
        assert got[name]["sha256"] == hashlib.sha256(body).hexdigest()
        assert got[name]["md5"] == hashlib.md5(body).hexdigest()
        assert got[name]["reason"] != "TOO_LARGE"
    assert got["c.parquet"]["reason"] == "TOO_LARGE"
