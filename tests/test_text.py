from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.functions import timeparse, urls
from tracelight.operators import sources
from tracelight.operators import text as op

FOX = (
    "The lazy dog sleeps all day long. Foxes jump over dogs! Do dogs mind it? "
    "Foxes jump over dogs!\n\nA second paragraph ends here. It has two sentences."
)


def one(df):
    return df.first().asDict()


def test_normalisation_counts_every_rule(spark):
    dirty = "a\r\nb\r\nc \t\n\n\n\nd" + chr(0x200B) + chr(0x202E) + chr(7) + chr(0xA0) + "e\n"
    row = one(op.normalize_corpus(spark.createDataFrame([(dirty,)], "text string")))
    assert row["normalized"] == "a\nb\nc\n\nd e"
    assert row["text"] == dirty and row["changed"]
    assert (row["crlf_replaced"], row["zero_width_removed"], row["bidi_controls_removed"]) == (2, 1, 1)
    assert (row["control_chars_removed"], row["special_spaces_replaced"]) == (1, 1)
    assert (row["trailing_whitespace_lines"], row["blank_runs_collapsed"]) == (1, 1)
    assert row["zero_width_kinds"] == ["ZERO WIDTH SPACE"]


def test_composition_and_folding(spark):
    df = spark.createDataFrame([("cafe" + chr(0x301) + " Straße ﬁn",)], "text string")
    row = one(op.canonicalize(op.normalize_corpus(df), "normalized"))
    assert row["normalized"] == "café Straße ﬁn"
    assert row["canonical"] == "café strasse fin"


def test_statistics_on_a_known_text(spark):
    row = one(op.text_statistics(spark.createDataFrame([(FOX,)], "normalized string")))
    assert (row["word_count"], row["sentence_count"], row["paragraph_count"]) == (28, 6, 2)
    assert row["repeated_sentence_count"] == 1
    assert (row["longest_sentence_words"], row["shortest_sentence_words"]) == (7, 4)
    assert row["line_count"] == 3


def test_empty_text_has_zero_statistics(spark):
    row = one(op.text_statistics(spark.createDataFrame([("",)], "normalized string")))
    assert all(v == 0 for k, v in row.items() if k != "normalized")


def test_phrases_skip_greetings_and_repeat_only_once(spark):
    text = (
        "Dear reader this sentence is only a greeting line. "
        "Extraordinary manuscripts documented astonishing meteorological phenomena yesterday. "
        "EXTRAORDINARY manuscripts documented astonishing meteorological phenomena yesterday. Too short."
    )
    rows = op.distinctive_phrases(spark.createDataFrame([(1, text)], "doc_id long, normalized string")).collect()
    assert [r.phrase for r in rows] == [
        "Extraordinary manuscripts documented astonishing meteorological phenomena yesterday"
    ]


def test_secrets_are_redacted(spark):
    text = "Authorization: abc; x?token=1&y=2 sk-abcdefghijklmnop"
    row = one(op.redact_text(spark.createDataFrame([(text,)], "text string")))
    assert row["redacted"] == "Authorization: [redacted]; x?token=[redacted]&y=2 [redacted]"
    assert row["authorization_hits"] == row["keyvalue_hits"] == row["apikey_hits"] == 1


def test_timestamps(spark):
    cases = {
        "2024:01:02 03:04:05": ("2024-01-02 03:04:05", False),
        "2024-01-02T03:04:05Z": ("2024-01-02 03:04:05", True),
        "2024-01-02T03:04:05.123+02:00": ("2024-01-02 01:04:05", True),
        "2024-01-02T03:04:05-0530": ("2024-01-02 08:34:05", True),
        "2024-01-02": ("2024-01-02 00:00:00", False),
        "0000:00:00 00:00:00": (None, False),
        "2024-13-02": (None, False),
        "soon": (None, False),
        None: (None, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    out = sources.parse_timestamps(df, "raw").select("raw", F.col("event_time").cast("string"), "tz_known")
    assert {r.raw: (r.event_time, r.tz_known) for r in out.collect()} == cases


def test_entities_and_hosts(spark):
    df = spark.createDataFrame(
        [("<p>a &amp;lt; b&#39;s &eacute;&#x1F600; &amp c &bogus; d</p>", "HTTPS://u:p@WWW.Example.com:8/x")],
        "html string, url string",
    )
    row = df.select(
        T.squeeze(urls.unescape(F.regexp_replace("html", "<[^>]+>", ""))).alias("t"), urls.host_of(F.col("url")).alias("h")
    ).first()
    assert row.t == "a &lt; b's é" + chr(0x1F600) + " & c &bogus; d"
    assert row.h == "example.com"


def test_unknown_zone_is_not_a_zone(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05",)], "raw string")
    assert df.select(timeparse.tz_known(F.col("raw"))).first()[0] is False


def test_times_between_line_ends_are_read(spark):
    rows = ["2024-01-05\n", " 2024-01-05 10:00:00\r\n", "2024-01-05T10:00+02:30", "2024-02-30", "\n", None]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = df.select(
        F.unix_timestamp(timeparse.instant(F.col("raw"))).alias("t"), timeparse.tz_known(F.col("raw")).alias("z")
    ).collect()
    assert [r["t"] for r in got] == [1704412800, 1704448800, 1704439800, None, None, None]
    assert [r["z"] for r in got] == [False, False, True, False, False, False]
