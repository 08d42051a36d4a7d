"""Phrase windows made in Arrow tasks, and the character classes arranged for the JVM."""

import re

from pyspark.sql import functions as F

from tracelight.functions import text as T
from tracelight.operators import sources, text

WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
BODIES = [
    " ".join(WORDS), "", None, "one, two three four", "nine ten  eleven", "ten eleven nine ten eleven",
    "ELEVEN Twelve-one two", "one two three " * 40,
]
PHRASES = ["one two three", "nine ten eleven", "Three Four Five Six", "eleven", "two one two", "", None, "...", "zero"]


def expected(phrase, body):
    """None without a hit, else whether single blanks separate the words."""
    words = re.compile(T.WORD.replace(r"[\p{L}\p{N}]", "[a-z0-9]"))
    body = " ".join((body or "").lower().split())
    wanted, found = words.findall((phrase or "").lower()), words.findall(body)
    gaps, n = words.split(body), len(wanted)
    hits = [gaps[i + 1 : i + n] for i in range(len(found) - n + 1) if n and found[i : i + n] == wanted]
    return any(all(g == " " for g in x) for x in hits) if hits else None


def test_every_window_of_odd_texts_is_found(spark):
    corpus = spark.createDataFrame(
        [(None if i == 5 else i, i % 2, f"https://a{i}.example/", b) for i, b in enumerate(BODIES)] * 2,
        "source_id long, backend int, url string, text string",
    ).repartition(3)
    asked = spark.createDataFrame(list(enumerate(PHRASES)), "doc_id long, phrase string").withColumn(
        "phrase_index", F.lit(1)
    )
    rows = sources.phrase_search(asked, corpus).collect()
    found = {(r["doc_id"], r["url"]): r["similarity"] for r in rows}
    assert len(found) == len(rows)
    wanted = {}
    for i, p in enumerate(PHRASES):
        for j, b in enumerate(BODIES):
            hit = expected(p, b)
            if hit is not None:
                wanted[i, f"https://a{j}.example/"] = 1.0 if hit else None
    assert found == wanted and len(wanted) > 10


def test_windows_no_phrase_can_have_never_become_rows(spark):
    many = " ".join(f"w{i}" for i in range(20_000))
    corpus = spark.createDataFrame(
        [(1, 0, "https://a.example/", many)], "source_id long, backend int, url string, text string"
    )
    asked = spark.createDataFrame([(1, 1, "w7 w8 w9")], "doc_id long, phrase_index int, phrase string")
    keyed = sources._with_keys(
        asked.withColumn("_h", F.transform(T.words(F.col("phrase")), lambda w: F.xxhash64(w)))
    )
    texts = corpus.select(
        "url",
        F.transform(T.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"),
        F.transform(F.split("text", T.JVM_WORD), lambda g: g == " ").alias("gaps"),
    )
    rows = sources._windows(texts, [3], sources._key_filter(keyed.select("key"))).collect()
    assert 1 <= len(rows) < 100
    assert keyed.first()["key"] in {r["key"] for r in rows}
    plan = sources.phrase_search(asked, corpus)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_stop_words_are_looked_up_not_scanned(spark):
    docs = spark.createDataFrame([(1, "The cats and dogs of London WERE seen there.")], "doc_id long, normalized string")
    out = text.distinctive_phrases(docs)
    assert "array_contains" not in out._jdf.queryExecution().analyzed().toString()
    row = out.first()
    content = ["cats", "dogs", "London", "seen", "there"]
    assert row["score"] == sum(map(len, content)) / len(content) * (len(content) / 9)


def test_classes_for_the_jvm_hold_the_same_characters(spark):
    places = [i for i in range(0x3200) if i] + [0x4E00, 0xAC00, 0xFEFF, 0xFF10, 0xFFFD, 0x1D7CE, 0x1F600, 0x20000]
    rows = spark.createDataFrame([(chr(i),) for i in places], "c string")
    c = F.col("c")
    special = "".join(T.ZERO_WIDTH) + T.BIDI + T.SPECIAL_SPACES + T.CONTROLS
    wrong = rows.filter(
        (c.rlike(T.SPACE) != c.rlike(T.JVM_SPACE))
        | (c.rlike(f"^(?:{T.WORD})$") != c.rlike(f"^(?:{T.JVM_WORD})$"))
        | (c.rlike(f"^{T.PLAIN_WORD}$") != c.rlike(f"^{T.JVM_PLAIN_WORD}$"))
        | ((F.length(F.translate("c", special, "")) == 0) != c.rlike(T.HIDDEN))
    )
    assert [hex(ord(r["c"])) for r in wrong.collect()] == []
