"""The registered queries on the smallest tables against plain-Python versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracelight.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = {int(re.match(r"op(\d+)_", n)[1]): n for n in QUERIES}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    held = {}

    def run(n):
        if n not in held:
            rows = [r.asDict() for r in QUERIES[NAMES[n]](spark, FOLDER).collect()]
            held[n] = rows
        return held[n]

    return run


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def tokenizer(name):
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_all_ten_are_there():
    assert sorted(NAMES) == list(range(1, 11))


@pytest.mark.parametrize("n", [2, 6, 9])
def test_checking_sql(spark, n):
    from compare import compare, connect

    df = QUERIES[NAMES[n]](spark, FOLDER)
    assert compare(df, connect(FOLDER), ORACLES[NAMES[n]]) == []


def test_language_accuracy(result, docs):
    rows = [r for r in result(1) if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"]) == 0) for r in result(1))
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]].lang for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in result(1))


def test_urls(result, spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rules = {"net": ("/", "block"), "example.net": ("/en/", "allow"),
             "example.com": ("/de/", "block"), "org": ("/fr/", "allow")}
    assert len(result(2)) == len(urls)
    for r in result(2):
        rest = urls[r["page_id"]].split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [
            h + p
            for h, (p, _) in rules.items()
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, key=len) if fits else None
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        if best:
            assert r["verdict"] == rules[best.split("/")[0]][1]


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    out = [("email", *m.span()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_data(result, docs):
    assert len(result(3)) == len(docs)
    for r in result(3):
        spans = plain_spans(docs[r["doc_id"]].text)
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        counts = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))  | {""}


def test_base_spans_on_random_texts():
    import random

    from tracelight.llm.pii_segments import KINDS, base_spans

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab.@-+%_ 129()4é") for _ in range(rng.randint(5, 60))) for _ in range(5000)]
    for text in [*texts, "a" * 200 + "@b.c", "x" * 64 + "@y.zz", "@@a@b.c@d.e a.b@c.d.e@f.g"]:
        assert sorted(plain_spans(text)) == sorted((KINDS[k], a, b) for k, a, b in base_spans(text))


def test_quality_statistics(result, docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in result(4):
        text = docs[r["doc_id"]].text
        words = word.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if word.search(line)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
                len(lines) - len(set(lines)), len(covered))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(r[n] for n in names) == want
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_decisions(spark):
    """On the labelled rows of a larger table: clean texts stay, nearly all bad ones go."""
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES[NAMES[4]](spark, folder).collect() if not r.base_failed]
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if quality.get(r.doc_id) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_packing_round_trip(result, docs):
    encode = tokenizer("word_bpe_49k.json").encode
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in result(5):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for doc_id, rows in pieces.items():
        ids = [*encode(docs[doc_id].text, add_special_tokens=False).ids, 1]
        at = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(part) // 4)
            assert r["ids_crc32"] == zlib.crc32(part)
            at += 4096
        assert at >= len(ids) > at - 4096
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in result(5))
    assert len(sequences) <= math.ceil(total / 4096) + 2


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_decontamination(result, docs, spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = word.findall(low(item.text))
        for i in range(len(words) - 9):
            windows[tuple(words[i : i + 10])].add(item.item_id)
    for r in result(6):
        words = word.findall(low(docs[r["doc_id"]].text))
        hit, items = set(), set()
        for i in range(len(words) - 9):
            if found := windows.get(tuple(words[i : i + 10])):
                hit |= {*range(i, i + 10)}
                items |= found
        names = ",".join(sorted(map(str, items)))
        want = (len(words), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
        assert tuple(r[n] for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_token_counts(result, docs):
    encode = tokenizer("byte_bpe_50k.json").encode
    for r in result(7):
        text = docs[r["doc_id"]].text
        n = len(encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_secrets(result, docs):
    found = collections.defaultdict(list)
    for r in result(8):
        value = docs[r["doc_id"]].text[r["start"] : r["end"]]
        assert r["value_sha256"] == hashlib.sha256(value.encode()).hexdigest()
        if r["is_secret"]:
            found[r["doc_id"]].append(value)
    sure = re.compile(r"\b(?:AKIA[0-9A-Z]{16})\b|password=(\w{16,})|token = \"(\w{30,})\"")
    for doc_id, doc in docs.items():
        for m in sure.finditer(doc.text):
            assert (m[1] or m[2] or m[0]) in found[doc_id]


def test_near_duplicates(result, docs):
    sets = {}
    for doc_id, doc in docs.items():
        w = doc.text.encode().lower().split()
        sets[doc_id] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([(*w,)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y]) if x < y else 0
            if both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    for r in result(9):
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root(i), root(i) == i)


def test_scores(result, docs):
    tokens = {i: [*d.text.encode().lower().split(), b""] for i, d in docs.items()}
    counts = collections.Counter(t for i, ts in tokens.items() if fold(i) != 1 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for r in result(10):
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[t] > 0 for t in own))
        assert r["train_tokens"] == n and r["held_out"] == (fold(r["doc_id"]) == 1)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    held = [r for r in result(10) if r["held_out"]]
    sizes = [len(docs[r["doc_id"]].text.encode()) for r in held]
    assert sum(r["bits_per_byte"] * n for r, n in zip(held, sizes, strict=True)) < 3.5 * sum(sizes)


def small_model(tokens, times, table_bits=10):
    from tracelight.llm import context_mixing as m

    counts = np.zeros((len(m.ORDERS), 2 << table_bits), np.float32)
    bits = m.decisions(tokens, table_bits)
    for p in range(len(m.ORDERS)):
        np.add.at(counts[p], bits.cells[p] * 2 + bits.bit, bits.per_decision(times))
    tables = m.tables_of(counts, table_bits)
    online = m.OnlinePass(m.first_mixer(), 0.15)
    for _ in range(20):
        online.step(tables, tokens, times)
    return m, tables, m.Mixer(online.weights, online.refined)


def test_probabilities_add_up():
    """After every beginning the probabilities of all 256 next bytes sum to one."""
    words = [b"the", b"then", b"this", b""]
    m, tables, mixer = small_model(words, np.array([5.0, 3.0, 2.0, 4.0]))
    for start in (b"", b"t", b"th", b"the", b"zq"):
        tokens = [start + bytes([b]) for b in range(256)]
        bits = m.decisions(tokens, tables.table_bits)
        cost = bits.per_byte(m.costs(tables, mixer, bits))
        here = bits.at == len(start)
        each = np.exp(-np.bincount(bits.token[here], cost[here], 256))
        assert each.sum() == pytest.approx(1, abs=1e-5)
    scores = m.token_scores(tables, mixer, [*words, b"zz"])
    assert (scores < 0).all() and scores[0] > scores[4]


def test_shared_beginnings_change_no_score():
    """Sorted tokens share steps; each alone shares none."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(0, 6))) for _ in range(80)]
    times = rng.integers(1, 9, len(words)).astype(float)
    m, tables, mixer = small_model(words, times, 12)
    alone = [m.token_scores(tables, mixer, [w])[0] for w in words]
    assert m.token_scores(tables, mixer, words) == pytest.approx(alone)
    order = sorted(range(len(words)), key=words.__getitem__)
    got = m.token_scores(tables, mixer, [words[i] for i in order])
    assert got == pytest.approx([alone[i] for i in order])
    bits = m.decisions([words[i] for i in order], 12)
    assert len(bits.bit) // 8 == len({(words[i] + b" " if words[i] else b"\n")[: n + 1] for i in order for n in range(len(words[i]) + 1)})
    weights = collections.Counter()
    for i in order:
        spelled = words[i] + b" " if words[i] else b"\n"
        for n in range(len(spelled)):
            weights[spelled[: n + 1]] += times[i]
    assert sorted(bits.per_decision(times[order])[::8]) == sorted(weights.values())


def test_own_occurrence_is_left_out():
    """A token seen once is predicted by its own count as if it had never been seen."""
    m, tables, mixer = small_model([b"qx"], np.array([1.0]), 16)
    bits = m.decisions([b"qx"], 16)
    x, _ = m.inputs(tables, bits, without_own=True)
    assert np.abs(x[:-1]).max() == 0
    x, _ = m.inputs(tables, bits)
    assert (np.sign(x[:-1]) == 2 * bits.bit - 1).all()


def test_mixer_learns_from_every_task(spark):
    """The average of the tasks' passes, weighted by the occurrences that moved each number."""
    m, tables, _ = small_model([b"ab", b"abc"], np.array([3.0, 1.0]))
    rows = spark.createDataFrame([(b"ab", 3), (b"abc", 1)], "token binary, n_train long")
    from tracelight.llm.common import sent

    got = m.fit_round(rows.repartition(2, "token"), sent(spark, tables), m.first_mixer(), 0.15)
    alone = []
    groups = rows.repartition(2, "token").rdd.glom().map(lambda r: [(bytes(x.token), x.n_train) for x in r])
    for part in groups.collect():
        online = m.OnlinePass(m.first_mixer(), 0.15)
        if part:
            online.step(tables, [t for t, _ in part], np.array([n for _, n in part], float))
        alone.append(online)
    moved = sum(o.moved for o in alone)
    want = sum(o.weights * o.moved[:, None] for o in alone)
    for g in range(m.GATES):
        expected = want[g] / moved[g] if moved[g] else m.first_mixer().weights[g]
        assert got.weights[g] == pytest.approx(expected)


def test_white_space_costs_nothing(spark):
    from tracelight.llm import context_mixing as m

    rows = [(1, "one two three", True), (2, "one   two \t three", True), (3, None, False), (4, "", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in m.score_texts(docs, table_bits=12).collect()}
    assert got[1].bits_per_byte == pytest.approx(got[2].bits_per_byte)
    assert got[3].bits_per_byte == got[4].bits_per_byte > 0


def test_words_are_read_after_the_words_before(spark):
    """Shuffled words cost more than the text; the base score, which has no order, the same."""
    from tracelight.llm import context_mixing as m

    text = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    shuffled = "bridge the fox old dog quick the over near lazy the stone jumps brown"
    rows = [(i, text, True) for i in range(30)] + [(98, text, False), (99, shuffled, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in m.score_texts(docs, table_bits=14).collect()}
    assert got[98].base_score == pytest.approx(got[99].base_score)
    assert got[98].n_tokens == got[99].n_tokens == got[99].n_known == 15
    assert got[99].score < 2 * got[98].score < 0
    pair = {p: m.decisions(*m.parted([p])[:1], 14, m.parted([p])[1]) for p in (b"a cd", b"b cd")}
    one, two = pair.values()
    assert len(one.bit) == len(two.bit) == 24 and (one.bit == two.bit).all()
    other = (one.cells != two.cells).reshape(len(m.ORDERS), 3, 8).any(axis=2)
    # the byte contexts differ as far as they reach, the beginning never, the pair always
    assert other.tolist() == [
        [o == -1 or o >= n + 2 for n in range(3)] for o in m.ORDERS
    ]
