"""Secret scans (operator 8): a random forest that removes false positives from pattern findings.

Patterns propose candidates (provider formats, assignments to key-like names, long mixed tokens).
Each is described by its length and character classes, how usual its character transitions are,
how much of it the corpus's own four-letter pieces cover, where its document comes from and which
words stand beside it. Transitions and pieces are counted over all texts; the forest is trained on
labelled findings of a bounded sample of documents and applied inside the row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import columns_of, kind_of, sent, ship, short_batches

ship(__name__)

#: A private key goes from its first to its last line; one without a last line is header and body.
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
KEY_BODY = re.compile(r"(?:\s*+[A-Za-z0-9-]++:[^\n]*+\n)*+[A-Za-z0-9+/=\s]*+")
#: Other candidate patterns in order of preference; group 1, or else the whole match, is the value.
PATTERNS = [
    ("cloud_key", re.compile(r"\b((?:AKIA|ASIA)[0-9A-Z]{12,20})\b")),
    ("repository_token", re.compile(r"\b(gh[pousr]_[A-Za-z0-9]{20,255})\b")),
    ("web_token", re.compile(r"\b(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")),
    ("service_key", re.compile(r"\b((?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}+)")),
    ("assignment", re.compile(
        r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
        r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)")),
    ("long_token", re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{16,}+)")),
]
#: A text without any of these holds no candidate.
HINT = re.compile(r"(?i)PRIVATE KEY|A[KS]IA|gh[pousr]_|eyJ|[spr]k[-_]|[:=]|[A-Za-z0-9+/_=-]{16}")
PLACEHOLDER = re.compile(
    r"(?i)example|sample|dummy|change.?me|placeholder|your[_-]|x{4,}|\*{3,}|<.*>|\$\{|test|0{6,}|1234567|abcdef"
)
KEY_WORD = re.compile(r"(?i)password|passwd|pwd|secret|token|key|credential|auth|bearer|login")
HEDGE = re.compile(r"(?i)example|sample|dummy|test|demo|hash|sha|md5|uuid|checksum|commit|version")
PROVIDERS = ("private_key", "cloud_key", "repository_token", "web_token", "service_key")
BASE = 27  # a-z and everything else

Finding = tuple[str, int, int]  # pattern, start, end


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Private keys of any length: each BEGIN with the next END, if no other BEGIN comes first."""
    begins = [m.span() for m in KEY_BEGIN.finditer(text)]
    ends = [m.span() for m in KEY_END.finditer(text)] if begins else []
    k = 0
    for i, (start, body) in enumerate(begins):
        limit = begins[i + 1][0] if i + 1 < len(begins) else len(text)
        while k < len(ends) and ends[k][0] < body:
            k += 1
        if k < len(ends) and ends[k][0] < limit:
            yield start, ends[k][1]
        else:
            yield start, KEY_BODY.match(text, body, limit).end()


def find_candidates(text: str, plain: bool = False) -> list[Finding]:
    """Values of all patterns; of overlapping ones that of the earlier pattern stays.

    A long token of letters or of digits alone is no candidate; training asks for these too
    (``plain``), as findings that a reviewer would turn down.
    """
    if HINT.search(text) is None:
        return []
    out: list[Finding] = [("private_key", a, b) for a, b in private_keys(text)]
    out.sort(key=lambda f: f[1])
    for name, pattern in PATTERNS:
        for m in pattern.finditer(text):
            start, end = m.span(1 if pattern.groups else 0)
            value = text[start:end]
            if name == "long_token" and not plain and (value.isalpha() or value.isdigit()):
                continue
            # findings do not overlap, so only the last one that starts before ``end`` can reach in
            at = bisect_left(out, end, key=lambda f: f[1])
            if start < end and (at == 0 or out[at - 1][2] <= start):
                out.insert(at, (name, start, end))
    return out


def letter_codes(raw: bytes) -> np.ndarray:
    codes = np.frombuffer(raw.lower(), np.uint8).astype(np.int64) - 96
    codes[(codes < 1) | (codes > 26)] = 0
    return codes


@dataclass
class Background:
    """What is usual in the corpus: log transition odds and which four-letter pieces are common."""

    transitions: np.ndarray  # (27, 27)
    common: np.ndarray  # (27^4,) bool

    def measure(self, value: str) -> tuple[float, float]:
        codes = letter_codes(value.encode())
        usual = float(self.transitions[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0
        if len(codes) < 4:
            return usual, 0.0
        cells = ((codes[:-3] * BASE + codes[1:-2]) * BASE + codes[2:-1]) * BASE + codes[3:]
        inside = np.zeros(len(codes), bool)
        hit = self.common[cells]
        for k in range(4):
            inside[k : k + len(hit)] |= hit
        return usual, float(inside.mean())


def background(docs: DataFrame, common_share: float = 2e-6) -> Background:
    """Counts of four-letter pieces over all texts; a piece is common from ``common_share`` on."""
    cells = BASE**4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in short_batches(batches, "text", 1_000_000):
            for text in batch.column(0).to_pylist():
                c = letter_codes((text or "").encode())
                if len(c) > 3:
                    at = ((c[:-3] * BASE + c[1:-2]) * BASE + c[2:-1]) * BASE + c[3:]
                    np.add.at(total, at, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["cell", "n"])

    got = (
        docs.select("text")
        .mapInArrow(count, "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    n = np.zeros(cells)
    n[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    pairs = n.reshape(BASE, BASE, -1).sum(axis=2) + 0.5
    odds = np.log(pairs / pairs.sum(axis=1, keepdims=True) * BASE)
    letters = np.indices((BASE,) * 4).min(axis=0).ravel() > 0
    return Background(odds, letters & (n >= common_share * max(n.sum(), 1)) & (n > 1))


def features(text: str, source: str | None, found: Finding, usual: Background) -> list[float]:
    name, start, end = found
    value = text[start:end]
    n = len(value)
    counts = np.array([value.count(c) for c in set(value)]) / n
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    transitions, covered = usual.measure(value)
    classes = [sum(map(f, value)) / n for f in (str.isdigit, str.isupper, str.islower)]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False)) / n
    path = source or ""
    depth, tested = path.count("/"), HEDGE.search(path) is not None
    return [
        n, *classes, 1 - sum(classes), switches, transitions, covered,
        float(-(counts * np.log2(counts)).sum()), len(set(value)) / n,
        float(re.fullmatch("[0-9a-fA-F]+", value) is not None),
        float(PROVIDERS.index(name) if name in PROVIDERS else len(PROVIDERS) + (name == "long_token")),
        float(KEY_WORD.search(before) is not None), float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(HEDGE.search(before + after) is not None), float(PLACEHOLDER.search(value) is not None),
        float(before[-1:] in ("\"", "'")), depth, float(tested), len(path),
    ]


def weak_label(text: str, found: Finding) -> int | None:
    """Label of a finding where no reviewer gave one: 1 for a provider's format or a mixed value
    assigned to a key-like name, 0 for placeholders and for values of plain letters or digits,
    None where neither is clear."""
    name, start, end = found
    value = text[start:end]
    if PLACEHOLDER.search(value) or len(set(value)) < 5:
        return 0
    if name in PROVIDERS:
        return 1
    digits, letters = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if not digits or not letters:
        return 0
    if name == "assignment":
        return 1 if len(value) >= 12 else None
    return 0 if HEDGE.search(text[max(0, start - 30) : start]) else None


@dataclass
class Forest:
    """Trees as flat arrays; a leaf has feature -1 and its share of secrets as threshold."""

    trees: list[tuple[np.ndarray, ...]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right in self.trees:
            node = np.zeros(len(x), int)
            while (open_rows := feature[node] >= 0).any():
                rows = np.flatnonzero(open_rows)
                at = node[rows]
                low = x[rows, feature[at]] <= threshold[at]
                node[rows] = np.where(low, left[at], right[at])
            total += threshold[node]
        return total / max(len(self.trees), 1)


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A tree of Gini splits; each split looks at the root of the number of features."""
    nodes: list[list[float]] = []
    tries = max(1, round(math.sqrt(x.shape[1])))

    def grow(rows: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append([-1, y[rows].mean(), 0, 0])
        if not left or len(rows) < 4 or y[rows].min() == y[rows].max():
            return at
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, ones = x[order, f], np.cumsum(y[order])
            cuts = np.flatnonzero(values[1:] > values[:-1])
            if not len(cuts):
                continue
            n = cuts + 1.0
            p, q = ones[cuts] / n, (ones[-1] - ones[cuts]) / (len(rows) - n)
            impure = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
            k = int(impure.argmin())
            if best is None or impure[k] < best[0]:
                best = (impure[k], int(f), (values[cuts[k]] + values[cuts[k] + 1]) / 2)
        if best is not None:
            low = x[rows, best[1]] <= best[2]
            nodes[at] = [best[1], best[2], grow(rows[low], left - 1), grow(rows[~low], left - 1)]
        return at

    grow(rng.integers(0, len(x), len(x)), depth)
    table = np.array(nodes, float)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int)


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8) -> Forest:
    """Bootstrap trees with both classes at equal weight; one class only gives its constant."""
    rng = np.random.default_rng(17)
    if not len(y):
        return Forest([(np.array([-1]), np.array([1.0]), np.array([0]), np.array([0]))])
    if y.min() < y.max():
        few = y == (1 if y.mean() < 0.5 else 0)
        again = rng.choice(np.flatnonzero(few), int((~few).sum() - few.sum()))
        keep = np.concatenate([np.arange(len(y)), again])
        x, y = x[keep], y[keep]
    return Forest([grow_tree(x, y, rng, depth) for _ in range(trees)])


Labeller = Callable[[str, Finding], int | None]


def train(
    docs: DataFrame,
    usual: Background,
    label: Labeller = weak_label,
    sample_docs: int = 3000,
    findings_each: int = 4,
) -> Forest:
    """The forest from labelled findings in about ``sample_docs`` documents with a candidate,
    taken by hash, and at most ``findings_each`` findings of either label in each."""
    hint = r"PRIVATE KEY|AKIA|ASIA|gh[pousr]_|eyJ|[=:]|[A-Za-z0-9+/_=-]{16}"
    near = docs.filter(F.col("text").rlike(hint))
    share = min(1.0, sample_docs / max(near.count(), 1))
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches, "text"):
            rows, labels = [], []
            for text, source in zip(*columns_of(batch, "text", "source"), strict=True):
                taken = {0: 0, 1: 0}
                for found in find_candidates(text, plain=True):
                    y = label(text, found)
                    if y is not None and taken[y] < findings_each:
                        taken[y] += 1
                        rows.append(features(text, source, found, usual))
                        labels.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["x", "y"]
            )

    rows = near.filter(lot < share).mapInArrow(collect, "x array<double>, y int").collect()
    rows = sorted((tuple(r["x"]), r["y"]) for r in rows)
    return train_forest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def judged(text: str, source: str | None, usual: Background, forest: Forest) -> list[tuple[Finding, float]]:
    found = find_candidates(text)
    if not found:
        return []
    x = np.array([features(text, source, f, usual) for f in found])
    return list(zip(found, forest.predict(x).tolist(), strict=True))


def prepared(docs: DataFrame, id_column: str, text_column: str, path_column: str | None) -> DataFrame:
    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), path.alias("source"))


def scan_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str | None = "source",
    threshold: float = 0.5,
    label: Labeller = weak_label,
) -> DataFrame:
    """(id, pattern, start, end, value_sha256, probability, is_secret): every candidate of every
    whole text, in code points, with the forest's verdict. Null and empty texts have none."""
    source = prepared(docs, id_column, text_column, path_column)
    usual = background(source)
    received = sent(source.sparkSession, usual, train(source, usual, label))
    kind = source.schema["_id"].dataType.simpleString()
    names = [id_column, "pattern", "start", "end", "value_sha256", "probability", "is_secret"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, forest = received()
        for batch in short_batches(batches, "text"):
            rows = []
            for doc_id, text, path in zip(*columns_of(batch, "_id", "text", "source"), strict=True):
                for (name, a, b), p in judged(text or "", path, usual, forest):
                    digest = hashlib.sha256(text[a:b].encode()).hexdigest()
                    rows.append((doc_id, name, a, b, digest, p, p >= threshold))
            data = list(zip(*rows, strict=True)) or [[]] * len(names)
            typed = zip(data, [kind_of(batch, "_id"), *kinds], strict=True)
            arrays = [pa.array(c, k) for c, k in typed]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(
        scan,
        f"`{id_column}` {kind}, pattern string, start long, end long, value_sha256 string, "
        "probability double, is_secret boolean",
    )


def redact_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str | None = "source",
    threshold: float = 0.5,
    mark: str = "[SECRET]",
    label: Labeller = weak_label,
) -> DataFrame:
    """``docs`` with every secret of ``text_column`` replaced by ``mark``; all rows and columns stay."""
    source = prepared(docs, id_column, text_column, path_column)
    usual = background(source)
    received = sent(source.sparkSession, usual, train(source, usual, label))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, forest = received()
        for batch in short_batches(batches, text_column):
            paths = columns_of(batch, path_column)[0] if path_column else [None] * batch.num_rows
            out = []
            for text, path in zip(columns_of(batch, text_column)[0], paths, strict=True):
                parts, done = [], 0
                for (_, a, b), p in judged(text or "", path, usual, forest):
                    if p >= threshold:
                        parts += [text[done:a], mark]
                        done = b
                out.append("".join([*parts, text[done:]]) if parts else text)
            at = batch.schema.get_field_index(text_column)
            yield batch.set_column(at, text_column, pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
