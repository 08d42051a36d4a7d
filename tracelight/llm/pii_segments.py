"""PII (operator 3): base patterns plus a semi-Markov conditional random field.

The base patterns (e-mail, IP, card, phone) give the spans that always count. The model (Sarawagi
and Cohen, 2004) adds spans that no pattern matches, such as disguised addresses and numbers with
other separators. Whole spans of up to ``MAX_TOKENS`` tokens (``DOT_TOKENS`` with a spelled-out dot) are scored by features of the span as
a whole (shape, digits, check digit, separators, neighbouring words); dynamic programming over
segments chooses boundaries and kinds jointly, and a span is added if its marginal probability is
at least ``ACCEPT``. A text is only looked at near anchors (digits, @ and spelled-out @ or dots), so
its cost follows the anchors it holds.

The model learns from base spans of a bounded sample of documents, as they are and rewritten in
the ways of ``DISGUISES``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import columns_of, kind_of, sent, ship, short_batches

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
DOT_TOKENS = 64  # of a span with a spelled-out dot
ACCEPT = 0.9
NEAR = 30  # anchors closer than this share a window, which reaches as far beyond them

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A run of digits that fails as a start fails at each of its digits, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What stands for @ or a dot: (at), [dot], dot, and at before a name with a dot.
SPELLED = r"[\[(]\s?(?:at|dot)\s?[\])]|\bdot\b|\bat\s+(?=[a-z0-9-]+\.[a-z])"
ANCHOR = re.compile(rf"(?i)[0-9]+|@|{SPELLED}")
NAMED = re.compile(rf"(?i)@|{SPELLED}")
DOT = re.compile(r"(?i)\bdot\b")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @: its local part is the run before it,
    from the end of the last address on."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL_END.match(text, start - 1, at):
            step = max(last, start - 64)
            found = LOCAL_END.search(text, step, at)
            if found is None or found.start() == start:
                break
            start = found.start()
            if start > step:
                break
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of ``text`` around its anchors, cut between words where words are short."""
    start = end = None
    for m in ANCHOR.finditer(text):
        if end is not None and m.start() - end <= NEAR:
            end = m.end()
            continue
        if end is not None:
            yield widened(text, start, end)
        start, end = m.span()
    if end is not None:
        yield widened(text, start, end)


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    cut = text.find(" ", low, start)
    low = cut + 1 if low and cut >= 0 else low
    cut = text.rfind(" ", end, high)
    return low, cut if high < len(text) and cut >= 0 else high


@dataclass
class Candidates:
    """Tokens of a window and the spans of them that may be entities."""

    starts: list[int]
    ends: list[int]
    spans: list[tuple[int, int]]  # first token, one past the last
    features: list[list[str]]


def shape(span: str) -> str:
    """Letters as a, runs of digits as 9, white space as one blank, other characters as they are."""
    out = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", span))
    return re.sub(r"\s+", " ", out)


def span_features(text: str, start: int, end: int, before: str, after: str) -> list[str]:
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    seps = "".join(sorted({c if not c.isspace() else " " for c in span if not c.isalnum()}))
    form = shape(span)
    low = span.lower()
    out = [
        "any", f"shape {form[:40]}", f"digits {min(len(digits), 20)}", f"groups {min(len(groups), 8)}",
        f"seps {seps[:8]}", f"before {before.lower()}", f"after {after.lower()[:12]}",
        f"first {form[:1]}", f"last {form[-1:]}", f"sizes {' '.join(str(len(g)) for g in groups)[:20]}",
    ]
    if len(digits) >= 13:
        out.append(f"check digit {luhn(digits)} {13 <= len(digits) <= 19}")
    if len(groups) == 4:
        out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    at = re.search(r"@|\bat\b", low)
    if at:
        tail = low[at.end() :]
        dots = len(re.findall(r"\.|\bdot\b", tail))
        out += [f"at {at[0]} dots {min(dots, 3)}", f"tail {bool(re.search('[a-z]{2,6}$', tail))}"]
        joined = re.sub(r"\s*[\[(]?\s?(\bdot\b|\.)\s?[\])]?\s*", ".", tail.lstrip("])} "))
        out.append(f"lead blanks {min(low[: at.start()].rstrip('[( ').count(' '), 2)}")
        out.append(f"tail blanks {min(joined.strip().count(' '), 2)} {joined.count('.') > 0}")
        out.append(f"local {bool(re.match(r'[^@\s]*[a-z0-9]', low))} spaces {span.count(' ') > 5}")
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    out.append(f"glued {glued}")
    if start and text[start - 1] in "+-.@_":
        out.append("cut left")
    if end + 1 < len(text) and text[end] in "-.@_" and text[end + 1].isalnum():
        out.append("cut right")
    return out


def candidates(text: str) -> Candidates:
    tokens = [m.span() for m in TOKEN.finditer(text)]
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    words = [text[a:b] for a, b in tokens]
    anchor = [w[0].isdigit() or w == "@" or w.lower() in ("dot", "at") for w in words]
    number = np.concatenate([[0], np.cumsum(anchor)])
    plain = [w.isalnum() or w in "+(@" for w in words]  # what an entity may begin with
    closes = [w.isalnum() for w in words]
    spans, features = [], []
    most = DOT_TOKENS if DOT.search(text) else MAX_TOKENS
    for i in range(len(words)):
        if not plain[i]:
            continue
        for j in range(i + 1, min(len(words), i + most) + 1):
            if not closes[j - 1] or number[j] == number[i]:
                continue
            raw = text[starts[i] : ends[j - 1]]
            if "\n" in raw:
                break
            n = sum(c.isdigit() for c in raw)
            named = NAMED.search(raw) is not None
            if n < 7 and not named and number[j] - number[i] < 4:
                continue
            if j - i > MAX_TOKENS and DOT.search(raw) is None:
                continue
            spans.append((i, j))
            before = words[i - 1] if i else ""
            after = words[j] if j < len(words) else ""
            features.append(span_features(text, starts[i], ends[j - 1], before, after))
    return Candidates(starts, ends, spans, features)


@dataclass
class Model:
    place: dict[str, int]
    weights: np.ndarray  # (features, kinds)

    def scores(self, found: Candidates) -> np.ndarray:
        out = np.zeros((len(found.spans), len(KINDS)))
        for k, names in enumerate(found.features):
            at = [self.place[f] for f in names if f in self.place]
            out[k] = self.weights[at].sum(axis=0)
        return out


def forward_backward(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Marginal probability of each (span, kind); a token outside spans scores 0."""
    total = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        by_end[j].append(k)
        by_start[i].append(k)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[spans[k][0]] + total[k] for k in by_end[j])])
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[spans[k][1]] + total[k] for k in by_start[i])])
    if not spans:
        return np.zeros((0, len(KINDS)))
    ends = np.array(spans)
    inside = alpha[ends[:, 0]] + beta[ends[:, 1]] - alpha[n]
    return np.exp(np.minimum(scores + inside[:, None], 0))


def best_segments(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(span, kind) of the best segmentation of ``n`` tokens."""
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(spans):
        by_end[j].append(k)
    value, back = np.zeros(n + 1), [-1] * (n + 1)
    top = scores.max(axis=1) if len(spans) else scores
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in by_end[j]:
            if value[spans[k][0]] + top[k] > value[j]:
                value[j], back[j] = value[spans[k][0]] + top[k], k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append((back[j], int(scores[back[j]].argmax())))
            j = spans[back[j]][0]
    return out[::-1]


def model_spans(model: Model, text: str, taken: list[Span]) -> list[Span]:
    """Spans of the model that touch none of ``taken``."""
    out: list[Span] = []
    for low, high in windows(text):
        part = text[low:high]
        left = [(a - low, b - low) for _, a, b in taken if a < high and b > low]
        found = candidates(part)
        free = [
            k
            for k, (i, j) in enumerate(found.spans)
            if not any(found.starts[i] < b and found.ends[j - 1] > a for a, b in left)
        ]
        if not free:
            continue
        found.spans = [found.spans[k] for k in free]
        found.features = [found.features[k] for k in free]
        scores = model.scores(found)
        if scores.max() <= 0:
            continue
        sure = forward_backward(len(found.starts), found.spans, scores)
        for k, kind in best_segments(len(found.starts), found.spans, scores):
            if sure[k, kind] >= ACCEPT:
                i, j = found.spans[k]
                out.append((kind, low + found.starts[i], low + found.ends[j - 1]))
    return out


#: Ways to rewrite a base span for training, by kind.
DISGUISES = {
    0: [("@", " at ", ".", " dot "), ("@", " (at) ", ".", " (dot) "), ("@", "[at]", ".", "[dot]"),
        ("@", " @ ", ".", "."), ("@", "(at)", ".", ".")],
    1: [(".", "[.]"), (".", " . "), (".", "(.)")],
    2: [("", "."), ("", "/"), ("", "_")],
    3: [("+", ""), ("+", "00"), ("+", "tel ")],
}


def disguised(kind: int, span: str, pick: int) -> str:
    way = DISGUISES[kind][pick % len(DISGUISES[kind])]
    if kind == 2:
        digits = re.sub("[^0-9]", "", span)
        return way[1].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    for old, new in zip(way[::2], way[1::2], strict=True):
        span = span.replace(old, new)
    return span.strip()


def examples(text: str, most: int) -> list[tuple[str, int, int, int]]:
    """Up to ``most`` windows of a text as (window, kind, start, end): its base span as it is, in
    disguise, or with a wrong digit count (kind -1: nothing to find)."""
    out = []
    spans = base_spans(text)
    for low, high in windows(text):
        part = text[low:high]
        own = [s for s in spans if s[1] < high and s[2] > low]
        if len(part) > 300 or len(own) > 1:
            continue
        if not own:
            out.append((part, -1, 0, 0))
        else:
            kind, a, b = own[0][0], own[0][1] - low, own[0][2] - low
            out.append((part, kind, a, b))
            pick = int.from_bytes(hashlib.md5(part.encode()).digest()[:4], "big")
            other = disguised(kind, part[a:b], pick)
            lead = len(other) - len(other.removeprefix("tel "))
            out.append((part[:a] + other + part[b:], kind, a + lead, a + len(other)))
            digits = re.sub("[^0-9]", "", part[a:b])
            if kind in (2, 3):
                short = digits[: 5 + pick % 2] if kind == 3 else digits[:-1] + str((int(digits[-1]) + 5) % 10)
                out.append((part[:a] + short + part[b:], -1, 0, 0))
        if len(out) >= most:
            break
    return out[:most]


def fit(rows: list[tuple[str, int, int, int]], epochs: int = 4, rate: float = 0.3) -> Model:
    """Maximum conditional likelihood by adaptive gradient steps over the windows."""
    ready, place = [], {}
    for text, kind, a, b in rows:
        found = candidates(text)
        gold = [
            k for k, (i, j) in enumerate(found.spans) if (found.starts[i], found.ends[j - 1]) == (a, b)
        ]
        if kind >= 0 and not gold:
            continue  # no segmentation into tokens gives this span
        for names in found.features:
            for f in names:
                place.setdefault(f, len(place))
        at = [np.array([place[f] for f in names]) for names in found.features]
        ready.append((len(found.starts), found.spans, at, gold[0] if kind >= 0 else -1, kind))
    weights = np.zeros((len(place), len(KINDS)))
    if place:
        weights[place["any"]] = -2.0
    squares = np.full_like(weights, 1e-2)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for r in rng.permutation(len(ready)):
            n, spans, at, gold, kind = ready[r]
            if not spans:
                continue
            scores = np.array([weights[f].sum(axis=0) for f in at])
            gradient = -forward_backward(n, spans, scores)
            if gold >= 0:
                gradient[gold, kind] += 1
            for k in np.flatnonzero(np.abs(gradient).max(axis=1) > 1e-3):
                step = gradient[k] - 1e-4 * weights[at[k]]
                squares[at[k]] += step**2
                weights[at[k]] += rate * step / np.sqrt(squares[at[k]])
    return Model(place, weights)


def train(docs: DataFrame, sample_docs: int = 1500, windows_each: int = 3) -> Model:
    """The model from at most about ``sample_docs`` documents with an anchor, taken by hash, and
    ``windows_each`` windows of each."""
    near = docs.filter(F.col("text").rlike(ANCHOR.pattern)).select("text")
    share = min(1.0, sample_docs / max(near.count(), 1))
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = near.filter(lot < share)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches, "text"):
            rows = [e for t in batch.column(0).to_pylist() for e in examples(t, windows_each)]
            data = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(c, k) for c, k in zip(data, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["window", "kind", "a", "b"])

    rows = sample.mapInArrow(collect, "window string, kind int, a int, b int").collect()
    return fit(sorted((r["window"], r["kind"], r["a"], r["b"]) for r in rows))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of ``docs``.

    Counts and base_sha256 are those of the base spans; ``spans`` lists these and the model's,
    none of which touches a base span. Null text is empty.
    """
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    kind = source.schema[id_column].dataType.simpleString()
    received = sent(source.sparkSession, model)
    names = [id_column, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model,), nothing = received(), hashlib.sha256(b"").hexdigest()
        for batch in short_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(*columns_of(batch, id_column, "text"), strict=True):
                if text is None or ANCHOR.search(text) is None:
                    rows.append((doc_id, 0, 0, 0, 0, nothing, "", 0))
                    continue
                base = base_spans(text)
                added = model_spans(model, text, base)
                n = [sum(s[0] == k for s in base) for k in range(4)]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc_id, *n, digest, listed(base + added), len(added)))
            data = list(zip(*rows, strict=True))
            typed = zip(data, [kind_of(batch, id_column), *kinds], strict=True)
            arrays = [pa.array(c, k) for c, k in typed]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = ", ".join(f"n_{k} long" for k in KINDS)
    return source.mapInArrow(
        find, f"`{id_column}` {kind}, {fields}, base_sha256 string, spans string, n_added long"
    )
