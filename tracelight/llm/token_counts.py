"""Token counts (operator 7): pieces counted once per distinct pre-token.

A byte-level tokenizer cuts a text into pre-tokens and merges bytes within each. The number of
pieces of a pre-token depends on nothing else, so each distinct one is encoded once; a document's
count is the sum over its pre-tokens. No id is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import per_process, ship, stored
from tracelight.llm.token_sums import count_tokens, sum_values

ship(__name__)

#: The split pattern of byte-level vocabularies (fixed value), for ASCII and Latin letters.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACE = r"\t-\r \x85\xa0"
PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LATIN}{NUMBERS}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Characters for which PRE_TOKEN is the tokenizer's own split; other texts go through the library.
BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def splitter(name: str) -> Callable[[str], list[bytes]]:
    """split(text): its pre-tokens as UTF-8; an added special string is a token of its own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = per_process(
        f"tokenizer:{name}", lambda: Tokenizer.from_file(public_tokenizers.path(name))
    )
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pre_tokens(text: str) -> list[bytes]:
        if BEYOND.search(text) is None:
            return [t.encode() for t in PRE_TOKEN.findall(text)]
        spans = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b].encode() for _, (a, b) in spans]

    def split(text: str) -> list[bytes]:
        if cut is None or not any(s in text for s in special):
            return pre_tokens(text)
        out: list[bytes] = []
        for k, part in enumerate(cut.split(text)):
            if k % 2:
                out.append(part.encode())
            elif part:
                out += pre_tokens(part)
        return out

    return split


def piece_counts(tokens: DataFrame, name: str) -> DataFrame:
    """``tokens`` (token, ...) with ``pieces``: how many ids the tokenizer gives each one."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = per_process(
            f"tokenizer:{name}", lambda: Tokenizer.from_file(public_tokenizers.path(name))
        )
        encode = tokenizer.encode
        for batch in batches:
            texts = [t.decode() for t in batch.column(0).to_pylist()]
            n = [float(len(encode(t, add_special_tokens=False))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.float64())],
                names=["token", "n_docs", "pieces"],
            )

    return tokens.select("token", "n_docs").mapInArrow(
        measure, "token binary, n_docs long, pieces double"
    )


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
    hot_tokens: int = 200_000,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; null text is empty.

    ``tokenizer`` names a byte-level file whose count of a text is the sum over its pre-tokens.
    Rows that share an id are one document. Columns beside id and text are not looked at.
    """
    source = docs.select(
        F.col(id_column), F.col(text_column).alias("text"), F.lit(False).alias("train")
    )

    def make() -> Callable[[str], list[bytes]]:
        return splitter(tokenizer)

    values = stored(piece_counts(count_tokens(source, make), tokenizer))
    sums = sum_values(source, make, values, ["pieces"], id_column, hot_tokens)
    n_tokens = F.round("pieces").cast("long")
    return sums.select(
        id_column, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
