import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG = " ".join(f"word{k % 977} und{k % 13}," for k in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, a null id, and clashing extra columns."""
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one"), (6, "The cat sat, on the mat."),
        (6, "The cat sat, on the mat."), (7, "The cat sat, on the mat."), (None, "No id here at all."),
        (8, "x" * 50_000), (9, "a\n" * 2000), (10, "Über Äpfel, où ça? 你好 <|endoftext|> a@b.example.com"),
    ]
    extra = ["stats", "token", "node", "words", "row", "h", "component_id", "kept", "_group", "mark"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, name in enumerate(extra):
        docs = docs.selectExpr("*", f"{k} AS `{name}`")
    return docs.selectExpr(
        "*", "'en' AS lang", "IF(doc_id = 4, null, 'a/test') AS source", "1L AS n_chars"
    )


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1), (4, None), (6, 0), (None, 0)], "doc_id long, quality int"
    )
