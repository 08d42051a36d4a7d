"""Stretches of a text that reappear inside it at a constant displacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.columns import indexes, let, ngrams


def displaced_repeats(
    df: DataFrame,
    min_matches: int = 6,
    min_shift: int = 8,
    n: int = 5,
    min_density: float = 0.15,
    top: int = 3,
    canonical: str = "canonical",
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc, shift, pairs, source_start, span, density, rank) from matching word n-grams.

    Each occurrence of an n-gram is paired with the previous occurrence of the same n-gram, so a
    gram that occurs m times gives m-1 pairs, not m*m, and no gram has to be left out. Sorting
    (gram, position) inside the row puts those neighbours side by side: no shuffle.
    """

    def shifts(s: Column) -> Column:
        pairs = F.filter(
            indexes(F.size(s)),
            lambda i: (i > 0)
            & (F.get(s, i)["g"] == F.get(s, i - 1)["g"])
            & (F.get(s, i)["p"] - F.get(s, i - 1)["p"] >= min_shift),
        )
        return F.sort_array(
            F.transform(
                pairs,
                lambda i: F.struct(
                    (F.get(s, i)["p"] - F.get(s, i - 1)["p"]).alias("shift"),
                    F.get(s, i - 1)["p"].alias("source"),
                ),
            )
        )

    def groups(s: Column) -> Column:
        starts = F.filter(
            indexes(F.size(s)),
            lambda i: (i == 0) | (F.get(s, i)["shift"] != F.get(s, i - 1)["shift"]),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, j: let(
                    F.coalesce(F.get(b, j + 1), F.size(s)),
                    lambda end: F.struct(
                        (at - end).alias("neg_pairs"),
                        F.get(s, at)["shift"].alias("shift"),
                        F.get(s, at)["source"].alias("lo"),
                        (F.get(s, end - 1)["source"] - F.get(s, at)["source"] + n).alias("span"),
                    ),
                ),
            ),
        )

    grams = F.sort_array(
        F.transform(
            ngrams(F.split(F.col(canonical), " "), n),
            lambda g, i: F.struct(g.alias("g"), i.alias("p")),
        )
    )
    found = F.filter(
        let(let(grams, shifts), groups),
        lambda r: (r["neg_pairs"] <= -min_matches)
        & (-r["neg_pairs"] / r["span"] >= min_density),
    )
    best = F.slice(F.sort_array(found), 1, top)
    return (
        df.select(id_col, F.posexplode_outer(best).alias("rank", "r"))
        .filter(F.col("r").isNotNull())
        .select(
            id_col,
            F.col("r.shift").alias("shift"),
            (-F.col("r.neg_pairs")).alias("pairs"),
            F.col("r.lo").alias("source_start"),
            F.col("r.span").alias("span"),
            (F.floor(-F.col("r.neg_pairs") / F.col("r.span") * 1000 + 0.5) / 1000).alias("density"),
            (F.col("rank") + 1).alias("rank"),
        )
    )
