"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    The optimizer may inline a projected column into every place that reads it, also into a
    lambda that runs once per element. A lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(size: Column) -> Column:
    """0 .. size-1, empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of ``n`` tokens; empty when there are fewer than ``n``.

    Reads elements by position: ``slice`` would copy the whole array once per window.
    """
    return let(
        tokens,
        lambda w: F.transform(
            indexes(F.size(w) - (n - 1)),
            lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]),
        ),
    )


def count_runs(tokens: Column) -> Column:
    """Counts per distinct token inside one row: array of (neg_n, pos, token), best first.

    Sort once, read run lengths off the sorted array, sort the runs: no shuffle, n log n.
    Ties keep the order of first appearance.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            indexes(F.size(s)),
            lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, j: F.struct(
                    (at - F.coalesce(F.get(b, j + 1), F.size(s))).alias("neg_n"),
                    F.get(s, at)["pos"].alias("pos"),
                    F.get(s, at)["token"].alias("token"),
                ),
            ),
        )

    ordered = F.sort_array(
        F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    )
    return F.sort_array(let(ordered, runs))


def first_by_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element per key of an array that is already in preference order."""

    def keep(s: Column) -> Column:
        firsts = F.filter(
            s, lambda x, i: (i == 0) | (x["key"] != F.get(s, i - 1)["key"])
        )
        return F.transform(
            F.sort_array(F.transform(firsts, lambda x: F.struct(x["pos"], x["item"]))),
            lambda x: x["item"],
        )

    keyed = F.sort_array(
        F.transform(
            items,
            lambda x, i: F.struct(key(x).alias("key"), i.alias("pos"), x.alias("item")),
        )
    )
    return let(keyed, keep)


def rounded(value: Column, digits: int) -> Column:
    """Round half up on the binary value, the same arithmetic in every engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def ratio(part: Column, whole: Column, digits: int) -> Column:
    return F.when(whole > 0, rounded(part / whole, digits)).otherwise(F.lit(0.0))
