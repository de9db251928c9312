"""Which of several text filters removes which texts, in every order, and what each filter is worth."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import cut

#: Failure conditions over the columns of ``text_facts``. A name is one character.
FILTERS = {
    "A": "words < 200",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * capitals > 2 * chars",
    "D": "marks > 0",
    "E": "repeated",
}
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"

#: Texts that hold more than one in so many rows are fewer than so many, and are joined by broadcast.
HOT = 1024


def measure(texts: DataFrame) -> DataFrame:
    """``node_id, node_type, words, distinct_words, capitals, chars, marks, digest`` of every whole text (null: empty).

    A word is a run of bytes that are no ASCII white space, so splitting the bytes is exact; ``digest`` is SHA-256.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in b.column("text"):
                text = text.as_py() or ""
                data = text.encode()
                words = data.split()
                facts = (len(words), len(set(words)), len(data) - len(data.translate(None, CAPITALS)), len(text),
                         len(data) - len(data.translate(None, MARKS)), hashlib.sha256(data).digest())
                for column, v in zip(out, facts):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column("node_id"), b.column("node_type"), *[pa.array(x, pa.int64()) for x in out[:5]], pa.array(out[5], pa.binary())],
                                             names=["node_id", "node_type", "words", "distinct_words", "capitals", "chars", "marks", "digest"])

    t = texts.select("node_id", "node_type", "text")
    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for c in ("node_id", "node_type")]
    return t.mapInArrow(run, ", ".join([*kinds, "words long, distinct_words long, capitals long, chars long, marks long, digest binary"]))


def text_facts(texts: DataFrame) -> DataFrame:
    """``measure`` plus ``repeated``: whether a row with a smaller ``node_id`` holds the same text.

    Only texts that occur twice are joined back. A text that fills more than one row in ``HOT`` has fewer than
    ``HOT`` others like it, so those few travel by broadcast, and no key of the shuffled join holds
    more than that part of the rows. Rows without an id are never repeated and repeat nothing.
    """
    t = cut(measure(texts))
    copies = t.groupBy("digest").agg(F.min("node_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    copies = cut(copies)
    often = F.col("_n") * F.lit(HOT) > F.lit(t.count())
    hot = copies.filter(often).select(F.col("digest").alias("_d"), F.col("_first").alias("_f"))
    t = t.join(F.broadcast(hot), F.col("digest") == F.col("_d"), "left")
    rare = t.filter("_d is null").drop("_f").join(copies.filter(~often).select("digest", F.col("_first").alias("_f")), "digest", "left")
    every = rare.unionByName(t.filter("_d is not null"))
    return every.withColumn("repeated", F.coalesce(F.col("_f") < F.col("node_id"), F.lit(False))).drop("_d", "_f", "digest")


def shapley_rows(n: int) -> list[list[int]]:
    """Integers m with sum over S of m[i][S] * v(S) = n! times the Shapley value of player i, for any game v with v(empty) = 0.

    The least squares fit of an additive game to v, weighted by (n - 1) / (C(n, s) s (n - s)) over the
    proper coalitions and bound to share out v(all) exactly, has the Shapley value as its solution. Its normal
    equations with the multiplier of the bound are eliminated once in rationals; every right-hand side is a sum over S.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    rows: list[list[Fraction]] = []
    for i in range(n):  # sum_j A[i][j] phi[j] + mu = sum_S w(S) [i in S] v(S)
        left = [sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        right = [weight.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(full + 1)]
        rows.append([*left, Fraction(1), *right])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == full)) for s in range(full + 1)])
    for i in range(n + 1):
        pivot = next(k for k in range(i, n + 1) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n + 1):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i])]
    out = [[x * factorial(n) for x in row[n + 1:]] for row in rows[:n]]
    scale = lcm(*[x.denominator for row in out for x in row])
    assert scale == 1, "n! times the weights of a Shapley value are whole numbers"
    return [[int(x) for x in row] for row in out]


def audit_filters(texts: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """What every filter removes at every place of every order, one row per node type, order and step.

    ``texts(node_id, node_type, text)`` are text outputs of nodes, ``labels(node_id, quality, toxic)`` marks some of
    them, ``filters`` names conditions over the columns of ``text_facts`` under which a text fails.
    Columns: ``node_type`` (null stays null), ``filter_order``, ``step`` (from 1), ``kept``, ``removed``, ``redundant`` (fails this
    filter, removed before), ``unique_fails`` (fails this filter only), ``good_lost`` and ``toxic_lost`` (removed here, with that
    label 1), ``shapley`` (removed by the step's filter, summed over all orders). Zeros are rows too.

    Every text is measured once and becomes a set of failed filters. For each type the removals of all coalitions of
    filters are tabulated from the counts of those sets, at most 2 ** n; every step is a difference of two coalitions, and
    Shapley values are the exact solution of ``shapley_rows``. Only such counts are grouped, so a type that
    holds most texts is no bottleneck.

    Null texts are empty; null ids have no label and repeat nothing; several labels of one id count as their
    greatest; repeated rows count each, and are no copies of each other; an empty table gives no rows; other columns are ignored.
    """
    filters = FILTERS if filters is None else filters
    names, n = "".join(filters), len(filters)
    if not 1 < n < 7 or len(names) != n or len(set(names)) != n:
        raise ValueError("two to six filters, each named by one character")
    facts = text_facts(texts.select("node_id", "node_type", "text"))
    failed = sum((F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    facts = cut(facts.select("node_id", "node_type", failed.cast("int").alias("failed")))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    marked = labels.filter("node_id is not null").groupBy(F.col("node_id").alias("_id")).agg(one("quality"), one("toxic"))
    known = facts.filter("node_id is not null").join(marked, F.col("node_id") == F.col("_id"), "left").select("node_type", "failed", "_quality", "_toxic")
    zero = F.lit(0)
    known = known.unionByName(facts.filter("node_id is null").select("node_type", "failed", zero.alias("_quality"), zero.alias("_toxic")))
    cells = known.groupBy("node_type", "failed").agg(F.count("*").alias("all"), F.coalesce(F.sum("_quality"), zero).alias("good"), F.coalesce(F.sum("_toxic"), zero).alias("toxic"))
    types = cells.groupBy("node_type").agg(F.sum("all").alias("_total"), F.collect_list(F.struct("failed", "all", "good", "toxic")).alias("_cells"))

    def gone(measure: str) -> Column:
        """The number that each coalition removes, by the coalition's bits."""
        def of(s: Column) -> Column:
            return F.aggregate("_cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["failed"].bitwiseAND(s) != 0, c[measure]).otherwise(F.lit(0).cast("long")))

        return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), of)

    t = types.withColumns({f"_v_{m}": gone(m) for m in ("all", "good", "toxic")})

    def value(row: list[int]) -> Column:
        return F.aggregate(F.zip_with("_v_all", F.lit(row).cast("array<bigint>"), lambda v, m: v * m), F.lit(0).cast("long"), lambda a, x: a + x)

    t = t.withColumn("_shapley", F.array(*[value(r) for r in shapley_rows(n)]))
    steps = [{"filter_order": o, "step": k + 1, "before": sum(1 << names.index(x) for x in o[:k]), "own": names.index(o[k])}
             for o in map("".join, permutations(names)) for k in range(n)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, own int>>")
    t = t.select("*", F.inline(steps)).withColumn("_bit", F.pow(F.lit(2), F.col("own")).cast("int"))
    after, everyone = F.col("before") + F.col("_bit"), F.lit((1 << n) - 1)
    at = lambda m, s: F.get(F.col(f"_v_{m}"), s)
    removed = at("all", after) - at("all", F.col("before"))
    return t.select(
        "node_type", "filter_order", "step", (F.col("_total") - at("all", after)).alias("kept"), removed.alias("removed"),
        (at("all", F.col("_bit")) - removed).alias("redundant"), (at("all", everyone) - at("all", everyone - F.col("_bit"))).alias("unique_fails"),
        (at("good", after) - at("good", F.col("before"))).alias("good_lost"), (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"),
        F.get(F.col("_shapley"), F.col("own")).alias("shapley"))
