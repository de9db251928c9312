"""Links between texts whose sets of word shingles are nearly equal.

Candidates share one of ``BANDS`` keys made of ``ROWS`` minima each of the shingles' hashes, which texts of Jaccard
similarity s do with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8. Each link is verified by the
shingles themselves, so none is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import cut
from .common import connected, hand_back
from .line_dedup import need
from .simhash import roots

BANDS, ROWS = 20, 5
#: Members of one key that meet in a task, and rows of such a task on average.
BLOCK_ROWS = 256
SHARD_ROWS = 1024
#: Shingles whose minima are taken in one step.
STEP = 4096

_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)
_FOLD = _RNG.integers(1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(0)), dtype="<u8"))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band; texts without words share all."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for s in range(0, len(h), STEP):
        np.minimum(low, (h[s:s + STEP] * _MUL + _ADD).min(axis=1), out=low)
    return (low.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """``node_id, same, keys`` of ``texts(node_id, text)``: a hash of the whole set, and the keys of the bands."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column("text")]
            same = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype="<u8").view("<i8")
            keys = np.concatenate([np.zeros(0, dtype="<u8"), *map(band_keys, sets)]).view("<i8")
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.array(same, pa.int64()), keys], names=["node_id", "same", "keys"])
            del sets, same, keys
        hand_back()

    return texts.select("node_id", "text").mapInArrow(run, "node_id long, same long, keys array<long>")


def sets_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, s``: the shingle hashes of the texts named by ``nodes(node)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width).view("<i8") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])
            del sets
        hand_back()

    return texts.select(F.col("node_id").alias("node"), "text").join(nodes, "node", "left_semi").mapInArrow(run, "node long, s array<long>")


def alike(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets reach the similarity."""
    p = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    na, nb = F.size("sa"), F.size("sb")
    size: Column = (na >= nb * F.lit(t) - 1e-9) & (nb >= na * F.lit(t) - 1e-9)
    return p.filter(size & (F.size(F.array_intersect("sa", "sb")) >= need(na, nb, t))).select("a", "b")


def block_links(sets: list[np.ndarray], node: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text to the smallest one of its group; every pair of ``sets`` is compared."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(word), dtype=bool)
    a, b = [], []
    for i in range(n - 1):
        own = word[start[i]:start[i + 1]]
        mark[own] = True
        run = np.concatenate([[0], np.cumsum(mark[word[start[i + 1]:]])])
        common = run[start[i + 2:] - start[i + 1]] - run[start[i + 1:-1] - start[i + 1]]
        mark[own] = False
        hit = np.flatnonzero(common >= np.ceil((size[i] + size[i + 1:]) * (t / (1 + t)) - 1e-9)) + i + 1
        a.append(np.full(len(hit), i))
        b.append(hit)
    order = np.argsort(node, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    r = roots(n, place[np.concatenate([*a, []]).astype(np.int64)], place[np.concatenate([*b, []]).astype(np.int64)])
    far = np.flatnonzero(r != np.arange(n))
    return node[order[far]], node[order[r[far]]]


def block_pairs(members: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Links (a, b) among the ``members(key, node)`` of each key; a large key is dealt to pairs of blocks."""
    size = members.groupBy("key").agg(F.count("*").alias("c"))
    m = members.join(size, "key").withColumn("parts", F.ceil(F.col("c") / BLOCK_ROWS).cast("int"))
    m = m.withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = cut(m.select("node", "key", F.least("i", "other").alias("lo"), F.greatest("i", "other").alias("hi")))
    shard = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(1, -(-m.count() // SHARD_ROWS))))

    def compare(table: pa.Table) -> pa.Table:
        at: dict[tuple, list[int]] = {}
        for k, x in enumerate(zip(*(table.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True)):
            at.setdefault(x, []).append(k)
        node, s = table.column("node").to_numpy(), table.column("s").combine_chunks()
        flat, off = s.values.to_numpy(), s.offsets.to_numpy()
        found = [block_links([flat[off[k]:off[k + 1]] for k in rows], node[rows], t) for rows in at.values() if len(rows) > 1]
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*found, strict=True) if found else ([], [])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return m.join(sets, "node").select("key", "lo", "hi", "node", "s", shard.alias("shard")).groupBy("shard").applyInArrow(compare, "a long, b long")


def near_copies(texts: DataFrame, width: int = 5, t: float = 0.8) -> DataFrame:
    """``node_id, root`` of every row of ``texts(node_id, text)`` that is linked to a smaller id: ``root`` is the smallest that links reach.

    Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at least ``t`` and they are
    candidates (see above). Words are those of ``simhash_groups``; texts without words are all alike. Rows
    without an id are left out. Texts of equal sets are one node. The members of a key are compared with the
    smallest of them first, which settles large groups without their pairs; keys whose members are then in
    different groups are compared pair by pair in blocks of bounded size.
    """
    texts = texts.filter(F.col("node_id").isNotNull())
    sig = cut(signatures(texts, width))
    one = cut(sig.groupBy("same").agg(F.min("node_id").alias("node"), F.first("keys").alias("keys")))
    band = one.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    full = band.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("c > 1")
    # keys of the same members are one
    full = full.groupBy("c", "low", "who").agg(F.min("key").alias("key")).select("key", "low")
    band = cut(band.join(full, "key"))
    sets = cut(sets_of(texts, band.select("node").distinct(), width))
    links = cut(alike(band.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), sets, t))
    tree = cut(connected(links))
    group = band.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = group.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).filter("x <> y and c > 2").select("key")
    rest = block_pairs(group.join(split, "key", "left_semi").select("key", "node"), sets, t)
    tree = connected(links.union(rest))
    rooted = sig.join(one.select("same", "node"), "same").join(tree, "node", "left")
    return rooted.select("node_id", F.coalesce("root", "node").alias("root")).filter("node_id <> root")
