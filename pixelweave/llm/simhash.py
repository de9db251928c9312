"""SimHash fingerprints of text outputs, and groups of texts whose fingerprints nearly agree."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut
from .common import connected

#: Rows of one comparison task on average, and the most members of one key that meet in it.
SHARD_ROWS = 4096
BLOCK_ROWS = 1024


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """64 bits: each is set if it is set in more than half of the shingles' XXH64 hashes."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, len(h), 65536):
        ones += np.unpackbits(h[s:s + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(texts: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fingerprint`` (long, the 64 bits) to ``texts(node_id, text)``; the text itself is left behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width, seed) for t in b.column("text")], dtype="<u8")
            yield pa.RecordBatch.from_arrays([b.column("node_id"), pa.array(fp.view("<i8"), pa.int64())], names=["node_id", "fingerprint"])

    t = texts.select("node_id", "text")
    return t.mapInArrow(run, f"node_id {t.schema['node_id'].dataType.simpleString()}, fingerprint long")


def near_pairs(prints: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), first[i] <= j < last[i], j < i, whose prints differ in ``radius`` bits or fewer.

    Bit-sliced: plane b holds bit b of 64 prints a word. A block is one print against one word; its
    64 distances are counted at once in carry-save counters, and it is left as soon as all
    of them have passed the radius.
    """
    n = len(prints)
    words = -(-n // 64)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, words * 64), dtype=np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
    stop = np.minimum(last, np.arange(n))  # only earlier lanes
    lo, hi = first >> 6, (stop + 63) >> 6
    many = np.where(stop > first, hi - lo, 0)
    probe = np.repeat(np.arange(n), many)
    word = np.arange(len(probe)) - np.repeat(np.cumsum(many) - many, many) + lo[probe]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    depth = max(1, (radius + 1).bit_length())
    width = 1 << depth  # counters hold 0 .. width - 1; they start so that radius + 1 overflows
    begin = width - radius - 1
    count = [np.full(len(probe), full if begin >> k & 1 else 0, dtype=np.uint64) for k in range(depth)]
    over = np.zeros(len(probe), dtype=np.uint64)
    # lanes outside the print's own range count as passed
    a = np.clip(first[probe] - word * 64, 0, 64)
    z = np.clip(stop[probe] - word * 64, 0, 64)
    below = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)
    over |= ~(below[z] & ~below[a])
    for b in range(64):
        carry = planes[b, word] ^ np.where(bits[probe, b].astype(bool), full, np.uint64(0))
        for k in range(depth):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 4 == 3 or b == 63:
            live = over != full
            if not live.all():
                probe, word, over, count = probe[live], word[live], over[live], [c[live] for c in count]
            if not len(probe):
                break
    if not len(probe):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    row, lane = np.nonzero(hit)
    return probe[row], word[row] * 64 + lane


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, by repeated minima and jumps."""
    r = np.arange(n)
    while len(a):
        low = np.minimum(r[a], r[b])
        new = r.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, r[end], low)
        new = new[new]
        if (new == r).all():
            break
        r = new
    return r


def near_links(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) that join all of ``prints(fingerprint, node)`` within ``radius`` bits, not all their pairs.

    The 64 bits are cut into ``blocks`` parts; prints within the radius agree on at least
    ``blocks - radius`` of them, so every choice of that many parts is a key. The members of a key are
    compared in blocks of bounded size (a large key is dealt to pairs of blocks), and a block returns
    only the links of its own groups to their smallest node.
    """
    edge = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for c in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edge[k + 1]) - (1 << edge[k])) for k in c)
        keys.append(F.xxhash64(F.lit(len(keys)), F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    t = prints.select("fingerprint", "node", F.explode(F.array(*keys)).alias("key"))
    size = t.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    total = size.agg(F.sum("c")).first()[0] or 0
    t = t.join(size, "key").withColumn("parts", F.ceil(F.col("c") / BLOCK_ROWS).cast("int"))
    t = t.withColumn("i", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = t.select("fingerprint", "node", "key", F.least("i", "other").alias("lo"), F.greatest("i", "other").alias("hi"))
    t = t.withColumn("shard", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(1, -(-total // SHARD_ROWS)))))

    def compare(table: pa.Table) -> pa.Table:
        lo, hi, key = (table.column(c).to_numpy() for c in ("lo", "hi", "key"))
        node, fp = table.column("node").to_numpy(), table.column("fingerprint").to_numpy()
        order = np.lexsort((node, hi, lo, key))
        lo, hi, key, node, fp = lo[order], hi[order], key[order], node[order], fp[order]
        n = len(key)
        head = np.ones(n, dtype=bool)
        head[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        start = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        i, j = near_pairs(fp.view("<u8"), start[group], np.append(start[1:], n)[group], radius)
        r = roots(n, i, j)
        far = np.flatnonzero(r != np.arange(n))
        return pa.table({"a": pa.array(node[far], pa.int64()), "b": pa.array(node[r[far]], pa.int64())})

    return t.groupBy("shard").applyInArrow(compare, "a long, b long")


def simhash_groups(texts: DataFrame, width: int = 3, seed: int = 42, radius: int = 2, blocks: int = 4) -> DataFrame:
    """``node_id, fingerprint, component_id`` for every row of ``texts(node_id, text)``.

    A text's words (runs of anything but ASCII white space, A-Z lower-cased) give shingles of ``width`` words; a text
    of fewer words is one shingle, one without words has fingerprint zero and is linked like any
    other. Fingerprints that differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest
    ``node_id`` that links reach. ``fingerprint`` is 16 lowercase hex digits.

    ``node_id`` is a long. Equal fingerprints are one node of the graph, so copies cost a row each
    and no pair. Null texts are empty; rows with a null id get a fingerprint and their group's id, but
    name no group unless it has no other id; repeated rows give repeated rows; an empty table
    gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(texts, width, seed))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("node_id").alias("first")).withColumn("node", F.coalesce("first", F.xxhash64("fingerprint"))))
    tree = connected(near_links(nodes, radius, blocks))
    named = nodes.join(tree.withColumnRenamed("root", "_root"), "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    low = F.min("first").over(Window.partitionBy("_root"))
    named = named.select("fingerprint", low.alias("component_id"))
    hex16 = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return prints.join(named, "fingerprint").select("node_id", hex16.alias("fingerprint"), "component_id")
