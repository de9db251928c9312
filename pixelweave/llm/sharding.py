"""A reproducible shuffle of texts into shards, from which a row's place can be computed and its row found again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut

ROUNDS = 6
#: The multipliers of a 32-bit mixing step.
MIX = (0x85EBCA6B, 0xC2B2AE35)
WORD = (1 << 32) - 1


def mixed(x: int) -> int:
    """``scramble`` of one number."""
    x = (x ^ x >> 16) * MIX[0] & WORD
    x = (x ^ x >> 13) * MIX[1] & WORD
    return x ^ x >> 16


def round_keys(seed: int) -> list[int]:
    """One 32-bit key a round, from the seed alone."""
    return [mixed((mixed(seed & WORD) + k * 0x9E3779B9) & WORD) for k in range(1, ROUNDS + 1)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A 32-bit mixing of each number of an unsigned 64-bit array."""
    m, w = [np.uint64(v) for v in MIX], np.uint64(WORD)
    x = (x ^ x >> np.uint64(16)) * m[0] & w
    x = (x ^ x >> np.uint64(13)) * m[1] & w
    return x ^ x >> np.uint64(16)


def half_bits(n: int) -> int:
    """Bits of either half of the smallest even block of bits that counts up to ``n`` rows."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    """One pass of the Feistel network over ``2 * half`` bits: a permutation, whatever the mixing is. Keys in reverse undo it."""
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> h, x & mask
    for k in keys:
        left, right = right, left ^ scramble(right + np.uint64(k) & np.uint64(WORD)) & mask
    return right << h | left  # halves swapped, so that reversed keys run backwards


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A permutation of 0 .. n - 1 (``back``: its inverse): values that leave the range walk on until they are back in it.

    The block holds less than four times ``n`` numbers, so a walk takes four steps at most on average.
    """
    half, keys = half_bits(n), round_keys(seed)
    if half > 32:
        raise ValueError("more than 2 ** 64 rows")
    keys = keys[::-1] if back else keys
    out = feistel(x.astype(np.uint64), half, keys)
    while (away := np.flatnonzero(out >= np.uint64(n))).size:
        out[away] = feistel(out[away], half, keys)
    return out


def place_of(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers among ``n`` rows."""
    p = permute(row, n, seed)
    return (p % np.uint64(shards)).astype(np.int32), (p // np.uint64(shards)).astype(np.int64)


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The global row number at a shard's slot: what ``place_of`` sends there."""
    return permute(slot.astype(np.uint64) * np.uint64(shards) + shard.astype(np.uint64), n, seed, back=True).astype(np.int64)


def in_ranges(t: DataFrame, order: list[str]) -> DataFrame:
    """The rows written in ranges of ``order``, with ``_part``, the range, and ``_in``, the row's place in it.

    Rows equal in ``order`` are told apart by their place in the input, so they may lie in several ranges; which of them comes
    first is open.
    """
    tied = t.withColumn("_tie", F.monotonically_increasing_id())
    parts = max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), t.rdd.getNumPartitions())
    ranges = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    local = F.monotonically_increasing_id()
    return cut(ranges.withColumns({"_part": F.shiftright(local, 33), "_in": local.bitwiseAND((1 << 33) - 1)}))


def number_rows(t: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """Adds ``out``, the place of each row in the order of the columns ``order``, and tells the number of rows.

    Every range numbers its own rows; the ranges' sizes, one number each, are summed up.
    """
    rows = in_ranges(t, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut(sizes.select("_part", before.alias("_before"), "_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    return rows.join(F.broadcast(sizes.drop("_n")), "_part").withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before"), total


def assign_shards(texts: DataFrame, shards: int = 24, seed: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deals ``texts(node_id, text)`` out to shards 0 .. ``shards`` - 1, at most one text more in one than in another.

    One row per text: ``node_id, size, text_crc32, row_no, shard, slot`` and the columns named in ``carry``. ``size`` is the number of
    UTF-8 bytes of the text (null: none) plus 8, ``text_crc32`` the CRC-32 of those bytes. Texts are numbered by (node_id, crc, hash
    of the text), nulls first; the number goes through a keyed Feistel permutation of 0 .. rows - 1, and the result p lies in shard
    p mod ``shards`` at slot p div ``shards``, so slots have no gaps. The same rows give the same places
    at any number of partitions; ``row_at`` finds the row number of any slot without a search.

    Rows equal in id and text are interchangeable, so a third of all rows may be one text. Without ``carry`` no text is
    shuffled. Null texts are empty; null ids are ids like any other; an empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = [c for c in carry if c not in ("node_id", "size", "text_crc32", "row_no", "shard", "slot")]
    t = texts.select("node_id", *extra, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    if not extra:
        t = cut(t)  # the range bounds are sampled from it, so texts are read once
    t, n = number_rows(t, ["node_id", "text_crc32", "_hash"], "row_no")
    t = t.drop("_hash")
    if n == 0:
        return t.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    return t.mapInArrow(_placed(n, shards, seed), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema] + ["shard int", "slot long"]))


def _placed(n: int, shards: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, slot = place_of(b.column("row_no").to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(slot)], names=[*b.schema.names, "shard", "slot"])

    return run


def write_shards(texts: DataFrame, path: str, shards: int = 24, seed: int = 1, files_per_shard: int = 1) -> None:
    """Writes the texts as Parquet, one folder ``shard=k`` per shard, each file a run of slots in order.

    Files are ranges of (shard, slot), so large shards become several files without a task that
    holds a whole one.
    """
    t = assign_shards(texts, shards, seed, tuple(texts.columns))
    t = t.repartitionByRange(shards * files_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot")
    t.write.partitionBy("shard").parquet(path)
