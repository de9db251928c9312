"""Packing tokenized text outputs into sequences of fixed length, planned over lengths only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import cut
from .common import hand_back, prefix_sums

PIECES = "node_id {id}, piece int, start long, length long, ids_crc32 long"


class Tokens:
    """Ids of texts by a byte-level BPE given as a tokenizer file.

    The same vocabulary as ranks gives the same ids several times faster; texts that name one of the
    ``special`` tokens go to the tokenizer itself, which alone knows how it reads them and is loaded at the first such text.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, special: list[str]):
        self.file, self.special, self.slow, self.fast = tokenizer, special, None, None
        if ranks is not None:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut_pieces(texts: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, end_id: int, size: int) -> DataFrame:
    """``node_id, piece, start, length, ids_crc32`` of every text: its ids, then ``end_id``.

    A text of more than ``size`` ids is cut from its end into whole pieces, so only its first piece may be
    shorter. The checksum is CRC-32 over the ids as little-endian unsigned 32-bit numbers.
    """
    from tokenizers import Tokenizer

    special = [t.content for t in Tokenizer.from_file(tokenizer).get_added_tokens_decoder().values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokens(tokenizer, ranks, pattern, special)
        for b in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for k, text in enumerate(b.column("text")):
                ids = np.array([*tok.ids(text.as_py() or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % size + 1
                bounds = [0, *range(first, len(ids) + 1, size)]
                for n, (s, e) in enumerate(zip(bounds, bounds[1:])):
                    for col, v in zip(rows, (k, n, s, e - s, zlib.crc32(ids[s:e].tobytes()))):
                        col.append(v)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("node_id").take(at), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:]]],
                                             names=["node_id", "piece", "start", "length", "ids_crc32"])
        del tok
        hand_back()

    t = texts.select("node_id", "text")
    return t.mapInArrow(run, PIECES.format(id=t.schema["node_id"].dataType.simpleString()))


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over a histogram: runs (length, rank, n, sequence, offset).

    The n pieces of a length whose ranks start at ``rank`` go to n sequences from ``sequence`` on, each at
    ``offset``. Sequences filled alike are one interval, so the work depends on ``size``, not on how many
    pieces there are: a length either takes a whole interval or splits one.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> intervals (first sequence, how many)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fits = sorted(r for r in room if r >= length)
        while left:
            if fits:
                r = fits[0]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    fits.pop(0)
            else:
                r, first, n = size, opened, -(-left // (size // length))
                opened += n
            take = min(left, n)
            runs.append((length, rank, take, first, size - r))
            rank, left = rank + take, left - take
            for space, start, many in ((r - length, first, take), (r, first + take, n - take)):
                if many and space:
                    if space >= length and space not in fits:
                        fits = sorted([*fits, space])
                    room.setdefault(space, []).append((start, many))
    return runs


def pack_texts(texts: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 2, size: int = 1024) -> DataFrame:
    """Places the tokens of ``texts(node_id, text)`` in as few sequences of ``size`` as best fit finds.

    One row per piece: ``node_id, piece, start, length, ids_crc32, sequence_id, offset``; a sequence
    is filled without gaps from 0 on. The texts are tokenized once. Only the histogram of piece lengths, at most
    ``size`` numbers, is planned with; each piece then takes the slot of its rank within its length.
    Ranks are distributed prefix sums, so a length shared by a third of all pieces is no bottleneck.
    The plan has fewer rows than ``size`` squared and is broadcast.

    Null texts are empty (their end id alone); null ids are ids like any other; repeated rows are texts of
    their own; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut(cut_pieces(texts, tokenizer, ranks, pattern, end_id, size))
    spark = texts.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, size)
    assert len(runs) < size * size, "plan larger than its bound"
    slots = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "_length long, _rank long, _n long, _sequence long, _offset long")
    key = F.xxhash64("node_id", "piece", "start", "ids_crc32")
    ranked = prefix_sums(pieces.withColumn("_one", F.lit(1).cast("long")), "length", key, ["node_id", "piece", "ids_crc32"], "_one", sum(counts.values()), "_r")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n")))
    return placed.select("node_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_r") - F.col("_rank")).alias("sequence_id"), F.col("_offset").alias("offset"))
