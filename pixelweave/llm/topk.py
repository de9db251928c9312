"""Exact largest inner products over image signatures, by Fagin's threshold algorithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut

#: Rows of a block of candidates, queries of a pack, list entries read before the bound is looked at again.
BLOCK_ROWS = 4096
PACK_ROWS = 256
STEP = 64
EXACT = 2.0 ** 53


class Block:
    """Candidates of one block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, levels: np.ndarray):
        self.ids, self.levels = ids, levels
        self.asc = np.argsort(levels, axis=0, kind="stable")
        self.sorted = np.take_along_axis(levels, self.asc, axis=0)

    def best(self, own: int, query: np.ndarray, floor: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates, or fewer: none below ``floor``.

        The lists are read in step from the end that contributes most. Rows met for the first time are scored in
        full; an unmet row can reach no more than the sum of the contributions at the reading
        positions, so reading stops once that is below the k-th score and the floor. Ties are read on.
        """
        n, dims = self.levels.shape
        used = np.flatnonzero(query)
        met = np.zeros(n, dtype=bool)
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.levels.dtype)
        up = query[used] > 0
        for start in range(0, n, STEP):
            stop = min(n, start + STEP)
            if len(used):
                rows = np.where(up[None, :], self.asc[n - stop:n - start, used][::-1], self.asc[start:stop, used]).ravel()
            else:
                rows = np.arange(n)
            fresh = np.zeros(n, dtype=bool)
            fresh[rows] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, self.levels[new] @ query])
            keep = ids != own
            if floor is not None:
                keep &= scores >= floor
            ids, scores = ids[keep], scores[keep]
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
            if not len(used):
                break
            at = np.where(up, self.sorted[n - stop, used], self.sorted[stop - 1, used])
            bound = at @ query[used]
            if (len(ids) == k and bound < scores[-1]) or (floor is not None and bound < floor):
                break
        return ids, scores


def top_products(images: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, image_id, score``: the k largest integer inner products of every query.

    ``images(image_id, levels)`` and ``queries(image_id, levels)`` hold arrays of integers; of two lengths, the shorter one counts
    as if zeros followed. A query's own id is no candidate; ties go to the smaller ``image_id``; with fewer candidates than k
    all are returned. Exact: the candidates are dealt to blocks of bounded size by a hash of their id, queries to
    packs, and every pack meets every block, first one block (its k-th score is a floor for the rest), then the
    others, which return only what reaches the floor.

    Rows whose id or array is null or whose array holds a null take no part. Of queries with one id the
    smallest array counts; repeated images stay candidates, each for itself. Scores are computed in doubles while they
    are exact there, else in 64-bit integers. No query or no image: no rows. Other columns are ignored.
    """
    def ready(t: DataFrame) -> DataFrame:
        ok = F.col("image_id").isNotNull() & F.col("levels").isNotNull() & ~F.exists("levels", lambda x: x.isNull())
        return t.select("image_id", F.col("levels").cast("array<long>").alias("levels")).filter(ok)

    rows = cut(ready(images))
    asked = ready(queries).groupBy("image_id").agg(F.min("levels").alias("levels"))
    n = rows.count()
    blocks, packs = max(1, round(n / BLOCK_ROWS)), max(1, -(-asked.count() // PACK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("image_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    rows = cut(rows)
    asked = cut(asked.withColumn("pack", F.pmod(F.xxhash64("image_id"), F.lit(packs)).cast("int")))

    def arrays(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = column.combine_chunks()
        at = a.offsets.to_numpy()
        return a.values.to_numpy(zero_copy_only=False), at[:-1].astype(np.int64), np.diff(at).astype(np.int64)

    def matrix(values: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """One row an array, cut or filled with zeros to ``width``."""
        out = np.zeros((len(size), width), dtype=np.int64)
        size = np.minimum(size, width)
        row = np.repeat(np.arange(len(size)), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out[row, col] = values[start[row] + col]
        return out

    def search(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            mine, theirs = arrays(left.column("levels")), arrays(right.column("levels"))
            width = int(min(mine[2].max(), theirs[2].max()))  # beyond the longest of either side all products are zero
            levels, asked = matrix(*mine, width), matrix(*theirs, width)
            reach = float(np.abs(levels.astype(float)).max(initial=0)) * float(np.abs(asked.astype(float)).sum(axis=1).max(initial=0))
            kind = np.float64 if reach < EXACT else np.int64
            block = Block(left.column("image_id").to_numpy(), levels.astype(kind))
            floors = right.column("floor").to_pylist()
            for q, vector, floor in zip(right.column("image_id").to_pylist(), asked.astype(kind), floors):
                ids, scores = block.best(q, vector, floor, k)
                out[0] += [q] * len(ids)
                out[1] += ids.tolist()
                out[2] += [int(s) for s in scores]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "image_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    def meet(q: DataFrame) -> DataFrame:
        """q(image_id, levels, pack, block, floor): every pack with the blocks its rows name."""
        left = rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        return left.groupBy("block", "pack").cogroup(q.groupBy("block", "pack")).applyInArrow(search, "query_id long, image_id long, score long")

    spark = images.sparkSession
    own = asked.withColumns({"block": F.pmod("pack", F.lit(blocks)).cast("int"), "floor": F.lit(None).cast("long")})
    home = rows.withColumn("pack", F.explode(F.sequence(F.col("block"), F.lit(packs - 1), F.lit(blocks)))) if blocks < packs else rows.withColumn("pack", F.col("block")).filter(F.col("pack") < packs)
    first = cut(home.groupBy("block", "pack").cogroup(own.groupBy("block", "pack")).applyInArrow(search, "query_id long, image_id long, score long"))
    if blocks > 1:
        low = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).select(F.col("query_id").alias("_q"), F.when(F.col("c") == k, F.col("s")).alias("floor"))
        rest = asked.join(low, F.col("image_id") == F.col("_q"), "left").drop("_q")
        rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter(F.col("block") != F.pmod("pack", F.lit(blocks)))
        first = first.union(meet(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "image_id"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "image_id", "score")
