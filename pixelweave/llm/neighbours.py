"""Approximate nearest images by cosine: an NN-descent graph, searched greedily.

The graph is built by rounds of Spark joins: every image brings the neighbours of its list and of the
lists that name it together, all of them are compared with each other, and each keeps the best. Searches start at the
query's own place in the graph and follow links to better and better images, all queries at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut

#: Nodes of one task of a merge or of a comparison, and images of a leaf of the first lists.
BLOCK_NODES = 512
SCORE_NODES = 4096
LEAF_ROWS = 192
EDGE = "node long, nbr long, score float, fresh boolean"
CAND = "node long, nbr long, score float"


def usable(images: DataFrame) -> DataFrame:
    """Rows whose vector can be compared: no null, no non-finite component, not zero, of the commonest length (of several, the shortest)."""
    v = F.col("signature")
    t = images.select("image_id", v.cast("array<double>").alias("signature")).filter(F.col("image_id").isNotNull() & v.isNotNull())
    bad = F.exists("signature", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    t = t.filter(~bad & F.exists("signature", lambda x: x != 0))
    dims = t.groupBy(F.size("signature").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return t.filter(F.size("signature") == (dims["n"] if dims else 0))


def matrix(column, kind=np.float64) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(a), -1)


def codes(vectors: np.ndarray) -> np.ndarray:
    """One signed byte a component: enough to order neighbours while the graph is built."""
    return np.rint(vectors * (127 / np.abs(vectors).max(axis=1, keepdims=True))).astype(np.int8)


def units(code: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(code), dtype=np.int8).reshape(len(code), -1).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def first_lists(nodes: DataFrame, n: int, width: int, trees: int, seed: int) -> DataFrame:
    """Candidates (node, nbr, score): the best of the leaf that each of ``trees`` sets of random planes puts a node in."""
    planes = max(0, math.ceil(math.log2(max(1, n) / LEAF_ROWS)))

    def leaves(batches):
        for b in batches:
            v = units(b.column("code").to_pylist())
            rng = np.random.default_rng(seed)
            for tree in range(trees):
                side = v @ rng.standard_normal((v.shape[1], planes)).astype(np.float32) > 0
                leaf = side @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(v), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * trees + tree), b.column("node"), b.column("code")], names=["leaf", "node", "code"])

    def best(t: pa.Table) -> pa.Table:
        ids, v = t.column("node").to_numpy(), units(t.column("code").to_pylist())
        k = min(width, len(ids) - 1)
        if k < 1:
            return pa.table({"node": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "score": pa.array([], pa.float32())})
        s = v @ v.T
        np.fill_diagonal(s, -9)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pa.table({"node": np.repeat(ids, k), "nbr": ids[top].ravel(), "score": np.take_along_axis(s, top, axis=1).ravel()})

    t = nodes.select("node", "code").mapInArrow(leaves, "leaf long, node long, code binary")
    # a leaf that many vectors share is dealt to parts of bounded size
    size = t.groupBy("leaf").agg(F.count("*").alias("c"))
    t = t.join(size, "leaf").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / (4 * LEAF_ROWS))))
    return t.groupBy("leaf", "part").applyInArrow(lambda key, x: best(x), CAND)


def merged(edges: DataFrame | None, found: DataFrame, n: int, width: int) -> DataFrame:
    """The ``width`` best distinct neighbours of each node; those not in ``edges`` are fresh."""
    blocks = max(1, n // BLOCK_NODES)
    t = found.select("node", "nbr", "score", F.lit(True).alias("fresh"))
    t = (t if edges is None else t.union(edges.select("node", "nbr", "score", F.lit(False)))).withColumn("block", block_of("node", blocks))

    def best(x: pa.Table) -> pa.Table:
        a, b, s = x.column("node").to_numpy(), x.column("nbr").to_numpy(), x.column("score").to_numpy()
        f = x.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
        o = np.lexsort((f, b, a))  # a known link before the same one found again
        a, b, s, f = a[o], b[o], s[o], f[o]
        one = np.ones(len(a), dtype=bool)
        one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s, f = a[one], b[one], s[one], f[one]
        o = np.lexsort((b, -s, a))
        a, b, s, f = a[o], b[o], s[o], f[o]
        head = np.ones(len(a), dtype=bool)
        head[1:] = a[1:] != a[:-1]
        place = np.arange(len(a)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        k = place < width
        return pa.table({"node": a[k], "nbr": b[k], "score": s[k], "fresh": f[k]})

    return cut(t.groupBy("block").applyInArrow(best, EDGE))


def descend(nodes: DataFrame, edges: DataFrame, n: int, width: int, members: int) -> DataFrame:
    """One round: candidates among the neighbours of each node's neighbours, both ways.

    Around every centre, nodes of its list and nodes whose lists name it meet, dealt to groups of
    ``members`` (fresh ones first, so that each pair with a fresh node is likely to meet); a centre that very many lists name gets
    more groups, so no group is large and none is left out.
    """
    worst = edges.groupBy("node").agg(F.min("score").alias("worst"), F.count("*").alias("c"))
    worst = worst.select("node", F.when(F.col("c") >= width, F.col("worst")).otherwise(F.lit(-9.0)).cast("float").alias("worst"))
    known = nodes.select("node", "code").join(worst, "node").withColumnRenamed("node", "member")
    both = edges.select(F.col("node").alias("centre"), F.col("nbr").alias("member"), "fresh").union(edges.select("nbr", "node", "fresh"))
    both = both.groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    order = Window.partitionBy("centre").orderBy(F.col("fresh").desc(), F.xxhash64("centre", "member"))
    both = both.withColumn("part", F.floor((F.row_number().over(order) - 1) / members).cast("int"))
    # groups without a fresh member have met before
    both = both.withColumn("_any", F.max("fresh").over(Window.partitionBy("centre", "part"))).filter("_any")
    t = both.drop("_any").join(known, "member").withColumn("block", block_of("centre", max(1, n // (BLOCK_NODES // 2))))

    def meet(x: pa.Table) -> pa.Table:
        c, p = x.column("centre").to_numpy(), x.column("part").to_numpy()
        o = np.lexsort((p, c))
        c, p = c[o], p[o]
        ids, worst = x.column("member").to_numpy()[o], x.column("worst").to_numpy()[o]
        fresh = x.column("fresh").to_numpy(zero_copy_only=False).astype(bool)[o]
        v = units(x.column("code").to_pylist())[o]
        head = np.ones(len(c), dtype=bool)
        head[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
        start = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        place = np.arange(len(c)) - start[group]
        out: list[list] = [[], [], []]
        for s in range(0, len(start), 64):  # groups compared at once
            rows = slice(start[s], start[s + 64] if s + 64 < len(start) else len(c))
            g, k = group[rows] - s, place[rows]
            shape = (int(g.max()) + 1, members)
            vec = np.zeros((*shape, v.shape[1]), dtype=np.float32)
            vec[g, k] = v[rows]
            who, low, new = np.full(shape, -1, dtype=np.int64), np.full(shape, 9, dtype=np.float32), np.zeros(shape, dtype=bool)
            there = np.zeros(shape, dtype=bool)
            who[g, k], low[g, k], new[g, k], there[g, k] = ids[rows], worst[rows], fresh[rows], True
            score = np.matmul(vec, vec.transpose(0, 2, 1))
            ok = (score > low[:, :, None]) & there[:, None, :] & (new[:, :, None] | new[:, None, :])
            ok[:, np.arange(members), np.arange(members)] = False
            i, a, b = np.nonzero(ok)
            out[0].append(who[i, a])
            out[1].append(who[i, b])
            out[2].append(score[i, a, b])
        return pa.table({"node": np.concatenate(out[0]), "nbr": np.concatenate(out[1]), "score": np.concatenate(out[2]).astype(np.float32)})

    return t.groupBy("block").applyInArrow(meet, CAND)


def build_graph(nodes: DataFrame, n: int, width: int, rounds: int, trees: int = 6, members: int = 48, seed: int = 5) -> DataFrame:
    """Links (node, nbr): ``width`` near neighbours of every node and the reverse of these links.

    ``nodes(node, code)``, n of them. The lists start from random-plane leaves and take ``rounds`` of NN-descent.
    """
    edges = merged(None, first_lists(nodes, n, width, trees, seed), n, width)
    for _ in range(rounds):
        edges = merged(edges, descend(nodes, edges, n, width, members), n, width)
    links = edges.select("node", "nbr")
    return cut(links.union(links.select("nbr", "node")).distinct())


def search_graph(nodes: DataFrame, links: DataFrame, starts: DataFrame, n: int, beam: int) -> DataFrame:
    """(query, node, score): the ``beam`` nearest nodes that a greedy search from each start finds.

    ``nodes(node, signature)``; ``starts(node)`` are nodes that serve as queries. A round follows the links of all
    beam members not yet followed; it ends when no query has any. Candidates are scored where their block of vectors is.
    """
    blocks = max(1, -(-n // SCORE_NODES))
    vectors = cut(nodes.select("node", "signature").withColumn("block", block_of("node", blocks)))
    asked = vectors.select("node", "signature").join(starts.select("node").distinct(), "node").withColumnRenamed("node", "query")
    asked = cut(asked)
    state = cut(asked.select("query", F.col("query").alias("node"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("open")))

    def score(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids, v = left.column("node").to_numpy(), matrix(left.column("signature"))
            o = np.argsort(ids)
            ids, v = ids[o], v[o]
            norm = np.sqrt((v * v).sum(axis=1))
            qv = matrix(right.column("signature"))
            cands, floors, queries = right.column("cands"), right.column("floor").to_pylist(), right.column("query").to_pylist()
            for k, q in enumerate(queries):
                at = np.searchsorted(ids, cands[k].values.to_numpy())
                s = (v[at] @ qv[k]) / (norm[at] * math.sqrt(float(qv[k] @ qv[k])))
                keep = np.flatnonzero(s >= floors[k]) if floors[k] is not None else np.arange(len(s))
                if len(keep) > beam:
                    keep = keep[np.argpartition(-s[keep], beam - 1)[:beam]]
                out[0].append(np.full(len(keep), q))
                out[1].append(ids[at[keep]])
                out[2].append(s[keep])
        return pa.table({c: np.concatenate(x) for c, x in zip(("query", "node", "score"), out)})

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc_nulls_last(), "node"))
    while not state.filter("open").isEmpty():
        reached = state.filter("open").select("query", "node").join(links, "node").select("query", F.col("nbr").alias("node"))
        own = state.filter(F.col("score").isNull()).select("query", "node")  # the start itself is scored too
        reached = reached.union(own).withColumn("block", block_of("node", blocks))
        reached = reached.groupBy("query", "block").agg(F.collect_set("node").alias("cands"))
        floor = state.groupBy("query").agg(F.count("score").alias("c"), F.min("score").alias("s")).select("query", F.when(F.col("c") >= beam, F.col("s")).alias("floor"))
        reached = reached.join(asked, "query").join(floor, "query")
        new = vectors.groupBy("block").cogroup(reached.groupBy("block")).applyInArrow(score, "query long, node long, score double")
        t = state.filter(F.col("score").isNotNull()).select("query", "node", "score", F.lit(False).alias("open"))
        t = t.union(new.withColumn("open", F.col("query") != F.col("node")))
        t = t.groupBy("query", "node").agg(F.max("score").alias("score"), F.min("open").alias("open"))
        state = cut(t.withColumn("_r", rank).filter(F.col("_r") <= beam).drop("_r"))
    return state.select("query", "node", "score")


def nearest_images(images: DataFrame, queries: DataFrame, k: int = 5, width: int = 24, rounds: int = 3, beam: int = 160) -> DataFrame:
    """``query_id, rank, image_id, score``: about the k images of largest cosine for every query.

    ``images(image_id, signature)`` are long ids and arrays of numbers; ``queries(image_id)`` names rows of
    ``images``, whose own id is no candidate. Scores are cosines of the given vectors in double precision; ties go to
    the smaller ``image_id``; with fewer candidates than k all that the graph reaches are returned. All images are in
    the graph. ``width``, ``rounds`` and ``beam`` trade work for recall.

    Equal vectors are one node of the graph with its k + 1 smallest ids: no other can be among k answers. So a vector that
    a third of all rows share costs one node.

    Vectors that are null, zero, hold a null or non-finite component, or are not of the commonest length take no part,
    nor do null ids; repeated rows (one id, one vector) count once; queries that name no usable row give no
    rows, nor does an empty table; other columns are ignored.
    """
    t = usable(images).distinct()
    place = F.row_number().over(Window.partitionBy("signature").orderBy("image_id"))
    few = t.withColumn("_r", place).filter(F.col("_r") <= k + 1)
    nodes = few.groupBy("signature").agg(F.min("image_id").alias("first"), F.array_sort(F.collect_list("image_id")).alias("ids"))

    def code(batches):
        for b in batches:
            c = codes(matrix(b.column("signature")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in c], pa.binary())], names=["node", "signature", "ids", "code"])

    nodes = cut(nodes.select(F.xxhash64("signature", "first").alias("node"), "signature", "ids").mapInArrow(code, "node long, signature array<double>, ids array<long>, code binary"))
    n = nodes.count()
    asked = t.join(queries.select("image_id").distinct(), "image_id")
    asked = cut(asked.join(nodes.select("node", "signature"), "signature").select(F.col("image_id").alias("query_id"), "node"))
    links = build_graph(nodes, n, width, rounds)
    found = search_graph(nodes, links, asked, n, beam)
    listed = found.join(nodes.select("node", F.explode("ids").alias("image_id")), "node")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "image_id")
    listed = listed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).select(F.col("query").alias("node"), "image_id", "score")
    out = asked.join(listed, "node").filter(F.col("image_id") != F.col("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "image_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "image_id", "score")
