"""Directed graphs as arc tables: levels, cyclic parts, and edges accepted one after another.

Arcs are ``(s, t)`` of any type that has an order. Rounds run on the driver, data never does: a round is a few joins
written to the checkpoint folder (``cut``), and only counts come back. What is chained in a line, however long, is
settled by pointer doubling, so a line of n nodes costs log n rounds and not n.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SPREAD_ROWS
from ..schema import cut_apart as cut

#: Edges of a part that are decided in one task at a time, and bits of one word of a set of them.
WINDOW = 2048
BITS = 64
#: Rounds that clear away what lies on no cycle before parts are sought.
TRIM = 4
#: Arcs that reachable sets pass between two written rounds.
HOPS = 4


def distinct_arcs(edges: DataFrame) -> DataFrame:
    """(s, t) of edges(source, target), no arc twice, no loops."""
    return edges.filter("source <> target").select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()


def climb(parents: DataFrame, join, whole: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """From every node of ``parents(v, p, w)``, one parent each, up to the first ancestor that has no parent.

    Returns (v, p, w), p the ancestor and w what ``join`` makes of the steps' w, and the same for nodes whose
    ancestors go round in a ring (None if there are none); with ``whole`` their w covers the ring at least once.
    Every round doubles the steps, so rounds grow with the logarithm of the depth. A parent of null is an end.
    """
    heads = parents.select(F.col("v").alias("_h"))
    t = parents.filter("p is not null").join(heads, F.col("p") == F.col("_h"), "left").select("v", "p", "w", F.col("_h").isNotNull().alias("more"))
    t = cut(t.unionByName(parents.filter("p is null").select("v", "p", "w", F.lit(False).alias("more"))))
    before, steps, rings = None, 1, None
    while n := t.filter("more").count():
        if n == before:  # a finite line would have come nearer to its end
            rings = t.filter("more")
            if not whole or steps >= n:
                break
        up = t.select(F.col("v").alias("_v"), F.col("p").alias("_p"), F.col("w").alias("_w"), F.col("more").alias("_more"))
        on = t.filter("more").join(up, F.col("p") == F.col("_v")).select("v", F.col("_p").alias("p"), join(F.col("w"), F.col("_w")).alias("w"), F.col("_more").alias("more"))
        t = cut(t.filter("not more").unionByName(on))
        before, steps = n, steps * 2
    return t.filter("not more").drop("more"), None if rings is None else t.filter("more").drop("more")


def levels(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, level): the longest way to a node from one without incoming edges. Nodes on or behind a cycle are absent,
    and nodes that are not settled after ``rounds`` rounds, if that is given.

    All nodes of level 0 are merged into one root. A node with one parent lies one arc above it, and ``climb`` takes it to its
    nearest ancestor of several parents, or to the root. Arcs are then drawn anew between what is left, the longest of
    each pair, which gives more nodes a single parent. A round so takes at least what a round of removing free nodes
    takes, and a line or a tree of any depth as a whole. In the end the nodes hang below each other in a forest, and one more climb
    reads the levels off.
    """
    ids = nodes.select("id").distinct()
    arcs = distinct_arcs(edges)
    arcs = arcs.join(ids.select(F.col("id").alias("s")), "s", "left_semi").join(ids.select(F.col("id").alias("t")), "t", "left_semi")
    arcs = cut(arcs)
    free = cut(ids.join(arcs.select(F.col("t").alias("id")), "id", "left_anti"))
    root = free.select(F.col("id").alias("s"), F.lit(True).alias("_root"))
    arcs = arcs.join(root, "s", "left").select(F.when(F.col("_root").isNull(), F.col("s")).alias("p"), F.col("t").alias("v"), F.lit(1).cast("long").alias("w"))
    hung = []
    while rounds is None or len(hung) < rounds:
        arcs = cut(arcs.groupBy("p", "v").agg(F.max("w").alias("w")))  # p null: the root
        single = cut(arcs.groupBy("v").agg(F.count("*").alias("_n"), F.max("p").alias("p"), F.max("w").alias("w")).filter("_n = 1").drop("_n"))
        if single.isEmpty():
            break
        top, _ = climb(single, lambda a, b: a + b)
        hung.append(top)
        left = arcs.join(single.select("v"), "v", "left_anti")
        up = top.select(F.col("v").alias("_v"), F.col("p").alias("_p"), F.col("w").alias("_w"))
        moved = left.filter("p is not null").join(up, F.col("p") == F.col("_v"), "left").select(
            F.when(F.col("_v").isNull(), F.col("p")).otherwise(F.col("_p")).alias("p"), "v", (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        arcs = moved.unionByName(left.filter("p is null"))
    done = free.select("id", F.lit(0).alias("level"))
    if hung:
        top, _ = climb(cut(reduce(DataFrame.unionByName, hung)), lambda a, b: a + b)
        done = done.union(top.filter("p is null").select(F.col("v").alias("id"), F.col("w").cast("int").alias("level")))
    return done


def maybe_cyclic(arcs: DataFrame) -> DataFrame:
    """(id): all nodes on cycles, and few others: what ``TRIM`` rounds of ``levels`` from either end leave over."""
    edges = arcs.select(F.col("s").alias("source"), F.col("t").alias("target"))
    nodes = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    stuck = cut(nodes.join(levels(nodes, edges, TRIM), "id", "left_anti"))
    if stuck.isEmpty():
        return stuck
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return cut(stuck.join(levels(stuck, back, TRIM), "id", "left_anti"))


def colours(arcs: DataFrame) -> DataFrame:
    """(id, colour): the greatest node, in a random order, from which a node of ``arcs(s, t)`` can be reached, itself included."""
    state = cut(arcs.select(F.col("s").alias("id")).union(arcs.select(F.col("t").alias("id"))).distinct().withColumn("colour", F.struct(F.xxhash64("id").alias("h"), "id")))
    front = state
    while True:
        far = [front]
        for _ in range(HOPS):
            far.append(far[-1].join(arcs, F.col("id") == F.col("s")).groupBy("t").agg(F.max("colour").alias("colour")).select(F.col("t").alias("id"), "colour"))
        got = reduce(DataFrame.unionByName, far[1:]).groupBy("id").agg(F.max("colour").alias("_new"))
        front = cut(state.join(got, "id").filter("_new > colour").select("id", F.col("_new").alias("colour")))
        if front.isEmpty():
            return state
        state = cut(state.join(front, "id", "left_anti").unionByName(front))


def turned(arcs: DataFrame) -> DataFrame:
    """Every arc the other way round."""
    return arcs.select(F.col("t").alias("s"), F.col("s").alias("t"), *[c for c in arcs.columns if c not in ("s", "t")])


def same_colour(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs that lie within a colour, and the colours."""
    c = colours(arcs.select("s", "t").distinct())
    t = arcs.join(c.select(F.col("id").alias("s"), F.col("colour").alias("_a")), "s").join(c.select(F.col("id").alias("t"), F.col("colour").alias("_b")), "t")
    return cut(t.filter("_a = _b").select(arcs.columns)), c


def strong_parts(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs (with their other columns) inside strongly connected parts, and (id, part) of the nodes there.

    Forward and backward colouring by turns: two nodes of one part have the same colours, and the part of the greatest node of a
    colour is told apart from the rest by the backward pass. What crosses colours goes; when a whole turn drops nothing, colours
    are parts. All parts are worked on at once, and as the greatest node is a random one, a few turns do.
    """
    while True:
        n = arcs.count()
        if n == 0:
            return arcs, arcs.select(F.col("s").alias("id"), F.col("s").alias("part"))
        arcs, c = same_colour(arcs)
        arcs = turned(same_colour(turned(arcs))[0])
        if arcs.count() == n:
            return arcs, c.select("id", F.col("colour.id").alias("part"))


def contract(core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of ``core(ord, s, t, fixed)`` as one edge each, and (ord): edges that close a ring of their own.

    A node with one edge in and one out, neither of them ``fixed``, can only lie on a cycle together with both edges. Such a line
    exists from its latest edge on, and no other edge of it can close a cycle; so the line becomes an edge with the ``ord`` of its latest one.
    """
    into = core.groupBy("t").agg(F.count("*").alias("_n"), F.max("fixed").alias("_f"), F.max("s").alias("p"), F.max("ord").alias("w")).filter("_n = 1 and not _f")
    out = core.groupBy("s").agg(F.count("*").alias("_n"), F.max("fixed").alias("_f")).filter("_n = 1 and not _f").select(F.col("s").alias("v"))
    inner = cut(into.select(F.col("t").alias("v"), "p", "w").join(out, "v", "left_semi"))
    if inner.isEmpty():
        return core, core.select("ord").limit(0)
    lines, rings = climb(inner, F.greatest, whole=True)
    closing = core.select("ord").limit(0) if rings is None else rings.select(F.col("w").alias("ord")).distinct()
    up = lines.select(F.col("v").alias("_v"), F.col("p").alias("_p"), F.col("w").alias("_w"))
    ends = core.join(inner.select(F.col("v").alias("t")), "t", "left_anti").join(up, F.col("s") == F.col("_v"), "left")
    joined = ends.select(F.greatest("ord", "_w").alias("ord"), F.coalesce("_p", "s").alias("s"), "t", "fixed")
    loops = joined.filter("s = t").select("ord")
    return cut(joined.filter("s <> t")), cut(closing.union(loops))


def _words(n: int) -> list[str]:
    return [f"b{k}" for k in range(n)]


def reachable_sets(marks: DataFrame, arcs: DataFrame, words: list[str]) -> DataFrame:
    """(part, id, words…): the union of the bit sets ``marks`` of all nodes that an ``id`` reaches over ``arcs(part, s, t)``.

    Sets go against the arcs, all of them at once, ``HOPS`` arcs in a round, until none grows; only grown sets travel on.
    """
    def united(d: DataFrame) -> DataFrame:
        return d.groupBy("part", "id").agg(*[F.bit_or(w).alias(w) for w in words])

    def hop(d: DataFrame) -> DataFrame:
        return united(d.withColumnRenamed("id", "t").join(arcs, ["part", "t"]).select("part", F.col("s").alias("id"), *words))

    state = cut(united(marks))
    front = state
    while True:
        far = [hop(front)]
        for _ in range(HOPS - 1):
            far.append(hop(far[-1]))
        got = united(reduce(DataFrame.unionByName, far)).withColumnsRenamed({w: f"_{w}" for w in words})
        both = got.join(state, ["part", "id"], "left").withColumns({w: F.coalesce(w, F.lit(0).cast("long")) for w in words})
        grown = reduce(lambda a, b: a | b, [F.col(f"_{w}").bitwiseAND(F.bitwise_not(F.col(w))) != 0 for w in words])
        front = cut(both.filter(grown).select("part", "id", *[F.col(w).bitwiseOR(F.col(f"_{w}")).alias(w) for w in words]))
        if front.isEmpty():
            return state
        state = cut(state.join(front, ["part", "id"], "left_anti").unionByName(front))


def _decide(keys: int):
    """Rows of whole parts in order: accept or refuse each edge by what it reaches and by the keys that are taken."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []

        def settle() -> pa.RecordBatch:
            reach = [r[1] for r in rows]  # by edge: bits of the edges whose source its target reaches
            live = [i for i, r in enumerate(reach) if r]
            taken: list[set] = [set() for _ in range(keys)]
            why: list[str | None] = []
            for i, (_, _, *own) in enumerate(rows):
                held = [k for k, (v, seen) in enumerate(zip(own, taken)) if v is not None and v in seen]
                reason = f"key {held[0]}" if held else "cycle" if reach[i] >> i & 1 else None
                why.append(reason)
                if reason is None:
                    for v, seen in zip(own, taken):
                        seen.add(v)
                    for x in live:
                        if reach[x] >> i & 1:
                            reach[x] |= reach[i]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(why, pa.string())], names=["ord", "why"])

        for b in batches:
            words = np.stack([b.column(c).to_numpy() for c in b.schema.names if c.startswith("b")], axis=1).astype("<i8")
            own = [b.column(c).to_pylist() for c in b.schema.names if c.startswith("key")]
            for k, (p, o) in enumerate(zip(b.column("part").to_pylist(), b.column("ord").to_pylist())):
                if p != part and rows:
                    yield settle()
                    rows = []
                part = p
                rows.append((o, int.from_bytes(words[k].tobytes(), "little"), *[v[k] for v in own]))
        if rows:
            yield settle()

    return run


def accept_in_order(edges: DataFrame, keys: list[Column] = (), window: int = WINDOW) -> DataFrame:
    """Which of edges(ord, source, target), taken by ``ord``, are accepted: (ord, why), ``why`` null for those.

    An edge is refused if an accepted one before it has an equal value in one of ``keys`` ("key k", the first such; null values never
    clash), or if it would close a cycle of accepted edges ("cycle"). ``ord`` is unique; rows without an end are left out.

    Edges outside strongly connected parts close no cycle, and lines inside them become single edges (``contract``).
    What may clash is linked into parts, and parts are independent of each other. In every round each part decides its next
    ``window`` edges in one task. What the task has to know of the edges accepted before is a bit for each
    pair of them: whether the one's target reaches the other's source (``reachable_sets``). So a task holds ``window``
    squared bits, whatever the size of the part; n edges of one part take n / ``window`` rounds, and parts that are smaller take one.
    """
    names = [f"key{k}" for k in range(len(keys))]
    t = cut(edges.select("ord", F.col("source").alias("s"), F.col("target").alias("t"), *[k.cast("string").alias(n) for k, n in zip(keys, names)]))
    loops = t.filter("s = t").select("ord", F.lit("cycle").alias("why"))
    t = t.filter("s <> t")
    shared = [t.filter(F.col(n).isNotNull()).groupBy(n).agg(F.count("*").alias("_n")).filter("_n > 1").select(n, F.lit(True).alias(f"_{n}")) for n in names]
    for n, table in zip(names, shared):
        t = _left(t, table, n)
    clash = reduce(lambda a, b: a | b, [F.col(f"_{n}").isNotNull() for n in names], F.lit(False))
    t = cut(t.select("ord", "s", "t", *names, clash.alias("fixed")))
    # of equal arcs without clashes the first decides for all
    first = t.filter("not fixed").groupBy("s", "t").agg(F.min("ord").alias("ord"))
    stuck = maybe_cyclic(t.select("s", "t").distinct())
    inside = lambda d: d.join(stuck.select(F.col("id").alias("s")), "s", "left_semi").join(stuck.select(F.col("id").alias("t")), "t", "left_semi")
    core = cut(inside(first.withColumn("fixed", F.lit(False)).unionByName(t.filter("fixed").select("s", "t", "ord", "fixed"))))
    refused = []
    if not core.isEmpty():
        core, ring = contract(core)
        refused.append(ring)
    core, part = strong_parts(core)
    undecided = core.filter("not fixed").select("ord", "s", "t").unionByName(t.filter("fixed").select("ord", "s", "t"))
    undecided = undecided.join(t.select("ord", *names), "ord")
    undecided = _link(undecided, core, part, t, names)
    told = _rounds(undecided, names, window)
    refused = reduce(DataFrame.unionByName, [told, *[r.select("ord", F.lit("cycle").alias("why")) for r in refused]])
    why = t.join(refused, "ord", "left").select("ord", "s", "t", "fixed", "why")
    lead = why.filter("not fixed").join(first.select("ord"), "ord", "left_semi").filter("why is not null").select("s", "t", F.lit("cycle").alias("_lead"))
    why = why.join(lead, ["s", "t"], "left").select("ord", F.coalesce("why", F.when(~F.col("fixed"), F.col("_lead"))).alias("why"))
    return why.unionByName(loops)


def _left(t: DataFrame, table: DataFrame, n: str) -> DataFrame:
    """Left join on a key that is null in many rows: each of those gets a value of its own, so they do not meet in one task."""
    own = F.coalesce(F.col(n), F.concat(F.lit("\0"), F.col("ord").cast("string")))
    return t.withColumn("_key", own).join(table.withColumnRenamed(n, "_key"), "_key", "left").drop("_key")


def _link(undecided: DataFrame, core: DataFrame, part: DataFrame, t: DataFrame, names: list[str]) -> DataFrame:
    """``undecided`` with ``part``: edges that may bear on each other are in one. Equal hashes of different keys only join parts."""
    from .components import connected_components

    strong = core.select("ord", F.lit(True).alias("_in"))
    u = undecided.join(strong, "ord", "left").join(part.select(F.col("id").alias("s"), F.col("part").alias("_p")), "s", "left")
    own = F.when(F.col("_in"), F.xxhash64(F.lit("part"), F.col("_p").cast("string")))
    u = u.select("ord", "s", "t", *names, F.coalesce(F.col("_in"), F.lit(False)).alias("cyclic"), own.alias("_own"))
    if not names:
        return cut(u.withColumn("part", F.col("_own")).drop("_own"))
    u = cut(u)
    me = F.xxhash64(F.lit("edge"), F.col("ord"))
    links = [u.filter("_own is not null").select(me.alias("a"), F.col("_own").alias("b"))]
    for k, n in enumerate(names):
        links.append(u.filter(F.col(n).isNotNull()).select(me.alias("a"), F.xxhash64(F.lit(k), F.col(n)).alias("b")))
    labels = connected_components(reduce(DataFrame.unionByName, links)).select(F.col("id").alias("_me"), F.col("label").alias("part"))
    return cut(u.withColumn("_me", me).join(labels, "_me", "left").select("ord", "s", "t", *names, "cyclic", F.coalesce("part", "_me").alias("part")))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, whole parts to a task and in order. The number of tasks is given, or few would get all: they are told by bytes, and deciding takes longer than reading."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SPREAD_ROWS))
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "_k")


def _rounds(undecided: DataFrame, names: list[str], window: int) -> DataFrame:
    """(ord, why) of all edges decided, window by window."""
    told: list[DataFrame] = []
    arcs = None
    while True:
        place = F.row_number().over(Window.partitionBy("part").orderBy("ord"))
        now = cut(undecided.withColumn("_k", place).filter(F.col("_k") <= window).withColumn("_k", F.col("_k") - 1))
        last, total = now.agg(F.max("_k"), F.count("*")).first()
        if last is None:
            break
        words = _words(last // BITS + 1)
        bit = [F.when(F.floor(F.col("_k") / BITS) == k, F.expr(f"shiftleft(1L, _k % {BITS})")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)]
        marks = now.filter("cyclic").select("part", F.col("s").alias("id"), *bit)
        if arcs is None:
            sets = marks.groupBy("part", "id").agg(*[F.bit_or(w).alias(w) for w in words])
        else:
            sets = reachable_sets(marks, arcs, words)
        sets = sets.select(F.col("part").alias("_part"), F.col("id").alias("_id"), *words)
        rows = now.join(sets, (F.col("part") == F.col("_part")) & (F.col("t") == F.col("_id")) & F.col("cyclic"), "left")
        rows = rows.select("part", "ord", "_k", *names, *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in words])
        done = cut(_dealt(rows, total).drop("_k").mapInArrow(_decide(len(names)), "ord long, why string"))
        told.append(done)
        yes = now.join(done.filter("why is null").select("ord"), "ord", "left_semi")
        left = undecided.join(now.select("ord"), "ord", "left_anti")
        for k, n in enumerate(names):
            held = yes.filter(F.col(n).isNotNull()).select(n, F.lit(f"key {k}").alias(f"_why{k}")).distinct()
            left = _left(left, held, n)
        if names:
            left = cut(left.withColumn("_why", F.coalesce(*[F.col(f"_why{k}") for k in range(len(names))])).drop(*[f"_why{k}" for k in range(len(names))]))
            told.append(left.filter("_why is not null").select("ord", F.col("_why").alias("why")))
            left = left.filter("_why is null").drop("_why")
        undecided = cut(left.select(undecided.columns))
        more = yes.filter("cyclic").select("part", "s", "t")
        more = more if arcs is None else arcs.unionByName(more)
        arcs = cut(more.join(undecided.select("part").distinct(), "part", "left_semi"))
    empty = undecided.select("ord", F.lit(None).cast("string").alias("why")).limit(0)
    return reduce(DataFrame.unionByName, told, empty)
