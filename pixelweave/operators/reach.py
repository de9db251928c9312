"""Whether paths exist, for many pairs of nodes: labels settle nearly all pairs, a search the rest.

No closure is built. Every node gets a label of fixed size about the nodes it reaches and one about the nodes that reach
it. If u reaches v, all that v reaches is reached by u, so v's label lies within u's in every part; one part that does not shows
that there is no path. A landmark reached by u that reaches v shows that there is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut_apart as cut
from ..schema import large
from .digraph import BITS, HOPS, climb, distinct_arcs, maybe_cyclic, strong_parts, turned

#: Random orders per direction; steps of a path that place a node in an order; landmarks.
ORDERS = 3
STEPS = 64
LANDMARKS = 256


def without_lines(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs with every line of nodes that have one arc in and one out drawn together to one arc, and
    (id, line, place, head, tail) of the nodes taken out: their line, place in it, and the nodes before and behind it.

    Of a ring of such nodes nothing is left, and head and tail are null. Lines of any length take log rounds (``climb``).
    """
    into = arcs.groupBy("t").agg(F.count("*").alias("_n"), F.max("s").alias("p")).filter("_n = 1").select(F.col("t").alias("v"), "p")
    out = arcs.groupBy("s").agg(F.count("*").alias("_m"), F.max("t").alias("q")).filter("_m = 1").select(F.col("s").alias("v"), "q")
    inner = cut(into.join(out, "v"))
    up, ring = climb(inner.join(inner.select(F.col("v").alias("p")), "p", "left_semi").select("v", "p", F.struct(F.lit(1).cast("long").alias("n"), F.col("v").alias("m")).alias("w")),
                     lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.greatest(a["m"], b["m"]).alias("m")), whole=True)
    at = inner.join(up.select("v", F.col("p").alias("first"), F.col("w.n").alias("place")), "v", "left")
    at = cut(at.select("v", "p", "q", F.coalesce("first", "v").alias("line"), F.coalesce("place", F.lit(0).cast("long")).alias("place")))
    if ring is not None:
        round_ = cut(ring.select("v", F.col("w.m").alias("line")))
        at = at.join(round_.select("v"), "v", "left_anti")
    heads = at.filter("place = 0").select("line", F.col("p").alias("head"))
    last = at.groupBy("line").agg(F.max_by("q", "place").alias("tail"))
    ends = cut(heads.join(last, "line"))
    nodes = at.select(F.col("v").alias("id"), "line", "place").join(ends, "line")
    short = ends.select(F.col("head").alias("s"), F.col("tail").alias("t")).filter("s <> t")
    if ring is not None:
        nodes = nodes.unionByName(round_.select(F.col("v").alias("id"), "line", F.lit(0).cast("long").alias("place")), allowMissingColumns=True)
    taken = inner.select(F.col("v"))
    left = arcs.join(taken.withColumnRenamed("v", "s"), "s", "left_anti").join(taken.withColumnRenamed("v", "t"), "t", "left_anti")
    return cut(left.select("s", "t").union(short).distinct()), cut(nodes)


def condensed(arcs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The arcs between strongly connected parts, their labels, and (id, part) of the nodes in parts of several nodes (None without any).

    Nodes of one part have equal labels, so only arcs between equal labels are looked at.
    """
    cols = [c for c in labels.columns if c != "id"]
    alike = labels.select("id", F.xxhash64(*cols).alias("l"))
    core = arcs.join(alike.select(F.col("id").alias("s"), F.col("l").alias("_a")), "s").join(alike.select(F.col("id").alias("t"), F.col("l").alias("_b")), "t")
    core = cut(core.filter("_a = _b").select("s", "t"))
    stuck = maybe_cyclic(core)
    if stuck.isEmpty():
        return arcs, labels, None
    core = core.join(stuck.withColumnRenamed("id", "s"), "s", "left_semi").join(stuck.withColumnRenamed("id", "t"), "t", "left_semi")
    _, part = strong_parts(cut(core))
    part = cut(part)
    lone = labels.join(part.filter("id <> part").select("id"), "id", "left_anti")  # a part is named by one of its nodes
    return cut(_named(_named(arcs, part, "s"), part, "t").filter("s <> t").distinct()), cut(lone), part


def _named(df: DataFrame, part: DataFrame | None, c: str) -> DataFrame:
    """``df`` with the part of a node in place of the node."""
    if part is None:
        return df
    p = part.select(F.col("id").alias("_id"), F.col("part").alias("_part"))
    return df.join(p, F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("_part", c)).drop("_id", "_part")


def random_orders(arcs: DataFrame) -> DataFrame:
    """(side, id, r0, r1, …): places of the nodes of ``arcs(side, s, t)`` in ``ORDERS`` random orders a side.

    For each order every node picks one of its predecessors at random. The picks form a forest, and nodes are sorted by
    their path from the root, so what hangs below a node lies together, as in a depth-first search. Paths are
    put together by pointer doubling; beyond ``STEPS`` steps, and where picks go round in a ring, nodes are sorted by a hash.
    """
    order = arcs.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    picked = order.groupBy("side", "o", "t").agg(F.min_by("s", F.xxhash64("o", "s", "t")).alias("p"))
    code = lambda c: F.lpad(F.hex(F.pmod(F.xxhash64(F.col("o"), F.col(c)), F.lit(256))), 2, "0")
    node = lambda c: F.struct("side", "o", F.col(c).alias("id"))
    parents = picked.select(node("t").alias("v"), node("p").alias("p"), code("t").alias("w"))
    paths, _ = climb(cut(parents), lambda a, b: F.substring(F.concat(b, a), 1, 2 * STEPS))
    nodes = order.select("side", "o", F.col("s").alias("id")).union(order.select("side", "o", F.col("t").alias("id"))).distinct()
    at = paths.select(F.col("v.side").alias("side"), F.col("v.o").alias("o"), F.col("v.id").alias("id"), F.col("p.id").alias("top"), "w")
    t = nodes.join(at, ["side", "o", "id"], "left").withColumns({"top": F.xxhash64("o", F.coalesce("top", "id")), "w": F.coalesce("w", F.lit("")), "h": F.xxhash64("o", "id")})
    key = ["side", "o", "top", "w", "h", "id"]
    t = t.repartitionByRange(*key).sortWithinPartitions(*key).select("side", "o", "id", F.monotonically_increasing_id().alias("r"))
    return cut(t).groupBy("side", "id").agg(*[F.max(F.when(F.col("o") == k, F.col("r"))).alias(f"r{k}") for k in range(ORDERS)])


def landmarks(arcs: DataFrame) -> DataFrame:
    """(id, no): the ``LANDMARKS`` nodes with most arcs in times arcs out, numbered from 0."""
    degree = arcs.select(F.col("s").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(arcs.select("t", F.lit(0), F.lit(1)))
    degree = degree.groupBy("id").agg(((F.sum("o") + 1) * (F.sum("i") + 1)).alias("d"))
    best = degree.orderBy(F.desc("d"), "id").limit(LANDMARKS)  # a table of fixed size
    return best.select("id", (F.row_number().over(Window.orderBy(F.desc("d"), "id")) - 1).alias("no"))


def _within(a: str, b: str, words: list[str]) -> Column:
    """Whether the label with prefix ``b`` lies within the one with prefix ``a``."""
    spans = [(F.col(f"{a}lo{k}") <= F.col(f"{b}lo{k}")) & (F.col(f"{a}hi{k}") >= F.col(f"{b}hi{k}")) for k in range(ORDERS)]
    bits = [F.col(f"{b}{w}").bitwiseAND(F.bitwise_not(F.col(f"{a}{w}"))) == 0 for w in words]
    return reduce(lambda x, y: x & y, spans + bits)


def reach_labels(arcs: DataFrame) -> DataFrame:
    """(id, d…, a…): what a node of ``arcs(s, t)`` reaches (d) and what reaches it (a), itself included.

    Of both sets the first and last place in each random order, and which landmarks they hold. The places and bits of a
    set are minima, maxima and unions over neighbours, so both directions spread together, ``HOPS`` arcs a round, until nothing changes.
    """
    words = [f"b{k}" for k in range(LANDMARKS // BITS)]
    cols = [f"{e}{k}" for k in range(ORDERS) for e in ("lo", "hi")] + words
    one, other = arcs.select(F.lit(0).alias("side"), "s", "t"), turned(arcs).select(F.lit(1).alias("side"), "s", "t")
    flows = cut(one.union(other))  # on side 0 a set comes to s from t
    own = [F.col(f"r{k}").alias(f"{e}{k}") for k in range(ORDERS) for e in ("lo", "hi")]
    bits = [F.when(F.floor(F.col("no") / BITS) == k, F.expr(f"shiftleft(1L, no % {BITS})")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)]
    state = random_orders(flows).join(F.broadcast(landmarks(arcs)), "id", "left").select("side", "id", *own, *bits)
    state = cut(state)

    def united(d: DataFrame) -> DataFrame:
        how = {"l": F.min, "h": F.max, "b": F.bit_or}
        return d.groupBy("side", "id").agg(*[how[c[0]](c).alias(c) for c in cols])

    def hop(d: DataFrame) -> DataFrame:
        return united(d.withColumnRenamed("id", "t").join(flows, ["side", "t"]).select("side", F.col("s").alias("id"), *cols))

    front = state
    while True:
        far = [hop(front)]
        for _ in range(HOPS - 1):
            far.append(hop(far[-1]))
        got = united(reduce(DataFrame.unionByName, far)).withColumnsRenamed({c: f"_{c}" for c in cols})
        both = got.join(state, ["side", "id"]).filter(~_within("", "_", words))
        new = {"l": F.least, "h": F.greatest, "b": lambda x, y: F.col(x).bitwiseOR(F.col(y))}
        front = cut(both.select("side", "id", *[new[c[0]](c, f"_{c}").alias(c) for c in cols]))
        if front.isEmpty():
            break
        state = cut(state.join(front, ["side", "id"], "left_anti").unionByName(front))
    down = state.filter("side = 0").select("id", *[F.col(c).alias(f"d{c}") for c in cols])
    return cut(down.join(state.filter("side = 1").select("id", *[F.col(c).alias(f"a{c}") for c in cols]), "id"))


def judged(pairs: DataFrame, labels: DataFrame, src: str, dst: str) -> DataFrame:
    """``pairs`` with ``known``: true or false where the labels of two nodes tell, else null. No path leads to or from nodes without arcs."""
    words = [f"b{k}" for k in range(LANDMARKS // BITS)]
    side = lambda p, c: labels.select(F.col("id").alias(c), *[F.col(x).alias(f"{p}{x}") for x in labels.columns if x != "id"])
    t = pairs.join(side("u", src), src, "left").join(side("v", dst), dst, "left")
    through = reduce(lambda x, y: x | y, [F.col(f"ud{w}").bitwiseAND(F.col(f"va{w}")) != 0 for w in words])
    fits = _within("ud", "vd", words) & _within("va", "ua", words)
    known = F.when(F.col(src) == F.col(dst), True).when(F.col("udlo0").isNull() | F.col("vdlo0").isNull() | ~fits, False).when(through, True)
    return t.select(*pairs.columns, known.alias("known"))


def paths_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst), each once, with ``connected``; a node reaches itself.

    Lines become single arcs (``without_lines``): a path from inside a line goes on at its tail, one into a line comes by its head. Then
    nodes get labels (``reach_labels``), strongly connected parts become one node each, and the labels decide. Pairs that they leave
    open are searched along the arcs, all at once; labels are asked at every node on the way, so a search only goes where
    its end may still lie, and ends as soon as it is known to be reached. Nulls are connected to nothing.
    """
    ends = pairs.filter("src is not null and dst is not null").select("src", "dst").distinct()
    arcs, lines = without_lines(cut(distinct_arcs(edges)))
    u = lines.select(F.col("id").alias("_u"), F.col("line").alias("_ul"), F.col("place").alias("_up"), F.col("tail").alias("_ut"))
    v = lines.select(F.col("id").alias("_v"), F.col("line").alias("_vl"), F.col("place").alias("_vp"), F.col("head").alias("_vh"))
    t = ends.join(u, F.col("src") == F.col("_u"), "left").join(v, F.col("dst") == F.col("_v"), "left")
    ring = F.col("_ut").isNull() & F.col("_vh").isNull()
    here = (F.col("src") == F.col("dst")) | (F.col("_ul").eqNullSafe(F.col("_vl")) & F.col("_ul").isNotNull() & ((F.col("_up") < F.col("_vp")) | ring))
    t = cut(t.select("src", "dst", F.coalesce(here, F.lit(False)).alias("_here"), F.when(F.col("_u").isNull(), F.col("src")).otherwise(F.col("_ut")).alias("_s"),
                     F.when(F.col("_v").isNull(), F.col("dst")).otherwise(F.col("_vh")).alias("_d")))
    arcs, labels, part = condensed(arcs, reach_labels(arcs))
    named = cut(_named(_named(t, part, "_s"), part, "_d"))
    told = cut(judged(named.filter("not _here and _s is not null and _d is not null").select("_s", "_d").distinct(), labels, "_s", "_d"))
    found = [told.filter("known").select("_s", "_d")]
    front = cut(told.filter("known is null").select("_s", "_d", F.col("_s").alias("_at")))
    seen = front
    while not front.isEmpty():
        step = front.join(arcs, F.col("_at") == F.col("s")).select("_s", "_d", F.col("t").alias("_at")).distinct()
        step = cut(judged(step, labels, "_at", "_d").filter("known is null or known"))
        hit = cut(step.filter("known").select("_s", "_d").distinct())
        found.append(hit)
        front = step.filter("known is null").drop("known").join(hit, ["_s", "_d"], "left_anti")
        front = cut(front.join(large(seen), ["_s", "_d", "_at"], "left_anti"))
        seen = seen.unionByName(front)
    hits = reduce(DataFrame.unionByName, found).withColumn("_hit", F.lit(True))
    return named.join(hits, ["_s", "_d"], "left").select("src", "dst", (F.col("_here") | F.coalesce("_hit", F.lit(False))).alias("connected"))
