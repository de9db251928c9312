"""Lineage and graph quality over edge tables ``edges(id, source, source_port, target, target_port)``.

Loops run on the driver, data never does: each round is a join written to the checkpoint folder
(``cut``), and only an emptiness flag comes back.  Node sets, not edge lists, are grouped, so a hub
holding a third of all edges never becomes one group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import cut, large
from . import digraph
from .reach import paths_between

# fixed values: which output types each input type accepts
ACCEPTS = {
    "image": ["image", "mask", "sequence"],
    "mask": ["mask", "image", "sequence"],
    "text": ["text"],
    "stl": ["stl"],
    "sequence": ["sequence", "image", "mask"],
    "splat": ["splat"],
    "transform": ["transform"],
}


def accepts(out_type: Column, in_type: Column) -> Column:
    """Whether an output may be wired to an input; unknown types never fit."""
    hit = F.lit(False)
    for want, have in ACCEPTS.items():
        hit = hit | ((in_type == want) & out_type.isin(have))
    return F.coalesce(hit, F.lit(False))


def _arcs(edges: DataFrame, reverse: bool = False) -> DataFrame:
    s, t = ("target", "source") if reverse else ("source", "target")
    return edges.select(F.col(s).alias("_s"), F.col(t).alias("_t")).distinct()


def downstream(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbour): distinct direct dependents of the given ids(id)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").select(
        F.col("source").alias("id"), F.col("target").alias("neighbour")
    ).distinct()


def upstream(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(
        F.col("target").alias("id"), F.col("source").alias("neighbour")
    ).distinct()


#: Most arcs and most descendants of a node whose set is kept in one row.
FAN = 256
SET = 4096


def descendants(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """(root, node): every node reachable from each seed(id).

    If every node with arcs is a seed, sets are made from the ends of the graph upwards (``_sets``): each is the union of those of
    its targets. Nodes on or above cycles and those with larger sets reach each other by rounds, and then take the sets of what
    they end at. Few seeds go by rounds alone. No table is broadcast: all of them grow with the graph.
    """
    arcs = cut(_arcs(edges, reverse))
    seeds = seeds.select(F.col("id").alias("root")).distinct()
    if not arcs.join(large(seeds), F.col("_s") == F.col("root"), "left_anti").isEmpty():
        return _pairs(arcs, seeds)
    done = _sets(arcs)
    found = done.select(F.col("id").alias("root"), F.explode("set").alias("node"))
    rest = cut(arcs.join(large(done), F.col("_s") == F.col("id"), "left_anti"))
    if rest.isEmpty():
        return found
    near = _pairs(rest, rest.select(F.col("_s").alias("root")).distinct())
    far = near.join(large(done), F.col("node") == F.col("id")).select("root", F.explode("set").alias("node"))
    return found.union(near.union(far).distinct())


def _sets(arcs: DataFrame) -> DataFrame:
    """(id, set): all that a node reaches, for nodes that reach no cycle, whose set has at most ``SET`` nodes, and likewise below them.

    Sets go up one arc a round; a node is done when it has heard from all of its targets.
    """
    degree = arcs.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= FAN)
    up = cut(arcs.join(large(degree), "_s"))
    types = dict(arcs.dtypes)
    sinks = arcs.select(F.col("_t").alias("id")).distinct().join(large(arcs), F.col("id") == F.col("_s"), "left_anti")
    done = sinks.withColumn("set", F.expr(f"cast(array() as array<{types['_t']}>)"))
    waiting, sets = None, []
    while True:
        heard = done.join(large(up), F.col("id") == F.col("_t")).select("_s", "_n", F.lit(1).cast("long").alias("_k"), F.concat(F.array("_t"), "set").alias("set"))
        heard = heard if waiting is None else heard.unionByName(waiting)
        heard = heard.groupBy("_s", "_n").agg(F.sum("_k").alias("_k"), F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"))
        heard = cut(heard.filter(F.size("set") <= SET))
        waiting = heard.filter("_k < _n")
        done = heard.filter("_k = _n").select(F.col("_s").alias("id"), "set")
        sets.append(done)
        if done.isEmpty():
            return reduce(DataFrame.unionByName, sets)


def _pairs(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node) over arcs(_s, _t) from seeds(root), by semi-naive rounds of ``HOPS`` arcs each.

    A round goes on from the pairs that the round before first found with its last arc; what it finds on the way is grouped with
    what is known once, so the known pairs are read once in ``HOPS`` arcs.
    """
    front = seeds.select("root", F.col("root").alias("node"))
    known = None
    while True:
        steps, far = [] if known is None else [known.withColumn("_hop", F.lit(0))], front
        for hop in range(1, digraph.HOPS + 1):
            far = far.join(large(arcs), F.col("node") == F.col("_s")).select("root", F.col("_t").alias("node")).distinct()
            steps.append(far.withColumn("_hop", F.lit(hop)))
        found = reduce(DataFrame.unionByName, steps).groupBy("root", "node").agg(F.min("_hop").alias("_hop"))
        found = cut(found.filter("_hop > 0"))
        new = found.select("root", "node")
        known = new if known is None else known.union(new)
        front = found.filter(F.col("_hop") == digraph.HOPS).select("root", "node")
        if front.isEmpty():
            return known


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return descendants(edges, seeds, reverse=True)


def reach(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """(id): nodes reachable from ANY seed: one visited set instead of pairs."""
    arcs = cut(_arcs(edges, reverse))
    front = cut(seeds.select(F.col("id").alias("_s")).distinct().join(arcs, "_s").select(F.col("_t").alias("id")).distinct())
    known = front
    while not front.isEmpty():
        step = front.join(arcs, F.col("id") == F.col("_s")).select(F.col("_t").alias("id")).distinct()
        front = cut(step.join(known, "id", "left_anti"))
        known = known.union(front)
    return known


def has_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst) plus ``connected``; a node reaches itself. Labels of the nodes settle most pairs (``reach``), no closure is built."""
    found = paths_between(edges, pairs).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "connected")
    t = pairs.join(found, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    return t.select(*pairs.columns, F.coalesce("connected", F.lit(False)).alias("connected"))


def would_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates(source, target) plus ``cycle``: whether adding that edge would close a loop."""
    keys = candidates.select("source", "target").distinct()
    pairs = keys.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    hit = has_path(edges, pairs).select(F.col("dst").alias("source"), F.col("src").alias("target"), F.col("connected").alias("cycle"))
    return candidates.join(hit, ["source", "target"])


def find_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes that can never be ordered. A self-loop alone does not block a node."""
    return nodes.select("id").distinct().join(digraph.levels(nodes, edges), "id", "left_anti")


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, asap, alap): earliest and latest column, both from 0 to the critical-path length."""
    asap = cut(digraph.levels(nodes, edges).withColumnRenamed("level", "asap"))
    sink = digraph.levels(nodes, edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).withColumnRenamed("level", "sink")
    t = nodes.select("id").distinct().join(asap, "id", "left").join(sink, "id", "left")
    top = asap.agg(F.max("asap")).first()[0] or 0  # one number: the critical-path length
    return t.select("id", F.coalesce("asap", F.lit(0)).alias("asap"), (F.lit(top) - F.coalesce("sink", F.lit(0))).alias("alap"))


def stale_nodes(prev_nodes: DataFrame, prev_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reason): nodes of the new version whose result no longer holds.

    Incoming wiring is compared edge by edge as counts (no per-node edge list is ever built).
    """
    a = prev_nodes.select("id", F.col("config").alias("_c"), F.coalesce("bypassed", F.lit(False)).alias("_b"), F.lit(True).alias("_old"))
    t = nodes.select("id", "config", F.coalesce("bypassed", F.lit(False)).alias("bypassed")).join(a, "id", "left")
    reason = (
        F.when(F.col("_old").isNull(), "added").when(F.col("bypassed") != F.col("_b"), "bypass")
        .when(~F.col("config").eqNullSafe(F.col("_c")), "config")
    )
    own = t.select("id", reason.alias("reason")).filter("reason is not null")
    key = ["target", "source", "source_port", "target_port"]
    count = lambda e, n: e.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    moved = count(prev_edges, "_n0").join(count(edges, "_n1"), key, "full_outer").filter("not (_n0 <=> _n1)")
    wired = moved.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    wired = wired.join(own, "id", "left_anti").withColumn("reason", F.lit("inputs"))
    changed = cut(own.union(wired))
    below = reach(edges, changed).join(nodes.select("id"), "id", "left_semi").join(changed, "id", "left_anti")
    return changed.union(below.withColumn("reason", F.lit("upstream")))


def _status(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.select(F.col("node_id").alias("id"), F.col("status").alias("_st"))
    return nodes.join(r, "id", "left").withColumn("status", F.coalesce("_st", F.lit("outOfDate"))).drop("_st")


def ready_nodes(nodes: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """(id): stale nodes with ``auto`` whose every upstream node is current."""
    fresh = runs.filter("status = 'upToDate'").select(F.col("node_id").alias("source"))
    blocked = edges.join(fresh, "source", "left_anti").select(F.col("target").alias("id")).distinct()
    return _status(nodes, runs).filter("auto and status = 'outOfDate'").select("id").join(blocked, "id", "left_anti")


def recompute_set(nodes: DataFrame, edges: DataFrame, runs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): the stale nodes among the given ids, their descendants, and all ancestors of those."""
    targets = cut(ids.select("id").union(reach(edges, ids)).distinct())
    need = targets.union(reach(edges, targets, reverse=True)).distinct()
    return _status(nodes, runs).filter("status <> 'upToDate'").select("id").join(need, "id", "left_semi")


def blocked_by_failure(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(id): nodes below a failure, the failed ones themselves not counted."""
    return reach(edges, failed).join(failed.select("id"), "id", "left_anti")


def sanitize_nodes(raw: DataFrame) -> DataFrame:
    """raw(ord, id, type, x, y, config, bypassed): the first complete row of each id, defaults filled."""
    cols = ["ord", "type", "x", "y", "config", "bypassed"]
    first = raw.filter("id is not null and type is not null").groupBy("id").agg(F.min(F.struct(*cols)).alias("_r"))
    t = first.select("id", *[F.col(f"_r.{c}").alias(c) for c in cols])

    def finite(v: str) -> Column:
        return F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(F.col(v)) < float("inf"))

    ok = finite("x") & finite("y")
    return t.select(
        "ord", "id", "type", F.when(ok, F.col("x")).otherwise(F.lit(0.0)).alias("x"),
        F.when(ok, F.col("y")).otherwise(F.lit(0.0)).alias("y"), F.coalesce("config", F.lit("{}")).alias("config"),
        F.coalesce("bypassed", F.lit(False)).alias("bypassed"),
    )


def check_edges(raw: DataFrame, nodes: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """raw edges plus ``reason`` (null when the edge is valid on its own) and ``single``."""
    ends = nodes.select("id", "type")
    t = raw.join(ends.select(F.col("id").alias("source"), F.col("type").alias("_stype")), "source", "left")
    t = t.join(ends.select(F.col("id").alias("target"), F.col("type").alias("_ttype")), "target", "left")
    missing = F.col("id").isNull() | F.col("source").isNull() | F.col("target").isNull()
    missing = missing | F.col("source_port").isNull() | F.col("target_port").isNull()
    reason = (
        F.when(missing, "missing field").when(F.col("_stype").isNull() | F.col("_ttype").isNull(), "dangling")
        .when(F.col("source") == F.col("target"), "self-loop")
    )
    single = F.lit(False)
    if ports is not None:
        side = lambda s, p, t: ports.filter(F.col("side") == s).select(
            F.col("type").alias(t), F.col("port").alias(p), F.col("port_type").alias(f"_{s}"), F.col("multiple").alias(f"_{s}_multi"))
        t = t.join(side("out", "source_port", "_stype"), ["_stype", "source_port"], "left")
        t = t.join(side("in", "target_port", "_ttype"), ["_ttype", "target_port"], "left")
        reason = (
            reason.when(F.col("_out").isNull(), "no output port").when(F.col("_in").isNull(), "no input port")
            .when(~accepts(F.col("_out"), F.col("_in")), "type mismatch")
        )
        single = ~F.coalesce("_in_multi", F.lit(True))
    return t.select("ord", "id", "source", "source_port", "target", "target_port", single.alias("single"), reason.alias("reason"))


def _conflicts() -> list[tuple[Column, str]]:
    """What two accepted edges must not share, and why."""
    return [
        (F.col("id"), "duplicate id"), (F.to_json(F.struct("source", "source_port", "target", "target_port")), "duplicate edge"),
        (F.when(F.col("single"), F.to_json(F.struct("target", "target_port"))), "input taken"),
    ]


def sanitize_edges(raw: DataFrame, nodes: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Every raw edge with ``reason``; null marks the accepted ones (cycles are G13's concern).

    A duplicate is judged against edges accepted so far.  Each round accepts the edges that come
    first in all of their groups (id, endpoints, single input), then drops whatever conflicts with
    them; group minima are partial aggregates, so a hot id costs one row per map task.
    """
    checked = cut(check_edges(raw, nodes, ports))
    bad = checked.filter("reason is not null")
    keys = ["k_id", "k_end", "k_one"]
    t = checked.filter("reason is null").withColumns({k: value for k, (value, _) in zip(keys, _conflicts())})
    left, taken, dropped = t, [], []
    while True:
        r = left
        for k in keys:
            first = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("ord").alias(f"_m{k}"))
            r = r.join(first, k, "left")
        wins = reduce(lambda a, b: a & b, [F.col(k).isNull() | (F.col(f"_m{k}") == F.col("ord")) for k in keys])
        win = cut(r.filter(wins).select(t.columns))
        if win.isEmpty():
            break
        taken.append(win)
        rest = left.join(win.select("ord"), "ord", "left_anti").withColumn("_hit", F.lit(None).cast("string"))
        for k, (_, why) in zip(keys, _conflicts()):
            mark = win.filter(F.col(k).isNotNull()).select(k, F.lit(why).alias("_why")).distinct()
            rest = rest.join(mark, k, "left").withColumn("_hit", F.coalesce("_hit", "_why")).drop("_why")
        rest = cut(rest)
        dropped.append(rest.filter("_hit is not null").withColumn("reason", F.col("_hit")))
        left = rest.filter("_hit is null").select(t.columns)
    cols = checked.columns
    return reduce(DataFrame.union, [bad] + [d.select(cols) for d in taken + dropped])


def drop_back_edges(edges: DataFrame, window: int = digraph.WINDOW) -> DataFrame:
    """Accept edges(ord, source, target, …) earliest first so that none closes a cycle of accepted ones (``digraph.accept_in_order``)."""
    told = digraph.accept_in_order(edges, window=window)
    return edges.join(large(told.filter("why is null").select("ord")), "ord", "left_semi")


def sanitize_wiring(raw: DataFrame, nodes: DataFrame, ports: DataFrame | None = None, window: int = digraph.WINDOW) -> DataFrame:
    """``sanitize_edges`` and ``drop_back_edges`` in one pass: every raw edge with ``reason``, null for the accepted ones.

    Each edge is judged against the edges accepted before it, by all rules at once: a refused back edge takes no input, no id and
    no endpoints away from a later edge, and an edge refused for its input closes no cycle.
    """
    checked = cut(check_edges(raw, nodes, ports))
    keys, reasons = zip(*_conflicts())
    told = digraph.accept_in_order(checked.filter("reason is null"), list(keys), window)
    named = F.create_map(*[F.lit(x) for k, why in enumerate(reasons) for x in (f"key {k}", why)], F.lit("cycle"), F.lit("closes a cycle"))
    told = told.select("ord", F.try_element_at(named, F.coalesce("why", F.lit(""))).alias("_why"))
    return checked.join(large(told), "ord", "left").withColumn("reason", F.coalesce("reason", "_why")).select(checked.columns)


def resolve_inputs(nodes: DataFrame, ports: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """(node_id, port, ord, value): what feeds each input port.

    Ports that take many values keep one row per edge (``ord`` gives their order); single ports keep
    the earliest edge that has a value.
    """
    ins = ports.filter("side = 'in'").select("type", F.col("port").alias("target_port"), "multiple")
    want = nodes.select(F.col("id").alias("target"), "type").join(ins, "type")
    have = results.filter("value is not null").select(
        F.col("node_id").alias("source"), F.col("port").alias("source_port"), "value"
    )
    t = edges.join(want, ["target", "target_port"]).join(have, ["source", "source_port"])
    t = t.select(F.col("target").alias("node_id"), F.col("target_port").alias("port"), "ord", "value", "multiple")
    many = t.filter("multiple").drop("multiple")
    one = t.filter("not multiple").groupBy("node_id", "port").agg(F.min(F.struct("ord", "value")).alias("_m"))
    return many.union(one.select("node_id", "port", "_m.ord", "_m.value"))


# fixed values: the value kind a port type carries; every other type is an image
KINDS = {"text": "text", "stl": "stl", "sequence": "sequence", "splat": "splat", "transform": "transform"}


def kind_of(port_type: Column) -> Column:
    e = F.when(port_type == "text", "text")
    for t, k in KINDS.items():
        e = e.when(port_type == t, k)
    return e.otherwise("image")


def bypass_outputs(nodes: DataFrame, ports: DataFrame, inputs: DataFrame) -> DataFrame:
    """(node_id, port, value): each output takes the first input, in port order, whose kind fits.

    ``ports`` carries ``pos`` (declaration order); ``inputs`` is (node_id, port, ord, kind, value).
    """
    first = inputs.groupBy("node_id", "port").agg(F.min(F.struct("ord", "kind", "value")).alias("_v"))
    ins = ports.filter("side = 'in'").select("type", "port", "pos")
    have = nodes.select(F.col("id").alias("node_id"), "type").join(ins, "type").join(first, ["node_id", "port"])
    have = have.select("node_id", "pos", F.col("_v.kind").alias("kind"), F.col("_v.value").alias("value"))
    outs = ports.filter("side = 'out'").select("type", F.col("port").alias("out"), kind_of(F.col("port_type")).alias("want"))
    want = nodes.select(F.col("id").alias("node_id"), "type").join(outs, "type").drop("type")
    frames = ["image", "sequence"]
    fits = (F.col("kind") == F.col("want")) | (F.col("kind").isin(frames) & F.col("want").isin(frames))
    t = want.join(have, "node_id").filter(fits)
    t = t.groupBy("node_id", "out").agg(F.min(F.struct("pos", "value")).alias("_m"))
    return t.select("node_id", F.col("out").alias("port"), F.col("_m.value").alias("value"))


def induced_subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame, prefix: str = "copy-", dx: float = 40.0,
                     dy: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Copy the nodes of a set and the edges wholly inside it, ids remapped, positions offset."""
    keep = ids.select("id").distinct()
    fresh = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n = nodes.join(keep, "id", "left_semi")
    n = n.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "id": fresh("id")})
    e = edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi")
    e = e.join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    return n, e.withColumns({"id": fresh("id"), "source": fresh("source"), "target": fresh("target")}).select(edges.columns)
