"""Graph algebra against brute force."""

import random

import pytest

from pixelweave.operators import digraph, reach
from pixelweave.operators import lineage as lg
from pyspark.sql import functions as F

EDGE = "ord long, id string, source long, source_port string, target long, target_port string"


def edges(spark, pairs):
    return spark.createDataFrame([(i, f"e{i}", s, "out", t, "a") for i, (s, t) in enumerate(pairs)], EDGE)


def reaches(out, a, b):
    seen, stack = set(), [a]
    while stack:
        for n in out.get(stack.pop(), ()):
            if n not in seen:
                seen.add(n)
                stack.append(n)
    return b in seen


def accept(pairs):
    out, kept = {}, []
    for i, (s, t) in enumerate(pairs):
        if s == t or reaches(out, t, s):
            continue
        out.setdefault(s, []).append(t)
        kept.append(i)
    return kept


@pytest.mark.parametrize("window", [digraph.WINDOW, 3])
def test_back_edges_are_refused_in_order(spark, window):
    """Several parts, lines between them, loops and repeated arcs, decided at once or in many rounds."""
    rnd = random.Random(5)
    pairs = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(22)] + [(100, 101), (101, 102)]
    pairs += [(a + 20, b + 20) for a, b in ((rnd.randrange(6), rnd.randrange(6)) for _ in range(12))] + [(40, 41), (41, 42), (42, 43), (43, 40), (3, 40), (43, 20)]
    pairs += [(60, 61), (61, 62), (62, 50), (50, 60)]
    rnd.shuffle(pairs)
    got = sorted(r.ord for r in lg.drop_back_edges(edges(spark, pairs), window).collect())
    assert got == accept(pairs)


def test_one_ring_of_any_length(spark):
    """A ring loses its latest edge only, in a few rounds."""
    n = 20000
    ring = spark.range(n).select(F.expr(f"(id * 7919) % {n}").alias("ord"), F.col("id").alias("source"), ((F.col("id") + 1) % n).alias("target"))
    refused = ring.join(lg.drop_back_edges(ring), "ord", "left_anti").collect()
    assert [r.ord for r in refused] == [n - 1]


def test_many_cyclic_parts_in_one_round(spark, monkeypatch):
    rnd, pairs, rounds = random.Random(3), [], []
    for k in range(300):
        pairs += [(a + 20 * k, b + 20 * k) for a, b in ((rnd.randrange(8), rnd.randrange(8)) for _ in range(16))]
    rnd.shuffle(pairs)
    decide = digraph._decide
    monkeypatch.setattr(digraph, "_decide", lambda keys: rounds.append(1) or decide(keys))
    got = sorted(r.ord for r in lg.drop_back_edges(edges(spark, pairs)).collect())
    assert got == accept(pairs) and len(rounds) == 1


def test_no_cycle_no_edge(spark):
    assert lg.drop_back_edges(edges(spark, []).limit(0)).count() == 0
    assert sorted(r.ord for r in lg.drop_back_edges(edges(spark, [(1, 2), (2, 3), (1, 3), (None, 3), (3, None)])).collect()) == [0, 1, 2]


def sanitize(rows):
    """Accepted rows (ord, id, source, source_port, target, target_port) by all rules, one after another; every input takes one edge."""
    ids, ends, inputs, out, kept = set(), set(), set(), {}, []
    for o, i, s, sp, t, tp in rows:
        if i in ids or (s, sp, t, tp) in ends or s == t or reaches(out, t, s) or (t, tp) in inputs:
            continue
        ids.add(i)
        ends.add((s, sp, t, tp))
        inputs.add((t, tp))
        out.setdefault(s, []).append(t)
        kept.append(o)
    return kept


@pytest.mark.parametrize("window", [digraph.WINDOW, 4])
def test_wiring_is_sanitized_in_one_pass(spark, window):
    """A back edge takes no input from a later edge, and an edge refused for its input closes no cycle."""
    rnd = random.Random(8)
    rows = [(0, "a", 1, "out", 2, "p"), (1, "b", 2, "out", 1, "p"), (2, "c", 3, "out", 1, "p"), (3, "d", 4, "out", 1, "p"), (4, "e", 1, "out", 4, "q"), (5, "e", 5, "out", 4, "q")]
    for k in range(6, 60):
        rows.append((k, f"i{rnd.randrange(40)}", rnd.randrange(10, 20), "out", rnd.randrange(10, 20), rnd.choice("pqrs")))
    ports = spark.createDataFrame([("n", "out", "out", "image", False)] + [("n", "in", x, "image", False) for x in "pqrs"], "type string, side string, port string, port_type string, multiple boolean")
    nodes = spark.createDataFrame([(k, "n") for k in range(20)], "id long, type string")
    got = {r.ord: r.reason for r in lg.sanitize_wiring(spark.createDataFrame(rows, EDGE), nodes, ports, window).collect()}
    assert len(got) == len(rows) and sorted(k for k, why in got.items() if why is None) == sanitize(rows)
    assert [got[k] for k in range(6)] == [None, "closes a cycle", None, "input taken", None, "duplicate id"]


def plain_levels(n, pairs):
    """Longest ways from free nodes; nodes on or behind cycles are left out."""
    into = {k: {a for a, b in pairs if b == k and a != b} for k in range(n)}
    level, todo = {}, True
    while todo:
        todo = [k for k in range(n) if k not in level and into[k] <= level.keys()]
        level |= {k: max((level[p] + 1 for p in into[k]), default=0) for k in todo}
    return level


@pytest.mark.parametrize("seed", [1, 2])
def test_levels(spark, seed):
    """Trees, lines, layers, cycles with what hangs behind them, and a hub."""
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(k), k) for k in range(1, 30)] + [(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(15)) if a < b]
    pairs += [(k, k + 1) for k in range(30, 60)] + [(5, 30), (60, 61), (61, 62), (62, 61), (62, 63), (63, 64), (64, 65), (10, 65), (66, 66), (67, 68), (68, 67)]
    pairs += [(70, k) for k in range(71, 80)] + [(k, 80) for k in range(71, 80)] + [(80, 81), (70, 81)]
    nodes = spark.createDataFrame([(k,) for k in range(82)], "id long")
    want = plain_levels(82, pairs)
    assert {r.id: r.level for r in digraph.levels(nodes, edges(spark, pairs)).collect()} == want
    assert {r.id for r in lg.find_cycles(nodes, edges(spark, pairs)).collect()} == set(range(82)) - want.keys()


def test_levels_of_a_long_line(spark, monkeypatch):
    """100 000 nodes in a line, in fewer than 40 written rounds."""
    n, rounds = 100000, []
    line = spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    cut = digraph.cut
    monkeypatch.setattr(digraph, "cut", lambda df: rounds.append(1) or cut(df))
    got = digraph.levels(spark.range(n), line).filter("level = id").count()
    assert got == n and len(rounds) < 40


def test_small_graph(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4)])
    pairs = spark.createDataFrame([(1, 3), (3, 1), (4, 4), (4, 3)], "src long, dst long")
    got = {(r.src, r.dst): r.connected for r in lg.has_path(e, pairs).collect()}
    assert got == {(1, 3): True, (3, 1): False, (4, 4): True, (4, 3): False}
    cand = spark.createDataFrame([(3, 1), (4, 3)], "source long, target long")
    assert {(r.source, r.target): r.cycle for r in lg.would_cycle(e, cand).collect()} == {(3, 1): True, (4, 3): False}


def closure(pairs, a):
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)
    seen, stack = {a}, [a]
    while stack:
        fresh = out.get(stack.pop(), set()) - seen
        seen |= fresh
        stack += fresh
    return seen


@pytest.mark.parametrize("marks", [64, 256])
def test_paths_against_brute_force(spark, monkeypatch, marks):
    """Cycles, lines inside and behind them, a ring of its own, a hub, unknown nodes and nulls."""
    monkeypatch.setattr(reach, "LANDMARKS", marks)
    rnd = random.Random(marks)
    pairs = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(190)]
    pairs += [(a, a + 1) for a in range(200, 230)] + [(3, 200), (215, 5), (230, 9)] + [(a, a + 1) for a in range(300, 310)] + [(310, 300)] + [(7, k) for k in range(400, 440)] + [(k, 440) for k in range(400, 440)]
    pairs += [(500, 501), (501, 502), (502, 501), (502, 503), (None, 1), (1, None), (8, 8)]
    nodes = [*range(150), *range(200, 231, 3), *range(300, 311, 2), *range(400, 441, 7), 500, 501, 502, 503, 999]
    asked = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(3000)] + [(a, b) for a in range(300, 311) for b in (300, 305, 3)] + [(205, 204), (204, 205), (230, 200)]
    want = {}
    for a, b in asked:
        want[a, b] = b in closure(pairs, a)
    asked += [(None, 1), (1, None), (5, 5), (5, 5)]
    want |= {(None, 1): False, (1, None): False, (5, 5): True}
    got = lg.has_path(edges(spark, pairs), spark.createDataFrame(asked, "src long, dst long")).collect()
    assert len(got) == len(asked) and {(r.src, r.dst): r.connected for r in got} == want


def test_labels_settle_most_pairs(spark):
    """Of random pairs few are left to the search, and no label contradicts the closure."""
    rnd = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(400), rnd.randrange(400)) for _ in range(900)) if a < b})
    arcs = spark.createDataFrame(pairs, "s long, t long")
    asked = sorted({(rnd.randrange(400), rnd.randrange(400)) for _ in range(4000)})
    told = reach.judged(spark.createDataFrame(asked, "src long, dst long"), reach.reach_labels(arcs), "src", "dst").collect()
    reached = {a: closure(pairs, a) for a in range(400)}
    assert all(r.known is None or r.known == (r.dst in reached[r.src]) for r in told)
    assert sum(r.known is None for r in told) < len(asked) * 0.05


def test_paths_along_a_long_line(spark, monkeypatch):
    n, rounds = 30000, []
    line = spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    asked = spark.range(n).select(F.col("id").alias("src"), F.expr(f"(id * 7919) % {n}").alias("dst"))
    cut = digraph.cut
    for m in (digraph, reach):
        monkeypatch.setattr(m, "cut", lambda df: rounds.append(1) or cut(df))
    assert lg.has_path(line, asked).filter("connected <> (src <= dst)").isEmpty() and len(rounds) < 60


def test_duplicate_is_judged_against_accepted_edges_only(spark):
    """(A, X), (B, X), (B, Y): the second id is refused for its endpoint, so the third may reuse its id."""
    rows = [(0, "A", 1, "out", 2, "x"), (1, "A", 1, "out", 3, "x"), (2, "B", 1, "out", 2, "x"), (3, "B", 1, "out", 3, "x")]
    raw = spark.createDataFrame(rows, EDGE)
    nodes = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "id long, type string")
    got = {r.ord: r.reason for r in lg.sanitize_edges(raw, nodes).collect()}
    assert got == {0: None, 1: "duplicate id", 2: "duplicate edge", 3: None}


def test_cycle_members_are_found(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (5, 5)])
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert {r.id for r in lg.find_cycles(nodes, e).collect()} == {2, 3, 4}


def test_closure_joins_sets_and_broadcasts_nothing(spark, monkeypatch):
    """Hubs, cycles, sets over the bound and few seeds, against a search from each node; the plans of all rounds without a broadcast."""
    import random

    from pixelweave.operators import lineage as lg

    plans, real = [], lg.cut
    monkeypatch.setattr(lg, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(lg, "SET", 12)
    monkeypatch.setattr(lg, "FAN", 5)
    rnd = random.Random(5)
    pairs = {(k, k // m) for k in range(2, 90) for m in (2, 3) if k >= m} | {(500, k) for k in range(0, 90, 9)}
    pairs |= {(300, 301), (301, 302), (302, 300), (303, 300), (302, 40), (7, 7), (95, 304), (304, 95)} | {(rnd.randrange(400, 420), rnd.randrange(400, 440)) for _ in range(25)}
    edges = spark.createDataFrame(sorted(pairs), "source long, target long")
    nodes = sorted({v for e in pairs for v in e})
    for back in (False, True):
        step = {}
        for s, t in pairs:
            step.setdefault(t if back else s, set()).add(s if back else t)
        for seeds in (nodes, nodes[::7]):
            want = set()
            for root in seeds:
                todo = list(step.get(root, ()))
                while todo:
                    v = todo.pop()
                    if (root, v) not in want:
                        want.add((root, v))
                        todo += step.get(v, ())
            got = [tuple(r) for r in lg.descendants(edges, spark.createDataFrame([(v,) for v in seeds], "id long"), back).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert not any("Broadcast" in p for p in plans)
