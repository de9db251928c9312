"""Filter audit, sharding and fill-in-the-middle against plain Python on small tables."""

import collections
import hashlib
import itertools
import json
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pixelweave.llm import audit, infill, sharding
from pixelweave.llm.queries import QUERIES
from pixelweave.sources.graphio import read_saved_graph
from pyspark.sql import functions as F

TEXTS = "node_id long, node_type string, text string, score string"
LONG = "é🦆<x " * 60000
ODD = [(None, None, None, "x"), (None, "llm", "a b", "x"), (None, "llm", "a b", "x"), (1, "llm", None, "x"), (2, "llm", "", "x"), (3, "text", "a", "x"), (3, "text", "a", "x"),
       (4, "text", " \n\t ", None), (5, "text", LONG, "x"), (6, "text", "A<M>b", "x"), (7, "", "a", "y"), (8, "text", " word ", "z"), (9, "text", LONG, "x")]


@pytest.fixture
def frame(spark):
    return lambda rows, schema=TEXTS: spark.createDataFrame(rows, schema)


def saved_texts(spark, tmp_path):
    """Settings of a saved graph's nodes, as the library reads them."""
    nodes = [{"id": f"n{k}", "type": ["text", "llm", "image"][k % 3], "position": {"x": 1.0, "y": 2.0}, "config": {"prompt": f"draw <P> {k}" if k == 4 else f"dräw #{k % 5} " * k}} for k in range(12)]
    (tmp_path / "g.json").write_text(json.dumps({"version": 1, "nodes": nodes, "edges": []}))
    return read_saved_graph(spark, str(tmp_path / "g.json"))[1].select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.col("config").alias("text"))


# audit

def brute_audit(rows, labels):
    """{(type, order, step): counts} by applying the filters in every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, kind, t, _ in rows:
        t = t or ""
        w = t.encode().split()
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        fails.append((kind, i, {k for k, v in f.items() if v}))
    out, values = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for kind in {r[1] for r in rows}:
            left, mine = [x for x in fails if x[0] == kind], [x for x in fails if x[0] == kind]
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[2]]
                left = [x for x in left if letter not in x[2]]
                failing = [x for x in mine if letter in x[2]]
                values[kind, letter] = values.get((kind, letter), 0) + len(gone)
                out[kind, order, k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(x[2] == {letter} for x in mine), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
    return {k: (*v, values[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df, first="node_type"):
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    got = {(r[first], r.filter_order, r.step): tuple(r[c] for c in cols) for r in rows}
    assert len(got) == len(rows)
    return got


def audited_rows():
    rng, rows = random.Random(1), list(ODD)
    for i in range(20, 140):
        w = [rng.choice(["w", "Word", "LOUD", "x|y", f"v{rng.randrange(400)}", f"u{rng.randrange(400)}"]) for _ in range(rng.choice([3, 150, 220, 500]))]
        rows.append((i, rng.choice(["a", "a", "b", None]), rng.choice([rows[-1][2] or "", " ".join(w), " ".join(w)]), None))
    return rows, [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in [*range(5, 120), 30, 31, 30]] + [(None, 1, 1)]


def test_audit_matches_every_order_applied(frame):
    rows, labels = audited_rows()
    got = told(audit.audit_filters(frame(rows), frame(labels, "node_id long, quality int, toxic int")))
    assert got == brute_audit(rows, labels)


@pytest.mark.parametrize("hot", [1, 4, 10 ** 9])
def test_audit_with_one_text_on_most_rows(frame, monkeypatch, hot):
    """Copies are found the same whether the text travels by broadcast or not."""
    monkeypatch.setattr(audit, "HOT", hot)
    rows = [(i, "a" if i % 3 else "b", "same" if i % 10 else f"own {i}", None) for i in range(300)]
    got = told(audit.audit_filters(frame(rows), frame([], "node_id long, quality int, toxic int")))
    assert got == brute_audit(rows, [])
    assert got["a", "EABCD", 1][1] + got["b", "EABCD", 1][1] == 269


def test_audit_other_filters_and_empty_table(frame, spark, tmp_path):
    labels = frame([], "node_id string, quality int, toxic int")
    t = saved_texts(spark, tmp_path)
    got = told(audit.audit_filters(t, labels, {"X": "words > 4", "Y": "marks > 0 and words > 6"}))
    assert len(got) == 3 * 4 and all(got[k, "YX", 2][1] + got[k, "YX", 1][1] == got[k, "XY", 1][1] for k in ("text", "llm", "image"))
    assert audit.audit_filters(t.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        audit.audit_filters(t, labels, {"X": "words > 4"})


@pytest.mark.parametrize("n", [2, 3, 5])
def test_shapley_of_any_game(n):
    """The least squares solution against the average over all orders."""
    rng = random.Random(n)
    v = [0] + [rng.randrange(-50, 1000) for _ in range((1 << n) - 1)]
    want = [Fraction(0)] * n
    for order in itertools.permutations(range(n)):
        s = 0
        for i in order:
            want[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    got = [sum(m * x for m, x in zip(row, v)) for row in audit.shapley_rows(n)]
    assert got == want and sum(got) == math.factorial(n) * v[-1]


# sharding

def plain_place(x, n, seed, shards):
    half = max(1, math.ceil(math.log2(n) / 2)) if n > 1 else 1
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for k in sharding.round_keys(seed):
            left, right = right, left ^ sharding.mixed((right + k) & sharding.WORD) & (1 << half) - 1
        x = right << half | left
        if x < n:
            return x % shards, x // shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 70000])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    p = sharding.permute(x, n, 9)
    assert sorted(p.tolist()) == x.tolist() and (sharding.permute(p, n, 9, back=True) == x).all()
    shard, slot = sharding.place_of(x, n, 7, 9)
    assert (sharding.row_at(shard, slot, n, 7, 9) == x).all()
    some = range(0, n, max(1, n // 50))
    assert [(int(shard[k]), int(slot[k])) for k in some] == [plain_place(k, n, 9, 7) for k in some]


def test_huge_numbers_of_rows():
    x, n = np.array([0, 1, 10 ** 18, 2 ** 62 - 2]), 2 ** 62 - 1
    p = sharding.permute(x, n, 1)
    assert len(set(p.tolist())) == 4 and (p < n).all() and (sharding.permute(p, n, 1, back=True) == x.astype(np.uint64)).all()


def test_shards(frame):
    rng = random.Random(2)
    rows = list(ODD) + [(i, "a", f"text {rng.randrange(50)}", None) for i in range(100, 400)]
    rng.shuffle(rows)
    out = sharding.assign_shards(frame(rows).repartition(5), 24, 3).collect()
    data = [(r[0], (r[2] or "").encode()) for r in rows]
    assert sorted((-1 if r.node_id is None else r.node_id, r.size, r.text_crc32) for r in out) == sorted((-1 if i is None else i, len(d) + 8, zlib.crc32(d)) for i, d in data)
    assert sorted(r.row_no for r in out) == list(range(len(rows)))
    ids = [r.node_id for r in sorted(out, key=lambda r: r.row_no)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert all((r.shard, r.slot) == plain_place(r.row_no, len(rows), 3, 24) for r in out)
    sizes = collections.Counter(r.shard for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k])) for k in sizes)


def key(r):
    return (-1 if r.node_id is None else r.node_id, r.size, r.text_crc32, r.shard, r.slot)


def test_shards_do_not_depend_on_partitions(frame, spark):
    rows = [(None if i % 3 == 0 else i, "a", "same" if i % 3 == 0 else f"t{i}", None) for i in range(600)]
    a = sorted(map(key, sharding.assign_shards(frame(rows).coalesce(1), 24).collect()))
    b = sorted(map(key, sharding.assign_shards(frame(rows[::-1]).repartition(9), 24).collect()))
    assert a == b
    ranges = sharding.in_ranges(frame(rows).repartition(4).select("node_id"), ["node_id"])
    assert ranges.filter("node_id is null").select("_part").distinct().count() > 1  # rows of one id lie in several ranges


def test_written_shards(frame, spark, tmp_path):
    rows = [(i, "a", f"text {i}", "s") for i in range(100)]
    sharding.write_shards(frame(rows), f"{tmp_path}/out", 5, files_per_shard=2)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.node_id, r.text, r.score) for r in out} == {(i, t, s) for i, _, t, s in rows}
    assert collections.Counter(r.shard for r in out) == {k: 20 for k in range(5)}
    assert sharding.assign_shards(frame([]), 24).collect() == []


def test_shards_of_saved_settings(spark, tmp_path):
    out = sharding.assign_shards(saved_texts(spark, tmp_path), 5).collect()
    assert len(out) == 12 and {r.node_id for r in out} == {f"n{k}" for k in range(12)}


# fill in the middle

def plain_infill(i, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def infill_rows():
    rng = random.Random(4)
    return list(ODD) + [(i, "a", "".join(rng.choice("<<PSM>é🦆ab \n") for _ in range(rng.choice([0, 1, 2, 9, 80]))), None) for i in range(10, 500)]


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_infill_and_back(block, monkeypatch):
    """Blocks of any size: characters, markers and pieces may lie across their borders."""
    monkeypatch.setattr(infill, "BLOCK", block)
    monkeypatch.setattr(infill, "BATCH", 5000)
    rows = [r for r in infill_rows() if len(r[2] or "") < 1000]
    digests = [hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in rows]
    names = ["node_id", "text"] + [f"_h{k}" for k in range(4)]
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows]), *[pa.array([int(d[8 * k:8 * k + 8], 16) for d in digests]) for k in range(4)]], names=names)
    got, back = [], []
    for part, data, offsets in infill.slices(b.slice(3), "text"):
        formed = infill.rearranged(part, data, offsets, 90, 20)
        got += formed.to_pylist()
        for p, d, o in infill.slices(formed, "output"):
            back += infill.put_back(p, d, o).to_pylist()
    assert [tuple(g[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")) for g in got] == [plain_infill(r[0], r[2]) for r in rows[3:]]
    assert back == [r[2] or "" for r in rows[3:]] and {g["form"] for g in got} == {"plain", "psm", "spm"}


def test_infill_on_spark(frame, spark, tmp_path):
    rows = infill_rows()
    out = infill.restore(infill.fill_in_middle(frame(rows).repartition(3))).collect()
    want = collections.Counter((r[0], *plain_infill(r[0], r[2]), r[2] or "") for r in rows)
    assert collections.Counter((r.node_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in out) == want
    assert infill.restore(infill.fill_in_middle(frame([]))).count() == 0
    saved = saved_texts(spark, tmp_path)
    assert {(r.node_id, r.text) for r in infill.restore(infill.fill_in_middle(saved)).collect()} == {(r.node_id, r.text) for r in saved.collect()}


# the registered queries on odd rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, n string, form string, repeated string, failed string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    rows, labels = audited_rows()
    spark.createDataFrame([(r[0], r[2], "en", r[1], 0, "q", "q", "q", "q", "q") for r in rows], DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_queries(spark, folder):
    rows, labels = audited_rows()
    assert told(QUERIES["op11_filter_audit"](spark, folder), "part") == brute_audit([(r[0], r[1] or "", r[2], None) for r in rows], labels)
    shards = QUERIES["op12_sharding"](spark, folder).collect()
    assert len(shards) == len(rows) and {r.law for r in shards} == {"rows"} and {r.grown_shard for r in shards} == {None}
    got = QUERIES["op13_fill_in_middle"](spark, folder).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter((r[0], *plain_infill(r[0], r[2])[:4], sha(plain_infill(r[0], r[2])[4]), sha(r[2] or "")) for r in rows)
    assert collections.Counter(map(tuple, got)) == want
