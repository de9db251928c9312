"""Operators on image signatures and result links, held against plain Python on small tables."""

import fnmatch
import random
import re

import numpy as np
import pytest

from pixelweave.llm import neighbours, topk, url_filter
from pyspark.sql import functions as F

# nearest images


def vectors(spark, a, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(a)), a)], "image_id long, signature array<double>")


def best(a, ids, q, k):
    s = a @ a[q] / (np.linalg.norm(a, axis=1) * np.linalg.norm(a[q]))
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(ids[i], s[i]) for i in order]


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((1500, 24))
    df = vectors(spark, a)
    got = {}
    for r in neighbours.nearest_images(df, df.filter("image_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.image_id, r.score))
    ids, hit = np.arange(len(a)), 0
    assert sorted(got) == list(range(0, 1500, 50))
    for q, rows in got.items():
        want = best(a, ids, q, 5)
        assert [x[0] for x in sorted(rows)] == [1, 2, 3, 4, 5] and q not in {x[1] for x in rows}
        hit += len({x[1] for x in rows} & {w[0] for w in want})
        for _, i, s in rows:
            assert abs(s - a[i] @ a[q] / np.linalg.norm(a[i]) / np.linalg.norm(a[q])) < 1e-12
    assert hit / (5 * len(got)) >= 0.9


def test_nearest_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 8))
    a[100:250] = a[100]  # half the table is one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(a)] + [(900, None), (901, [0.0] * 8), (902, [None] + [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] * 8), (905, [1.0]), (None, [1.0] * 8), (100, [float(x) for x in a[100]])]
    df = spark.createDataFrame(rows, "image_id long, signature array<double>")
    got = {}
    for r in neighbours.nearest_images(df, spark.createDataFrame([(0,), (100,), (150,), (900,), (999,)], "image_id long"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.image_id))
    assert sorted(got) == [0, 100, 150]
    assert [i for _, i in sorted(got[100])] == [101, 102, 103, 104, 105] and [i for _, i in sorted(got[150])] == [100, 101, 102, 103, 104]
    assert len(got[0]) == 5
    none = spark.createDataFrame([], df.schema)
    assert neighbours.nearest_images(none, none, 5).count() == 0
    three = vectors(spark, a[:3])
    assert neighbours.nearest_images(three, three, 5).count() == 6


# exact largest products

def levels(spark, rows):
    return spark.createDataFrame(rows, "image_id long, levels array<long>, rank string")


@pytest.mark.parametrize("scale", [50, 1 << 28])
def test_topk_is_exact(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 200)
    monkeypatch.setattr(topk, "PACK_ROWS", 7)
    rng = np.random.default_rng(2)
    a = rng.integers(-scale, scale + 1, (900, 6))
    a[300:500] = a[300]
    a[7] = 0
    df = levels(spark, [(i, v.tolist(), "x") for i, v in enumerate(a)] + [(950, None, "x"), (951, [1, None, 1, 1, 1, 1], "x"), (None, [1] * 6, "x")])
    asked = [*range(0, 900, 40), 7, 950]
    got = {}
    for r in topk.top_products(df, df.filter(F.col("image_id").isin(asked)), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.image_id, r.score))
    assert sorted(got) == sorted(asked[:-1])
    for q, rows in got.items():
        s = a @ a[q]
        order = [i for i in np.lexsort((np.arange(len(a)), -s)) if i != q][:10]
        assert sorted(rows) == [(k + 1, i, s[i]) for k, i in enumerate(order)]


def test_topk_small(spark):
    df = levels(spark, [(1, [1, 2], "x"), (2, [3, -1], "x"), (2, [3, -1], "x")])
    got = sorted((r.query_id, r["rank"], r.image_id, r.score) for r in topk.top_products(df, df, 10).collect())
    assert got == [(1, 1, 2, 1), (1, 2, 2, 1), (2, 1, 1, 1)]
    assert topk.top_products(levels(spark, []), df, 10).count() == 0 and topk.top_products(df, levels(spark, []), 10).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(3)
    a = (np.abs(rng.standard_normal((4000, 3))) ** 3 * 1000).astype(np.int64).astype(float)
    block = topk.Block(np.arange(4000), a)
    seen = []
    block.levels = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: (seen.append(len(k)), np.ndarray.__getitem__(self, k))[1]}).__call__(a.shape)
    block.levels[...] = a
    ids, _ = block.best(-1, np.array([1.0, 1.0, 1.0]), None, 10)
    assert ids.tolist() == np.lexsort((np.arange(4000), -a.sum(axis=1)))[:10].tolist() and sum(seen) < 2000


# links

def test_shift_and_is_a_glob_matcher():
    rng = random.Random(1)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["a" * 130, "**" + "b" * 70 + "*"]
    texts = ["".join(rng.choice("ab/éz") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["", "a" * 130, "x/" + "b" * 70, "b" * 71, "😀"]
    got = url_filter.ShiftAnd(globs).fits(texts)

    def plain(g):
        out = ""
        for part in re.findall(r"\*{2}|.", g, re.S):
            out += {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        return re.compile(out + r"\Z")

    want = np.array([[bool(plain(g).match(t)) for g in globs] for t in texts])
    assert (got == want).all() and want.any()
    assert fnmatch.fnmatchcase("ab", "a?") and url_filter.ShiftAnd(["a?"]).fits(["ab"])[0, 0]


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def plain_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(n, v) for v, n in RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.split("/", 1)[1])]
    return (host, path, *max(fit, key=lambda x: len(x[0]))) if fit else (host, path, None, None)


def test_links(spark):
    urls = [None, "", "no host", "http://", "http://NET/x", "https://a.b.Example.NET/en/1?x=/fr/#t", "http://example.net", "http://example.net?/en/", "ftp://example.com/de/x.exe", "http://notexample.com/de/", "http://example.com/de", "http://x.org/fr/", "http://org/fr/a",
            "http://a.org/x.net/en/", "http://É.net/", "http://a.net:80/", "://net/", "http://a/b\nc.net/", "http://files.example.com/a.zip", "http://x.org/" + "y" * 20000, "http://u@x.net/"] * 2
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "node_id long, url string, verdict string")
    out = url_filter.filter_links(df, [url_filter.site_rule(v, n) for v, n in RULES])
    assert out.columns == ["node_id", "url", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain_judge(r.url)
        method = "block" if host == "" or re.search(r"\.(exe|msi|apk|dmg|iso|zip|rar|7z)\Z", path) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or method), r.url
    assert url_filter.filter_links(df.limit(0), []).count() == 0
    assert {r.verdict for r in url_filter.filter_links(df, [], ()).collect()} == {"allow", "block"}


def test_topk_of_unequal_lengths(spark):
    """A shorter array counts as if zeros followed, empty ones too; no row is mixed with another."""
    rng = random.Random(12)
    rows = [(i, [rng.randrange(-9, 10) for _ in range(rng.choice([0, 1, 3, 4, 4, 4, 9]))]) for i in range(400)] + [(400, [5, 0, 0]), (401, [9] * 5000), (500, [1] * 5000)]
    t = spark.createDataFrame(rows, "image_id long, levels array<long>")
    got = {(r.query_id, r.rank): (r.image_id, r.score) for r in topk.top_products(t, t.filter("image_id % 50 = 0"), 6).collect()}
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:6]
            assert [got[q, k + 1] for k in range(6)] == [(i, -s) for s, i in scores]


def test_neighbours_keep_the_commonest_length(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    t = spark.createDataFrame([*good, (70, [1.0, 2.0, 3.0, 4.0]), (71, [1.0]), (72, [])], "image_id long, signature array<double>")
    got = neighbours.nearest_images(t, t.select("image_id"), 3).collect()
    assert {r.query_id for r in got} == set(range(60)) == {r.image_id for r in got} | set(range(60)) and len(got) == 180
