"""The five stages on a small table, and on odd rows."""

import random
import re

import numpy as np
import pytest
from test_texts import brute_lines, plain_print, words

import corpus_pipeline as cp
from __spark_entry__ import queries
from pixelweave.llm import line_dedup, mixing, near_copies, queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """150 documents: a third toxic, lines and whole texts that repeat, near copies, odd rows."""
    rng, base, rows, labels = random.Random(3), str(tmp_path_factory.mktemp("sf")), [], []
    shared = [" ".join(words(20, -k, 5000)) for k in range(6)]
    for i in range(140):
        lines = [" ".join(words(rng.randrange(6, 60), (i, k).__hash__(), 5000)) for k in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.append(" ".join(rng.choice(["you", "idiot", "moron", "scum"]) for _ in range(12)))
        if i % 5 == 1:
            lines.insert(0, shared[i % 6])
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}" if i % 7 else "hot"))
        labels.append((i, 1, int(i % 3 == 0)))
    long = words(400, 77, 5000)
    for i in range(140, 146):  # near copies: one long line, of which a third of the words is new each time, is no line match
        rows.append((i, "\n".join(" ".join(long[k:k + 4]) for k in range(0, 400 - (i - 140) % 2 * 4, 4)), "en", "s1"))
    rows += [(146, None, None, None), (147, "", "en", "s2"), (148, rows[1][1], "fr", "s3"), (149, " \n ", "en", "s0")]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows_of(docs)

    clean = spark.createDataFrame(cp.drop_toxic(spark, docs, folder).collect(), DOCS)
    kept = rows_of(clean)
    assert set(kept) == {i for i in before if i >= 140 or i % 3} and all(kept[i] == before[i] for i in kept)

    lines = spark.createDataFrame(cp.drop_lines(spark, clean, folder).collect(), DOCS)
    got, gone = rows_of(lines), brute_lines([(r.doc_id, "", r.text) for r in kept.values()], 0.8, 5)
    for i, r in kept.items():
        text = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (i, k) not in gone)
        if text != r.text and not (text or "").strip():
            assert i not in got
        else:
            assert got[i].text == text and got[i].n_chars == len(text or "")
    assert gone and 148 not in got

    near = spark.createDataFrame(cp.drop_near_copies(spark, lines, folder).collect(), DOCS)
    prints = {i: plain_print(r.text) for i, r in got.items()}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            root[a] = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
    assert set(rows_of(near)) == {i for i in root if root[i] == i} and len(rows_of(near)) < len(got)

    one = rows_of(near)
    mixed = cp.mix(spark, near, folder).collect()
    taken = {r.node_id: r.taken for r in mixing.mix_sources(cp.as_texts(near)).collect()}
    count = {}
    for r in mixed:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        count[r.doc_id] = count.get(r.doc_id, 0) + n
        assert one[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text) and r.source == one[r.doc_id].source
    assert count == {i: n for i, n in taken.items() if n}

    packed = cp.pack(spark, spark.createDataFrame(mixed, DOCS), folder).collect()
    assert {r.doc_id for r in packed} == set(count) and sum(r.piece == 0 for r in packed) == len(mixed)
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 for p in used.values())


def test_run_is_the_stages(spark, folder):
    assert [k for k, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    out = queries()["pipeline"](spark, folder)
    assert out.count() > 50 and "sequence_id" in out.columns


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_on_odd_rows(spark, folder, stage):
    odd = [(None, None, None, None, None, 1), (1, None, "en", "s", 0, 1), (2, "", "en", None, 0, 1), (3, "a b", None, "s", 3, 1), (3, "a b", None, "s", 3, 1), (4, "w " * 30000, "en", "s", 60000, 1), (None, "x y z", "en", "s", 5, 1)]
    df = spark.createDataFrame(odd, DOCS + ", score int")
    out = stage(spark, df, folder)
    got = out.collect()
    if stage is not cp.pack:
        assert set(DOCS.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
        assert {4} <= {r.doc_id for r in got}
    assert stage(spark, df.limit(0), folder).count() == 0


def test_every_operator_has_a_query():
    names = set(q.QUERIES)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and names | {"pipeline"} <= set(queries())


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def similar_rows():
    """Copies with words replaced, on both sides of a similarity of 0.8; groups, short and wordless texts."""
    rng, rows = random.Random(5), []
    for k in range(40):
        base = words(rng.choice([70, 150, 400]), 1000 + k, 9000)
        for _ in range(6 if k else 30):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 9])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    return rows + [(len(rows) + k, t, "en", "s", 0) for k, t in enumerate([None, "", "a b", "A  b", "a c", rows[7][1]])] + [(None, rows[0][1], "en", "s", 0)] * 2


def test_similar_texts_against_brute_force(spark, monkeypatch):
    rows = similar_rows()
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}
    near = [(i, j) for i in sets for j in sets if j < i and jaccard(sets[i], sets[j]) >= 0.8]
    for _ in range(8):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    want = {(i, r) for i, r in root.items() if i != r}
    df = spark.createDataFrame(rows, DOCS)
    for block in (near_copies.BLOCK_ROWS, 4):
        monkeypatch.setattr(near_copies, "BLOCK_ROWS", block)
        assert {tuple(r) for r in near_copies.near_copies(cp.as_texts(df)).collect()} == want and len(want) > 80
    kept = [r.doc_id for r in dict(cp.STAGES)["simhash"](spark, df, "").collect()]
    assert not [1 for i in kept for j in kept if None not in (i, j) and j < i and (i, j) in set(near)] and kept.count(None) == 2


def test_block_links():
    sets = [near_copies.shingle_set(r[1], 5) for r in similar_rows()[:60]]
    node = np.random.default_rng(1).permutation(1000)[:60]
    root = {i: i for i in node.tolist()}
    for _ in sets:
        for i, a in zip(node.tolist(), sets):
            for j, b in zip(node.tolist(), sets):
                if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                    root[i] = min(root[i], root[j])
    a, b = near_copies.block_links(sets, node, 0.8)
    assert dict(zip(a.tolist(), b.tolist())) == {i: r for i, r in root.items() if i != r}


def test_mix_takes_all_documents_without_an_id(spark):
    rows = [(None, " ".join(words(20 + k, k, 5000)), "en", f"s{k % 2}", k) for k in range(40)] + [(k, " ".join(words(30, 100 + k, 5000)), "en", "s0", k) for k in range(10)]
    rows += rows[:1] * 4 + [(None, None, "en", "s0", 0), (None, " ", "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOCS)
    whole = {r[1]: sum(x[1] == r[1] for x in rows) for r in rows if (r[1] or "").strip()}
    texts = [r.text for r in cp.mix(spark, df, "").collect()]
    sizes, taken = {"s0": 0, "s1": 0}, len(" ".join(texts).split())
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    assert all(whole[t] <= texts.count(t) <= 2 * whole[t] for t in whole)
    assert all(any(w.startswith(t) for w in whole) for t in texts)
    assert abs(taken - 1.5 * sum(sizes.values())) <= 2


def test_lines_of_documents_without_an_id(spark):
    """Each text loses its own lines, and what they lose is no one row of all texts."""
    a, b = (" ".join(words(9, 50 + k, 5000)) for k in range(2))
    rows = [(None, None, f"own {k}\n{a if k % 2 else b}\n{b}" + f"\nlast {k}", None) for k in range(12)]
    df = spark.createDataFrame(rows, "node_id long, node_type string, text string, score string")
    gone = line_dedup.repeated_lines(df).groupBy("node_id", "t").count().collect()
    assert len(gone) == 12  # one row a text
    out = sorted((r.text, r.lines_removed) for r in line_dedup.dedup_lines(df).collect())
    want = [(f"own {k}\n{a if k % 2 else b}\nlast {k}", 1) for k in range(12)]
    assert out == sorted(want)
