"""Operators on text outputs of nodes, held against plain Python on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from pixelweave.llm import chat, line_dedup, mixing, packing, secrets, simhash, toxicity
from pyspark.sql import functions as F

TEXTS = "node_id long, node_type string, text string, score string"
ODD = [(None, None, None, "x"), (1, "llm", None, "x"), (2, "llm", "", "x"), (3, "text", "a", "x"), (3, "text", "a", "x"), (4, "text", " \n\t ", None), (5, "text", "long " * 20000, "x")]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, TEXTS)


def words(n, seed, vocabulary=300):
    rng = random.Random(seed)
    return [f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n)]


# line dedup

def brute_lines(rows, t, least):
    """(node_id, line number) of lines that an earlier line matches."""
    lines = []
    for i, text in sorted({(r[0], r[2]) for r in rows if r[2] is not None}, key=lambda x: (x[0] is not None, x[0])):
        for k, line in enumerate(text.split("\n")):
            w = {x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", line)}
            lines.append((i, k, w))
    lines = [x for x in lines if len(x[2]) >= least]
    return {(i, k) for n, (i, k, w) in enumerate(lines) if any(len(w & v) >= t * len(w | v) - 1e-12 for _, _, v in lines[:n])}


def near_lines(seed):
    rng = random.Random(seed)
    base = [words(rng.choice([3, 5, 8, 12, 20, 45]), rng.random()) for _ in range(30)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(5):
            w = list(rng.choice(base)) if rng.random() < 0.6 else words(rng.choice([5, 9, 30]), rng.random())
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", f"v{rng.randrange(99)}"])
            text.append(" ".join(w))
        rows.append((i, "text", "\n".join(text), "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(frame, seed):
    rows = near_lines(seed)
    got = {(r.node_id, r.line_no) for r in line_dedup.repeated_lines(frame(rows)).collect()}
    want = brute_lines(rows, 0.8, 5)
    assert got == want and len(want) > 20


def test_line_dedup_removes_only_lines(frame):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "short line"
    rows = [(1, "t", f"{a}\n{c}", "x"), (2, "t", f"{b}\n{a}\n{c}", "y"), (3, "t", a.upper(), None)]
    got = {r.node_id: r for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [f"{a}\n{c}", f"{b}\n{c}", ""]
    assert got[2].lines_removed == 1 and got[2].score == "y" and got[3].lines_removed == 1


def test_line_dedup_odd_rows(frame, spark):
    out = line_dedup.dedup_lines(frame(ODD)).collect()
    assert sorted((r.node_id or 0, r.text or "") for r in out) == sorted((r[0] or 0, r[2] or "") for r in ODD)
    assert line_dedup.dedup_lines(frame([])).count() == 0


def test_line_words_are_ordered_by_counts(frame):
    """Not only the most frequent words: 6 000 that stand four times each come after some that stand once."""
    often, seldom = [f"often{k}" for k in range(6000)], [f"seldom{k}" for k in range(5)]
    df = frame([(k, "t", " ".join(often[k::10]), "x") for k in range(10)] * 4 + [(10, "t", " ".join(seldom), "x")])
    levels = line_dedup.word_levels(df)
    line = df.limit(1).select(line_dedup.ranked(F.lit(" ".join(often[:30] + seldom)), levels).alias("all"), line_dedup.ranked(F.lit(" ".join(seldom)), levels).alias("few")).first()
    assert len(line["all"]) == 35 and line["all"][:5] == line["few"]


def test_line_words_fold_only_a_to_z(spark):
    some = ["ab", "AB", "\u00e9", "\u00c9", "e\u0301", "E\u0301", "\u00e3", "\u00c3", "\u00d7", "\u00f7", "stra\u00dfe", "STRASSE", "i", "\u0130", "\u0131", "k", "\u212a", "\u041f", "\u043f", "\u3249", "\uff21", "\uff41", "\U00010400", "\U00010428"]
    got = spark.createDataFrame([(w,) for w in some], "w string").select("w", line_dedup.words_of(F.col("w"))[0].alias("a"), line_dedup.folded(F.col("w")).alias("b")).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len({(r.a, r.b) for r in got}) == len(some) - 2  # ab, and e with its accent apart


def test_lines_of_large_kinds(frame):
    """Kinds of more and of fewer lines than are settled against their first lines, white space of all sorts, accents that differ."""
    base = [words(12, 70 + k, 4000) for k in range(3)]
    rows = []
    for k in range(3 * line_dedup.LEAD_LINES):
        w = list(base[0] if k % 3 else base[1] if k % 2 else base[2])
        w[k % 12] = f"own{k}" if k % 4 else "\u00c9t\u00e9" if k % 8 else "\u00e9t\u00e9"
        rows.append((k, "text", f"\t{w[0]}\r" + "  ".join(w[1:]).upper() + "\n" + " ".join(words(7, 900 + k, 4000)), "x"))
    got = {(r.node_id, r.line_no) for r in line_dedup.repeated_lines(frame(rows)).collect()}
    want = brute_lines_a_to_z(rows, 0.8, 5)
    assert got == want and len(want) > 60


def brute_lines_a_to_z(rows, t, least):
    lower = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    lines = [(i, k, set(re.findall(r"[^\x20\x09-\x0D]+", line.translate(lower)))) for i, _, text, _ in rows for k, line in enumerate(text.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    return {(i, k) for n, (i, k, w) in enumerate(lines) if any(len(w & v) >= t * len(w | v) - 1e-12 for _, _, v in lines[:n])}


# chats

EVENTS = "node_id long, seq long, kind string, turn long, role string, text string, loss string"


def test_chat_fold(spark):
    e = [(1, 0, "message", 0, "user", "hi", ""), (1, 1, "delta", 1, "assistant", "He", ""), (1, 2, "delta", 1, None, "llo", ""), (1, 3, "message", 2, "user", "bye", ""),
         (1, 4, "delta", 3, "assistant", "x", ""), (1, 5, "regenerate", 1, None, None, ""), (1, 6, "delta", 1, "assistant", "New", ""), (1, 7, "edit", 0, None, "hello", ""),
         (2, 0, "delta", 0, "user", "a", ""), (2, 1, "edit", 0, "user", "b", ""), (2, 2, "delta", 0, "user", "c", ""), (2, 1, "edit", 0, "user", "b", ""), (3, 0, None, None, None, None, ""), (None, 0, "message", 0, "user", "q", "")]
    got = sorted((r.node_id or 0, r.turn or 0, r.role, r.text) for r in chat.fold_events(spark.createDataFrame(e, EVENTS)).collect())
    assert got == [(0, 0, "user", "q"), (1, 0, "user", "hello"), (1, 1, "assistant", "New"), (2, 0, "user", "bc"), (3, 0, "", "")]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\\<|im_start|>", "\\", "\\\\<s>\\/s>", "<<|im_sep|>", "", "é\n[INST", "[[/INST]]\\n", "x" * 5000]
    rows = [(n, i, "message", i, "assistant" if i % 2 else "us<|er", t, "") for n in range(3) for i, t in enumerate(texts[n:] + texts[:n])]
    out = chat.format_chats(spark.createDataFrame(rows, EVENTS))
    out = out.select("node_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("under")).collect()
    for r in out:
        want = texts[r.node_id:] + texts[:r.node_id]
        assert [t.text for t in r.turns] == want and [t.role for t in r.turns] == ["assistant" if i % 2 else "us<|er" for i in range(len(want))]
        assert r.under == "".join(want[1::2])
        assert not re.search(r"</?s>|\[/?INST\]", r.formatted) and r.formatted.count("<|im_end|>") == len(want)
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


# packing

def test_plan_is_best_fit_of_every_piece():
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 1025), 300)}
    rooms = []  # one piece after the other
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 1024) - length)
    place = {}
    for length, rank, n, seq, offset in packing.plan(counts, 1024):
        for k in range(n):
            place.setdefault(seq + k, []).append((offset, length))
        counts[length] -= n
    assert not any(counts.values())
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(place) == list(range(len(rooms)))


def test_packing(frame):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", "a <|endoftext|> b", " ".join(words(3000, 1)), "Éèç it's 12 \n\n  x", "same", "same", "日本 😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    rows = [(i, "t", t, "x") for i, t in enumerate(texts)]
    out = packing.pack_texts(frame(rows), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in out if r.node_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert packing.pack_texts(frame([]), P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack_texts(frame(ODD), P.path("byte_bpe_50k.json")).select("node_id").count() >= len(ODD)


# mixing

def fill(totals, share):
    """Targets by sharing the excess again and again."""
    order = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, out = sum(totals.values()) * share, {}
    free = set(order)
    while free:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if part[s] > 2 * totals[s]]
        if not above:
            return out | part
        for s in above:
            out[s] = 2 * totals[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(frame):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", "c", None, "é"]), " ".join(words(rng.randrange(0, 60), i)), "x") for i in range(900)] + [(1000, "empty", "", "x"), (None, "hot", "one two", "x")]
    out = mixing.mix_sources(frame(rows)).collect()
    totals = {}
    for r in out:
        totals[r.node_type] = totals.get(r.node_type, 0) + r.size
    want = fill(totals, 1.5)
    assert len(out) == len(rows)
    for s in totals:
        mine = [r for r in out if r.node_type == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == totals[s] for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target + 1e-9) and all(0 <= r.taken <= 2 * r.size for r in mine)
        if totals[s]:  # whole epochs and one cut text
            assert len({r.taken / r.size for r in mine if r.size} - {0, 1, 2}) <= 1
    again = mixing.mix_sources(frame(rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix_sources(frame([])).count() == 0
    assert mixing.mix_sources(frame(ODD)).count() == len(ODD)


def test_mixing_given_weights(frame, spark):
    rows = [(i, "ab"[i % 2], "one two three", "x") for i in range(100)]
    out = mixing.mix_sources(frame(rows), spark.createDataFrame([("a", 1), ("b", 3)], "node_type string, weight int"), share=0.5).collect()
    got = {s: sum(r.taken for r in out if r.node_type == s) for s in "ab"}
    assert got == {"a": 37, "b": 112}


# simhash

def plain_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(frame):
    rng, rows = random.Random(8), list(ODD[1:4] + ODD[5:])
    for i in range(10, 60):
        base = words(400, i % 12)
        for _ in range(rng.choice([0, 0, 1, 2])):
            base[rng.randrange(400)] = "x"
        rows.append((i, "t", " ".join(base), "x"))
    out = simhash.simhash_groups(frame(rows)).collect()
    prints = {r[0]: plain_print(r[2]) for r in rows}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = min(root[a], root[b])
    assert len(out) == len(rows) and all(int(r.fingerprint, 16) == prints[r.node_id] and len(r.fingerprint) == 16 for r in out)
    assert {r.node_id: r.component_id for r in out} == root and len(set(root.values())) < len(root)
    assert simhash.simhash_groups(frame([])).count() == 0
    assert simhash.simhash_groups(frame(ODD)).count() == len(ODD)


def test_simhash_large_keys_and_chains(spark):
    """Prints that all share keys, in chains of two bits, over several blocks."""
    rng = np.random.default_rng(1)
    prints = [0]
    for _ in range(2500):
        p = prints[rng.integers(max(0, len(prints) - 40), len(prints))]
        prints.append(int(p) ^ (1 << int(rng.integers(0, 16))) ^ (1 << int(rng.integers(0, 16))))
    prints = sorted(set(prints)) + [((1 << 64) - 1) ^ (0xFF << 20)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fingerprint long, node long"), 2, 4)
    got = {r.node: r.root for r in simhash.connected(links).collect()}
    a = np.array(prints, dtype="u8")
    root = np.arange(len(a))
    while True:
        new = np.array([root[np.bitwise_count(a ^ x) <= 2].min() for x in a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    assert [got.get(i, i) for i in range(len(a))] == root.tolist()


def test_bit_sliced_pairs():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 8, 300).astype("u8") << np.uint64(28)
    for radius in (0, 1, 2, 3):
        i, j = simhash.near_pairs(a, np.zeros(300, dtype=np.int64), np.full(300, 300), radius)
        want = {(x, y) for x in range(300) for y in range(x) if int(a[x] ^ a[y]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


# secrets

def plain_spans(text):
    out = []
    for k, r in enumerate(secrets.RULES):
        out += [(m.start(), k, r.kind, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return [(s, kind, e) for s, _, kind, e in sorted(out)]


def test_secrets(frame):
    rng = random.Random(4)
    parts = ["password", "API_KEY", "apikey", "Token", "secret", "passwd", " = ", ":", "\"", "'", "=", "abcdefgh12", "short", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef" * 4, " ", "\n", "é", "😀", "ghp_", "A1" * 20, "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, "t", "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))), "x") for i in range(300)]
    rows += [(7, "t", "token=secret: abcdefgh12", "x"), (8, "t", "token: key1 password=abcdefghij", "x"), (None, "t", "secret = 'abcd/efgh=='", "x")] + ODD
    out = secrets.find_secrets(frame(rows)).collect()
    got = sorted(str((r.node_id, [(s.start, s.kind, s.end) for s in r.spans])) for r in out)
    want = sorted(str((r[0], plain_spans(r[2]))) for r in rows)
    assert got == want and sum(len(r.spans) for r in out) > 100
    assert secrets.find_secrets(frame([])).count() == 0


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is True
    assert q["access"] == ("and", frozenset({"aki", "kia"}))
    assert ("and", frozenset({"tok", "oke", "ken"})) in q["assign"][1]
    assert secrets.trigram_query("ab|cde") is True and secrets.trigram_query("(?:abcd)+x") == ("and", frozenset({"abc", "bcd"}))


def test_index_lists_postings(frame):
    index = secrets.trigram_index(frame([(1, "t", "AKIA", "x"), (2, "t", "kia", "x"), (3, "t", None, "x")]), ["aki", "kia"])
    assert sorted((r.trigram, r.node_id) for r in index.collect()) == [("aki", 1), ("kia", 1), ("kia", 2)]


# toxicity

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_levenshtein():
    auto = toxicity.Automaton(("moron$", "idiot$", "scum$", "lowei", "stupid$"))
    rng = random.Random(6)
    letters = "moridtscupelwa"
    tested = set()
    for _ in range(4000):
        w = list(rng.choice(["moron", "idiot", "scum", "lowei", "stupid", "loweix"]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)]])
        tested.add("".join(w) or "a")
    tested = sorted(tested)
    start, end, kind = auto.hits(" ".join(tested))
    got = dict(zip(start.tolist(), kind.tolist()))
    at = 0
    for w in tested:
        exact = w in ("moron", "idiot", "scum", "stupid") or w.startswith("lowei")
        fuzzy = any(edits(w, t) <= 1 for t in ("moron", "idiot", "stupid"))
        assert got.get(at, 0) == (2 if exact else 1 if fuzzy else 0), w
        at += len(w) + 1


def test_one_edit():
    words = ["a", "ab", "abc", "acb", "abd", "xabc", "abcx", "bc", "axbc", "abxx"]
    for a in words:
        for b in words:
            if a != b:
                assert toxicity.one_edit(a, b) == (edits(a, b) == 1), (a, b)


def test_toxicity_learns_and_scores(frame, spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        w = words(rng.randrange(5, 120), i)
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "blorfen", "Moron,"])
        rows.append((i, "t", " ".join(w), "x"))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels, "node_id long, toxic int")
    model = toxicity.fit_model(frame(rows), lab.filter("node_id % 5 != 0"))
    assert {"idiot$", "moron$"} <= {t for t, _ in model.terms}
    more = [(-1, "t", "you absolute idoit and mooron, idiot", "x"), (-2, "t", "He said: \"idiot\" is a word.", "x"), *ODD]
    out = toxicity.score_toxicity(frame(rows + more), model)
    assert out.columns == ["node_id", "node_type", "text", "score", "predicted"]
    got = out.collect()
    by = {r.node_id: r for r in got}
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([by[i].predicted == t for i, t in labels if i % 5 == 0]) > 0.97
    assert by[2].predicted == 0 and by[-2].score < by[-1].score
    assert toxicity.score_toxicity(frame([]), model).count() == 0


def test_toxicity_without_labels(frame, spark):
    model = toxicity.fit_model(frame(ODD), spark.createDataFrame([], "node_id long, toxic int"))
    assert model == toxicity.ToxicModel()


def test_digest_of_sha(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
