"""Toxicity of text outputs: misspelled lexicon terms by an automaton, weighed by their context.

The lexicon is a trie; a Levenshtein automaton of one edit runs along it, and both are made one
deterministic automaton, so every word is read once whatever the size of the lexicon. Words of a
batch are read side by side, letter by letter; nearly all of them leave the automaton
after a few letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms in a lexicon end in "$" if the word ends there; others are stems of words.
END = "$"
#: Whole words at least this long are also found with one letter changed, added, left out.
FUZZY_FROM = 5
#: Least rows times log odds of a term; rarer or less telling beginnings of words are chance.
EVIDENCE = 14.0
#: Characters of context on each side of a hit.
WINDOW = 80
#: Marks that open and close a quotation, words that report speech, words that address the reader.
QUOTES = (("\"", "\""), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"))
REPORTS = frozenset("said says wrote called quote quoted quoting reported stated word dit appelé cité sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your you're youre u ur tu te toi vous votre du dich dein deine ihr euch tú usted te vuestro".split())

#: Used when the labels hold only one class.
DEFAULT_TERMS = tuple((w + END, 4.0) for w in "idiot moron stupid pathetic worthless loser scum trash disgusting".split())
FEATURES = ["abuse", "fuzzy", "quoted", "hits"]


@dataclass(frozen=True)
class ToxicModel:
    """``terms`` with their log odds, ``weights`` of the features and a bias."""

    terms: tuple[tuple[str, float], ...] = DEFAULT_TERMS
    weights: tuple[float, ...] = (1.5, 1.0, 0.3, 0.5)
    bias: float = -3.5


@dataclass
class Automaton:
    """Deterministic: ``step[state, letter class]``, ``accept[state]`` (2 exact, 1 one edit, 0 none); state 0 is dead, 1 starts."""

    terms: tuple[str, ...]
    letters: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        trie: list[dict[str, int]] = [{}]
        whole, stem, deep = set(), set(), {0: 0}
        for t in self.terms:
            at = 0
            for c in t.removesuffix(END):
                if c not in trie[at]:
                    trie.append({})
                    trie[at][c] = len(trie) - 1
                    deep[len(trie) - 1] = 0
                at = trie[at][c]
            (whole if t.endswith(END) else stem).add(at)
        # nodes that lead to a term which may be misspelled
        def mark(node: int, depth: int) -> bool:
            fuzzy = any([mark(n, depth + 1) for n in trie[node].values()]) or (node in whole and depth >= FUZZY_FROM)
            deep[node] = int(fuzzy)
            return fuzzy
        mark(0, 0)
        self.letters = {c: k + 2 for k, c in enumerate(sorted({c for n in trie for c in n}))}

        def closed(items: set[tuple[int, int]]) -> frozenset:
            """With letters of the term left out; a place reached without an error needs no other."""
            out = set(items)
            for node, e in items:
                if e == 0:
                    out |= {(n, 1) for n in trie[node].values() if deep[n]}
            return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

        def read(state: frozenset, c: str | None) -> frozenset:
            out: set[tuple[int, int]] = set()
            for node, e in state:
                if c in trie[node]:
                    out.add((trie[node][c], e))
                if e == 0 and deep[node]:
                    out.add((node, 1))  # a letter too many
                    out |= {(n, 1) for n in trie[node].values() if deep[n]}  # another letter
            return closed(out)

        hit = frozenset([(-1, 0)])
        first = closed({(0, 0)})
        index, todo, rows = {frozenset(): 0, first: 1, hit: 2}, [first], {0: None, 2: None}
        while todo:
            s = todo.pop()
            row = []
            for c in (None, *self.letters):
                n = read(s, c)
                if any(e == 0 and node in stem for node, e in n):
                    n = hit
                if n not in index:
                    index[n] = len(index)
                    todo.append(n)
                row.append(index[n])
            rows[index[s]] = row
        self.step = np.zeros((len(index), len(self.letters) + 2), dtype=np.int32)
        self.accept = np.zeros(len(index), dtype=np.int8)
        for s, k in index.items():
            if rows[k]:
                self.step[k, 1:] = rows[k]
            ends = [e for node, e in s if node in whole and (e == 0 or deep[node])]
            self.accept[k] = 2 if 0 in ends else 1 if ends else 0
        self.step[2, 1:], self.accept[2] = 2, 2
        kinds = np.zeros(0x3000, dtype=np.uint8)  # beyond it nothing is a letter
        for i in range(len(kinds)):
            if chr(i).isalpha():
                kinds[i] = self.letters.get(chr(i), 1)
        self.kinds = kinds

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, accept) of the words that hit, of a lower-cased text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = np.zeros(len(codes) + 1, dtype=np.uint8)
        low = codes < len(self.kinds)
        kind[:-1] = np.where(low, self.kinds[np.where(low, codes, 0)], 0)
        letter = kind > 0
        turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            turn = np.concatenate([[0], turn])
        starts, ends = turn[0::2], turn[1::2]
        word, state = np.arange(len(starts)), np.ones(len(starts), dtype=np.int32)
        got_word, got_kind, j = [], [], 0
        while len(word):
            at = starts[word] + j
            state = self.step[state, kind[at]]
            over = ends[word] == at + 1
            done = over & (self.accept[state] > 0)
            got_word.append(word[done])
            got_kind.append(self.accept[state[done]])
            live = ~over & (state > 0)
            word, state, j = word[live], state[live], j + 1
        w = np.concatenate(got_word) if got_word else np.zeros(0, dtype=np.int64)
        k = np.concatenate(got_kind) if got_kind else np.zeros(0, dtype=np.int8)
        return starts[w], ends[w], k


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in a quotation or in reported speech, not turned to the reader."""
    before, after = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    near = re.findall(r"[^\W\d_]+", before)[-6:]
    for left, right in QUOTES:
        inside = before.count(left) % 2 == 1 if left == right else before.rfind(left) > before.rfind(right)
        if inside and right in after:
            return True
    return any(w in REPORTS for w in near) and not any(w in ADDRESS for w in near[-3:])


def one_edit(a: str, b: str) -> bool:
    """Whether two different words are one letter apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def term_weight(word: str, exact: bool, terms: dict[str, float]) -> float:
    """Log odds of the term that a hit stands for: the word, its longest stem, or the best word one edit away."""
    if exact:
        return terms.get(word + END) or next(terms[word[:n]] for n in range(len(word), 0, -1) if word[:n] in terms)
    return max((w for t, w in terms.items() if t.endswith(END) and one_edit(word, t[:-1])), default=0.0)


def features_of(texts: list[str | None], auto: Automaton, terms: dict[str, float]) -> np.ndarray:
    """(texts, FEATURES): logs of the summed odds of the different terms that abuse, of misspelled and of quoted ones, and of the number of hits."""
    out = np.zeros((len(texts), len(FEATURES)))
    low = [(t or "").lower() for t in texts]
    k = 0
    while k < len(low):
        stop, size = k, 0
        while stop < len(low) and (stop == k or size + len(low[stop]) < 1 << 21):  # texts read side by side
            size += len(low[stop]) + 1
            stop += 1
        base = np.cumsum([0] + [len(t) + 1 for t in low[k:stop]])
        met: set[tuple[int, int, str]] = set()
        for s, e, a in zip(*(x.tolist() for x in auto.hits(" ".join(low[k:stop])))):
            row = int(np.searchsorted(base, s, side="right")) - 1
            s, e, own = s - int(base[row]), e - int(base[row]), low[k + row]
            c = 2 if is_quoted(own, s, e) else 0 if a == 2 else 1
            out[k + row, 3] += 1
            if (row, c, own[s:e]) not in met:
                met.add((row, c, own[s:e]))
                out[k + row, c] += term_weight(own[s:e], a == 2, terms)
        k = stop
    return np.log1p(out)


def learn_terms(sample: DataFrame, limit: int = 400) -> tuple[tuple[str, float], ...]:
    """Terms of the toxic rows of ``sample(text, toxic)`` with their log odds: words and stems that clean rows hardly hold.

    Counted are the rows of each class that hold a beginning of a word (four to twelve letters, or the
    whole word). A beginning is kept if at least four and one in 150 of the toxic rows hold it and its share of them is ten
    times its share of the clean rows, and made longer while it keeps 95 % of its rows; the ``limit`` of most
    evidence stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        word = re.compile(r"[^\W\d_]+")
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = {w + END for w in word.findall((text or "").lower())}
                count[int(toxic)].update({w[:n] for w in words for n in range(4, min(len(w), 13) + 1)})
        both = list(count[0].keys() | count[1].keys())
        for s in range(0, len(both), 50_000):
            part = both[s:s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([count[1][w] for w in part], pa.int64()), pa.array([count[0][w] for w in part], pa.int64())], names=["term", "bad", "good"])

    n = sample.agg(F.count("*").alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if not 0 < n["bad"] < n["rows"]:
        return ()
    odds = F.log(((F.col("bad") + 0.5) / (n["bad"] + 1)) / ((F.col("good") + 0.5) / (n["rows"] - n["bad"] + 1)))
    counts = sample.select("text", "toxic").mapInArrow(run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = counts.withColumn("odds", odds).filter((F.col("bad") >= max(4, n["bad"] // 150)) & (F.col("odds") >= float(np.log(10))) & (F.col("bad") * F.col("odds") >= EVIDENCE))
    rows = {r["term"]: (r["bad"], r["odds"]) for r in counts.orderBy((F.col("bad") * F.col("odds")).desc(), "term").limit(20 * limit).collect()}
    best: dict[str, str] = {}  # beginning -> the longest one that keeps its rows
    for t in sorted(rows, key=len, reverse=True):
        grown = [best[t + c] for c in sorted({w[len(t)] for w in rows if len(w) > len(t) and w.startswith(t)}) if t + c in best]
        grown = [x for x in grown if rows[x][0] >= 0.95 * rows[t][0]]
        best[t] = max(grown, key=lambda x: rows[x][0]) if grown else t
    kept: dict[str, float] = {}
    for t in sorted(set(best.values()), key=lambda x: (-rows[x][0] * rows[x][1], len(x), x)):
        if len(kept) < limit and not any(t.startswith(k) for k in kept):
            kept[t] = float(rows[t][1])
    return tuple(sorted(kept.items()))


def fit_model(texts: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> ToxicModel:
    """A model from ``labels(node_id, toxic)`` of ``texts(node_id, text)``.

    It is fitted on at most about ``sample_rows`` labelled rows, those with the smallest hashes of their ids
    (all, if there are fewer); the ids of that many rows are broadcast. Without rows of both classes the default model stands.
    """
    lab = labels.filter(F.col("toxic").isin(0, 1) & F.col("node_id").isNotNull()).groupBy("node_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = lab.count()
    slots = 1 << 30
    part = lab.filter(F.pmod(F.xxhash64("node_id"), F.lit(slots)) < int(slots * min(1.0, sample_rows / max(1, n))))
    sample = texts.select("node_id", "text").join(F.broadcast(part), "node_id")
    terms = learn_terms(sample)
    if not terms:
        return ToxicModel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(tuple(t for t, _ in terms))
        for b in batches:
            x = features_of(b.column("text").to_pylist(), auto, dict(terms))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(len(FEATURES))] + [b.column("toxic").cast(pa.int32())], names=[*FEATURES, "toxic"])

    got = sample.select("text", "toxic").mapInArrow(run, ", ".join(f"{c} double" for c in FEATURES) + ", toxic int").toPandas()
    x = np.c_[got[FEATURES].to_numpy(), np.ones(len(got))]
    y = got["toxic"].to_numpy()
    if not 0 < y.sum() < len(y):
        return ToxicModel(terms=terms)
    w, ridge = np.zeros(x.shape[1]), np.diag([0.5] * len(FEATURES) + [1e-3])
    for _ in range(50):  # Newton's steps for the logistic loss with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return ToxicModel(terms, tuple(float(v) for v in w[:-1]), float(w[-1]))


def score_toxicity(texts: DataFrame, model: ToxicModel) -> DataFrame:
    """All columns of ``texts(node_id, text, ...)`` and ``score`` (0 to 1, higher: likelier toxic), ``predicted``.

    The score is a logistic function of four features of the whole text: the odds of the lexicon terms that abuse,
    of misspelled ones, of quoted ones, and the number of hits. Nothing but the text is read. Null and empty texts
    score like texts without a hit. Rows are neither dropped nor joined: repeated rows score alike, null ids stay, an
    empty table gives no rows, columns named like the new ones are replaced. ``predicted`` is 1 from 0.5 on.
    """
    w, bias, terms = np.array(model.weights), model.bias, model.terms
    kept = texts.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(tuple(t for t, _ in terms))
        for b in batches:
            z = features_of(b.column("text").to_pylist(), auto, dict(terms)) @ w + bias
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*b.schema.names, "score"])

    from pyspark.sql import types as T

    out = kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
