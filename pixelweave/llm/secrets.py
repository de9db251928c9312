"""Secrets in node settings and texts, found through a trigram index.

Saved graphs carry what users typed into their nodes, tokens of model services included. Every rule
is a regular expression. From it a Boolean query over trigrams is derived that every match satisfies;
the index holds, for the trigrams that any rule asks for, which texts contain them; a rule is verified only on
texts whose postings satisfy its query. Rules that force no trigram scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most strings that an expression is spelled out to; beyond it the trigrams seen so far are asked for.
SPELLED = 64


@dataclass(frozen=True)
class SecretRule:
    """``group`` must have ``least`` characters, else the match is dropped (it still uses up its text)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds in the order that breaks ties between spans of equal start.
RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]+", 0, 32),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("repo", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)

# A query is True (anything may match), a trigram, or ("and" | "or", frozenset of queries).


def both(kind: str, parts: list) -> object:
    parts = [p for p in parts if p is not True] if kind == "and" else parts
    if not parts or (kind == "or" and True in parts):
        return True
    flat = frozenset(parts)
    if kind == "or":  # a part that asks for more than another adds nothing
        need = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else {p} for p in flat}
        flat = frozenset(p for p in flat if not any(need[q] < need[p] for q in flat))
    return next(iter(flat)) if len(flat) == 1 else (kind, flat)


def of_strings(strings: set[str]) -> object:
    return both("or", [both("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regular expression, over lower-cased text."""
    return spell(regex_tree.parse(pattern))[1]


def spell(items) -> tuple[set[str] | None, object]:
    """(every string a sequence can be, or None; a query that each of its matches satisfies).

    Neighbours are joined to longer strings as long as there are few of them; before an element of unknown
    text, and at the end, the strings gathered so far give their trigrams.
    """
    run: set[str] = {""}
    whole, asked = True, []
    for op, arg in items:
        own, query = element(op, arg)
        if own is not None and len(own) * len(run) <= SPELLED:
            run = {a + b for a, b in product(run, own)}
        else:
            asked += [of_strings(run), query]
            whole, run = False, own or {""}
    asked.append(of_strings(run))
    return (run if whole else None), both("and", asked)


def element(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.AT:
        return {""}, True
    if op is C.SUBPATTERN:
        return spell(arg[-1])
    if op is C.BRANCH:
        got = [spell(x) for x in arg[1]]
        if all(own is not None for own, _ in got):
            return set().union(*[own for own, _ in got]), True
        return None, both("or", [query for _, query in got])
    if op is C.IN:
        kinds = dict(arg)
        if set(kinds) <= {C.LITERAL, C.RANGE} and len(arg) <= 8:
            chars = {chr(c).lower() for kind, v in arg for c in (range(v[0], v[1] + 1) if kind is C.RANGE else [v])}
            return (chars if len(chars) <= 8 else None), True
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, what = arg
        own, query = spell(what)
        if (low, high) == (0, 1) and own is not None:
            return own | {""}, True
        return (own, query) if low == high == 1 else (None, query if low else True)
    return None, True


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def satisfied(query: object, mask: Column, bit: dict[str, int]) -> Column:
    """The query over a text's postings, which are words of bits, one for each trigram."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.getbit(mask, F.lit(bit[query])) == 1
    out = None
    for q in sorted(query[1], key=str):
        c = satisfied(q, mask, bit)
        out = c if out is None else (out & c if query[0] == "and" else out | c)
    return out


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``trigram, node_id`` of the lower-cased texts, for the given trigrams."""
    low = texts.select("node_id", F.lower("text").alias("_t"))
    found = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(g)), F.lit(n)) for n, g in enumerate(trigrams)]))
    return low.select("node_id", F.explode(found).alias("_n")).select(F.element_at(F.array(*map(F.lit, trigrams)), F.col("_n") + 1).alias("trigram"), "node_id", "_n")


def candidates(index: DataFrame, queries: dict[str, object], trigrams: list[str]) -> DataFrame:
    """``node_id, kinds``: the kinds whose queries a text's postings satisfy; texts without any are absent.

    The postings of a text meet as the bits of one number, so a trigram that nearly every text holds
    is no large group, and they are combined before they are shuffled.
    """
    bit = {g: n for n, g in enumerate(trigrams)}
    masks = index.groupBy("node_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_n"))).alias("m"))
    kinds = F.array_compact(F.array(*[F.when(satisfied(q, F.col("m"), bit), F.lit(k)) for k, q in queries.items()]))
    return masks.select("node_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def probe(rule: SecretRule) -> str:
    """What a text scanned in full must hold: for a run of one class, a run that is long enough."""
    run = rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("]") == 1
    return f"{rule.pattern[:-1]}{{{rule.least}}}" if run and rule.least else rule.pattern


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """All spans of a rule: array of (start, order, end), code points, leftmost and not overlapping."""
    parts = F.split(text, rule.pattern, -1)
    size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else size
    gaps = F.slice(F.transform(parts, F.length), F.lit(1), F.size(size))
    hits = F.arrays_zip(gaps.alias("gap"), size.alias("size"), tested.alias("tested"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    fold = F.aggregate(hits, F.struct(F.lit(0).alias("at"), nothing.alias("s")), lambda a, h: F.struct(
        (a["at"] + h["gap"] + h["size"]).alias("at"),
        F.when(h["tested"] >= rule.least, F.concat(a["s"], F.array(F.struct((a["at"] + h["gap"]).alias("start"), F.lit(order).alias("rank"), (a["at"] + h["gap"] + h["size"]).alias("end"))))).otherwise(a["s"]).alias("s")))
    return fold["s"]


def find_secrets(texts: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``node_id, spans`` for every row of ``texts(node_id, text)``; DataFrame operations only.

    ``spans`` is an array of (start, kind, end) by start, then in the order of ``rules``: code points, end exclusive.
    Within a kind, matches are the leftmost that do not overlap; a match that fails its rule's
    length is dropped.

    Null and empty texts have no spans; null ids are looked up like others; rows that share an id share
    postings, which only adds texts to verify, and each row gets its own spans; an empty table gives
    no rows; other columns are ignored.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    grams = sorted(set().union(*map(trigrams_of, indexed.values()))) if indexed else []
    if len(grams) > 64:
        raise ValueError("the rules ask for more than 64 trigrams; scan them in two calls")
    t = texts.select("node_id", F.coalesce("text", F.lit("")).alias("text"))
    if grams:
        found = candidates(trigram_index(t, grams), indexed, grams).withColumnRenamed("node_id", "_id")
        t = t.join(found, F.col("node_id").eqNullSafe(F.col("_id")), "left")
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    every = []
    for n, r in enumerate(rules):
        test = F.array_contains("kinds", r.kind) if r.kind in indexed else F.col("text").rlike(probe(r))
        every.append(F.when(test, spans_of(F.col("text"), r, n)).otherwise(nothing))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*every)), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    return t.select("node_id", spans.alias("spans"))
