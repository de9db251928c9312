"""Judging result links with glob rules, all rules at once in a bit-parallel automaton.

A rule is a glob over the canonical link, ``host + path``: ``*`` stands for any run without a
slash, ``**`` for any run, ``?`` for one character that is no slash. Every character of a rule is
one bit of a Shift-And automaton; the bits of all rules lie side by side in 64-bit words. Reading a
character shifts the whole state once, masks it with the character's row, and keeps the bits whose
star lets them stay. A batch of links is read column by column, so one step moves every rule of
every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``globs``: any of them fits; ``name`` is reported; the rule with the longest name wins."""

    name: str
    verdict: str
    globs: tuple[str, ...]


def site_rule(verdict: str, name: str) -> Rule:
    """A rule like ``example.net/en/``: the host and all its subdomains, every path that starts so."""
    return Rule(name, verdict, (f"{name}**", f"*.{name}**"))


#: Links whose path names a program or archive; the method's own verdict where no site rule fits.
FILE_RULES = tuple(Rule(f"**.{x}", "block", (f"**.{x}",)) for x in ("exe", "msi", "apk", "dmg", "iso", "zip", "rar", "7z"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class ShiftAnd:
    """The automaton of a list of globs; ``fits`` reads many strings at once."""

    def __init__(self, globs: list[str]):
        cells: list[tuple[str, str]] = []  # (character, star after it) of each bit; "" starts a glob
        self.last: list[int] = []
        for g in globs:
            cells.append(("", ""))
            i = 0
            while i < len(g):
                if g.startswith("**", i):
                    cells[-1] = (cells[-1][0], "**")
                    i += 2
                    continue
                if g[i] == "*":
                    cells[-1] = (cells[-1][0], cells[-1][1] or "*")
                else:
                    cells.append((g[i], ""))
                i += 1
            self.last.append(len(cells) - 1)
        chars = sorted({c for c, _ in cells if c not in ("", "?")} | {"/"})
        self.codes = np.array([ord(c) for c in chars], dtype=np.uint32)
        self.words = -(-len(cells) // 64)
        step = np.zeros((len(chars) + 1, self.words), dtype=np.uint64)  # row 0: any other character
        stay = np.zeros_like(step)
        begin = np.zeros(self.words, dtype=np.uint64)
        slash = chars.index("/") + 1
        for bit, (c, star) in enumerate(cells):
            w, b = bit >> 6, np.uint64(1 << (bit & 63))
            if c == "":
                begin[w] |= b
            elif c == "?":
                step[[k for k in range(len(step)) if k != slash], w] |= b
            else:
                step[chars.index(c) + 1, w] |= b
            if star:
                stay[[k for k in range(len(step)) if star == "**" or k != slash], w] |= b
        self.step, self.stay, self.begin = step, stay, begin

    def fits(self, texts: list[str]) -> np.ndarray:
        """(texts, globs) booleans."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        size = np.array([len(texts[i]) for i in order], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        kind = np.where(self.codes[at] == codes, at + 1, 0)
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -j, side="left"))  # links longer than j come first
            k, s = kind[start[:n] + j], state[:n]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:n] = (moved & self.step[k]) | (s & self.stay[k])
        last = np.array(self.last, dtype=np.int64)
        hit = ((state[:, last >> 6] >> (last & 63).astype(np.uint64)) & one).astype(bool)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def filter_links(links: DataFrame, rules: list[Rule], method_rules: tuple[Rule, ...] = FILE_RULES,
                 default: str = "allow", no_host: str = "block") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``links(node_id, url, ...)``.

    ``rules`` are settings, held by every task. Among the rules that fit a link the longest name
    wins (then the smaller name), and its verdict stands. Where none fits, ``rule`` is null and the
    method decides: ``no_host`` for links without a host (null, empty, no ``://``), else the verdict
    of the first of ``method_rules`` that fits, else ``default``. Rows are neither dropped nor
    joined: repeated links are judged alike, an empty table gives an empty result, columns named
    like the new ones are replaced, all others stay. Nothing is shuffled.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    every = [*ranked, *method_rules]
    globs = [g for r in every for g in r.globs]
    owner = [i for i, r in enumerate(every) for _ in r.globs]
    n_ranked = len(ranked)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        auto = ShiftAnd(globs) if globs else None
        for host, path in batches:
            names, verdicts = [], []
            hits = auto.fits(list(host + path)) if auto is not None and len(host) else np.zeros((len(host), 0), dtype=bool)
            first = np.where(hits.any(axis=1), hits.argmax(axis=1), -1) if hits.shape[1] else np.full(len(host), -1)
            for h, k in zip(host, first):
                r = every[owner[k]] if k >= 0 else None
                named = r is not None and owner[k] < n_ranked
                names.append(r.name if named else None)
                verdicts.append(r.verdict if named else no_host if h == "" else r.verdict if r else default)
            yield pd.DataFrame({"rule": pd.Series(names, dtype=object), "verdict": verdicts})

    t = links.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keep = [c for c in t.columns if c not in ("host", "path")]
    t = t.withColumn("_j", judge("host", "path"))
    return t.select(*keep, "host", "path", F.col("_j.rule").alias("rule"), F.col("_j.verdict").alias("verdict"))
