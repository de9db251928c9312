"""Removing lines that repeat earlier lines nearly word for word: an exact set-similarity join.

DataFrame operations only. Lines are sets of words. With the words of every line in one common
order, rare ones first, two lines whose Jaccard similarity is at least t share a word among the first
``n - ceil(t * n) + 1`` of each, so only those words are joined on. Positions, lengths and a bitmap of the
sets (lines that differ in d words differ in at most d bits) leave few pairs, and those
are compared word by word. Lines and words are known by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are counted in so many hashed classes. A class's level is the logarithm of its count, 15 at most.
#: The levels of 16 classes share a number: the first bits of a word's hash tell which, bits 2 to 5 the place in it.
CLASSES = 1 << 20
LEVEL_BITS = 4
ROW_SHIFT = 64 - (CLASSES // 16 - 1).bit_length()
#: Words of a line under which it looks for first lines of its kind, first lines of each kind, and lines that make a kind:
#: the pairs of fewer are listed.
LEAD_WORDS, LEADS, LEAD_LINES = 4, 8, 32
#: Bits of a filter of hashes, for each of them, and at most.
FILTER_BITS, FILTER_WORDS = 16, 1 << 15


def words_of(line: Column) -> Column:
    """The distinct words of a line, A-Z lower-cased, split at ASCII white space."""
    return F.array_distinct(F.array_remove(F.split(F.translate(line, UPPER, LOWER), SPACE), ""))


def lines_of(texts: DataFrame) -> DataFrame:
    """``node_id, t, line_no, no, line, h``: every line with its text's hash, its own and a number for its place.

    Places are ordered by ``node_id`` (null first), then line: the id, moved by the bits of a line number. Ids
    that leave no room for those are ranked first.
    """
    t = texts.select("node_id", "text", F.xxhash64("text").alias("t")).select("node_id", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # a text has no more line ends than bytes
    top = texts.agg(F.max(F.octet_length("text")).alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi")).first()
    bits, low = int(top["n"] or 0).bit_length(), top["lo"] or 0
    rank = F.coalesce(F.col("node_id") - F.lit(low) + 1, F.lit(0)).cast("long")
    if ((top["hi"] or 0) - low + 1).bit_length() + bits > 62:
        ids = settled(texts.select("node_id").distinct().orderBy("node_id").select(F.col("node_id").alias("_id"), F.monotonically_increasing_id().alias("_rank")))
        t, rank = t.join(ids, F.col("node_id").eqNullSafe(F.col("_id"))), F.col("_rank")
    return t.select("node_id", "t", "line_no", (F.shiftleft(rank, bits) + F.col("line_no")).alias("no"), "line", F.xxhash64("line").alias("h"))


def folded(text: Column) -> Column:
    """A text whose words are those of ``words_of`` under other names, A-Z lower-cased.

    Its UTF-8 bytes are read as Latin-1 and lower-cased. That lowers A-Z and turns the bytes C0 to DE into E0 to FE, which joins no two
    words: how many bytes follow tells which of the two a first byte was. It takes a fraction of the time of ``translate``.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def word_levels(texts: DataFrame) -> list[int]:
    """The levels of the hash classes of words, counted over all texts, 16 in a number; the list is of fixed size."""
    w = texts.select(F.explode(F.split(folded(F.col("text")), SPACE)).alias("w")).select(F.xxhash64("w").alias("h"))
    c = F.shiftleft(F.shiftrightunsigned("h", ROW_SHIFT), 6).bitwiseOR(F.col("h").bitwiseAND(F.lit(60))).cast("int")
    n = w.groupBy(c.alias("c")).agg(F.count("*").alias("n")).select(F.shiftright("c", 6).alias("i"), F.col("c").bitwiseAND(F.lit(60)).alias("at"), "n")
    level = F.least(F.floor(F.log2("n") + 1e-9), F.lit(15))
    rows = n.groupBy("i").agg(F.bit_or(F.call_function("shiftleft", level, F.col("at"))).alias("m")).toArrow()
    levels = [0] * (CLASSES // 16)
    for i, m in zip(rows.column("i").to_pylist(), rows.column("m").to_pylist()):
        levels[i] = m
    return levels


def ranked(line: Column, levels: list[int]) -> Column:
    """The distinct words of a line as numbers in the common order: by level, then by hash."""
    # split at single spaces, which needs no pattern
    plain = F.when(line.rlike(r"[\x09-\x0D]"), F.translate(line, "\t\n\x0b\x0c\r", " " * 5)).otherwise(line)
    h = F.transform(F.split(folded(plain), " "), lambda w: F.xxhash64(w))
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")

    def number(h: Column) -> Column:
        row = F.get(table, F.shiftrightunsigned(h, ROW_SHIFT).cast("int"))
        level = F.call_function("shiftrightunsigned", row, h.bitwiseAND(F.lit(60)).cast("int"))
        # the shift leaves the level's four bits; levels from 8 on make negative numbers, so their order is turned by the first bit
        return F.shiftleft(level, 64 - LEVEL_BITS).bitwiseOR(F.shiftrightunsigned(h, LEVEL_BITS)).bitwiseXOR(F.lit(-(1 << 63)))

    return F.sort_array(F.transform(F.array_distinct(F.array_remove(h, F.xxhash64(F.lit("")))), number))


def bitmap(numbers: str, half: int) -> Column:
    """64 bits; every word flips one of 128, the halves' bits together."""
    mine = "<> 0" if half else "= 0"
    return F.expr(f"aggregate({numbers}, 0L, (a, x) -> IF((x & 64L) {mine}, a ^ shiftleft(1L, CAST(x & 63L AS INT)), a))")


def distinct_lines(lines: DataFrame, levels: list[int], t: float, least: int) -> DataFrame:
    """One row for each different line of at least ``least`` words: ``h``, ``no`` (its first place), ``n``, ``head`` (the words joined on), ``b0``, ``b1``."""
    w = lines.select("h", "no", ranked(F.col("line"), levels).alias("_w"))
    n = F.size("_w")
    head = F.slice("_w", F.lit(1), (n - F.ceil(n * F.lit(t) - 1e-9) + 1).cast("int"))
    # equal lines have equal heads and bitmaps, so the smallest struct is the first line's
    row = F.struct("no", n.alias("n"), head.alias("head"), bitmap("_w", 0).alias("b0"), bitmap("_w", 1).alias("b1"))
    return w.groupBy("h").agg(F.min(row).alias("r")).select("h", "r.*").filter(F.col("n") >= least)


def need(a: Column, b: Column, t: float) -> Column:
    """Common words that sets of these sizes must have."""
    return F.ceil((a + b) * F.lit(t / (1 + t)) - 1e-9)


def plausible(t: float) -> Column:
    """Order, length and bitmap filters for x and an earlier y. ``lim`` is x's place, or below all places if x needs no partner."""
    nx, ny = F.col("x.n"), F.col("y.n")
    bits = F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))) + F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1")))
    before = (F.col("y.no") < F.col("x.lim")) | ((F.col("y.no") == F.col("x.lim")) & (F.col("y.h") < F.col("x.h")))
    # follows from it, and makes both sides need the same columns, so that one shuffle serves both
    before = before & (F.col("y.lim") <= F.col("x.no"))
    return before & (ny >= nx * F.lit(t) - 1e-9) & (nx >= ny * F.lit(t) - 1e-9) & (bits <= nx + ny - 2 * need(nx, ny, t))


def among(name: str, want: DataFrame) -> Column:
    """Whether the hash in the named column may be one of ``want``, which has the same column: a bit filter of bounded size tells, never wrongly no."""
    n = want.count()
    size = max(64, min(FILTER_WORDS * 64, 1 << (max(1, n) * FILTER_BITS - 1).bit_length()))
    slot = F.pmod(F.col(name), F.lit(size))
    place = slot.bitwiseAND(F.lit(63)).cast("int")
    bits = want.select(F.shiftright(slot, 6).alias("w"), place.alias("b")).groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("m"))
    table = {r["w"]: r["m"] for r in bits.collect()}
    # the filter is one row of at most FILTER_WORDS numbers
    row = want.sparkSession.createDataFrame([([table.get(w, 0) for w in range(size // 64)],)], "m array<long>")
    word = F.call_function("get", row.scalar(), F.shiftright(slot, 6).cast("int"))
    return F.call_function("getbit", word, place) == 1


def alike(pairs: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """Hashes ``h`` of the lines x of ``pairs(x, y)`` that reach the similarity, by their words.

    Only the lines named are read again; what ``among`` lets through wrongly the join drops.
    """
    want = settled(pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct())
    thin = lines.select("h", "line").filter(among("h", want))
    got = settled(thin.join(want, "h").dropDuplicates(["h"]).select("h", words_of(F.col("line")).alias("w")))
    p = pairs.join(got.select(F.col("h").alias("x"), F.col("w").alias("wx")), "x").join(got.select(F.col("h").alias("y"), F.col("w").alias("wy")), "y")
    common = F.size(F.array_intersect("wx", "wy"))
    return p.filter(common >= need(F.size("wx"), F.size("wy"), t)).select(F.col("x").alias("h")).distinct()


def repeated_lines(texts: DataFrame, t: float = 0.8, least: int = 5) -> DataFrame:
    """``node_id, t, line_no`` of every line that an earlier line matches; ``t`` is the hash of its text.

    A line is matched by an earlier one (smaller ``node_id``, then line number) if the Jaccard
    similarity of their word sets is at least ``t``. Whether the earlier line is itself removed does not
    matter. Lines of fewer than ``least`` distinct words are left alone.
    """
    lines = lines_of(texts)
    d = settled(distinct_lines(lines, word_levels(texts), t, least))
    # 1. Lines of a kind: against the first lines, one in each of a few parts, that share a word and about the
    #    length. Where many lines are near copies of each other this settles them without their pairs. Words that such
    #    copies have in common are frequent for that reason, so the last words joined on serve too.
    kind = F.floor(F.ln("n") / F.lit(math.log(1 / t)))
    some = F.array_distinct(F.concat(F.slice("head", 1, 1), F.slice(F.reverse("head"), 1, LEAD_WORDS)))
    rare = d.select("h", "no", "n", "b0", "b1", kind.alias("kind"), F.explode(some).alias("word")).withColumn("word", F.xxhash64("word", "kind")).drop("kind")
    rare = rare.filter(among("word", settled(rare.groupBy("word").agg(F.count("*").alias("c")).filter(F.col("c") >= LEAD_LINES).select("word"))))
    row, part = F.struct("no", "n", "b0", "b1", "h"), F.pmod("h", F.lit(LEADS))
    firsts = F.array_compact(F.array(*[F.min(F.when(part == k, row)) for k in range(LEADS)]))
    lead = rare.groupBy("word").agg(F.count("*").alias("c"), firsts.alias("l")).filter("c > 1").select("word", F.explode("l").alias("l")).select("word", "l.*").withColumn("lim", F.col("no"))
    pairs = rare.withColumn("lim", F.col("no")).alias("x").join(lead.alias("y"), (F.col("x.word") == F.col("y.word")) & plausible(t))
    first = settled(alike(settled(pairs.select(F.col("x.h").alias("x"), F.col("y.h").alias("y")).distinct()), lines, t))
    # 2. All others against every earlier line that shares one of the words joined on. Both sides are the same rows,
    #    shuffled once: a settled line takes part with no place that anything could precede.
    rows = d.join(first.withColumn("done", F.lit(True)), "h", "left").withColumn("lim", F.when(F.col("done"), F.lit(-1)).otherwise(F.col("no")))
    # without nulls neither side gets a filter of its own
    rows = rows.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("h", "no", "lim", "n", "b0", "b1")], F.posexplode("head").alias("at", "word"))
    rows = rows.withColumn("word", F.hash("word"))  # half as wide; words that meet wrongly only add candidates
    nx, ny = F.col("x.n"), F.col("y.n")
    reach = F.least("x.at", "y.at") + F.least(nx - F.col("x.at"), ny - F.col("y.at"))
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.word") == F.col("y.word")) & plausible(t) & (reach >= need(nx, ny, t)))
    gone = first.union(alike(settled(pairs.select(F.col("x.h").alias("x"), F.col("y.h").alias("y")).distinct()), lines, t)).distinct()
    # 3. Every line but the first of its text, and all lines that are gone.
    sets = d.select("h", F.col("no").alias("_first")).join(gone.withColumn("gone", F.lit(True)), "h", "left")
    w = lines.select("node_id", "t", "line_no", "no", "h").join(sets, "h")
    return w.filter(F.col("gone").isNotNull() | (F.col("no") != F.col("_first"))).select("node_id", "t", "line_no")


def dedup_lines(texts: DataFrame, t: float = 0.8, least: int = 5) -> DataFrame:
    """``texts(node_id, text, ...)`` without the lines that an earlier line matches; see ``repeated_lines``.

    All columns stay; ``text`` loses the lines, and ``lines_removed`` (replaced, if there is one) counts them. ``node_id``
    is a long. Null and empty texts are kept as they are, as is a text that loses all its lines (empty then). Null ids come
    first in the order; lines of texts that share an id and have the same number are at one place: equal ones stay together, of
    similar ones the smaller hash counts as earlier. An empty table stays empty.
    """
    t0 = texts.drop("lines_removed")
    # by id and text: all rows without an id do not meet in one
    gone = repeated_lines(texts, t, least).groupBy("node_id", "t").agg(F.collect_set("line_no").alias("_gone")).withColumnsRenamed({"node_id": "_id", "t": "_t"})
    j = t0.join(gone, F.col("node_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i))
    j = j.withColumn("_kept", F.when(F.col("_gone").isNotNull() & F.col("text").isNotNull(), kept))
    cols = [F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text") if c == "text" else F.col(c) for c in t0.columns]
    return j.select(*cols, F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).alias("lines_removed"))
