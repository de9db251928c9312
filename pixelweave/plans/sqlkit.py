"""Pieces of ANSI/DuckDB SQL for the oracle side: fixtures as CTEs and rounding helpers."""

from __future__ import annotations

import re


def u8(e: str) -> str:
    return f"CAST(greatest(0e0, least(255e0, round_even(CAST({e} AS DOUBLE), 0))) AS INTEGER)"


def jsr(e: str) -> str:
    return f"CAST(floor(CAST({e} AS DOUBLE) + 0.5e0) AS INTEGER)"


def lum(p: str = "") -> str:
    return f"(0.299e0*{p}r + 0.587e0*{p}g + 0.114e0*{p}b)"


def clamp01(e: str) -> str:
    return f"greatest(0e0, least(1e0, {e}))"


_H = (
    "((({x})::BIGINT*374761393 + ({y})::BIGINT*668265263 + ({z})::BIGINT*362437) & 4294967295)"
)


def hash2(x: str, y: str, z: str) -> str:
    h1 = _H.format(x=x, y=y, z=z)
    h2 = f"((xor({h1}, {h1} >> 13) * 1274126177) & 4294967295)"
    return f"xor({h2}, {h2} >> 16)"


def _e(k: int) -> str:
    return f"embedding[((i+{k})%64)+1]::DOUBLE"


PX = (
    "px AS (SELECT vec_id AS image_id, 0 AS frame, 8 AS w, 8 AS h, (i%8)::INTEGER AS x, (i//8)::INTEGER AS y, "
    f"{u8('128e0+512e0*' + _e(0))} AS r, {u8('128e0+512e0*' + _e(21))} AS g, "
    f"{u8('128e0+512e0*' + _e(42))} AS b, {u8('200e0+800e0*' + _e(11))} AS a "
    "FROM embeddings, range(64) t(i))"
)
PXB = "pxb AS (SELECT xor(image_id, 1::BIGINT) AS image_id, frame, w, h, x, y, r, g, b, a FROM px)"
PART = (
    "pp AS (SELECT image_id, frame, 16 AS w, 16 AS h, x, y, (v & 255)::INTEGER AS r, ((v>>8) & 255)::INTEGER AS g, "
    "((v>>16) & 255)::INTEGER AS b, CASE WHEN ((v>>24) & 7) = 0 THEN 0 ELSE 255 END AS a FROM ("
    f"SELECT p_partkey AS image_id, 0 AS frame, (i%16)::INTEGER AS x, (i//16)::INTEGER AS y, "
    f"{hash2('i%16', 'i//16', 'p_partkey')} AS v FROM part, range(256) t(i)))"
)
MASK = (
    "mk AS (SELECT image_id, frame, 16 AS w, 16 AS h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM ("
    "SELECT p_partkey AS image_id, 0 AS frame, (i%16)::INTEGER AS x, (i//16)::INTEGER AS y, "
    f"CASE WHEN ({hash2('(i%16)//2', '(i//16)//2', 'p_partkey')} & 3) < 2 THEN 255 ELSE 0 END AS v "
    "FROM part, range(256) t(i)))"
)
IMGS = (
    "im AS (SELECT p_partkey AS image_id, 0 AS frame, (5 + p_partkey % 11)::INTEGER AS w, "
    "(6 + p_size % 15)::INTEGER AS h FROM part)"
)
GRID = (
    "gr AS (SELECT image_id, frame, w, h, x::INTEGER AS x, y::INTEGER AS y FROM im, "
    "range(w) tx(x), range(h) ty(y))"
)
FRAMES = (
    "fr AS (SELECT user_id AS image_id, (row_number() OVER q - 1)::INTEGER AS frame, event_id, "
    "coalesce(least(1000, CAST(floor((lead(epoch_us(ts)) OVER q - epoch_us(ts)) / 1000) AS BIGINT)), 100)::INTEGER AS delay_ms "
    "FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id))"
)
SEQ = (
    "sq AS (SELECT image_id, frame, 4 AS w, 4 AS h, (i%4)::INTEGER AS x, (i//4)::INTEGER AS y, "
    "((event_id + 4*(i%4) + 16*(i//4)) % 256)::INTEGER AS r, (255 - (event_id + 4*(i%4) + 16*(i//4)) % 256)::INTEGER AS g, "
    "64 AS b, 255 AS a FROM fr, range(16) t(i))"
)
OUT = "image_id, frame, x, y, r, g, b, a"
OUTS = "image_id, frame, w, h, x, y, r, g, b, a"


def sql(body: str, *ctes: str) -> str:
    """A query over CTEs. Each is evaluated once; inlined, a join of two of them may be planned as a join of their ranges."""
    once = re.sub(r"\b(\w+) AS \((?=SELECT)", r"\1 AS MATERIALIZED (", ", ".join(ctes))
    return f"WITH RECURSIVE {once} {body}"


def rgb_map(fn, src: str = "px", a: str = "a", ctes=(PX,)) -> str:
    """SELECT with r, g, b replaced by fn(channel, index)."""
    r, g, b = (fn(ch, i) for i, ch in enumerate("rgb"))
    return sql(f"SELECT image_id, frame, x, y, {r} AS r, {g} AS g, {b} AS b, {a} AS a FROM {src}", *ctes)


def grey(v: str, src: str = "px", a: str = "255", ctes=(PX,)) -> str:
    return sql(
        f"SELECT image_id, frame, x, y, v AS r, v AS g, v AS b, a FROM "
        f"(SELECT image_id, frame, x, y, CAST({v} AS INTEGER) AS v, {a} AS a FROM {src})", *ctes,
    )


def bw(cond: str, **kw) -> str:
    return grey(f"CASE WHEN {cond} THEN 255 ELSE 0 END", **kw)
