"""Fill-in-the-middle forms of text outputs: three cuts pieces of a text, re-ordered behind markers, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed markers of prefix, suffix and middle.
MARKERS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
WIDTH = 3
#: Order of the pieces in each form, and the pieces' numbers in the text.
ORDERS = {"psm": "PSM", "spm": "SPM"}
PIECES = "PMS"

#: Bytes of text of one batch (one longer text is a batch of its own), and bytes whose shifts are held at once.
BATCH = 1 << 24
BLOCK = 1 << 18


def drawn(node_id: Column, seed: int, k: int) -> Column:
    """The k-th (from 0) 8-digit group of the hex SHA-256 of ``seed:node_id``, as a number. A null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(node_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def slices(b: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``BATCH`` bytes of text, each with its bytes and the rows' offsets in them."""
    col = pc.fill_null(b.column(text).cast(pa.large_binary()), b"")
    size = pc.binary_length(col).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH, "right")))
        part = col.slice(start, stop - start)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset: part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
        yield b.slice(start, stop - start), data, offsets - offsets[0]
        start = stop


def scan_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points before every block of bytes, and before every offset: first bytes of characters, counted block by block."""
    blocks, at = [0], np.zeros(len(offsets), np.int64)
    for a in range(0, len(data), BLOCK):
        seen = np.cumsum((data[a:a + BLOCK] & 0xC0) != 0x80) + blocks[-1]
        here = (offsets > a) & (offsets <= a + BLOCK)
        at[here] = seen[offsets[here] - a - 1]
        blocks.append(int(seen[-1]))
    return np.array(blocks, np.int64), at


def byte_of_point(data: np.ndarray, blocks: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The byte at which each code point of the batch (ascending) begins; the number of bytes for the one behind the last."""
    out = np.full(len(points), len(data), np.int64)
    block = np.searchsorted(blocks, points, "right") - 1
    for k in np.unique(block[block < len(blocks) - 1]):
        firsts = np.flatnonzero((data[k * BLOCK:(k + 1) * BLOCK] & 0xC0) != 0x80)
        here = block == k
        out[here] = firsts[points[here] - blocks[k]] + k * BLOCK
    return out


def shifts(starts: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The place that every byte moves to, block by block: (from, to, places).

    Pieces begin at the ascending ``starts`` and move by ``shift``. A difference array holds at every piece's
    first byte how its shift differs from the piece before, and its cumulative sum is each byte's shift.
    Empty pieces share a first byte, where their differences add up.
    """
    change = np.diff(shift, prepend=0)
    now = 0
    for a in range(0, size, BLOCK):
        b = min(size, a + BLOCK)
        difference = np.zeros(b - a, np.int64)
        lo, hi = np.searchsorted(starts, [a, b])
        np.add.at(difference, starts[lo:hi] - a, change[lo:hi])
        moved = np.cumsum(difference) + now
        now = int(moved[-1])
        yield a, b, np.arange(a, b) + moved


def find_markers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte, row) of every marker that lies inside one text, in order."""
    found = []
    for a in range(0, len(data), BLOCK):
        d = data[a:a + BLOCK + WIDTH - 1]
        if len(d) >= WIDTH:
            letters = np.isin(d[1:-1], np.frombuffer(b"".join(m[1:2] for m in MARKERS.values()), np.uint8))
            found.append(np.flatnonzero((d[:-2] == ord("<")) & letters & (d[2:] == ord(">"))) + a)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + WIDTH <= offsets[row + 1]
    return at[whole], row[whole]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def rearranged(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, plain_of_100: int, spm_of_100: int) -> pa.RecordBatch:
    rows = part.num_rows
    h = [part.column(f"_h{k}").to_numpy() for k in range(4)]
    blocks, before = scan_points(data, offsets)
    n = np.diff(before)
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)], axis=1), axis=1)
    plain = (n == 0) | (h[2] % 100 >= plain_of_100)
    plain[find_markers(data, offsets)[1]] = True
    spm = ~plain & (h[3] % 100 < spm_of_100)
    # bytes at which prefix, middle and suffix of every text begin, and where they end
    marks = byte_of_point(data, blocks, (before[:-1, None] + cuts).ravel()).reshape(rows, 2)
    starts = np.column_stack([offsets[:-1], marks])
    size = np.diff(np.column_stack([starts, offsets[1:]]), axis=1)
    extra = np.where(plain, 0, WIDTH * len(MARKERS))
    ends = np.cumsum(np.diff(offsets) + extra)
    first = ends - np.diff(offsets) - extra
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    to = starts - offsets[:-1, None] + first[:, None]  # plain: every piece stays in its place
    for form, order in ORDERS.items():
        which = np.flatnonzero(spm if form == "spm" else ~plain & ~spm)
        at = first[which]
        for piece in order:
            for k, byte in enumerate(MARKERS[piece]):
                out[at + k] = byte
            column = PIECES.index(piece)
            to[which, column] = at + WIDTH
            at = at + WIDTH + size[which, column]
    for a, b, places in shifts(starts.ravel(), (to - starts).ravel(), len(data)):
        out[places] = data[a:b]
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    chars = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
    names = [c for c in part.schema.names if c not in ("text", *[f"_h{k}" for k in range(4)])]
    kept = [part.column(c) for c in names]
    return pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), form, *chars, strings(out, np.concatenate([[0], ends]))],
                                      names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(texts: DataFrame, seed: int = 1, plain_of_100: int = 90, spm_of_100: int = 20) -> DataFrame:
    """Fill-in-the-middle training texts of ``texts(node_id, text)``: ``node_id, n, form, prefix_chars, middle_chars, output``.

    A text of ``n`` code points is cut twice, after h1 mod (n + 1) and h2 mod (n + 1) of them, where h1 to h4 are drawn from
    (seed, node_id) alone (``drawn``). ``form`` is ``plain`` where the text is empty, holds a marker, or h3 mod 100 is
    ``plain_of_100`` or more; else ``spm`` where h4 mod 100 is under ``spm_of_100``, else ``psm``. ``output`` is the text itself, or
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Only texts without a marker are cut, and no
    marker can arise where a piece meets one, so ``restore`` reads the text back.

    The bytes of a batch are moved at once: first bytes of characters are counted to find the cuts, the pieces' shifts are written
    as differences at the pieces' first bytes, and their cumulative sum scatters all bytes into the outputs. Work goes on in blocks,
    so a very long text costs its own bytes twice and no more. No row meets another, so no type of node is a bottleneck.

    Null texts are empty; a null id is drawn for as an id without digits; repeated rows give equal rows;
    an empty table gives no rows; ``prefix_chars`` and ``middle_chars`` are null where plain; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in slices(b, "text"):
                yield rearranged(part, data, offsets, plain_of_100, spm_of_100)

    t = texts.select("node_id", "text", *[drawn(F.col("node_id"), seed, k).alias(f"_h{k}") for k in range(4)])
    kind = t.schema["node_id"].dataType.simpleString()
    return t.mapInArrow(run, f"node_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def put_back(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    form = np.array(part.column("form").to_pylist(), dtype=object)
    cut = np.flatnonzero((form == "psm") | (form == "spm"))
    at, row = find_markers(data, offsets)
    mine = np.isin(row, cut)
    at = at[mine].reshape(-1, len(MARKERS))  # an output that was cut holds each marker once
    size = np.diff(offsets)
    size[cut] -= WIDTH * len(MARKERS)
    ends = np.cumsum(size)
    first = ends - size
    starts = np.repeat(first[:, None], len(PIECES), axis=1)  # plain: one piece, and two empty ones
    source = np.repeat(offsets[:-1, None], len(PIECES), axis=1)
    begin = at + WIDTH
    length = np.diff(np.column_stack([at, offsets[1:][cut]]), axis=1) - WIDTH
    for name, order in ORDERS.items():
        here = form[cut] == name
        which = cut[here]
        place = first[which]
        for k, piece in enumerate(PIECES):
            column = order.index(piece)
            starts[which, k], source[which, k] = place, begin[here, column]
            place = place + length[here, column]
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a, b, places in shifts(starts.ravel(), (source - starts).ravel(), len(out)):
        out[a:b] = data[places]
    return strings(out, np.concatenate([[0], ends]))


def restore(formed: DataFrame) -> DataFrame:
    """Adds ``text`` to the rows of ``formed(form, output, ...)``, rebuilt from these two columns by the inverse gather.

    Markers are found in the outputs' bytes, give every byte of the text the place it was moved to, and are left out. Null outputs are empty.
    """
    names = formed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in slices(b, "output"):
                yield pa.RecordBatch.from_arrays([*part.columns, put_back(part, data, offsets)], names=[*names, "text"])

    return formed.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema] + ["text string"]))
