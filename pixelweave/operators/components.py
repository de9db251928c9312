"""Connected components: masks become runs, runs become a graph, the graph contracts in log rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import d, jsround, luminance
from ..schema import IMG, PIXEL, POS, RGB, SIZE, cut, cut_apart, images_of, large
from .color import bw


def connected_components(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """links(keys…, a, b), undirected -> (keys…, id, label): the smallest id of each component.

    Components never cross ``keys`` (an image, say).  Alternating large-star / small-star
    contraction: every round replaces edges by edges to the smallest known neighbour, halving path
    lengths, so rounds grow with the logarithm of the component size.  Only minima (partial
    aggregates) are taken per node, never neighbour lists, so a hub stays harmless.
    """
    keys = keys or []
    both = links.filter("a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_apart(both)
    n_edges = edges.count()
    nodes = links.select(*keys, F.col("a").alias("id")).union(links.select(*keys, F.col("b").alias("id"))).distinct()
    while True:
        # large star: link every larger neighbour of a node to the node's smallest neighbour
        sym = edges.select(*keys, F.col("u").alias("n"), F.col("v").alias("m")).union(
            edges.select(*keys, F.col("v").alias("n"), F.col("u").alias("m")))
        low = sym.groupBy(*keys, "n").agg(F.min("m").alias("lo")).select(*keys, "n", F.least("n", "lo").alias("lo"))
        large = sym.filter("m > n").join(low, [*keys, "n"]).select(*keys, F.col("m").alias("u"), F.col("lo").alias("v"))
        large = cut_apart(large.filter("u <> v").distinct())
        # small star: link a node's smaller neighbours, and the node itself, to the smallest of them
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("lo"))
        small = large.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("lo").alias("v")).filter("u <> v")
        nxt = cut_apart(small.union(low.select(*keys, "u", F.col("lo").alias("v"))).distinct())
        n_next = nxt.count()  # footers only
        if n_next == n_edges and nxt.join(edges, [*keys, "u", "v"], "left_anti").isEmpty():
            break
        edges, n_edges = nxt, n_next
    star = edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("label"))
    return nodes.join(star, [*keys, "id"], "left").select(*keys, "id", F.coalesce("label", "id").alias("label"))


#: Side of the tiles inside which runs are linked at first, and how many of them make a side of the next larger tile.
TILE = 256
GROW = 4


def runs(m: DataFrame, value: str = "on", keys: list[str] = IMG, tile: int | None = None) -> DataFrame:
    """(keys…, w, h, y, x0, x1, on): maximal horizontal runs of equal value (gaps and islands), cut at the borders of tiles if ``tile`` is given."""
    part = [*keys, "y", value]
    if tile is not None:
        m, part = m.withColumn("_tx", F.floor(F.col("x") / tile)), [*part, "_tx"]
    t = m.withColumn("_g", F.col("x") - F.row_number().over(Window.partitionBy(*part).orderBy("x")))
    return t.groupBy(*SIZE, *part, "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(*keys, *SIZE, "y", value, "x0", "x1")


def _settle(keys: list[str]):
    """Roots of linked nodes, tile by tile: rows come sorted by tile, and whole tiles are labelled at once."""
    import numpy as np
    import pyarrow as pa

    group = [*keys, "ay", "ax"]

    def label(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).to_numpy() for c in group]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        tile = np.cumsum(new) - 1
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        ids, node = np.unique(np.concatenate([a, b]), return_inverse=True)
        uniq, first, inv = np.unique(np.concatenate([tile, tile]) * len(ids) + node, return_index=True, return_inverse=True)
        a, b = inv[: t.num_rows], inv[t.num_rows:]
        root = np.arange(len(uniq))
        while True:  # smallest linked node, with pointer jumping
            low = np.minimum(root[a], root[b])
            next_ = root.copy()
            np.minimum.at(next_, root[a], low)
            np.minimum.at(next_, root[b], low)
            next_ = next_[next_]
            if np.array_equal(next_, root):
                break
            root = next_
        # codes of one tile are ordered like its node ids, so the smallest code is the first pixel
        own = [t.column(k).take(pa.array(first % t.num_rows)).combine_chunks() for k in keys]
        return pa.RecordBatch.from_arrays([*own, pa.array(ids[uniq % len(ids)]), pa.array(ids[uniq[root] % len(ids)])], names=[*keys, "id", "root"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = np.ones(t.num_rows, bool)
            for c in group:
                v = t.column(c).to_numpy()
                last &= v == v[-1]
            start = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if start:
                yield label(t.slice(0, start))
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield label(held)

    return run


def label_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """links(keys…, a, b, ay, ax, by, bx) between nodes in tiles -> (keys…, id, label), the smallest id of each component.

    Links inside a tile are settled where they are. The others then link whole components, one link a pair, and ``GROW`` by ``GROW``
    tiles become one, until none is left: as many rounds as the image's side has digits to that base. A task
    holds one tile, and of a larger tile only links across the borders of the tiles it is made of, so its size goes with
    the side of an image and not with its area. Tiles of small images share tasks.
    """
    types = dict(links.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "id bigint", "root bigint"])
    links = cut(links)
    labels = None
    while True:
        inside = (F.col("ay") == F.col("by")) & (F.col("ax") == F.col("bx"))
        tiles = links.filter(inside).select(*keys, "ay", "ax", "a", "b").repartition(*keys, "ay", "ax").sortWithinPartitions(*keys, "ay", "ax")
        roots = cut(tiles.mapInArrow(_settle(keys), schema))
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            t = labels.join(roots.select(*keys, F.col("id").alias("label"), "root"), [*keys, "label"], "left")
            t = t.select(*keys, "id", F.coalesce("root", "label").alias("label"))
            # what has no link inside its tile still belongs to what it touches across the border
            alone = roots.join(labels.select(*keys, "id"), [*keys, "id"], "left_anti").select(*keys, "id", F.col("root").alias("label"))
            labels = cut(t.unionByName(alone))
        rest = links.filter(~inside)
        for end in "ab":
            known = roots.select(*keys, F.col("id").alias(end), F.col("root").alias("_r"))
            rest = rest.join(known, [*keys, end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
        larger = [F.floor(F.col(c) / GROW).cast("int").alias(c) for c in ("ay", "ax", "by", "bx")]
        links = cut(rest.select(*keys, "a", "b", *larger).distinct())
        if links.isEmpty():
            return labels


def _label_tiles(tile: int, value: str):
    """Roots of the runs of whole tiles: rows come sorted by tile, row and column, ``_k`` numbers the runs of a tile from 1."""
    import numpy as np
    import pyarrow as pa

    def label(t: pa.Table) -> pa.RecordBatch:
        y, x0, x1, on = (t.column(c).to_numpy() for c in ("y", "x0", "x1", value))
        row = np.cumsum(t.column("_k").to_numpy() == 1) * tile + y % tile
        # runs of a row are disjoint, so those that a run of the row above overlaps are neighbours
        lo = np.searchsorted(row * tile + x1 % tile, (row + 1) * tile + x0 % tile)
        hi = np.searchsorted(row * tile + x0 % tile, (row + 1) * tile + x1 % tile, side="right")
        n = np.where(y % tile == tile - 1, 0, np.maximum(hi - lo, 0))
        a = np.repeat(np.arange(len(y)), n)
        b = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = on[a] == on[b]
        a, b = a[same], b[same]
        root = np.arange(len(y))
        while True:  # smallest linked run, with pointer jumping
            low = np.minimum(root[a], root[b])
            next_ = root.copy()
            np.minimum.at(next_, root[a], low)
            np.minimum.at(next_, root[b], low)
            next_ = next_[next_]
            if np.array_equal(next_, root):
                break
            root = next_
        t = t.append_column("root", pa.array((y[root].astype(np.int64) << 31) + x0[root])).drop_columns("_k")
        return t.combine_chunks().to_batches()[0]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            start = int(np.flatnonzero(t.column("_k").to_numpy() == 1)[-1])
            if start:
                yield label(t.slice(0, start))
            held = t.slice(start)
        if held is not None:
            yield label(held)

    return run


def label_runs(r: DataFrame, value: str = "on", keys: list[str] = IMG, tile: int = TILE) -> DataFrame:
    """Runs within tiles plus ``label_x, label_y``, the first pixel (row-major) of the run's 4-connected component.

    A run touches a run of the row below when their spans overlap, and one beside it when they meet at the border of two tiles.
    Runs meet once by tile, which needs no shuffle where images are together already, and get their roots there. Only runs at the borders
    of tiles go on: those of two rows are swept in x order, and each run only looks at the one active run of the other row:
    no range join, and no pair that does not touch is ever formed. Images of one tile are done before.
    """
    cols = [*keys, *SIZE, "y", "x0", "x1", value]
    r = r.select(*cols, F.floor(F.col("x0") / tile).cast("int").alias("_tx"), F.floor(F.col("y") / tile).cast("int").alias("_ty"))
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_ty", "_tx").orderBy("y", "x0")))
    types = dict(r.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in [*cols, "_tx", "_ty"]], "root bigint"])
    r = cut(r.mapInArrow(_label_tiles(tile, value), schema))
    ends = [*keys, "_tx", value, "x0", "x1", "root"]
    up = r.filter((F.col("y") + 1) % tile == 0).select("y", *ends, F.lit(0).alias("_side"))
    down = r.filter((F.col("y") > 0) & (F.col("y") % tile == 0)).select((F.col("y") - 1).alias("y"), *ends, F.lit(1).alias("_side"))
    sweep = Window.partitionBy(*keys, "y", "_tx", value).orderBy("x0", "_side").rowsBetween(Window.unboundedPreceding, 0)
    active = lambda s: F.last(F.when(F.col("_side") == s, F.struct("x0", "x1", "root")), ignorenulls=True).over(sweep)
    ev = up.union(down).withColumns({"_a": active(0), "_b": active(1)})
    touch = ev.filter("_a is not null and _b is not null and _a.x1 >= _b.x0 and _b.x1 >= _a.x0")
    # tiles as ``label_links`` has them first: larger ones, as nothing is left to link inside a tile
    wide = lambda c: F.floor(c / GROW).cast("int")
    row = lambda c: F.floor(c / (tile * GROW)).cast("int")
    links = touch.select(*keys, F.col("_a.root").alias("a"), F.col("_b.root").alias("b"),
                         row(F.col("y")).alias("ay"), wide(F.col("_tx")).alias("ax"), row(F.col("y") + 1).alias("by"), wide(F.col("_tx")).alias("bx"))
    left = r.filter((F.col("x1") + 1) % tile == 0).select(*keys, "y", value, (F.col("x1") + 1).alias("_x"), F.col("root").alias("a"), wide(F.col("_tx")).alias("ax"))
    right = r.filter((F.col("x0") > 0) & (F.col("x0") % tile == 0)).select(*keys, "y", value, F.col("x0").alias("_x"), F.col("root").alias("b"), wide(F.col("_tx")).alias("bx"))
    beside = left.join(large(right), [*keys, "y", value, "_x"])
    beside = beside.select(*keys, "a", "b", row(F.col("y")).alias("ay"), "ax", row(F.col("y")).alias("by"), "bx")
    links = cut(links.unionByName(beside).distinct())
    label = F.col("root")
    if not links.isEmpty():
        r = r.join(large(label_links(links, keys).withColumnRenamed("id", "root")), [*keys, "root"], "left")
        label = F.coalesce("label", "root")
    side = F.lit(1 << 31).cast("long")
    return r.select(*cols, (label % side).cast("int").alias("label_x"), F.shiftright(label, 31).cast("int").alias("label_y"))


def merged_runs(r: DataFrame, value: str = "on", keys: list[str] = IMG, tile: int = TILE) -> DataFrame:
    """Maximal runs again (within tiles), of runs that cover their rows and have changed their value. Runs meet by tile, as ``label_runs`` has them."""
    t = r.withColumns({"_tx": F.floor(F.col("x0") / tile).cast("int"), "_ty": F.floor(F.col("y") / tile).cast("int")})
    line = Window.partitionBy(*keys, "_ty", "_tx").orderBy("y", "x0")
    joins = (F.lag("y").over(line) == F.col("y")) & F.lag(value).over(line).eqNullSafe(F.col(value)) & (F.lag("x1").over(line) + 1 == F.col("x0"))
    t = t.withColumn("_new", F.when(joins, 0).otherwise(1))
    t = t.withColumn("_g", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.groupBy(*keys, "_ty", "_tx", *SIZE, "y", value, "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return t.select(*keys, *SIZE, "y", value, "x0", "x1")


def _explode_runs(r: DataFrame) -> DataFrame:
    return r.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def components(p: DataFrame, cut_level: float = 128, white_only: bool = True, tile: int = TILE) -> DataFrame:
    """(image_id, frame, x, y, on, label_x, label_y) of the 4-connected components of a mask."""
    m = p.select(*IMG, *SIZE, *POS, (luminance() >= d(cut_level)).alias("on"))
    if white_only:
        m = m.filter("on")
    return _explode_runs(label_runs(runs(m, tile=tile), tile=tile)).select(*IMG, *POS, "on", "label_x", "label_y")


def _flip_small(r: DataFrame, value: bool, min_size: int, enclosed_only: bool, tile: int) -> DataFrame:
    """Runs with components of ``value`` smaller than ``min_size`` flipped."""
    every = label_runs(r, tile=tile)
    lab = every.filter(F.col("on") == value)
    edge = (F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1)
    key = [*IMG, "label_x", "label_y"]
    size = lab.groupBy(*key).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"), F.max(edge).alias("_edge"))
    small = F.col("_n") < min_size
    if enclosed_only:
        small = small & ~F.col("_edge")
    few = size.filter(small).select(*key, F.lit(True).alias("_flip"))
    t = lab.join(large(few), key, "left").select(*IMG, *SIZE, "y", "x0", "x1", F.when(F.col("_flip"), F.lit(not value)).otherwise(F.lit(value)).alias("on"))
    return t.unionByName(every.filter(F.col("on") != value).select(*IMG, *SIZE, "y", "x0", "x1", "on"))


def despeckle(p: DataFrame, min_area: float = 9, min_hole_area: float = 0, cut_level: float = 128, tile: int = TILE) -> DataFrame:
    """Drop white specks, then fill enclosed black holes; works on runs until the last step."""
    m = p.select(*IMG, *SIZE, *POS, (luminance() >= d(cut_level)).alias("on"))
    r = runs(m, tile=tile)
    if min_area > 1:
        r = _flip_small(r, True, int(min_area), False, tile)
    if min_hole_area > 0:
        if min_area > 1:  # flipped neighbours have to be merged into maximal runs again
            r = merged_runs(r, tile=tile)
        r = _flip_small(r, False, int(min_hole_area), True, tile)
    return bw(_explode_runs(r), F.col("on")).select(*PIXEL)


def magic_wand(p: DataFrame, seeds: DataFrame, tolerance: float, tile: int = TILE) -> DataFrame:
    """(image_id, frame, x, y): pixels connected to a seed within tolerance of that seed's colour.

    ``seeds`` is (image_id, frame, seed_id, x, y).  Each seed floods its own candidate pixels, all
    seeds of all images at once; the colour test is part of the join, so other pixels never leave it. Seeds go to every strip
    of ``tile`` rows of their image, and pixels meet them by strip.
    """
    keys = [*IMG, "seed_id"]
    s = seeds.select(*keys, jsround("x").alias("x"), jsround("y").alias("y"))
    s = s.join(p, [*IMG, *POS]).select(*keys, "h", F.col("x").alias("sx"), F.col("y").alias("sy"), *[F.col(ch).alias(f"_s{ch}") for ch in RGB])
    s = cut(s)
    strip = s.drop("sx", "sy").withColumn("_ty", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / tile).cast("int")))).drop("h")
    t = p.withColumn("_ty", F.floor(F.col("y") / tile).cast("int")).join(strip, [*IMG, "_ty"]).drop("_ty").filter(F.greatest(*[F.abs(F.col(ch) - F.col(f"_s{ch}")) for ch in RGB]) <= tolerance)
    r = runs(t.select(*keys, *SIZE, *POS, F.lit(True).alias("on")), keys=keys, tile=tile)
    lab = label_runs(r, keys=keys, tile=tile)
    start = s.select(*keys, F.col("sy").alias("y"), "sx")
    home = lab.join(start, [*keys, "y"]).filter("sx between x0 and x1").select(*keys, "label_x", "label_y").distinct()
    hit = lab.join(home, [*keys, "label_x", "label_y"], "left_semi")
    return _explode_runs(hit).select(*IMG, *POS).distinct()


def select_shapes(images: DataFrame, shapes: DataFrame) -> DataFrame:
    """(image_id, frame, x, y) inside rectangles and ellipses(image_id, frame, kind, x, y, w, h).

    A shape expands its own clipped rows and then columns; pixels are never joined to shapes.
    Negative sizes are normalised; an ellipse takes the pixels whose centre lies inside it.
    """
    s = shapes.select(
        *IMG, "kind", F.when(F.col("w") < 0, F.col("x") + F.col("w")).otherwise(F.col("x")).cast("double").alias("sx"),
        F.when(F.col("h") < 0, F.col("y") + F.col("h")).otherwise(F.col("y")).cast("double").alias("sy"),
        F.abs("w").cast("double").alias("sw"), F.abs("h").cast("double").alias("sh"),
    ).join(images.select(*IMG, *SIZE), IMG)
    y0, y1 = F.greatest(F.lit(0), F.floor("sy")).cast("int"), F.least(F.col("h"), F.ceil(F.col("sy") + F.col("sh"))).cast("int")
    x0, x1 = F.greatest(F.lit(0), F.floor("sx")).cast("int"), F.least(F.col("w"), F.ceil(F.col("sx") + F.col("sw"))).cast("int")
    t = s.withColumns({"_x0": x0, "_x1": x1 - 1, "_y0": y0, "_y1": y1 - 1}).filter("_x0 <= _x1 and _y0 <= _y1")
    t = t.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).repartition(*IMG, "y")
    t = t.withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    rx, ry = F.col("sw") / 2, F.col("sh") / 2
    nx = (d("x") + 0.5 - (F.col("sx") + rx)) / F.when(rx > 0, rx).otherwise(d(1))
    ny = (d("y") + 0.5 - (F.col("sy") + ry)) / F.when(ry > 0, ry).otherwise(d(1))
    inside = F.when(F.col("kind") == "ellipse", (rx > 0) & (ry > 0) & (nx * nx + ny * ny <= 1)).otherwise(F.lit(True))
    return t.filter(inside).select(*IMG, *POS).distinct()


def area_mask(p: DataFrame, seeds: DataFrame, tolerance: float, shapes: DataFrame) -> DataFrame:
    """Opaque mask of the union of flooded seeds and shapes."""
    sel = magic_wand(p, seeds, tolerance).union(select_shapes(images_of(p), shapes)).distinct().withColumn("_in", F.lit(True))
    t = p.join(sel, [*IMG, *POS], "left")
    return bw(t, F.col("_in").isNotNull()).select(*PIXEL)
