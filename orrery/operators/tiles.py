"""The map: its bounds, tile and label pyramids, spatial joins and category labels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room around the map.
PADDING = 100
#: Smallest radius of a drawn circle, in pixels, and a tile's pixels.
LEAST_PIXELS, TILE_PIXELS = 0.09, 256
#: Divisions of the tile pyramid; and of the label pyramid: zones, scale, whether category and region labels show. Fixed values.
TILE_DIVISIONS = [4, 8, 16, 32, 64, 128, 256, 512]
ZONE_DIVISIONS = [
    (1, 1, True, False), (1, 2, True, False), (1, 4, False, True), (1, 8, False, True), (2, 16, False, False), (4, 32, False, False),
    (8, 64, False, False), (16, 128, False, False), (32, 256, False, False), (64, 512, False, False),
]


def _trunc_div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, cut towards zero."""
    return (F.signum(a) * F.signum(b)).cast("bigint") * F.floor(F.abs(a) / F.abs(b)).cast("bigint")


def world_bounds(positions: DataFrame, centred: bool = False) -> DataFrame:
    """(minx, maxx, miny, maxy, maxr): one row; the circles' bounds and the origin, with room around; symmetric about the centre of mass
    (r squared) if ``centred``. No positions give the origin's surroundings."""
    x, y, r = (F.col(c).cast("bigint") for c in ("x", "y", "r"))
    m = r * r
    zero = F.lit(0).cast("bigint")
    edge = lambda f, g, c: g(zero, F.coalesce(f(c), zero))
    sums = positions.agg(
        (edge(F.min, F.least, x - r) - PADDING).alias("minx"), (edge(F.max, F.greatest, x + r) + PADDING).alias("maxx"), (edge(F.min, F.least, y - r) - PADDING).alias("miny"),
        (edge(F.max, F.greatest, y + r) + PADDING).alias("maxy"), F.coalesce(F.max(r), zero).alias("maxr"), F.sum(m).alias("m"), F.sum(m * x).alias("mx"), F.sum(m * y).alias("my"),
    )
    if centred:
        for c in "xy":
            low, high = F.col(f"min{c}"), F.col(f"max{c}")
            at = _trunc_div(F.col(f"m{c}"), F.col("m"))
            sums = sums.withColumn("__at", F.when(F.col("m") > 0, at)).withColumns(
                {f"min{c}": F.when(F.col("__at").isNull() | (F.col("__at") - low > high - F.col("__at")), low).otherwise(2 * F.col("__at") - high), f"max{c}": F.when(F.col("__at") - low > high - F.col("__at"), 2 * F.col("__at") - low).otherwise(high)}
            )
    return sums.select("minx", "maxx", "miny", "maxy", "maxr")


def tile_pyramid(bounds: DataFrame, most: int = 256) -> DataFrame:
    """(depth, divs, tw) of each depth, with the bounds: square tiles of whole width."""
    levels = [F.struct(F.lit(k).alias("depth"), F.lit(d).alias("divs")) for k, d in enumerate(TILE_DIVISIONS) if d <= most]
    side = F.greatest((F.col("maxx") - F.col("minx")) / F.col("divs"), (F.col("maxy") - F.col("miny")) / F.col("divs"))
    return bounds.select("*", F.inline(F.array(*levels))).withColumn("tw", F.floor(side).cast("bigint"))


def zone_pyramid(bounds: DataFrame, most: int = 32) -> DataFrame:
    """(depth, divs, scale, tw, cats, regs) of each depth of the label pyramid, with the bounds."""
    kept = []
    for k, (zones, scale, cats, regs) in enumerate(ZONE_DIVISIONS):
        if zones > most:
            break
        kept.append(F.struct(F.lit(k).alias("depth"), F.lit(zones).alias("divs"), F.lit(scale).alias("sdivs"), F.lit(cats).alias("cats"), F.lit(regs).alias("regs")))
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    rows = bounds.select("*", F.inline(F.array(*kept)))
    return rows.withColumn("tw", F.floor(side / F.col("divs")).cast("bigint")).withColumn("scale", F.floor(side / F.col("sdivs")).cast("bigint")).drop("sdivs")


def _touched(centre: Column, half: Column, low: Column, width: Column, divs: Column) -> Column:
    """The numbers (from 1) of the strips that centre +- half may touch, one strip more on either side; the exact test follows."""
    first = F.floor((centre - half - low) / width).cast("int")
    last = F.floor((centre + half - low) / width).cast("int") + 2
    a, b = F.greatest(first, F.lit(1)), F.least(last, divs.cast("int"))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def tile_members(positions: DataFrame, pyramid: DataFrame, widened: bool = True) -> DataFrame:
    """(depth, xi, yi) of every tile with the rows of positions that its drawing must consider.

    A tile's box, its middle and half size cut to whole numbers, widened by the greatest radius and by the circle's own, edges included.
    Each circle names the few tiles it may touch (an explode over the pyramid's at most eight levels, which are broadcast); nothing is
    shuffled until tiles are grouped. Without ``widened`` a tile has only what leaves a mark in it, that is circles whose own radius, or a pixel, reaches it: the
    drawing is the same, and one great circle doesn't multiply the tiles of all others.
    """
    rows = positions.join(F.broadcast(pyramid))
    half = F.floor(F.col("tw") / 2)
    own = F.col("maxr") + F.col("r") if widened else F.greatest(F.col("r"), F.ceil(F.col("tw") / TILE_PIXELS)) + 1
    reach = half + own
    for c, n in (("x", "xi"), ("y", "yi")):
        rows = rows.withColumn(n, F.explode(_touched(F.col(c), own, F.col(f"min{c}"), F.col("tw"), F.col("divs"))))
        # The middle lies halfway into the tile and is cut towards zero.
        middle = (F.col(f"min{c}") + (F.col(n) - 0.5) * F.col("tw")).cast("bigint")
        rows = rows.where(F.abs(F.col(c) - middle) <= reach)
    return rows.select("depth", "xi", "yi", *positions.columns)


def draw_list(members: DataFrame, pyramid: DataFrame, colour: Column, pixels: int = TILE_PIXELS) -> DataFrame:
    """What a rasteriser draws: (depth, xi, yi, id, px, py, pr, colour) in the pixels of each tile, circles at least 0.09 wide."""
    rows = members.join(F.broadcast(pyramid.select("depth", "minx", "miny", "tw")), "depth")
    scale = pixels / F.col("tw")
    at = lambda c, n: (F.col(c) - F.col(f"min{c}") - (F.col(n) - 1) * F.col("tw")) * scale
    return rows.select("depth", "xi", "yi", "id", at("x", "xi").alias("px"), at("y", "yi").alias("py"), F.greatest(F.col("r") * scale, F.lit(LEAST_PIXELS)).alias("pr"), colour.alias("colour"))


def zone_labels(positions: DataFrame, pyramid: DataFrame, cat_labels: DataFrame | None = None, reg_labels: DataFrame | None = None) -> DataFrame:
    """(depth, xi, yi, x, y, r, label): the labels of each zone.

    positions(x, y, r, label): papers with a label whose radius exceeds a hundredth of the zone's scale, and whose circle reaches the zone's
    box, edges included. Category and region labels (x, y, r, label) show at the depths that have them, strictly inside.
    """
    papers_ = positions.select("x", "y", "r", "label").where("label <> ''")
    parts = []
    for rows, flag in ((papers_, None), (cat_labels, "cats"), (reg_labels, "regs")):
        if rows is None:
            continue
        near = rows.select("x", "y", "r", "label").join(F.broadcast(pyramid if flag is None else pyramid.where(flag)))
        half = F.floor(F.col("tw") / 2)
        if flag is None:
            near = near.where(F.col("r") > F.floor(F.col("scale") * 0.01))
        for c, n in (("x", "xi"), ("y", "yi")):
            near = near.withColumn(n, F.explode(_touched(F.col(c), F.col("r") if flag is None else F.lit(0), F.col(f"min{c}"), F.col("tw"), F.col("divs"))))
            middle = F.col(f"min{c}") + (F.col(n) - 1) * F.col("tw") + half
            off = F.abs(F.col(c) - middle)
            near = near.where(off <= half + F.col("r") if flag is None else off < half)
        parts.append(near.select("depth", "xi", "yi", *[F.col(c).cast("bigint").alias(c) for c in "xyr"], "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zone_json(labels: DataFrame, pyramid: DataFrame) -> DataFrame:
    """(depth, xi, yi, json): each zone's file; a zone without labels has none. Zones are bounded by what is legible in them."""
    item = F.to_json(F.struct("x", "y", "r", F.col("label").alias("lbl")))
    rows = labels.groupBy("depth", "xi", "yi").agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), item.alias("j")))).alias("l"))
    rows = rows.join(F.broadcast(pyramid.select("depth", "scale")), "depth")
    name = F.concat_ws("_", F.lit("lz"), "depth", "xi", "yi")
    return rows.select("depth", "xi", "yi", F.concat(name, F.lit('({"scale":'), F.col("scale"), F.lit(',"lbls":['), F.array_join(F.transform("l", lambda s: s["j"]), ","), F.lit("]})")).alias("json"))


def world_index(bounds: DataFrame, latest: DataFrame, tiles: DataFrame, zones: DataFrame) -> DataFrame:
    """(json): one row, the index of the map: bounds, latest identifier, tile and zone levels. latest(latestid), one row."""
    t = tiles.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("depth").alias("z"), F.col("tw"), F.col("tw").alias("th"), F.col("divs").alias("nx"), F.col("divs").alias("ny"))))).alias("tilings"))
    z = zones.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("depth").alias("z"), F.col("scale").alias("s"), F.col("tw").alias("w"), F.col("tw").alias("h"), F.col("divs").alias("nx"), F.col("divs").alias("ny"))))).alias("zones"))
    rows = bounds.join(F.broadcast(latest)).join(F.broadcast(t)).join(F.broadcast(z))
    head = F.to_json(F.struct("latestid", F.col("minx").alias("xmin"), F.col("miny").alias("ymin"), F.col("maxx").alias("xmax"), F.col("maxy").alias("ymax")))
    return rows.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"tilings":'), F.col("tilings"), F.lit(',"zones":'), F.col("zones"), F.lit("}")).alias("json"))


def category_labels(positions: DataFrame, display: DataFrame) -> DataFrame:
    """(cat, label, x, y, r): each displayed category's centre of mass (r squared), cut to whole numbers, and half the diagonal of its box,
    which holds the origin. positions(cat, x, y, r), display(cat, display) of at most 256 rows; categories without mass have none."""
    x, y, r = (F.col(c).cast("bigint") for c in ("x", "y", "r"))
    m, zero = r * r, F.lit(0).cast("bigint")
    span = lambda c: F.greatest(zero, F.max(c)) - F.least(zero, F.min(c))
    sums = positions.groupBy("cat").agg(F.sum(m).alias("m"), F.sum(m * x).alias("mx"), F.sum(m * y).alias("my"), span(x).alias("dx"), span(y).alias("dy"))
    rows = sums.join(F.broadcast(display.where("display <> ''")), "cat").where("m > 0")
    half = F.floor(F.sqrt(F.pow(F.col("dx"), 2) + F.pow(F.col("dy"), 2)) / 2).cast("bigint")
    return rows.select("cat", F.col("display").alias("label"), _trunc_div(F.col("mx"), F.col("m")).alias("x"), _trunc_div(F.col("my"), F.col("m")).alias("y"), half.alias("r"))


def at_point(positions: DataFrame, x: float, y: float, edge: bool = True) -> DataFrame:
    """(id, r) of the circle that holds a point, of several that of the smallest identifier; on the edge counts unless ``edge`` is false."""
    d = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)) - F.col("r")
    return positions.where((F.abs(F.col("x") - x) <= F.col("r")) & (F.abs(F.col("y") - y) <= F.col("r")) & ((d <= 0) if edge else (d < 0))).orderBy("id").limit(1).select("id", "r")


def points_to_papers(points: DataFrame, positions: DataFrame, cell: int = 512) -> DataFrame:
    """(point, id) for many points (point, x, y) at once: each circle names the cells of a grid that it touches, and meets the points there."""
    grid = lambda c: F.floor(c / cell).cast("bigint")
    p = points.select("point", F.col("x").alias("px"), F.col("y").alias("py"), grid(F.col("x")).alias("gx"), grid(F.col("y")).alias("gy"))
    c = positions.select("id", "x", "y", "r")
    for axis in "xy":
        c = c.withColumn(f"g{axis}", F.explode(F.sequence(grid(F.col(axis) - F.col("r")), grid(F.col(axis) + F.col("r")))))
    hit = p.join(c, ["gx", "gy"]).where(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) <= F.pow(F.col("r").cast("double"), 2))
    return hit.groupBy("point").agg(F.min("id").alias("id"))


def rasterise(drawn: DataFrame, pixels: int = TILE_PIXELS) -> DataFrame:
    """(depth, xi, yi, circles, png): the drawing of a draw list, a tile per group, the largest circles first; of the few tiles of the first
    depths each holds a share of the whole map, which one task draws."""
    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pr", "id"], ascending=[False, True])
        image = np.zeros((pixels, pixels, 4), dtype=np.uint8)
        for px, py, pr, rgb in zip(rows["px"], rows["py"], np.maximum(rows["pr"], 0.5), rows["colour"]):
            # Only the pixels of the circle's own square are looked at.
            x0, x1, y0, y1 = max(0, int(px - pr)), min(pixels, int(px + pr) + 2), max(0, int(py - pr)), min(pixels, int(py + pr) + 2)
            if x0 < x1 and y0 < y1:
                gy, gx = np.ogrid[y0:y1, x0:x1]
                image[y0:y1, x0:x1][(gx + 0.5 - px) ** 2 + (gy + 0.5 - py) ** 2 <= pr**2] = [*(int(255 * rgb[c]) for c in "rgb"), 255]
        # A line of the image begins with the number of its filter, none.
        raw = np.concatenate((np.zeros((pixels, 1), dtype=np.uint8), image.reshape(pixels, -1)), axis=1).tobytes()
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels, pixels, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")
        return pd.DataFrame({"depth": [key[0]], "xi": [key[1]], "yi": [key[2]], "circles": [len(rows)], "png": [png]})

    # Rows are few for the work that they make, so the number of parts isn't left to their size.
    parts = max(64, int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return drawn.repartition(parts, "depth", "xi", "yi").groupBy("depth", "xi", "yi").applyInPandas(draw, "depth int, xi int, yi int, circles bigint, png binary")
