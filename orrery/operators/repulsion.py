"""Repulsion between all nodes of a layout: the exact sum over pairs, and the Barnes-Hut tree, distributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.config import Forces

#: A cell stands for its nodes if its side squared is less than OPENING times the distance squared. Fixed value.
OPENING = 0.45
#: Smallest distance squared.
LEAST_RSQ = 1e-6
#: Depth of the smallest cells; and the deepest tiles that work is dealt by: at most 4^8 rows are broadcast.
DEEPEST, TILE_DEPTH = 24, 8
#: Nodes wanted in a tile; receivers evaluated at once.
PER_TILE, BLOCK = 400, 512
#: How many times over a tile may be filled before tiles are made smaller.
DENSE = 4


def pair_factor(rsq: np.ndarray, m1: np.ndarray, m2: np.ndarray, r1: np.ndarray, r2: np.ndarray, leaf: np.ndarray, p: Forces) -> np.ndarray:
    """Force over displacement of a node (m1, r1) and a cell or, where ``leaf``, another node (m2, r2)."""
    rsq = np.maximum(rsq, LEAST_RSQ)
    far = np.where(rsq > p.falloff_rsq, rsq * rsq / p.falloff_rsq, rsq)
    out = m1 * m2 / far
    if p.close_repulsion:
        reach = p.close_c * (p.close_d + r1 + r2) ** 2
        near = leaf & (rsq < reach)
        with np.errstate(over="ignore"):
            push = p.close_a * np.minimum(p.close_b, np.expm1(4.0 * (reach - rsq))) / rsq + m1 * m2 / reach
        out = np.where(near, push, out)
    return out


def naive_forces(nodes: pd.DataFrame, p: Forces) -> pd.DataFrame:
    """(id, fx, fy) by the sum over all pairs, for tests: quadratic, in one process."""
    x, y, m, r = (nodes[c].to_numpy(dtype=float) for c in ("x", "y", "mass", "radius"))
    dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
    f = pair_factor(dx * dx + dy * dy, m[:, None], m[None, :], r[:, None], r[None, :], np.ones_like(dx, dtype=bool), p)
    np.fill_diagonal(f, 0.0)
    return pd.DataFrame({"id": nodes["id"], "fx": (dx * f).sum(1), "fy": (dy * f).sum(1)})


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of v (24) with a zero between each two."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def morton(x: np.ndarray, y: np.ndarray, low_x: float, low_y: float, side: float, depth: int) -> np.ndarray:
    """Codes of the quadtree cells at a depth; a cell's code begins its parts' codes."""
    most = (1 << depth) - 1
    at = lambda c, low: np.clip(((c - low) / side * (1 << depth)).astype(np.int64), 0, most)
    return (_spread(at(x, low_x)) | (_spread(at(y, low_y)) << np.uint64(1))).astype(np.int64)


class Cells:
    """Nodes or tiles sorted by code: a cell of any depth is a range, its sums are differences of running sums."""

    def __init__(self, code: np.ndarray, depth: int, n: np.ndarray, m: np.ndarray, mx: np.ndarray, my: np.ndarray, r: np.ndarray):
        self.code, self.depth, self.r = code, depth, r
        self.sums = [np.concatenate(([0], np.cumsum(v))) for v in (n, m, mx, my)]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        n, m, mx, my = (s[hi] - s[lo] for s in self.sums)
        return n, m, mx / m, my / m

    def parts(self, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the four cells one deeper than ``depth`` within the cells that begin at lo: arrays (k, 4)."""
        shift = 2 * (self.depth - depth - 1)
        first = (self.code[lo] >> (shift + 2)) << 2
        edges = np.searchsorted(self.code, (first[:, None] + np.arange(5)) << shift)
        return edges[:, :4], edges[:, 1:]


def _walk(own: dict[str, np.ndarray], own_tile: int, tiles: Cells, nodes: Cells, place: np.ndarray, side: float, p: Forces) -> tuple[np.ndarray, np.ndarray]:
    """Forces on the own nodes: all (node, cell) pairs are followed down the tree together, level by level."""
    k = len(own["x"])
    fx, fy = np.zeros(k), np.zeros(k)

    def level(who: np.ndarray, lo: np.ndarray, hi: np.ndarray, cells: Cells, depth: int, me: np.ndarray) -> np.ndarray:
        """Adds what stands for itself at this depth; returns which pairs must be opened."""
        n, m, cx, cy = cells.of(lo, hi)
        dx, dy = own["x"][who] - cx, own["y"][who] - cy
        rsq = np.maximum(dx * dx + dy * dy, LEAST_RSQ)
        holds = (lo <= me) & (me < hi)
        leaf = n == 1
        taken = ~holds & (leaf | ((side / (1 << depth)) ** 2 < OPENING * rsq))
        f = pair_factor(rsq[taken], own["mass"][who[taken]], m[taken], own["radius"][who[taken]], cells.r[lo[taken]], leaf[taken], p)
        to = who[taken]
        fx[:] += np.bincount(to, dx[taken] * f, k)
        fy[:] += np.bincount(to, dy[taken] * f, k)
        return ~taken & ~(holds & leaf)

    who, lo, hi = np.arange(k), np.zeros(k, dtype=np.int64), np.full(k, len(tiles.code))
    for depth in range(tiles.depth + 1):
        if not len(who):
            break
        open_ = level(who, lo, hi, tiles, depth, np.full(len(who), own_tile))
        who, lo, hi = who[open_], lo[open_], hi[open_]
        if depth < tiles.depth:
            a, b = tiles.parts(lo, depth)
            some = b > a
            who, lo, hi = np.repeat(who, 4).reshape(-1, 4)[some], a[some], b[some]
    # What is still open are tiles nearby, whose nodes are here.
    code = tiles.code[lo]
    shift = 2 * (nodes.depth - tiles.depth)
    lo, hi = np.searchsorted(nodes.code, code << shift), np.searchsorted(nodes.code, (code + 1) << shift)
    for depth in range(tiles.depth, nodes.depth + 1):
        if not len(who):
            break
        open_ = level(who, lo, hi, nodes, depth, place[who])
        who, lo, hi = who[open_], lo[open_], hi[open_]
        if depth < nodes.depth and len(who):
            a, b = nodes.parts(lo, depth)
            some = b > a
            who, lo, hi = np.repeat(who, 4).reshape(-1, 4)[some], a[some], b[some]
    # Nodes in one smallest cell lie on one another and don't push.
    return fx, fy


def local_forces(x: np.ndarray, y: np.ndarray, mass: np.ndarray, radius: np.ndarray, held: np.ndarray, p: Forces, block: int = 8 * BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The repulsive forces on nodes that are all here: the same tree and the same cells as in ``repulsion``."""
    fx, fy = np.zeros(len(x)), np.zeros(len(x))
    low_x, low_y = x.min(), y.min()
    side = max(x.max() - low_x, y.max() - low_y, 1e-10) * (1 + 1e-9)
    if not np.isfinite(side):
        return fx, fy
    mine = morton(x, y, low_x, low_y, side, DEEPEST)
    sort = np.argsort(mine, kind="stable")
    x, y, m, r = x[sort], y[sort], mass[sort], radius[sort]
    nodes = Cells(mine[sort], DEEPEST, np.ones(len(x), dtype=np.int64), m, m * x, m * y, r)
    one = lambda v: np.array([v.sum()])
    whole = Cells(np.zeros(1, dtype=np.int64), 0, np.array([len(x)]), one(m), one(m * x), one(m * y), np.array([r.max()]))
    at = np.flatnonzero(~held[sort])
    for begin in range(0, len(at), block):
        part = at[begin : begin + block]
        own = {"x": x[part], "y": y[part], "mass": m[part], "radius": r[part]}
        fx[sort[part]], fy[sort[part]] = _walk(own, 0, whole, nodes, part, side, p)
    return fx, fy


def repulsion(nodes: DataFrame, p: Forces, per_tile: int = PER_TILE, box: tuple | None = None) -> DataFrame:
    """(id, fx, fy): the repulsive force on each node of nodes(id, x, y, mass, radius[, held]); held nodes push but aren't pushed.

    The tree is that of the points: a cell of several is cut in four until each stands alone. Work is dealt by tiles, cells of one depth.
    A task has its tile's nodes, those of the 24 tiles around, and the sums of all tiles (at most 4^8 rows, broadcast): a tile further away
    is so distant that it always stands for its nodes. So a node is sent to at most 25 tasks, whatever the number of nodes.
    ``box``: (least x, greatest x, least y, greatest y, nodes), if known.
    """
    held = F.col("held") if "held" in nodes.columns else F.lit(False)
    rows = nodes.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "mass", "radius")], F.coalesce(held, F.lit(False)).alias("held"))
    box = box or rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not box[4]:
        return rows.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    low_x, low_y, side = box[0], box[2], max(box[1] - box[0], box[3] - box[2], 1e-10) * (1 + 1e-9)
    strips = 1 << TILE_DEPTH
    strip = lambda c, low: F.least(F.greatest(F.floor((F.col(c) - low) / side * strips), F.lit(0)), F.lit(strips - 1)).cast("int")
    placed = rows.withColumn("tx", strip("x", low_x)).withColumn("ty", strip("y", low_y))
    sums = placed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("x")).alias("mx"), F.sum(F.col("mass") * F.col("y")).alias("my"), F.max("radius").alias("r")).toPandas()
    # The shallowest depth at which no tile holds more than DENSE times what is wanted.
    for depth in range(TILE_DEPTH + 1):
        at = sums.assign(**{c: sums[c] // (1 << (TILE_DEPTH - depth)) for c in ("tx", "ty")}).groupby(["tx", "ty"], as_index=False).agg({"n": "sum", "m": "sum", "mx": "sum", "my": "sum", "r": "max"})
        if at["n"].max() <= DENSE * per_tile:
            break
    sums, strips = at, 1 << depth
    placed = placed.withColumns({c: F.shiftright(c, TILE_DEPTH - depth) for c in ("tx", "ty")})
    codes = (_spread(sums["tx"].to_numpy()) | (_spread(sums["ty"].to_numpy()) << np.uint64(1))).astype(np.int64)
    order = np.argsort(codes)
    sent = nodes.sparkSession.sparkContext.broadcast((codes[order], *[sums[c].to_numpy(dtype=float)[order] for c in ("n", "m", "mx", "my", "r")]))

    near = F.array(*[F.lit(k) for k in range(-2, 3)])
    for a in ("x", "y"):
        placed = placed.withColumn(f"o{a}", F.explode(F.filter(F.transform(near, lambda k: F.col(f"t{a}") + k), lambda t: (t >= 0) & (t < strips))))  # noqa: B023
    there = nodes.sparkSession.createDataFrame(sums[["tx", "ty"]].rename(columns={"tx": "ox", "ty": "oy"}).astype("int32"))
    dealt = placed.join(F.broadcast(there), ["ox", "oy"], "left_semi").select("ox", "oy", "id", "x", "y", "mass", "radius", "held", ((F.col("tx") == F.col("ox")) & (F.col("ty") == F.col("oy"))).alias("own"))

    def forces(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        code, n, m, mx, my, r = sent.value
        tiles = Cells(code, depth, n.astype(np.int64), m, mx, my, r)
        x, y, mass = (group[c].to_numpy() for c in ("x", "y", "mass"))
        # A node's code begins with its tile's: both cut the same box.
        mine = morton(x, y, low_x, low_y, side, DEEPEST)
        sort = np.lexsort((group["id"].to_numpy(), mine))
        g, mine = group.iloc[sort], mine[sort]
        x, y, mass = x[sort], y[sort], mass[sort]
        local = Cells(mine, DEEPEST, np.ones(len(g), dtype=np.int64), mass, mass * x, mass * y, g["radius"].to_numpy())
        tile = int(_spread(np.array([key[0]]))[0] | (_spread(np.array([key[1]]))[0] << np.uint64(1)))
        at = np.flatnonzero(g["own"].to_numpy() & ~g["held"].to_numpy())
        out = []
        for begin in range(0, len(at), BLOCK):
            part = at[begin : begin + BLOCK]
            own = {"x": x[part], "y": y[part], "mass": mass[part], "radius": g["radius"].to_numpy()[part]}
            fx, fy = _walk(own, int(np.searchsorted(code, tile)), tiles, local, part, side, p)
            out.append(pd.DataFrame({"id": g["id"].to_numpy()[part], "fx": fx, "fy": fy}))
        return pd.concat(out) if out else pd.DataFrame({"id": np.array([], dtype="int64"), "fx": np.array([], dtype=float), "fy": np.array([], dtype=float)})

    moved = dealt.groupBy("ox", "oy").applyInPandas(forces, "id bigint, fx double, fy double")
    return rows.select("id").join(moved, "id", "left").select("id", F.coalesce("fx", F.lit(0.0)).alias("fx"), F.coalesce("fy", F.lit(0.0)).alias("fy"))


def quadtree_cells(nodes: DataFrame, depths: int) -> DataFrame:
    """(depth, cx, cy, n, mass, x, y): mass and centre of mass of every occupied cell down to a depth, over the points' square box."""
    box = nodes.agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"))
    rows = nodes.join(F.broadcast(box)).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depths))))
    strips = F.pow(F.lit(2.0), F.col("depth"))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"l{c}")) / F.greatest(F.col("side"), F.lit(1e-10)) * strips), strips - 1).cast("bigint")
    return rows.groupBy("depth", cell("x").alias("cx"), cell("y").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), (F.sum(F.col("mass") * F.col("x")) / F.sum("mass")).alias("x"), (F.sum(F.col("mass") * F.col("y")) / F.sum("mass")).alias("y")
    )
