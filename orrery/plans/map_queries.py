"""Queries of the map: bounds, pyramids, tiles, labels, colours, point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import colours, labels, measures
from orrery.functions.ids import days_ago
from orrery.operators import citations as C
from orrery.operators import tiles as T
from orrery.plans import catalog_queries
from orrery.plans.catalog_queries import _ASOF, _DAY, _as_of
from orrery.plans.registry import Registry
from orrery.session import scratch
from orrery.sources import json_sources as J
from orrery.sources.tables import table

R = Registry()
query = R.query

_POS = ", pos as (select distinct id, cast(x as bigint) as x, cast(y as bigint) as y, cast(r as bigint) as r from map_data)"
_BOUNDS = _POS + """, bounds as (
    select least(0, min(x - r)) - 100 as minx, greatest(0, max(x + r)) + 100 as maxx, least(0, min(y - r)) - 100 as miny, greatest(0, max(y + r)) + 100 as maxy, max(r) as maxr from pos)"""
_TILES = _BOUNDS + """, pyramid as (
    select b.*, depth, divs, cast(floor(greatest((maxx - minx) / divs, (maxy - miny) / divs)) as bigint) as tw
    from bounds b, (values (0, 4), (1, 8), (2, 16), (3, 32), (4, 64), (5, 128), (6, 256)) v(depth, divs))"""
_ZONES = _BOUNDS + """, zones as (
    select b.*, depth, divs, cats, cast(floor(greatest(maxx - minx, maxy - miny) / divs) as bigint) as tw, cast(floor(greatest(maxx - minx, maxy - miny) / sdivs) as bigint) as scale
    from bounds b, (values (0, 1, 1, true), (1, 1, 2, true), (2, 1, 4, false), (3, 1, 8, false), (4, 2, 16, false), (5, 4, 32, false), (6, 8, 64, false), (7, 16, 128, false), (8, 32, 256, false)) v(depth, divs, sdivs, cats))"""
_CATLABELS = """, catlabels as (
    select maincat as cat, upper(maincat) as label, cast(trunc(sum(r * r * x) / sum(r * r)) as bigint) as x, cast(trunc(sum(r * r * y) / sum(r * r)) as bigint) as y,
           cast(floor(sqrt(pow(greatest(0, max(x)) - least(0, min(x)), 2) + pow(greatest(0, max(y)) - least(0, min(y)), 2)) / 2) as bigint) as r
    from pos join papers on pos.id = papers.id group by maincat having sum(r * r) > 0)"""


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "map_data").distinct()


def _membership(spark: SparkSession, folder: str, *most: int) -> DataFrame:
    pos = _positions(spark, folder)
    members = T.tile_members(pos, T.tile_pyramid(T.world_bounds(pos), *most))
    return members.groupBy("depth", "xi", "yi").agg(F.count(F.lit(1)).alias("papers"), F.sum(F.col("id") % 1000003).alias("checksum"))


def _category_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _positions(spark, folder).join(C.papers(spark, folder, "maincat"), "id")
    names = C.papers(spark, folder, "maincat").select(F.col("maincat").alias("cat"), F.upper("maincat").alias("display")).distinct()
    return T.category_labels(rows.select(F.col("maincat").alias("cat"), "x", "y", "r"), names)


def _colour_table(spark: SparkSession, folder: str) -> DataFrame:
    """(cat, col, dim): colours given to the categories by their number, at most 255 rows."""
    n = F.col("number")
    return C.category_dictionary(C.papers(spark, folder, "maincat", where="true")).select("cat", F.array(*[(n * k % 10) / 10.0 for k in (3, 7, 9)]).alias("col"), F.array(F.lit(0.55), F.lit(0.48)).alias("dim"))


def _coloured(spark: SparkSession, folder: str) -> DataFrame:
    """Positions with age rank, main category's colour, and days since the paper's day."""
    rows = _positions(spark, folder).join(C.papers(spark, folder, "maincat"), "id")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    aged = C.indexed(rows).join(F.broadcast(n)).withColumn("age", F.col("idx") / F.col("n"))
    return aged.join(F.broadcast(_colour_table(spark, folder)), F.col("maincat") == F.col("cat"), "left").join(F.broadcast(_as_of(spark, folder)))


_RGB = _POS + """, d as (select cat, row_number() over (order by cat) as n from (select distinct lower(trim(maincat)) as cat from cur where trim(maincat) <> '') order by cat limit 255),
    aged as (select pos.id, (row_number() over (order by pos.id) - 1) / cast(count(*) over () as double) as age, (n * 3 % 10) / 10.0 as c0, (n * 7 % 10) / 10.0 as c1, (n * 9 % 10) / 10.0 as c2
             from pos join papers p on pos.id = p.id left join d on p.maincat = d.cat),
    k as (select *, 0.1 + 0.3 * (1 - age) as pale, least(1.0, 0.55 + 0.48 * exp(-4 * (1 - age) * (1 - age))) as dim from aged),
    rgb as (select id, dim * (pale + c0 * (1 - pale)) as r, dim * (pale + c1 * (1 - pale)) as g, dim * (pale + c2 * (1 - pale)) as b from k)"""


def _flat(rows: DataFrame, rgb) -> DataFrame:
    return rows.select("id", rgb.alias("c")).select("id", *[F.round(F.col(f"c.{k}"), 6).alias(k) for k in "rgb"])


@query(_BOUNDS + " select * from bounds")
def world_bounds(spark, folder):
    return T.world_bounds(_positions(spark, folder))


@query(_BOUNDS + """, c as (select cast(trunc(sum(r * r * x) / sum(r * r)) as bigint) as cx, cast(trunc(sum(r * r * y) / sum(r * r)) as bigint) as cy from pos)
    select case when cx - minx > maxx - cx then minx else 2 * cx - maxx end as minx, case when cx - minx > maxx - cx then 2 * cx - minx else maxx end as maxx,
           case when cy - miny > maxy - cy then miny else 2 * cy - maxy end as miny, case when cy - miny > maxy - cy then 2 * cy - miny else maxy end as maxy, maxr from bounds, c""")
def world_bounds_centred(spark, folder):
    return T.world_bounds(_positions(spark, folder), centred=True)


@query(_TILES + " select depth, divs, tw from pyramid")
def tile_pyramid(spark, folder):
    return T.tile_pyramid(T.world_bounds(_positions(spark, folder))).select("depth", "divs", "tw")


@query(_ZONES + " select depth, divs, scale, tw from zones")
def zone_pyramid(spark, folder):
    return T.zone_pyramid(T.world_bounds(_positions(spark, folder))).select("depth", "divs", "scale", "tw")


@query(_TILES + """, mid as (select depth, n, cast(trunc(minx + (n - 0.5) * tw) as bigint) as mx, cast(trunc(miny + (n - 0.5) * tw) as bigint) as my, cast(floor(tw / 2) as bigint) as half, maxr
                             from (select *, unnest(range(1, divs + 1)) as n from pyramid where divs <= 64))
    select a.depth, cast(a.n as int) as xi, cast(b.n as int) as yi, count(*) as papers, sum(pos.id % 1000003)::bigint as checksum
    from pos join mid a on abs(pos.x - a.mx) <= a.half + a.maxr + pos.r join mid b on a.depth = b.depth and abs(pos.y - b.my) <= b.half + b.maxr + pos.r group by 1, 2, 3""")
def tile_membership(spark, folder):
    """The depths to 64 divisions, to which its SQL goes; tile_membership_whole has all."""
    return _membership(spark, folder, 64)


@query(_TILES + """, mid as (select depth, n, cast(trunc(minx + (n - 0.5) * tw) as bigint) as mx, cast(trunc(miny + (n - 0.5) * tw) as bigint) as my, cast(floor(tw / 2) as bigint) as half, maxr
                             from (select *, unnest(range(1, divs + 1)) as n from pyramid))
    select a.depth, cast(a.n as int) as xi, cast(b.n as int) as yi, count(*) as papers, sum(pos.id % 1000003)::bigint as checksum
    from pos join mid a on abs(pos.x - a.mx) <= a.half + a.maxr + pos.r join mid b on a.depth = b.depth and abs(pos.y - b.my) <= b.half + b.maxr + pos.r group by 1, 2, 3""")
def tile_membership_whole(spark, folder):
    return _membership(spark, folder)


@query(_ZONES + _CATLABELS + """, named as (select pos.*, maincat as label from pos join papers on pos.id = papers.id),
    mid as (select z.depth, n, z.minx + (n - 1) * tw + tw // 2 as mx, z.miny + (n - 1) * tw + tw // 2 as my, tw // 2 as half, cast(floor(scale * 0.01) as bigint) as least, cats from (select *, unnest(range(1, divs + 1)) as n from zones) z)
    select a.depth, cast(a.n as int) as xi, cast(b.n as int) as yi, x, y, r, label from named join mid a on abs(x - a.mx) <= a.half + r and r > a.least join mid b on a.depth = b.depth and abs(y - b.my) <= b.half + r
    union all
    select a.depth, cast(a.n as int), cast(b.n as int), x, y, r, label from catlabels join mid a on a.cats and abs(x - a.mx) < a.half join mid b on a.depth = b.depth and abs(y - b.my) < b.half""")
def zone_labels(spark, folder):
    pos = _positions(spark, folder)
    named = pos.join(C.papers(spark, folder, "maincat"), "id").withColumnRenamed("maincat", "label")
    return T.zone_labels(named, T.zone_pyramid(T.world_bounds(pos)), _category_labels(spark, folder))


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, one for each category, by way of a regions file as a map's editor writes it."""
    path = scratch(spark, "regions")
    rows = _category_labels(spark, folder).select(F.col("x").alias("X"), F.col("y").alias("Y"), F.col("r").alias("Radius"), F.concat(F.lit("region "), "cat").alias("Label"))
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)  # at most 255 rows
    return J.read_regions(spark, path).withColumnRenamed("radius", "r")


@query(_ZONES.replace("divs, cats, cast", "divs, depth in (2, 3) as regs, cast") + _CATLABELS + """, mid as (select z.depth, n, z.minx + (n - 1) * tw + tw // 2 as mx, z.miny + (n - 1) * tw + tw // 2 as my, tw // 2 as half, regs from (select *, unnest(range(1, divs + 1)) as n from zones) z)
    select a.depth, cast(a.n as int) as xi, cast(b.n as int) as yi, x, y, r, 'region ' || cat as label from catlabels join mid a on a.regs and abs(x - a.mx) < a.half join mid b on a.depth = b.depth and abs(y - b.my) < b.half""")
def region_labels(spark, folder):
    """The region labels of every zone that shows them."""
    pos = _positions(spark, folder)
    none = pos.withColumn("label", F.lit("")).limit(0)
    return T.zone_labels(none, T.zone_pyramid(T.world_bounds(pos)), None, _regions(spark, folder))


@query(_ZONES.replace("divs, cats, cast", "divs, cats, depth in (2, 3) as regs, cast") + _CATLABELS + ", lab as (" + "select id, regexp_replace(case" + catalog_queries.ORACLES["paper_labels"].split("select id, regexp_replace(case", 1)[1] + """), named as (select pos.*, label from pos join lab on pos.id = lab.id where label <> ''),
    mid as (select z.depth, n, scale, z.minx + (n - 1) * tw + tw // 2 as mx, z.miny + (n - 1) * tw + tw // 2 as my, tw // 2 as half, cast(floor(scale * 0.01) as bigint) as least, cats, regs from (select *, unnest(range(1, divs + 1)) as n from zones) z),
    every as (select a.depth, a.scale, a.n as xi, b.n as yi, x, y, r, label from named join mid a on abs(x - a.mx) <= a.half + r and r > a.least join mid b on a.depth = b.depth and abs(y - b.my) <= b.half + r
              union all select a.depth, a.scale, a.n, b.n, x, y, r, label from catlabels join mid a on a.cats and abs(x - a.mx) < a.half join mid b on a.depth = b.depth and abs(y - b.my) < b.half
              union all select a.depth, a.scale, a.n, b.n, x, y, r, 'region ' || cat from catlabels join mid a on a.regs and abs(x - a.mx) < a.half join mid b on a.depth = b.depth and abs(y - b.my) < b.half),
    item as (select depth, scale, xi, yi, r, '{"x":' || x || ',"y":' || y || ',"r":' || r || ',"lbl":' || to_json(label) || '}' as j from every)
    select depth, cast(xi as int) as xi, cast(yi as int) as yi, 'lz_' || depth || '_' || xi || '_' || yi || '({"scale":' || scale || ',"lbls":[' || string_agg(j, ',' order by -r, j) || ']})' as json from item group by depth, scale, xi, yi""")
def zone_label_files(spark, folder):
    pos = _positions(spark, folder)
    named = pos.join(C.papers(spark, folder, "authors", "keywords", "title"), "id")
    named = named.withColumn("label", labels.paper_label(F.col("authors"), F.col("keywords"), F.col("title")))
    zones = T.zone_pyramid(T.world_bounds(pos))
    return T.zone_json(T.zone_labels(named, zones, _category_labels(spark, folder), _regions(spark, folder)), zones)


_DRAWN = _TILES + _RGB.replace(_POS, "") + """, mid as (select depth, n, tw, minx, miny, cast(trunc(minx + (n - 0.5) * tw) as bigint) as mx, cast(trunc(miny + (n - 0.5) * tw) as bigint) as my, cast(floor(tw / 2) as bigint) as half
                             from (select *, unnest(range(1, divs + 1)) as n from pyramid)),
    mark as (select a.depth, cast(a.n as int) as xi, cast(b.n as int) as yi, pos.id, (pos.x - a.minx - (a.n - 1) * a.tw) * 256.0 / a.tw as px, (pos.y - a.miny - (b.n - 1) * a.tw) * 256.0 / a.tw as py, greatest(pos.r * 256.0 / a.tw, 0.09) as pr
             from pos join mid a on abs(pos.x - a.mx) <= a.half + greatest(pos.r, ceil(a.tw / 256.0)) + 1 join mid b on a.depth = b.depth and abs(pos.y - b.my) <= b.half + greatest(pos.r, ceil(a.tw / 256.0)) + 1)"""


def _draw_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = _coloured(spark, folder)
    pyramid = T.tile_pyramid(T.world_bounds(_positions(spark, folder)))
    paint = rows.withColumn("rgb", colours.category_colour(F.col("col"), F.col("dim"), F.col("age"))).select("id", "x", "y", "r", "rgb")
    return T.draw_list(T.tile_members(paint, pyramid, widened=False), pyramid, F.col("rgb"))


@query(_DRAWN + " select depth, xi, yi, mark.id, round(px, 4) + 0.0 as px, round(py, 4) + 0.0 as py, round(pr, 4) as pr, round(rgb.r, 5) as red, round(rgb.g, 5) as green, round(rgb.b, 5) as blue from mark join rgb on mark.id = rgb.id")
def tile_draw_list(spark, folder):
    """All depths of the pyramid."""
    at = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return _draw_list(spark, folder).select("depth", "xi", "yi", "id", at("px"), at("py"), F.round("pr", 4).alias("pr"), *[F.round(f"colour.{c}", 5).alias(n) for c, n in zip("rgb", ("red", "green", "blue"))])


@query(_DRAWN + " select depth, xi, yi, count(*) as circles, true as drawn from mark join rgb on mark.id = rgb.id group by 1, 2, 3")
def tile_images(spark, folder):
    """The tiles as PNG images, all depths: how many circles each draws, and whether it is an image."""
    images = T.rasterise(_draw_list(spark, folder))
    return images.select("depth", "xi", "yi", "circles", (F.hex(F.substring("png", 1, 8)) == "89504E470D0A1A0A").alias("drawn"))


@query(_BOUNDS + """, i as (select b.*, (select max(id) from papers) as latestid from bounds b),
    t as (select string_agg('{"z":' || depth || ',"tw":' || tw || ',"th":' || tw || ',"nx":' || divs || ',"ny":' || divs || '}', ',' order by depth) as s
          from (select depth, divs, cast(floor(greatest((maxx - minx) / divs, (maxy - miny) / divs)) as bigint) as tw from bounds, (values (0, 4), (1, 8), (2, 16), (3, 32), (4, 64), (5, 128), (6, 256)) v(depth, divs))),
    z as (select string_agg('{"z":' || depth || ',"s":' || scale || ',"w":' || tw || ',"h":' || tw || ',"nx":' || divs || ',"ny":' || divs || '}', ',' order by depth) as s
          from (select depth, divs, cast(floor(greatest(maxx - minx, maxy - miny) / divs) as bigint) as tw, cast(floor(greatest(maxx - minx, maxy - miny) / sdivs) as bigint) as scale
                from bounds, (values (0, 1, 1), (1, 1, 2), (2, 1, 4), (3, 1, 8), (4, 2, 16), (5, 4, 32), (6, 8, 64), (7, 16, 128), (8, 32, 256)) v(depth, divs, sdivs)))
    select '{"latestid":' || latestid || ',"xmin":' || minx || ',"ymin":' || miny || ',"xmax":' || maxx || ',"ymax":' || maxy || ',"tilings":[' || t.s || '],"zones":[' || z.s || ']}' as json from i, t, z""")
def world_index(spark, folder):
    bounds = T.world_bounds(_positions(spark, folder))
    latest = C.papers(spark, folder).agg(F.max("id").alias("latestid"))
    return T.world_index(bounds, latest, T.tile_pyramid(bounds), T.zone_pyramid(bounds))


@query(_POS + _CATLABELS + " select * from catlabels")
def category_label_centroid(spark, folder):
    return _category_labels(spark, folder)


@query(_POS + " select maincat as cat, count(*) as papers, round(avg(x), 4) as x, round(avg(y), 4) as y from pos join papers on pos.id = papers.id group by maincat")
def category_centroid(spark, folder):
    from orrery.operators.layout import category_centres

    rows = _positions(spark, folder).join(C.papers(spark, folder, "maincat"), "id").withColumnRenamed("maincat", "cat")
    return category_centres(rows).select("cat", "papers", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_POS + " select maincat as cat, round(atan2(sum(1.0 * r * r * y) / sum(r * r), sum(1.0 * r * r * x) / sum(r * r)), 6) as angle from pos join papers on pos.id = papers.id group by maincat")
def category_orientation(spark, folder):
    m = F.col("r").cast("double") * F.col("r")
    rows = _positions(spark, folder).join(C.papers(spark, folder, "maincat"), "id").groupBy(F.col("maincat").alias("cat"))
    return rows.agg(F.round(F.atan2(F.sum(m * F.col("y")) / F.sum(m), F.sum(m * F.col("x")) / F.sum(m)), 6).alias("angle"))


@query(_POS + " select id, r from pos where sqrt(pow(x + 15783, 2) + pow(y + 13454, 2)) - r <= 0 order by id limit 1")
def point_lookup(spark, folder):
    return T.at_point(_positions(spark, folder), -15783, -13454).select("id", F.col("r").cast("bigint").alias("r"))


@query(_POS + ", n as (select id, x, y, r from pos order by r desc, id limit 1) select pos.id, pos.r from pos, n where sqrt(pow(pos.x - n.x - n.r + 1, 2) + pow(pos.y - n.y, 2)) - pos.r < 0 order by pos.id limit 1")
def node_at_point(spark, folder):
    """The node whose disc holds a point strictly: one just inside the rim of the largest."""
    pos = _positions(spark, folder)
    x, y, r = pos.orderBy(F.desc("r"), "id").select("x", "y", "r").first()
    return T.at_point(pos, x + r - 1, y, edge=False).select("id", F.col("r").cast("bigint").alias("r"))


@query(_POS + " select a.id as point, min(b.id) as id from (select id, x + 10 as x, y - 10 as y from pos) a join pos b on abs(a.x - b.x) <= b.r and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= pow(b.r, 2) group by a.id")
def points_lookup(spark, folder):
    pos = _positions(spark, folder)
    return T.points_to_papers(pos.select(F.col("id").alias("point"), (F.col("x") + 10).alias("x"), (F.col("y") - 10).alias("y")), pos)


@query(_RGB + " select id, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from rgb")
def tile_colours(spark, folder):
    return _flat(_coloured(spark, folder), colours.category_colour(F.col("col"), F.col("dim"), F.col("age")))


@query(_RGB + " select id, round(0.289 * r + 0.587 * g + 0.114 * b, 6) as r, round(0.289 * r + 0.587 * g + 0.114 * b, 6) as g, round(0.289 * r + 0.587 * g + 0.114 * b, 6) as b from rgb")
def grey_colours(spark, folder):
    return _flat(_coloured(spark, folder), colours.grey(colours.category_colour(F.col("col"), F.col("dim"), F.col("age"))))


@query(_POS + f""", h as (select pos.id, date_diff('day', {_DAY.format('pos.id')}, {_ASOF}) as days from pos join papers on pos.id = papers.id), k as (select id, exp(-pow(days / 1460.0, 2) / 2 - 0.0001 * days) as heat from h)
    select id, round(0.15 + (1.0 - 0.15) * heat, 6) as r, round(cast(0.15 as double), 6) as g, round(cast(0.25 as double), 6) as b from k""")
def heat_colours(spark, folder):
    return _flat(_coloured(spark, folder), colours.heat_colour(measures.heat(days_ago(F.col("id"), F.col("asof"))), (0.15, 0.15, 0.25), (1.0, 0.15, 0.25)))


@query(_RGB + """ select id, round(0.6 * (1 - age) + (c0 * (1 - pow(age, 4)) + pow(age, 4)) * (1 - 0.6 * (1 - age)), 6) as r, round(0.6 * (1 - age) + c1 * (1 - pow(age, 4)) * (1 - 0.6 * (1 - age)), 6) as g,
                  round(0.6 * (1 - age) + c2 * (1 - pow(age, 4)) * (1 - 0.6 * (1 - age)), 6) as b from aged""")
def layout_colours(spark, folder):
    return _flat(_coloured(spark, folder), colours.layout_colour(F.col("col"), F.col("age")))


@query(_POS + " select id, round(cast(x * 0.02 + 400 as double), 6) as sx, round(cast(y * 0.02 + 300 as double), 6) as sy, round(x * cos(0.5) - y * sin(0.5), 4) + 0.0 as rx, round(x * sin(0.5) + y * cos(0.5), 4) + 0.0 as ry, -x as fx from pos")
def screen_transforms(spark, folder):
    x, y = F.col("x"), F.col("y")
    sx, sy = measures.world_to_screen(x, y, 0.02, 400, 300)
    rx, ry = measures.rotated(x, y, 0.5)
    return _positions(spark, folder).select("id", F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"), (F.round(rx, 4) + 0.0).alias("rx"), (F.round(ry, 4) + 0.0).alias("ry"), (-x).cast("bigint").alias("fx"))


@query(_POS + """, b as (select min(x) as lx, min(y) as ly, cast(greatest(max(x) - min(x), max(y) - min(y)) as double) as side from pos),
    c as (select depth, least(cast(floor((x - lx) / side * pow(2, depth)) as bigint), cast(pow(2, depth) as bigint) - 1) as cx, least(cast(floor((y - ly) / side * pow(2, depth)) as bigint), cast(pow(2, depth) as bigint) - 1) as cy, x, y, cast(r as double) * r as m
          from pos, b, (select unnest(range(0, 7)) as depth))
    select cast(depth as int) as depth, cx, cy, count(*) as n, round(sum(m), 3) as mass, round(sum(m * x) / sum(m), 3) as x, round(sum(m * y) / sum(m), 3) as y from c group by 1, 2, 3""")
def quadtree_cells(spark, folder):
    from orrery.operators.repulsion import quadtree_cells as cells

    rows = _positions(spark, folder).withColumn("mass", F.col("r").cast("double") * F.col("r"))
    return cells(rows, 6).select("depth", "cx", "cy", "n", F.round("mass", 3).alias("mass"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


QUERIES, ORACLES = R.queries, R.oracles
