"""Queries of the citation graph's structure and of the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.config import Forces
from orrery.functions.ids import OPEN_END
from orrery.functions.measures import mass, radius
from orrery.operators import citations as C
from orrery.operators import components as G
from orrery.operators import layout as L
from orrery.operators.repulsion import repulsion
from orrery.plans.catalog_queries import _CATS, _DICT, _edges
from orrery.plans.registry import Registry
from orrery.session import written
from orrery.sources.tables import table

R = Registry()
query = R.query

_WHOLE = ", few as (select id from papers), fe as (select distinct src, dst from e)"
_CC = _WHOLE + """, u as (select src as a, dst as b from fe union select dst, src from fe),
    cc(n, l) using key (n) as (select distinct a, a from u union (select u.b, min(cc.l) from cc join u on u.a = cc.n join recurring.cc r on r.n = u.b where cc.l < r.l group by u.b)),
    comp as (select few.id, coalesce(cc.l, few.id) as component from few left join cc on few.id = cc.n)"""


def _components(spark: SparkSession, folder: str) -> DataFrame:
    return G.connected_components(C.papers(spark, folder), _edges(spark, folder))


@query(_CC + " select id, component from comp")
def connected_components(spark, folder):
    return _components(spark, folder)


@query(_CC + " select papers, count(*) as components from (select component, count(*) as papers from comp group by component) group by papers")
def component_histogram(spark, folder):
    return G.component_histogram(_components(spark, folder))


@query(_CC + " select component, count(*) as papers from comp group by component having count(*) > 2 order by papers desc, component limit 1")
def largest_component(spark, folder):
    return G.largest_component(_components(spark, folder))


@query(_CC + " select component, row_number() over (order by component) as colour from (select distinct component from comp)")
def component_colours(spark, folder):
    return G.colours(_components(spark, folder))


@query(_WHOLE + """, d as (select distinct src, dst from fe where src > dst),
    reach(s, n) as (select src, dst from d union select r.s, d.dst from reach r join d on d.src = r.n)
    select src, dst from d where not exists (select 1 from d x join reach y on y.s = x.dst where x.src = d.src and y.n = d.dst and x.dst <> d.dst)""")
def transitive_reduction(spark, folder):
    return G.transitive_reduction(_edges(spark, folder))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers (id, cat, mass), links and keywords of the structural queries."""
    few = C.papers(spark, folder, "allcats", "keywords")
    links = written(C.edges(C.blob_links(spark, folder), few).select("src", "dst", "ord", "freq"), "links")
    names = C.category_dictionary(C.papers(spark, folder, "maincat", where="true"))
    cites = C.citation_counts(links, few)
    rows = C.known_categories(few, names).join(cites, "id").select("id", F.col("cats")[0].alias("cat"), mass(F.col("cites")).alias("mass"))
    return written(rows, "papers"), links, written(C.keyword_rows(few), "keywords")


# The walk over categories: which components become connected at which category, then the links that do it.
_FAKES = f""", {_DICT}, few as (select id from papers), fe as (select distinct src, dst from e), u as (select src as a, dst as b from fe union select dst, src from fe),
    cc(n, l) using key (n) as (select distinct a, a from u union (select u.b, min(cc.l) from cc join u on u.a = cc.n join recurring.cc r on r.n = u.b where cc.l < r.l group by u.b)),
    comp as (select few.id, coalesce(cc.l, few.id) as component from few left join cc on few.id = cc.n),
    big as (select component from comp group by component having count(*) > 2 order by count(*) desc, component limit 1),
    c as (select id, unnest({_CATS}) as cat, unnest(range(len({_CATS}))) as i from papers),
    first as (select c.id, arg_min(number, i) as cat from c join d on lower(c.cat) = d.cat group by c.id),
    bp as (select p.id, coalesce(f.cat, 0) as cat, 0.2 + 0.2 * cites.cites as mass, comp.component, comp.component in (select component from big) as big
           from papers p join cites on p.id = cites.id join comp on p.id = comp.id left join first f on f.id = p.id),
    spans as (select distinct component, cat from bp where not big),
    reach as (select a.cat, list(distinct b.cat) as others from spans a join spans b on a.component = b.component group by a.cat),
    turns as (select cat, others, row_number() over (order by cat) as k from reach),
    walk(k, live, opened) as (
        select 0::bigint, coalesce((select list(distinct cat) from bp where big), []::bigint[]), []::bigint[]
        union all select t.k, case when list_contains(live, t.cat) then list_distinct(live || others) else live end, case when list_contains(live, t.cat) then opened || [t.cat] else opened end
        from walk join turns t on t.k = walk.k + 1),
    opened as (select unnest(opened) as cat from walk where k = (select max(k) from walk)),
    at_ as (select component, min(cat) as step from spans where cat in (select cat from opened) group by component),
    st as (select bp.*, case when big then -1 else at_.step end as step from bp left join at_ on bp.component = at_.component and not big),
    linking as (select component, cat, min(id) as id from st where step = cat and not big group by component, cat),
    kws as (select id, i - 1 as slot, kw from (select id, unnest(list_filter(list_slice(string_split(keywords, ','), 1, 5), lambda x: x <> '')) as kw, unnest(range(1, len(list_filter(list_slice(string_split(keywords, ','), 1, 5), lambda x: x <> '')) + 1)) as i from papers)),
    bykw as (select cat, kw, arg_min(st.id, (-mass, st.id)) as dst from st join (select distinct id, kw from kws) k on k.id = st.id where step < cat group by cat, kw),
    words as (select l.id as src, b.dst, k.slot from linking l join kws k on k.id = l.id join bykw b on b.cat = l.cat and b.kw = k.kw),
    start as (select cat, min((-mass, id)) as best from st where step < cat group by cat),
    own as (select component, cat, min((-mass, id)) as heaviest, min(id) as id from st where step = cat and not big group by component, cat),
    late as (select a.id, a.cat, min(b.heaviest) as h from own a left join own b on a.cat = b.cat and b.id < a.id group by a.id, a.cat),
    plain as (select a.id as src, case when h is not null and h < s.best then h else s.best end as w from late a join start s on a.cat = s.cat where a.id not in (select src from words)),
    fakes as (select src, dst, slot from words union all select src, w[2], 0 from plain)"""


@query(_FAKES + " select src, dst, cast(slot as int) as slot from fakes")
def fake_links(spark, folder):
    rows, links, keywords = _graph(spark, folder)
    return G.fake_links(rows, written(G.connected_components(rows, links), "components"), keywords)[0]


@query(_FAKES + """, con as (select id, cat from st where step is not null)
    select con.id, cat, round(con.id / 4e9, 9) as age, count(k.src) as cites from con left join (select src, dst from e where freq > 0 and src in (select id from con) and dst in (select id from con)) k on k.dst = con.id group by con.id, cat""")
def select_graph(spark, folder):
    rows, links, keywords = _graph(spark, folder)
    return G.select_graph(rows, links, keywords, 0, OPEN_END)["papers"].select("id", "cat", F.round("age", 9).alias("age"), "cites")


_LINKS = """, ll as (select least(src, dst) as a, greatest(src, dst) as b, sum(cast(freq as double) * freq) as weight, min(src) as s0, max(src) as s1 from e group by 1, 2),
    links1 as (select case when s0 = s1 and s0 = b then b else a end as src, case when s0 = s1 and s0 = b then a else b end as dst, weight from ll)"""
_NODES = """, nodes as (select c.id, 0.2 + 0.2 * cites as mass, sqrt((0.2 + 0.2 * cites) / pi()) as radius, x / 20.0 as x, y / 20.0 as y from cites c join (select distinct * from map_data) m on c.id = m.id)"""


def _layout_nodes(spark: SparkSession, folder: str) -> DataFrame:
    cites = C.citation_counts(_edges(spark, folder), C.papers(spark, folder))
    at = table(spark, folder, "map_data", "id", "x", "y").distinct()
    m = mass(F.col("cites"))
    return cites.join(at, "id").select("id", m.alias("mass"), radius(m).alias("radius"), (F.col("x") / 20.0).alias("x"), (F.col("y") / 20.0).alias("y"))


def _layout(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes = written(_layout_nodes(spark, folder), "nodes")
    links = L.layout_links(_edges(spark, folder))
    links = links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, written(links, "links")


@query(_LINKS + " select src, dst, weight from links1")
def combine_reciprocal_links(spark, folder):
    return L.layout_links(_edges(spark, folder))


@query(_LINKS + """, up as (select id, id - id % 15625 as parent from papers), c as (select a.parent as ps, b.parent as pd, weight from links1 l join up a on l.src = a.id join up b on l.dst = b.id where a.parent <> b.parent)
    select least(ps, pd) as a, greatest(ps, pd) as b, sum(weight) as weight from c group by 1, 2""")
def coarse_links(spark, folder):
    up = C.papers(spark, folder).select("id", (F.col("id") - F.col("id") % 15625).alias("parent"))
    out = L.coarse_links(L.layout_links(_edges(spark, folder)), up)
    return out.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")


@query(_LINKS + _NODES + """, f as (select a.id as s, b.id as d, a.x - b.x as dx, a.y - b.y as dy, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as r, 1.5 * (a.radius + b.radius) as rest, 1.17 * 0.65 * weight as k
              from links1 l join nodes a on l.src = a.id join nodes b on l.dst = b.id),
    g as (select s as id, -dx * k * (r - rest) / r as fx, -dy * k * (r - rest) / r as fy from f where r > 0.01 union all select d, dx * k * (r - rest) / r, dy * k * (r - rest) / r from f where r > 0.01)
    select id, round(sum(fx), 3) + 0.0 as fx, round(sum(fy), 3) + 0.0 as fy from g group by id""")
def link_force(spark, folder):
    nodes, links = _layout(spark, folder)
    return L.link_forces(nodes, links, Forces()).select("id", (F.round("fx", 3) + 0.0).alias("fx"), (F.round("fy", 3) + 0.0).alias("fy"))


@query(_LINKS + _NODES + """, f as (select a.id as s, b.id as d, a.x - b.x as dx, a.y - b.y as dy, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as r, 1.5 * (a.radius + b.radius) as rest, 1.17 * 0.65 * weight as k
              from links1 l join nodes a on l.src = a.id join nodes b on l.dst = b.id),
    g as (select s as id, -dx * k * (r - rest) / r as fx, -dy * k * (r - rest) / r as fy from f where r > 0.01 union all select d, dx * k * (r - rest) / r, dy * k * (r - rest) / r from f where r > 0.01),
    t as (select id, sqrt(pow(sum(fx), 2) + pow(sum(fy), 2)) as f from g group by id) select round(max(f), 3) as most, round(sum(f), 1) as energy, count(*) as nodes from t""")
def link_force_extremes(spark, folder):
    """The greatest link force and the sum of all."""
    nodes, links = _layout(spark, folder)
    f = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
    return L.link_forces(nodes, links, Forces()).agg(F.round(F.max(f), 3).alias("most"), F.round(F.sum(f), 1).alias("energy"), F.count(F.lit(1)).alias("nodes"))


@query(_NODES + _LINKS + " select (select count(*) from nodes) as nodes, (select count(*) from links1 where src in (select id from nodes) and dst in (select id from nodes)) as links, (select round(cast(sum(mass) as double), 3) from nodes) as mass")
def layout_summary(spark, folder):
    return L.summary(*_layout(spark, folder)).select("nodes", "links", F.round("mass", 3).alias("mass"))


@query(_NODES + " select round(cast(sum(mass) as double), 3) as mass, round(sum(mass * x) / sum(mass), 4) as cx, round(sum(mass * y) / sum(mass), 4) as cy, round(sqrt(sum(mass * x * x) / sum(mass)), 4) as sx, round(sqrt(sum(mass * y * y) / sum(mass)), 4) as sy from nodes")
def layout_moments(spark, folder):
    m = F.col("mass")
    mean = lambda c: F.sum(m * c) / F.sum(m)
    x, y = F.col("x"), F.col("y")
    return _layout_nodes(spark, folder).agg(F.round(F.sum(m), 3).alias("mass"), F.round(mean(x), 4).alias("cx"), F.round(mean(y), 4).alias("cy"), F.round(F.sqrt(mean(x * x)), 4).alias("sx"), F.round(F.sqrt(mean(y * y)), 4).alias("sy"))


@query()
def barnes_hut_force(spark, folder):
    return repulsion(written(_layout_nodes(spark, folder), "nodes"), Forces())


@query()
def barnes_hut_close_force(spark, folder):
    return repulsion(written(_layout_nodes(spark, folder), "nodes"), Forces(close_repulsion=True))


@query()
def layout_iterate(spark, folder):
    nodes, links = _layout(spark, folder)
    return L.exported(L.iterated(nodes, links, Forces(), L.State(step=1.0), 2)[0])


_TURNS = _NODES + _LINKS + """, ln as (select src, dst, weight from links1 where src in (select id from nodes) and dst in (select id from nodes)),
    num as (select id, cast(row_number() over (order by id) - 1 as int) as n from nodes),
    turn as (select src, any_value(a.n) as sn, list(b.n order by weight desc, dst) as dsts, row_number() over (order by max(weight) desc, any_value(mass), src) as k
             from ln join nodes on nodes.id = src join num a on a.id = src join num b on b.id = dst group by src),
    w(k, taken, sn, dn) as (
        select 0::bigint, repeat('0', (select count(*)::int from nodes))::bit, null::int, null::int
        union all select t.k, case when c.d is null then w.taken else set_bit(set_bit(w.taken, t.sn, 1), c.d, 1) end, t.sn, c.d
        from w join turn t on t.k = w.k + 1, lateral (select case when get_bit(w.taken, t.sn) = 0 then list_filter(t.dsts, lambda d: get_bit(w.taken, d) = 0)[1] end as d) c),
    pair as (select b.id, a.id as parent from w join num a on a.n = w.sn join num b on b.n = w.dn)"""


@query(_TURNS + ' select nodes.id, coalesce(parent, nodes.id) as parent, parent is not null as "second" from nodes left join pair on nodes.id = pair.id')
def greedy_coarsen(spark, folder):
    nodes, links = _layout(spark, folder)
    return L.coarsened(nodes, links)[2]


@query(_TURNS + """, up as (select nodes.id, coalesce(parent, nodes.id) as parent, mass, radius from nodes left join pair on nodes.id = pair.id)
    select parent as id, round(cast(sum(mass) as double), 4) as mass, round(sqrt(sum(radius * radius)), 4) as radius from up group by parent""")
def coarse_nodes(spark, folder):
    nodes, links = _layout(spark, folder)
    return L.coarsened(nodes, links)[0].select("id", F.round("mass", 4).alias("mass"), F.round("radius", 4).alias("radius"))


@query()
def refine_layout(spark, folder):
    nodes, links = _layout(spark, folder)
    coarse, _, children = L.coarsened(nodes, links)
    return L.refined(nodes, children, L.started(coarse, 7)).select("id", "x", "y")


@query(_NODES + _LINKS + """, old as (select nodes.* from nodes where id in (select id from cur where coalesce(status, '') not in ('new', 'deleted'))),
    ln as (select src, dst, weight from links1 where src in (select id from nodes) and dst in (select id from nodes)),
    ends as (select src as id, dst as other, weight from ln union all select dst, src, weight from ln),
    mid as (select ends.id, sum(weight * x) / sum(weight) as mx, sum(weight * y) / sum(weight) as my from ends join old on old.id = other group by ends.id)
    select n.id, old.id is not null as held, round(case when old.id is not null then old.x else mx end + 1e-6, 4) + 0.0 as x, round(case when old.id is not null then old.y else my end + 1e-6, 4) + 0.0 as y
    from nodes n left join old on n.id = old.id left join mid on mid.id = n.id""")
def place_new_papers(spark, folder):
    """Where new papers are put, without the random part: null for those without placed neighbours."""
    nodes, links = _layout(spark, folder)
    settled = C.papers(spark, folder, where="coalesce(status, '') not in ('new', 'deleted')")
    at = table(spark, folder, "map_data", "id", "x", "y").distinct().join(settled, "id", "left_semi")
    valid = L.with_positions(nodes, at, 7)
    placed = L.placed_new(valid, links, 7)
    linked = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("l")).select("l.*")
    near = linked.join(valid.where("valid").select(F.col("id").alias("other")), "other", "left_semi").select("id", F.lit(True).alias("near")).distinct()
    at_ = lambda c, k: F.round(F.when(F.col("held"), F.col(c)).when(F.col("near"), F.col(c) - L.jitter(7, k)) + 1e-6, 4) + 0.0
    return placed.join(near, "id", "left").select("id", "held", at_("x", 0).alias("x"), at_("y", 1).alias("y"))


_TURNED = """, cen as (select sum(mass * x) / sum(mass) as cx, sum(mass * y) / sum(mass) as cy from nodes where {0}), t as (select 4.2 - atan2(cy, cx) as a from cen)
    select id, round(x * cos(a) - y * sin(a), 3) + 0.0 as x, round(x * sin(a) + y * cos(a), 3) + 0.0 as y from nodes, t"""


@query(_NODES + _TURNED.format("id in (select id from papers where maincat = 'opt-dyn')"))
def orient_layout(spark, folder):
    chosen = C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'").select("id")
    return _rounded(L.oriented(_layout_nodes(spark, folder), chosen, 4.2))


@query(_NODES + _TURNED.format("id = (select id from nodes order by mass desc, id limit 1)"))
def orient_by_paper(spark, folder):
    nodes = written(_layout_nodes(spark, folder), "nodes")
    return _rounded(L.oriented(nodes, nodes.orderBy(F.desc("mass"), "id").limit(1).select("id"), 4.2))


@query(_NODES + """, k as (select n.id, maincat as cat, x, y from nodes n join papers p on n.id = p.id), c as (select cat, count(*) as n, avg(x) as cx, avg(y) as cy from k group by cat),
    f as (select id, x - cx as dx, y - cy as dy, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) as r, 0.1 * sqrt(n) as rest from k join c using (cat) where id not in (select src from e) and id not in (select dst from e))
    select id, round(case when r > rest then -0.117 * (r - rest) / r * dx else 0 end, 4) + 0.0 as fx, round(case when r > rest then -0.117 * (r - rest) / r * dy else 0 end, 4) + 0.0 as fy from f""")
def category_pull(spark, folder):
    nodes = _layout_nodes(spark, folder).join(C.papers(spark, folder, "maincat").withColumnRenamed("maincat", "cat"), "id")
    e = _edges(spark, folder)
    alone = nodes.join(e.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")
    pull = L.category_pull(nodes, alone, L.category_centres(nodes), Forces())
    return pull.select("id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("fx", "fy")])


@query(_NODES + " select id, case when k = 1 then 12.5 else x end as x, case when k = 1 then -3.25 else y end as y from (select *, row_number() over (order by mass desc, id) as k from nodes)")
def moved_node(spark, folder):
    """One node put elsewhere."""
    nodes = written(_layout_nodes(spark, folder), "nodes")
    return L.moved(nodes, nodes.orderBy(F.desc("mass"), "id").limit(1).select("id", F.lit(12.5).alias("x"), F.lit(-3.25).alias("y"))).select("id", "x", "y")


@query(_NODES + " select count(*) as nodes, count(*) as inside, true as moved from nodes")
def jolted_layout(spark, folder):
    """All nodes shaken: how many stay within the jolt of where they were, and whether they moved at all."""
    nodes = written(_layout_nodes(spark, folder), "nodes")
    both = L.jolted(nodes, 3.0, 5).select("id", F.col("x").alias("nx"), F.col("y").alias("ny")).join(nodes, "id")
    off = F.greatest(F.abs(F.col("nx") - F.col("x")), F.abs(F.col("ny") - F.col("y")))
    return both.agg(F.count(F.lit(1)).alias("nodes"), F.sum((off <= 3.0).cast("bigint")).alias("inside"), (F.avg(off) > 0.5).alias("moved"))


@query(_TURNS + """, up as (select nodes.id, coalesce(parent, nodes.id) as parent, mass, x, y from nodes left join pair on nodes.id = pair.id), g as (select parent, sum(mass * x) / sum(mass) as x, sum(mass * y) / sum(mass) as y from up group by parent)
    select up.id, round(g.x + 1e-6, 4) + 0.0 as x, round(g.y + 1e-6, 4) + 0.0 as y from up join g on up.parent = g.parent""")
def coarsen_display(spark, folder):
    """The displayed level made coarser: parents at their parts' centre of mass, and the finest nodes at their parents' places."""
    nodes, links = _layout(spark, folder)
    coarse, _, children = L.coarsened(nodes, links)
    out = L.propagated([children], L.gathered(nodes, children, coarse))
    # Means of twentieths often lie halfway between two of the last digits kept.
    return out.select("id", *[(F.round(F.col(c) + 1e-6, 4) + 0.0).alias(c) for c in "xy"])


def _rounded(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query()
def daily_increment(spark, folder):
    """The daily batch: stored positions, new papers placed and relaxed with the old ones held, the whole graph adjusted, then finely; saved again.

    The iterations turn the map, so it is aligned by a category at the end.
    """
    nodes, links = _layout(spark, folder)
    stored = table(spark, folder, "map_data").distinct()
    old = stored.join(C.papers(spark, folder, where="coalesce(status, '') not in ('new', 'deleted')"), "id", "left_semi")
    placed = written(L.placed_new(L.with_positions(nodes, old, 7), links, 7), "placed")
    moved = L.daily_layout(placed, links, Forces())
    chosen = C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'").select("id")
    return L.saved(old, L.oriented(moved, chosen, 4.2))


@query()
def complete_layout(spark, folder):
    """A layout from scratch: all levels come to rest one after another, then close repulsion, then the finest level. The last two phases have a
    hundred iterations each here; the operator's own numbers are the reference's 2000 and 6000."""
    nodes, links = _layout(spark, folder)
    return L.exported(L.complete_layout(nodes.drop("x", "y"), links, Forces(), close_rounds=99, fine_rounds=99, state=L.State()))


QUERIES, ORACLES = R.queries, R.oracles
