"""Queries of a map client: searches, papers' data, locations, identifiers, saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import citations as C
from orrery.operators import search as S
from orrery.operators import serving as V
from orrery.operators import text_index as X
from orrery.operators import user_state as U
from orrery.plans import dispatch
from orrery.plans.catalog_queries import _edges
from orrery.plans.registry import Registry
from orrery.session import scratch, written
from orrery.sources.tables import table

R = Registry()
query = R.query

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_PADDED = "(' ' || array_to_string(" + _WORDS + ", ' ') || ' ')"
_MAP = ", pos as (select distinct id, x, y, r from map_data)"


def _searched(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Papers with what every search needs, and the columns that it looks into; no others are read."""
    return C.papers(spark, folder, *columns, "arxiv", "publ")


def _counted(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return C.counts(spark, folder, *(columns or ["numcites"]))


_FOUND = " select p.id, c.numcites as nc from papers p join cnt c on p.id = c.id where (p.arxiv is not null or p.publ is not null) and {0} order by p.id {1}"


@query(_FOUND.format("maincat = 'opt-dyn' and p.id between 2100000000 and 2200000000", "limit 500"))
def category_range_search(spark, folder):
    return S.category_search(_searched(spark, folder, "maincat"), _counted(spark, folder), "opt-dyn", False, 2_100_000_000, 2_200_000_000)


@query(_FOUND.format("(contains(allcats, 'opt-dyn') or contains(allcats, 'geo')) and p.id between 2100000000 and 4000000000", ""))
def category_cross_search(spark, folder):
    return S.category_search(_searched(spark, folder, "allcats"), _counted(spark, folder), "opt-dyn,geo", True, 2_100_000_000, 0, most=None)


@query(_FOUND.format("contains(allcats, 'dyn') and p.id between (select min(id) from datebdry where daysago in (31, 2)) and (select max(id) from datebdry where daysago in (31, 2))", "limit 500"))
def category_days_search(spark, folder):
    return S.category_search_by_days(_searched(spark, folder, "allcats"), _counted(spark, folder), table(spark, folder, "datebdry"), "dyn", True, 31, 2)


@query(_FOUND.format("false", ""))
def category_invalid_search(spark, folder):
    return S.category_search(_searched(spark, folder, "maincat"), _counted(spark, folder), "opt-dyn.XA", False, 2_100_000_000, 0)


@query(_FOUND.format("p.inspire between 1000 and 20000 and maincat = 'opt-dyn'", ""))
def aux_range_search(spark, folder):
    rows = C.papers(spark, folder, "maincat", "allcats", "arxiv", "publ", "inspire")
    return S.generic(rows, _counted(spark, folder), F.coalesce(F.col("inspire").between(1000, 20000), F.lit(False)) & S.in_categories("opt-dyn", False), most=None)


@query(_MAP + _FOUND.format("p.id in (select id from pos) and maincat = 'opt-dyn'", "limit 500"))
def mapped_only_search(spark, folder):
    return S.generic(_searched(spark, folder, "maincat"), _counted(spark, folder), S.in_categories("opt-dyn", False), table(spark, folder, "map_data", "id"))


@query(_FOUND.format("contains(" + _PADDED.format("authors") + ", ' henry ')", "limit 500"))
def author_terms_search(spark, folder):
    return S.generic(_searched(spark, folder, "authors"), _counted(spark, folder), S.all_terms(F.col("authors"), "Henry", True))


@query(_FOUND.format("contains(" + _PADDED.format("authors") + ", ' henry ') and p.inspire between 100 and 30000", "limit 500"))
def author_aux_search(spark, folder):
    rows = C.papers(spark, folder, "authors", "arxiv", "publ", "inspire")
    return S.generic(rows, _counted(spark, folder), S.all_terms(F.col("authors"), "Henry", True) & F.col("inspire").between(100, 30000))


@query(_FOUND.format("contains(" + _PADDED.format("title") + ", ' vortex ') and contains(" + _PADDED.format("title") + ", ' and ')", "limit 500"))
def title_terms_search(spark, folder):
    return S.generic(_searched(spark, folder, "title"), _counted(spark, folder), S.all_terms(F.col("title"), "vortex and", False))


@query(" select id, cast(len(list_filter(" + _WORDS.format("concat_ws(' ', keywords)") + ", lambda w: w in ('vortex', 'spin'))) as bigint) as hits from papers where hits > 0 order by hits desc, id limit 150")
def keyword_search(spark, folder):
    return S.any_term(C.papers(spark, folder, "keywords"), ["keywords"], "vortex spin").select("id", "hits")


@query(" select id, cast(len(list_filter(" + _WORDS.format("concat_ws(' ', authors, keywords)") + ", lambda w: w in ('henry', 'spin'))) as bigint) as hits from papers where hits > 0 order by hits desc, id limit 150")
def general_search(spark, folder):
    return S.any_term(C.papers(spark, folder, "authors", "keywords"), ["authors", "keywords"], "henry spin").select("id", "hits")


@query(" select p.id, c.numrefs, c.numcites, p.arxiv from papers p left join cnt c on p.id = c.id where p.arxiv = '0003.070314' or p.arxiv like '%/93%'")
def paper_by_code(spark, folder):
    rows = V.paper_rows(C.papers(spark, folder, "arxiv"), _counted(spark, folder, "numrefs", "numcites", "dnumcites1", "dnumcites5"))
    return rows.where((F.col("arxiv") == "0003.070314") | F.col("arxiv").like("%/93%")).select("id", "numrefs", "numcites", "arxiv")


def _misc(spark: SparkSession, folder: str) -> DataFrame:
    """(field, value): the last run's trending papers packed as the table of miscellany has them, with a triple that doesn't parse."""
    runs = table(spark, folder, "trending").where("maincat is not null and trim(maincat) <> '' and score is not null and numcites is not null")
    last = runs.agg(F.max("trendrun").alias("trendrun"))
    rows = runs.join(F.broadcast(last), "trendrun").select(F.lower(F.trim("maincat")).alias("field"), "id", "score", "numcites").distinct()
    listed = rows.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("id", "score", "numcites"))).alias("l"))
    return listed.select("field", F.concat(F.lit("bad,x,1,"), F.array_join(F.transform("l", lambda t: F.concat_ws(",", t["id"], t["score"], t["numcites"])), ",")).alias("value"))


@query("""select id, numcites as nc, maincat as mc from (select distinct lower(trim(maincat)) as maincat, id, score, numcites from trending
          where trendrun = (select max(trendrun) from trending where maincat is not null and trim(maincat) <> '' and score is not null and numcites is not null) and trim(maincat) <> '' and score is not null and numcites is not null)
          where maincat in ('opt-dyn', 'comp-dyn', 'stat-dyn', 'mag-dyn') and score >= 0 order by score desc, id limit 10""", prelude=False)
def trending_top10(spark, folder):
    return S.trending(_misc(spark, folder), ["opt-dyn", "comp-dyn", "stat-dyn", "mag-dyn"])


@query("""select case k when 1 then arxiv when 2 then 'doi:10.99' else 'Ann. Map Phys.' end as name, id from papers, (values (1), (2), (3)) v(k)
          where (k = 1 and arxiv in ('optma/9201007828', '0003.070314', '0201.117208')) or (k = 2 and publ like '%#10.99%') or (k = 3 and publ like 'Ann. Map Phys.#%')""")
def id_conversion(spark, folder):
    return S.convert_ids(C.papers(spark, folder, "arxiv", "publ"), ["optma/9201007828", "0003.070314", "0201.117208"], ["10.99"], ["Ann. Map Phys."])


@query(_MAP + " select pos.* from pos where id in (select id from papers where maincat = 'opt-dyn')")
def locations_of_papers(spark, folder):
    return V.locations(C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'"), table(spark, folder, "map_data").distinct())


@query(_MAP + " select e.src as paper, e.dst as other, e.ord, e.freq, x, y, r from e left join pos on e.dst = pos.id")
def references_with_locations(spark, folder):
    return V.linked(_edges(spark, folder), "src", "dst", table(spark, folder, "map_data").distinct())


@query(_MAP + " select e.dst as paper, e.src as other, e.ord, e.freq, x, y, r from e join pos on e.src = pos.id")
def mapped_citations(spark, folder):
    return V.linked(_edges(spark, folder), "dst", "src", table(spark, folder, "map_data").distinct(), mapped_only=True)


@query(" select e.src as paper, e.dst as other, e.ord, e.freq from e where e.src in (select id from papers where maincat = 'opt-dyn') and e.dst in (select id from papers where maincat = 'opt-dyn')")
def references_within_list(spark, folder):
    chosen = C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'").select("id")
    rows = _edges(spark, folder).join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows.select(F.col("src").alias("paper"), F.col("dst").alias("other"), "ord", "freq")


@query("select max(case when daysago = 0 then id end) as d0, max(case when daysago = 1 then id end) as d1, max(case when daysago = 2 then id end) as d2, max(case when daysago = 3 then id end) as d3, max(case when daysago = 4 then id end) as d4, max(case when daysago = 5 then id end) as d5 from datebdry", prelude=False)
def date_boundaries(spark, folder):
    return V.date_boundaries(table(spark, folder, "datebdry"))


@query(_FOUND.format("p.id between (select min(id) from datebdry) and 4000000000", "limit 500"))
def new_papers_search(spark, folder):
    edge = table(spark, folder, "datebdry").agg(F.min("id").alias("b"))
    rows = _searched(spark, folder).join(F.broadcast(edge), F.col("id") >= F.col("b"))
    return S.generic(rows, _counted(spark, folder), S.in_range(0, 0))


def _abstracts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, abstract): the first text about a paper that isn't empty stands for its abstract; the tables have no others."""
    text = F.trim(F.regexp_replace(F.regexp_extract("text", r"^[^<]*", 0), r"\s+", " "))
    rows = table(spark, folder, "documents", "doc_id", "text", "paperid").select(F.col("paperid").alias("id"), "doc_id", text.alias("abstract"))
    return rows.where("id is not null and abstract <> ''").groupBy("id").agg(F.min_by("abstract", "doc_id").alias("abstract"))


def _optional(members: str) -> str:
    """SQL of a JSON object of those members that aren't null."""
    return "'{' || array_to_string(list_filter([" + members + "], lambda x: x is not null), ',') || '}'"


_META_JSON = _optional("""'"auth":' || to_json(coalesce(authors, '(unknown authors)')), '"titl":' || to_json(coalesce(title, '(unknown title)')), '"nr":' || c.numrefs, '"nc":' || c.numcites, '"dnc1":' || c.dnumcites1, '"dnc5":' || c.dnumcites5,
    case when arxiv <> '' then '"arxv":' || to_json(arxiv) end, case when arxiv <> '' and allcats <> '' then '"cats":' || to_json(allcats) end, case when inspire > 0 then '"insp":' || inspire end, case when publ <> '' then '"publ":' || to_json(publ) end""")
_UPDATE_JSON = _optional("""'"nc":' || c.numcites, '"dnc1":' || c.dnumcites1, '"dnc5":' || c.dnumcites5, case when publ <> '' then '"publ":' || to_json(publ) end""")
_LISTED = """string_agg('{"id":' || other || ',"o":' || ord || ',"f":' || freq || ',"nc":' || nc || '}', ',' order by ord, other, freq)"""


@query(r""", txt as (select paperid as id, doc_id, trim(regexp_replace(regexp_extract(text, '^[^<]*'), '\s+', ' ', 'g')) as t from documents where paperid is not null),
    ab as (select id, arg_min(t, doc_id) as t from txt where t <> '' group by id), nn as (select dst, count(*) as n from e group by dst),
    rl as (select src as id, """ + _LISTED + """ as l from (select e.src, e.dst as other, e.ord, e.freq, cites.cites as nc from e join cites on cites.id = e.dst) group by src),
    cl as (select dst as id, """ + _LISTED + """ as l from (select e.dst, e.src as other, e.ord, e.freq, cites.cites as nc from e join cites on cites.id = e.src join nn on nn.dst = e.dst join papers p on p.id = e.dst
           where p.maincat = 'opt-dyn' or nn.n < 26 or e.src >= 2217000000) group by dst)
    select p.id, case when maincat = 'opt-dyn' then """ + _META_JSON + """ end as meta, case when coalesce(maincat, '') <> 'opt-dyn' then """ + _UPDATE_JSON + """ end as upd,
           case when maincat = 'opt-dyn' then '[' || coalesce(rl.l, '') || ']' end as refs, '[' || coalesce(cl.l, '') || ']' as cites, case when maincat = 'opt-dyn' then coalesce(ab.t, '(no abstract)') end as abst
    from papers p left join cnt c on p.id = c.id left join rl on rl.id = p.id left join cl on cl.id = p.id left join ab on ab.id = p.id""")
def data_for_ids(spark, folder):
    rows = V.paper_rows(_searched(spark, folder, "allcats", "maincat", "title", "authors", "inspire"), _counted(spark, folder, "numrefs", "numcites", "dnumcites1", "dnumcites5"))
    flags = F.when(F.col("maincat") == "opt-dyn", V.META | V.REFS | V.ALL_CITES | V.ABSTRACT).otherwise(V.UPDATE | V.NEW_CITES)
    e = _edges(spark, folder)
    return V.data_for_ids(rows.select("id", flags.alias("flags")), rows, e, C.citation_counts(e, rows), 2_217_000_000, _abstracts(spark, folder))


# Saved state: users are derived from papers' main categories, their items from papers.
_NOTES = """, old as (select maincat as "user", id, title as notes from papers where title is not null and arxiv is not null),
    diff as (select maincat as "user", id, case when publ is null then null else upper(title) end as notes, coalesce(status, '') = 'checked' as rm from papers where inspire is not null)"""


def _notes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = C.papers(spark, folder, "maincat", "title", "inspire", "arxiv", "publ", "status").withColumnRenamed("maincat", "user")
    old = rows.where("title is not null and arxiv is not null").select("user", "id", F.col("title").alias("notes"))
    notes = F.when(F.col("publ").isNull(), F.lit(None)).otherwise(F.upper("title"))
    diff = rows.where("inspire is not null").select("user", "id", notes.alias("notes"), (F.coalesce("status", F.lit("")) == "checked").alias("rm"), F.lit(1).alias("seq"))
    return old, diff


@query(_NOTES + ' select coalesce(o."user", d."user") as "user", coalesce(o.id, d.id) as id, coalesce(d.notes, o.notes) as notes from old o full join diff d on o."user" = d."user" and o.id = d.id where not coalesce(d.rm, false)')
def notes_merge(spark, folder):
    return U.merge_notes(*_notes(spark, folder))


@query("""select maincat as name, id from (select maincat, id from papers where arxiv is not null union all select maincat, id from papers where publ is not null) group by all having count(*) % 2 = 1""")
def tag_toggle(spark, folder):
    rows = C.papers(spark, folder, "maincat", "arxiv", "publ").withColumnRenamed("maincat", "name")
    return U.toggled(rows.where("arxiv is not null"), rows.where("publ is not null"), ["name"], "id")


_GRAPHS = _MAP + """, g as (select *, maincat as "user", 'g' || (id % 7) as name from papers),
    og as (select "user", name, count(*) as ind from g where arxiv is not null group by all), dg as (select "user", name, max(inspire) as ind, name = 'g3' as rm from g where inspire is not null group by all),
    mg as (select coalesce(o."user", d."user") as "user", coalesce(o.name, d.name) as name, coalesce(d.ind, o.ind) as ind from og o full join dg d on o."user" = d."user" and o.name = d.name where not coalesce(d.rm, false)),
    od as (select "user", name, g.id, x::bigint as x, r::bigint as r from g join pos on g.id = pos.id where arxiv is not null and ("user", name) not in (select ("user", name) from dg where rm)),
    dd as (select "user", name, g.id, -x::bigint as x, case when g.id % 2 = 0 then r::bigint end as r, coalesce(status, '') = 'checked' as rm from g join pos on g.id = pos.id where publ is not null)"""


def _graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = C.papers(spark, folder, "maincat", "arxiv", "publ", "inspire", "status").select("*", F.col("maincat").alias("user"), F.concat(F.lit("g"), F.col("id") % 7).alias("name"))
    drawn = rows.join(table(spark, folder, "map_data", "id", "x", "r").distinct(), "id").withColumns({c: F.col(c).cast("bigint") for c in "xr"})
    old = rows.where("arxiv is not null").groupBy("user", "name").agg(F.count(F.lit(1)).alias("ind"))
    diff = rows.where("inspire is not null").groupBy("user", "name").agg(F.max("inspire").alias("ind")).select("*", (F.col("name") == "g3").alias("rm"), F.lit(1).alias("seq"))
    old_drawn = drawn.where("arxiv is not null").select("user", "name", "id", "x", "r")
    diff_drawn = drawn.where("publ is not null").select("user", "name", "id", (-F.col("x")).alias("x"), F.when(F.col("id") % 2 == 0, F.col("r")).alias("r"), (F.coalesce("status", F.lit("")) == "checked").alias("rm"), F.lit(1).alias("seq"))
    return U.merge_graphs(old, diff, old_drawn, diff_drawn)


@query(_GRAPHS + ' select "user", name, ind from mg')
def graphs_merge(spark, folder):
    return _graphs(spark, folder)[0]


@query(_GRAPHS + """ select * from (select coalesce(o."user", d."user") as "user", coalesce(o.name, d.name) as name, coalesce(o.id, d.id) as id, coalesce(d.x, o.x) as x, coalesce(d.r, o.r) as r
    from od o full join dd d on o."user" = d."user" and o.name = d.name and o.id = d.id where not coalesce(d.rm, false)) where ("user", name) in (select ("user", name) from mg)""")
def graphs_drawn(spark, folder):
    return _graphs(spark, folder)[1]


_TAGS = """, g as (select *, maincat as "user", 't' || (id % 5) as name from papers),
    ot as (select "user", name, min(id) as ind, false as blob, true as halo from g where arxiv is not null group by all),
    dt as (select "user", name, max(inspire) as ind, case when name = 't1' then true end as blob, case when name = 't2' then false end as halo, name = 't4' as rm from g where inspire is not null group by "user", name),
    mt as (select coalesce(o."user", d."user") as "user", coalesce(o.name, d.name) as name, coalesce(d.ind, o.ind) as ind, coalesce(d.blob, o.blob) as blob, coalesce(d.halo, o.halo) as halo
           from ot o full join dt d on o."user" = d."user" and o.name = d.name where not coalesce(d.rm, false)),
    ti as (select "user", name, id from g where arxiv is not null and ("user", name) not in (select ("user", name) from dt where rm) union all select "user", name, id from g where publ is not null)"""


def _tags(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = C.papers(spark, folder, "maincat", "arxiv", "publ", "inspire").select("*", F.col("maincat").alias("user"), F.concat(F.lit("t"), F.col("id") % 5).alias("name"))
    old = rows.where("arxiv is not null").groupBy("user", "name").agg(F.min("id").alias("ind")).select("*", F.lit(False).alias("blob"), F.lit(True).alias("halo"))
    diff = rows.where("inspire is not null").groupBy("user", "name").agg(F.max("inspire").alias("ind"))
    diff = diff.select("*", F.when(F.col("name") == "t1", True).alias("blob"), F.when(F.col("name") == "t2", False).alias("halo"), (F.col("name") == "t4").alias("rm"), F.lit(1).alias("seq"))
    return U.merge_tags(old, diff, rows.where("arxiv is not null").select("user", "name", "id"), rows.where("publ is not null").select("user", "name", "id"))


@query(_TAGS + ' select "user", name, ind, blob, halo from mt')
def tags_merge(spark, folder):
    return _tags(spark, folder)[0]


@query(_TAGS + ' select "user", name, id from ti where ("user", name) in (select ("user", name) from mt) group by all having count(*) % 2 = 1')
def tags_papers(spark, folder):
    return _tags(spark, folder)[1]


@query("""select coalesce(o."user", d."user") as "user", coalesce(d.pvo, o.pvo) as pvo, coalesce(d.nda, o.nda) as nda from (select maincat as "user", count(*) as pvo, count(publ) as nda from papers where arxiv is not null group by 1) o
          full join (select maincat as "user", case when count(*) % 2 = 0 then -count(*) end as pvo, case when count(*) % 3 > 0 then -1 end as nda from papers where publ is not null group by 1) d on o."user" = d."user" """)
def settings_merge(spark, folder):
    rows = C.papers(spark, folder, "maincat", "arxiv", "publ").withColumnRenamed("maincat", "user")
    n = F.count(F.lit(1))
    old = rows.where("arxiv is not null").groupBy("user").agg(n.alias("pvo"), F.count("publ").alias("nda"))
    diff = rows.where("publ is not null").groupBy("user").agg(n.alias("n")).select("user", F.when(F.col("n") % 2 == 0, -F.col("n")).alias("pvo"), F.when(F.col("n") % 3 > 0, F.lit(-1).cast("bigint")).alias("nda"))
    return U.merge_settings(old, diff)


_STATES = _NOTES + """, merged as (select coalesce(o."user", d."user") as "user", coalesce(o.id, d.id) as id, coalesce(d.notes, o.notes) as notes from old o full join diff d on o."user" = d."user" and o.id = d.id where not coalesce(d.rm, false)),
    was as (select "user", string_agg(id || '=' || coalesce(notes, ''), ';' order by id) as state from old group by 1), now_ as (select "user", string_agg(id || '=' || coalesce(notes, ''), ';' order by id) as state from merged group by 1)"""


def _state(notes: DataFrame) -> DataFrame:
    """(user, state): a user's notes as one text; a saved profile is one text by its format."""
    item = F.struct("id", F.concat(F.col("id"), F.lit("="), F.coalesce("notes", F.lit(""))).alias("t"))
    return notes.groupBy("user").agg(F.array_sort(F.collect_list(item)).alias("l")).select("user", F.array_join(F.transform("l", lambda x: x["t"]), ";").alias("state"))


@query(_STATES + """ select n."user", case when length(n."user") % 2 = 0 then n.state else w.state end as state from now_ n left join was w on n."user" = w."user" """)
def state_sync(spark, folder):
    """Differences merged, and kept where the client's hash of the result is ours; every other client is wrong about it."""
    old, diff = _notes(spark, folder)
    merged = written(_state(U.merge_notes(old, diff)), "merged")
    client = merged.select("user", U.state_hash(F.when(F.length("user") % 2 == 0, F.col("state")).otherwise(F.concat("state", F.lit("!")))).alias("hash"))
    return U.accepted(_state(old), merged, client)


@query(_STATES + """ select "user", case when length("user") % 2 = 0 then state end as state, length("user") + 1 as loads from was""")
def state_load(spark, folder):
    stored = _state(_notes(spark, folder)[0]).withColumn("loads", F.length("user").cast("bigint"))
    client = stored.select("user", U.state_hash(F.when(F.length("user") % 2 == 0, F.lit("other")).otherwise(F.col("state"))).alias("hash"))
    return U.loaded(stored, client)


_RANKED = """, tok as (select id, unnest(""" + _WORDS.format("concat_ws(' ', authors, keywords)") + """) as term from papers), pst as (select term, id, count(*) as uses from tok group by all)"""


@query(_RANKED + " select term, count(*) as papers, cast(sum(uses) as bigint) as uses from pst group by term")
def text_index(spark, folder):
    found = X.postings(C.papers(spark, folder, "authors", "keywords"), ["authors", "keywords"])
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("papers"), F.sum("uses").alias("uses"))


@query(_RANKED + """, w as (select term, pow(log10((select count(*) from papers) / count(*)::double), 2) as rarity from pst where term in ('henry', 'spin', 'vortex') group by term),
    s as (select id, sum(uses * rarity) as relevance from pst join w using (term) group by id order by round(relevance, 9) desc, id limit 150)
    select id, round(relevance, 6) as relevance, row_number() over (order by round(relevance, 9) desc, id) - 1 as o from s""")
def ranked_search(spark, folder):
    """Natural-language search by relevance, in an index that is stored and of which only the parts of the typed words are read."""
    rows = C.papers(spark, folder, "authors", "keywords")
    path = scratch(spark, "index")
    X.write_index(X.postings(rows, ["authors", "keywords"]), path)
    out = X.ranked(X.read_index(spark, path), "Spin, vortex Henry", C.papers(spark, folder).count())
    return out.select("id", F.round("relevance", 6).alias("relevance"), "o")


_REQUESTS: list[dict[str, str]] = [
    {"sax": "0003.070314"}, {"saxm": "0003.070314"}, {"sge": "henry spin"}, {"skw": "vortex spin"}, {"sau": "Henry"}, {"saux": "Henry", "min": "100", "max": "30000"}, {"sti": "vortex and"},
    {"sca": "opt-dyn", "f": "2100000000", "t": "2200000000"}, {"sca": "dyn", "fd": "31", "td": "2", "x": "true"}, {"scax": "opt-dyn", "min": "1000", "max": "20000"}, {"ml2p": "-15783,-13454"},
    {"gdmv": ""}, {"gdb": ""}, {"chids": "optma/9201007828,0003.070314"}, {"snp": "", "f": "2217000000", "t": "0"}, {"nothing": "known"},
]
_ROUTED = _MAP + ", f as (select p.*, c.numcites from papers p join cnt c on p.id = c.id where p.arxiv is not null or p.publ is not null)"
_ROUTED_ROWS = [
    "(select count(*) from papers where arxiv = '0003.070314')", "(select count(*) from papers where arxiv = '0003.070314')", "(select least(150, count(*)) from papers where len(list_filter(" + _WORDS.format("concat_ws(' ', authors, keywords)") + ", lambda w: w in ('henry', 'spin'))) > 0)",
    "(select least(150, count(*)) from papers where len(list_filter(" + _WORDS.format("concat_ws(' ', keywords)") + ", lambda w: w in ('vortex', 'spin'))) > 0)", "(select least(500, count(*)) from f where contains(" + _PADDED.format("authors") + ", ' henry '))",
    "(select least(500, count(*)) from f where contains(" + _PADDED.format("authors") + ", ' henry ') and inspire between 100 and 30000)", "(select least(500, count(*)) from f where contains(" + _PADDED.format("title") + ", ' vortex ') and contains(" + _PADDED.format("title") + ", ' and '))",
    "(select least(500, count(*)) from f where maincat = 'opt-dyn' and id between 2100000000 and 2200000000)",
    "(select least(500, count(*)) from f where contains(allcats, 'dyn') and id between (select min(id) from datebdry where daysago in (31, 2)) and (select max(id) from datebdry where daysago in (31, 2)))", "(select count(*) from f where inspire between 1000 and 20000 and maincat = 'opt-dyn')",
    "(select least(1, count(*)) from pos where sqrt(pow(x + 15783, 2) + pow(y + 13454, 2)) - r <= 0)", "1", "1", "(select count(*) from papers where arxiv in ('optma/9201007828', '0003.070314'))", "(select least(500, count(*)) from f where id between 2217000000 and 4000000000)", "null",
]


@query(_ROUTED + " " + " union all ".join(f"select '{next(iter(r))}' as request, cast({k} as int) as number, cast({n} as bigint) as found" for k, (r, n) in enumerate(zip(_REQUESTS, _ROUTED_ROWS))))
def routed_requests(spark, folder):
    """How many rows each of several requests is answered with; null for one that is answered by nothing."""
    source, out = dispatch.Source(spark, folder), None
    for k, request in enumerate(_REQUESTS):
        rows = dispatch.answer(source, request)
        n = spark.range(1).select(F.lit(None).cast("bigint").alias("found")) if rows is None else rows.agg(F.count(F.lit(1)).alias("found"))
        part = n.select(F.lit(next(iter(request))).alias("request"), F.lit(k).alias("number"), "found")
        out = part if out is None else out.unionByName(part)
    return out


@query("select '7' as v, max(case when daysago = 0 then id end) as d0 from datebdry", prelude=False)
def date_and_version(spark, folder):
    return V.versioned(V.date_boundaries(table(spark, folder, "datebdry"), 0), "7")


@query(_MAP + " select id, x, y, r from pos where id not in (select id from papers where status = 'new') union all select id, x + 1, y, r from pos where id in (select id from papers where status = 'new')")
def positions_upsert(spark, folder):
    pos = table(spark, folder, "map_data").distinct()
    new = pos.join(C.papers(spark, folder, "status").where("status = 'new'").select("id"), "id", "left_semi")
    return U.upsert(pos, new.withColumn("x", F.col("x") + 1), ["id"])


@query('select maincat as "user", sha1(title) as hash from papers where title is not null')
def state_hashes(spark, folder):
    return C.papers(spark, folder, "maincat", "title").where("title is not null").select(F.col("maincat").alias("user"), U.state_hash(F.col("title")).alias("hash"))


QUERIES, ORACLES = R.queries, R.oracles
