"""Queries of scans, projections, filters, joins, aggregates and rankings over papers and their references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import ids, labels, measures
from orrery.operators import citations as C
from orrery.plans.registry import Registry
from orrery.sources import synthetic
from orrery.sources.blobs import pack_links
from orrery.sources.json_sources import merge_other_links
from orrery.sources.tables import checked_count, table

R = Registry()
query = R.query


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return C.edges(C.blob_links(spark, folder), C.papers(spark, folder))


def _as_of(spark: SparkSession, folder: str) -> DataFrame:
    """(asof): the day of the latest boundary, one row."""
    return table(spark, folder, "datebdry").where("daysago = 0").agg(ids.id_date(F.max("id")).alias("asof"))


_DAY = "cast(make_date(cast(({0} // 10000000) + 1800 as bigint), 1, 1) + to_months(cast(({0} % 10000000) // 625000 as int)) + to_days(cast(({0} % 625000) // 15625 as int)) as date)"
_ASOF = "(select max(" + _DAY.format("id") + ") from datebdry where daysago = 0)"
_CATS = r"list_filter(list_transform(regexp_split_to_array(coalesce(allcats, ''), '[,;|/\s]+'), lambda x: trim(x, '\"'' ')), lambda x: x <> '')"
_DICT = "d as (select cat, row_number() over (order by cat) as number from (select distinct lower(trim(maincat)) as cat from cur where trim(maincat) <> '') order by cat limit 255)"


@query("select id, maincat, title from papers")
def meta_scan(spark, folder):
    return C.papers(spark, folder, "maincat", "title")


@query("select count(id) as n from papers where maincat = 'opt-dyn'")
def meta_count(spark, folder):
    return C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'").agg(F.count("id").alias("n"))


@query("select id, maincat from papers order by id desc limit 20")
def meta_extra_clause(spark, folder):
    return C.papers(spark, folder, "maincat", extra="ORDER BY id DESC LIMIT 20")


@query("select id, slot, other, ord, freq, ncites from dec")
def refs_decoded(spark, folder):
    return C.blob_links(spark, folder)


@query("select 'refs' as field, count(distinct id) as n from pcite where octet_length(refs) % 10 <> 0 union all select 'cites', count(distinct id) from pcite where octet_length(cites) % 10 <> 0", prelude=False)
def blob_errors(spark, folder):
    rows = table(spark, folder, "pcite", "id", "refs", "cites")
    bad = [rows.where(F.octet_length(c) % 10 != 0).agg(F.count_distinct("id").alias("n")).select(F.lit(c).alias("field"), "n") for c in ("refs", "cites")]
    return bad[0].unionByName(bad[1])


@query("select distinct id, upper(hex(refs)) as blob from pcite where octet_length(refs) > 0 and octet_length(refs) % 10 = 0", prelude=False)
def blob_roundtrip(spark, folder):
    return pack_links(C.blob_links(spark, folder), "id").select("id", F.hex("blob").alias("blob"))


@query("""select distinct p.id, (octet_length(cites) // 10) as records, numcites from pcite p where octet_length(cites) % 10 = 0 and octet_length(cites) // 10 <> numcites""", prelude=False)
def cites_blob_mismatch(spark, folder):
    rows = table(spark, folder, "pcite", "id", "cites", "numcites").select("id", (F.octet_length("cites") % 10).alias("rest"), F.floor(F.octet_length("cites") / 10).alias("records"), "numcites")
    return rows.where("rest = 0 and records <> numcites").select("id", "records", "numcites").distinct()


@query("select d.id, d.slot, d.other from dec d where d.id in (select id from papers where maincat = 'opt-dyn')")
def semi_join_refs(spark, folder):
    chosen = C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'")
    return C.blob_links(spark, folder).join(chosen.select("id"), "id", "left_semi").select("id", "slot", "other")


@query("select src, dst, ord, freq, ncites from e")
def graph_links(spark, folder):
    return _edges(spark, folder)


@query("select id, other, case when id = other then 'self' when other not in (select id from papers) then 'unknown' else 'capped' end as reason from dec where id in (select id from papers) and (id = other or other not in (select id from papers) or freq > 255)")
def dropped_references(spark, folder):
    known = C.papers(spark, folder)
    rows = C.blob_links(spark, folder).join(known, "id", "left_semi").join(known.select(F.col("id").alias("other"), F.lit(True).alias("known")), "other", "left")
    reason = F.when(F.col("id") == F.col("other"), "self").when(F.col("known").isNull(), "unknown").when(F.col("freq") > 255, "capped")
    return rows.select("id", "other", reason.alias("reason")).where(F.col("reason").isNotNull())


@query("""select id, row_number() over (partition by id order by i) - 1 as slot, kw as keyword from (select id, unnest(list_slice(string_split(keywords, ','), 1, 5)) as kw,
          unnest(range(1, len(list_slice(string_split(keywords, ','), 1, 5)) + 1)) as i from papers where keywords is not null) where kw <> ''""")
def keyword_top5(spark, folder):
    return C.keyword_rows(C.papers(spark, folder, "keywords")).select("id", F.col("slot").cast("bigint").alias("slot"), "keyword")


@query("select count(distinct kw) as distinct_keywords, count(*) as keywords from (select unnest(list_slice(string_split(keywords, ','), 1, 5)) as kw from papers) where kw <> ''")
def keyword_totals(spark, folder):
    return C.keyword_rows(C.papers(spark, folder, "keywords")).agg(F.count_distinct("keyword").alias("distinct_keywords"), F.count(F.lit(1)).alias("keywords"))


@query(f""", {_DICT}, c as (select id, unnest({_CATS}) as cat, unnest(range(len({_CATS}))) as i from papers),
          k as (select c.id, number, row_number() over (partition by c.id order by i) as r from c join d on lower(c.cat) = d.cat)
          select p.id, coalesce(max(case when r = 1 then number end), 0) as cat1, coalesce(max(case when r = 2 then number end), 0) as cat2,
                 coalesce(max(case when r = 3 then number end), 0) as cat3, coalesce(max(case when r = 4 then number end), 0) as cat4 from papers p left join k on p.id = k.id group by p.id""")
def category_top4(spark, folder):
    names = C.category_dictionary(C.papers(spark, folder, "maincat", where="true"))
    rows = C.known_categories(C.papers(spark, folder, "allcats"), names)
    return rows.select("id", *[F.col("cats")[k].alias(f"cat{k + 1}") for k in range(4)])


@query(f", {_DICT} select cat, number from d")
def category_dictionary(spark, folder):
    return C.category_dictionary(C.papers(spark, folder, "maincat", where="true"))


@query(f"select id, strftime({_DAY.format('id')}, '%Y-%m-%d') as day, (id // 10000000) + 1800 as y, cast(date_diff('day', {_DAY.format('id')}, {_ASOF}) as bigint) as days from papers")
def id_date_decode(spark, folder):
    rows = C.papers(spark, folder).join(F.broadcast(_as_of(spark, folder)))
    return rows.select("id", F.date_format(ids.id_date(F.col("id")), "yyyy-MM-dd").alias("day"), ids.id_year(F.col("id")).alias("y"), ids.days_ago(F.col("id"), F.col("asof")).alias("days"))


@query("select id, id - (id % 15625) as first from papers")
def date_id_encode(spark, folder):
    return C.papers(spark, folder).select("id", ids.date_id(ids.id_date(F.col("id"))).alias("first"))


@query(f"select id, round(exp(-pow(days / 1460.0, 2) / 2 - 0.0001 * days), 6) as heat from (select id, date_diff('day', {_DAY.format('id')}, {_ASOF}) as days from papers)")
def heat_by_age(spark, folder):
    rows = C.papers(spark, folder).join(F.broadcast(_as_of(spark, folder)))
    return rows.select("id", F.round(measures.heat(ids.days_ago(F.col("id"), F.col("asof"))), 6).alias("heat"))


@query("select id, case when inspire > 0 then cast(1 as double) else cast(0 as double) end as heat from papers")
def heat_by_field(spark, folder):
    return C.papers(spark, folder, "inspire").select("id", F.when(F.col("inspire") > 0, 1.0).otherwise(0.0).alias("heat"))


@query("select id, round((id - lo) / cast(hi - lo as double), 9) as age from papers, (select min(id) as lo, max(id) as hi from papers)")
def age_in_range(spark, folder):
    rows = C.papers(spark, folder)
    ends = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return rows.join(F.broadcast(ends)).select("id", F.round(ids.age_in_range(F.col("id"), F.col("lo"), F.col("hi")), 9).alias("age"))


@query("select min(id) as lo, max(id) as hi from papers")
def id_range(spark, folder):
    return C.papers(spark, folder).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("select id, row_number() over (order by id) - 1 as idx from papers")
def dense_index(spark, folder):
    return C.indexed(C.papers(spark, folder)).select("id", "idx")


@query("select m.id, round((row_number() over (order by m.id) - 1) / cast(count(*) over () as double), 9) as age from (select distinct id from map_data) m join papers p on m.id = p.id")
def paper_age_rank(spark, folder):
    mapped = table(spark, folder, "map_data", "id").distinct().join(C.papers(spark, folder), "id")
    n = mapped.agg(F.count(F.lit(1)).alias("n"))
    return C.indexed(mapped).join(F.broadcast(n)).select("id", F.round(F.col("idx") / F.col("n"), 9).alias("age"))


@query("select id, cites, round(cast(0.2 + 0.2 * cites as double), 6) as mass, round(sqrt((0.2 + 0.2 * cites) / pi()), 6) as radius from cites")
def mass_radius(spark, folder):
    rows = C.citation_counts(_edges(spark, folder), C.papers(spark, folder))
    m = measures.mass(F.col("cites"))
    return rows.select("id", "cites", F.round(m, 6).alias("mass"), F.round(measures.radius(m), 6).alias("radius"))


@query("select id, cast(round((x / 20.0) * 20) as int) as x, cast(round((y / 20.0) * 20) as int) as y, r from (select distinct * from map_data)", prelude=False)
def quantise_positions(spark, folder):
    rows = table(spark, folder, "map_data").distinct()
    return rows.select("id", *[measures.quantised(measures.dequantised(F.col(c))).alias(c) for c in "xy"], "r")


@query("select id, cites from cites")
def citation_counts(spark, folder):
    return C.citation_counts(_edges(spark, folder), C.papers(spark, folder))


@query("select p.id, coalesce(n, 0) as cites from papers p left join (select dst, count(*) as n from e where freq > 0 group by dst) c on p.id = c.dst")
def graph_citation_counts(spark, folder):
    return C.citation_counts(_edges(spark, folder), C.papers(spark, folder), only_frequent=True)


@query("select dst as id, arg_max(ncites, src * 100000 + ord) as cites from e group by dst")
def external_cites(spark, folder):
    return C.external_cites(_edges(spark, folder))


@query("select dst as paper, src as citing, ord, freq from e")
def reverse_graph(spark, folder):
    return C.reverse(_edges(spark, folder))


@query("select p.id, c.numcites, m.x, m.y from papers p join cnt c on p.id = c.id join (select distinct * from map_data) m on p.id = m.id where p.maincat = 'opt-dyn'")
def meta_counts_map_join(spark, folder):
    rows = C.papers(spark, folder, "maincat").where("maincat = 'opt-dyn'").join(C.counts(spark, folder, "numcites"), "id")
    return rows.join(table(spark, folder, "map_data").distinct(), "id").select("id", "numcites", "x", "y")


@query("select p.id, m.x, m.y, m.r, m.id is not null as valid from papers p left join (select distinct * from map_data) m on p.id = m.id")
def positions_left_join(spark, folder):
    stored = table(spark, folder, "map_data").distinct()
    return C.papers(spark, folder).join(stored.withColumn("there", F.lit(True)), "id", "left").select("id", "x", "y", "r", F.coalesce("there", F.lit(False)).alias("valid"))


@query("select distinct id, x, y, r from map_data", prelude=False)
def positions_scan(spark, folder):
    rows = table(spark, folder, "map_data").distinct()
    return checked_count(rows, table(spark, folder, "map_data", "id").distinct().count()).orderBy("id")


@query("""select coalesce(a.src, b.pastid) as src, coalesce(a.dst, b.futureid) as dst, coalesce(a.freq, 0) as freq, coalesce(b.w, 0.0) as weight
          from (select src, dst, max(freq) as freq from e group by src, dst) a full join (select futureid as pastid, pastid as futureid, cast(max(reffreq) as double) as w from links where pastid is not null and futureid is not null group by 1, 2) b on a.src = b.pastid and a.dst = b.futureid""")
def other_links_merge(spark, folder):
    refs = _edges(spark, folder).groupBy("src", "dst").agg(F.max("freq").alias("freq"))
    other = table(spark, folder, "links", "pastid", "futureid", "reffreq").dropna(subset=["pastid", "futureid"]).select(F.col("futureid").alias("src"), F.col("pastid").alias("dst"), F.coalesce(F.col("reffreq").cast("double"), F.lit(0.0)).alias("weight"))
    return merge_other_links(refs, other)


@query("select p.id from papers p where not exists (select 1 from e where e.src = p.id or e.dst = p.id)")
def unlinked_papers(spark, folder):
    e = _edges(spark, folder)
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return C.papers(spark, folder).join(ends, "id", "left_anti")


@query("select max(d.id) as boundary, max(p.latest) as latest from datebdry d, (select max(id) as latest from papers) p where d.id < p.latest")
def new_papers_id(spark, folder):
    latest = C.papers(spark, folder).agg(F.max("id").alias("latest"))
    return table(spark, folder, "datebdry", "id").join(F.broadcast(latest), F.col("id") < F.col("latest")).agg(F.max("id").alias("boundary"), F.max("latest").alias("latest"))


@query("select e.dst as paper, e.src as citing from e where e.src >= (select max(id) from datebdry where daysago = 31)")
def cites_since_boundary(spark, folder):
    edge = table(spark, folder, "datebdry").where("daysago = 31").agg(F.max("id").alias("b"))
    return _edges(spark, folder).join(F.broadcast(edge), F.col("src") >= F.col("b")).select(F.col("dst").alias("paper"), F.col("src").alias("citing"))


@query("""select dst as paper, src as citing, n < 26 as everything from (select e.*, count(*) over (partition by dst) as n from e) where n < 26 or src >= (select max(id) from datebdry where daysago = 5)""")
def new_or_all_cites(spark, folder):
    e = _edges(spark, folder)
    n = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    edge = table(spark, folder, "datebdry").where("daysago = 5").agg(F.max("id").alias("b"))
    return e.join(n, "dst").join(F.broadcast(edge)).where((F.col("n") < 26) | (F.col("src") >= F.col("b"))).select(F.col("dst").alias("paper"), F.col("src").alias("citing"), (F.col("n") < 26).alias("everything"))


@query("select e.src, e.dst, round(0.4 + 0.6 * exp(-pow(1e-7 * (e.src - e.dst), 2)), 9) as factor from e")
def age_weakening(spark, folder):
    return _edges(spark, folder).select("src", "dst", F.round(measures.age_weakening(F.col("src"), F.col("dst")), 9).alias("factor"))


@query(r"""select id, regexp_replace(case when keywords <> '' then case when len(string_split(keywords, ',')) <= 1 then keywords || ',' else list_slice(string_split(keywords, ','), 1, 2)[1] || ',' || string_split(keywords, ',')[2] end
            when title <> '' then case when length(title) > 32 then case when contains(substr(replace(title, ',', ';'), 1, 32), ' ') then regexp_extract(substr(replace(title, ',', ';'), 1, 32), '^(.*) [^ ]*$', 1, 's') else substr(replace(title, ',', ';'), 1, 32) end else replace(title, ',', ';') end || '...,' else '' end
            || ',' || case when len(a) <= 1 then a[1] || ',' when len(a) = 2 then a[1] || ',' || a[2] else a[1] || ',et al.' end, '[^A-Za-z0-9 \-/.,<>()=]', '', 'g') as label
          from (select id, keywords, title, list_transform(string_split(coalesce(authors, ''), ','), lambda x: string_split(x, '.')[-1]) as a from papers)""")
def paper_labels(spark, folder):
    rows = C.papers(spark, folder, "authors", "keywords", "title")
    return rows.select("id", labels.paper_label(F.col("authors"), F.col("keywords"), F.col("title")).alias("label"))


@query(r"select id, regexp_replace(title, '[^A-Za-z0-9 \-/.,<>()=]', '', 'g') as label from papers where title is not null")
def label_clean(spark, folder):
    return C.papers(spark, folder, "title").where("title is not null").select("id", labels.clean(F.col("title")).alias("label"))


@query(r"select id, sha1(title) as s1, sha256(title) as s2 from papers where title is not null")
def hashes(spark, folder):
    return C.papers(spark, folder, "title").where("title is not null").select("id", F.sha1("title").alias("s1"), F.sha2("title", 256).alias("s2"))


@query("""select id, list_reduce(list_prepend(2166136261::bigint, list_transform(range(octet_length(encode(title))), lambda i: ('0x' || substr(hex(encode(title)), 2 * i + 1, 2))::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as hash
          from papers where title is not null""")
def string_hashes(spark, folder):
    return C.papers(spark, folder, "title").where("title is not null").select("id", labels.fnv32(F.col("title")).alias("hash"))


@query(f""", o as (select e.dst as id, sum(exp(-pow(date_diff('day', {_DAY.format('e.src')}, {_ASOF}) / 365.0, 2) / 2)) / count(*) as heat from e group by e.dst) select id, round(heat / (select max(heat) from o), 6) as heat from o""")
def citation_heat(spark, folder):
    """How recent a paper's citations are: the mean over them of a bell curve of their age, by the greatest such mean."""
    e = _edges(spark, folder).join(F.broadcast(_as_of(spark, folder)))
    heat = e.groupBy(F.col("dst").alias("id")).agg(F.avg(F.exp(-F.pow(ids.days_ago(F.col("src"), F.col("asof")) / 365.0, 2) / 2)).alias("heat"))
    return heat.join(F.broadcast(heat.agg(F.max("heat").alias("most")))).select("id", F.round(F.col("heat") / F.col("most"), 6).alias("heat"))


@query(r"select id, strftime(day, '%-d %B %Y') as spoken from (select id, " + _DAY.format("id") + " as day from papers)")
def spoken_dates(spark, folder):
    text = F.date_format(ids.id_date(F.col("id")), "yyyy-M-d")
    return C.papers(spark, folder).select("id", ids.spoken_date(text).alias("spoken"))


@query(r"""select id, case when length(arxiv) in (9, 10) and substr(arxiv, 5, 1) = '.' then substr(arxiv, 1, 2) || 'xx/' || substr(arxiv, 1, 4) || '/' || arxiv || '.xml'
           when length(arxiv) >= 10 then substr(right(arxiv, 7), 1, 2) || 'xx/' || substr(right(arxiv, 7), 1, 4) || '/' || left(arxiv, length(arxiv) - 8) || right(arxiv, 7) || '.xml' end as path from papers""")
def abstract_paths(spark, folder):
    return C.papers(spark, folder, "arxiv").select("id", labels.abstract_path(F.col("arxiv")).alias("path"))


@query(r"select doc_id, case when trim(regexp_replace(split_part(text, '<', 1), '\s+', ' ', 'g')) = '' then '(no abstract)' else trim(regexp_replace(split_part(text, '<', 1), '\s+', ' ', 'g')) end as abstract from documents", prelude=False)
def abstracts(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "text")
    return rows.select("doc_id", labels.abstract_text(F.concat(F.lit("<entry><abstract>"), "text", F.lit("</abstract>"))).alias("abstract"))


@query(r"""select id, list_filter(regexp_split_to_array(title, '[\s''+\\]+'), lambda x: x <> '') as terms from papers where title is not null""")
def query_terms(spark, folder):
    return C.papers(spark, folder, "title").where("title is not null").select("id", labels.search_terms(F.col("title")).alias("terms"))


@query(r"""select id, array_to_string(list_transform(list_filter(regexp_split_to_array(title, '[\s''+\\]+'), lambda x: x <> ''), lambda x: ' +"' || x || '"'), '') as required from papers where title is not null""")
def required_terms(spark, folder):
    return C.papers(spark, folder, "title").where("title is not null").select("id", labels.required_terms(F.col("title"), True).alias("required"))


@query("select id, (length(arxiv) > 0 and regexp_full_match(arxiv, '[A-Za-z0-9./\\-]+')) as code, regexp_full_match(id::varchar, '0|[0-9]{10}') as number from papers where arxiv is not null")
def valid_inputs(spark, folder):
    """Which public codes and identifiers would be taken from a request."""
    rows = C.papers(spark, folder, "arxiv").where("arxiv is not null")
    return rows.select("id", labels.valid_code_column(F.col("arxiv")).alias("code"), labels.valid_id_column(F.col("id").cast("string")).alias("number"))


@query("select maincat, count(*) as n, max(id) as best from (select maincat, p.id, cites, row_number() over (partition by maincat order by cites desc, p.id) as k from papers p join cites c on p.id = c.id) where k = 1 group by maincat")
def best_per_category(spark, folder):
    rows = C.papers(spark, folder, "maincat").join(C.citation_counts(_edges(spark, folder), C.papers(spark, folder)), "id")
    return C.best_by(rows, ["maincat"], "cites", "id", "id", "best").select("maincat", F.lit(1).cast("bigint").alias("n"), "best")


@query("""select maincat, kw as keyword, id as best from (select maincat, kw, k.id, row_number() over (partition by maincat, kw order by cites desc, k.id) as r from
          (select distinct id, maincat, unnest(list_slice(string_split(keywords, ','), 1, 5)) as kw from papers) k join cites c on k.id = c.id where kw <> '') where r = 1""")
def best_per_keyword(spark, folder):
    rows = C.papers(spark, folder, "maincat", "keywords")
    cites = C.citation_counts(_edges(spark, folder), rows)
    words = C.keyword_rows(rows).select("id", "keyword").distinct()
    return C.best_by(words.join(rows.select("id", "maincat"), "id").join(cites, "id"), ["maincat", "keyword"], "cites", "id", "id", "best")


@query("""select lo as windowstart, count(p.id) as papers from (select unnest(range(1990000000, 2220000000, 2000000)) as lo) w join papers p on p.id between lo and lo + 20000000 where (lo % 10000000) // 625000 < 12 group by lo""")
def sliding_id_windows(spark, folder):
    begins = C.sliding_windows(F.col("id"), 1_990_000_000, 2_219_999_999, 20_000_000, 2_000_000)
    return C.papers(spark, folder).select("id", F.explode(begins).alias("windowstart")).groupBy("windowstart").agg(F.count("id").alias("papers"))


@query("select 1 + i as id, round(case when i = 0 then 0.2 + 0.1 * 99 else 0.2 end, 6)::double as mass, case when i = 0 then 99 else 0 end as cites from range(100) t(i)", prelude=False)
def synthetic_star(spark, folder):
    papers, links = synthetic.star(spark, 100)
    return C.citation_counts(links, papers).join(papers, "id").select("id", F.round("mass", 6).alias("mass"), "cites")


@query("select id, cites from cites order by cites desc, id limit 25")
def most_cited(spark, folder):
    return C.citation_counts(_edges(spark, folder), C.papers(spark, folder)).orderBy(F.desc("cites"), "id").limit(25)


@query("select id, x, y, r, row_number() over (order by r desc, id) - 1 as drawn from (select distinct * from map_data)", prelude=False)
def draw_order(spark, folder):
    rows = table(spark, folder, "map_data").distinct()
    keyed = rows.withColumn("k", (F.lit(1 << 20) - F.col("r")) * F.lit(1 << 33) + F.col("id"))
    return C.indexed(keyed, "k", "drawn").select("id", "x", "y", "r", "drawn")


@query("select id from (select id, row_number() over (order by id) - 1 as idx from papers) where idx % 3 = 0")
def fast_draw(spark, folder):
    return C.indexed(C.papers(spark, folder)).where("idx % 3 = 0").select("id")


@query("select id, maincat from papers order by md5(id || '/42'), id limit 1000")
def random_sample(spark, folder):
    """A sample in a random order that depends on the identifiers and a seed only, not on how rows are dealt."""
    return C.papers(spark, folder, "maincat").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("/42"))), "id").limit(1000)


@query("select id from papers where id in (select dst from e where freq > 1) except select id from papers where maincat = 'opt-dyn'")
def veto_by_links(spark, folder):
    strong = _edges(spark, folder).where("freq > 1").select(F.col("dst").alias("id"))
    rows = C.papers(spark, folder, "maincat").where("maincat <> 'opt-dyn'")
    return rows.join(strong, "id", "left_semi").select("id")


QUERIES, ORACLES = R.queries, R.oracles
