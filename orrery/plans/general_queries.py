"""Queries of the general data-processing operators: packed lists, heavy keys, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.orphans import link_orphans, orphan_report
from orrery.operators.packed import AUTHORS, CATEGORIES, unpack_rows
from orrery.operators.skew import count_mismatches, salted_distinct_count
from orrery.sources.tables import current_rows, table


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found with the mark of values whose opening quote or bracket nothing closes."""
    papers = current_rows(table(spark, folder, "meta_data", "id", "allcats", "authors", "loadedat"), "allcats", "authors")
    cats = unpack_rows(papers, ["id"], "allcats", CATEGORIES)
    return cats.unionByName(unpack_rows(papers, ["id"], "authors", AUTHORS))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_values(spark, folder).drop("err")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "links", "pastid", "futureid")
    return count_mismatches(table(spark, folder, "pcite", "id", "numcites"), links, "id", "numcites", "pastid", "futureid").select("id").distinct()


def p5_citing_papers(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "links", "pastid", "futureid")
    return salted_distinct_count(links, "pastid", "futureid", "citing")


def p5_citing_all(spark: SparkSession, folder: str) -> DataFrame:
    """The number of citing papers of every paper of pcite or meta_data, and of every other that is cited; 0 where there is none."""
    known = table(spark, folder, "pcite", "id").unionByName(table(spark, folder, "meta_data", "id")).where("id is not null").select(F.col("id").alias("pastid")).distinct()
    counted = p5_citing_papers(spark, folder)
    return known.join(counted, "pastid", "full").select("pastid", F.coalesce("citing", F.lit(0).cast("bigint")).alias("citing"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "links", "linkid", "pastid", "futureid", "pastpaper", "seenat")
    return link_orphans(links, table(spark, folder, "meta_data", "id", "arxiv", "status", "loadedat"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p7_found(spark, folder))


QUERIES = {f.__name__: f for f in (p4_found, p4_values, p5_found, p5_citing_papers, p5_citing_all, p7_found, p7_report)}

_ORPHANS = r"""
    with one as (select id, max(loadedat) as m, min(loadedat) as firstat from meta_data group by id),
    facts as (
        select distinct m.id, o.firstat, coalesce(lower(trim(m.status)) = 'deleted', false) as gone,
               regexp_replace(regexp_replace(lower(regexp_replace(m.arxiv, '\s+', '', 'g')), '^arxiv:', ''), 'v[0-9]+$', '') as code
        from meta_data m join one o on m.id = o.id and m.loadedat = o.m),
    targets as (select 'id' as space, cast(id as varchar) as key, gone, firstat from facts union all select 'code', code, gone, firstat from facts where code is not null),
    refs as (
        select linkid, seenat, 'pastid' as reffield, 'id' as space, cast(pastid as varchar) as key from links
        union all select linkid, seenat, 'futureid', 'id', cast(futureid as varchar) from links
        union all select linkid, seenat, 'pastpaper', 'code', regexp_replace(regexp_replace(lower(regexp_replace(pastpaper, '\s+', '', 'g')), '^arxiv:', ''), 'v[0-9]+$', '') from links),
    found as (
        select distinct linkid, reffield, case when t.key is null then 'missing' when t.gone then 'deleted' when t.firstat > seenat then 'late' end as kind, strftime(seenat, '%Y-%m') as period
        from refs left join targets t on refs.space = t.space and refs.key = t.key where refs.key is not null)
"""
_CITING = "select pastid, count(distinct futureid) as citing from links where pastid is not null group by pastid"

_NAMES = r"""list_transform(case when regexp_matches(regexp_replace(authors, '"[^"]*"', '', 'g'), '[;|/\t\n\r]') then regexp_split_to_array(authors, '[;|/\t\n\r]')
    else regexp_extract_all(regexp_replace(authors, '\s*,?\s+(?:and|&)\s+', ',', 'g'), '(?:[^,"]|"(?:[^"]|"")*")+') end, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"""

_VALUES = rf"""
        with cur as (select distinct m.id, allcats, authors from meta_data m join (select id as i, max(loadedat) as t from meta_data group by id) on m.id = i and m.loadedat = t),
        c as (select id, list_filter(list_transform(regexp_split_to_array(allcats, '[,;|/\s]+'), lambda x: {{'val': trim(x, '"'''), 'err': false}}), lambda x: x.val <> '') as l from cur),
        a as (select id, list_filter(list_transform({_NAMES}, lambda x: case when regexp_matches(x, '^"(?:[^"]|"")*"$') then {{'val': trim(replace(x[2:-2], '""', '"')), 'err': false}} else {{'val': x, 'err': regexp_matches(x, '^["\[]')}} end), lambda x: x.val <> '') as l from cur),
        b as (select id, 'allcats' as fieldname, l from c union all select id, 'authors', l from a),
        v as (select id, fieldname, cast(unnest(range(1, len(l) + 1)) as bigint) as slot, unnest(l) as item from b)
"""

ORACLES = {
    "p4_found": _VALUES + "select id, fieldname, slot, item.val as val from v",
    "p4_values": _VALUES + "select id, fieldname, slot, item.val as val, item.err as err from v",
    "p5_found": f"select distinct p.id from pcite p left join ({_CITING}) c on p.id = c.pastid where p.numcites is not null and p.numcites <> coalesce(c.citing, 0)",
    "p5_citing_papers": _CITING,
    "p5_citing_all": f"""
        with c as ({_CITING}), k as (select id from pcite where id is not null union select id from meta_data where id is not null union select pastid from c)
        select k.id as pastid, coalesce(c.citing, 0) as citing from k left join c on k.id = c.pastid""",
    "p7_found": _ORPHANS + "select linkid, reffield, kind, period from found where kind is not null",
    "p7_report": _ORPHANS + "select reffield, kind, period, count(*) as orphans from found where kind is not null group by reffield, kind, period",
}
