"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.leaks import leaks
from orrery.llm.names import same_names
from orrery.llm.packing import pack, token_counts
from orrery.llm.pairs import item_pairs, lifted
from orrery.llm.spans import shared_classes, shared_pairs, shared_share
from orrery.llm.terms import marked_terms, normal_term
from orrery.llm.topn import top_n
from orrery.operators.packed import AUTHORS, CATEGORIES, unpack_rows, unpacked
from orrery.session import written
from orrery.sources.tables import current_rows, table


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    papers = current_rows(table(spark, folder, "meta_data", "id", "keywords", "loadedat"), "keywords")
    terms = F.transform(F.split("keywords", ","), normal_term)
    return marked_terms(papers, "id", terms).withColumnRenamed("term", "keyword")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where(F.col("mark").isNotNull()).select("keyword", "mark")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "trending", "trendrun", "maincat", "id", "score", "loadedat").withColumn("maincat", F.lower(F.trim("maincat")))
    runs = runs.where((F.col("maincat") != "") & F.col("id").isNotNull())
    last = runs.groupBy("trendrun", "maincat", "id").agg(F.max(F.struct("loadedat", "score")).alias("best")).select("trendrun", "maincat", "id", "best.score")
    return top_n(last, ["trendrun", "maincat"], "score", "id", 5).select("trendrun", "maincat", "id")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    papers = current_rows(table(spark, folder, "meta_data", "id", "allcats", "loadedat"), "allcats")
    return item_pairs(papers, F.transform(unpacked(F.col("allcats"), CATEGORIES), lambda x: x["val"])).withColumns({c: F.round(c, 9) for c in ("lift", "pmi")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lifted(p3_pairs(spark, folder)).select(F.col("a").alias("cata"), F.col("b").alias("catb"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    papers = current_rows(table(spark, folder, "meta_data", "id", "authors", "loadedat"), "authors")
    return same_names(unpack_rows(papers, ["id"], "authors", AUTHORS), "val")


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(table(spark, folder, "documents", "doc_id", "text")))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing, one row: documents, containers over their capacity, documents cut though they fit, places used
    twice or left out, documents lost or doubled, and whether less than a hundredth of the room is empty."""
    sizes = written(token_counts(table(spark, folder, "documents", "doc_id", "text")), "sizes")
    packed = written(pack(sizes), "packed")
    each = packed.groupBy("container").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.count_distinct("place").alias("p"), F.max("place").alias("m"))
    bins = each.agg(F.sum((F.col("n") > 2048).cast("bigint")).alias("overfull"), F.sum(((F.col("p") != F.col("k")) | (F.col("m") != F.col("k") - 1)).cast("bigint")).alias("misplaced"), (F.sum("n") >= 0.99 * 2048 * (F.count(F.lit(1)) - 1)).alias("full"))
    whole = packed.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.count_distinct("part").alias("k"))
    docs = sizes.join(whole, "doc_id", "full").agg(
        F.count("n_tokens").alias("documents"), F.sum(((F.col("n_tokens") <= 2048) & (F.col("parts") > 1)).cast("bigint")).alias("cut"),
        F.sum((~F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("parts") == F.col("k")), F.lit(False))).cast("bigint")).alias("lost"),
    )
    return docs.join(bins).select("documents", "overfull", "cut", "misplaced", "lost", "full")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_pairs(table(spark, folder, "documents", "doc_id", "text"))


def p10_share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_share(table(spark, folder, "documents", "doc_id", "text"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    return shared_classes(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p3_found, p3_pairs, p6_found, p8_pack, p8_report, p9_found, p10_found, p10_classes, p10_share)}

_CURRENT = "select distinct m.* from meta_data m join (select id as i, max(loadedat) as t from meta_data group by id) on m.id = i and m.loadedat = t"
_TERMS = rf"""
    with cur as ({_CURRENT}),
    k as (select id, trim(regexp_replace(lower(unnest(string_split(keywords, ','))), '\s+', ' ', 'g')) as keyword from cur),
    n as (select count(distinct id) as n from k where keyword <> ''),
    f as (select keyword, count(*) as uses, count(distinct id) as records from k where keyword <> '' group by keyword)
    select keyword, uses, records, case when records < 3 then 'rare' when records > n * 0.05 then 'common' end as mark from f, n
"""
_CATS = rf"""
    with cur as ({_CURRENT}),
    c as (select distinct id, trim(unnest(regexp_split_to_array(allcats, '[,;|/\s]+')), '"'' ') as cat from cur),
    o as (select cat, count(*) as c from c where cat <> '' group by cat),
    n as (select count(distinct id) as n from c where cat <> ''),
    p as (select x.cat as a, y.cat as b, count(*) as n_ab from c x join c y on x.id = y.id and x.cat < y.cat where x.cat <> '' and y.cat <> '' group by x.cat, y.cat),
    f as (select p.a, p.b, n_ab, oa.c as n_a, ob.c as n_b, n.n from p join o oa on oa.cat = p.a join o ob on ob.cat = p.b, n)
"""
_EVAL_WORDS = r"regexp_extract_all(regexp_replace(replace(replace(replace(lower({0}), chr(64257), 'fi'), chr(64258), 'fl'), chr(64256), 'ff'), '(­\s*\n[\s>]*|­|([a-z0-9])[-‐][ \t\r]*\n[\s>|]*([a-z0-9]))', '\2\3', 'g'), '[\p{{L}}\p{{N}}]+')"
_RUNS = "select {0} as k, array_to_string(list_slice(w, i, i + 12), ' ') as run from (select {0}, w, unnest(range(1, len(w) - 11)) as i from (select {0}, {1} as w from {2}) where len(w) >= 13)"

_SPANS = """
        w as (select doc_id, i, hash(substr(text, i, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300)),
        g as (select h from w group by h having count(distinct doc_id) > 1),
        m as (select distinct doc_id, h from w where h in (select h from g))"""
_PAIRS = "select distinct a.doc_id as doca, b.doc_id as docb from m a join m b on a.h = b.h and a.doc_id < b.doc_id"

ORACLES = {
    "p1_found": f"select keyword, mark from ({_TERMS}) where mark is not null",
    "p1_terms": _TERMS,
    "p2_found": """
        with t as (select distinct trendrun, lower(trim(maincat)) as maincat, id, score, loadedat from trending where trim(maincat) <> ''),
        l as (select trendrun, maincat, id, arg_max(coalesce(score, -1000000000), loadedat) as score from t group by trendrun, maincat, id),
        r as (select *, row_number() over (partition by trendrun, maincat order by score desc, id) as k from l where score > -1000000000)
        select trendrun, maincat, id from r where k <= 5""",
    "p3_found": _CATS + "select a as cata, b as catb from f where n_ab >= 3 and cast(n as hugeint) * n_ab >= 3 * cast(n_a as hugeint) * n_b",
    "p3_pairs": _CATS + "select a, b, n_ab, n_a, n_b, n, round(cast(n as double) * n_ab / (cast(n_a as double) * n_b), 9) as lift, round(log2(cast(n as double) * n_ab / (cast(n_a as double) * n_b)), 9) as pmi from f",
    "p9_found": f"""
        with d as ({_RUNS.format("doc_id", _EVAL_WORDS.format("text"), "documents")}), e as (select distinct k, run from ({_RUNS.format("item_id", _EVAL_WORDS.format("text"), "eval_items")}))
        select distinct d.k as doc_id, e.k as item_id from d join e on d.run = e.run""",
    "p8_report": "select count(*) as documents, 0 as overfull, 0 as cut, 0 as misplaced, 0 as lost, true as full from documents",
    "p10_found": f"with {_SPANS} {_PAIRS}",
    "p10_share": f"""
        with {_SPANS}, s as (select distinct doc_id, i from w where h in (select h from g)),
        o as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from s),
        c as (select doc_id, count(*) filter (where p is null or i - p > 300) as spans, sum(least(300, coalesce(i - p, 300)))::bigint as chars from o group by doc_id)
        select d.doc_id, coalesce(length(text), 0) as n_chars, coalesce(spans, 0) as spans, coalesce(chars, 0) as shared_chars, case when length(text) > 0 then coalesce(chars, 0) / length(text)::double else 0.0 end as share
        from documents d left join c on d.doc_id = c.doc_id""",
    "p10_classes": f"""
        with {_SPANS}, f as ({_PAIRS}),
        k as (select doc_id, case when length(text) >= 300 then min(doc_id) over (partition by text) else doc_id end as class from documents),
        l as (select distinct a.class as x, b.class as y from f join k a on f.doca = a.doc_id join k b on f.docb = b.doc_id where a.class <> b.class),
        n as (select x, count(*) as links from (select x, y from l union select y, x from l) group by x)
        select doc_id, class, count(*) over (partition by class) as copies, coalesce(links, 0) as links from k left join n on class = x""",
}
