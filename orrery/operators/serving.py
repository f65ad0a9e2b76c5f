"""What a map client asks for: papers with links, locations, date boundaries. All return DataFrames for any number of requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.encode import json_list, link_json, paper_json, update_json

#: Flags of a request for a paper's data, and the number of citations from which only new ones are sent. Fixed values.
META, UPDATE, REFS, ALL_CITES, NEW_CITES, ABSTRACT, MANY_CITES = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 26


def linked(links: DataFrame, here: str, there: str, positions: DataFrame, mapped_only: bool = False) -> DataFrame:
    """(paper, other, ord, freq, x, y, r): links of papers with the other end's place; without one null, or left out if ``mapped_only``."""
    rows = links.select(F.col(here).alias("paper"), F.col(there).alias("other"), "ord", "freq")
    place = positions.select(F.col("id").alias("other"), "x", "y", "r")
    return rows.join(place, "other", "inner" if mapped_only else "left").select("paper", "other", "ord", "freq", "x", "y", "r")


def locations(requested: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, x, y, r) of the requested papers (id) that are on the map."""
    return positions.join(requested.select("id").distinct(), "id", "left_semi").select("id", "x", "y", "r")


def paper_rows(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """Papers with their counts; a paper without counts has none (null)."""
    return meta.join(counts, "id", "left")


def data_for_ids(requests: DataFrame, papers: DataFrame, links: DataFrame, cites: DataFrame, boundary: int, abstracts: DataFrame | None = None) -> DataFrame:
    """(id, meta, upd, refs, cites, abst) for requests (id, flags): each member as JSON if its flag is set, else null.

    papers: rows of ``paper_rows``. links(src, dst, ord, freq), cites(id, cites). Metadata go before an update of it, all citations before
    new ones; new citations are all of them below 26, else those from identifiers of ``boundary`` on. Unknown papers have no row, lists
    without members are ``[]``.
    """
    asked = requests.groupBy("id").agg(F.max("flags").alias("flags"))
    bit = lambda b: F.col("flags").bitwiseAND(b) != 0
    rows = asked.join(papers, "id")
    meta = paper_json(*[F.col(c) for c in ("title", "authors", "numrefs", "numcites", "dnumcites1", "dnumcites5", "arxiv", "allcats", "inspire", "publ")])
    update = update_json(*[F.col(c) for c in ("numcites", "dnumcites1", "dnumcites5", "publ")])
    rows = rows.select("id", "flags", F.when(bit(META), meta).alias("meta"), F.when(bit(UPDATE) & ~bit(META), update).alias("upd"))

    count = cites.select("id", F.col("cites").alias("__nc"))
    item = link_json(F.col("other"), F.col("ord"), F.col("freq"), F.col("__nc"))

    def lists(mask: int, here: str, there: str, name: str) -> DataFrame:
        chosen = asked.where(F.col("flags").bitwiseAND(mask) != 0).withColumnRenamed("id", here)
        found = links.join(chosen, here).select(F.col(here).alias("id"), F.col(there).alias("other"), "ord", "freq", "flags")
        if name == "cites":
            n = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("__n"))
            found = found.join(n, "id").where(F.col("flags").bitwiseAND(ALL_CITES) != 0).unionByName(
                found.join(n, "id").where((F.col("flags").bitwiseAND(ALL_CITES) == 0) & ((F.col("__n") < MANY_CITES) | (F.col("other") >= boundary)))
            )
        found = found.join(count.withColumnRenamed("id", "other"), "other", "left")
        return json_list(found, ["id"], item, F.struct("ord", "other"), name)

    out = rows.join(lists(REFS, "src", "dst", "refs"), "id", "left").join(lists(ALL_CITES | NEW_CITES, "dst", "src", "cites"), "id", "left")
    none = F.lit("[]")
    out = out.withColumns({"refs": F.when(bit(REFS), F.coalesce("refs", none)), "cites": F.when(bit(ALL_CITES | NEW_CITES), F.coalesce("cites", none))})
    if abstracts is None:
        return out.drop("flags").withColumn("abst", F.lit(None).cast("string"))
    text = abstracts.select("id", F.col("abstract").alias("abst"))
    return out.join(text, "id", "left").withColumn("abst", F.when(bit(ABSTRACT), F.coalesce("abst", F.lit("(no abstract)")))).drop("flags")


def date_boundaries(boundaries: DataFrame, most: int = 5) -> DataFrame:
    """(d0, d1, ...): one row, the boundary of each of the last days."""
    return boundaries.where(F.col("daysago") <= most).agg(*[F.max(F.when(F.col("daysago") == d, F.col("id"))).alias(f"d{d}") for d in range(most + 1)])


def versioned(boundaries: DataFrame, version: str) -> DataFrame:
    """The boundaries with the version that a client compares with its own."""
    return boundaries.select(F.lit(version).alias("v"), "*")


def explain_paper(papers: DataFrame, links: DataFrame, id_: int) -> DataFrame:
    """(role, id, title, authors, ord): a paper, then its references in order, then its citations; for a look at the data."""
    row = papers.where(F.col("id") == id_).select(F.lit("paper").alias("role"), "id", F.lit(0).cast("bigint").alias("ord"))
    refs = links.where(F.col("src") == id_).select(F.lit("reference").alias("role"), F.col("dst").alias("id"), "ord")
    cites = links.where(F.col("dst") == id_).select(F.lit("citation").alias("role"), F.col("src").alias("id"), "ord")
    return row.unionByName(refs).unionByName(cites).join(papers.select("id", "title", "authors"), "id", "left").select("role", "id", "title", "authors", "ord")
