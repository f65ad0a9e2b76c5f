"""Searches over titles, authors and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.ids import OPEN_END
from orrery.functions.labels import valid_categories

#: Result caps: full text, general, trending, and identifiers converted at once.
TEXT_CAP, GENERAL_CAP, TRENDING_CAP, CONVERSION_CAP = 150, 500, 10, 50


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; null gives null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def holds_phrase(words: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` stand side by side in ``words``; an empty phrase stands everywhere."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(phrase, " "), F.lit(" "))) | (F.size(phrase) == 0)


def all_terms(text: Column, typed: str, quoted: bool) -> Column:
    """Boolean mode: every typed word must occur; a quoted one as adjacent words."""
    import re

    terms = [t for t in re.split(r"[\s'+\\]+", typed) if t]
    words = tokens(text)
    out = F.lit(bool(terms))
    for t in terms:
        parts = [p for p in re.split(r"[\W_]+", t.lower()) if p]
        for p in [parts] if quoted else [[p] for p in parts]:
            out = out & holds_phrase(words, F.array(*map(F.lit, p)))
    return F.coalesce(out, F.lit(False))


def any_term(rows: DataFrame, texts: list[str], typed: str, most: int = TEXT_CAP) -> DataFrame:
    """Natural mode: rows with any typed word, with the number of occurrences of typed words (hits), best first, then by id."""
    import re

    wanted = F.array(*[F.lit(t) for t in sorted({t for t in re.split(r"[\W_]+", typed.lower()) if t})])
    words = tokens(F.concat_ws(" ", *texts))
    hits = F.size(F.filter(words, lambda w: F.array_contains(wanted, w)))
    return rows.withColumn("hits", hits.cast("bigint")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(most)


def in_categories(typed: str, cross: bool) -> Column:
    """Main category among those typed, or, with cross lists, all categories hold one as a part (so ``math`` also finds ``math-ph``).

    A list that isn't valid finds nothing.
    """
    cats = valid_categories(typed)
    if cats is None:
        return F.lit(False)
    out = F.lit(False)
    for c in cats:
        out = out | (F.contains("allcats", F.lit(c)) if cross else (F.col("maincat") == c))
    return F.coalesce(out, F.lit(False))


def in_range(low: int, high: int) -> Column:
    """Identifiers from low to high; a high of 0 is open."""
    return F.col("id").between(low, high or OPEN_END)


def generic(rows: DataFrame, cites: DataFrame, where: Column, positions: DataFrame | None = None, most: int | None = GENERAL_CAP) -> DataFrame:
    """(id, nc): the papers found, with their citations; published or with a public code; on the map, if positions are given.

    The smallest identifiers come first, so that a cap is deterministic.
    """
    found = rows.where(where & (F.col("arxiv").isNotNull() | F.col("publ").isNotNull()))
    if positions is not None:
        found = found.join(positions.select("id"), "id", "left_semi")
    out = found.join(cites.select("id", F.col("numcites").alias("nc")), "id").select("id", "nc")
    return out.orderBy("id").limit(most) if most else out


def category_search(rows: DataFrame, cites: DataFrame, typed: str, cross: bool, low: int, high: int, most: int | None = GENERAL_CAP) -> DataFrame:
    return generic(rows, cites, in_categories(typed, cross) & in_range(low, high), most=most)


def category_search_by_days(rows: DataFrame, cites: DataFrame, boundaries: DataFrame, typed: str, cross: bool, days_from: int, days_to: int) -> DataFrame:
    """Category search between two day boundaries, in either order; nothing if one is missing or not days_from > days_to."""
    ends = boundaries.where(F.col("daysago").isin(days_from, days_to)).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("daysago").alias("k"))
    ok = (F.col("k") == 2) & F.lit(days_from > days_to)
    found = rows.where(in_categories(typed, cross)).join(F.broadcast(ends), F.col("id").between(F.col("low"), F.col("high")) & ok, "inner")
    return generic(found.drop("low", "high", "k"), cites, F.lit(True))


def trending(misc: DataFrame, categories: list[str], most: int = TRENDING_CAP) -> DataFrame:
    """(id, nc, mc): the best of the packed lists ``id,score,nc,...`` of some categories; triples that don't parse are left out.

    misc(field, value). mc is null for the lists of no category.
    """
    items = F.split("value", ",")
    triples = F.transform(F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda k: (k % 3 == 0) & (k + 2 < F.size(items))), lambda k: F.slice(items, k + 1, 3))
    rows = misc.where(F.col("field").isin(categories)).select("field", F.explode(triples).alias("t"))
    number = lambda k: F.when(F.col("t")[k].rlike("^[0-9]+$"), F.col("t")[k].try_cast("bigint"))
    parsed = rows.select(number(0).alias("id"), number(1).alias("score"), number(2).alias("nc"), F.when(~F.col("field").isin("top10", "none"), F.col("field")).alias("mc")).dropna(subset=["id", "score", "nc"])
    return parsed.orderBy(F.desc("score"), "id").limit(most).select("id", "nc", "mc")


def convert_ids(rows: DataFrame, codes: list[str], dois: list[str], journals: list[str], most: int = CONVERSION_CAP) -> DataFrame:
    """(name, id) of papers by public code, DOI or journal; nothing if more than ``most`` are asked for.

    publ reads ``journal#volume,page#doi``. The names asked for are a bounded list, matched in one scan.
    """
    few = len(codes) + len(dois) + len(journals) <= most
    names = [F.when(F.col("arxiv") == c, F.lit(c)) for c in codes]
    names += [F.when(F.contains("publ", F.lit(f"#{d}")), F.lit(f"doi:{d}")) for d in dois]
    names += [F.when(F.startswith("publ", F.lit(f"{j}#")), F.lit(j)) for j in journals]
    if not few or not names:
        return rows.select(F.lit("").alias("name"), "id").limit(0)
    return rows.select("id", F.explode(F.array_compact(F.array(*names))).alias("name")).select("name", "id")
