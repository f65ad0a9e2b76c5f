"""JSON of papers and links, response envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(text: Column) -> Column:
    return F.when(text != "", text)


def paper_json(title: Column, authors: Column, refs: Column, cites: Column, d1: Column, d5: Column, arxiv: Column, allcats: Column, inspire: Column, publ: Column, extra: Column | None = None) -> Column:
    """A paper's description. A null title or author list reads as unknown; other members that are null or empty are left out,
    as are the categories of a paper without public code, and an auxiliary object if there is none."""
    members = [
        F.coalesce(authors, F.lit("(unknown authors)")).alias("auth"), F.coalesce(title, F.lit("(unknown title)")).alias("titl"), refs.alias("nr"), cites.alias("nc"), d1.alias("dnc1"), d5.alias("dnc5"),
        _kept(arxiv).alias("arxv"), F.when(arxiv != "", _kept(allcats)).alias("cats"), F.when(inspire > 0, inspire).alias("insp"), _kept(publ).alias("publ"),
    ]
    return F.to_json(F.struct(*members, *([extra.alias("aux")] if extra is not None else [])))


def update_json(cites: Column, d1: Column, d5: Column, publ: Column) -> Column:
    """What changes in a paper's description from day to day."""
    return F.to_json(F.struct(cites.alias("nc"), d1.alias("dnc1"), d5.alias("dnc5"), _kept(publ).alias("publ")))


def link_json(id_: Column, order: Column, freq: Column, cites: Column, x: Column | None = None, y: Column | None = None, r: Column | None = None) -> Column:
    """A link's description, with the other paper's place on the map if it has one."""
    place = [c.alias(n) for n, c in (("x", x), ("y", y), ("r", r)) if c is not None]
    return F.to_json(F.struct(id_.alias("id"), order.alias("o"), freq.alias("f"), cites.alias("nc"), *place))


def json_list(df: DataFrame, key: list[str], item: Column, order: Column, name: str) -> DataFrame:
    """(key..., name): the items of each key as one JSON array, ordered."""
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("j")))).alias("__l"))
    return rows.select(*key, F.concat(F.lit("["), F.array_join(F.transform("__l", lambda s: s["j"]), ","), F.lit("]")).alias(name))


def to_response(df: DataFrame, callback: str | None = None) -> str:
    """The answer to a request: {"r": rows}, or {"r": null} without rows, in a callback if one is asked for.

    For answers of a page's size, which it brings to the driver: they are limited by the queries that make them.
    """
    rows = [r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()]
    body = '{"r":' + (f"[{','.join(rows)}]" if rows else "null") + "}"
    return f"{callback}({body})" if callback else body
