"""Requests of a map client by name: which query answers which request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.labels import valid_code, valid_id
from orrery.operators import citations as C
from orrery.operators import search as S
from orrery.operators import serving as V
from orrery.operators import tiles as T
from orrery.sources.tables import table

Request = dict[str, str]
Answer = Callable[["Source", Request], DataFrame]


class Source:
    """The tables of a folder, as requests need them."""

    def __init__(self, spark: SparkSession, folder: str, version: str = "1"):
        self.spark, self.folder, self.version = spark, folder, version

    def papers(self, *columns: str) -> DataFrame:
        return C.papers(self.spark, self.folder, *columns)

    def searched(self, *columns: str) -> DataFrame:
        return self.papers(*columns, "arxiv", "publ")

    def counts(self) -> DataFrame:
        return C.counts(self.spark, self.folder, "numcites")

    def positions(self) -> DataFrame:
        return table(self.spark, self.folder, "map_data").distinct()

    def boundaries(self) -> DataFrame:
        return table(self.spark, self.folder, "datebdry")

    def edges(self) -> DataFrame:
        return C.edges(C.blob_links(self.spark, self.folder), C.papers(self.spark, self.folder))

    def listed(self, ids: str) -> DataFrame:
        """(id) of a comma list; what isn't an identifier is left out."""
        return self.spark.createDataFrame([(int(i),) for i in ids.split(",") if valid_id(i)], "id bigint")


def _numbers(r: Request, *names: str) -> list[int]:
    return [int(v) if (v := r.get(n, "0")).isdigit() else 0 for n in names]


def _category(s: Source, r: Request) -> DataFrame:
    cross = r.get("x") == "true"
    rows = s.searched("allcats" if cross else "maincat")
    if "fd" in r:
        return S.category_search_by_days(rows, s.counts(), s.boundaries(), r["sca"], cross, *_numbers(r, "fd", "td"))
    return S.category_search(rows, s.counts(), r["sca"], cross, *_numbers(r, "f", "t"))


def _aux(s: Source, r: Request) -> DataFrame:
    low, high = _numbers(r, "min", "max")
    inside = F.coalesce(F.col("inspire").between(low, high), F.lit(False))
    if "saux" in r:
        return S.generic(s.searched("authors", "inspire"), s.counts(), inside & S.all_terms(F.col("authors"), r["saux"], True))
    cross = r.get("x") == "true"
    return S.generic(s.searched("allcats" if cross else "maincat", "inspire"), s.counts(), inside & S.in_categories(r["scax"], cross), most=None)


def _links(s: Source, here: str, there: str, paper: str) -> DataFrame:
    one = s.listed(paper).withColumnRenamed("id", here)
    return V.linked(s.edges().join(F.broadcast(one), here), here, there, s.positions(), mapped_only=True)


def _coded(s: Source, code: str, minimal: bool) -> DataFrame:
    """A paper by its public code: its identifier, and unless ``minimal`` its counts; no row for what can't be a code."""
    rows = s.papers("arxiv").where((F.col("arxiv") == code) if valid_code(code) else F.lit(False))
    return rows.select("id") if minimal else rows.join(s.counts(), "id", "left").select("id", "numcites", "arxiv")


def _place(s: Source, r: Request) -> DataFrame:
    x, y = (float(v) for v in r["ml2p"].split(",")[:2])
    return T.at_point(s.positions(), x, y)


#: The first of these names that a request has is what it asks for. One entry for each request.
ROUTES: dict[str, Answer] = {
    "gdata": lambda s, r: s.listed(r["gdata"]).join(V.paper_rows(s.searched("title"), s.counts()), "id"),
    "sax": lambda s, r: _coded(s, r["sax"], False),
    "saxm": lambda s, r: _coded(s, r["saxm"], True),
    "sge": lambda s, r: S.any_term(s.papers("authors", "keywords"), ["authors", "keywords"], r["sge"]).select("id", "hits"),
    "skw": lambda s, r: S.any_term(s.papers("keywords"), ["keywords"], r["skw"]).select("id", "hits"),
    "sau": lambda s, r: S.generic(s.searched("authors"), s.counts(), S.all_terms(F.col("authors"), r["sau"], True)),
    "saux": _aux,
    "sti": lambda s, r: S.generic(s.searched("title"), s.counts(), S.all_terms(F.col("title"), r["sti"], False)),
    "sca": _category,
    "scax": _aux,
    "mp2l": lambda s, r: V.locations(s.listed(r["mp2l"]), s.positions()),
    "ml2p": _place,
    "mr2l": lambda s, r: _links(s, "src", "dst", r["mr2l"]),
    "mc2l": lambda s, r: _links(s, "dst", "src", r["mc2l"]),
    "gdmv": lambda s, r: V.versioned(V.date_boundaries(s.boundaries(), 0), s.version),
    "gdb": lambda s, r: V.versioned(V.date_boundaries(s.boundaries()), s.version),
    "chids": lambda s, r: S.convert_ids(s.searched(), [c for c in r["chids"].split(",") if valid_code(c)], [], []),
    "snp": lambda s, r: S.generic(s.searched(), s.counts(), S.in_range(*_numbers(r, "f", "t"))),
}


def route(request: Request) -> str | None:
    """The name of what a request asks for; None if it is nothing known."""
    return next((name for name in ROUTES if name in request), None)


def answer(source: Source, request: Request) -> DataFrame | None:
    """The rows that answer a request; None (a ``null`` response) for one that asks for nothing known."""
    name = route(request)
    return None if name is None else ROUTES[name](source, request)
