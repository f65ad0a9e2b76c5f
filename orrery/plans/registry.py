"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: SQL of the logical tables: current rows, papers that aren't deleted, counts, decoded references, and the graph's links.
PRELUDE = """
    with recursive cur as (
        select distinct m.id, allcats, maincat, title, authors, keywords, arxiv, publ, inspire, status
        from meta_data m join (select id as i, max(loadedat) as t from meta_data group by id) on m.id = i and m.loadedat = t),
    papers as (select * from cur where coalesce(lower(trim(status)), '') <> 'deleted'),
    cnt as (select distinct id, numrefs, numcites, dnumcites1, dnumcites5 from pcite),
    blob as (select distinct id, hex(refs) as h, octet_length(refs) // 10 as n from pcite where octet_length(refs) > 0 and octet_length(refs) % 10 = 0),
    rec as (select id, h, unnest(range(n)) as slot from blob),
    dec as (
        select id, slot, cast('0x' || substr(h, 20 * slot + 7, 2) || substr(h, 20 * slot + 5, 2) || substr(h, 20 * slot + 3, 2) || substr(h, 20 * slot + 1, 2) as bigint) as other,
               cast('0x' || substr(h, 20 * slot + 11, 2) || substr(h, 20 * slot + 9, 2) as bigint) as ord,
               cast('0x' || substr(h, 20 * slot + 15, 2) || substr(h, 20 * slot + 13, 2) as bigint) as freq,
               cast('0x' || substr(h, 20 * slot + 19, 2) || substr(h, 20 * slot + 17, 2) as bigint) as ncites
        from rec),
    e as (
        select id as src, other as dst, ord, least(freq, 255) as freq, ncites from dec
        where id <> other and id in (select id from papers) and other in (select id from papers)),
    cites as (select p.id, coalesce(c.n, 0) as cites from papers p left join (select dst, count(*) as n from e group by dst) c on p.id = c.dst)
"""


class Registry:
    """Queries by name, and the SQL of those that SQL can express."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = (PRELUDE if prelude else "") + sql
            return f

        return add
