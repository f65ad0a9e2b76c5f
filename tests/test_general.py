from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from orrery.operators.orphans import bare_code, link_orphans, orphan_references
from orrery.operators.skew import count_mismatches, heavy_keys, salted_aggregate, salted_distinct_count
from orrery.plans import general_queries
from orrery.sources.tables import current_rows
from tests.conftest import in_order, rows_of

LINKS = "linkid bigint, pastid bigint, futureid bigint, pastpaper string, seenat timestamp_ntz"
META = "id bigint, arxiv string, status string, loadedat timestamp_ntz"
T = lambda m, d=1: dt.datetime(2020, m, d)


def test_current_rows(spark):
    df = spark.createDataFrame([(1, "a", T(1)), (1, "b", T(2)), (1, "b", T(2)), (2, None, None), (None, "n", T(1)), (3, "x", T(1)), (3, "y", T(1))], "id int, v string, loadedat timestamp_ntz")
    assert rows_of(current_rows(df, "v")) == [(1, "b"), (2, None), (3, "y"), (None, "n")]
    assert current_rows(df.limit(0), "v").count() == 0


def test_salted_distinct_count(spark):
    rng = random.Random(1)
    rows = [(7, rng.randrange(500)) for _ in range(3000)] + [(rng.randrange(100, 900), rng.randrange(50)) for _ in range(2000)] + [(None, 1), (8, None)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    want = {}
    for k, v in rows:
        if k is not None:
            want.setdefault(k, set()).update([] if v is None else [v])
    for salts in (1, 64, None):
        got = {r["k"]: r["n"] for r in salted_distinct_count(df, "k", "v", "n", salts=salts, share=0.05).collect()}
        assert got == {k: len(v) for k, v in want.items()}
    assert [(r[0], r["__parts"]) for r in heavy_keys(df, "k", 0.05).collect()] == [(7, 12)]
    assert salted_distinct_count(df.limit(0), "k", "v", "n").count() == 0


def test_citing_all(spark, tmp_path):
    """Papers that nobody cites count 0."""
    folder = str(tmp_path)
    for name, rows, schema in (("pcite", [(1,), (2,), (2,)], "id bigint"), ("meta_data", [(3,), (None,)], "id bigint"), ("links", [(1, 2), (1, 2), (1, 3), (9, 1), (None, 1)], "pastid bigint, futureid bigint")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    assert rows_of(general_queries.p5_citing_all(spark, folder).select(F.col("pastid").alias("a"), F.col("citing").alias("b"))) == [(1, 2), (2, 0), (3, 0), (9, 1)]


def test_salted_aggregate(spark):
    df = spark.createDataFrame([(1, k, k % 3) for k in range(100)] + [(2, 5, 1), (None, 4, 2), (None, None, 2)], "k int, __v int, v int")
    got = salted_aggregate(df, "k", {"s": F.sum("__v"), "c": F.count(F.lit(1))}, {"s": F.sum("s"), "c": F.sum("c")}, share=0.3)
    assert rows_of(got) == rows_of(df.groupBy("k").agg(F.sum("__v").alias("s"), F.count(F.lit(1)).alias("c")))


def test_count_mismatches(spark):
    claims = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 0), (4, None), (5, 1), (None, 3)], "id bigint, n bigint")
    links = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, None), (None, 3)], "pastid bigint, futureid bigint")
    assert rows_of(count_mismatches(claims, links, "id", "n", "pastid", "futureid").select("id")) == [(2,), (5,)]


def brute_orphans(links, meta):
    import re

    bare = lambda c: None if c is None else re.sub(r"^arxiv:|v[0-9]+$", "", re.sub(r"\s+", "", c).lower())
    now, first = {}, {}
    for i, a, s, at in meta:
        if i not in now or at > now[i][2]:
            now[i] = (a, s, at)
        first[i] = min(first.get(i, at), at)
    facts = {("id", i): ((v[1] or "").strip(" ").lower() == "deleted", first[i]) for i, v in now.items()}
    for i, v in now.items():
        if v[0] is not None:
            facts[("code", bare(v[0]))] = facts[("id", i)]
    out = set()
    for linkid, past, future, code, at in links:
        for field, key in (("pastid", ("id", past)), ("futureid", ("id", future)), ("pastpaper", ("code", bare(code)))):
            if key[1] is None:
                continue
            kind = "missing" if key not in facts else "deleted" if facts[key][0] else "late" if at and facts[key][1] > at else None
            if kind:
                out.add((kind, linkid, at.strftime("%Y-%m") if at else None, field))
    return in_order(out)


def test_orphans_against_brute_force(spark):
    rng = random.Random(2)
    meta = [(i, None if i % 7 == 0 else f"{i:04d}.12", rng.choice(["ok", " Deleted", "DELETED", None]), T(1 + i % 9)) for i in range(40)]
    meta += [(i, f"{i:04d}.12", "ok", T(10)) for i in range(5)] + [meta[0]]
    links = []
    for k in range(600):
        code = rng.choice([None, "", "unknown", f"{rng.randrange(50):04d}.12", f" arXiv:{rng.randrange(50):04d}.12v3", f"ARXIV: {rng.randrange(50):04d}.12"])
        links.append((k % 500 if k % 11 else None, 3 if k % 3 == 0 else rng.choice([None, rng.randrange(60)]), rng.choice([None, rng.randrange(60)]), code, rng.choice([None, T(1 + k % 12, 2)])))
    links += links[:20]
    ldf = spark.createDataFrame(links, LINKS).withColumn("key", F.lit("clash")).withColumn("source", F.lit(1)).withColumn("kind", F.lit(2))
    mdf = spark.createDataFrame(meta, META).withColumn("gone", F.lit("clash"))
    for share in (1 / 1024, 0.1, 2.0):
        assert rows_of(link_orphans(ldf, mdf, share)) == brute_orphans(links, meta)
    assert link_orphans(ldf.limit(0), mdf).count() == 0
    assert {r["kind"] for r in link_orphans(ldf, mdf.limit(0)).collect()} == {"missing"}


def test_orphans_of_any_tables(spark):
    refs = spark.createDataFrame([(1, "f", "s", "a", T(1)), (2, "f", "s", "b", T(1)), (3, "f", "s", None, T(1))], "source int, field string, space string, key string, at timestamp_ntz")
    targets = spark.createDataFrame([("s", "a", True, T(1)), ("s", "a", False, T(3))], "space string, key string, gone boolean, firstat timestamp_ntz")
    # Of two targets with one key, one isn't deleted, and the first was there in time.
    assert rows_of(orphan_references(refs, targets)) == [("f", "missing", "2020-01", 2)]


def test_bare_code(spark):
    df = spark.createDataFrame([("ArXiv: ab/12 v3",), (" AB/12",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(bare_code(F.col("c"))).collect()] == ["ab/12", "ab/12", None, ""]
