from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import names as N
from orrery.llm.names import name_clusters, one_error, parse_name, same_names, similar_tokens, spellings, token_places
from orrery.llm.pairs import item_pairs, lifted
from orrery.llm import terms as T
from orrery.llm.terms import decoded, marked_terms, normal_term, term_bitmaps
from orrery.llm.topn import top_n
from tests.conftest import in_order, rows_of


def test_terms(spark):
    rng = random.Random(1)
    rows = [(i * 37 - 50, [rng.choice(["a", "a", "a", "b", "c", "d", f"t{rng.randrange(40)}", "", None]) for _ in range(rng.randrange(6))]) for i in range(300)]
    rows += [(5000, None), (None, ["a", "zz"]), (5001, [])]
    df = spark.createDataFrame(rows, "id bigint, k array<string>").withColumn("term", F.lit("clash")).withColumn("word", F.lit(1))
    uses, docs = {}, {}
    for i, ks in rows:
        for k in ks or []:
            if k:
                uses[k] = uses.get(k, 0) + 1
                docs.setdefault(k, set()).update([] if i is None else [i])
    n = len(set().union(*docs.values()))
    mark = lambda d: "rare" if d < 3 else "common" if d > 0.1 * n else None
    got = marked_terms(df, "id", F.col("k"), common_above=0.1)
    assert rows_of(got.select(F.col("term").alias("a"), F.col("uses").alias("b"), F.col("records").alias("c"), F.col("mark").alias("d"))) == in_order((k, uses[k], len(docs[k]), mark(len(docs[k]))) for k in uses)
    assert marked_terms(df.limit(0), "id", F.col("k")).count() == 0
    # The same record twice sets one bit and counts two uses; the row of a null term is the union.
    edge = 1 << T.CONTAINER
    two = spark.createDataFrame([(64, ["x", "x"]), (edge - 1, ["x", "y"]), (edge, ["x"]), (64, ["x"]), (-1, ["y"]), (None, ["x"])], "id bigint, k array<string>")
    got = {(r["term"], r["container"]): (decoded(bytes(r["bits"])).tolist(), r["records"], r["uses"]) for r in term_bitmaps(two, "id", F.col("k")).collect()}
    assert got[("x", 0)] == ([64, edge - 1], 2, 4) and got[("x", 1)] == ([0], 1, 1) and got[("y", 0)] == ([edge - 1], 1, 1) and got[("y", -1)] == ([edge - 1], 1, 1)
    assert got[("x", None)] == ([], 0, 1) and got[(None, 0)][0] == [64, edge - 1] and len(got) == 9


def test_terms_in_pieces(spark, monkeypatch):
    """A container whose occurrences come in many pieces is merged by union."""
    rng = random.Random(2)
    rows = [(rng.randrange(50), [f"t{rng.randrange(9)}" for _ in range(3)]) for _ in range(400)]
    sets, uses = {}, {}
    for i, ks in rows:
        for k in ks:
            sets.setdefault(k, set()).add(i)
            uses[k] = uses.get(k, 0) + 1
    monkeypatch.setattr(T, "HELD", 20)
    batches = [pa.RecordBatch.from_arrays([pa.array([c] * len(p)), pa.array([i for i, _ in p]), pa.array([k for _, k in p])], ["container", "place", "term"]) for c, p in ((0, [(i, k) for i, ks in rows[j : j + 10] for k in ks]) for j in range(0, 400, 10))]
    got = pa.Table.from_batches(list(T._containers(iter(batches)))).to_pylist()
    assert {r["term"]: (set(decoded(r["bits"]).tolist()), r["uses"]) for r in got if r["term"]} == {k: (sets[k], uses[k]) for k in sets}
    assert [set(decoded(r["bits"]).tolist()) for r in got if r["term"] is None] == [{i for i, _ in rows}]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20 - 1), unique=True, max_size=30), max_size=6))
def test_encoding(sets):
    number = np.array([k for k, s in enumerate(sets) for _ in s], dtype=np.int64)
    raw, offsets = T.encoded(number, np.array([p for s in sets for p in sorted(s)], dtype=np.int64), len(sets))
    assert [decoded(raw[a:b].tobytes()).tolist() for a, b in zip(offsets, offsets[1:])] == [sorted(s) for s in sets]


def test_normal_term(spark):
    df = spark.createDataFrame([("  Graph \t  Diffusion ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(normal_term(F.col("t"))).collect()] == ["graph diffusion", None, ""]


@pytest.mark.parametrize("room", [1_000_000, 8])
def test_top_n(spark, room):
    rng = random.Random(room)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", None]), rng.randrange(200), rng.choice([None, -(2**63), 2**63 - 1, 5, 5, 7])) for _ in range(400)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "run bigint, cat string, id bigint, score bigint").repartition(5).withColumn("place", F.lit("clash"))
    want = []
    for key in {r[:2] for r in rows}:
        own = sorted((-s, i) for r, c, i, s in rows if (r, c) == key and s is not None)
        want += [(key[1], i, k + 1, key[0], -s) for k, (s, i) in enumerate(own[:5])]
    assert rows_of(top_n(df, ["run", "cat"], "score", "id", 5, room)) == in_order(want)
    assert top_n(df.limit(0), ["run", "cat"], "score", "id", 5).count() == 0
    assert top_n(df.withColumn("score", F.lit(None).cast("bigint")), ["run"], "score", "id", 5).count() == 0


def test_pairs(spark):
    rng = random.Random(3)
    baskets = [[rng.choice("aaabbcdef") for _ in range(rng.randrange(7))] + rng.choice([[], [""], [None]]) for _ in range(200)] + [None, []]
    sets = [{x for x in b or [] if x} for b in baskets]
    n = sum(1 for s in sets if s)
    one = {x: sum(x in s for s in sets) for x in "abcdef"}
    two = {p: c for p in combinations("abcdef", 2) if (c := sum(p[0] in s and p[1] in s for s in sets))}
    df = spark.createDataFrame([(b, 1) for b in baskets], "i array<string>, a int").withColumn("n", F.lit(2))
    got = {(r["a"], r["b"]): r for r in item_pairs(df, F.col("i")).collect()}
    assert set(got) == set(two)
    for (x, y), r in got.items():
        assert (r["n_ab"], r["n_a"], r["n_b"], r["n"]) == (two[x, y], one[x], one[y], n)
        assert r["lift"] == pytest.approx(n * two[x, y] / one[x] / one[y])
    high = {(r["a"], r["b"]) for r in lifted(item_pairs(df, F.col("i")), 3, 1).collect()}
    assert high == {p for p, c in two.items() if c >= 3 and n * c >= one[p[0]] * one[p[1]]}
    assert item_pairs(df.limit(0), F.col("i")).count() == 0
    # Pairs are emitted once: the result is read from the written counts.
    plan = item_pairs(df, F.col("i"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Scan parquet") >= 1
    # One very large basket is emitted as a stream.
    big = spark.createDataFrame([([f"x{k:04d}" for k in range(300)],)], "i array<string>")
    assert item_pairs(big, F.col("i")).count() == 300 * 299 // 2


def test_parse_name():
    scores = {"margaret": 0.9, "daniel": 0.9, "stone": 0.1, "zebulon": 0.5, "quimby": 0.5, "peggy": 0.9, "maria": 0.9, "cruz": 0.1}
    for text, want in {
        "Margaret C. Stone": ("p", "stone", "margaret", "c", ""), "Stone, M. C.": ("p", "stone", "m", "c", ""), "M.C. Stone": ("p", "stone", "m", "c", ""), "MC Stone": ("p", "stone", "m", "c", ""),
        "STONE Margaret": ("p", "stone", "margaret", "", ""), "Stone Margaret": ("p", "stone", "margaret", "", ""), "margaret  stöne": ("p", "stone", "margaret", "", ""), "Stone M.": ("p", "stone", "m", "", ""),
        'Margaret "Peggy" Stone': ("p", "stone", "margaret", "", ""), "Peggy Stone": ("p", "stone", "margaret", "", ""), "Ted Stone": ("p", "stone", "edward", "", "theodore"), "Chris Stone": ("p", "stone", "c", "", ""),
        "The ATLAS Collaboration": ("c", "atlas", "", "", ""), "Atlas Coll.": ("c", "atlas", "", "", ""), "Collaboration ATLAS": ("c", "atlas", "", "", ""), "ATLAS Colaboration": ("c", "atlas", "", "", ""),
        "Stone": ("p", "stone", "", "", ""), "D. STONE Jr.": ("p", "stone", "d", "", ""), "...": None, "": None,
        "Zebulon Quimby": ("p", "zebulon", "quimby", "", ""), "Quimby Zebulon": ("p", "zebulon", "quimby", "", ""),
        "Maria de la Cruz": ("p", "cruz", "maria", "", ""), "de la Cruz, Maria": ("p", "cruz", "maria", "", ""), "Cruz, Maria de la": ("p", "cruz", "maria", "", ""),
    }.items():
        assert parse_name(text, scores) == want, text


def test_similar_tokens(spark, monkeypatch):
    """The join finds every pair one error apart and each token itself, also where very many tokens share a q-gram."""
    monkeypatch.setattr(N, "CELL", 3)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(60)})
    df = spark.createDataFrame([(w, b) for w in words for b in "xy"], "token string, block string")
    for q in (2, 5):
        got = {(r["t1"], r["t2"]) for r in similar_tokens(df, "token", ["block"], q).where("block = 'x'").collect()}
        assert {(w, w) for w in words} <= got
        one = spark.createDataFrame([(a, b) for a in words for b in words if a < b], "a string, b string").where(one_error(F.col("a"), F.col("b")))
        assert {tuple(r) for r in one.collect()} <= got
        assert all(abs(len(a) - len(b)) <= 1 for a, b in got)


def test_reordered_and_rare_names(spark):
    """Names that occur a few times only, in either order, and with particles; however many other names there are."""
    same = [["Zebulon Quimby", "Quimby Zebulon", "Quimby, Zebulon"], ["de la Cruz, Maria", "Maria de la Cruz"]]
    rng = random.Random(1)
    other = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(300)]
    rows = [(v,) for g in same for v in g] + [(f"{rng.choice(other)} {w}",) for w in other for _ in range(4)]
    got = {tuple(r) for r in same_names(spark.createDataFrame(rows, "val string"), "val").collect()}
    assert {tuple(sorted(p)) for g in same for p in combinations(g, 2)} <= got


def test_names_come_from_the_join(spark, monkeypatch):
    """Without the similarity join nothing is linked; the soft similarity decides what is."""
    rows = [("Margaret Stonewall",), ("M. Stonewall",), ("Stonewall, Margaret",), ("Margaret Stonewlal",), ("Margaret Stonexyll",)]
    df = spark.createDataFrame(rows * 2, "val string")
    base = {tuple(r) for r in same_names(df, "val").collect()}
    assert len(base) == 6
    assert {tuple(r) for r in same_names(df, "val", alike=-1.0).collect()} > base
    real = N.similar_tokens
    monkeypatch.setattr(N, "similar_tokens", lambda *a, **k: real(*a, **k).limit(0))
    assert same_names(df, "val").count() == 0


def test_one_error(spark):
    word = "stonewall"
    made = {word[:k] + word[k + 1 :] for k in range(9)} | {word[:k] + "z" + word[k:] for k in range(10)} | {word[:k] + "z" + word[k + 1 :] for k in range(9)} | {word[:k] + word[k + 1] + word[k] + word[k + 2 :] for k in range(8) if word[k] != word[k + 1]}
    other = ["stonewlla", "stnoewlal", "stonewzzl", "stone", word]
    df = spark.createDataFrame([(w, True) for w in sorted(made)] + [(w, False) for w in other], "w string, near boolean")
    assert df.where(one_error(F.lit(word), F.col("w")) != F.col("near")).count() == 0
    tokens = spark.createDataFrame([(w, "p") for w in sorted(made | {word})], "token string, kind string")
    found = {frozenset((r["t1"], r["t2"])) for r in similar_tokens(tokens, "token", ["kind"]).collect()}
    assert {frozenset((word, w)) for w in made} <= found


def test_names_of_a_shared_surname(spark):
    """A typing error is held against everyone of the surname and initial, not only the most used."""
    uses = [("John B. Smithson", 9), ("J. Smithson", 2), ("James A. Smithson", 4), ("James A. Smithsno", 1), ("J. A. Smithosn", 1), ("Justine Smithsun", 1)]
    got = {tuple(r) for r in same_names(spark.createDataFrame([(v,) for v, n in uses for _ in range(n)], "val string"), "val").collect()}
    assert ("James A. Smithsno", "James A. Smithson") in got
    assert not any({"John B. Smithson", "Justine Smithsun"} & set(p) for p in got)
    roots = {r["val"]: r["root"] for r in name_clusters(spark.createDataFrame([(v,) for v, n in uses for _ in range(n)], "val string"), "val").collect()}
    assert roots["J. A. Smithosn"] == "smithson" and roots["Justine Smithsun"] == "smithsun"


def test_names(spark):
    same = [["Margaret C. Stonewall", "M. Stonewall", "STONEWALL Margaret", "Stonewall, M. C.", "Peggy Stonewall", "margaret stonewal", "Margaret Stónewall"], ["Daniel Stonewall", "D Stonewall", "Dan Stonewall"], ["ABCDE Collaboration", "The ABCDE Collab."], ["Ted Rockfall", "T. Rockfall", "Theodore Rockfall"]]
    apart = ["Margaret Riverbed", "R. Stonewall", "Jon Onlyone", "???", "Charles Lakeside", "Christine Lakeside", "C. Lakeside"]
    uses = [(v, k) for group in same for j, v in enumerate(group) for k in range(3 if j == 0 else 1)] + [(v, 0) for v in apart] + [(None, 1), ("", 1)]
    df = spark.createDataFrame(uses, "val string, rare int")
    got = {(r["namea"], r["nameb"]) for r in same_names(df, "val").collect()}
    assert got == {tuple(sorted(p)) for g in same for p in combinations(g, 2)}
    assert same_names(df.limit(0), "val").count() == 0
    assert name_clusters(df, "val").count() == len({v for v, _ in uses if v}) - 1  # the one without letters
    n = {r["token"]: (r["n"], r["first"]) for r in token_places(spellings(df, "val")).collect()}
    assert n["margaret"][1] > n["margaret"][0] / 2 and n["stonewall"][1] == 1
