from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators import citations as C
from orrery.operators import components as G
from orrery.sources.blobs import BlobLayout, bad_blobs, pack_links, unpack_links
from orrery.sources.synthetic import double_star, scattered, star
from tests.conftest import rows_of


def find_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a in parent and b in parent:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted((root(n), n) for n in nodes)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40), st.sets(st.integers(0, 28), min_size=1))
def test_components(spark, links, nodes):
    n = spark.createDataFrame([(i, "x") for i in sorted(nodes)], "id bigint, component2 string")
    e = spark.createDataFrame(links, "src bigint, dst bigint")
    assert rows_of(G.connected_components(n, e)) == find_components(nodes, links)


@pytest.mark.parametrize("seed", range(2))
def test_components_in_rounds(spark, seed):
    """More links than one task takes."""
    rng = random.Random(seed)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    n, e = spark.range(40), spark.createDataFrame(links, "src bigint, dst bigint")
    assert rows_of(G.connected_components(n, e, few=-1)) == find_components(range(40), links)


def test_long_path_hub_and_stars(spark):
    path = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 700)]
    nodes = spark.range(0, 800)
    got = rows_of(G.connected_components(nodes, spark.createDataFrame(path, "src bigint, dst bigint")))
    assert got == find_components(range(800), path)
    for papers, links in (star(spark, 50), double_star(spark, 50)):
        c = G.connected_components(papers, links)
        assert rows_of(G.component_histogram(c)) == [(1, 50)]
        assert rows_of(G.largest_component(c)) == [(1, 50)]
    assert scattered(spark, 20, 5, 1).where("radius <= 4").count() == 20
    assert G.largest_component(G.connected_components(spark.range(5), links.limit(0))).count() == 0


def test_transitive_reduction(spark):
    rng = random.Random(3)
    links = {(a, b) for _ in range(120) for a, b in [sorted((rng.randrange(30), rng.randrange(30)), reverse=True)] if a != b}
    out = {n: {b for a, b in links if a == n} for n in range(30)}

    def reach(n):
        seen, todo = set(), list(out[n])
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += out[m]
        return seen

    want = sorted((b, a) for a, b in links if not any(b in reach(m) for m in out[a] if m != b))
    df = spark.createDataFrame(sorted(links) + [(1, 1), (2, 9)], "src bigint, dst bigint")
    assert rows_of(G.transitive_reduction(df)) == want


def walk(papers, components, keywords):
    """The walk over categories and papers, as told."""
    comp = dict(components)
    size = {}
    for c in comp.values():
        size[c] = size.get(c, 0) + 1
    big = min((c for c in size if size[c] > 2 and size[c] == max(size.values())), default=None)
    connected = {p for p in comp if comp[p] == big}
    links = []
    for cat in sorted({c for _, c, _ in papers}):
        best = {}
        for p, c, m in papers:
            if c == cat and p in connected:
                for _, w in keywords.get(p, []):
                    if w not in best or m > best[w][1]:
                        best[w] = (p, m)
        for p, c, _ in papers:
            if c != cat or p in connected:
                continue
            own = [(p, best[w][0], s) for s, w in keywords.get(p, []) if w in best]
            if not own:
                near = [(q, m) for q, d, m in papers if d == cat and q in connected]
                if near:
                    own = [(p, max(near, key=lambda x: (x[1], -x[0]))[0], 0)]
            if own:
                links += own
                connected |= {q for q in comp if comp[q] == comp[p]}
    return sorted(links), sorted(connected)


@pytest.mark.parametrize("seed", range(4))
def test_fake_links(spark, seed):
    rng = random.Random(seed)
    papers = [(i, rng.randrange(4), rng.choice([0.2, 0.4, 0.4, 1.0])) for i in range(40)]
    links = [(a, b) for a in range(14) for b in [rng.randrange(14)]] + [(rng.randrange(14, 40), rng.randrange(14, 40)) for _ in range(14)]
    words = {i: [(k, rng.choice("abcde")) for k in range(rng.randrange(3))] for i in range(40)}
    components = [(n, r) for r, n in find_components(range(40), links)]
    want = walk(papers, components, words)
    fakes, connected = G.fake_links(
        spark.createDataFrame(papers, "id bigint, cat bigint, mass double"), spark.createDataFrame(components, "id bigint, component bigint"),
        spark.createDataFrame([(i, s, w) for i, x in words.items() for s, w in x], "id bigint, slot int, keyword string"),
    )
    got = sorted((r["src"], r["dst"], r["slot"]) for r in fakes.collect())
    assert (got, sorted(r[0] for r in connected.collect())) == want


def test_blobs(spark):
    rows = [(1, k, 4_000_000_000 + k, k, 300 + k, 65_535 - k) for k in range(5)] + [(2, 0, 7, 0, 1, 0)]
    links = spark.createDataFrame(rows, "id bigint, slot bigint, other bigint, ord bigint, freq bigint, ncites bigint")
    packed = pack_links(links, "id")
    assert rows_of(unpack_links(packed, "id", "blob")) == rows_of(links)
    slim = BlobLayout(order=False, freq=True, ncites=False)
    again = unpack_links(pack_links(links, "id", slim), "id", "blob", slim)
    assert rows_of(again) == rows_of(links.withColumns({"ord": F.lit(0).cast("bigint"), "ncites": F.lit(0).cast("bigint")}))
    odd = spark.createDataFrame([(1, b""), (2, None), (3, b"123"), (4, b"\x01\0\0\0\x02\0\x03\0\x04\0")], "id bigint, blob binary").withColumn("other", F.lit("x"))
    assert rows_of(unpack_links(odd, "id", "blob")) == [(3, 4, 4, 2, 1, 0)]
    assert [r["id"] for r in bad_blobs(odd, "blob").collect()] == [3]
    assert unpack_links(odd.limit(0), "id", "blob").count() == 0


def test_edges_and_counts(spark):
    dec = spark.createDataFrame([(1, 0, 1, 1, 1, 0), (1, 1, 2, 2, 300, 5), (1, 2, 2, 3, 1, 6), (1, 3, 9, 1, 1, 0), (3, 0, 2, 1, 0, 7)], "id bigint, slot bigint, other bigint, ord bigint, freq bigint, ncites bigint")
    known = spark.range(1, 4)
    e = C.edges(dec, known)
    assert rows_of(e.select("src", "dst", "freq")) == [(2, 0, 3), (2, 1, 1), (2, 255, 1)]
    assert rows_of(C.citation_counts(e, known)) == [(0, 1), (0, 3), (3, 2)]
    assert rows_of(C.citation_counts(e, known, only_frequent=True)) == [(0, 1), (0, 3), (2, 2)]
    assert rows_of(C.external_cites(e)) == [(7, 2)]


def test_categories_keywords_index(spark):
    df = spark.createDataFrame([(1, "b;a, x", "k1,,k2,k3,k4,k5"), (2, None, None), (3, "a a b c d", "")], "id bigint, allcats string, keywords string")
    names = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "cat string, number bigint")
    assert [r["cats"] for r in C.known_categories(df, names).orderBy("id").collect()] == [[2, 1, 0, 0], [0, 0, 0, 0], [1, 1, 2, 3]]
    assert [tuple(r) for r in C.keyword_rows(df).orderBy("id", "slot").collect()] == [(1, 0, "k1"), (1, 1, "k2"), (1, 2, "k3"), (1, 3, "k4")]
    big = spark.range(0, 5000, 3).withColumn("k", F.col("id") * 7)
    assert C.indexed(big, "k").where(F.col("idx") * 3 != F.col("id")).count() == 0
    assert C.indexed(big.limit(0), "k").count() == 0
