from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.config import Forces, load_settings
from orrery.functions import encode, labels, measures
from orrery.functions.ids import date_id, id_date, spoken_date
from orrery.operators import search as S
from orrery.operators import serving as V
from orrery.operators import tiles as T
from orrery.operators import user_state as U
from orrery.plans import map_queries, serving_queries
from orrery.sources import json_sources as J
from tests.conftest import rows_of

POS = "id bigint, x int, y int, r int"


def test_tiles_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(-900, 900), rng.randrange(-700, 900), rng.randrange(1, 120)) for i in range(80)]
    pos = spark.createDataFrame(rows, POS)
    bounds = T.world_bounds(pos)
    b = bounds.first()
    assert b["minx"] == min(0, min(x - r for _, x, _, r in rows)) - 100 and b["maxy"] == max(0, max(y + r for _, _, y, r in rows)) + 100
    pyramid = T.tile_pyramid(bounds, 16)
    want = set()
    for depth, divs in enumerate((4, 8, 16)):
        tw = int(max((b["maxx"] - b["minx"]) / divs, (b["maxy"] - b["miny"]) / divs))
        for xi in range(1, divs + 1):
            for yi in range(1, divs + 1):
                mx, my = int(b["minx"] + (xi - 0.5) * tw), int(b["miny"] + (yi - 0.5) * tw)
                want |= {(depth, i, xi, yi) for i, x, y, r in rows if abs(x - mx) <= tw // 2 + b["maxr"] + r and abs(y - my) <= tw // 2 + b["maxr"] + r}
    assert set(rows_of(T.tile_members(pos, pyramid).select("depth", "id", "xi", "yi"))) == want
    none = T.world_bounds(pos.limit(0)).first()
    assert (none["minx"], none["maxx"], none["maxr"]) == (-100, 100, 0)


@pytest.fixture(scope="module")
def small_map(tmp_path_factory, spark):
    """A folder with a map of a few papers; two of them without metadata."""
    folder = str(tmp_path_factory.mktemp("map"))
    rng = random.Random(6)
    pos = [(2_100_000_000 + i, rng.randrange(-9000, 9000), rng.randrange(-7000, 9000), rng.randrange(1, 120)) for i in range(40)]
    spark.createDataFrame(pos, POS).write.parquet(f"{folder}/map_data.parquet")
    meta = [(i, "opt-dyn", f"{k}", datetime.datetime(2020, 1, 1)) for k, (i, *_) in enumerate(pos[:38])]
    rows = spark.createDataFrame(meta, "id bigint, maincat string, arxiv string, loadedat timestamp")
    rows.selectExpr("*", "maincat as allcats", "'T' as title", "'A. B' as authors", "'k' as keywords", "'' as publ", "id % 3 as inspire", "'' as status").write.parquet(f"{folder}/meta_data.parquet")
    spark.createDataFrame([(0, pos[-1][0])], "daysago int, id bigint").write.parquet(f"{folder}/datebdry.parquet")
    return folder, pos


def test_whole_pyramid(spark, small_map):
    """The tile queries give all seven depths, to 256 divisions."""
    folder, pos = small_map
    maxr = max(r for *_, r in pos)
    minx, maxx, miny, maxy = (f(0, f(p[k] + s * p[3] for p in pos)) + s * 100 for k, f, s in ((1, min, -1), (1, max, 1), (2, min, -1), (2, max, 1)))
    want, marks = {}, {}
    for depth, divs in enumerate((4, 8, 16, 32, 64, 128, 256)):
        tw = int(max((maxx - minx) / divs, (maxy - miny) / divs))
        near = lambda c, low, reach: [n for n in range(1, divs + 1) if abs(c - int(low + (n - 0.5) * tw)) <= tw // 2 + reach]  # noqa: E731, B023
        for i, x, y, r in pos:
            for found, reach in ((want, maxr + r), (marks, max(r, -(-tw // 256)) + 1)):
                for xi in near(x, minx, reach):
                    for yi in near(y, miny, reach):
                        found.setdefault((depth, xi, yi), set()).add(i)
    got = map_queries.tile_membership_whole(spark, folder).collect()
    assert {(t["depth"], t["xi"], t["yi"]): (t["papers"], t["checksum"]) for t in got} == {t: (len(ids), sum(i % 1000003 for i in ids)) for t, ids in want.items()}
    drawn = {}
    for t in map_queries.tile_draw_list(spark, folder).select("depth", "xi", "yi", "id").collect():
        drawn.setdefault(tuple(t)[:3], set()).add(t["id"])
    known = {i for i, *_ in pos[:38]}
    assert drawn == {t: ids & known for t, ids in marks.items() if ids & known}


def test_labels_zones_and_png(spark):
    pos = spark.createDataFrame([(1, 0, 0, 50, "big"), (2, 400, 300, 1, "small"), (3, -300, 10, 40, "")], POS + ", label string")
    zones = T.zone_pyramid(T.world_bounds(pos))
    cats = spark.createDataFrame([("c", 10, 10, 5)], "label string, x bigint, y bigint, r bigint")
    out = T.zone_labels(pos, zones, cats, cats)
    assert out.where("depth = 0").select("label").distinct().count() == 2
    text = T.zone_json(out, zones).where("depth = 0").first()["json"]
    assert text.startswith("lz_0_1_1({") and json.loads(text[len("lz_0_1_1(") : -1])["lbls"][0]["lbl"] == "big"
    pyramid = T.tile_pyramid(T.world_bounds(pos), 4)
    drawn = T.draw_list(T.tile_members(pos.drop("label"), pyramid), pyramid, F.struct(F.lit(1.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.0).alias("b")))
    assert T.rasterise(drawn, 32).limit(1).first()["png"][:8] == b"\x89PNG\r\n\x1a\n"
    index = json.loads(T.world_index(T.world_bounds(pos), spark.sql("select 7L as latestid"), pyramid, zones).first()[0])
    assert index["latestid"] == 7 and len(index["tilings"]) == 1 and len(index["zones"]) == 9


def test_points(spark):
    pos = spark.createDataFrame([(2, 0, 0, 10), (1, 5, 0, 10), (3, 1000, 1000, 600)], POS)
    assert rows_of(T.at_point(pos, 10, 0)) == [(1, 10)]
    assert rows_of(T.at_point(pos, -10, 0)) == [(2, 10)]
    assert rows_of(T.at_point(pos, -10, 0, edge=False)) == []
    pts = spark.createDataFrame([(1, 0, 0), (2, -10, 0), (3, 600, 700), (4, -900, 0)], "point int, x int, y int")
    assert rows_of(T.points_to_papers(pts, pos)) == [(1, 1), (2, 2), (3, 3)]


def test_label_texts(spark):
    rows = [("A.B. One,C. Two", "k1,k2,k3", "t"), ("A. One", "", "A title, of some length that goes on"), ("A. One,B. Two,C. Three", None, None), (None, "k", "t"), ("", "", "x" * 40)]
    df = spark.createDataFrame(rows, "a string, k string, t string")
    got = [r[0] for r in df.select(labels.paper_label(F.col("a"), F.col("k"), F.col("t"))).collect()]
    assert got == ["k1,k2, One, Two", "A title of some length that...,, One,", ", One,et al.", "k,,,", "x" * 32 + "...,,,"]
    assert labels.valid_categories("hep-th,math") == ["hep-th", "math"] and labels.valid_categories("x") is None and labels.valid_categories("a.CO") is None
    assert labels.valid_id("0") and labels.valid_id("1234567890") and not labels.valid_id("12") and labels.valid_suffix("ab_1") and not labels.valid_suffix("a-b")
    text = "<a> <abstract>\n  One\t two <b>three</abstract>"
    assert spark.createDataFrame([(text,), (None,)], "x string").select(labels.abstract_text(F.col("x"))).collect()[0][0] == "One two"
    assert spark.range(1).select(labels.required_terms(F.lit("it's +a b"), True)).first()[0] == ' +"it" +"s" +"a" +"b"'


def test_dates(spark):
    df = spark.createDataFrame([(2217359375, "2021-3-7"), (1920234503, "then")], "id bigint, t string")
    got = df.select(id_date(F.col("id")).cast("string"), spoken_date(F.col("t")), date_id(id_date(F.col("id")), 3)).collect()
    assert [tuple(r) for r in got] == [("2022-01-01", "7 March 2021", 2220000012), ("1992-01-16", "then", 1920234387)]


def test_quantise(spark):
    df = spark.createDataFrame([(0.025, -0.025), (1.31, -7.9)], "a double, b double")
    assert [tuple(r) for r in df.select(measures.quantised(F.col("a")), measures.quantised(F.col("b"))).collect()] == [(1, -1), (26, -158)]
    assert measures.fitting_scale(10, 20, 200, 200, 1) == 5


def test_search(spark):
    rows = [(1, "On the math of things", "math-ph", "x", "a", None), (2, "Things", "math", "math", None, "J#1"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, title string, allcats string, maincat string, arxiv string, publ string")
    assert [r[0] for r in df.where(S.all_terms(F.col("title"), "math things", False)).select("id").collect()] == [1]
    assert df.where(S.all_terms(F.col("title"), "", False)).count() == 0
    assert [r[0] for r in df.where(S.in_categories("math", True)).select("id").collect()] == [1, 2]
    assert [r[0] for r in df.where(S.in_categories("math", False)).select("id").collect()] == [2]
    assert df.where(S.in_categories("m.x", True)).count() == 0
    misc = spark.createDataFrame([("top10", "5,9,1,7,10,2,bad,1,1,8,x,3,4,11"), ("c", "6,10,3")], "field string, value string")
    assert [tuple(r) for r in S.trending(misc, ["top10", "c"]).collect()] == [(6, 3, "c"), (7, 2, None), (5, 1, None)]
    assert rows_of(S.convert_ids(df, ["a"], [], ["J"])) == [(1, "a"), (2, "J")]
    assert S.convert_ids(df, ["a"] * 51, [], []).count() == 0


def test_data_for_ids(spark):
    papers = spark.createDataFrame([(1, "T", None, 2, 3, 0, -1, "a1", "c,d", 5, None), (2, None, "A", None, None, None, None, None, "c", 0, "")], "id bigint, title string, authors string, numrefs bigint, numcites bigint, dnumcites1 int, dnumcites5 int, arxiv string, allcats string, inspire bigint, publ string")
    links = spark.createDataFrame([(k, 1, k, 1) for k in range(10, 40)] + [(1, 2, 1, 2)], "src bigint, dst bigint, ord bigint, freq bigint")
    cites = spark.createDataFrame([(2, 1)], "id bigint, cites bigint")
    asked = spark.createDataFrame([(1, V.META | V.UPDATE | V.REFS | V.NEW_CITES | V.ABSTRACT), (2, V.UPDATE), (99, 1)], "id bigint, flags int")
    texts = spark.createDataFrame([(2, "abc")], "id bigint, abstract string")
    got = {r["id"]: r for r in V.data_for_ids(asked, papers, links, cites, 35, texts).collect()}
    assert set(got) == {1, 2}
    meta = json.loads(got[1]["meta"])
    assert meta == {"auth": "(unknown authors)", "titl": "T", "nr": 2, "nc": 3, "dnc1": 0, "dnc5": -1, "arxv": "a1", "cats": "c,d", "insp": 5}
    assert got[1]["upd"] is None and json.loads(got[1]["refs"]) == [{"id": 2, "o": 1, "f": 2, "nc": 1}] and got[1]["abst"] == "(no abstract)"
    assert [x["id"] for x in json.loads(got[1]["cites"])] == [35, 36, 37, 38, 39]
    assert got[2]["meta"] is None and got[2]["refs"] is None and got[2]["abst"] is None
    assert encode.to_response(links.limit(0)) == '{"r":null}' and encode.to_response(spark.range(1), "cb") == 'cb({"r":[{"id":0}]})'


def test_data_for_ids_query(spark, tmp_path):
    """The query reads inspire, and gives abstracts to requests that ask for them."""
    folder, at = str(tmp_path), datetime.datetime(2020, 1, 1)
    meta = [(1, "opt-dyn", 1048, at), (2, "opt-dyn", 0, at), (3, "geo", 7, at)]
    rows = spark.createDataFrame(meta, "id bigint, maincat string, inspire bigint, loadedat timestamp")
    rows.selectExpr("*", "maincat as allcats", "'T' as title", "'A. B' as authors", "'k' as keywords", "'a' as arxiv", "'' as publ", "'' as status").write.parquet(f"{folder}/meta_data.parquet")
    counts = spark.createDataFrame([(k, bytearray()) for k in (1, 2, 3)], "id bigint, refs binary")
    counts.selectExpr("*", "refs as cites", "0 as numrefs", "0 as numcites", "0 as dnumcites1", "0 as dnumcites5").write.parquet(f"{folder}/pcite.parquet")
    texts = [(9, 1, "late"), (4, 1, "of\n spins <b>x"), (2, 1, " "), (5, 3, "unasked"), (6, None, "none")]
    spark.createDataFrame(texts, "doc_id bigint, paperid bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["id"]: r for r in serving_queries.data_for_ids(spark, folder).collect()}
    assert json.loads(got[1]["meta"])["insp"] == 1048 and "insp" not in json.loads(got[2]["meta"])
    assert [got[k]["abst"] for k in (1, 2, 3)] == ["of spins", "(no abstract)", None]


def test_notes_and_graphs(spark):
    old = spark.createDataFrame([("u", 1, "a"), ("u", 2, "b"), ("u", 3, "c")], "user string, id bigint, notes string")
    diff = spark.createDataFrame([("u", 1, None, None, 1), ("u", 2, None, True, 2), ("u", 3, "C", False, 3), ("u", 4, "d", False, 4), ("v", 1, "x", True, 5), ("u", 2, None, False, 6)], "user string, id bigint, notes string, rm boolean, seq int")
    assert rows_of(U.merge_notes(old, diff)) == [(1, "a", "u"), (2, None, "u"), (3, "C", "u"), (4, "d", "u")]
    assert rows_of(U.merge_notes(old, diff.limit(0))) == rows_of(old)
    g = "user string, name string, ind int"
    graphs = spark.createDataFrame([("u", "g", 1), ("u", "h", 2)], g)
    gdiff = spark.createDataFrame([("u", "g", None, False, 1), ("u", "h", None, True, 2)], g + ", rm boolean, seq int")
    d = "user string, name string, id bigint, x int, r int"
    drawn = spark.createDataFrame([("u", "g", 1, 5, 6), ("u", "h", 1, 5, 6)], d)
    ddiff = spark.createDataFrame([("u", "g", 1, None, 9, False, 1), ("u", "g", 2, 3, 3, False, 2)], d + ", rm boolean, seq int")
    a, b = U.merge_graphs(graphs, gdiff, drawn, ddiff)
    assert rows_of(a) == [(1, "g", "u")] and rows_of(b) == [(1, "g", 9, "u", 5), (2, "g", 3, "u", 3)]


def test_tags_settings_hash(spark):
    t = "user string, name string, ind int, blob boolean, halo boolean"
    old = spark.createDataFrame([("u", "t", 1, True, False)], t)
    diff = spark.createDataFrame([("u", "t", None, None, True, False, 1)], t + ", rm boolean, seq int")
    i = "user string, name string, id bigint"
    ids = spark.createDataFrame([("u", "t", 1), ("u", "t", 2), ("u", "t", 2), ("u", "t", 2)], i)
    more = spark.createDataFrame([("u", "t", 1), ("u", "t", 3)], i)
    tags, left = U.merge_tags(old, diff, ids, more)
    assert rows_of(tags) == [(True, True, 1, "t", "u")] and rows_of(left) == [(2, "t", "u"), (3, "t", "u")]
    assert spark.range(1).select(U.toggled_array(F.array(F.lit(1), F.lit(2), F.lit(2), F.lit(2)), F.array(F.lit(1), F.lit(3)))).first()[0] == [2, 3]
    s = "user string, pvo int, nda int"
    assert rows_of(U.merge_settings(spark.createDataFrame([("u", 1, 2)], s), spark.createDataFrame([("u", None, 5), ("v", 7, None)], s))) == [(5, 1, "u"), (None, 7, "v")]
    was, new = (spark.createDataFrame([("u", v)], "user string, state string") for v in ("old", "new"))
    for sent, want in (("c2a6b03f190dfb2b4aa91f8af8d477a9bc3401dc", "new"), ("no", "old")):
        assert rows_of(U.accepted(was, new, spark.createDataFrame([("u", sent)], "user string, hash string"))) == [(want, "u")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "layout.json").write_text("[[1,2,-3,4],[5,6,7,8],[9]]")
    assert rows_of(J.read_layout(spark, str(tmp_path / "layout.json"))) == [(1, 4, 2, -3), (5, 8, 6, 7)]
    J.write_layout(spark.createDataFrame([(1, 2, -3, 4)], POS), str(tmp_path / "out"))
    assert rows_of(J.read_layout_lines(spark, str(tmp_path / "out"))) == [(1, 4, 2, -3)]
    (tmp_path / "refs.json").write_text('[{"id":1,"allcats":"a,b","refs":[[2,3],[4]]},{"id":2,"refs":[]}]')
    papers, refs = J.read_references(spark, str(tmp_path / "refs.json"))
    assert rows_of(papers) == [("a,b", 1), (None, 2)] and rows_of(refs) == [(2, 3, 1), (4, 1, 1)]
    (tmp_path / "other.json").write_text('[{"id":1,"refs":[[2,0.5],[9,1]]}]')
    assert rows_of(J.merge_other_links(refs, J.read_other_links(spark, str(tmp_path / "other.json")))) == [(2, 3, 1, 0.5), (4, 1, 1, 0.0), (9, 0, 1, 1.0)]
    (tmp_path / "cats.json").write_text('{"default_col":[1,0,0],"cats":[{"cat":"a","col":[0,1,0],"display":"A"},{"cat":"b","col":[0]}]}')
    assert rows_of(J.read_categories(spark, str(tmp_path / "cats.json"))) == [("a", [0.0, 1.0, 0.0], [0.55, 0.48], "A"), ("b", [1.0, 0.0, 0.0], [0.55, 0.48], "")]
    (tmp_path / "regions.json").write_text('[{"X":1,"Y":2,"Radius":3,"Label":"r"}]')
    assert rows_of(J.read_regions(spark, str(tmp_path / "regions.json"))) == [("r", 3, 1, 2)]
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text("<x><abstract> so\n much </abstract></x>")
    assert J.read_abstracts(spark, str(tmp_path / "xml")).first()["abstract"] == "so much"
    J.write_layout_links(spark.createDataFrame([(1, 3, 0.5), (1, 2, 1.0), (1, 4, 0.0), (1, 5, 1234567.0), (1, 6, 0.0000123), (1, 7, 100.0), (1, 8, 3.25)], "src bigint, dst bigint, weight double"), str(tmp_path / "links"))
    assert spark.read.text(str(tmp_path / "links")).first()[0] == "[1,[[2,1],[3,0.5],[4,0],[5,1.23457e+06],[6,1.23e-05],[7,100],[8,3.25]]]"


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"nbody":{"mass_cites_exponent":1,"forces":{"link_strength":2}},"tiles":{"max_tile_division":64},"sql":{"meta_table":{"name":"m","field_id":"Id","field_auxint1":"","where_clause":"x"}}}')
    s = load_settings(p)
    assert s.forces.link_strength == 2.0 and s.mass_exponent == 1.0 and s.max_tile_division == 64 and s.where == "x" and s.tables["meta"].columns == {"id": "id", "auxint1": ""}
    assert Forces().adjusted(link_strength=2.0).link_strength == 2.34


def test_binding(spark, tmp_path):
    from orrery.config import Binding

    spark.range(2).withColumnRenamed("id", "paper").write.parquet(str(tmp_path / "m_x.parquet"))
    assert Binding("m", {"id": "paper", "aux": ""}).read(spark, str(tmp_path), "x").columns == ["id"]
