from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators.packed import AUTHORS, CATEGORIES, COMMAS, unpack_rows, unpacked
from tests.conftest import rows_of


def values(spark, text, packing):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return [r["val"] for r in unpack_rows(df, ["id"], "t", packing).orderBy("slot").collect()]


def test_authors(spark):
    cases = {
        "A. One,B. Two": ["A. One", "B. Two"],
        "A. One, B. Two and C. Three": ["A. One", "B. Two", "C. Three"],
        "A. One, B. Two, & C. Three": ["A. One", "B. Two", "C. Three"],
        "One, A.; Two, B.;": ["One, A.", "Two, B."],
        "One, A. | Two, B.": ["One, A.", "Two, B."],
        '"One, A.","Two, B. C."': ["One, A.", "Two, B. C."],
        'A. One , "Bo ""Bob"" Two" , C. Three': ["A. One", 'Bo "Bob" Two', "C. Three"],
        'Al "Ali" One, B. Two': ['Al "Ali" One', "B. Two"],
        "A. One,,B. Two,, ": ["A. One", "B. Two"],
        "A. One\nB. Two\tC. Three / D. Four": ["A. One", "B. Two", "C. Three", "D. Four"],
        "Andy Band and Sandy Land": ["Andy Band", "Sandy Land"],
        "[One, A.], B. Two": ["[One, A.]", "B. Two"],
        " , ;": [],
        "": [],
        '"': ['"'],
        '"open, B. Two': ['"open', "B. Two"],
    }
    for text, want in cases.items():
        assert values(spark, text, AUTHORS) == want, text


def test_categories(spark):
    for text, want in {
        "a-b.C, d;e|f/g h\ti": ["a-b.C", "d", "e", "f", "g", "h", "i"],
        "'a'; 'b'": ["a", "b"],
        ' a , "b" , c': ["a", "b", "c"],
        '"a","a"': ["a", "a"],
        "a;": ["a"],
        " ": [],
    }.items():
        assert values(spark, text, CATEGORIES) == want, text


def test_flags_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, '"x, y', 5), (2, None, 6), (3, "a,b", None)], "id int, authors string, slot2 int")
    out = unpack_rows(df, ["id", "slot2"], "authors", AUTHORS)
    assert [tuple(r) for r in out.orderBy("id", "slot").collect()] == [
        (1, 5, "authors", 1, '"x', True), (1, 5, "authors", 2, "y", False), (3, None, "authors", 1, "a", False), (3, None, "authors", 2, "b", False),
    ]
    assert unpack_rows(df.limit(0), ["id"], "authors", AUTHORS).count() == 0


def test_long_text(spark):
    n = 20_000
    text = ",".join(f'"x ""{k}"", y"' for k in range(n))
    df = spark.createDataFrame([(text,)], "t string").select(unpacked(F.col("t"), AUTHORS).alias("u"))
    got = df.select(F.size("u"), F.col("u")[n - 1]["val"]).first()
    assert tuple(got) == (n, f'x "{n - 1}", y')
    assert len(values(spark, '"' + 'a""' * 50_000, AUTHORS)) == 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet='ab ",;', min_size=0, max_size=6), max_size=4))
def test_round_trip(spark, items):
    """Quoted values come back as they went in, but for outer blanks and empty ones."""
    text = ",".join('"' + i.replace('"', '""') + '"' for i in items)
    assert values(spark, text, COMMAS) == [i.strip() for i in items if i.strip()]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a,b"), (1, "a,b")], "id int, t string")
    assert len(rows_of(unpack_rows(df, ["id"], "t", COMMAS))) == 4


def test_any_character(spark):
    """Characters that part the values while a field is cut may stand in them."""
    for text in ("a\x01b, c\x02", "\x02" + "1, \x01and b", '"x\x01, y", \x02' + "2"):
        want = [v.strip().strip('"') for v in (text.split(", ") if '"' not in text else ["x\x01, y", "\x022"])]
        assert values(spark, text, AUTHORS) == want, repr(text)


def test_error_flags(spark):
    df = spark.createDataFrame([("[One, A.], [B. Two; 'x'y",), ("'a, [b] c, [d]",)], "t string")
    got = [[(v["val"], v["err"]) for v in r[0]] for r in df.select(unpacked(F.col("t"), AUTHORS)).collect()]
    assert got == [[("[One, A.], [B. Two", True), ("'x'y", True)], [("'a", True), ("[b] c", True), ("[d]", False)]]
