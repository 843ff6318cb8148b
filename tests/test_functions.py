import math

import pytest
from pyspark.sql import functions as F

from glossmill.functions import scalars, text, urls
from glossmill.functions.boolean_query import highlight, text_match
from glossmill.functions.stemming import stem_word
from glossmill.sources.delimited import split_fields


def one(spark, *columns, **values):
    """The values of columns over one row of named values."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return tuple(row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


TEXT = "A red fox-trot band plays \"late night\" music and more e-commerce songs for a quiet crowd"
CASES = [
    ("red band", 1, 1), ('"red fox"', 1, 1), ('"red band"', 0, 0), ("re", 0, 1), ("red AND crow", 0, 1), ("red AND crowd", 1, 1),
    ("crow OR band", 1, 1), ("crow OR bands", 0, 1), ("NOT red", 0, 0), ("NOT blue", 1, 1), ("NOT blue red", 1, 1), ("NOT (blue OR red)", 0, 0),
    ("(NOT red OR fox) AND band", 1, 1), ("(NOT red OR foxy) AND band", 0, 0), ("red AND blue OR fox", 1, 1), ("e_commerce", 1, 1), ("e-commerce", 1, 1),
    ("mus*", 1, 1), ('"quiet cr*"', 1, 1), ("(red", 0, 0), ("red)", 0, 0), ("", 1, 1), ("RED AND (fox AND (band AND NOT (blue)))", 1, 1), ("AND", 0, 0),
]


def test_boolean_queries(spark):
    row = spark.createDataFrame([(TEXT,)], "t string")
    got = row.select(*(text_match(F.col("t"), q, fuzzy).alias(f"q{i}_{int(fuzzy)}") for i, (q, _, _) in enumerate(CASES) for fuzzy in (False, True))).first()
    assert list(got) == [bool(x) for _, a, b in CASES for x in (a, b)]
    rows = spark.createDataFrame([(None,), ("",), ("x",), ("Fox",)], "t string")
    assert [r[0] for r in rows.select(text_match(F.col("t"), "fox"), "t").collect()] == [False, False, False, True]
    assert row.select(text_match(F.col("t"), "RED", case_sensitive=True)).first()[0] is False
    assert one(spark, highlight(F.lit("A fox and foxes"), "fox OR fox*"))[0] == "A <b>fox</b> and <b>foxes</b>"


def test_text_functions(spark):
    t = F.lit("In time,  é {x} 3rd-rate Birds don't")
    tokens, words, digest = one(spark, text.tokens(t), text.content_words(t), text.content_digest(F.lit("abc")))
    assert tokens == ["In", " ", "time", ",", " ", "x", " ", "3rd", "-", "rate", " ", "Birds", " ", "don", "'", "t"]
    assert words == ["time", "rate", "birds", "don"]
    assert digest == "kAFQmDzST7DWlj99KOF/cg"
    assert one(spark, text.trim_field(F.lit("abcdefghijklmn")), text.trim_field(F.lit("short"))) == ("abcdefghi....4 chars...", "short")
    assert one(spark, text.expand_short_form(F.lit("isn't")), text.expand_short_form(F.lit("ain't")), text.expand_short_form(F.lit("cat"))) == (["is", "not"], ["are", "not"], ["cat"])
    assert one(spark, text.distinct_terms(F.lit('big "red fox" big cat')), text.path_words(F.lit("C:/my_files/.x/2005_report.final.txt"))) == (["big", "red fox", "cat"], "my files 2005 report")
    assert one(spark, text.media_kind(F.lit("a/B.JPG")), text.media_kind(F.lit("x.zip"))) == ("image", None)
    assert one(spark, text.question_words(F.lit("Who knows when or where? who")), text.question_kind(F.lit("Where is it"))) == (["who", "when", "where"], "place")
    assert one(spark, text.tokens(F.lit(None).cast("string")), text.content_words(F.lit("")))[1] == []


def test_scalars(spark):
    assert one(spark, scalars.log2_or_zero(F.lit(0.0)), scalars.log10_or_zero(F.lit(1000.0))) == (0.0, pytest.approx(3))
    assert one(spark, scalars.factorial(F.lit(25)), scalars.combinations(F.lit(10), F.lit(3)), scalars.combinations(F.lit(3), F.lit(0)), scalars.combinations(F.lit(3), F.lit(5))) == (pytest.approx(math.factorial(25)), 120.0, 1.0, 0.0)
    assert one(spark, scalars.hex_of(F.lit(255)), scalars.url_encode(F.lit("a b~*é")), scalars.url_decode(F.lit("a%20b+%7e"))) == ("ff", "a%20b%7e*%c3%a9", "a b+~")
    at = F.lit("2024-02-02 13:05:09").cast("timestamp")
    assert one(spark, scalars.ordinal_date(at, True, True, True), scalars.days_in_month(at), scalars.days_in_year(F.lit(1900))) == ("Friday, February 2nd, 2024 13:05:09 GMT", 29, 365)
    dates = ["Tue, 4 Mar 2003 10:20:30 +0000", "March 4, 03 12:05 AM", "March 4, 73 1:05 pm", "4 Foo 2003 10:20:30", "soon", None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string").select("i", scalars.mail_date(F.col("d")).cast("string").alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["2003-03-04 10:20:30", "2003-03-04 00:05:00", "1973-03-04 13:05:00", None, None, None]
    steps = [one(spark, scalars.colour_step(F.lit(v), F.lit(0.0), F.lit(1.0), 4))[0] for v in (-1.0, 0.0, 0.5, 1.0, 2.0)]
    assert steps == [0, 0, 1, 3, 3]
    v = F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.0))
    w = F.create_map(F.lit("a"), F.lit(3.0))
    encoded, back, sim = one(spark, scalars.encode_vector(v), scalars.decode_vector(scalars.encode_vector(v)), scalars.cosine(v, w))
    assert encoded == "a###1.0_!_b###2.0" and back == {"a": 1.0, "b": 2.0} and sim == pytest.approx(1 / math.sqrt(5))
    assert one(spark, scalars.likelihood_ratio(F.lit(10), F.lit(5), F.lit(6), F.lit(100)), scalars.likelihood_ratio(F.lit(10), F.lit(10), F.lit(1), F.lit(100)))[0] == 0.0


def test_likelihood_ratio_against_definition(spark):
    from math import comb, log2

    c1, c2, c12, n = 12, 9, 5, 80
    def like(k, m, p):
        return comb(m, k) * p**k * (1 - p) ** (m - k)

    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    expected = -2 * log2(like(c12, c1, p) * like(c2 - c12, n - c1, p) / (like(c12, c1, p1) * like(c2 - c12, n - c1, p2)))
    assert one(spark, scalars.likelihood_ratio(F.lit(c1), F.lit(c2), F.lit(c12), F.lit(n)))[0] == pytest.approx(expected)


def test_urls(spark):
    page = F.lit("http://a.org/x/y/page.html")
    links = ["z.html", "/top.html", "../up.html", "./here", "http://b.org/q", "#part", "../../../far"]
    got = one(spark, *(urls.clean_link(F.lit(u), page) for u in links))
    assert got == ("a.org/x/y/z.html", "a.org/top.html", "a.org/x/up.html", "a.org/x/y/here", "b.org/q", "a.org/x/y/page.html", "far")
    assert one(spark, urls.site_of(F.lit("www.a.org:80/x")), urls.base_of(F.lit("http://a.org/x?q=1")), urls.base_of(F.lit("a.org"))) == ("www.a.org", "a.org/", "a.org/")


def test_stems():
    given = "caresses ponies cats feed agreed plastered motoring hopping filing happy relational conditional hopefulness formality adjustment rate controll XY's 12".split()
    stems = dict(zip(given, map(stem_word, given), strict=True))
    assert (stems["caresses"], stems["cats"], stems["plastered"], stems["hopping"], stems["filing"]) == ("caress", "cat", "plaster", "hop", "file")
    assert stems["feed"] == "fe" and stems["agreed"] == "agre" and stems["happy"] == "happy" and stems["XY's"] == "xy" and stem_word(None) is None


def test_delimited_lines(spark):
    got = one(spark, *(split_fields(F.lit(x)) for x in ("a:b!:c:d!!:", "x", "a::b:")))
    assert got == (["a", "b:c", "d!"], ["x"], ["a", "", "b"])
