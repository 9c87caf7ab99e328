"""Scalar vectors, worked out by hand."""

import html

import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [("index.html", 855210151), ("dir/page.htm", 2464453013), ("0", 1), ("", 1)])
def test_url_hash(spark, url, want):
    assert one(spark, codecs.url_hash(F.col("u")), u=url) == want


@pytest.mark.parametrize(("n", "little", "big"), [(0, "00", "00"), (1, "01", "01"), (127, "7f", "7f"), (128, "8001", "8100"), (300, "ac02", "822c"), (16384, "808001", "818000")])
def test_varints(spark, n, little, big):
    row = spark.createDataFrame([(n,)], "n bigint").select(codecs.leb128_hex(F.col("n")), codecs.encint_hex(F.col("n"))).first()
    assert tuple(row) == (little, big)


def test_negative_varint_is_an_error(spark):
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "n bigint").select(codecs.encint_hex(F.col("n"))).collect()


@pytest.mark.parametrize(("n", "root", "want"), [(0, 1, "00"), (1, 1, "01"), (2, 1, "100"), (3, 1, "101"), (4, 1, "11000"), (5, 1, "11001"), (8, 1, "1110000"), (0, 6, "0000000"), (1, 6, "0000001"), (63, 6, "0111111"), (64, 6, "10000000"), (65, 6, "10000001"), (128, 6, "1100000000")])
def test_scale_root(spark, n, root, want):
    row = spark.createDataFrame([(n,)], "n bigint").select(codecs.scale_root_bits(F.col("n"), root), codecs.scale_root_size(F.col("n"), root)).first()
    assert tuple(row) == (want, len(want))


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abd", 2), ("abc", "abc", 3), ("ab", "abc", 2), ("x", "y", 0), ("", "y", 0)])
def test_common_prefix(spark, a, b, want):
    assert one(spark, codecs.common_prefix(F.col("a"), F.col("b")), a=a, b=b) == want


def test_words(spark):
    got = one(spark, text.words(F.col("t")), t="It's 3.14 v1.2 1a.5 don't a'_b _x 'q' 1.2.3. été")
    assert got == ["its", "3.14", "v1", "2", "1a.5", "dont", "a", "_b", "_x", "q", "1.2.3", "été"]


@pytest.mark.parametrize("long", ["w" * 200_000, "1.2" * 50_000, "b'c" * 50_000])
def test_very_long_words(spark, long):
    assert one(spark, text.words(F.col("t")), t=long + " end") == ["end"]


def test_unescape_all_entities(spark):
    values = ["a &amp; b", "&amp;lt;", "&eacute;t&#233; &copy", "none", "&notit; &middot;", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["v"] for r in df.select("i", text.unescape_exactly(F.col("v")).alias("v")).orderBy("i").collect()]
    assert got == [None if v is None else html.unescape(v) for v in values]


def test_directories(spark):
    assert one(spark, text.directories(F.col("p")), p="/a/b/c.htm") == ["/a/", "/a/b/"]
    assert one(spark, text.directories(F.col("p")), p="/t.htm") == []


def test_collation(spark):
    want = ["a b", ".apple", "apple", "Apple", "APPLE", "_b", "(paren", "Parent, Child", "Zebra", "éa"]
    df = spark.createDataFrame([(w,) for w in reversed(want)], "w string")
    assert [r["w"] for r in df.orderBy(text.collation_key(F.col("w"))).collect()] == want


def test_titles_and_sections(spark):
    page = "<html><TITLE a=b>Alpha &amp; <b>Co</b>\n x</TITLE><body>Don't <script>x</script>use</body>"
    assert one(spark, text.page_title(F.col("p")), p=page) == "Alpha &amp; Co x"
    assert one(spark, text.words(text.strip_markup(text.body_section(F.col("p")))), p=page) == ["dont", "use"]
    assert one(spark, text.body_section(F.col("p")), p="<title>t</title>x") == "<title>t</title>x"


def test_compound_keyword(spark):
    df = spark.createDataFrame([(["", "A", "", "B"],)], "p array<string>")
    assert df.select(text.compound_keyword(F.col("p")).alias("x")).first()["x"] == "A, , B"
