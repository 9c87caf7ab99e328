"""The mini project: occurrences, statistics, packing, sources; and the registered queries against their SQL."""

import hashlib
import html
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import catalog, fulltext
from quire.operators.packing import pack
from quire.plans import registry
from quire.sources import project

A = "<html><head><title>Alpha &amp; Co</title></head><body>Don't use the v1.2 or 3.14\n<img src=\"img/x.png\"> <a href=\"sub/b.htm#s\">see</a></body></html>"
B = "<html><title>Beta</title><body>the beta file"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mini(spark):
    return spark.createDataFrame([(0, "a.htm", A), (1, "sub/b.htm", B)], "page_id bigint, url string, html string")


def test_occurrences(mini):
    got = {(r["page_id"], r["is_title"], r["word"], r["pos"]) for r in fulltext.occurrences(mini).collect()}
    assert got == {(0, True, "alpha", 0), (0, True, "co", 1), (0, False, "dont", 2), (0, False, "use", 3), (0, False, "v1", 4), (0, False, "2", 5), (0, False, "3.14", 6), (0, False, "see", 7), (1, True, "beta", 0), (1, False, "beta", 1), (1, False, "beta", 2), (1, False, "file", 3)}


def test_statistics(mini):
    occ = fulltext.occurrences(mini)
    assert fulltext.corpus_stats(occ).first().asDict() == {"total_words": 12, "total_length": 40, "entry_length": 36, "longest_word": 5, "distinct_words": 10, "pages": 2}
    order = [(r["word"], r["is_title"]) for r in fulltext.vocabulary(occ).orderBy("rank").collect()]
    assert order == [("2", False), ("3.14", False), ("alpha", True), ("beta", True), ("beta", False), ("co", True), ("dont", False), ("file", False), ("see", False), ("use", False), ("v1", False)]
    assert {r["tf"] for r in fulltext.term_stats(occ).where("word = 'beta' and not is_title").collect()} == {2}


def test_front_coding_round_trip(mini):
    rows = fulltext.front_coded(fulltext.occurrences(mini)).orderBy("word", F.col("is_title").desc()).collect()
    last = ""
    for r in rows:
        last = last[: r["prefix_len"]] + r["suffix"]
        assert last == r["word"]


def test_payload_round_trip(spark, mini):
    """The lists decode to the positions that went in."""
    occ = fulltext.occurrences(mini)
    want = {(r["word"], r["is_title"], r["page_id"]): r["positions"] for r in fulltext.postings(occ).collect()}
    got = {}
    whole = fulltext.wlc_payload(occ).groupBy("word", "is_title").agg(F.sort_array(F.collect_list(F.struct("page_id", "payload")))["payload"].alias("payload"))
    for r in whole.collect():
        bits = "".join(f"{b:08b}" for b in b"".join(r["payload"]))
        at, doc = 0, 0

        def number(root, at):
            prefix = bits.index("0", at) - at
            at += prefix + 1
            width = root if prefix == 0 else root + prefix - 1
            low = int(bits[at : at + width] or "0", 2)
            return (low if prefix == 0 else (1 << width) | low), at + width

        while at < len(bits):
            d, at = number(1, at)
            doc += d
            n, at = number(1, at)
            place, places = 0, []
            for _ in range(n):
                step, at = number(6, at)
                place += step
                places.append(place)
            got[(r["word"], r["is_title"], doc)] = places
            at = -(-at // 8) * 8
    assert got == want


def brute(sizes, page, first=0):
    out, p, at = [], 0, first
    for n in sizes:
        if at + n > page:
            p, at = p + 1, 0
        out.append((p, at))
        at += n
        p, at = p + max(at - 1, 0) // page, at - max(at - 1, 0) // page * page
    return out


@pytest.mark.parametrize("sizes", [[1500, 1600, 1700, 1800, 1900, 2000], [4096, 1, 4096], [10, 9000, 5, 4097, 4096, 20_000, 3] * 5, [random.Random(5).randint(1, 900) for _ in range(700)]])
def test_packing(spark, sizes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i bigint, size bigint")
    got = [(r["page"], r["pos"]) for r in pack(df, [F.col("i")], "size").orderBy("i").collect()]
    assert got == brute(sizes, 4096)


def test_pages_at_once():
    """Where entries fill pages one after the other, ends are found page by page; the same as entry by entry."""
    from quire.operators import packing

    rng = np.random.default_rng(1)
    for page, header, spans, most in ((4096, 0, True, 60), (1000, 12, True, 900), (2048, 12, False, 5000), (2048, 8, False, 300)):
        for n in (1, 2, 700):
            size = rng.integers(1, most, n)
            need = size + (header > 0)
            assert packing._page_starts(size, size, need, page, header, spans)
            got = packing._ends(size, size, need, page, header, spans)
            for begin in {header, header + 1, page // 2, page - 1, page}:
                turned, at = 0, begin
                for s, k in zip(size.tolist(), need.tolist(), strict=True):
                    if at > header and at + k > page:
                        turned, at = turned + 1, header
                    at += s
                assert (got[0][begin], got[1][begin]) == (turned, at if spans else min(at, page)), (page, n, begin)
    many = rng.integers(1, 40, 400_000)
    began = time.process_time()
    packing._ends(many, many, many, 4096, 0)
    assert time.process_time() - began < 2


def test_packing_with_headers(spark):
    """Pages begin behind a header, a row that begins one is larger, and rows need more room than they take."""
    rng = random.Random(3)
    rows = [(i, n, n + rng.randint(0, 40), n + rng.randint(0, 60)) for i, n in enumerate(rng.randint(20, 160) for _ in range(900))]
    want, page, at = [], 2, 12
    for _, size, first, need in rows:
        if at > 12 and at + need > 1000:
            page, at = page + 1, 12
        want.append((page, at))
        at += first if at == 12 else size
    df = spark.createDataFrame(rows, "i bigint, size bigint, first bigint, need bigint")
    got = pack(df, [F.col("i")], "size", 1000, 12, 2, 12, F.col("first"), F.col("need")).orderBy("i").collect()
    assert [(r["page"], r["pos"]) for r in got] == want


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    key = lambda row: tuple(map(repr, row))
    rows = sorted(map(tuple, got.select(*columns).collect()), key=key)
    assert rows == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)
    return rows


@pytest.mark.parametrize("name", ["keyword_blocks", "keyword_block_table"])
def test_keywords_longer_than_a_block(spark, tmp_path, name):
    """A keyword of 1,200 topics is one block, and the next keyword begins another."""
    link = lambda i: f'<a href="/{i}">{i}</a>'
    html = "<nav>" + "".join(map(link, ["long", *range(3)])) + "</nav>"
    spark.range(1200).selectExpr("id as page_id", "concat('http://a.example/', id) as url", f"'{html}' as html").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(same_as_sql(spark, name, str(tmp_path))) == 4


@pytest.mark.parametrize("n", [0, 3, 20_000])
def test_keyword_tree(spark, n):
    """Against the same levels made in memory; 20,000 keywords make three levels of blocks."""
    lists = spark.range(n).select(F.concat(F.lit("keyword "), F.lpad(F.col("id").cast("string"), 8, "0")).alias("keyword"), F.lit(0).alias("place"), F.lit(1).alias("topic_idx"))
    blocks = catalog.keyword_blocks(lists)
    first = {r["page"]: r["k"] for r in blocks.groupBy("page").agg(F.min("keyword").alias("k")).collect()}
    want, level, used = [], sorted(first.items()), len(first)
    depth = 0
    while len(level) > 1:
        depth, above, at = depth + 1, [], 8
        for child, keyword in level[1:]:
            size = 2 * len(keyword) + 22 + 4
            if not above or at > 8 and at + size >= 2048:
                above.append((used + len(above), keyword))
                at = 8
            want.append((depth, above[-1][0], at, keyword, child))
            at += size
        used, level = used + len(above), above
    got = sorted(tuple(r) for r in catalog.keyword_tree(blocks).collect())
    assert got == want and depth == {0: 0, 3: 0, 20_000: 2}[n]


def tree_in_memory(blocks):
    """Levels above listing blocks (page, rank, keyword, n_topics), one after the other."""
    first = {}
    for page, _, keyword, n in sorted(blocks):
        first.setdefault(page, (keyword, n))
    want, level, used, depth = [], [(p, *kn) for p, kn in sorted(first.items())], len(first), 0
    while len(level) > 1:
        depth, above, at = depth + 1, [], 8
        for child, keyword, n in level[1:]:
            size = 2 * len(keyword) + 22 + 4 * n
            if not above or at + size >= 2048:
                above.append((used + len(above), keyword, n))
                at = 8
            want.append((depth, above[-1][0], at, keyword, child))
            at += size
        used, level = used + len(above), above
    return sorted(want), depth


@pytest.mark.parametrize("few", [3, 12, 10_000])
@pytest.mark.parametrize("sizes", ["long", "half", "mixed"])
def test_high_keyword_tree(spark, sizes, few):
    """Entries that share no block make a tree as high as they are many; those of mixed sizes are joined level by level."""
    rng = random.Random(7)
    topics = {"long": [600] * 30, "half": [300] * 30, "mixed": [rng.choice((1, 200, 300, 480, 700)) for _ in range(40)]}[sizes]
    rows = [(f"keyword {i:03}", n, i, i, 12, 0) for i, n in enumerate(topics)]
    blocks = spark.createDataFrame(rows, "keyword string, n_topics bigint, rank bigint, page bigint, pos bigint, bytes bigint")
    want, depth = tree_in_memory([(page, rank, k, n) for k, n, rank, page, _, _ in rows])
    spark.sparkContext.setJobGroup(f"tree {sizes} {few}", "")
    got = sorted(tuple(r) for r in catalog.keyword_tree(blocks, few).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tree {sizes} {few}"))
    assert got == want
    assert few < len(topics) or jobs < depth * 5


def test_content_blocks(spark, mini):
    many = spark.range(40).crossJoin(mini.select("html")).select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.repeat("html", 50), F.col("id").cast("string")).alias("html"))
    whole = b"".join(r["html"].encode() for r in many.orderBy("page_id").collect())
    got = {r["block_id"]: (r["uncompressed"], r["crc"]) for r in catalog.content_blocks(many).collect()}
    cut = [whole[i : i + 65536] for i in range(0, len(whole), 65536)]
    assert got == {i: (len(c), zlib.crc32(c)) for i, c in enumerate(cut)}


def test_topics(spark, mini):
    toc = spark.createDataFrame([(0, 1, "B", "sub/b.htm"), (1, 1, "Sec", "sub/b.htm#s"), (2, 1, "C", "c.htm"), (3, 2, "A", "A.HTM")], "ord bigint, depth int, title string, url string")
    got = [(r["topic_idx"], r["url"], r["flags"]) for r in catalog.topics(mini, toc).orderBy("topic_idx").collect()]
    assert got == [(0, "a.htm", 6), (1, "sub/b.htm", 6), (2, "c.htm", 6), (3, "sub/b.htm#s", 4)]


def test_project_file(spark):
    value = "[OPTIONS]\r\n; note\nTitle=One\ntitle=Two\nLanguage=0x409 English\n[FILES]\na.htm\nsub\\b.htm\n[WINDOWS]\nmain=\"t\",\"x,y\",[1,2,3,4],,0x10\n[OTHER]\nz=1"
    rows = project.lines(spark.createDataFrame([("p", value)], "path string, value string"))
    assert {r["key"]: r["value"] for r in project.options(rows).collect()} == {"title": "Two", "language": "0x409 English"}
    assert [r["canon"] for r in project.manifest(rows).orderBy("seq").collect()] == ["/a.htm", "/sub/b.htm"]
    assert project.windows(rows).first()["fields"] == ["t", "x", "y", "[1,2,3,4]", None, "0x10"]
    codes = spark.createDataFrame([("0x409 English",), ("0x40C",), ("1031",)], "v string").select(project.language(F.col("v")).alias("x"))
    assert [r["x"] for r in codes.collect()] == [0x409, 0x40C, 1031]


def test_contents_file(spark):
    value = '<UL><LI><OBJECT type="text/sitemap"><param name="Name" value="Top"><param name="Local" value="a.htm"></OBJECT><UL class=x><UL><OBJECT type="text/sitemap"><param name="Name" value="B &amp; b"><param name="Local" value="b.htm"></OBJECT><OBJECT><param name="Name" value="none"></OBJECT></UL></UL>'
    rows = project.contents_entries(spark.createDataFrame([("t", value)], "path string, value string")).orderBy("ord").collect()
    assert [(r["ord"], r["depth"], r["title"], r["url"]) for r in rows] == [(0, 1, "Top", "a.htm"), (1, 2, "B &amp; b", "b.htm")]


def test_keyword_file(spark):
    item = lambda n, x: f'<li><object type="text/sitemap"><param name="Name" value="{n}"><param name="Local" value="{x}"></object>'
    value = "<ul>" + item("Zebra", "a.htm") + item("Parent", "a.htm") + "<ul>" + item("Child &amp; x", "c.htm") + "</ul>" + item("", "d.htm") + "</ul>"
    rows = project.keyword_rows(spark.createDataFrame([("k", value)], "path string, value string"))
    assert sorted((r["keyword"], r["local"]) for r in rows.collect()) == [("Parent, Child & x", "c.htm"), ("Zebra", "a.htm")]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key)


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(DATA)
    assert __spark_entry__.entry(spark).count() > 0


def test_all_entities_are_decoded(spark):
    """Also numeric ones, names beyond the closed set and those without a semicolon."""
    page = spark.createDataFrame([(0, "a", "<title>caf&eacute; &#233;t&#xe9;</title><body>x&ndash;y R&amp D &lt;b&gt; &quot;q&quot;</body>")], "page_id bigint, url string, html string")
    got = [(r["is_title"], r["word"]) for r in fulltext.occurrences(page).orderBy("pos").collect()]
    assert got == [(True, "café"), (True, "été"), (False, "x"), (False, "y"), (False, "r"), (False, "d"), (False, "b"), (False, "q")]


def decoding_all(sql):
    """The SQL of a query with html.unescape where it has the seven replacements."""
    for section in ("t", "b"):
        seven = registry._strip(section)
        bare = seven.removeprefix("replace(" * len(text.ENTITIES)).partition(f", '{text.ENTITIES[0][0]}'")[0]
        sql = sql.replace(seven, f"decode_all({bare})")
    return sql


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Pages whose entities are cut off, numeric, beyond the seven, or encoded twice; their words fill several leaves."""
    folder = str(tmp_path_factory.mktemp("odd"))
    odd = ["caf&eacute; &#233;t&#xe9; &amp", "R&amp D &AMP; &ampx &am", "&amp;eacute; &amp;amp; &amp;amp", "x&ndash;y &notit; &#0; &#xD800; &nosuch;", "&lt;b&gt; &quot;q&quot; &middot;&nbsp;&copy;", "plain"]
    words = lambda i: " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(60))
    rows = [(i, f"/{i}", f"<title>{x}</title><body>{x} from an hand {words(i)} {x}") for i, x in enumerate(odd)]
    spark.createDataFrame([*rows, (len(odd), None, None)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(n for n, sql in registry.oracle_sql().items() if registry._strip("b") in sql))
def test_full_text_queries_decode_all_entities(spark, odd_pages, name):
    """Each full-text query gives the rows of its SQL with all entities decoded, which on these pages are not those with seven."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{odd_pages}/pages.parquet/*.parquet'")
    con.create_function("decode_all", html.unescape, ["VARCHAR"], "VARCHAR")
    got = registry.queries()[name](spark, odd_pages)
    columns = sorted(got.columns)
    rows = lambda sql: sorted(con.sql(sql).select(*[f'"{c}"' for c in columns]).fetchall(), key=repr)
    sql = registry.oracle_sql()[name]
    want = rows(decoding_all(sql))
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == want
    assert want != rows(sql)
