"""The registered index queries and, beside each, the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import codecs, text
from quire.operators import catalog, fulltext
from quire.sources import project
from quire.staging import Staging


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _html():
    return F.coalesce("html", F.lit(""))


def page_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.page_title(_html()).alias("title"))


def section_presence(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", _html().rlike(text.TITLE).alias("has_title"), _html().rlike(text.BODY).alias("has_body"))


def strip_markup(spark, sf_dir):
    return fulltext.sections(pages(spark, sf_dir)).select("page_id", F.length("body").cast("bigint").alias("text_len"))


def tokens(spark, sf_dir):
    words = fulltext.tagged(F.col("title_words"), F.col("body_words"))
    rows = fulltext.word_lists(pages(spark, sf_dir)).select("page_id", F.explode(words).alias("x"))
    return rows.groupBy("page_id", "x.is_title", "x.word").agg(F.count("*").alias("n"))


def stopword_filter(spark, sf_dir):
    both = F.concat("title_words", "body_words")
    kept = F.size(text.without_stop_words(both)).cast("bigint")
    return fulltext.word_lists(pages(spark, sf_dir)).select("page_id", kept.alias("kept"), (F.size(both) - kept).alias("dropped"))


def _occ(spark, sf_dir):
    return fulltext.occurrences(pages(spark, sf_dir))


def word_positions(spark, sf_dir):
    return _occ(spark, sf_dir)


def term_stats(spark, sf_dir):
    return fulltext.term_stats(_occ(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return fulltext.corpus_stats(_occ(spark, sf_dir))


def posting_deltas(spark, sf_dir):
    return fulltext.posting_deltas(_occ(spark, sf_dir))


def wlc_bits(spark, sf_dir):
    return fulltext.wlc_sizes(_occ(spark, sf_dir))


def wlc_payload(spark, sf_dir):
    return fulltext.wlc_payload(_occ(spark, sf_dir)).select("word", "is_title", "page_id", F.lower(F.hex("payload")).alias("payload"))


def vocab_order(spark, sf_dir):
    return fulltext.vocabulary(_occ(spark, sf_dir))


def front_coding(spark, sf_dir):
    return fulltext.front_coded(_occ(spark, sf_dir))


def url_hash(spark, sf_dir):
    return catalog.url_hashes(pages(spark, sf_dir))


def url_table(spark, sf_dir):
    return catalog.url_table(pages(spark, sf_dir))


def outlinks(spark, sf_dir):
    return catalog.outlinks(pages(spark, sf_dir))


def missing_refs(spark, sf_dir):
    return catalog.missing_refs(pages(spark, sf_dir))


def directories(spark, sf_dir):
    return catalog.directories(pages(spark, sf_dir))


def directory_sort(spark, sf_dir):
    return catalog.directory_entries(pages(spark, sf_dir))


def section_offsets(spark, sf_dir):
    return catalog.section_offsets(pages(spark, sf_dir)).select("page_id", "offset", "length")


def toc_entries(spark, sf_dir):
    return catalog.toc_entries(pages(spark, sf_dir))


def toc_has_children(spark, sf_dir):
    return catalog.toc_children(catalog.toc_entries(pages(spark, sf_dir)))


def toc_bfs(spark, sf_dir):
    return catalog.toc_breadth_first(catalog.toc_entries(pages(spark, sf_dir)))


def toc_offsets(spark, sf_dir):
    return catalog.toc_offsets(catalog.toc_entries(pages(spark, sf_dir)))


def topics_flags(spark, sf_dir):
    p = pages(spark, sf_dir)
    return catalog.topics(p, catalog.toc_entries(p))


def keyword_index(spark, sf_dir):
    p = pages(spark, sf_dir)
    return catalog.keyword_index(p, catalog.toc_entries(p))


def keyword_collation(spark, sf_dir):
    return catalog.keyword_collation(catalog.toc_entries(pages(spark, sf_dir)))


def keyword_resolve(spark, sf_dir):
    p = pages(spark, sf_dir)
    return catalog.keyword_resolve(p, catalog.toc_entries(p))


def strings_heap(spark, sf_dir):
    return catalog.strings_heap(pages(spark, sf_dir))


def leaf_packing(spark, sf_dir):
    return catalog.leaf_packing(_occ(spark, sf_dir))


def separator_keys(spark, sf_dir):
    return catalog.separator_keys(catalog.leaf_packing(_occ(spark, sf_dir)))


def leaf_table(spark, sf_dir):
    return catalog.block_table(catalog.leaf_packing(_occ(spark, sf_dir)), catalog.LEAF, Staging(spark, "leaf-table"))


def leaf_free_space(spark, sf_dir):
    return leaf_table(spark, sf_dir).agg(F.count("*").alias("leaves"), F.sum("free").alias("total_free"))


def leaf_nodes(spark, sf_dir):
    return catalog.leaf_nodes(catalog.leaf_packing(_occ(spark, sf_dir)))


def _keyword_blocks(spark, sf_dir):
    return catalog.keyword_blocks(keyword_lists(spark, sf_dir))


def keyword_lists(spark, sf_dir):
    p = pages(spark, sf_dir)
    return catalog.keyword_lists(p, catalog.toc_entries(p))


def keyword_blocks(spark, sf_dir):
    return _keyword_blocks(spark, sf_dir)


def keyword_block_table(spark, sf_dir):
    return catalog.block_table(_keyword_blocks(spark, sf_dir), catalog.KEYWORD_BLOCK, Staging(spark, "keyword-table"))


def keyword_tree(spark, sf_dir):
    return catalog.keyword_tree(Staging(spark, "tree-input").table(_keyword_blocks(spark, sf_dir), "blocks"))


def topics_table(spark, sf_dir):
    p = pages(spark, sf_dir)
    return catalog.topics_table(p, catalog.toc_entries(p))


def topic_pages(spark, sf_dir):
    """Pages that are topics by their name, with the bare name."""
    paths = catalog.page_paths(pages(spark, sf_dir))
    return paths.where(text.is_topic(F.col("path"))).select("page_id", text.base_name(F.col("path")).alias("name"))


def frame_padding(spark, sf_dir):
    """One row: bytes of all contents, and with zeros up to whole frames of 32 KiB."""
    total = pages(spark, sf_dir).agg(F.coalesce(F.sum(F.octet_length(_html())), F.lit(0)).cast("bigint").alias("total"))
    return total.select("total", (F.ceil(F.col("total") / 32768) * 32768).cast("bigint").alias("padded"))


def varint_len(spark, sf_dir):
    n = F.octet_length(_html()).cast("bigint")
    sized = pages(spark, sf_dir).select(n.alias("value")).distinct()
    return sized.select("value", codecs.leb128_hex(F.col("value")).alias("leb128"), codecs.encint_hex(F.col("value")).alias("encint"))


def content_blocks(spark, sf_dir):
    return catalog.content_blocks(pages(spark, sf_dir))


def term_lookup(spark, sf_dir):
    return fulltext.lookup(_occ(spark, sf_dir), "hand")


def phrase_lookup(spark, sf_dir):
    return fulltext.phrase(_occ(spark, sf_dir), ["from", "an"])


def project_options(spark, sf_dir):
    """A project file's options, read through the same expressions as a file would be."""
    lines = spark.createDataFrame([("p.hhp", "[OPTIONS]\nTitle=Mini\n;x=y\nLanguage=0x409 English\nFull-text search=Yes\n[FILES]\na.htm\nsub\\b.htm")], "path string, value string")
    return project.options(project.lines(lines)).select("key", "value")


NAMES = (
    page_title, section_presence, strip_markup, tokens, stopword_filter, word_positions, term_stats, corpus_stats, posting_deltas, wlc_bits,
    wlc_payload, vocab_order, front_coding, url_hash, url_table, outlinks, missing_refs, directories, directory_sort, section_offsets,
    toc_entries, toc_has_children, toc_bfs, toc_offsets, topics_flags, keyword_index, keyword_collation, keyword_resolve, strings_heap,
    leaf_packing, separator_keys, leaf_table, leaf_free_space, leaf_nodes, keyword_lists, keyword_blocks, keyword_block_table, keyword_tree,
    topics_table, topic_pages, frame_padding, varint_len, content_blocks, term_lookup, phrase_lookup, project_options,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _strip(x: str) -> str:
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    for entity, char in text.ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_L, _W = r"[\p{L}\p{N}]", r"[\p{L}\p{N}_]"
_RX = rf"\p{{Nd}}(?:{_W}|''{_L}|\.\p{{Nd}})*|{_W}(?:{_W}|''{_L})*"


def _words(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({x}), '{_RX}'), lambda w: replace(w, '''', '')), lambda w: length(w) BETWEEN 1 AND 99)"


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_P = "p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages)"
_SECTIONS = f"""{_P},
s0 AS (SELECT page_id, regexp_extract(html, '{text.TITLE}', 1) AS t,
  CASE WHEN regexp_matches(html, '{text.BODY}') THEN regexp_extract(html, '{text.BODY}', 1) ELSE html END AS b FROM p),
s AS (SELECT page_id, {_strip("t")} AS title, {_strip("b")} AS body FROM s0)"""
_LISTS = f"{_SECTIONS},\nl AS (SELECT page_id, {_words('title')} AS tw, {_words('body')} AS bw FROM s)"
_OCC = f"""{_LISTS},
f AS (SELECT page_id, list_filter(tw, lambda w: NOT list_contains({_STOP}, w)) AS tw, list_filter(bw, lambda w: NOT list_contains({_STOP}, w)) AS bw FROM l),
occ AS (
  SELECT page_id, true AS is_title, unnest(tw) AS word, CAST(generate_subscripts(tw, 1) - 1 AS BIGINT) AS pos FROM f
  UNION ALL
  SELECT page_id, false, unnest(bw), CAST(len(tw) + generate_subscripts(bw, 1) - 1 AS BIGINT) FROM f)"""
_SIZE = "greatest(length(ltrim(bin({0}), '0')) - {1}, 0) + 1 + greatest(length(ltrim(bin({0}), '0')) - 1, {1})"
_BIN = "ltrim(bin({0}), '0')"
_CODE = f"(repeat('1', greatest(length({_BIN}) - {{1}}, 0)) || '0' || CASE WHEN length({_BIN}) <= {{1}} THEN lpad({_BIN}, {{1}}, '0') ELSE substr({_BIN}, 2) END)"
_DELTAS = f"""{_OCC},
dd AS (SELECT word, is_title, page_id, page_id - coalesce(lag(page_id) OVER (PARTITION BY word, is_title ORDER BY page_id), 0) AS doc_delta
  FROM (SELECT DISTINCT word, is_title, page_id FROM occ)),
deltas AS (SELECT word, is_title, page_id, pos, doc_delta, pos - coalesce(lag(pos) OVER (PARTITION BY word, is_title, page_id ORDER BY pos), 0) AS pos_delta
  FROM occ JOIN dd USING (word, is_title, page_id))"""
_WLC = f"""WITH {_DELTAS},
g AS (SELECT word, is_title, page_id, any_value(doc_delta) AS d, count(*) AS n, sum({_SIZE.format("pos_delta", 6)}) AS bits FROM deltas GROUP BY ALL)
SELECT word, is_title, CAST(sum(ceil(({_SIZE.format("d", 1)} + {_SIZE.format("n", 1)} + bits) / 8.0)) AS BIGINT) AS wlc_bytes FROM g GROUP BY ALL"""
_URL = "regexp_replace(replace({0}, '\\', '/'), '^/+', '')"
_HASH = f"""{_P},
h0 AS (SELECT page_id, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split({_URL.format("url")}, ''), lambda c: c <> ''),
  lambda c: CASE WHEN c = '/' THEN 44 WHEN unicode(c) > 90 THEN unicode(c) - 80 ELSE unicode(c) - 48 END::BIGINT)), lambda h, o: (43 * h + o) & 4294967295) AS h FROM p),
h AS (SELECT page_id, CASE WHEN h = 0 THEN 1 ELSE h END AS hash FROM h0)"""
_REFS = rf"""{_P},
r0 AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["'']([^"''#?]+)', 1), lambda x: replace(x, '\', '/'))) AS ref FROM p),
r AS (SELECT * FROM r0 WHERE NOT (starts_with(ref, 'http://') OR starts_with(ref, 'https://') OR starts_with(ref, 'mailto:') OR starts_with(ref, 'javascript:')))"""
_PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)"
_DIRS = f"""{_PATHS},
parts AS (SELECT string_split(path, '/') AS x FROM paths),
dirs AS (SELECT DISTINCT array_to_string(x[1:i], '/') || '/' AS dir FROM (SELECT x, unnest(range(2, len(x))) AS i FROM parts WHERE len(x) > 2))"""
_TOC = f"""{_P},
n0 AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '{catalog.NAV}', 1), '{catalog.ANCHOR}') AS a FROM p),
n1 AS (SELECT page_id, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM n0),
toc AS (SELECT row_number() OVER (ORDER BY page_id, i) - 1 AS ord, CASE WHEN i = 1 THEN 1 ELSE 2 END AS depth, page_id,
  regexp_extract(a, '(?is)href="([^"]*)"', 1) AS url, regexp_extract(a, '(?is)>(.*?)</a>', 1) AS title FROM n1)"""
_KIDS = f"{_TOC},\nkids AS (SELECT ord, depth, coalesce(lead(depth) OVER (ORDER BY ord) > depth, false) AS has_children FROM toc)"
_TOPICS = f"""{_TOC},
e AS (SELECT depth, ord, {_URL.format("url")} AS url, lower({_URL.format("url")}) AS key FROM toc),
o0 AS (SELECT page_id, {_URL.format("url")} AS url, lower({_URL.format("url")}) AS key FROM p),
o AS (SELECT * FROM o0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
b AS (SELECT 0 AS phase, 0 AS depth, page_id AS seq, url, CASE WHEN key IN (SELECT key FROM e) THEN 6 ELSE 2 END AS flags FROM o),
w AS (SELECT * FROM e WHERE key NOT IN (SELECT key FROM o) QUALIFY row_number() OVER (PARTITION BY key ORDER BY depth, ord) = 1),
v AS (SELECT CASE WHEN contains(url, '#') THEN 2 ELSE 1 END AS phase, CASE WHEN contains(url, '#') THEN 0 ELSE depth END AS depth, ord AS seq, url,
  CASE WHEN contains(url, '#') THEN 4 ELSE 6 END AS flags FROM w),
topics AS (SELECT row_number() OVER (ORDER BY phase, depth, seq, url) - 1 AS topic_idx, url, flags FROM (SELECT * FROM b UNION ALL SELECT * FROM v))"""


def _packing(ctes: str, rows: str, page: int, at_page: int, at_place: int, out: str) -> str:
    """Rows (k, i, size), i from 1 on without gaps, packed one after the other."""
    return f"""WITH RECURSIVE {ctes},
x AS MATERIALIZED ({rows}),
pk AS (
  SELECT 0::BIGINT AS i, {at_page}::BIGINT AS page, 0::BIGINT AS pos, {at_place}::BIGINT AS upto
  UNION ALL
  SELECT x.i, CASE WHEN upto + size > {page} THEN page + 1 ELSE page END, CASE WHEN upto + size > {page} THEN 0 ELSE upto END,
    CASE WHEN upto + size > {page} THEN size ELSE upto + size END
  FROM pk JOIN x ON x.i = pk.i + 1)
SELECT {out}, page, pos FROM pk JOIN x USING (i)"""


def _paged(name: str, rows: str, page: int, at: int, header: int, first_page: int = 0) -> str:
    """Tables ``name``_p (the columns of ``rows``, page, pos): rows (i from 1 on, size, first, need) packed, page by page."""
    return f"""{name}_x AS MATERIALIZED (SELECT *, sum(size) OVER (ORDER BY i) AS upto FROM ({rows})),
{name}_s AS (
  SELECT 1::BIGINT AS i, {first_page}::BIGINT AS page, {at}::BIGINT AS at
  UNION ALL
  SELECT min(b.i), s.page + 1, {header} FROM {name}_s s JOIN {name}_x a ON a.i = s.i
    JOIN {name}_x b ON b.i > s.i AND s.at + a.first + b.upto - b.size - a.upto + b.need > {page} GROUP BY s.page),
{name}_p AS (
  SELECT x.*, s.page, CAST(CASE WHEN x.i = s.i THEN s.at ELSE s.at + a.first + x.upto - x.size - a.upto END AS BIGINT) AS pos
  FROM {name}_x x ASOF JOIN {name}_s s ON x.i >= s.i JOIN {name}_x a ON a.i = s.i)"""


def _blocks(name: str, page: int) -> str:
    return f"""SELECT page, count(*) AS n_entries, CAST({page} - max(pos + bytes) AS BIGINT) AS free, page - 1 AS prev_page,
  CASE WHEN page < (SELECT max(page) FROM {name}) THEN page + 1 ELSE -1 END AS next_page, CAST(sum(count(*)) OVER (ORDER BY page) - count(*) AS BIGINT) AS entries_before
FROM {name} GROUP BY page"""


def _groups(n: str) -> str:
    return f"range(0, greatest(1, CAST(ceil(length(ltrim(bin({n}), '0')) / 7.0) AS BIGINT)))"


_COMMON = "CAST(len(list_filter(range(1, least(length(word), length(last)) + 1), lambda i: word[1:i] = last[1:i])) AS BIGINT)"
_LEB = "greatest(1, CAST(ceil(length(ltrim(bin({0}), '0')) / 7.0) AS BIGINT))"
_LEAVES = f"""WITH RECURSIVE {_DELTAS},
g AS (SELECT word, is_title, page_id, any_value(doc_delta) AS d, count(*) AS n, sum({_SIZE.format("pos_delta", 6)}) AS bits FROM deltas GROUP BY ALL),
z AS (SELECT word, is_title, count(*) AS df, CAST(sum(ceil(({_SIZE.format("d", 1)} + {_SIZE.format("n", 1)} + bits) / 8.0)) AS BIGINT) AS bytes FROM g GROUP BY ALL),
v AS (SELECT word, is_title, row_number() OVER o AS i, coalesce(lag(word) OVER o, '') AS last, length(word) + 9 + {_LEB.format("df")} + {_LEB.format("bytes")} AS first
  FROM z WINDOW o AS (ORDER BY word, is_title DESC)),
{_paged("leaf", f"SELECT word, is_title, i, first - {_COMMON} AS size, first, length(word) + 18 AS need FROM v", 4096, 8, 8)},
leaves AS (SELECT word, is_title, page, pos, CAST(CASE WHEN pos = 8 THEN first ELSE size END AS BIGINT) AS bytes FROM leaf_p),
sep AS (SELECT page, arg_min(word, {{'w': word, 'b': NOT is_title}}) AS first_word, arg_max(word, {{'w': word, 'b': NOT is_title}}) AS last_word FROM leaves GROUP BY page)"""
_LISTED = f"""{_TOPICS},
kn AS (SELECT lower(url) AS key, max(topic_idx) AS topic_idx FROM topics GROUP BY 1),
kl AS (SELECT title AS keyword, row_number() OVER (PARTITION BY title ORDER BY ord) - 1 AS place, topic_idx
  FROM toc JOIN kn ON kn.key = lower({_URL.format("toc.url")}) WHERE title <> '' AND url <> '')"""
_COLLATE = r"""lower(regexp_replace(keyword, '^[^\p{L}\p{N}]+', '')),
  list_transform(string_split(keyword, ''), lambda c: {'c': lower(c), 'u': CASE WHEN regexp_matches(c, '^\p{Lu}$') THEN 1 ELSE 0 END}), keyword"""
_LISTING = f"""WITH RECURSIVE {_LISTED},
kc AS (SELECT keyword, count(*) AS n_topics, 2 * length(keyword) + 26 + 4 * count(*) AS bytes FROM kl GROUP BY keyword),
{_paged("kb", f"SELECT *, row_number() OVER (ORDER BY {_COLLATE}) AS i, bytes AS size, bytes AS first, bytes + 1 AS need FROM kc", 2048, 12, 12)}"""
_HEX = "lower(lpad(to_hex({0}), 2, '0'))"

ORACLE = {
    "page_title": rf"WITH {_P} SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '{text.TITLE}', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS title FROM p",
    "section_presence": f"WITH {_P} SELECT page_id, regexp_matches(html, '{text.TITLE}') AS has_title, regexp_matches(html, '{text.BODY}') AS has_body FROM p",
    "strip_markup": f"WITH {_SECTIONS} SELECT page_id, length(body) AS text_len FROM s",
    "tokens": f"WITH {_LISTS} SELECT page_id, is_title, word, count(*) AS n FROM (SELECT page_id, true AS is_title, unnest(tw) AS word FROM l UNION ALL SELECT page_id, false, unnest(bw) FROM l) GROUP BY ALL",
    "stopword_filter": f"WITH {_LISTS}, k AS (SELECT page_id, list_concat(tw, bw) AS w FROM l) SELECT page_id, CAST(len(list_filter(w, lambda x: NOT list_contains({_STOP}, x))) AS BIGINT) AS kept, CAST(len(list_filter(w, lambda x: list_contains({_STOP}, x))) AS BIGINT) AS dropped FROM k",
    "word_positions": f"WITH {_OCC} SELECT page_id, is_title, word, pos FROM occ",
    "term_stats": f"WITH {_OCC} SELECT word, is_title, count(DISTINCT page_id) AS df, count(*) AS tf FROM occ GROUP BY ALL",
    "corpus_stats": f"""WITH {_OCC}, e AS (SELECT DISTINCT word, is_title FROM occ)
SELECT count(*) AS total_words, CAST(sum(length(word)) AS BIGINT) AS total_length, max(length(word)) AS longest_word, count(DISTINCT word) AS distinct_words,
  (SELECT CAST(sum(length(word)) AS BIGINT) FROM e) AS entry_length, count(DISTINCT page_id) AS pages FROM occ""",
    "posting_deltas": f"WITH {_DELTAS} SELECT word, is_title, page_id, pos, doc_delta, pos_delta FROM deltas",
    "wlc_bits": _WLC,
    "wlc_payload": f"""WITH {_DELTAS},
g AS (SELECT word, is_title, page_id, {_CODE.format("any_value(doc_delta)", 1)} || {_CODE.format("count(*)", 1)} || string_agg({_CODE.format("pos_delta", 6)}, '' ORDER BY pos) AS bits FROM deltas GROUP BY word, is_title, page_id)
SELECT word, is_title, page_id, lower(hex(unbin(rpad(bits, CAST(ceil(length(bits) / 8.0) * 8 AS INTEGER), '0')))) AS payload FROM g""",
    "vocab_order": f"WITH {_OCC} SELECT word, is_title, row_number() OVER (ORDER BY word, is_title DESC) - 1 AS rank FROM (SELECT DISTINCT word, is_title FROM occ)",
    "front_coding": f"""WITH {_OCC}, v AS (SELECT word, is_title, coalesce(lag(word) OVER (ORDER BY word, is_title DESC), '') AS last FROM (SELECT DISTINCT word, is_title FROM occ)),
c AS (SELECT *, CAST(len(list_filter(range(1, least(length(word), length(last)) + 1), lambda i: word[1:i] = last[1:i])) AS BIGINT) AS prefix_len FROM v)
SELECT word, is_title, prefix_len, substring(word, prefix_len + 1) AS suffix FROM c""",
    "url_hash": f"WITH {_HASH} SELECT page_id, hash FROM h",
    "url_table": f"WITH {_HASH} SELECT page_id, hash, row_number() OVER (ORDER BY hash, page_id) - 1 AS rank FROM h",
    "outlinks": f"WITH {_REFS} SELECT page_id, ref, count(*) AS n FROM r GROUP BY ALL",
    "missing_refs": f"WITH {_REFS} SELECT DISTINCT ref FROM r WHERE {_URL.format('ref')} NOT IN (SELECT {_URL.format('url')} FROM p)",
    "directories": f"WITH {_DIRS} SELECT dir FROM dirs",
    "directory_sort": f"""WITH {_DIRS}, a AS (SELECT path AS name, 1 AS section FROM paths UNION SELECT dir, 0 FROM dirs UNION SELECT unnest(['/', {', '.join(repr(d) for d in catalog.FIXED_DIRECTORIES)}]), 0)
SELECT name, section, row_number() OVER (ORDER BY lower(name), name, section) - 1 AS rank FROM a""",
    "section_offsets": f"WITH {_P}, z AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS length FROM p) SELECT page_id, CAST(coalesce(sum(length) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length FROM z",
    "toc_entries": f"WITH {_TOC} SELECT ord, depth, title, url, page_id FROM toc",
    "toc_has_children": f"WITH {_KIDS} SELECT ord, depth, has_children FROM kids",
    "toc_bfs": f"WITH {_TOC} SELECT ord, depth, row_number() OVER (ORDER BY depth, ord) - 1 AS bfs_rank FROM toc",
    "toc_offsets": _packing(_KIDS, "SELECT ord, row_number() OVER (ORDER BY depth, ord) AS i, CASE WHEN has_children THEN 28 ELSE 20 END AS size FROM kids", 4096, 1, 0, "ord"),
    "topics_flags": f"WITH {_TOPICS} SELECT topic_idx, url, flags FROM topics",
    "keyword_index": f"WITH {_TOC} SELECT title AS keyword, count(*) AS n_topics, arg_min(page_id, ord) AS first_topic, arg_max(page_id, ord) AS last_topic FROM toc WHERE title <> '' GROUP BY title",
    "keyword_collation": rf"""WITH {_TOC}, k AS (SELECT DISTINCT title AS keyword FROM toc WHERE title <> '')
SELECT keyword, row_number() OVER (ORDER BY lower(regexp_replace(keyword, '^[^\p{{L}}\p{{N}}]+', '')),
  list_transform(string_split(keyword, ''), lambda c: {{'c': lower(c), 'u': CASE WHEN regexp_matches(c, '^\p{{Lu}}$') THEN 1 ELSE 0 END}}), keyword) - 1 AS rank FROM k""",
    "keyword_resolve": f"WITH {_TOPICS}, g AS (SELECT lower({_URL.format('url')}) AS key, max(topic_idx) AS topic_idx FROM topics GROUP BY 1) SELECT title AS keyword, topic_idx FROM toc JOIN g ON g.key = lower({_URL.format('toc.url')}) WHERE title <> '' AND url <> ''",
    "strings_heap": _packing(_P, rf"SELECT page_id, row_number() OVER (ORDER BY page_id) AS i, length(trim(regexp_replace(regexp_replace(regexp_extract(html, '{text.TITLE}', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) + 1 AS size FROM p", 4096, 0, 1, "page_id"),
    "leaf_packing": f"{_LEAVES} SELECT word, is_title, page, pos, bytes FROM leaves",
    "separator_keys": f"{_LEAVES} SELECT page, first_word, last_word FROM sep",
    "leaf_table": f"{_LEAVES} {_blocks('leaves', 4096)}",
    "leaf_free_space": f"{_LEAVES} SELECT count(*) AS leaves, CAST(sum(free) AS BIGINT) AS total_free FROM ({_blocks('leaves', 4096)})",
    "leaf_nodes": f"""{_LEAVES},
sv AS (SELECT page AS leaf, last_word AS word, coalesce(lag(last_word) OVER (ORDER BY page), '') AS last FROM sep WHERE (SELECT count(*) FROM sep) > 1),
{_paged("node", f"SELECT leaf, word, leaf + 1 AS i, length(word) + 8 - {_COMMON} AS size, length(word) + 8 AS first, length(word) + 8 - {_COMMON} AS need FROM sv", 4096, 2, 2)}
SELECT leaf, word, page, pos FROM node_p""",
    "keyword_lists": f"WITH {_LISTED} SELECT keyword, place, topic_idx FROM kl",
    "keyword_blocks": f"{_LISTING} SELECT keyword, n_topics, i - 1 AS rank, page, pos, bytes FROM kb_p",
    "keyword_block_table": f"{_LISTING} {_blocks('kb_p', 2048)}",
    "topics_table": f"""WITH RECURSIVE {_TOPICS},
kd AS (SELECT ord, coalesce(lead(depth) OVER (ORDER BY ord) > depth, false) AS c FROM toc),
{_paged("to", "SELECT ord, row_number() OVER (ORDER BY depth, ord) AS i, CASE WHEN c THEN 28 ELSE 20 END AS size, size AS first, size AS need FROM toc JOIN kd USING (ord)", 4096, 0, 0, 1)},
kn AS (SELECT lower(url) AS key, max(topic_idx) AS topic_idx FROM topics GROUP BY 1),
nm AS (SELECT kn.topic_idx, max(to_p.page * 4096 + to_p.pos) AS toc_off, min(to_p.i) AS bfs, arg_min(title, to_p.i) AS toc_title
  FROM toc JOIN to_p USING (ord) JOIN kn ON kn.key = lower({_URL.format("toc.url")}) GROUP BY 1),
ow AS (SELECT {_URL.format("url")} AS url, arg_min(trim(regexp_replace(regexp_replace(regexp_extract(html, '{text.TITLE}', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), page_id) AS own_title FROM p GROUP BY 1),
al AS (SELECT t.topic_idx, t.url, flags, bfs, coalesce(toc_off, 0) AS toc_off, coalesce(own_title, toc_title, '') AS title FROM topics t LEFT JOIN nm USING (topic_idx) LEFT JOIN ow ON ow.url = t.url),
{_paged("ti", "SELECT topic_idx, row_number() OVER (ORDER BY bfs IS NULL, bfs, topic_idx) AS i, length(title) + 1 AS size, size AS first, size AS need FROM al WHERE title <> ''", 4096, 1, 0)},
{_paged("us", "SELECT topic_idx, topic_idx + 1 AS i, length(url) + 9 AS size, size AS first, size AS need FROM al", 4096, 1, 0)},
uh0 AS (SELECT topic_idx, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(url, ''), lambda c: c <> ''),
  lambda c: CASE WHEN c = '/' THEN 44 WHEN unicode(c) > 90 THEN unicode(c) - 80 ELSE unicode(c) - 48 END::BIGINT)), lambda h, o: (43 * h + o) & 4294967295) AS h FROM al),
uh AS (SELECT topic_idx, row_number() OVER (ORDER BY CASE WHEN h = 0 THEN 1 ELSE h END, topic_idx) - 1 AS r FROM uh0)
SELECT topic_idx, toc_off, coalesce(ti_p.page * 4096 + ti_p.pos, 4294967295) AS title_off, r // 341 * 4096 + r % 341 * 12 AS urltbl_off, us_p.page * 4096 + us_p.pos AS urlstr_off, flags
FROM al LEFT JOIN ti_p USING (topic_idx) JOIN us_p USING (topic_idx) JOIN uh USING (topic_idx)""",
    "topic_pages": f"WITH {_PATHS} SELECT page_id, lower(regexp_replace(parse_filename(path), '([^.])\\.[^.]*$', '\\1')) AS name FROM paths WHERE contains(lower(string_split(path, '/')[-1]), '.ht')",
    "frame_padding": f"WITH {_P} SELECT CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) AS total, CAST(ceil(coalesce(sum(strlen(html)), 0) / 32768.0) * 32768 AS BIGINT) AS padded FROM p",
    "varint_len": f"""WITH {_P}, z AS (SELECT DISTINCT CAST(strlen(html) AS BIGINT) AS value FROM p), g AS (SELECT value, {_groups("value")} AS i FROM z)
SELECT value, array_to_string(list_transform(i, lambda k: {_HEX.format("((value >> (7 * k)::INT) & 127) + CASE WHEN k < len(i) - 1 THEN 128 ELSE 0 END")}), '') AS leb128,
  array_to_string(list_transform(i, lambda k: {_HEX.format("((value >> (7 * (len(i) - 1 - k))::INT) & 127) + CASE WHEN k < len(i) - 1 THEN 128 ELSE 0 END")}), '') AS encint FROM g""",
    "term_lookup": f"WITH {_OCC} SELECT page_id, is_title, pos FROM occ WHERE word = 'hand'",
    "phrase_lookup": f"WITH {_OCC} SELECT DISTINCT a.page_id, a.pos FROM occ a JOIN occ b ON a.page_id = b.page_id AND b.pos = a.pos + 1 WHERE a.word = 'from' AND b.word = 'an'",
    "project_options": "SELECT * FROM (VALUES ('title', 'Mini'), ('language', '0x409 English'), ('full-text search', 'Yes')) AS t(key, value)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
