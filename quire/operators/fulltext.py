"""Positional full-text index: occurrences, postings, statistics, deltas, code sizes, front coding.

One pass over the pages makes word arrays; positions are places in the title's and body's filtered words one after the other, so no window
is needed; one shuffle by word makes the postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import codecs, text
from quire.staging import Staging, preceded, ranked

#: Roots of the codes of document steps, occurrence counts and position steps.
ROOTS = (1, 1, 6)


def sections(pages: DataFrame, exact: bool = True) -> DataFrame:
    """(page_id, title, body): text of both sections without markup, entities decoded."""
    html = F.coalesce(F.col("html"), F.lit(""))
    out = pages.select("page_id", text.strip_markup(text.title_section(html)).alias("title"), text.strip_markup(text.body_section(html)).alias("body"))
    decode = text.unescape_exactly if exact else text.unescape
    return out.select("page_id", decode(F.col("title")).alias("title"), decode(F.col("body")).alias("body"))


def word_lists(pages: DataFrame, exact: bool = True) -> DataFrame:
    """(page_id, title_words, body_words), stop words still in."""
    return sections(pages, exact).select("page_id", text.words(F.col("title")).alias("title_words"), text.words(F.col("body")).alias("body_words"))


def tagged(title: Column, body: Column) -> Column:
    """One array of (is_title, word): both sections are read in one pass."""
    tag = lambda words, is_title: F.transform(words, lambda w: F.struct(F.lit(is_title).alias("is_title"), w.alias("word")))
    return F.concat(tag(title, True), tag(body, False))


def occurrences(pages: DataFrame, exact: bool = True) -> DataFrame:
    """(page_id, is_title, word, pos): one row per indexed word; stop words take no position, the body goes on after the title."""
    lists = word_lists(pages, exact).select("page_id", text.without_stop_words(F.col("title_words")).alias("t"), text.without_stop_words(F.col("body_words")).alias("b"))
    return lists.select("page_id", F.posexplode(tagged(F.col("t"), F.col("b"))).alias("pos", "x")).select("page_id", "x.is_title", "x.word", F.col("pos").cast("bigint").alias("pos"))


def postings(occ: DataFrame) -> DataFrame:
    """(word, is_title, page_id, tf, positions): ascending positions of each word in each page."""
    return occ.groupBy("word", "is_title", "page_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_stats(occ: DataFrame) -> DataFrame:
    """(word, is_title, df, tf); counted per page first, so that a word in every page is no hot key."""
    per_page = occ.groupBy("word", "is_title", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("word", "is_title").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


def corpus_stats(occ: DataFrame) -> DataFrame:
    """One row: total words and letters, longest word, distinct words, letters of distinct (word, is_title) entries, pages."""
    entries = occ.groupBy("word", "is_title").agg(F.count("*").alias("n"))
    by_entry = entries.agg(
        F.sum("n").alias("total_words"),
        F.sum(F.col("n") * F.length("word")).cast("bigint").alias("total_length"),
        F.sum(F.length("word")).cast("bigint").alias("entry_length"),
        F.max(F.length("word")).cast("bigint").alias("longest_word"),
        F.count_distinct("word").alias("distinct_words"),
    )
    return by_entry.crossJoin(occ.agg(F.count_distinct("page_id").alias("pages")))  # one row by one row


def posting_deltas(occ: DataFrame) -> DataFrame:
    """(word, is_title, page_id, pos, doc_delta, pos_delta): steps of pages within a word and of positions within a page."""
    lists = preceded(postings(occ), [F.col("word"), F.col("is_title"), F.col("page_id")], {"w": "word", "t": "is_title", "p": "page_id"}, Staging(occ.sparkSession, "deltas"))
    same = (F.col("w") == F.col("word")) & (F.col("t") == F.col("is_title"))
    lists = lists.withColumn("doc_delta", F.col("page_id") - F.when(same, F.col("p")).otherwise(0))
    step = F.transform("positions", lambda x, i: F.struct(x.alias("pos"), (x - F.when(i == 0, 0).otherwise(F.get("positions", i - 1))).alias("pos_delta")))
    return lists.select("word", "is_title", "page_id", "doc_delta", F.explode(step).alias("x")).select("word", "is_title", "page_id", "x.pos", "doc_delta", "x.pos_delta")


def wlc_entries(occ: DataFrame) -> DataFrame:
    """(word, is_title, df, wlc_bytes): pages and bytes of each word's list of pages and positions, whole bytes per page."""
    deltas = posting_deltas(occ)
    doc, count, place = ROOTS
    per_page = deltas.groupBy("word", "is_title", "page_id").agg(F.first("doc_delta").alias("d"), F.count("*").alias("n"), F.sum(codecs.scale_root_size(F.col("pos_delta"), place)).alias("bits"))
    bits = codecs.scale_root_size(F.col("d"), doc) + codecs.scale_root_size(F.col("n"), count) + F.col("bits")
    return per_page.groupBy("word", "is_title").agg(F.count("*").alias("df"), F.sum(F.ceil(bits / 8)).cast("bigint").alias("wlc_bytes"))


def wlc_sizes(occ: DataFrame) -> DataFrame:
    """(word, is_title, wlc_bytes)."""
    return wlc_entries(occ).select("word", "is_title", "wlc_bytes")


def wlc_payload(occ: DataFrame) -> DataFrame:
    """(word, is_title, page_id, payload): the lists themselves, whole bytes per page; a word's list is its pages' payloads in their order.

    They stay one row per page, so that the list of a frequent word, which may hold every page, is no single row.
    """
    doc, count, place = ROOTS
    deltas = posting_deltas(occ).groupBy("word", "is_title", "page_id").agg(F.first("doc_delta").alias("d"), F.sort_array(F.collect_list(F.struct("pos", "pos_delta"))).alias("x"))
    bits = F.concat(codecs.scale_root_bits(F.col("d"), doc), codecs.scale_root_bits(F.size("x").cast("bigint"), count), F.array_join(F.transform("x", lambda p: codecs.scale_root_bits(p["pos_delta"], place)), ""))
    deltas = deltas.select("word", "is_title", "page_id", bits.alias("bits"))
    padded = F.rpad("bits", (F.ceil(F.length("bits") / 8) * 8).cast("int"), F.lit("0"))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(padded) / 8 - 1).cast("int")), lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")
    return deltas.select("word", "is_title", "page_id", F.unhex(octets).alias("payload"))


def vocabulary(occ: DataFrame, name: str = "rank") -> DataFrame:
    """(word, is_title, rank): all entries by word, title before body."""
    entries = occ.select("word", "is_title").distinct()
    return ranked(entries, [F.col("word"), F.col("is_title").desc()], Staging(occ.sparkSession, "vocabulary"), name)


def front_coded(occ: DataFrame) -> DataFrame:
    """(word, is_title, prefix_len, suffix): each entry against the one before it in vocabulary order.

    No task holds more than a range of the order.
    """
    entries = preceded(occ.select("word", "is_title").distinct(), [F.col("word"), F.col("is_title").desc()], {"last": "word"}, Staging(occ.sparkSession, "front"))
    both = entries.withColumn("prefix_len", codecs.common_prefix(F.col("word"), F.coalesce("last", F.lit(""))))
    return both.select("word", "is_title", "prefix_len", F.substring("word", (F.col("prefix_len") + 1).cast("int"), F.length("word")).alias("suffix"))


def lookup(occ: DataFrame, word: str) -> DataFrame:
    """Extension. (page_id, is_title, pos) of a word."""
    return occ.where(F.col("word") == word).select("page_id", "is_title", "pos")


def phrase(occ: DataFrame, terms: list[str]) -> DataFrame:
    """Extension. (page_id, pos): where the terms stand one after the other; all joins are on (page_id, place)."""
    at = lambda i: occ.where(F.col("word") == terms[i]).select("page_id", (F.col("pos") - i).alias("pos"))
    out = at(0)
    for i in range(1, len(terms)):
        out = out.join(at(i), ["page_id", "pos"], "left_semi")
    return out.distinct()
