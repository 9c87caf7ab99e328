"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import exact_dedup, language_id, licenses, mixing, near_dedup, nearest, registry, sentencepieces, token_files, tool_calls, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=3, n=60):
    """Texts of few words with exact and near copies, and odd rows."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "sta") for b in ("ba", "do", "fi", "ge", "hu", "jon", "ke")]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 60)))
        if i % 4 == 1:
            text = rows[r.randrange(len(rows))][1]
        elif i % 4 == 2:
            ws = rows[r.randrange(len(rows))][1].split()
            for _ in range(max(1, len(ws) // 25)):
                ws[r.randrange(len(ws))] = r.choice(words)
            text = " ".join(ws)
        rows.append((i, text, "en", f"s{i % 4}", 0))
    odd = [(100, None, None, None, None), (101, "", "en", None, 0), (102, "  \n\t ", "en", "", 0), (103, "one", "en", "s1", 0), (104, "ONE", "en", "s1", 0), (105, "word " * 20_000, "en", "s1", 0), (105, "word " * 20_000, "en", "s1", 0), (None, "null id here", "en", "s2", 0), (106, "été ÉTÉ ß", "fr", "s2", 0)]
    return rows + odd


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    return frame.withColumn("node", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("q_s", F.lit(2)).withColumn("size", F.lit(3))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, nothing):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        match = [ids for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        ids = match[0]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(nothing).count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_digest_index_keeps_growing(spark):
    index = exact_dedup.DigestIndex(spark, "growing_index", 3)
    for batch, size in (([(1, "a"), (2, "b")], 2), ([(9, "a"), (3, "c"), (4, "c")], 3)):
        rows = exact_dedup.exact_dedup(spark.createDataFrame(batch, "doc_id bigint, text string"), index)
        rows.collect()
        assert index.read().count() == size
    assert {r["doc_id"]: r["keep_id"] for r in rows.collect()} == {9: 1, 3: 4, 4: 4}
    again = exact_dedup.exact_dedup(spark.createDataFrame([(9, "a"), (3, "c"), (4, "c")], "doc_id bigint, text string"), index)
    assert not any(r["kept"] for r in again.collect()) and index.read().count() == 3
    about = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED growing_index").collect()}
    assert about["Num Buckets"] == "3" and "digest" in about["Bucket Columns"] and "digest" in about["Sort Columns"]


def test_tool_calls(spark):
    rows = [(1, 0, "system", "be\n\"x\""), (1, 1, "user", "q\\\u0001"), (1, 2, "assistant", "a"), (1, 3, "user", None), (2, 5, "assistant", "lost"), (None, 0, "user", "n"), (1, 2, "assistant", "a"), (3, None, "user", "x"), (3, 1, "robot", "x"), (4, -1, "user", "neg")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    got = tool_calls.linked_tool_calls(spark.createDataFrame(rows, schema).withColumn("call_id", F.lit("x")).withColumn("conv", F.lit(1))).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert len(got) == 6 and set(by) == {(1, 0), (1, 1), (1, 3), (2, 5), (None, 0), (4, -1)}
    assert by[1, 1]["linked"] and by[1, 1]["level"] == 1 and by[1, 1]["error"] is None
    assert by[1, 3]["error"] == "text: missing" and not by[1, 3]["linked"] and by[1, 3]["level"] == 2
    assert by[2, 5]["error"] == "result without a call" and by[4, -1]["error"] == "turn: negative"
    for r in got:
        value = json.loads(r["json"])
        assert json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    assert json.loads(by[1, 1]["json"])["arguments"]["text"] == "q\\\u0001"
    # Many calls and results of one identifier, with and without a conversation: never each with each.
    many = [(c, t, r, f"{r} {i}") for c in (None, 7) for i in range(60) for t, r in ((1, "user"), (2, "assistant"))]
    many += [(8, 1, "user", "x" * 1_100_000), (8, 3, "user", "")]
    got = tool_calls.linked_tool_calls(spark.createDataFrame(many, schema)).collect()
    errors = {}
    for r in got:
        errors[r["conv_id"], r["error"]] = errors.get((r["conv_id"], r["error"]), 0) + 1
    assert errors == {(7, None): 60, (7, "another result of a call"): 59, (None, None): 60, (None, "result without a call"): 60, (8, "text: too long"): 1, (8, None): 1}
    assert all(json.loads(r["json"])["result"] == "assistant 0" for r in got if r["conv_id"] == 7 and r["error"] is None)
    assert {(r["turn"], r["level"]) for r in got if r["conv_id"] == 8} == {(1, 0), (3, 1)}
    assert tool_calls.linked_tool_calls(spark.createDataFrame([], schema)).count() == 0


def test_topological_levels(spark):
    calls = spark.createDataFrame([(c,) for c in "abcdefg"], "call_id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("e", "f"), ("f", "e"), ("g", "f"), ("d", "zz")], "call_id string, needs_id string")
    got = {r["call_id"]: r["level"] for r in tool_calls.topological_levels(calls, needs).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None}
    r = random.Random(4)
    links = {i: sorted(r.sample(range(i), min(i, r.choice([0, 1, 1, 1, 1, 2, 3])))) for i in range(70)}
    level = {}
    for i, below in links.items():
        level[i] = max((level[x] + 1 for x in below), default=0)
    calls = spark.createDataFrame([(str(i),) for i in links], "call_id string")
    needs = spark.createDataFrame([(str(i), str(x)) for i, below in links.items() for x in below], "call_id string, needs_id string")
    assert {int(x["call_id"]): x["level"] for x in tool_calls.topological_levels(calls, needs).collect()} == level


def brute_near(rows, width):
    def shingles(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            group[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [64, 2])
def test_near_dedup(spark, docs, monkeypatch, hot):
    """Also with nearly all lists counted as long, and no rounds before them."""
    monkeypatch.setattr(near_dedup, "HOT_LIST", hot)
    monkeypatch.setattr(near_dedup, "ROUNDS", 2 if hot == 64 else 0)
    got = near_dedup.near_dedup(docs, 2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(corpus(), 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def near_copies(seed, groups=3, n=60, size=70):
    """Large groups of near copies, with stragglers about the threshold, and unlike texts that share a passage."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(size)]
        for i in range(n):
            ws = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
                ws[r.randrange(size)] = r.choice(words[:40])
            rows.append(" ".join(ws))
    passage = " ".join(r.choice(words) for _ in range(30))
    rows += [f"{' '.join(r.choice(words) for _ in range(r.randint(5, 90)))} {passage}" for _ in range(n)]
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("rounds", "width"), [(0, 2), (0, 5), (2, 2)])
def test_near_dedup_of_large_groups(spark, monkeypatch, rounds, width):
    monkeypatch.setattr(near_dedup, "HOT_LIST", 8)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    rows = near_copies(rounds + width)
    want = brute_near(rows, width)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA), width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert 10 < len({c for *_, c in want}) < 230


def test_near_dedup_of_nothing(nothing):
    assert near_dedup.near_dedup(nothing, 2).count() == 0
    assert near_dedup.drop_near_copies(nothing, 2).count() == 0


def test_near_copies_are_dropped_row_by_row(spark):
    """Rows that share an id or have none are told apart by their texts; of wholly repeated rows one stays."""
    base = [f"w{i}" for i in range(40)]
    a, near, other = " ".join(base), " ".join([*base[:-1], "x"]), "quite another text that is like none of them"
    rows = [(1, a), (5, near), (5, other), (1, a), (None, near), (None, "an unlike row without any id at all"), (7, ""), (7, None), (8, a.upper())]
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit(0)).withColumn("digest", F.lit(1)), 2)
    assert left.columns == ["doc_id", "text", "label", "digest"]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, a), (5, other), (None, "an unlike row without any id at all"), (7, ""), (7, None)], key=repr)


def test_components(spark):
    from quire.llm.common import Staging

    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (200, 200)]
    frame = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["node"][0]: r["label"][0] for r in near_dedup.components(frame, Staging(spark, "t")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_licenses(spark, docs):
    texts = ["The MIT License. GNU General Public License v3, gnu GENERAL public-license", "cc by cc by sa 4.0", "mitlicense amit license", None, "", "É apache License é", "x " * 50_000 + "mit license", "gpl"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(rows).collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(at))
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert got[7]["labels"] == "gpl" and got[1]["labels"] == "cc-by,cc-by-sa-4.0"
    assert len(licenses.rules()) > 300
    forms = {"SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Apache-2.0": "apache-2.0", "MIT-licensed": "mit", "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "BSD-3-Clause": "bsd-3-clause"}
    named = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string")).collect()}
    assert named == dict(enumerate(forms.values()))
    table, alphabet = licenses.rules(), "gnu general public license version 3 0 mit cc by sa 4 0 apache 2 0 spdx license identifier mit licensed under the terms".split()
    r = random.Random(6)
    for _ in range(150):  # against a plain reading of the rules of suppression
        text = " ".join(r.choice(alphabet) for _ in range(25))
        every = [(m.start(), m.end(), i) for i, (_, _, keyword, rule) in enumerate(table) if f" {keyword} " in f" {text} " for m in rule.finditer(text)]
        left, stay = sorted(every, key=lambda x: (-table[x[2]][1], x[0] - x[1], x[0], x[2])), []
        while left:
            stay.append(left[0])
            left = [x for x in left[1:] if x[1] <= stay[-1][0] or x[0] >= stay[-1][1]]
        scanned = licenses._scan(text)
        want = {table[x[2]][0] for x in stay} | {table[x[2]][0] for x in every if x[2] < len(licenses.BASE)}
        assert (scanned[4] if scanned else "") == ",".join(sorted(want))
    assert licenses.scan_licenses(docs).count() == len(corpus())


def test_mix(docs, nothing):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus())
    by, size = {}, {}
    for i, t, _, s, _ in corpus():
        size.setdefault(s, 0)
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_, target = float(sum(size.values())), set(order), {}
    while True:  # reshare until none is above
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= 3 * size[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 3.0 * size[s]
            open_.discard(s)
    known = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert known == {(size[s], round(target[s], 6)) for s in order}
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in got)
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in copies.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_sources(nothing).count() == 0


def test_mix_hits_its_targets(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(90)) + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = mixing.mix_sources(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 3 for r in got)


def test_token_files(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    odd = ["a  b", "a\n\nb", " lead", "tail \n", "x\ny z", "it's <|endoftext|> don't.", "日本 été, ça!\tq", "1.2 ..."]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    got = token_files.token_files(rows).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    start = 0
    for r, (_, t) in zip(got, sorted([(-1 if x["doc_id"] is None else x["doc_id"], x["text"]) for x in rows.collect()], key=lambda x: x[0]), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(nothing).count() == 0


def test_shared_ids_of_token_files(spark):
    """Rows without an id, or of one id, are spread over the files; their tokens are whole and laid end to end."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 50} of {i}") for i in range(300)] + [(7, "same")] * 5
    want = [(d, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")) for d, t in rows]
    got = token_files.token_files(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("start").collect()
    names = [r["doc_id"] for r in got]
    assert names == sorted(names, key=lambda d: -1 if d is None else d)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert sorted(((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got)) == sorted((d or -1, len(x), zlib.crc32(x.tobytes())) for d, x in want)


def test_frequency_ranks_over_several_counts(spark):
    """Ids are counted for many documents together, and these counts, of different widths, are added up."""
    import zstandard

    lists = [[], [7] * 300_000, [9] * 300_001 + [65_536], [2, 2], [40_000] * token_files.BLOCK]
    rows = spark.createDataFrame([(zstandard.ZstdCompressor().compress(token_files._narrow(np.array(x, np.uint32))),) for x in lists], "ids binary").coalesce(1)
    assert token_files.frequency_ranks(rows).tolist() == [40_000, 9, 7, 2, 65_536]


def test_words_of_token_files_are_encoded_once(monkeypatch):
    """Marks behind a word make no new pieces of it, and pieces that are met again outlive the forgetting of others; all as the library encodes whole texts."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    tokenizer, encoder = Tokenizer.from_file(path), token_files.Encoder(path)

    def same(texts):
        ids, bounds = encoder(pa.array([t.encode() for t in texts], pa.large_binary()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    marks = [*"!#$%&()*+,-./:;=>?@[]^_`{|}~", "***", "...", "'s", "''s", "'"]
    same([f"Über großen{m} großen{m}\ngroßen{m}" for m in marks] + ["", "", "\n", " ", "a×, b÷. ñ, 日本, हिन्दी."])
    assert sum("großen" in p.decode() for p in encoder.known) == 2  # with a blank before it and without
    monkeypatch.setattr(token_files, "PIECES", 20)
    for i in range(5):
        same([" ".join(f"again {'xyzuv'[i] * k}" for k in range(1, 15)), "x" * 200 + f" {i}"])
    both = encoder.known | encoder.older
    assert b" again" in both and b" x" not in both and len(both) < 80 and max(map(len, both)) <= token_files.LONGEST


def test_ids_counted_while_encoding(spark, docs, nothing):
    """The counts that go with the encoded texts rank the ids as a count of all stored ids does."""
    tokens = token_files.encoded(docs).cache()
    want = token_files.frequency_ranks(tokens.where("ids is not null").select("ids"))
    assert len(want) and token_files.frequency_ranks(tokens).tolist() == want.tolist()
    assert len(token_files.frequency_ranks(token_files.encoded(nothing))) == 0


def test_white_space_runs_of_token_files(spark):
    """Blanks and line feeds next to white space of every kind, on both sides, as the library encodes the whole text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    kinds = ["\t", "\v", "\f", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
    texts = ["a \xa0 \xa0 b", "a\n\xa0\xa0b", "a\r\nb", *(f"a{x}b" for k in kinds for x in (f" {k}", f"{k} ", f"\n{k}", f"{k}\n", f"{k} {k}{k}", f" {k} {k} ", f"\n{k}{k}\n"))]
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    got = token_files.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_packing_of_ranks():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 3], np.uint32)
    control, data = token_files.pack(ranks)
    assert token_files.unpack(control, data, len(ranks)).tolist() == ranks.tolist()
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 4 + 4 + 1 and len(control) == 2


def test_sentencepieces(spark, docs, nothing):
    import public_tokenizers

    p = sentencepieces.Vocabulary(public_tokenizers.path(sentencepieces.VOCABULARY))
    words = sorted({" word", " words", " wordy", "word", " ", "  x", " été", " 日本語", " ▁", " \x00a", " supercalifragilistic"})
    for word, ids in zip(words, p.segment_sorted(words), strict=True):

        def best(end, word=word, seen={}):  # noqa: B006
            if end == 0:
                return 0.0
            if (word, end) not in seen:
                options = [best(i) + p.score[word[i:end]][0] for i in range(end) if word[i:end] in p.score]
                seen[word, end] = max(options, default=best(end - 1) + sentencepieces.BYTE * len(word[end - 1].encode()))
            return seen[word, end]

        own = {i: s for s, i in p.score.values()}
        assert abs(sum(own.get(i, sentencepieces.BYTE) for i in ids) - best(len(word))) < 1e-9
        assert b"".join(p.bytes[i] for i in ids).decode() == word
    got = sentencepieces.piece_digests(docs).collect()
    assert len(got) == len(corpus()) and all(r["exact"] for r in got)
    odd = spark.createDataFrame([(1, "▁ a▁b  c\n "), (2, None), (3, "x" * 100_000)], "doc_id bigint, text string")
    back = sentencepieces.decode_pieces(sentencepieces.encode_pieces(odd)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: "▁ a▁b  c\n ", 2: "", 3: "x" * 100_000}


def test_viterbi_and_its_shortcut():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(0, 12, 5)
        s = rng.normal(0, rng.choice([0.3, 1, 4]), (lengths.sum(), 3)).astype(np.float32)
        label, one, at = language_id.viterbi(s, lengths, 2.0), language_id.single_language(s, lengths, 2.0), 0
        for i, n in enumerate(lengths):
            if n:
                x, own = s[at : at + n], label[at : at + n].astype(int)
                v = x[0].astype(float)
                for t in range(1, n):
                    v = (v[:, None] - 2.0 * (1 - np.eye(3))).max(0) + x[t]
                assert abs(x[np.arange(n), own].sum() - 2.0 * (np.diff(own) != 0).sum() - v.max()) < 1e-3
                if one[i] >= 0:
                    assert abs(x[:, one[i]].sum() - v.max()) < 1e-3
            at += n


def test_language_id(spark, nothing):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34 !", "en", None, 0), (-3, "Привет мир", None, None, 0), (-4, "", "en", None, 0), (-5, "½ ²", None, None, 0)], SCHEMA)
    got = language_id.identify_languages(table.unionByName(odd)).join(table.select(F.col("doc_id"), "lang"), "doc_id", "left").collect()
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] < 0} == {-1: ("und", 0), -2: ("und", 0), -3: ("en", 0), -4: ("und", 0), -5: ("und", 0)}
    assert language_id.identify_languages(nothing).count() == 0
    model = language_id.learn(table.select("text", "lang"))
    by = {r["lang"]: r["text"] for r in table.where("length(text) > 400").select("lang", "text").collect()}
    mixed = language_id.spans(" ".join(by["en"].split()[:40]) + " " + " ".join(by["de"].split()[:40]), model)
    assert [x[2] for x in mixed] == ["en", "de"]


def test_many_languages(spark):
    """Over 256 languages, none left out; very long and repeated texts, clashing columns."""
    letters = [chr(0x61 + i) for i in range(20)]
    code = lambda i: f"{letters[i % 20]}{letters[i // 20 % 20]}{letters[i % 7]}{letters[i // 20 % 20]}{letters[i % 20]}"
    rows = [(4 * k + i, f"{code(i)} " * 30, f"l{i:03}", None, 0) for i in range(300) for k in (10_000, 20_000, 30_000)]
    rows += [(-1, f"{code(299)} " * 100_000, None, None, 0), (-2, f"{code(299)} " * 3, None, None, 0), (-2, f"{code(299)} " * 3, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("words", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = language_id.identify_languages(docs).collect()
    lang = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == (lang[r["doc_id"]] or "l299") and r["score"] == 1 for r in got) and len(got) == len(rows)
    assert language_id.drop_unidentified(docs).count() == len(rows)


def test_words_of_letters_and_marks(spark):
    """Learning and prediction cut the same words; only letters count; no letters, no language."""
    import unicodedata

    hindi, marathi = "यह हिन्दी भाषा में लिखा हुआ है और इसके शब्दों में मात्राएँ हैं", "ही मराठी भाषा आहे आणि तिच्यात लिहिलेले शब्द वेगळे आहेत"
    nfd = unicodedata.normalize("NFD", "été après déjà où être élève forêt naïve là-bas ÉTÉ")
    russian = unicodedata.normalize("NFD", "мой твой ёлка йод белый синий край май")
    thai = "ที่นี่ภาษาไทย คนไทยพูดภาษาไทยที่บ้าน"
    train = [(4 * 97 + i, t, x) for i, (t, x) in enumerate([(hindi, "hi"), (marathi, "mr"), (nfd, "fr"), (russian, "ru"), (thai, "th"), ("plain english words and more of them", "en")] * 30)]
    odd = {-1: "हिन्दी भाषा", -2: "मराठी शब्द", -3: unicodedata.normalize("NFD", "élève été"), -4: "½ ²", -5: "Ⅷ ½", -6: "\u2764\ufe0f \u0301", -7: unicodedata.normalize("NFD", "белый край"), -8: "ที่นี่", -9: "हिन्दी \u13a0\u13a1\u13a2"}
    rows = spark.createDataFrame(train + [(i, t, None) for i, t in odd.items()], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify_languages(rows).where("doc_id < 0").collect()}
    assert got == {-1: ("hi", 1), -2: ("mr", 1), -3: ("fr", 1), -4: ("und", 0), -5: ("und", 0), -6: ("und", 0), -7: ("ru", 1), -8: ("th", 1), -9: ("hi", 0.5)}
    assert {r["doc_id"] for r in language_id.drop_unidentified(rows).where("doc_id < 0").collect()} == {i for i, r in got.items() if r[0] != "und"}
    model = language_id.learn(rows.select("text", "lang"))
    learned = np.unique(language_id.score_words(["भाषा", "जजज"], model)[:, model["languages"].index("hi")])
    assert len(learned) == 2
    assert language_id.spans("हिन्दी भाषा", model) == [(0, 1, "hi")] and language_id.spans("½ ²", model) == []


def test_mixed_languages_stay_in_the_pipeline(spark):
    """Only what op4 calls und goes: not three languages in one text, nor many letters of a script that training lacks."""
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    by = {}
    for r in table.where("length(text) > 400 and lang is not null").orderBy("doc_id").collect():
        by.setdefault(r["lang"], re.findall(r"[^\W\d_]+", r["text"]))
    cut = lambda lang, n: " ".join(itertools.takewhile(lambda w, left=[n]: left.__setitem__(0, left[0] - len(w)) or left[0] >= 0, itertools.cycle(by[lang])))  # noqa: B006, E731
    texts = {-1: f"{cut('en', 900)} {cut('de', 600)} {cut('fr', 500)}", -2: f"{cut('en', 300)} {'\u13a0\u13a1\u13a2\u13a3 ' * 90}", -3: "12 34 !", -4: "\u00bd", -5: None}
    rows = table.unionByName(spark.createDataFrame([(i, t, None, "odd", 0) for i, t in texts.items()], SCHEMA), allowMissingColumns=True)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, rows, DATA).collect()}
    op4 = {r["doc_id"]: r for r in language_id.identify_languages(rows).collect()}
    assert left & set(texts) == {-1, -2} and op4[-1]["lang_pred"] == op4[-2]["lang_pred"] == "en"
    assert 0 < op4[-1]["score"] < 0.5 and 0 < op4[-2]["score"] < 0.5
    assert left == {i for i, r in op4.items() if r["lang_pred"] != "und"}


def test_toxicity(spark, nothing):
    r = random.Random(1)
    plain = ["".join(r.choice(["ba", "do", "ke", "li", "mu", "ra", "so", "ti"]) for _ in range(r.randint(2, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        ws = [r.choice(plain) for _ in range(r.randint(20, 120))]
        bad = i % 5 == 0
        for _ in range(5 if bad else 0):
            ws[r.randrange(len(ws))] = r.choice(["gruzzle", "snarfix", "wobbler"])
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, labels).collect()}
    held = [x for x in got.values() if x["held_out"] and x["doc_id"] < 600]
    assert sum(x["predicted"] == int(x["doc_id"] % 5 == 0) for x in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values()) and got[1000]["predicted"] == got[1001]["predicted"] == 0
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got.values())
    assert {x["score"] for x in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    # Far into a very long text, on repeated rows, beside columns of other names.
    late = " ".join(r.choice(plain) for _ in range(30_000)) + " gruzzle snarfix wobbler gruzzle snarfix wobbler" * 3
    more = docs.unionByName(spark.createDataFrame([(2000, late), (2001, "gruzzle you snarfix"), (2001, "gruzzle you snarfix"), (None, "gruzzle")], "doc_id bigint, text string"))
    again = toxicity.score_toxicity(more.withColumn("score", F.lit("x")).withColumn("q_text", F.lit(1)).withColumn("toxic", F.lit(0)), labels.withColumn("text", F.lit("y"))).collect()
    new = {x["doc_id"]: x for x in again}
    assert len(again) == 606 and all(new[i] == x for i, x in got.items()) and new[None]["held_out"] is False
    assert len({(x["score"], x["predicted"]) for x in again if x["doc_id"] == 2001}) == 1 and new[2001]["predicted"] == 1
    assert new[2000]["score"] > new[0]["score"] / 2


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 10)).astype(np.float32)
    x[300:500] = x[7]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(900)]
    odd = [(2000, None, 0), (2020, [0.0] * 10, 0), (2040, [float("nan")] * 10, 0), (2060, [None] * 10, 0), (2080, [1.0, 2.0], 0)]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        scores = nearest.inner(x.astype(float), x[q].astype(float))
        want = [(i, scores[i]) for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
        hits += len({a for a, _ in want} & {a for a, _ in got[q]})
        assert all(b == scores[a] for a, b in got[q]) and len(got[q]) == 20
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert set(got) == set(range(0, 900, 20)) and hits >= 0.97 * 45 * 20
    assert nearest.nearest(spark.createDataFrame(odd[:4], "vec_id bigint, embedding array<float>, label int")).count() == 0
    few = nearest.nearest(spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>, label int")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = step(spark, docs, DATA)
        if name == "near":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _, c in brute_near(rows, 5) if i == c}
        if name == "exact":
            assert docs.count() == before.select("text").distinct().count()
        if name != "pieces":
            assert docs.columns == columns and docs.count() > 0
    assert docs.columns == ["doc_id", "ids", "n_pieces"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple(map(repr, row))
    rounded = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=key)
    assert rounded(got.select(*columns).collect()) == rounded(want.select(*columns).fetchall())
