"""Token ids in binary files.

File format: Parquet rows, one per block of whole documents, in ascending doc_id order over the files and within each (the
file and block numbers are columns). A block holds doc_ids (64-bit), token counts (32-bit), and two streams: ``control``, two bits per
token that say how many bytes it takes (1 to 4), four tokens to a byte; and ``data``, the token's rank in little-endian bytes.
Ranks number the ids by falling frequency over all documents (ties by id), so that the most frequent 256 take one byte;
the table of ranks, bounded by the vocabulary, is a file of its own beside the blocks.

Decoding looks each control byte up in a table of four lengths, from which the places of all tokens follow by a running
sum, and gathers the bytes by numpy indexing.

Each document ends with END. Many texts are cut at once, by numpy over their bytes: before single blanks, around single line
feeds, and between a letter and an ASCII mark behind it. The vocabulary's own splitting cuts there too, if no other white space stands
beside. Arrow numbers the distinct pieces, and only those not met before go to the library. (Texts with a blank or line feed next to
white space of any kind, or with what may be a special token, are encoded whole: the splitting keeps runs of white space together.)
Ids are counted where they are made, so that the ranks cost no pass over them.

Defined results: null counts as the empty text, which has the END token alone; rows with a null doc_id come first; rows
that share a doc_id stand next to each other, by a hash of their tokens; very long texts make a block of their own; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import Staging, checked_broadcast, partitions, released

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Tokens of a block (a longer document makes a block of its own), bytes of text encoded at once, and pieces that a Python process
#: remembers (new and older ones), none of more bytes than LONGEST.
BLOCK = 1 << 19
STEP = 1 << 23
PIECES = 900_000
LONGEST = 64
#: Words handed to the library at once, and in one text.
WORDS = 4096
TOGETHER = 16


def _kinds() -> np.ndarray:
    """What each byte may be: SEP, MARK or LETTER (ASCII), LESS, white space of another kind or an end (BEFORE) or beginning (AFTER) of one."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK
    kind[[*range(65, 91), *range(97, 123)]] = LETTER
    kind[list(b" \n")] = SEP
    kind[ord("<")] |= LESS
    for x in (*ASCII_SPACE, *WIDE_SPACE):
        raw = x.encode()
        kind[raw[-1]] |= BEFORE
        kind[raw[0]] |= AFTER
    return kind


SEP, MARK, LETTER, LESS, BEFORE, AFTER = (1 << i for i in range(6))
#: White space besides blank and line feed (Python's \s, which holds all of Unicode's).
ASCII_SPACE = ("\t", "\v", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x1f")
WIDE_SPACE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
KIND = _kinds()
KIND_BYTES = KIND.tobytes()
#: The bytes of the wide ones as numbers: of two bytes, of three.
WIDE = [np.array([int.from_bytes(x.encode()) for x in WIDE_SPACE if len(x.encode()) == n]) for n in (2, 3)]


def _white(text: np.ndarray, at: np.ndarray, ends: bool) -> np.ndarray:
    """Whether white space of another kind than SEP ends (or begins) at these bytes of text."""
    a, b, c = (text[np.clip(at + i, 0, len(text) - 1)].astype(np.int64) for i in ((-2, -1, 0) if ends else (0, 1, 2)))
    two, one = (b << 8 | c, c) if ends else (a << 8 | b, a)
    return np.isin(one, [ord(x) for x in ASCII_SPACE]) | np.isin(two, WIDE[0]) | np.isin(a << 16 | b << 8 | c, WIDE[1])


def piece_starts(raw: bytes, edges: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that follow one another; edges: where each text begins, and the end of the last."""
    text, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(KIND_BYTES), np.uint8)
    cut = (kind & SEP).view(bool)  # SEP is 1
    at = np.flatnonzero(cut)
    # Texts to leave whole. What stands beside a text's own end counts too: that costs time alone.
    left, right = np.maximum(at - 1, 0), np.minimum(at + 1, len(text) - 1)
    pair = at[1:][np.diff(at) == 1]
    before, after = at[(kind[left] & BEFORE) > 0], at[(kind[right] & AFTER) > 0]
    less = np.flatnonzero(kind & LESS)
    less = less[text[np.minimum(less + 1, len(text) - 1)] == ord("|")]
    odd = np.concatenate((pair, before[_white(text, before - 1, True)], after[_white(text, after + 1, False)], less))
    # Marks behind a letter: an ASCII one, or U+00C0 to U+00FF without the two signs among them.
    mark = np.flatnonzero(kind & MARK)
    one, two = text[np.maximum(mark - 1, 0)], text[np.maximum(mark - 2, 0)]
    cut[mark[((KIND[one] & LETTER) > 0) | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]] = True
    line = at[text[at] == ord("\n")] + 1
    cut[line[line < len(text)]] = True
    for i in np.unique(np.searchsorted(edges, odd, "right") - 1):
        cut[edges[i] : edges[i + 1]] = False
    cut[edges[:-1][np.diff(edges) > 0]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to ids, each distinct piece of text encoded once while remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on.
        self.letters = np.arange(256, dtype="<u4")
        hidden = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
        self.letters[hidden] = 256 + np.arange(len(hidden))
        # Words alone go to the library several in one text, which it doesn't split: a byte stands between them that no UTF-8 text has
        # and no token but its own, so no merge goes beyond a word.
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = None
        vocabulary = self.tokenizer.get_vocab()
        alone = [b for b in (0xFF, 0xFE, 0xC0, 0xC1) if [t for t in vocabulary if chr(self.letters[b]) in t] == [chr(self.letters[b])]]
        self.between, self.line = bytes(alone[:1]), chr(self.letters[ord("\n")])
        self.cut = vocabulary[chr(self.letters[alone[0]])] if alone else -1
        # Pieces and their ids as 32-bit integers; those of ``older`` that are met again move to ``known``.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit integers."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """The same for words of letters, with a blank before them or not."""
        if not self.between:
            return self._encode(words)
        some = b"\n".join(self.between.join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER))
        texts = self.letters[np.frombuffer(some, np.uint8)].tobytes().decode("utf-32-le").split(self.line)
        flat = []
        for e in self.words.encode_batch_fast(texts, add_special_tokens=False):
            flat += e.ids
            flat.append(self.cut)
        ids = np.array(flat, "<u4")
        raw, at = ids.tobytes(), np.flatnonzero(ids == self.cut) * 4
        return [raw[a:b] for a, b in zip([0, *(at[:-1] + 4).tolist()], at.tolist(), strict=True)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        found = {}
        bare = [p.removeprefix(b" ") for p in pieces]
        words = [p for p, x in zip(pieces, bare, strict=True) if len(p) <= LONGEST and (x.isalpha() or (not x.isascii() and x.decode("utf-8", "replace").isalpha()))]
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            found.update(zip(some, self._encode_words(some), strict=True))
        other = [p for p in pieces if p not in found]
        ids = self._encode(other)
        if len(self.known) > PIECES // 2:
            self.known, self.older = {}, self.known
        self.known.update(found)
        self.known.update((p, x) for p, x in zip(other, ids, strict=True) if len(p) <= LONGEST)
        found.update(zip(other, ids, strict=True))
        return [found[p] for p in pieces]

    def __call__(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts (none is null), each followed by END, and where each text's begin, with the end of the last."""
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes() if edges[-1] > edges[0] else b""
        edges = edges - edges[0]
        starts = piece_starts(raw, edges) if raw else np.zeros(0, np.int64)
        kind, number = (pa.binary(), np.int32) if len(raw) < 1 << 31 else (pa.large_binary(), np.int64)
        cuts = np.append(starts, len(raw)).astype(number)
        pieces = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        # (Slices of the bytes: Arrow makes Python values one by one.)
        bounds = np.frombuffer(pieces.dictionary.buffers()[1], number)[: len(pieces.dictionary) + 1].tolist()
        distinct = pieces.dictionary.buffers()[2].to_pybytes() if len(starts) else b""
        keys = [distinct[a:b] for a, b in itertools.pairwise(bounds)]
        ids = list(map(self.known.get, keys))
        new = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            if (x := self.older.get(keys[i])) is None:
                new.append(i)
            else:
                ids[i] = self.known[keys[i]] = x
        if new:
            for i, x in zip(new, self._learn([keys[i] for i in new]), strict=True):
                ids[i] = x
        # Pieces with END behind each text's last, then the ids of all of them end to end.
        ends = np.searchsorted(starts, edges)
        codes = np.insert(pieces.indices.to_numpy(), ends[1:], len(keys))
        flat = pa.array([*ids, struct.pack("<I", END)], pa.large_binary()).take(pa.array(codes))
        place = np.frombuffer(flat.buffers()[1], np.int64)[: len(codes) + 1]
        return np.frombuffer(flat.buffers()[2], "<u4", int(place[-1]) // 4), place[ends + np.arange(len(ends))] // 4


def _encoder(path: str | None) -> Encoder:
    """The process's encoder: loading the vocabulary takes longer than a small task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    kept = sys.__dict__.setdefault("_quire_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


#: Lengths of the four tokens of a control byte.
def length_table() -> np.ndarray:
    return ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a stream of ranks."""
    r, most = ranks, int(ranks.max(initial=0))
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    more = [r >= 1 << 8 * k for k in range(1, 4) if most >> 8 * k]
    for there in more:
        codes[: len(r)] += there
    begin = np.cumsum(codes[: len(r)], dtype=np.int64) - codes[: len(r)] + np.arange(len(r))
    data = np.zeros(len(r) + sum(map(np.count_nonzero, more)), np.uint8)
    data[begin] = r.astype(np.uint8)  # the low byte
    for k, there in enumerate(more, 1):
        at = np.flatnonzero(there)
        data[begin[at] + k] = (r[at] >> np.uint32(8 * k)).astype(np.uint8)
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a stream, by table look-up."""
    size = length_table()[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        there = np.flatnonzero(size > k)
        out[there] |= raw[begin[there] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as compressed integers; besides, a row for each task with the ids it ``seen`` and how many ``times``."""

    def run(batches):
        import pyarrow.compute as pc
        import zstandard

        encode, squeeze, total = _encoder(path), zstandard.ZstdCompressor(level=3), np.zeros(0, np.int64)
        names = ["doc_id", "n_tokens", "ids", "seen", "times"]
        lists = pa.list_(pa.int64())
        for batch in batches:
            # A null text may have bytes under it.
            doc_ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
                ids, bounds = encode(texts.slice(at, upto - at))
                total = _added(total, np.bincount(ids))
                raw = [squeeze.compress(_narrow(ids[a:b])) for a, b in itertools.pairwise(bounds.tolist())]
                none = pa.nulls(upto - at, lists)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, upto - at), pa.array(np.diff(bounds)), pa.array(raw, pa.binary()), none, none], names=names)
                at = upto
        seen = np.flatnonzero(total)
        null = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*null, pa.array([seen], lists), pa.array([total[seen]], lists)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id bigint, n_tokens bigint, ids binary, seen array<bigint>, times array<bigint>")


def _added(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.pad(total, (0, max(0, len(n) - len(total))))
    total[: len(n)] += n
    return total


def _narrow(ids: np.ndarray) -> bytes:
    """As 16-bit integers where these hold all ids; else as 32-bit integers and a byte that makes the length odd."""
    return ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else ids.astype("<u4").tobytes() + b"\0"


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", len(raw) // 4) if len(raw) % 2 else np.frombuffer(raw, "<u2")


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents; as many as the vocabulary has at most. Those not counted by ``encoded`` are here."""

    def count(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        total, held, size = np.zeros(0, np.int64), [], 0
        for batch in batches:
            for raw in batch.column("ids"):
                held.append(_wide(open_.decompress(raw.as_py())))
                size += len(held[-1])
                if size > BLOCK:
                    # A count has as many places as the vocabulary: one for many documents.
                    total = _added(total, np.bincount(np.concatenate(held)))
                    held, size = [], 0
        if held:
            total = _added(total, np.bincount(np.concatenate(held)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    if "seen" in tokens.columns:
        counts = tokens.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).select(F.col("x.seen").alias("id"), F.col("x.times").alias("n"))
    else:
        counts = tokens.select("ids").mapInArrow(released(count), "id bigint, n bigint")
    rows = counts.groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r["id"] for r in rows.orderBy(F.desc("n"), "id").collect()], np.uint32)


def write_token_files(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Write ``docs`` (doc_id, text) as token files under ``out``: ``out/ranks`` and ``out/blocks``."""
    spark = docs.sparkSession
    stage = Staging(spark, "tokens")
    # Rows that share an id, or have none, are spread by their tokens: ranges may part them, and their order is kept.
    tokens = stage.table(encoded(docs, path).withColumn("spread", F.xxhash64("ids")), "tokens", codec="uncompressed")
    ids = frequency_ranks(tokens)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{out}/ranks")
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)

    def blocks(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        part, number = TaskContext.get().partitionId(), 0
        held, names, size = [], [], 0

        def close():
            counts = np.array([len(x) for x in held], "<u4")
            control, data = pack(rank[np.concatenate(held)])
            known = pa.array(names, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, number)] + [pa.array([int(counts.sum())], pa.int64()), pa.array([known.to_pylist()], pa.list_(pa.int64())), pa.array([counts.tobytes()], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["part", "block", "tokens", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = _wide(open_.decompress(raw.as_py()))
                if held and size + len(x) > BLOCK:
                    yield close()
                    held, names, size, number = [], [], 0, number + 1
                held.append(x)
                names.append(name)
                size += len(x)
        if held:
            yield close()

    rows = tokens.where("ids is not null").select("doc_id", "spread", "ids")
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "spread").sortWithinPartitions("doc_id", "spread")
    written = ordered.mapInArrow(released(blocks), "part bigint, block bigint, tokens bigint, doc_ids array<bigint>, counts binary, control binary, data binary")
    written.write.option("compression", "zstd").parquet(f"{out}/blocks")
    stage.drop(tokens)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "part bigint, block bigint, tokens bigint, doc_ids array<bigint>, counts binary, control binary, data binary"
    blocks = spark.read.schema(schema).parquet(f"{out}/blocks")
    ids = np.array([r["id"] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()], np.uint32)
    # Starts: first over the parts (one row each), then over the blocks within a part.
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    within = blocks.select("part", "block", F.col("tokens").alias("n"))
    within = within.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("offset"))
    starts = within.join(parts, "part").select("part", "block", (F.col("base") + F.col("offset")).alias("first"))
    starts = Staging(spark, "starts").table(starts, "starts")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                flat = ids[unpack(row["control"], row["data"], int(counts.sum()))].astype("<u4")
                edge = np.concatenate(([0], np.cumsum(counts)))
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + edge[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(checked_broadcast(starts), ["part", "block"]).select("first", "doc_ids", "counts", "control", "data")
    return placed.mapInArrow(released(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    out = Staging(spark, "token-files").path("files")
    write_token_files(docs, out, path)
    return read_token_files(spark, out)
