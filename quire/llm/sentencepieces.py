"""SentencePiece encoding and decoding by Viterbi over shared prefixes.

A text is marked as the SentencePiece format does it: one blank before it, blanks written as the piece mark. Marked words are runs of
blanks with what follows them. The distinct words of a batch, those that the task doesn't remember, are sorted, which
lays them out as a trie in depth-first order: the forward scores of a word's characters are kept on a stack, and the next word takes
over those of the prefix that both share. The best segmentation of each word follows from the back pointers.

Pieces and ids come from a vocabulary file; vocabularies are not trained here, and so neither are their scores. Those of the
file are ranks (it was made by merging), not probabilities; they are read as Zipf's law has them, log p = -log(rank + 1), up to a constant. Characters without a piece are spelled by byte pieces; so is the
mark itself where a text holds it as a character, and so decoding gives back every text exactly.

Defined results: null and empty texts have no pieces; among equally good segmentations the one whose last piece is longer wins, from the end to the
front; very long words are segmented whole, in time linear in their length; repeated rows get equal ids; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import released

VOCABULARY = "piece_bpe_32k.model"
#: Score of a byte piece: below that of every other piece.
BYTE = -16.0
#: Bytes of words and their ids that a task remembers.
CACHE = 48 << 20
#: Characters of text encoded at once.
STEP = 1 << 19
MARK = "▁"


class Vocabulary:
    """Pieces, their scores and ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.uint32)
        ranked = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(MARK, " ").encode()
                ranked.append((-model.get_score(i), i, piece.replace(MARK, " ")))
        self.score = {piece: (-math.log(rank + 1), i) for rank, (_, i, piece) in enumerate(sorted(ranked), 1)}
        self.longest = max(map(len, self.score), default=1)

    def segment_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each word's best segmentation. words: sorted; shared prefixes are scored once."""
        table, longest, byte_id = self.score, self.longest, self.byte_id
        best, back, last, out = [0.0], [None], "", []
        for word in words:
            n = len(word)
            shared, limit = 0, min(n, len(last))
            while shared < limit and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for j in range(shared + 1, n + 1):
                top, how = -math.inf, None
                for i in range(max(0, j - longest), j):
                    found = table.get(word[i:j])
                    if found is not None:
                        value = best[i] + found[0]
                        if value > top:
                            top, how = value, (i, found[1])
                if how is None:
                    raw = word[j - 1].encode()
                    top, how = best[j - 1] + BYTE * len(raw), (j - 1, tuple(int(byte_id[b]) for b in reversed(raw)))
                best.append(top)
                back.append(how)
            ids, j = [], n
            while j:
                i, piece = back[j]
                if isinstance(piece, tuple):
                    ids.extend(piece)
                else:
                    ids.append(piece)
                j = i
            ids.reverse()
            out.append(ids)
            last = word
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes as they stand, without the blank in front."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Pieces:
    """A vocabulary and the segmentations of marked words that a task remembers."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.decode = vocabulary, vocabulary.decode
        self.split = re.compile(r" *[^ ]+| +").findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = self.used = 0
        self.start, self.size, self.store = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def _learn(self, words: list[str]) -> None:
        found = self.vocabulary.segment_sorted(words)
        size = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(self.known), int(size.sum())
        while n + len(words) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        at = slice(n, n + len(words))
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.store[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.used += total
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        # A string and its place in the dictionary take some 150 bytes besides its characters.
        self.held += len(words) * 166 + 2 * sum(map(len, words)) + 4 * total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > CACHE:
            self.forget()
        lists = [self.split(" " + t) if t else [] for t in texts]
        flat = [w for x in lists for w in x]
        if new := sorted(set(flat).difference(self.known)):
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        own = self.size[codes]
        upto = np.cumsum(own)
        ids = self.store[np.repeat(self.start[codes] - (upto - own), own) + np.arange(int(own.sum()))]
        ends = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _pieces(path: str | None) -> Pieces:
    """An empty memory over the process's vocabulary: reading that takes longer than a small task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    kept = sys.__dict__.setdefault("_quire_pieces", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return Pieces(kept[path])


def _batches(column: pa.Array):
    texts = ["" if t is None else t for t in column.to_pylist()]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < STEP):
            size += len(texts[upto])
            upto += 1
        yield at, texts[at:upto]
        at = upto


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``."""

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                found = pieces.encode(texts)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id bigint, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            texts = [pieces.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id bigint, text string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), exact (decoding gave the text)."""

    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                found = pieces.encode(texts)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                exact = [pieces.decode(x.tolist()) == t for x, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([len(x) for x in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(exact)], names=["doc_id", "n_pieces", "ids_crc32", "exact"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id bigint, n_pieces bigint, ids_crc32 bigint, exact boolean")
