"""Language identification of text spans.

Words are a letter and the letters and marks behind it, in learning and prediction alike: Spark cuts them, ``letter_words``.
Script ranges narrow the candidates of a word: each learned language has the scripts that its training words' letters used. A word's
score per candidate is the sum of log-probabilities of its letter trigrams (with word bounds), from all training
documents' counts. Viterbi over the words of a text, with a penalty for each change of language, labels spans; the
language whose spans hold the most letters (marks don't count) is the prediction, its share of the letters the score.

Learning: trigram counts by language over all training documents (lang not null, crc32 of doc_id's text mod 4 not 2), in one Spark
aggregation. Trigrams are counted under a hash of BUCKETS values, so that every one counts, no language is left out, and the
model has a size known beforehand: half a megabyte a language, with four languages as with a thousand.

Defined results: texts that are null, empty or without letters get ``und`` and score 0. A text with letters gets a learned
language: if all its letters are of scripts that no learned language uses, the one with the most training words, with score 0;
if nothing can be learned, ``und``. Ties go to the first language by code point; a null doc_id is
a training row (its crc32 is that of no text) and not held out; very long texts are labelled whole; further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import wordbytes as wb
from quire.llm.common import released

#: Values of the trigrams' hash, a power of two.
BUCKETS = 1 << 17
#: Cost of a change of language between two words, in natural logarithms.
SWITCH = 12.0
#: Added to every count.
SMOOTH = 0.5
#: Bytes of words and scores that a task remembers.
CACHE = 32 << 20
#: Scores (words by languages) that are labelled at once.
STEP = 1 << 20


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


#: First code points of scripts' ranges and their names; fixed values of the Unicode standard, coarsened.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"), (0x20000, "han"), (0x30000, "other")]


_BOUNDS = np.array([x[0] for x in SCRIPTS])
_NAMES = sorted({x[1] for x in SCRIPTS})
_BITS = np.array([1 << _NAMES.index(x[1]) for x in SCRIPTS], np.int64)


def script_bits(codes: np.ndarray) -> np.ndarray:
    """One bit per script: that of each code point."""
    return _BITS[np.searchsorted(_BOUNDS, codes, side="right") - 1]


#: A letter and the letters and marks behind it; marks without a letter before them (as behind emoji) are no words.
WORD = r"(\p{L}[\p{L}\p{M}]*+)"


def letter_words(text: Column) -> Column:
    """Lower-case words of a text; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(1))


def mark_table() -> np.ndarray:
    """By code point, whether it is a mark: what else stands in a word is a letter."""
    if "_quire_marks" not in sys.__dict__:
        sys._quire_marks = np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
    return sys._quire_marks


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, code point of each letter or mark, first place of each word): a word has as many of either."""
    codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    # The trigrams of a word begin at its mark and at all of its letters but the last.
    at = np.repeat(np.cumsum(size + 2) - size - 2 - first, size) + np.arange(int(size.sum()))
    key = codes[at] << np.uint64(42) | codes[at + 1] << np.uint64(21) | codes[at + 2]
    return (wb.mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64), codes[at + 1].astype(np.int64), first


def learn(docs: DataFrame) -> dict:
    """The model: languages, log-probabilities by bucket and language, scripts of each language, the one with the most words.

    docs: (text, lang) of the training rows. Counts cover all of them; as many numbers as BUCKETS reach the driver per language.
    """
    words = docs.where("lang is not null").select("lang", F.explode(letter_words(F.col("text"))).alias("w"))
    # Words are counted before they are cut up: the same few words make up most of a text.
    words = words.groupBy("lang", "w").agg(F.count("*").alias("n"))

    def count(batches):
        for batch in batches:
            for lang, rows in pa.Table.from_batches([batch]).to_pandas().groupby("lang"):
                bucket, code, first = grams(rows["w"].tolist())
                each = np.repeat(rows["n"].to_numpy(), np.diff(np.append(first, len(code))))
                script = np.where(mark_table()[code], -1, -2 - np.searchsorted(_BOUNDS, code, side="right"))  # marks stand in many scripts
                kinds, place = np.unique(np.concatenate((bucket, script)), return_inverse=True)
                sums = np.bincount(place, np.concatenate((each, each))).astype(np.int64)
                total = np.array([rows["n"].sum()])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(kinds) + 1), pa.string()), pa.array(np.append(kinds, BUCKETS), pa.int64()), pa.array(np.append(sums, total), pa.int64())], names=["lang", "kind", "n"])

    counted = words.mapInArrow(released(count), "lang string, kind bigint, n bigint").groupBy("lang", "kind").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counted["lang"]))
    of = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    kind, n = counted["kind"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    table = np.zeros((BUCKETS, len(languages)), np.float32)
    gram = (kind >= 0) & (kind < BUCKETS)
    table[kind[gram], of[gram]] = n[gram]
    totals = table.sum(0, dtype=np.float64)
    np.log((table + SMOOTH) / (totals + SMOOTH * BUCKETS), out=table, casting="same_kind")
    scripts, most = np.zeros(len(languages), np.int64), np.zeros(len(languages), np.int64)
    most[of[kind == BUCKETS]] = n[kind == BUCKETS]
    letters = np.bincount(of[kind < -1], n[kind < -1], len(languages))
    used = np.zeros((len(languages), len(_NAMES)))
    np.add.at(used, (of[kind < -1], np.array([_NAMES.index(SCRIPTS[-3 - k][1]) for k in kind[kind < -1]], np.int64)), n[kind < -1])
    for i in range(len(languages)):
        scripts[i] = sum(1 << j for j in np.flatnonzero((used[i] > 0) & (used[i] * 1000 >= letters[i])))
    return {"languages": languages, "table": table, "scripts": scripts, "main": int(most.argmax()) if languages else 0}


def score_words(words: list[str], model: dict) -> np.ndarray:
    """Log-probability of each word in each language; minus infinity where its scripts rule a language out.

    A word in several scripts may be of any language that uses one of them, if none uses all. Words in scripts that no
    language uses get NaN.
    """
    if not words or not model["languages"]:
        return np.full((len(words), len(model["languages"])), np.nan, np.float32)
    bucket, code, first = grams(words)
    score = np.add.reduceat(model["table"][bucket], first, axis=0)
    own = np.bitwise_or.reduceat(np.where(mark_table()[code], 0, script_bits(code)), first)[:, None]
    lacks = (own & ~model["scripts"]) != 0
    none = lacks.all(1)
    lacks[none] = ((own & model["scripts"]) == 0)[none]
    score[lacks] = -np.inf
    score[lacks.all(1)] = np.nan
    return score


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores: words by languages, texts one after the other with the given lengths.

    All texts step along together, the longest first, so that the number of steps is the longest text's length.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    kind = np.min_scalar_type(max(k - 1, 0))
    back = np.empty((n, k), kind)
    best = np.zeros((len(sizes), k), np.float32)
    rows = np.arange(len(sizes))
    for t, m in enumerate(active):
        v = best[:m]
        at = starts[:m] + t
        if t:
            top = v.argmax(1)
            stay = v >= (v[rows[:m], top] - switch)[:, None]
            back[at] = np.where(stay, np.arange(k, dtype=kind), top.astype(kind)[:, None])
            v = np.where(stay, v, (v[rows[:m], top] - switch)[:, None])
            best[:m] = v + scores[at]
            best[:m] -= best[:m].max(1, keepdims=True)  # keeps long texts within single precision
        else:
            best[:m] = scores[at]
    label = np.zeros(n, np.int64)
    now = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = back[at, now[:m]]
    return label


class Words:
    """A model's scores, and the numbers of letters, of the words that a task remembers."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((1 << 12, len(self.model["languages"])), np.float32)
        self.letters = np.zeros(1 << 12, np.int64)

    def codes(self, words: list[str]) -> np.ndarray:
        if self.held > CACHE:
            self.forget()
        if new := list(set(words).difference(self.known)):
            n = len(self.known)
            while n + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
                self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
            self.scores[n : n + len(new)] = score_words(new, self.model)
            size = np.fromiter(map(len, new), np.int64, len(new))
            marks = mark_table()[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
            self.letters[n : n + len(new)] = size - np.add.reduceat(marks, np.cumsum(size) - size, dtype=np.int64)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            # A string and its place in the dictionary take some 150 bytes besides its characters.
            self.held += len(new) * (150 + 8 + 4 * self.scores.shape[1]) + 2 * int(size.sum())
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def single_language(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Per text the language that labels all of its words, or -1 where Viterbi has to decide.

    If no run of words gains more than half a switch from any other language than the text's best one, no path of
    several languages is better: m runs away from it gain m halves at most, and cost m - 1 switches at least.
    """
    texts, k = len(lengths), scores.shape[1]
    owner = np.repeat(np.arange(texts), lengths)
    total = np.stack([np.bincount(owner, scores[:, j], texts) for j in range(k)], axis=1)
    best = total.argmax(1)
    own = scores[np.arange(len(owner)), best[owner]].astype(np.float64)
    most = np.full(texts, -np.inf)
    starts = np.cumsum(lengths) - lengths
    full = lengths > 0
    for j in range(k):
        gain = np.cumsum(scores[:, j] - own)
        before = np.concatenate(([0.0], gain[:-1]))
        # Running minimum within each text: texts are set apart by an offset larger than any sum.
        apart = owner * (2.0 * (np.abs(gain).max(initial=0.0) + 1.0))
        low = np.minimum.accumulate(before - apart) + apart
        top = np.maximum.reduceat(gain - low, starts[full]) if full.any() else np.zeros(0)
        most[full] = np.maximum(most[full], np.where(best[full] == j, 0.0, top))
    return np.where(most <= switch / 2, best, -1)


def label_words(lists: pa.ListArray, words: Words, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, letters, label) of each word of the texts, given as lists of words; label -1 where no language is possible."""
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    # Each distinct word becomes a Python string once a batch.
    flat = lists.flatten().dictionary_encode()
    codes = words.codes(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
    letters = words.letters[codes]
    scores = words.scores[codes]
    label = np.full(len(codes), -1, np.int64)
    if not scores.size:
        return owner, letters, label
    known = ~np.isnan(scores[:, 0])
    rows, of = np.maximum(scores[known], np.float32(-1e4)), owner[known]
    lengths = np.bincount(of, minlength=len(lists))
    whole = single_language(rows, lengths, switch)
    out = whole[of]
    hard = whole[of] < 0
    if hard.any():
        out[hard] = viterbi(rows[hard], np.where(whole < 0, lengths, 0), switch)
    label[known] = out
    return owner, letters, label


def spans(text: str, model: dict, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """(first word, last word, language) of a text's spans."""
    import regex

    _, _, label = label_words(pa.array([regex.findall(WORD, text.lower())], pa.list_(pa.string())), Words(model), switch)
    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1), len(label)]
    return [(int(a), int(b) - 1, model["languages"][label[a]] if label[a] >= 0 else "und") for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def main_languages(lists: pa.ListArray, words: Words, switch: float = SWITCH):
    """(number of the main language, the number of languages for und; its share of the letters; spans) of some texts at a time.

    As many texts at a time as STEP allows, or one longer than that.
    """
    k = len(words.model["languages"])
    upto = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    step = max(1, STEP // max(1, k))
    at = 0
    while at < len(lists):
        m = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, side="right")) - at)
        owner, letters, label = label_words(lists.slice(at, m), words, switch)
        weight = np.bincount(owner * (k + 1) + np.where(label < 0, k, label), letters, m * (k + 1)).reshape(m, k + 1)
        total = weight.sum(1)
        top = weight[:, :k].argmax(1) if k else np.zeros(m, np.int64)
        share = np.divide(weight[np.arange(m), top] if k else np.zeros(m), total, out=np.zeros(m), where=total > 0)
        edges = np.concatenate(([True], (owner[1:] != owner[:-1]) | (label[1:] != label[:-1]))) if len(owner) else np.zeros(0, bool)
        best = np.where(share > 0, top, np.where(total > 0, words.model["main"], k)) if k else np.full(m, k)
        yield best, share, np.bincount(owner[edges], minlength=m)
        at += m


def predict(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * BUCKETS bytes a language

    def run(batches):
        words = Words(shared.value)
        names = np.array([*words.model["languages"], "und"], dtype=object)
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for top, share, n_spans in main_languages(batch.column("words"), words, switch):
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(top)), pa.array(names[top], pa.string()), pa.array(share, pa.float64()), pa.array(n_spans, pa.int64())], names=["doc_id", "lang_pred", "score", "n_spans"])
                at += len(top)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), letter_words(F.col("text")).alias("words"))
    return rows.mapInArrow(released(run), "doc_id bigint, lang_pred string, score double, n_spans bigint")


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_spans."""
    model = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "n_spans")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the texts that ``predict`` calls ``und``: those without letters.

    The decision is made beside the row, by an Arrow function of the text's words, so that texts are neither joined nor shuffled.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches):
        words = Words(shared.value)
        for lists in batches:
            yield pa.array(np.concatenate([np.zeros(0, bool), *(top < len(words.model["languages"]) for top, _, _ in main_languages(lists, words))]), pa.bool_())

    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(labelled)(batches)

    return docs.where(identified(letter_words(F.col("text"))))
