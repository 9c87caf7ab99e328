"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library, each on the windows of its own class's texts. Toxic texts are ordinary ones
for the most part, so the trained segments of both classes largely agree, and which of these one dictionary happens to
hold says nothing about a window. Therefore what both classes have is held once, in a part that both dictionaries share,
and of either trained dictionary the runs of bytes stay that the other class lacks: every GRAM bytes of them stand in TIMES as many texts of the
own class, with EVIDENCE. Both dictionaries are laid out alike (filled up with zero bytes), so that the shared part costs the same in both.

A window of a text is compressed with either dictionary; the bytes that the toxic one saves are its distance. A text's
distances (the largest three, sums and counts beyond a threshold, means, the number of windows) go through a logistic
function fitted on the training texts, which is the score.

Learning uses at most SAMPLE labelled training rows of either class (crc32 of doc_id's text mod 3 not 1), those with the smallest hash
of doc_id, and at most the first LONGEST characters of each; of near copies among them one counts. Scoring uses the text alone,
all of it, window by window.

Defined results: null, empty and blank texts are scored as one empty window; without training rows of both classes
every score is 0; a null doc_id is not held out and no training row; repeated rows get equal scores; very long texts are scored
whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import released
from quire.llm.language_id import held_out

SAMPLE = 3_000
LONGEST = 100_000
#: Words of a window; bytes of the shared part and of each trained dictionary.
WINDOW, COMMON, TRAINED = 12, 4_000, 16_384
LEVEL = 9
#: Length of the runs that tell the classes apart: such a run stands in this many more texts of its class, with this much evidence (in nats).
GRAM, TIMES, EVIDENCE = 5, 12.0, 20.0
#: Bytes saved from which a window counts.
SAVED = 3
CUT = 0.7


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, max(1, len(words)), WINDOW)]


def _without_copies(texts: list[str]) -> list[int]:
    """Numbers of the texts, one of each group of (near) copies: those with the same smallest hash of three words."""
    import xxhash

    seen, out = set(), []
    for i, text in enumerate(texts):
        ws = text.lower().split()
        key = min((xxhash.xxh64_intdigest(" ".join(ws[j : j + 3]).encode("utf-8", "replace")) for j in range(max(1, len(ws) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains on ``samples``, the best segments last; b"" where these are too few for it."""
    import zstandard

    try:
        made = zstandard.train_dictionary(size, samples, k=32, d=6)
    except zstandard.ZstdError:
        return b""
    return made.as_bytes()[-(size - min(size // 4, 700)) :]  # without the tables at its head


def _runs(counts: Counter, windows_of: list[list[bytes]]) -> Counter:
    """Adds to ``counts`` in how many texts each run of GRAM bytes stands."""
    for win in windows_of:
        counts.update({w[i : i + GRAM] for w in win for i in range(len(w) - GRAM + 1)})
    return counts


def own_part(trained: bytes, own: Counter, n_own: int, other: Counter, n_other: int) -> bytes:
    """The runs of a trained dictionary that the other class lacks, each once, the best last."""
    stays = np.zeros(len(trained), bool)
    for i in range(len(trained) - GRAM + 1):
        x = trained[i : i + GRAM]
        n = own[x]
        gain = math.log((n + 0.5) / (n_own + 1) * (n_other + 1) / (other[x] + 0.5))
        if n >= max(4, 0.01 * n_own) and gain > math.log(TIMES) and n * gain > EVIDENCE:
            stays[i : i + GRAM] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], stays.astype(np.int8), [0])))).reshape(-1, 2)
    held: list[bytes] = []
    for run in sorted({trained[a:b] for a, b in edges}, key=lambda r: (-len(r), r)):
        if not any(run in x for x in held):
            held.append(run)
    return b"".join(reversed(held))


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary content from the windows of each class's texts, equally laid out."""
    flat = lambda x: [w for win in x for w in win]
    in_toxic, in_ordinary = _runs(Counter(), toxic), _runs(Counter(), ordinary)
    a = own_part(_trained(flat(toxic), TRAINED), in_toxic, len(toxic), in_ordinary, len(ordinary))
    b = own_part(_trained(flat(ordinary), TRAINED), in_ordinary, len(ordinary), in_toxic, len(toxic))
    common = _trained(flat(ordinary), COMMON)
    size = max(len(a), len(b))
    return common + a.rjust(size, b"\0"), common + b.rjust(size, b"\0")


def _compressor(content: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=80, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def features(win: list[bytes], toxic, ordinary) -> list[float]:
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in win], float)
    top = np.zeros(3)
    order = np.sort(saved)[::-1][:3]
    top[: len(order)] = order
    beyond = np.maximum(saved - SAVED + 1, 0).sum()
    return [*top, math.sqrt(beyond), math.log(len(win)), beyond / len(win), math.sqrt((saved >= SAVED).sum()), saved.mean()]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights with the constant first) by Newton's method; the rarer class weighs more, by the root of the ratio."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / deviation]
    each = np.where(y == 1, math.sqrt((y == 0).sum() / max(1, (y == 1).sum())), 1.0)
    w = np.zeros(a.shape[1])
    ridge = penalty * np.r_[1e-3, np.ones(len(w) - 1)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (each * (p - y)) + ridge * w
        hess = (a * (each * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, deviation, w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The classifier from labelled documents; bounded by ``sample`` texts of either class."""
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    pick = lambda c: rows.where(F.col("toxic") == c).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("q_id"), F.col("toxic").alias("q_toxic"))
    texts = docs.select(F.col("doc_id").alias("q_doc"), F.substring(F.coalesce("text", F.lit("")), 1, LONGEST).alias("q_text"))
    # The sample is bounded by its parameter, so it may be broadcast and its texts fetched.
    got = texts.join(F.broadcast(chosen), F.col("q_doc") == F.col("q_id")).select("q_doc", "q_toxic", "q_text").toPandas()
    got = got.sort_values(["q_doc", "q_toxic", "q_text"])
    keep = _without_copies(got["q_text"].tolist())
    win, y = [windows(t) for t in got["q_text"].iloc[keep]], got["q_toxic"].to_numpy()[keep]
    if not (y == 1).any() or not (y == 0).any():
        return None
    toxic, ordinary = train_dictionaries([w for w, c in zip(win, y, strict=True) if c == 1], [w for w, c in zip(win, y, strict=True) if c == 0])
    a, b = _compressor(toxic), _compressor(ordinary)
    mean, deviation, weights = fit_logistic(np.array([features(w, a, b) for w in win]), y)
    return {"toxic": toxic, "ordinary": ordinary, "mean": mean, "deviation": deviation, "weights": weights}


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels)

    def score(batches):
        a, b = (_compressor(model["toxic"]), _compressor(model["ordinary"])) if model else (None, None)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if model:
                x = np.array([features(windows(t or ""), a, b) for t in texts]).reshape(len(texts), -1)
                z = np.c_[np.ones(len(x)), (x - model["mean"]) / model["deviation"]] @ model["weights"] if len(x) else np.zeros(0)
                out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                out = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(released(score), "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))
