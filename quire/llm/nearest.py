"""Maximum inner product search with score-aware (anisotropic) quantisation.

Index: vectors are cut into parts of two dimensions, each quantised to one of 16 centres (four bits). Centres are fitted on
a sample of at most SAMPLE vectors: k-means per part, then rounds that minimise the anisotropic loss, in which the part of
a residual that is parallel to its vector costs PARALLEL times the rest, as it changes inner products with near vectors the most. In a round,
codes are improved part by part with the others held, then all centres are solved for at once (least squares).

Search: the index is dealt into blocks of at most BLOCK vectors, the queries into blocks of QUERIES; each pair of blocks is
one task's unit of work (a stated query set against all rows, in blocks). A query's table holds the inner products with all centres; a
scan adds up table entries by code; the RERANK best of a block, and all others that the scan's error could lift among the
best, are scored exactly, in double precision, on the vectors stored in the block, and the block's best k go on to a
merge by rank.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; ties go to the
smaller vec_id; rows that share a vec_id are each a candidate, and none is a candidate of the query with that id;
an empty table gives an empty result; a query with fewer candidates than k gets all; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Staging

SAMPLE = 4_000
CENTRES = 16
PART = 2
PARALLEL = 4.0
ROUNDS = 3
BLOCK = 16_384
QUERIES = 4_096
#: Queries whose tables a task holds at once (CENTRES ** 2 numbers for two parts each).
TABLES = 256
RERANK = 200
#: Standard deviations of the scan's error beyond which it isn't made up for.
REACH = 3.0
K = 20
EVERY = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as arrays of doubles, those that can take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def _code(x: np.ndarray, centres: np.ndarray, start: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
    """Codes of the rows of x (n, parts): the nearest centres, then improved part by part under the anisotropic loss."""
    n, d = x.shape
    parts = d // PART
    xs = x.reshape(n, parts, PART)
    codes = start
    if codes is None:
        codes = np.empty((n, parts), np.uint8)
        for j in range(parts):
            codes[:, j] = ((xs[:, j, None, :] - centres[j][None]) ** 2).sum(2).argmin(1)
    norm = np.sqrt((x * x).sum(1))
    unit = (x / norm[:, None]).reshape(n, parts, PART)
    along = ((xs - centres[np.arange(parts)[None], codes]) * unit).sum(2)  # parallel part of the residual, by part
    total = along.sum(1)
    for _ in range(rounds):
        for j in range(parts):
            r = xs[:, j, None, :] - centres[j][None]
            own = (r * unit[:, j, None, :]).sum(2)
            loss = (r * r).sum(2) + (PARALLEL - 1) * ((total - along[:, j])[:, None] + own) ** 2
            best = loss.argmin(1)
            codes[:, j] = best
            new = own[np.arange(n), best]
            total += new - along[:, j]
            along[:, j] = new
    return codes


def fit(sample: np.ndarray, seed: int = 7) -> np.ndarray:
    """Centres (parts, CENTRES, PART) from a sample of vectors."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    parts = d // PART
    xs = sample.reshape(n, parts, PART)
    centres = np.empty((parts, CENTRES, PART))
    for j in range(parts):
        c = xs[rng.choice(n, CENTRES, replace=n < CENTRES), j].copy()
        for _ in range(8):
            near = ((xs[:, j, None, :] - c[None]) ** 2).sum(2).argmin(1)
            count = np.bincount(near, minlength=CENTRES)
            for p in range(PART):
                s = np.bincount(near, xs[:, j, p], CENTRES)
                c[:, p] = np.where(count > 0, s / np.maximum(count, 1), c[:, p])
        centres[j] = c
    codes = None
    unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
    for _ in range(ROUNDS):
        codes = _code(sample, centres, codes)
        # All centres at once: minimise |x - B c|^2 + (PARALLEL - 1) (u . (x - B c))^2 over the sample.
        size = parts * CENTRES * PART
        at = (np.arange(parts)[None, :, None] * CENTRES + codes[:, :, None]) * PART + np.arange(PART)
        at = at.reshape(n, d)
        lhs = np.zeros((size, size))
        pull = np.zeros((n, size), np.float32)
        np.put_along_axis(pull, at, unit.astype(np.float32), 1)
        lhs += (PARALLEL - 1) * (pull.T @ pull)
        lhs[np.arange(size), np.arange(size)] += np.bincount(at.ravel(), minlength=size) + 1e-3
        dot = (unit * sample).sum(1)
        rhs = np.bincount(at.ravel(), sample.ravel(), size) + (PARALLEL - 1) * np.bincount(at.ravel(), (unit * dot[:, None]).ravel(), size)
        rhs += 1e-3 * centres.ravel()
        centres = np.linalg.solve(lhs, rhs).reshape(parts, CENTRES, PART)
    return centres


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, the earlier first among equals at the edge."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = -np.partition(-scores, k - 1)[k - 1]
    over = np.flatnonzero(scores > edge)
    return np.concatenate((over, np.flatnonzero(scores == edge)[: k - len(over)]))


def search_block(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int, rerank: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of each query's best k in a block.

    Equal vectors stand once, so that very many copies of one don't crowd out the rest: vector i has the ids
    ids[at[i]:at[i + 1]], ascending.
    """
    parts = centres.shape[0]
    tables = np.einsum("qjp,jcp->qjc", queries.reshape(len(queries), parts, PART), centres).astype(np.float32)
    # Two four-bit codes make a byte: one table look-up for two parts.
    if parts % 2:
        codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), axis=1)
        tables = np.concatenate((tables, np.zeros((len(tables), 1, CENTRES), np.float32)), axis=1)
    pairs = np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T)
    tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)
    out = []
    for i in range(len(queries)):
        score = tables[i, 0][pairs[0]]
        for j in range(1, len(pairs)):
            score += tables[i, j][pairs[j]]
        near = _best(score, rerank)
        exact = inner(vectors[near], queries[i])
        if len(near) < len(score) and len(near) >= k:
            # What the scan's error, as these show it, could lift to the k-th best is scored exactly as well: all of a
            # dense group of vectors, whose codes are alike.
            error = exact - score[near]
            reach = -np.partition(-exact, k - 1)[k - 1] - max(error.mean(), 0.0) - REACH * error.std()
            more = np.setdiff1d(np.flatnonzero(score >= reach), near)
            near, exact = np.concatenate((near, more)), np.concatenate((exact, inner(vectors[more], queries[i])))
        # The best k + 1 vectors and what ties with the last, each with its smallest k + 1 ids besides the query's own.
        if len(near) > k + 1:
            edge = -np.partition(-exact, k)[k]
            near, exact = near[exact >= edge], exact[exact >= edge]
        got = [own[own != query_ids[i]][: k + 1] for own in (ids[at[v] : at[v + 1]] for v in near)]
        flat, value = np.concatenate(got), np.repeat(exact, [len(g) for g in got])
        for o in np.lexsort((flat, -value))[:k]:
            out.append((int(query_ids[i]), int(flat[o]), float(value[o])))
    return out


def inner(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of the components."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * q[j]
    return total


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    stage = Staging(spark, "nearest")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = stage.table(usable(vectors), "usable")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    d, n = common["d"], common["count"]
    rows = rows.where(F.size("v") == d)
    wide = d + (-d) % PART
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - d)))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    centres = fit(pad(np.array(got["v"].tolist(), float)))

    def encode(batches):
        for pdf in batches:
            x = pad(np.array(pdf["v"].tolist(), float).reshape(len(pdf), d))
            yield pd.DataFrame({"block": pdf["block"], "vec_id": pdf["vec_id"], "code": [c.tobytes() for c in _code(x, centres)], "v": [r.tobytes() for r in x]})

    blocks = max(1, -(-n // BLOCK))
    index = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).mapInPandas(encode, "block int, vec_id bigint, code binary, v binary")
    index = stage.table(index, "index")
    asked = rows.where(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-(n // every + 1) // QUERIES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(query_blocks)).cast("int"))
    # Each block of either side is sent once for each block of the other: rows times blocks, never rows times rows.
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, of_index: pd.DataFrame, of_queries: pd.DataFrame) -> pd.DataFrame:
        if of_index.empty or of_queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        which, _ = pd.factorize(of_index["v"])
        of_index = of_index.iloc[np.lexsort((of_index["vec_id"], which))]
        at = np.concatenate(([0], np.cumsum(np.bincount(which))))
        one = of_index.iloc[at[:-1]]
        codes = np.frombuffer(b"".join(one["code"]), np.uint8).reshape(len(one), -1)
        x = np.frombuffer(b"".join(one["v"]), float).reshape(len(one), -1)
        q = pad(np.array(of_queries["v"].tolist(), float))
        ids, asked_ids, found = of_index["vec_id"].to_numpy(), of_queries["vec_id"].to_numpy(), []
        for i in range(0, len(q), TABLES):
            found += search_block(ids, at, codes, x, asked_ids[i : i + TABLES], q[i : i + TABLES], centres, k, rerank)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
