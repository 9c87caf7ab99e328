"""MinHash near-dedup with bottom-k sketches.

Words are runs of other than ASCII white space, A-Z in lower case; a document's set holds the 64-bit hashes of its distinct
shingles. Two documents are linked when 100 * |intersection| >= 80 * |union| on the full sets; groups are the connected
components of these links.

Method
1. Documents with equal sets are one node (named by 128 bits of its set), so exact copies cost nothing further.
2. A node's sketch: the k smallest hashes of its set, from one hash function.
3. Inverted lists of the retained values. Linked nodes share at least m = min(ceil(0.8 n), k / 2) sketch values (for sets
   within k surely; beyond it but for about one link in a million at the very threshold, with k = 48). So it is enough to
   list each node under the k - m + 1 values of its sketch that the fewest nodes retain: a passage that very many
   documents share has long lists, but no node needs them.
4. Overlaps, in rounds. In every list that still holds several components, each node is paired with the list's most
   typical node (whose retained values are the most common): n - 1 pairs for n nodes. After these rounds, nodes of
   different components that share a list of at most HOT_LIST nodes are paired in full. Pairs are filtered by the
   sizes of the sets, then by the overlap of the sketches and the union-sketch estimate, then verified on full sets. A
   pair within one component changes nothing and is not tried.
5. Longer lists (a large group of near copies and its stragglers, or a passage that very many texts share):
   - Each node a is reduced to its difference d(a) from the list's most typical node, its hub h: the shingles that one of the two
     has and the other lacks. |d(a)| alone decides whether a and h are linked. As d(a) and d(b) differ exactly where
     a and b do, a and b are linked when |d(a)| + |d(b)| - 2 |d(a) & d(b)| <= (|a| + |b|) / 9, that is, when the differences
     share at least t(a, b) = e(a) + e(b) shingles, with e(a) = |d(a)| / 2 - |a| / 18. Where t <= 0, both are linked with h.
   - So only nodes that aren't linked with h look for others, by a prefix filter on the differences: sets that share t elements share
     one among the first |d| - t + 1 of each, in one order for all: the shingles that h lacks by rarity (a shingle that no
     other node adds uses up a place, but meets nobody), then those that h has. Nodes meet by the straggler's class of e, so that t is known before they do.
     Far from the hub t is large, and a straggler's own edits, which nobody shares, use all places up. Before a pair
     is made, bitmaps of both differences bound what they share: no more than the bits that both set, and the elements
     of either that fell on one bit.
   - Nodes whose difference is not small (over half of the hub) are joined on full sets by a prefix filter that knows
     both sizes. Two linked nodes are both in the first join (up to the size of the hub) or both in the second.
6. Full sets are computed again from the texts, for the nodes concerned only.

``drop_near_copies`` keeps of each group the row with the smallest doc_id, null last, then the smallest digest of its text; rows
are told apart by both, and of wholly repeated ones one stays.

Defined results: null and empty texts and texts without words have no shingles, are linked with nothing and are kept;
texts with fewer words than the width have their whole sequence as the one shingle; wholly repeated rows have one
component and equal marks; a null doc_id never is the smallest unless all of its component are null; empty tables give
empty results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import wordbytes as wb
from quire.llm.common import Staging, checked_broadcast, released

SKETCH = 48
THRESHOLD = 80
#: Rounds of pairing with the most typical node before all pairs of different components are tried.
ROUNDS = 2
#: Lists up to this length are paired in full.
HOT_LIST = 64
#: Shingles that a pair of long lists must share among its rarest.
SHARE = 3
#: Ratio between the bounds of a size class.
CLASS = 1.02
#: Width of a class of e, as a part of the hub's size.
CLASSES = 50
#: Words of 64 bits in the bitmap of a difference.
BITMAP = 16
#: Bytes of text whose shingles are made at once: some 60 times as much memory.
STEP = 1 << 20


def _steps(column: pa.Array):
    """Slices of a text column of about STEP bytes each, at least one text."""
    sizes = wb.text_bytes(column)[1]
    at, n = 0, len(sizes) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + STEP, side="right")) - 1)
        yield at, column.slice(at, upto - at)
        at = upto


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the sorted distinct shingle hashes of each text."""
    data, offsets = wb.text_bytes(column)
    data = wb.lower_table()[data]
    start, end, owner = wb.word_spans(data, offsets, wb.not_blank())
    values, of = wb.shingle_hashes(wb.word_hashes(data, start, end), owner, len(column), width)
    return np.searchsorted(of, np.arange(len(column) + 1)), values


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _nodes(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """16 bytes that name each set; null for the empty set."""
    n = np.diff(bounds).astype(np.uint64)
    a = wb.mix(_sums(values, bounds) + n)
    b = wb.mix(_sums(wb.mix(values ^ np.uint64(0xE7037ED1A0B428DB)), bounds) + n)
    raw = np.stack((a, b), axis=1).tobytes()
    return pa.array([raw[i * 16 : i * 16 + 16] if n[i] else None for i in range(len(n))], pa.binary())


def _lists(values: np.ndarray, bounds: np.ndarray, most: int | None = None) -> pa.Array:
    begin, end = bounds[:-1], bounds[1:]
    if most is not None:
        end = np.minimum(end, begin + most)
        size = end - begin
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
        values, bounds = values[at], np.concatenate(([0], np.cumsum(size)))
    return pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(values.view(np.int64)))


def text_digest(docs: DataFrame) -> Column:
    return F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))


def sketches(docs: DataFrame, width: int, digest: bool = False) -> DataFrame:
    """(doc_id, digest, n_shingles, node, sketch) of each document; the digest of its text is null unless asked for."""

    def make(batches):
        for batch in batches:
            for at, texts in _steps(batch.column("text")):
                bounds, values = _shingles(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), batch.column("digest").slice(at, len(texts)), pa.array(np.diff(bounds), pa.int64()), _nodes(bounds, values), _lists(values, bounds, SKETCH)],
                    names=["doc_id", "digest", "n_shingles", "node", "sketch"],
                )

    named = (text_digest(docs) if digest else F.lit(None).cast("binary")).alias("digest")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), named, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(make), "doc_id bigint, digest binary, n_shingles bigint, node binary, sketch array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, members) of each document with shingles."""

    def make(batches):
        for batch in batches:
            for _, texts in _steps(batch.column("text")):
                bounds, values = _shingles(texts, width)
                yield pa.RecordBatch.from_arrays([_nodes(bounds, values), _lists(values, bounds)], names=["node", "members"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(make), "node binary, members array<bigint>").where("node is not null")


def components(edges: DataFrame, stage: Staging) -> DataFrame:
    """(node, label): the smallest node of each component of ``edges`` (a, b), for the nodes that have edges.

    Each round gives every node the smallest label among its neighbours and itself, then contracts the edges; what is left
    shrinks at least by half. Only counts reach the driver.
    """
    labels = None
    edges = stage.table(edges.where("a <> b").distinct(), "edges")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "low")
        if labels is None:
            labels = low.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(low, labels["label"] == low["a"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = stage.table(labels, "labels")
        left = edges.join(low.select("a", F.col("to").alias("x")), "a").join(low.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = stage.table(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _keys(nodes: DataFrame, stage: Staging) -> DataFrame:
    """(v, node, n, pop): each node under the rarest of its retained values that other nodes retain too.

    Values that one node alone retains come first in the order of rarity and use up places, but need no list.
    """
    posting = nodes.select("node", "n", F.explode("sketch").alias("v"))
    lists = stage.table(posting.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "lists")
    shared = posting.join(lists, "v")
    own = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("x"), F.sum(F.log2("df")).alias("pop"))
    k = F.least(F.col("n"), F.lit(SKETCH))
    m = F.least(F.ceil(F.col("n") * THRESHOLD / 100), F.lit(SKETCH // 2))
    places = (k - m + 1) - (k - F.size("x"))
    own = own.where(places > 0).select("node", "n", "pop", F.explode(F.slice("x", F.lit(1), places.cast("int"))).alias("x"))
    keys = stage.table(own.select("node", "n", "pop", F.col("x.v").alias("v")), "keys")
    stage.drop(lists)
    return keys


def _similar_sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def _estimate(a: Column, b: Column) -> Column:
    """Jaccard index estimated from the k smallest of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, stage: Staging) -> DataFrame:
    """(node, members) for the wanted nodes, from the text of one document of each."""
    ids = stage.table(nodes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("q_id")), "wanted")
    texts = docs.select("doc_id", "text").join(checked_broadcast(ids.where("q_id is not null")), F.col("doc_id") == F.col("q_id"), "left_semi")
    if not ids.where("q_id is null").isEmpty():  # nodes whose documents all lack an id are found among the rows without one
        texts = texts.unionByName(docs.where("doc_id is null").select("doc_id", "text"))
    sets = full_sets(texts, width)
    return stage.table(sets.groupBy("node").agg(F.first("members").alias("members")), "sets", codec="uncompressed")


def _links(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _around_hubs(hot: DataFrame, sets: DataFrame, stage: Staging) -> DataFrame:
    """(hub, node, label, n, nh, d, added, lacks): each node against the most typical node of each of its lists.

    added, lacks: the shingles that the node has and the hub lacks, and the reverse; null where these are more than the hub has.
    """
    hubs = hot.groupBy("v").agg(F.max(F.struct("pop", "node"))["node"].alias("hub"))
    met = stage.table(hot.join(stage.table(hubs, "hubs"), "v").select("hub", "node", "label").distinct(), "met")
    both = met.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("members").alias("of_hub")), "hub")
    out = both.select("hub", "node", "label", F.size("members").alias("n"), F.size("of_hub").alias("nh"), F.array_except("members", "of_hub").alias("added"), F.array_except("of_hub", "members").alias("lacks"))
    out = out.withColumn("d", F.size("added") + F.size("lacks"))
    out = out.withColumns({k: F.when(F.col("d") <= F.col("nh"), F.col(k)) for k in ("added", "lacks")})
    return stage.table(out, "around", codec="uncompressed")


def _links_by_difference(around: DataFrame, stage: Staging) -> DataFrame:
    """The links (a, b) between nodes of different labels whose differences from a common hub are no larger than the hub.

    Links with the hub itself, which join all nodes near it, come from the size of the difference.
    """
    with_hub = F.col("d") * (100 + THRESHOLD) <= (F.col("n") + F.col("nh")) * (100 - THRESHOLD)
    direct = around.where(with_hub & (F.col("node") != F.col("hub"))).select(*_links(F.col("node"), F.col("hub")))
    near = around.where("added is not null")
    if near.where(~with_hub).isEmpty():
        return direct.distinct()
    posting = near.select("hub", "node", F.explode("added").alias("s"))
    lists = stage.table(posting.groupBy("hub", "s").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    own = posting.join(lists, ["hub", "s"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("df", "s")))["s"].alias("x"))
    part = (100 - THRESHOLD) / (100 + THRESHOLD)
    nears = near.select("hub", "node", "label", "n", "d", "added", "lacks", (~with_hub).alias("stray"), (F.col("d") / 2 - F.col("n") * part / 2).alias("e"), F.greatest(F.lit(1.0), F.col("nh") / CLASSES).alias("w"))
    own = nears.join(own, ["hub", "node"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<bigint>")))
    bits = [f"b{i}" for i in range(BITMAP)]
    bitmap = "aggregate(concat(added, lacks), 0L, (z, s) -> z | if(pmod(shiftright(s, 6), {}) = {}, shiftleft(1L, cast(s & 63 as int)), 0L))"
    own = own.withColumns({b: F.expr(bitmap.format(BITMAP, i)) for i, b in enumerate(bits)})
    own = own.withColumn("fallen", F.col("d") - sum(F.bit_count(b) for b in bits))
    own = own.withColumn("single", F.size("added") - F.size("x")).withColumn("x", F.concat("x", F.sort_array("lacks"))).drop("added", "lacks")
    own = stage.table(own.withColumn("c", F.floor(F.col("e") / F.col("w"))), "own", codec="uncompressed")
    # Per hub: the lowest class of any node, and the classes of strays (at most about CLASSES / 2). Only these are looked up.
    classes = own.groupBy("hub").agg(F.min("c").alias("low"), F.collect_set(F.when(F.col("stray"), F.col("c"))).alias("classes"))
    own = own.join(checked_broadcast(stage.table(classes, "classes")), "hub")
    reach = F.col("n") * (part * 100 / THRESHOLD) + 1  # how far the e of two linked nodes can lie apart
    first, last = (F.floor((F.col("e") + x) / F.col("w")) for x in (-reach, reach))

    def keys(rows: DataFrame, other: Column) -> DataFrame:
        """``rows`` under all shingles that they may first share with nodes of class ``other`` or a higher one."""
        need = F.greatest(F.lit(1), F.ceil(F.col("e") + other * F.col("w") - 1e-6))
        places = (F.col("d") - need + 1 - F.col("single")).cast("int")
        at = rows.where(places > 0).select("hub", "node", "label", "n", "d", "e", "w", *bits, "fallen", "c", "cx", "single", F.posexplode(F.slice("x", F.lit(1), places)).alias("i", "s"))
        # rest: how many of the difference come at this place or later; upto: the highest class for which the place is needed.
        at = at.withColumn("rest", F.col("d") - F.col("single") - F.col("i"))
        return at.withColumn("upto", F.floor((F.col("rest") - F.col("e") + 1e-6) / F.col("w"))).drop("single", "i", "e", "w")

    # A straggler is listed once a place, under its own class; the others under the classes of stragglers within their reach.
    x = keys(own.where("stray").withColumn("cx", F.col("c")), F.greatest(first, "low")).alias("x")
    y = keys(own.withColumn("cx", F.explode(F.filter("classes", lambda o: o.between(first, last)))), F.col("cx")).alias("y")
    met = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.cx") == F.col("y.cx")) & (F.col("x.upto") >= F.col("y.c"))
    size = F.col("x.n") + F.col("y.n")
    fits = (F.col("x.label") != F.col("y.label")) & _similar_sizes(F.col("x.n"), F.col("y.n"))
    both_set = sum(F.bit_count(F.col(f"x.{b}").bitwiseAND(F.col(f"y.{b}"))) for b in bits) + F.least("x.fallen", "y.fallen")
    for most in (F.least("x.rest", "y.rest"), both_set):
        fits &= (F.col("x.d") + F.col("y.d") - 2 * most) * (100 + THRESHOLD) <= size * (100 - THRESHOLD)
    pairs = stage.table(x.join(y, met & fits).select(F.col("x.hub").alias("hub"), *_links(F.col("x.node"), F.col("y.node"))).distinct(), "near-hub")
    side = lambda k: near.select("hub", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.concat("added", "lacks").alias(f"d{k}"))
    both = pairs.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    linked = both.where(apart * (100 + THRESHOLD) <= (F.col("na") + F.col("nb")) * (100 - THRESHOLD)).select("a", "b")
    return direct.unionByName(linked).distinct()


def _far_pairs(who: DataFrame, sets: DataFrame, stage: Staging) -> DataFrame:
    """Candidate pairs (a, b) of different labels among ``who`` (node, n, label), complete for the threshold."""
    posting = sets.join(who, "node").select("node", "n", "label", F.explode("members").alias("s"))
    lists = stage.table(posting.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    own = posting.join(lists, "s").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    size_class = F.floor(F.log("n") / float(np.log(CLASS))).cast("int")
    steps = int(np.ceil(np.log(100 / THRESHOLD) / np.log(CLASS)))
    own = stage.table(own.withColumn("k", size_class), "own")
    share = THRESHOLD / (100 + THRESHOLD)

    def keys(small: bool) -> DataFrame:
        at = own.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        other = F.col("k") + F.col("d") if small else F.col("k") - F.col("d")
        low = F.pow(F.lit(CLASS), other.cast("double")) * (1 - 1e-9)
        least = F.greatest(F.col("n").cast("double"), low) if small else low
        need = F.ceil((F.col("n") + least) * share - 1e-6)
        places = F.col("n") - need + 1 - (F.col("n") - F.size("x"))
        at = at.withColumn("other", other).where(places > 0).withColumn("single", F.col("n") - F.size("x"))
        at = at.select("node", "n", "label", "k", "other", "single", F.slice("x.s", F.lit(1), (places + (SHARE - 1)).cast("int")).alias("all"), F.posexplode(F.slice("x.s", F.lit(1), places.cast("int"))).alias("i", "s"))
        ks, kl = ("k", "other") if small else ("other", "k")
        # rest: how many of the set come at this place or later; before, after: the listed shingles around this place.
        rest = F.col("n") - F.col("single") - F.col("i")
        return at.select("node", "n", "label", F.col(ks).alias("ks"), F.col(kl).alias("kl"), "s", rest.alias("rest"), F.slice("all", F.lit(1), F.col("i")).alias("before"), F.slice("all", F.col("i") + 2, F.size("all")).alias("after"))

    x, y = keys(True).alias("x"), keys(False).alias("y")
    met = (F.col("x.s") == F.col("y.s")) & (F.col("x.ks") == F.col("y.ks")) & (F.col("x.kl") == F.col("y.kl"))
    fits = (F.col("x.n") <= F.col("y.n")) & (F.col("x.label") != F.col("y.label")) & _similar_sizes(F.col("x.n"), F.col("y.n"))
    # A pair comes once, at the first shingle that it shares, and only if enough of either set is left from there on.
    fits &= F.least("x.rest", "y.rest") * (100 + THRESHOLD) >= (F.col("x.n") + F.col("y.n")) * THRESHOLD
    fits &= ~F.arrays_overlap("x.before", "y.before")
    few = (F.col("x.n") + F.col("y.n")) * THRESHOLD < SHARE * (100 + THRESHOLD)
    fits &= few | (F.size(F.array_intersect("x.after", "y.after")) >= SHARE - 1)
    return x.join(y, met & fits).select(*_links(F.col("x.node"), F.col("y.node")))


def _hot_links(hot: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, stage: Staging) -> DataFrame:
    """The links (a, b) between nodes of different labels that share a long list. hot: (v, node, n, pop, label)."""
    sets = _sets_of(hot.select("node").distinct(), nodes, docs, width, stage)
    around = _around_hubs(hot, sets, stage)
    links = stage.table(_links_by_difference(around, stage), "hot-links")
    far = stage.table(around.where(F.col("d") * 2 > F.col("nh")).select("node", "n", "label").distinct(), "far")
    if not far.isEmpty():
        pairs = stage.table(_far_pairs(far, sets, stage).distinct(), "far-pairs")
        links = links.unionByName(_verified(pairs, sets))
    return links


def _likely(pairs: DataFrame, nodes: DataFrame, stage: Staging) -> DataFrame:
    """The pairs (a, b) that the overlap of their sketches and the union-sketch estimate leave."""
    side = nodes.select("node", "n", "sketch")
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
    both = both.join(side.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    need = F.least(F.ceil(F.greatest("na", "nb") * THRESHOLD / 100), F.lit(SKETCH // 2))
    return stage.table(both.where((overlap >= need) & (_estimate(F.col("sa"), F.col("sb")) >= 0.5)).select("a", "b"), "likely")


def _linked(likely: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, stage: Staging) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wanted = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(wanted, nodes, docs, width, stage)
    links = stage.table(_verified(likely, sets), "links")
    stage.drop(sets)
    return links


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("members").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(common * 100 >= union * THRESHOLD).select("a", "b")


def near_classes(docs: DataFrame, width: int, stage: Staging, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, node) of each row, and (q_node, label, component_id) of each distinct set."""
    rows = stage.table(sketches(docs, width, digest), "sketches")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stage.table(nodes, "nodes")
    whole_rows, rows = rows, stage.table(rows.drop("sketch"), "rows")
    stage.drop(whole_rows)
    keys = _keys(nodes, stage)
    links = None
    labels = None
    used = None
    for turn in range(ROUNDS + 1):
        if labels is None:
            at = keys.withColumn("label", F.col("node"))
        else:
            at = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            # Only lists that still hold several components can add anything.
            mixed = at.groupBy("v").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("v")
            at = at.join(mixed, "v", "left_semi")
        at = stage.table(at.select("v", "node", "n", "pop", "label"), "at")
        if turn < ROUNDS:
            typical = F.max(F.struct("pop", "node", "n", "label"))
            if used is not None:
                typical = F.max(F.when(F.col("u").isNull(), F.struct("pop", "node", "n", "label")))
            hubs = at if used is None else at.join(used.select(F.col("node"), F.lit(1).alias("u")), "node", "left")
            hubs = stage.table(hubs.groupBy("v").agg(typical.alias("h")).where("h is not null"), "hubs")
            pairs = at.join(hubs, "v").where((F.col("label") != F.col("h.label")) & _similar_sizes(F.col("n"), F.col("h.n")))
            pairs = pairs.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"))
            now = hubs.select("h.node").distinct()
            used = stage.table(now if used is None else used.unionByName(now).distinct(), "used")
        else:
            long_ = at.groupBy("v").agg(F.count("*").alias("len")).where(F.col("len") > HOT_LIST)
            long_ = stage.table(long_.select("v"), "long")
            short = at.join(long_, "v", "left_anti")
            x, y = short.alias("x"), short.alias("y")
            apart = (F.col("x.v") == F.col("y.v")) & (F.col("x.label") < F.col("y.label"))
            pairs = x.join(y, apart & _similar_sizes(F.col("x.n"), F.col("y.n")))
            pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
            hot = stage.table(at.join(long_, "v", "left_semi"), "hot")
        pairs = stage.table(pairs.distinct(), "pairs")
        likely = _likely(pairs, nodes, stage)
        found = [] if likely.isEmpty() else [_linked(likely, nodes, docs, width, stage)]
        if turn == ROUNDS and not hot.isEmpty():
            found.append(stage.table(_hot_links(hot, nodes, docs, width, stage), "links"))
        found = [x for x in found if not x.isEmpty()]
        if found:
            links = reduce(DataFrame.unionByName, found if links is None else [links, *found])
            labels = components(links, stage)
    if labels is None:
        classes = nodes.select("node", F.col("node").alias("label"), F.col("first_id").alias("component_id"))
    else:
        # Only nodes with links are grouped. Staged on both sides, a join on the label of a large group can be split.
        linked = stage.table(nodes.select("node", "first_id").join(labels, "node"), "linked")
        first = stage.table(linked.groupBy("label").agg(F.min("first_id").alias("component_id")), "first")
        linked = linked.join(checked_broadcast(first), "label").select("node", "label", "component_id")
        alone = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"), F.col("first_id").alias("component_id"))
        classes = linked.unionByName(alone)
    return rows, stage.table(classes.withColumnRenamed("node", "q_node"), "classes")


def near_dedup(docs: DataFrame, width: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows, classes = near_classes(docs, width, Staging(docs.sparkSession, "near"))
    out = rows.join(classes, F.col("node") == F.col("q_node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with all its columns, one row of each group. Rows are named by doc_id and a digest of their text."""
    stage = Staging(docs.sparkSession, "near-drop")
    rows, classes = near_classes(docs, width, stage, digest=True)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    named = rows.where("n_shingles > 0").join(classes, F.col("node") == F.col("q_node")).groupBy("label", name.alias("name")).agg(F.count("*").alias("n"))
    named = stage.table(named, "named")
    first = stage.table(named.groupBy("label").agg(F.min("name").alias("first")), "first")
    out = named.join(first, "label").where((F.col("name") != F.col("first")) | (F.col("n") > 1))
    gone = stage.table(out.select(F.col("name.doc_id").alias("q_id"), F.col("name.digest").alias("q_digest"), (F.col("name") == F.col("first")).alias("q_first")), "gone")
    tied = lambda rows: F.col("doc_id").cast("bigint").eqNullSafe(F.col("q_id")) & (text_digest(rows) == F.col("q_digest"))
    left = docs.join(checked_broadcast(gone.where("not q_first").drop("q_first")), tied(docs), "left_anti")
    repeated = gone.where("q_first").drop("q_first")
    if repeated.isEmpty():
        return left
    # Of wholly repeated rows that stay, one: only those are numbered.
    once = left.join(checked_broadcast(repeated), tied(left), "left_anti")
    several = left.join(checked_broadcast(repeated), tied(left), "left_semi").withColumn("q_digest", text_digest(left))
    number = F.row_number().over(Window.partitionBy("doc_id", "q_digest").orderBy(F.lit(1)))
    return once.unionByName(several.withColumn("q_rank", number).where("q_rank = 1").drop("q_rank", "q_digest"))
