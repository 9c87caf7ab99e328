"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Source targets: sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; the targets share the size of the
whole corpus by weight, and none exceeds ``max_copies`` times its source's size: the excess is reshared by weight among
the others until none is above.

Document counts: a document's expected copies are target / source size. The whole part is taken for certain. For the
rest, documents are ranked by random odds over inclusion odds (u / (1-u)) / (p / (1-p)), p the fractional part, and the
smallest ranks are taken up to the remaining words of the source. (p is one number in a source, as all its words weigh alike;
between sources it differs.) Last, of the documents not taken, the one whose size
fits the gap best is taken if that brings the source nearer to its target: one document a source at most, which
is chosen by size and not by chance, so that its inclusion probability is a little above p and that of the others p.

The boundary is found by a radix descent on the rank: two aggregations by (source, 12-bit bucket), then an ordered
window over the rows of one bucket of the second level. So a source with a third of all rows is never ordered in one
task, and nothing but a table of sources and buckets is windowed.

Defined results: a null text has size 0; documents of size 0 are never taken and cost nothing; rows that share doc_id are
told apart by a digest of their text; wholly repeated rows share one rank and are cut by an arbitrary but equal choice;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Staging, text_or_empty

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 4096
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def sized() -> list[Column]:
    """doc_id, source, size, u, tie of a row: u in (0, 1) is drawn from a digest of doc_id; tie tells texts apart.

    Rows without a doc_id draw by a digest of their text, so that they don't all meet in one bucket of the rank.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.md5(text_or_empty().cast("string"))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), name)), 1, 12), 16, 10)
    return [
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text_or_empty()).alias("size"),
        ((bits.cast("double") + 0.5) / float(1 << 48)).alias("u"),
        F.crc32(text_or_empty()).alias("tie"),
    ]


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target). The windows run over the table of sources, one row each.

    With sources ordered by cap / weight, the capped ones are a prefix, so resharing until none is above is one running
    sum: source k is capped if the level that the uncapped ones would reach is not below its own cap / weight.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    sources = sources.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / weight_left).withColumn("capped", F.col("ratio") <= F.col("level"))
    # The first uncapped source in this order has the largest level of the uncapped ones: from there on, levels fall.
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return sources.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def source_key(source: Column) -> Column:
    """A join key that tells the null source from any other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds the Pareto rank q (null where nothing is left to chance) and its buckets b1, b2. rows have u, size, q_p."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("q_p") / (1 - F.col("q_p")))
    rows = rows.withColumn("q", F.when((F.col("q_p") > 0) & (F.col("size") > 0), odds))
    place = F.col("q") / (1 + F.col("q")) * BUCKETS
    return rows.withColumn("b1", F.floor(place)).withColumn("b2", F.floor((place - F.col("b1")) * BUCKETS))


def _edge(rows: DataFrame, need: DataFrame, bucket: str, cut: str) -> DataFrame:
    """(q_s, cut, q_rest): the bucket in which each source's needed words are reached, and the words needed inside it."""
    sums = rows.groupBy("q_s", bucket).agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("q_s").orderBy(bucket)))
    edge = upto.join(need, "q_s").where((F.col("upto") > F.col("q_rest")) & (F.col("upto") - F.col("words") <= F.col("q_rest")))
    edge = edge.groupBy("q_s").agg(F.min(F.struct(bucket, "upto", "words", "q_rest")).alias("e"))
    return edge.select("q_s", F.col(f"e.{bucket}").alias(cut), (F.col("e.q_rest") - F.col("e.upto") + F.col("e.words")).alias("q_rest"))


def mix_plan(rows: DataFrame, stage: Staging, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source with all that decides its documents: target, whole copies, p, the rank's cut, the fitting document."""
    targets = source_targets(rows, weights, max_copies)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(source_key(F.col("source")).alias("q_s"), F.col("source_size").alias("q_size"), F.col("target").alias("q_target"), copies.alias("c"))
    plan = plan.withColumn("q_whole", F.floor("c")).withColumn("q_p", F.col("c") - F.col("q_whole")).drop("c")
    plan = stage.table(plan, "plan")
    need = plan.where("q_p > 0").select("q_s", (F.col("q_target") - F.col("q_whole") * F.col("q_size")).alias("q_rest"))
    keyed = rows.withColumn("q_s", source_key(F.col("source")))
    live = ranked(keyed.join(plan.select("q_s", "q_p"), "q_s")).where("q is not null")
    edge1 = stage.table(_edge(live, need, "b1", "q_cut1"), "edge1")
    inside1 = stage.table(live.join(edge1.select("q_s", "q_cut1"), "q_s").where("b1 = q_cut1"), "inside1")
    edge2 = stage.table(_edge(inside1, edge1.select("q_s", "q_rest"), "b2", "q_cut2"), "edge2")
    inside2 = inside1.join(edge2, "q_s").where("b2 = q_cut2")
    run = Window.partitionBy("q_s").orderBy("q", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside2.withColumn("upto", F.sum("size").over(run)).where("upto <= q_rest")
    last = last.groupBy("q_s").agg(F.max(F.struct("q", "doc_id", "tie")).alias("q_last"), F.max("upto").alias("got"))
    cut = edge1.select("q_s", "q_cut1").join(edge2, "q_s", "left").join(last, "q_s", "left")
    cut = cut.withColumn("q_gap", F.col("q_rest") - F.coalesce(F.col("got"), F.lit(0))).drop("got", "q_rest")
    plan = stage.table(plan.join(cut, "q_s", "left"), "cut")
    # The document that fits the gap best, per source; it is taken only if the source comes nearer to its target.
    miss = F.abs(F.col("size") - F.col("q_gap"))
    open_ = ranked(keyed.join(plan, "q_s")).where(F.col("q").isNotNull() & (F.col("q_gap") > 0) & ~_before()).where(miss < F.col("q_gap"))
    fit = open_.groupBy("q_s").agg(F.min(F.struct(miss.alias("m"), "q", "doc_id", "tie")).alias("f"))
    fit = fit.select("q_s", F.struct("f.q", "f.doc_id", "f.tie").alias("q_fit"))
    return stage.table(plan.join(fit, "q_s", "left"), "decided")


def _before() -> Column:
    """True where a document's rank comes before its source's cut."""
    in_last = (F.col("b2") == F.col("q_cut2")) & F.coalesce(F.struct("q", "doc_id", "tie") <= F.col("q_last"), F.lit(False))
    before = (F.col("b1") < F.col("q_cut1")) | ((F.col("b1") == F.col("q_cut1")) & ((F.col("b2") < F.col("q_cut2")) | in_last))
    return F.coalesce(F.when(F.col("q_cut1").isNull(), F.lit(True)).otherwise(before), F.lit(False))


def times() -> Column:
    """How often a ranked row joined with its source's plan is taken."""
    fits = F.coalesce(F.struct("q", "doc_id", "tie").eqNullSafe(F.col("q_fit")), F.lit(False))
    return (F.col("q_whole") + F.when(F.col("q").isNotNull() & (_before() | fits), 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    stage = Staging(docs.sparkSession, "mix")
    rows = stage.table(docs.select(*sized()), "sized")  # the only pass over the texts
    plan = mix_plan(rows, stage, weights, max_copies)
    # One row per source: Spark broadcasts it while it is small, else it splits a hot source's rows.
    out = ranked(rows.withColumn("q_s", source_key(F.col("source"))).join(plan, "q_s"))
    return out.select("doc_id", "size", F.col("q_size").cast("bigint").alias("source_size"), F.col("q_target").alias("target"), (F.col("size") * times()).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, each row as many times as the mix takes it. Texts are not shuffled."""
    stage = Staging(docs.sparkSession, "mixed")
    plan = mix_plan(stage.table(docs.select(*sized()), "sized"), stage)
    rows = docs.select(F.struct("*").alias("q_row"), *sized()).withColumn("q_s", source_key(F.col("source")))
    out = ranked(rows.join(plan, "q_s")).withColumn("q_times", times()).where("q_times > 0")
    return out.withColumn("q_copy", F.explode(F.sequence(F.lit(1), F.col("q_times")))).select("q_row.*")
