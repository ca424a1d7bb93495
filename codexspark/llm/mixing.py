"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source gets a target of tokens from its weight (capped at a multiple of what it has, the excess reshared). Its
documents are shuffled by a hash and laid on a virtual time line: a document finishes at the source's tokens so far,
divided by the target. All documents are range-sorted by finish time and taken until the total budget is used up. A
source whose target exceeds its size goes round again: its second copies follow the first ones.

Scale: texts are read once, for their sizes; everything after works on (id, hash, size) rows. Running sums go over
(source, hash range) pieces, so a source with a third of all rows is spread over as many tasks as any; what the driver
sees are a few totals and one cut. Results are the same in every run, as order comes from a hash of doc_id.

Nulls: a null text has size 0 and takes 0; null sources form one source that sorts last; null ids hash as empty. Rows
that repeat an id are documents of their own, kept in a fixed order by size. An empty table gives an empty result;
columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexspark.llm.shared import SPLIT, staged


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)  # of sources in code-point order, repeating
    share: float = 1.5  # budget, of all tokens
    most: float = 2.0  # a target's limit, of its source's tokens
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, SPLIT), lambda w: w != "")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """60 bits of an MD5, which other engines have as well."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def sizes_of(docs: DataFrame, mix: Mix) -> DataFrame:
    key = shuffle_key(F.col("doc_id"), mix.seed)
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with `sid`, their place in code-point order, null last: range parts are numbered alone, then moved by
    the count of the parts before (as many rows as partitions)."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    parts = staged(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("place", place).join(starts, "part").select("source", "source_size", (F.col("place") + F.col("start")).alias("sid"))


def targets_of(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, float]:
    """(source, sid, source_size, target) and the total budget. The level of tokens per weight rises until no source
    that isn't at its cap would pass it; each step needs two sums."""
    sources = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("sid") % len(mix.weights) + 1).cast("int"))
    sources = staged(sources.withColumn("weight", weight), "mix-weights")
    cap = F.col("source_size") * F.lit(mix.most)
    whole = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (whole[0] or 0) * mix.share
    level, open_weight = (budget / whole[1] if whole[1] else 0.0), whole[1]
    while open_weight:
        full = cap <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if (got[1] or 0) == open_weight or not got[1]:
            break
        open_weight = got[1]
        level = (budget - (got[0] or 0.0)) / open_weight
    target = F.least(cap, F.col("weight") * F.lit(level))
    return staged(sources.select("source", "sid", "source_size", target.alias("target")), "mix-targets"), budget


def timeline(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with `done`, the tokens of its source up to and with it in shuffled order."""
    spark = sizes.sparkSession
    pieces = 1 << max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    own = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop("source")
    own = own.withColumn("piece", F.expr(f"shiftright(key, {60 - (pieces.bit_length() - 1)})"))
    before = Window.partitionBy("sid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("sid", "piece").agg(F.sum("size").alias("n")).select("sid", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "piece").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = own.withColumn("inside", F.sum("size").over(inside)).join(starts, ["sid", "piece"])
    return lined.withColumn("done", F.col("inside") + F.col("start")).drop("inside", "start", "piece")


def finish(rounds: int) -> list[Column]:
    return [(F.col("done") + F.col("source_size") * i) / F.col("target") for i in range(rounds)]


def cut_of(lined: DataFrame, budget: float, rounds: int) -> tuple | None:
    """(finish, key, doc_id) of the last document that the budget holds, in the order of finish times."""
    n = int(lined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(F.col("finish"), F.col("key"), F.col("id"))
    queue = lined.filter("size > 0 and target > 0").select("size", "key", F.col("doc_id").alias("id"), F.explode(F.array(*finish(rounds))).alias("finish"))
    queue = staged(queue.repartitionByRange(n, "finish", "key").withColumn("part", F.spark_partition_id()), "mix-queue")
    totals = queue.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect()  # a row for each partition
    used, crossing = 0, None
    for part, size in totals:
        if used + size > budget:
            crossing = part
            break
        used += size
    if crossing is None:
        return None
    running = F.sum("size").over(Window.partitionBy("part").orderBy("finish", "key", "id").rowsBetween(Window.unboundedPreceding, 0))
    last = queue.filter(F.col("part") == crossing).withColumn("running", running + used).filter(F.col("running") <= budget).agg(F.max(at)).first()[0]
    if last is None:  # the part before ends at the cut
        last = queue.filter(F.col("part") < crossing).agg(F.max(at)).first()[0]
    return (last["finish"], last["key"], last["id"]) if last else (-1.0, 0, None)


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, key, size, sid, source, source_size, target, copies) for each row of docs."""
    rounds = -int(-mix.most // 1)
    sizes = staged(sizes_of(docs, mix), "mix-sizes")
    targets, budget = targets_of(sizes, mix)
    lined = staged(timeline(sizes, targets), "mix-line")
    cut = cut_of(lined, budget, rounds)
    if cut is None:
        taken = [F.lit(1)] * rounds
    else:
        end, key, doc_id = cut
        same = (F.col("key") < key) | ((F.col("key") == key) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(doc_id))))
        taken = [F.when((f < end) | ((f == end) & same), 1).otherwise(0) for f in finish(rounds)]
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(taken[1:], taken[0])).otherwise(0)
    return lined.withColumn("copies", copies).join(targets.select("sid", "source"), "sid")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts are not shuffled: within a source documents are
    taken in hash order, so each round of a source ends at one (hash, id, size), and rows are held against it."""
    plan = staged(mix_sources(docs, mix).select("source", "key", "doc_id", "size", "copies"), "mix-plan")
    least = F.lit(-(1 << 63)).cast("long")
    place = lambda key, doc_id, size: F.struct(key.alias("key"), F.coalesce(doc_id.cast("long"), least).alias("id"), size.alias("size"))
    rounds = range(1, -int(-mix.most // 1) + 1)
    ends = plan.groupBy(F.col("source").alias("__mix_source")).agg(*[F.max(F.when(F.col("copies") >= i, place(F.col("key"), F.col("doc_id"), F.col("size")))).alias(f"__mix_end{i}") for i in rounds])
    size, own = n_words(F.col("text")), shuffle_key(F.col("doc_id"), mix.seed)
    here = docs.withColumn("__mix_size", size).withColumn("__mix_at", place(own, F.col("doc_id"), size))
    here = here.join(ends, F.col("source").eqNullSafe(F.col("__mix_source")), "left")
    copies = [F.when((F.col("__mix_size") > 0) & (F.col("__mix_at") <= F.col(f"__mix_end{i}")), 1).otherwise(0) for i in rounds]
    return here.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), sum(copies[1:], copies[0])))).select(*docs.columns)
