"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only.  Each source's documents fall into blocks by a
seeded hash, of ``BLOCK_DOCS`` documents or the square root of the source's number if
that is more; the blocks of a source are put in a seeded
random order.  A source whose target is r times its size is drawn floor(r) times as a
whole, and the rest of the target comes from the first blocks of the order, the last
of them only as far as its documents fit (the last document by words).  The drawn
blocks of all sources are dealt to the output shards by a binary tree: at each node
the number of blocks of every source that go to the left half is a draw from the
multivariate hypergeometric distribution, one source after another, so that the
quotas of the children add up to those of the parent and every shard gets its exact
number of blocks.  Within a shard rows are ordered by a hash.

No step brings a source's rows into one task: what is ordered is the table of blocks
(at most the square root of a source's documents) and the documents of the one block
in which a source's target is reached.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import WORD_PATTERN, stored

SEED = 20_240_601
BLOCK_DOCS = 256
#: 2 ** 3 output shards at least, and words of a shard at most.
SHARD_LEVELS, SHARD_WORDS = 3, 50_000_000
MOST_REPEATS = 3.0


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: float = MOST_REPEATS) -> DataFrame:
    """(source, docs, source_size) -> the same with weight and target.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of
    all sizes; a target stops at ``repeats`` times its source's size and the excess is
    dealt anew by weight.  The stopped sources are a prefix of the sources ordered by
    (most / weight), so running sums find the level in one pass over the table of
    sources.  Sizes of 0 give targets of 0.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = functools.reduce(lambda c, i: c.when(turn == i, F.lit(float(weights[i]))), range(1, len(weights)), F.when(turn == 0, F.lit(float(weights[0]))))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(repeats)))
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    total, all_weight = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("stopped", F.col("most") <= F.col("weight") * F.col("level"))
    # the level of those that are not stopped: what the stopped leave over
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stopped"), F.col("most")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(~F.col("stopped"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("stopped"), F.col("most")).otherwise(F.col("weight") * left / F.when(free > 0, free))
    return s.withColumn("target", F.coalesce(target, F.lit(0.0))).drop("most", "level", "stopped")


def _let(value: Column, made) -> Column:
    """``made(value)`` with the value computed once, so that expressions stay small."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 6, good to ten digits."""
    def series(y: Column) -> Column:
        return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - F.log((y - 1) * (y - 2) * (y - 3) * (y - 4) * (y - 5))

    return _let(x + 6.0, series)


def hypergeometric(u: Column, good: Column, bad: Column, draws: Column) -> Column:
    """A draw from the hypergeometric distribution by inversion, as a column expression.

    ``good`` of ``good + bad`` are marked, ``draws`` are taken without replacement.  The
    walk starts twelve deviations below the mode, where the probability comes from
    factorials, and goes on by the ratio of neighbours, so that its length grows with the
    deviation only; what lies beyond it is less than 1e-30.
    """

    def span(c: Column) -> Column:
        all_ = c["good"] + c["bad"]
        mode = F.floor((c["draws"] + 1) * (c["good"] + 1) / (all_ + 2))
        reach = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), c["draws"] * c["good"] * c["bad"] * (all_ - c["draws"]) / F.greatest(F.lit(1.0), all_ * all_ * (all_ - 1))))) + 30
        low, high = F.greatest(F.lit(0.0), c["draws"] - c["bad"]), F.least(c["good"], c["draws"])
        return _let(
            F.struct(mode.cast("double").alias("mode"), reach.cast("double").alias("reach")),
            lambda m: F.struct(c["good"].alias("good"), c["bad"].alias("bad"), c["draws"].alias("draws"), F.greatest(low, m["mode"] - m["reach"]).alias("first"), F.least(high, m["mode"] + m["reach"]).alias("last")),
        )

    def walk(c: Column) -> Column:
        def choose(n: Column, k: Column) -> Column:
            return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

        start = F.exp(choose(c["good"], c["first"]) + choose(c["bad"], c["draws"] - c["first"]) - choose(c["good"] + c["bad"], c["draws"]))

        def step(a: Column, x: Column) -> Column:  # p belongs to k, and sum to what is below k
            k, on = x.cast("double"), (a["sum"] + a["p"]) < u
            ratio = (c["good"] - k) * (c["draws"] - k) / ((k + 1) * (c["bad"] - c["draws"] + k + 1))
            return F.struct(F.when(on, a["sum"] + a["p"]).otherwise(a["sum"]).alias("sum"), F.when(on, a["p"] * ratio).otherwise(a["p"]).alias("p"), F.when(on, a["k"] + 1.0).otherwise(a["k"]).alias("k"))

        ks = F.when(c["last"] > c["first"], F.sequence(c["first"].cast("long"), c["last"].cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(ks, F.struct(F.lit(0.0).alias("sum"), start.alias("p"), c["first"].alias("k")), step, lambda a: a["k"].cast("long"))

    counts = F.struct(good.cast("double").alias("good"), bad.cast("double").alias("bad"), draws.cast("double").alias("draws"))
    return _let(_let(counts, span), walk)


def split_quotas(quotas: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """(source, blocks) -> (source, shard, blocks): exact quotas of 2 ** ``levels`` shards.

    Every node of the tree gives the left half of its blocks (rounded up) to its left
    child; how many come from each source is drawn source by source, conditional on
    what the sources before took, which makes the joint draw multivariate
    hypergeometric.  The conditional chain runs inside one row per node (an array of
    the sources' quotas), so the tree takes one row for each shard at most.
    """
    nodes = quotas.groupBy(F.lit(0).alias("shard")).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("source").alias("h"), "source", F.col("blocks").cast("long").alias("blocks")))).alias("held"))
    for level in range(levels):
        depth = F.lit(level)
        total = F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        start = F.struct((total - F.floor(total / 2)).alias("need"), total.alias("rest"), F.array().cast("array<bigint>").alias("left"))

        def deal(acc: Column, x: Column) -> Column:
            take = hypergeometric(_uniform(F.lit(seed), depth, F.col("shard"), x["h"]), x["blocks"], acc["rest"] - x["blocks"], acc["need"]).cast("long")
            return F.struct((acc["need"] - take).alias("need"), (acc["rest"] - x["blocks"]).alias("rest"), F.concat(acc["left"], F.array(take)).alias("left"))

        nodes = nodes.withColumn("left", F.aggregate("held", start, deal, lambda a: a["left"]))

        def child(right: bool) -> Column:
            return F.transform(F.arrays_zip("held", "left"), lambda z: F.struct(z["held"]["h"].alias("h"), z["held"]["source"].alias("source"), (z["held"]["blocks"] - z["left"] if right else z["left"]).alias("blocks")))

        both = F.array(F.struct((F.col("shard") * 2).alias("shard"), child(False).alias("held")), F.struct((F.col("shard") * 2 + 1).alias("shard"), child(True).alias("held")))
        nodes = nodes.select(F.explode(both).alias("x")).select("x.*")
    return nodes.select("shard", F.explode("held").alias("x")).select("x.source", "shard", "x.blocks")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: float = MOST_REPEATS, block_docs: int = BLOCK_DOCS, levels: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text and others) with size, source_size, target, taken, block, shards and shard_order.

    ``taken`` is the number of words that the mix takes of the document, repeats
    counted: at most ``repeats`` times its size.  ``shards`` lists the output shard of
    each draw of the document's block and ``shard_order`` its place in the local
    shuffle.  There are 2 ** ``levels`` shards, by default as many as keep a shard below
    ``SHARD_WORDS`` words and 8 at least.  Null texts and texts without words have size 0
    and are taken with 0 words; a null source is a source.  Rows are told apart by id
    and text, so that null and repeated ids are rows like others; rows that agree in
    both share what the mix takes of them evenly (less than a word each is lost).  Ties in
    the seeded orders go by id.  Very long texts are blocks' rows like others.  Empty tables
    give no rows.  Input columns with one of the added names are replaced; other names
    do not matter.
    """
    added = ["size", "source_size", "target", "taken", "block", "shards", "shard_order"]
    docs = docs.drop(*added)
    names = docs.columns
    words = F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", F.col("row.source").cast("string").alias("source"), F.xxhash64(F.lit(seed), F.col("row.doc_id").cast("string"), F.xxhash64("row.text")).alias("key"), words.alias("size"))
    # small tables are written once: later joins know their size, and no count is made twice
    light = stored(sized.select("key", "source", "size"), "sizes")
    sizes = light.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, repeats).withColumn("n_blocks", F.ceil(F.col("docs") / F.greatest(F.lit(block_docs), F.ceil(F.sqrt("docs")))))
    # a source's target as whole draws and words of one more, partial draw
    plan = plan.withColumn("words", F.floor("target")).withColumn("draws", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("draws", F.least("draws", F.lit(int(repeats)))).withColumn("rest", F.col("words") - F.col("draws") * F.col("source_size"))
    plan = stored(plan.select(F.col("source").alias("p_source"), "docs", "source_size", "target", "n_blocks", "draws", "rest"), "plan")
    if levels is None:
        levels = max(SHARD_LEVELS, math.ceil(math.log2(max(1, (plan.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))))

    def with_block(df: DataFrame) -> DataFrame:
        joined = df.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
        return joined.withColumn("block", F.pmod("key", "n_blocks"))

    by_block = with_block(light).groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("draws").alias("draws"), F.first("rest").alias("rest"))
    permuted = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = by_block.withColumn("before", F.coalesce(F.sum("block_size").over(permuted), F.lit(0)))
    # words that the partial draw takes of the block; a block taken in part is one more draw
    blocks = blocks.withColumn("part", F.greatest(F.lit(0), F.least("block_size", F.col("rest") - F.col("before")))).withColumn("drawn", F.col("draws") + (F.col("part") > 0).cast("int"))
    blocks = stored(blocks, "blocks")
    quotas = blocks.groupBy("source").agg(F.sum("drawn").alias("blocks"))
    dealt = split_quotas(quotas, levels, seed)
    upto = W.partitionBy("source").orderBy("shard")
    ranges = dealt.withColumn("to", F.sum("blocks").over(upto)).withColumn("from", F.col("to") - F.col("blocks"))
    tickets = blocks.filter("drawn > 0").select("source", "block", F.explode(F.expr("sequence(1, cast(drawn as int))")).alias("draw"))
    deal_order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block", "draw"), "block", "draw")
    tickets = tickets.withColumn("ticket", F.row_number().over(deal_order) - 1)
    by_source = ranges.groupBy(F.col("source").alias("r_source")).agg(F.sort_array(F.collect_list(F.struct("to", "shard"))).alias("cuts"))
    placed = tickets.join(by_source, F.col("source").eqNullSafe(F.col("r_source"))).withColumn("shard", F.filter("cuts", lambda c: c["to"] > F.col("ticket"))[0]["shard"])
    shards = placed.groupBy(F.col("source").alias("s_source"), F.col("block").alias("s_block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "shard"))), lambda x: x["shard"]).alias("shards"))
    block_plan = blocks.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")), "left")
    block_plan = stored(block_plan.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "part", "block_size", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "block_plan")
    # in the block where the partial draw ends, documents are taken in a seeded order as long as words are left
    ends = block_plan.filter("part > 0 and part < block_size").select(F.col("b_source").alias("e_source"), F.col("b_block").alias("e_block"), F.col("part").alias("e_part"))  # one row a source
    edge = with_block(light).join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    edge = edge.groupBy("source", "block", "key").agg(F.count("*").alias("rows"), F.sum("size").alias("size"), F.first("e_part").alias("e_part"))
    seeded = W.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 3), "key"), "key").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("d_before", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
    edge = edge.select(F.col("source").alias("e_source"), F.col("key").alias("e_key"), F.floor(F.greatest(F.lit(0), F.least("size", F.col("e_part") - F.col("d_before"))) / F.col("rows")).alias("e_taken"))
    edge = stored(edge, "edge")
    out = with_block(sized).join(block_plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    out = out.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("key") == F.col("e_key")), "left")
    extra = F.when(F.col("part") <= 0, F.lit(0)).when(F.col("part") >= F.col("block_size"), F.col("size")).otherwise(F.coalesce("e_taken", F.lit(0)))
    out = out.withColumn("taken", (F.col("draws") * F.col("size") + extra).cast("long"))
    out = out.withColumn("shard_order", F.xxhash64(F.lit(seed + 4), "key"))
    return out.select("row.*", "size", "source_size", "target", "taken", "block", "shards", "shard_order")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with sources weighing 1, 2, 3 in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "shards", "shard_order")
