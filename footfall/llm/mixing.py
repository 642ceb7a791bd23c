"""Mixing sources to target weights.

The words of each source are packed into blocks of fixed length. Output shards of a
fixed number of slots draw multinomial source counts; each slot of a source is mapped
to a block by a pseudorandom permutation of the source's block numbers, one
permutation per epoch; blocks are joined by their number. Only DataFrame functions
are used.

Draws alone would miss the targets by chance, and could use a block more often than
its source allows. So each source has a quota of slots that its target fixes: draws
beyond the quota are given up, and what is missing is added to hashed shards.

Defined results: a null or blank text has size 0 and is never taken; a null source is
a source of its own and comes last; repeated rows are packed one after the other; an
empty table gives an empty table; reruns agree, since every choice is a hash of the
seed; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.text import split_words
from footfall.session import stage

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20250711
# Rows that one window sorts; longer sequences get their positions in two levels.
RUN_ROWS = 2000
# A draw is a ticket; the table of tickets has this many rows whatever the data.
TICKETS = 65_536
# Rounds of the swap-or-not shuffle (Hoang, Morris and Rogaway, 2012).
ROUNDS = 24
KEY = ("__key", "__more")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in order of code points, null last, take the weights in turn and share
    the total. A target stops at ``max_epochs`` times its source, and the excess is
    shared again by weight: in the end every open source has target ``level * weight``.
    With the sources in order of ``cap / weight`` the closed ones are a prefix, so the
    level follows from running sums. The windows see one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    # A source is open once its cap lies above the level that holds if it is open.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def pack(docs: DataFrame, *ties: str) -> DataFrame:
    """Place each document in its source's word stream: adds ``size``, ``source_size`` and ``start``.

    ``docs`` holds ``doc_id, source, size`` and ``ties``, columns that order rows with equal
    ones. The order within a source is a hash, so it does not depend on partitions. Starts come in two levels: sizes are summed over
    runs of about ``RUN_ROWS`` rows, the runs are summed up per source, and a window
    covers one run only.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    runs = F.ceil(F.col("rows") / RUN_ROWS)
    counts = stage(counts.select("source", "source_size", runs.alias("runs")), "sources")
    # One row per source; the planner broadcasts it only if it is small.
    known = docs.join(counts, docs["source"].eqNullSafe(counts["source"]), "left").drop(counts["source"])
    order = F.xxhash64(F.lit(SEED), "doc_id", "size")
    dealt = known.withColumn("order", order).withColumn("run", F.pmod("order", "runs"))
    totals = dealt.groupBy("source", "run").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("__source"), F.col("run").alias("__run"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "run").orderBy("order", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(offsets, local["source"].eqNullSafe(F.col("__source")) & (F.col("run") == F.col("__run")))
    return placed.withColumn("start", F.col("offset") + F.col("local")).drop("__source", "__run", "offset", "local", "order", "run", "runs")


def _permuted(index: Column, n: Column, *key: Column) -> Column:
    """Image of ``index`` under a keyed permutation of ``0 .. n - 1``, for any ``n``.

    Swap-or-not: each round pairs x with k - x, and a hash of the pair decides for
    both of them alike whether they change places.
    """
    salt = F.xxhash64(F.lit(SEED), *key)

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(salt, r), n) - x, n)
        coin = F.xxhash64(salt, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("bigint"), swap)


def plan_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``shard, slot, source, block, epoch`` for every slot, from ``source, source_size, target``.

    A slot's draw is a hashed ticket, and tickets are dealt to sources in proportion to
    their targets: the counts of a shard are multinomial. The number of a slot within
    its source comes from counts per shard summed up over the shards.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.round(F.col("target") * blocks / F.col("source_size")).cast("bigint")
    known = sources.filter(F.col("source_size") > 0).select("source", "target", blocks.alias("blocks"), F.least(quota, max_epochs * blocks).alias("quota"))
    known = stage(known.withColumn("key", F.monotonically_increasing_id()), "quotas")
    below = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("target").over(below), F.lit(0.0)) / F.sum("target").over(Window.partitionBy())
    upto = share + F.col("target") / F.sum("target").over(Window.partitionBy())
    limits = known.select("key", F.round(share * TICKETS).cast("int").alias("low"), (F.round(upto * TICKETS).cast("int") - 1).alias("high"))
    tickets = limits.filter("high >= low").select("key", F.explode(F.sequence("low", "high")).alias("ticket"))

    total = known.agg(F.sum("quota")).first()[0] or 0
    spark = sources.sparkSession
    parts = max(1, min(20_000, total // 250_000), spark.sparkContext.defaultParallelism)
    slots = spark.range(0, total, 1, parts).select(
        F.floor(F.col("id") / shard_slots).cast("bigint").alias("shard"), F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(TICKETS)).cast("int").alias("ticket")
    )
    drawn = slots.join(F.broadcast(tickets), "ticket").drop("ticket")
    counts = stage(drawn.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n")), "draws")
    ahead = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "shard").orderBy("slot")
    numbered = drawn.withColumn("number", F.row_number().over(inside) - 1).join(offsets, ["key", "shard"])
    numbered = numbered.select("key", "shard", "slot", (F.col("offset") + F.col("number")).alias("number"))
    # What chance left short of the quota: about the square root of the slots, dealt in pieces.
    made = counts.groupBy("key").agg(F.sum("n").alias("made"))
    short = known.join(made, "key", "left").withColumn("made", F.coalesce("made", F.lit(0))).filter("made < quota")
    piece = F.explode(F.sequence("made", F.col("quota") - 1, F.lit(shard_slots).cast("bigint")))
    pieces = short.select("key", "quota", piece.alias("from"))
    added = pieces.select("key", F.explode(F.sequence("from", F.least(F.col("quota"), F.col("from") + shard_slots) - 1)).alias("number"))
    shards = max(1, -(-total // shard_slots))
    added = added.select("key", F.pmod(F.xxhash64(F.lit(SEED), "key", "number"), F.lit(shards)).cast("bigint").alias("shard"), F.lit(None).cast("bigint").alias("slot"), "number")
    settled = numbered.unionByName(added).join(known, "key").filter("number < quota")
    epoch = F.floor(F.col("number") / F.col("blocks")).cast("bigint")
    block = _permuted(F.pmod("number", "blocks"), F.col("blocks"), F.xxhash64("source"), epoch)
    return settled.select("shard", "slot", "source", block.alias("block"), epoch.alias("epoch"))


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    size = F.size(split_words(F.col("text"))).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), *keep)


def _targets_and_slots(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sources), "targets")
    return targets, plan_slots(targets)


def _spans(placed: DataFrame, *keep: str) -> DataFrame:
    """The part of each block that a document fills: ``block, from, words``, counted within the document."""
    size, start = F.col("size"), F.col("start")
    first, last = F.floor(start / BLOCK_WORDS), F.floor((start + size - 1) / BLOCK_WORDS)
    blocks = placed.filter(size > 0).select("doc_id", "source", "size", "start", *keep, F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("block") * BLOCK_WORDS, start)
    high = F.least((F.col("block") + 1) * BLOCK_WORDS, start + size)
    return blocks.select("doc_id", "source", "size", "start", *keep, "block", (low - start).alias("from"), (high - low).alias("words"))


def usage(docs: DataFrame) -> DataFrame:
    """How much of each document the mix takes: ``doc_id, size, source_size, target, taken``."""
    sized = stage(_sized(docs), "sizes")
    placed = stage(pack(sized), "packed")
    targets, slots = _targets_and_slots(sized)
    times = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    times = times.select(F.xxhash64("source", F.col("source").isNull()).alias("__s"), F.col("source").alias("__source"), F.col("block").alias("__block"), "times")
    spans = _spans(placed)
    used = spans.join(times, spans["source"].eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block")))
    taken = used.groupBy("doc_id", "source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    taken = taken.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("start").alias("__start"), "taken")
    same = placed["doc_id"].eqNullSafe(F.col("__doc")) & placed["source"].eqNullSafe(F.col("__source")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0)
    targets = targets.select(F.col("source").alias("__t"), "target")
    joined = placed.join(taken, same, "left")
    joined = joined.join(targets, joined["source"].eqNullSafe(F.col("__t")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, text`` with two hashes that name a row; repeated rows share them."""
    cells = [c for name in ("doc_id", "source", "text") for c in (F.col(name), F.col(name).isNull())]
    return docs.select("doc_id", "source", "text", *[F.xxhash64(F.lit(SEED + n), *cells).alias(key) for n, key in enumerate(KEY)])


def mix(docs: DataFrame) -> DataFrame:
    """The mixed data: ``shard, slot, source, block, epoch, doc_id, from, words, text``.

    One row per slot and document in its block; ``text`` is that part of the document,
    its words separated by single spaces. Blocks are packed and drawn without the texts,
    which are shuffled once, to the parts that are cut out of them.
    """
    keyed = _keyed(docs)
    sized = stage(_sized(keyed, *KEY), "sizes")
    _, slots = _targets_and_slots(sized)
    spans = _spans(pack(sized, *KEY), *KEY)
    parts = spans.select("doc_id", F.col("source").alias("__source"), F.col("block").alias("__block"), "from", "words", *KEY)
    cuts = slots.join(parts, slots["source"].eqNullSafe(F.col("__source")) & (slots["block"] == F.col("__block"))).drop("__source", "__block")
    # Of repeated rows one text is enough.
    repeats = Window.partitionBy(*KEY).orderBy("doc_id")
    texts = keyed.select("doc_id", "text", *KEY).withColumn("earlier", F.lag(F.lit(1)).over(repeats)).filter("earlier IS NULL")
    texts = texts.select(*KEY, split_words(F.col("text")).alias("__words"))
    text = F.array_join(F.slice("__words", (F.col("from") + 1).cast("int"), F.col("words").cast("int")), " ")
    return texts.join(cuts, list(KEY)).select(*[c for c in cuts.columns if c not in KEY], text.alias("text"))
