"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, document after document, are packed into blocks of ``block_words`` words. Every output shard of
``shard_slots`` slots draws its multinomial counts of the sources, whose probabilities are their shares of all slots. The
counts of a source are scaled so that its running total over the shards ends at its quota exactly; what rounding leaves
over is carried to the next shard, so shards differ a little in size. The slots that a shard gives a source take the next
indices k of that source; index k is block (pseudorandom permutation of k within the epoch k / blocks), and slots and
blocks are joined by (source, block index). The slots of a shard are then shuffled among each other. Permutations are
swap-or-not shuffles, so they need no table and no arithmetic over 64 bits.

Defined results: null text has size 0 and nothing taken; sources are ordered by code point with null last; a source
without words has target 0; equal rows count separately and get equal sums in some order; an empty table gives an
empty table; a very long text is as many blocks as its words fill; columns other than doc_id, text and source are ignored
by the report; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialize, one_of_each, row_key

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROUNDS = 24
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def n_words(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 if null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, WORD_SEPARATORS))).cast("long")


def shuffle_index(i, n, seed, rounds: int = ROUNDS):
    """Pseudorandom permutation of 0..n-1 at ``i`` (a swap-or-not shuffle; each round is an involution)."""

    def turn(x, r):
        partner = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        top = F.greatest(x, partner)
        return F.when(F.pmod(F.xxhash64(seed, r, top), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), turn)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 5, 2, 1 in source order, no target above
    ``MAX_REPEATS`` times its source's size, the excess shared again by weight (water filling, in closed form).

    One row a source; the windows below run over sources, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(MAX_REPEATS)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # if the sources before this one are the full ones, the rest get `level` per unit of weight
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(all_rows))
    level = F.col("first").getField("level")
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def placed(docs: DataFrame) -> DataFrame:
    """Add ``start``: the number of words of the same source before a row, by (doc_id, row hash).

    Rows are dealt by ranges of (source, doc_id, row hash), so a source with a third of all rows is summed in many tasks;
    the second window runs over one row a source and range.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_hash")]
    dealt = docs.repartitionByRange(F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "mix-dealt")
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("s"))
    base = sums.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), (F.sum("s").over(Window.partitionBy("source").orderBy("part")) - F.col("s")).alias("base"))
    inner = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return out.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part"))).withColumn("start", F.col("base") + F.col("inside")).drop("b_source", "b_part", "base", "inside", "part")


def quotas(sources: DataFrame, block_words: int) -> DataFrame:
    """Add ``n_blocks`` and ``quota``, the slots of each source: whole epochs of all its blocks as far as its target
    goes, then as many blocks of one more epoch as come nearest to the rest."""
    s = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words)).filter("source_size > 0")
    s = s.withColumn("epochs", F.floor(F.col("target") / F.col("source_size") + 1e-9))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))
    quota = F.col("epochs") * F.col("n_blocks") + F.when(F.col("epochs") >= MAX_REPEATS, 0).otherwise(F.least(F.col("n_blocks"), F.round(rest / block_words).cast("long")))
    return s.withColumn("quota", quota).filter("quota > 0").select("source_no", "n_blocks", "quota")


def draw_table(sources: DataFrame, cells: int) -> Column:
    """One value: for each of ``cells`` equal parts of [0, 1) the sources that reach into it, as (upper end, number).

    A source holds a stretch as long as its share of all slots. A cell has two sources on average, so a draw costs the
    same however many sources there are.
    """
    upto = Window.orderBy("source_no")  # one row a source
    total = F.sum("quota").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = sources.withColumn("high", F.sum("quota").over(upto) / total).withColumn("low", (F.sum("quota").over(upto) - F.col("quota")) / total)
    reach = F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1).cast("long"), F.floor(F.col("high") * cells)))
    each = ends.select(F.explode(reach).alias("cell"), F.struct("high", "source_no").alias("s")).groupBy("cell").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "s"))), lambda c: c["s"]).alias("t")).scalar()


def shard_counts(spark: SparkSession, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, n_blocks, shard, first_k, n): the multinomial draw of every shard, scaled to the quotas.

    A slot draws its source by a uniform number, and the shard's counts are those of its slots. Running totals go by groups
    of 4,096 shards first, so no window runs over all shards.
    """
    n_sources, n_slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    shards, cells = -(-n_slots // shard_slots), 2 * n_sources
    if not n_slots:
        return spark.createDataFrame([], "source_no int, n_blocks long, shard long, first_k long, n long")
    table = spark.range(1).select(draw_table(sources, cells).alias("t"))
    table = materialize(table, "mix-draws").select("t").scalar()
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(1 << 52)) / float(1 << 52)
    drawn = spark.range(0, n_slots, 1, max(1, n_slots // 250_000)).select("id", u.alias("u")).withColumn("cell", F.element_at(table, (F.floor(F.col("u") * cells) + 1).cast("int")))
    source = F.get(F.filter("cell", lambda c: c["high"] > F.col("u")), 0)["source_no"]
    counts = drawn.select(F.floor(F.col("id") / shard_slots).alias("shard"), F.coalesce(source, F.element_at("cell", -1)["source_no"]).alias("source_no"))
    counts = materialize(counts.groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("c")), "mix-counts")
    group = F.floor(F.col("shard") / 4096)
    before = counts.groupBy("source_no", group.alias("g")).agg(F.sum("c").alias("c"))
    before = before.select("source_no", "g", (F.sum("c").over(Window.partitionBy("source_no").orderBy("g")) - F.col("c")).alias("before"))
    totals = sources.join(counts.groupBy("source_no").agg(F.sum("c").alias("drawn")), "source_no", "left")
    run = counts.withColumn("g", group).withColumn("inside", F.sum("c").over(Window.partitionBy("source_no", "g").orderBy("shard"))).join(before, ["source_no", "g"])
    run = run.join(totals, "source_no").withColumn("upto", F.col("before") + F.col("inside"))
    scaled = lambda x: F.when(x >= F.col("drawn"), F.col("quota")).otherwise(F.floor(x * (F.col("quota") / F.col("drawn"))))
    out = run.select("source_no", "n_blocks", "shard", scaled(F.col("upto") - F.col("c")).alias("first_k"), scaled(F.col("upto")).alias("end_k"))
    # a source so small that no slot drew it goes to one shard whole
    missed = totals.filter("drawn IS NULL").select("source_no", "n_blocks", F.pmod(F.xxhash64(F.lit(seed), "source_no"), F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("first_k"), F.col("quota").alias("end_k"))
    return out.unionByName(missed).withColumn("n", F.col("end_k") - F.col("first_k")).drop("end_k").filter("n > 0")


def plan(spark: SparkSession, sources: DataFrame, block_words: int = 64, shard_slots: int = 1024, seed: int = 17, slots_a_task: int = 100_000) -> DataFrame:
    """The mix's slots: (source_no, epoch, block, shard, slot), made shard by shard from the shards' drawn counts."""
    sources = materialize(quotas(sources, block_words), "mix-quotas")
    counts = materialize(shard_counts(spark, sources, shard_slots, seed), "mix-shards")
    n_slots = counts.agg(F.sum("n")).first()[0] or 0
    in_shard = Window.partitionBy("shard").orderBy("source_no")
    size = F.sum("n").over(in_shard.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    dealt = counts.withColumn("size", size).withColumn("first", F.sum("n").over(in_shard) - F.col("n"))
    # an explicit number of partitions, which adaptive execution leaves as it is: few rows, but each becomes many
    dealt = dealt.repartition(max(1, -(-n_slots // slots_a_task)), "shard", "source_no")
    slots = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    k = F.col("first_k") + F.col("i")
    epoch = F.floor(k / F.col("n_blocks"))
    block = shuffle_index(F.pmod(k, F.col("n_blocks")), F.col("n_blocks"), F.xxhash64(F.lit(seed), F.col("source_no"), epoch))
    place = shuffle_index(F.col("first") + F.col("i"), F.col("size"), F.xxhash64(F.lit(seed), F.lit("shard"), F.col("shard")))
    return slots.select("source_no", epoch.alias("epoch"), block.alias("block"), "shard", place.alias("slot"))


def mix(docs: DataFrame, block_words: int = 64, shard_slots: int = 1024, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, segments): every document with its size, source_size and target; and the mix itself, one row for each
    piece of a document in a slot: row id, shard, slot, epoch, first word, number of words. Its order is (shard, slot,
    place in the block)."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_key().alias("key"), F.xxhash64("doc_id", "source", "text").alias("row_hash"))
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(targets(sizes).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "mix-sources")
    named = sources.select(F.col("source").alias("s_source"), "source_size", "target", "source_no")
    full = placed(rows).join(named, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    full = materialize(full.select("row_id", "key", "doc_id", "size", "source_size", "target", "source_no", "start"), "mix-placed")
    blocks = full.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    blocks = blocks.select("source_no", "block", "row_id", (low - F.col("block") * block_words).alias("place"), (low - F.col("start")).alias("first_word"), (high - low).alias("words"))
    # slots come from a few rows, so the planner takes them for small: a sort-merge join, never a broadcast
    slots = plan(docs.sparkSession, sources, block_words, shard_slots, seed).hint("merge")
    segments = blocks.join(slots, ["source_no", "block"]).select("row_id", "shard", "slot", "place", "epoch", "first_word", "words")
    return full, segments


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of query op4."""
    rows, segments = mix(docs, **options)
    taken = segments.groupBy("row_id").agg(F.sum("words").alias("t"))
    return rows.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each document and epoch the words taken, in order, joined by one space; same columns.

    A document of which nothing is taken does not come out; one taken in several epochs comes out several times. Rows of a
    shard, the one where a document's epoch first stands, come together and in the order of their slots.
    """
    rows, segments = mix(docs, **options)
    taken = segments.groupBy("row_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("parts"), F.min(F.struct("shard", "slot", "place")).alias("at"))
    taken = taken.join(rows.select("row_id", "key"), "row_id").select(F.col("key").alias("k"), "parts", "at")
    # repeated rows share a key: one of them stands for all, and each brings its own takes
    texts = one_of_each(docs, row_key())
    out = texts.join(taken.hint("merge"), "k").withColumn("words", F.split(F.btrim("row.text", F.lit(" \t\n\x0b\x0c\r")), WORD_SEPARATORS))
    piece = lambda p: F.slice("words", F.least(p["first_word"].cast("int") + 1, F.size("words")), p["words"].cast("int"))
    out = out.select("row", "at", F.array_join(F.flatten(F.transform("parts", piece)), " ").alias("text"))
    out = out.repartition("at.shard").sortWithinPartitions("at")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
