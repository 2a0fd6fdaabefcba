"""Mixing of sources to target weights by systematic sampling.

Each source's documents are in a fixed order. A document's expected copies are its source's rate (target
over size); with one random offset per source added to the prefix sum of expected copies, a document is
taken once for each integer that its step of the sum crosses. Sizes ascend, so that the words taken differ
from those expected by no more than the largest document.

So that long documents don't take their source away from the target, a source is sampled in parts: those of
more than a quarter of the target first, then those of more than a sixteenth, and so on. A part's rate is
that of the words still to be taken to the words of all documents left, so each part makes up for the ones
before. A source whose words are mostly in long documents, or which is little more than one of them, ends as
near as whole documents allow.

As a rate holds for a whole part, the prefix sum is rate times rank, and a rank is the sum of the counts of
the groups before plus the row number within its group. Groups (levels of size, then hashed chunks of a
bounded expected number of documents) keep a hot source from being sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import checkpointed, fresh

#: A source's words are taken so many times at most, and documents of a chunk (expected).
MOST_TIMES, CHUNK = 3, 5_000
#: Of a target, what documents have more of that are sampled before the others.
LARGE = (4, 16, 64, 256)
#: Levels of size for each power of two.
LEVELS = 8
SEED = 20_240_601


def word_count(text: Column) -> Column:
    """Words between ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \x09-\x0D]++")), F.lit(0)).cast("long")


def _sized(docs: DataFrame, chunks: int) -> DataFrame:
    size = word_count(F.col("text"))
    level = F.floor(F.log2(F.col("size") + 1) * LEVELS).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(chunks)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")).withColumns({"level": level, "chunk": chunk})


def source_targets(sizes: DataFrame, most_times: float = MOST_TIMES, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from sizes (source, source_size), one row for each source.

    Sources in code point order, null last, weigh `weights`, repeating, and share all words; a target
    stops at most_times its source's size and the excess is shared by weight among the others until none
    is above. In ascending order of cap by weight, those sources are capped whose share of what the capped
    ones before them leave would exceed the cap. The windows run over one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most_times))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = rising.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = weighed.withColumn("each", left / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.first(F.when(F.col("cap") > F.col("w") * F.col("each"), F.col("each")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = share.withColumn("open", F.col("cap") > F.col("w") * F.col("each")).withColumn("each", F.coalesce(level, F.lit(0.0)))
    opened = F.max(F.col("open").cast("int")).over(rising.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return marked.select("source", "source_size", F.when(opened, F.col("w") * F.col("each")).otherwise(F.col("cap")).alias("target"))


def mix_copies(docs: DataFrame, most_times: float = MOST_TIMES, weights: tuple[float, ...] = (1, 2, 3), chunk: int = CHUNK, large: tuple[int, ...] = LARGE) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs (doc_id, text, source).

    size is in words (null text: 0); a null source is a source. copies is how often the mix takes the row,
    never above most_times (rounded up). A source without words has target 0 and none of its rows is taken.
    Rows that repeat a doc_id are rows of their own; rows of one size are in the order of doc_id, null first.
    Texts count whole. Reruns agree: the order and the offset are hashes. Other columns are not read. An empty
    table gives no rows.
    """
    chunks = max(1, -(-docs.count() // chunk))
    sized = checkpointed(_sized(docs, chunks))
    groups = sized.groupBy("source", "level", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), most_times, weights).withColumnRenamed("source", "t_source")
    groups = groups.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # a level is of a part if all of its documents are
    parts = [(F.col("level") <= F.floor(F.log2(F.col("target") / x + 1) * LEVELS)).cast("int") for x in large]
    groups = groups.withColumn("part", sum(parts, F.lit(0)))
    before = Window.partitionBy("source", "part").orderBy("level", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    groups = checkpointed(groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    placed = groups.select(F.col("source").alias("g_source"), F.col("level").alias("g_level"), F.col("chunk").alias("g_chunk"), "before", "part", "source_size", "target")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("source", "level", "chunk").orderBy("size", "doc_id")))
    joined = ranked.join(placed, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("level") == F.col("g_level")) & (F.col("chunk") == F.col("g_chunk")))
    joined = checkpointed(joined.select("doc_id", "source", "size", "source_size", "target", "part", (F.col("before") + F.col("rank")).alias("upto")))
    words = groups.groupBy(F.col("source").alias("of"), "part").agg(F.sum("words").alias("words"), F.first("target").alias("target"))
    words = checkpointed(words.groupBy("of").agg(F.first("target").alias("aim"), *[F.sum(F.when(F.col("part") >= k, F.col("words")).otherwise(0)).alias(f"left{k}") for k in range(len(large) + 1)]))
    still, found = words.withColumn("still", F.col("aim")), []
    for k in range(len(large) + 1):
        rate = F.when(F.col(f"left{k}") > 0, F.least(F.greatest(F.col("still") / F.col(f"left{k}"), F.lit(0.0)), F.lit(float(most_times)))).otherwise(0.0)
        own = joined.where(F.col("part") == k).join(still.select("of", rate.alias("rate")), F.col("source").eqNullSafe(F.col("of")))
        own = own.withColumn("copies", _crossed(F.col("rate"), F.col("upto"), "source", k)).select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))
        found.append(own)
        if k < len(large):
            taken = own.groupBy(F.col("source").alias("t_source")).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
            still = checkpointed(still.join(taken, F.col("of").eqNullSafe(F.col("t_source")), "left").withColumn("still", F.col("still") - F.coalesce("taken", F.lit(0))).drop("t_source", "taken"))
    return reduce(DataFrame.unionByName, found)


def _crossed(rate: Column, upto: Column, source: str, part: int) -> Column:
    """The integers that a step of `rate` crosses which ends at `upto` steps from the source's offset."""
    # a multiple of 1/1024, so that whole rates stay exact
    offset = (F.pmod(F.xxhash64(source, F.lit(SEED + part)), F.lit(1023)) + 1) / 1024
    return F.floor(offset + rate * upto) - F.floor(offset + rate * (upto - 1))


def mix(docs: DataFrame, most_times: float = MOST_TIMES, weights: tuple[float, ...] = (1, 2, 3), chunk: int = CHUNK) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or more); all columns stay, whatever their names.

    Rows of equal doc_id, source and size share what is drawn for them evenly. Null, empty and very long
    texts, null sources and empty tables are as in `mix_copies`.
    """
    names = docs.columns
    doc, source, size, all_, n, k, own, copy, words, key = fresh(docs, "doc", "source", "size", "all", "n", "k", "own", "copy", "words", "key")
    drawn = mix_copies(docs, most_times, weights, chunk).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(all_), F.count("*").alias(n)).where(F.col(all_) > 0)
    drawn = drawn.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), all_, n)
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    keyed = docs.withColumns({words: word_count(F.col("text")), key: F.col("doc_id").cast("long")})
    keyed = keyed.withColumn(k, F.row_number().over(Window.partitionBy(key, "source", words).orderBy("text")) if repeated else F.lit(1))
    match = F.col(key).eqNullSafe(F.col(doc)) & keyed["source"].eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    share = F.floor(F.col(all_) * F.col(k) / F.col(n)) - F.floor(F.col(all_) * (F.col(k) - 1) / F.col(n))
    return keyed.join(drawn, match).withColumn(own, share.cast("int")).where(F.col(own) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*names)
