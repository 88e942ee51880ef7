"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled into one ring of words, cut into equal blocks. A schedule of slots, as many as the mix
has blocks, is dealt out by the golden-ratio sequence: slot n's point falls into one source's part of the cumulative
weights, so any stretch of the schedule is near the weights. A slot takes its source's next block, by its rank among the
source's slots. A source short of its target at the end gets closing slots; past its target it has none.

Sizes, sources and shuffles stay columns: texts are read once and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import positional
from tidemark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# floor(2^48 / golden ratio), odd: multiples modulo 2^48 are the fixed-point golden-ratio sequence
UNIT, STEP = 1 << 48, 173961102589771


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before each row, carried over range partitions instead of in one task."""
    placed = cut_lineage(df.sort(order).withColumn("_part", F.spark_partition_id()).withColumn("_value", value))
    # one number for each partition comes to the driver and goes back
    sums = sorted(map(tuple, placed.groupBy("_part").agg(F.sum("_value")).collect()))
    starts = [(part, float(sum(x for _, x in sums[:i]))) for i, (part, _) in enumerate(sums)] or [(0, 0.0)]
    carried = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _before double"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(order)) - F.col("_value")
    return placed.withColumn("_inside", inside).join(carried, "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_value")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Adds `target`: shares by weight of all sizes, none above `most` times its source's size.

    sources: a row for each source with `source_size` and `weight`. Each round is one aggregate: the sources above their
    bound are fixed there and the rest is shared anew; a round fixes at least one more source or is the last.
    """
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    bound = F.col("source_size") * most
    level = 0.0
    while True:
        # a source is fixed if this level would give it more than its bound
        over = F.lit(level) * F.col("weight") > bound
        fixed, weight = sources.agg(F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        if not weight:
            break
        new = (total - float(fixed or 0)) / float(weight)
        if new == level:
            break
        level = new
    share = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(share > bound, bound.cast("double")).otherwise(share))


def ring(docs: DataFrame, bucket_rows: int = 2000) -> DataFrame:
    """Adds `source_size` and `start`: the place of each row's first word in its source's shuffled ring.

    The shuffle orders rows by a hash of id and text, so repeated rows are neighbours and interchangeable. Sums run over
    hash buckets of about `bucket_rows` rows and then inside each bucket, so no source is one task.
    """
    rows = docs.count()
    digits = 1
    while 16**digits * bucket_rows < rows:
        digits += 1
    hashed = docs.withColumn("_key", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix"))))
    hashed = hashed.withColumn("_bucket", F.substring("_key", 1, digits))
    sums = hashed.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    by_source = Window.partitionBy("source")
    before = F.sum("_size").over(by_source.orderBy("_bucket")) - F.col("_size")
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), before.alias("_before"),
                       F.sum("_size").over(by_source).alias("source_size"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "text_md5")
    placed = hashed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("_place", F.row_number().over(order))
    return (placed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("start", F.col("_before") + F.col("_inside")).drop("_source", "_b", "_before", "_inside"))


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """Slots of the mix: slot, source, rank of the slot among its source's slots.

    sources: number, source, target. Points meet the cumulative weights by cells of the unit interval: a source is listed
    in the cells it touches, a point looks only into its own, and cells get equally many points.
    """
    spark = sources.sparkSession
    total, parts = sources.agg(F.sum("target"), F.count(F.lit(1))).first()
    total = float(total or 0)
    slots = int(-(-total // block_words))
    cells = max(1024, 4 * parts)
    bounds = (running(sources.where("target > 0"), F.col("number").asc(), F.col("target"), "_from").withColumn("_to", F.col("_from") + F.col("target"))
              .select("source", "target", (F.col("_from") / F.lit(total or 1.0)).alias("_low"), (F.col("_to") / F.lit(total or 1.0)).alias("_high")))
    listed = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_low") * cells), F.least(F.floor(F.col("_high") * cells), F.lit(cells).cast("long")))))
    number = F.col("id").cast("decimal(18,0)") * F.lit(STEP).cast("decimal(18,0)")
    point = (number % F.lit(UNIT).cast("decimal(18,0)")).cast("double") / F.lit(float(UNIT))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("_point")).withColumn("cell", F.floor(F.col("_point") * cells))
    dealt = points.join(listed, "cell").where("_point >= _low and _point < _high").select("slot", "source")
    return dealt


def ranked(dealt: DataFrame, sources: DataFrame, block_words: int, slots_per_bucket: int = 4096) -> DataFrame:
    """Slots with `rank`, cut off at the source's target and filled up to it: source, rank, slot.

    Ranks are counted by stretches of the schedule and then inside each, so a heavy source is no single task.
    """
    dealt = dealt.withColumn("_stretch", F.floor(F.col("slot") / slots_per_bucket))
    counts = dealt.groupBy("source", "_stretch").count()
    over = Window.partitionBy("source").orderBy("_stretch")
    counts = counts.select(F.col("source").alias("_s"), F.col("_stretch").alias("_t"), (F.sum("count").over(over) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source", "_stretch").orderBy("slot")) - 1
    ranks = (dealt.withColumn("_inside", inside)
             .join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_stretch") == F.col("_t")))
             .select("source", "slot", (F.col("_before") + F.col("_inside")).alias("rank")))
    need = sources.select(F.col("source").alias("_s"), F.ceil(F.round("target") / block_words).alias("_need"))
    kept = ranks.join(need, F.col("source").eqNullSafe(F.col("_s"))).where("rank < _need").select("source", "rank", "slot")
    have = ranks.groupBy("source").agg(F.count(F.lit(1)).alias("_have")).withColumnRenamed("source", "_r")
    short = (need.join(have, F.col("_s").eqNullSafe(F.col("_r")), "left").withColumn("_have", F.coalesce("_have", F.lit(0).cast("long")))
             .where("_have < _need")
             .select(F.col("_s").alias("source"), F.explode(F.sequence("_have", F.col("_need") - 1)).alias("rank"), F.lit(None).cast("long").alias("slot")))
    return kept.union(short)


def mixture(docs: DataFrame, block_words: int = 1024, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix of `docs` (doc_id, text, source).

    rows: doc_id, source, text_md5, size, source_size, target, start, _bucket and _place, the last two naming the row within its
    source.
    pieces: source, _bucket, _place, pass, rank, slot, first, words: which words of which row each slot takes,
    `pass` counting the rounds of the ring. `slot` is NULL for closing slots.

    Null and empty texts have size 0 and are never taken. NULL is a source of its own, after all others. Repeated rows are
    rows of their own. With no words at all every target is 0. Other columns are not read.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.col("text")).alias("text_md5"))
    sized = cut_lineage(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = running(sources, F.col("source").asc_nulls_last(), F.lit(1), "number")
    sources = sources.withColumn("number", F.col("number").cast("long")).withColumn("weight", F.col("number") % 3 + 1)
    sources = cut_lineage(targets(cut_lineage(sources), most))
    goal = sources.select(F.col("source").alias("_goal"), "target")
    rows = cut_lineage(ring(sized).join(goal, F.col("source").eqNullSafe(F.col("_goal"))).drop("_goal", "_key"))
    slots = ranked(schedule(sources, block_words), sources, block_words).select(F.col("source").alias("_s"), F.col("rank").alias("_k"), "slot")
    # each row in each pass of the ring, cut at block borders; what lies past the target has no slot
    end = F.round("target").cast("long")
    laps = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    turns = (rows.where("size > 0").select("*", laps).withColumn("_from", F.col("start") + F.col("pass") * F.col("source_size"))
             .withColumn("_to", F.least(F.col("_from") + F.col("size"), end)).where("_from < _to")
             .withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words)))))
    low = F.greatest(F.col("_from"), F.col("_block") * block_words)
    high = F.least(F.col("_to"), (F.col("_block") + 1) * block_words)
    pieces = (turns.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_k")))
              .select("source", "_bucket", "_place", "pass", F.col("_block").alias("rank"), "slot", (low - F.col("_from")).alias("first"), (high - low).alias("words")))
    return rows, pieces


def taken_rows(docs: DataFrame, block_words: int = 1024, most: int = 3) -> DataFrame:
    rows, pieces = mixture(docs, block_words, most)
    sums = pieces.groupBy(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.col("_place").alias("_p")).agg(F.sum("words").alias("taken"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("_place") == F.col("_p"))
    return rows.join(sums, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def taken_words(docs: DataFrame, block_words: int = 1024, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of `docs`; see `mixture` for nulls, ties and empty input."""
    return taken_rows(docs, block_words, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = 1024, most: int = 3) -> DataFrame:
    """The mix as documents: one row for each time a document is taken, its text cut where its source's target cuts it.

    Columns are those of `docs`; `n_chars`, if there, follows the text. Rows with nothing taken go. Repeated rows (same id,
    source and text) are taken as often as all of them together.
    """
    shares = (taken_rows(docs, block_words, most).where("taken > 0")
              .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_md5").alias("_md5"))
              .agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken")))
    plain, names, _ = positional(docs)
    id, text, source = (names[docs.columns.index(c)] for c in ("doc_id", "text", "source"))
    same = F.col("_text").eqNullSafe(F.col("_md5")) & F.col(id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source"))
    joined = plain.withColumn("_text", F.md5(text)).join(shares, same).dropDuplicates(["_text", id, source])
    lap = joined.withColumn("_lap", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))))
    lap = lap.withColumn("_words", F.least(F.col("_size"), F.col("_taken") - F.col("_lap") * F.col("_size")))
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_words").cast("int")))
    out = lap.withColumn(text, F.when(F.col("_words") < F.col("_size"), part).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn(names[docs.columns.index("n_chars")], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)
