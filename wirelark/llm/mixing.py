"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The words of each source, its documents shuffled, are one stream, cut into blocks of equally many words. Slot ``n``
of the mix takes the golden-ratio point frac(n * phi); the cumulative targets map it to a source, and the slot's
rank among that source's slots is the block that it gets. So every stretch of the mix holds the sources near
their weights. A source's stream is passed through at most ``max_epochs`` times, each time in another order.

All sums that run along a source or along the slots are taken in two steps, within chunks of about the square root of the
rows and then over the chunks, so no task holds a source. DataFrame functions only.

Nulls and edge cases: a null source is a source of its own, the last one; a null or empty text has size 0
and takes part with 0 words; repeated rows each count; a null ``doc_id`` is shuffled like any other; an empty table,
or one without words, gives targets of 0 and takes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelark.llm.common import broadcast_if_small, word_array
from wirelark.session import store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 256
GOLDEN = (math.sqrt(5) - 1) / 2
# frac(2**26 * GOLDEN): large slot numbers are split in two so that no product loses its fraction.
_STEP = 1 << 26
_GOLDEN_STEP = (_STEP * GOLDEN) % 1


def sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, its number of words."""
    return docs.withColumn("size", F.size(word_array(F.col("text"))).cast("long"))


def targets(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (``source``, ``source_size``; one row each) with ``weight`` and ``target``.

    Sources share ``share`` of all sizes by weight, none above ``max_epochs`` times its size. Raising all by one common
    level until each is at its cap or at level times weight is what resharing the excess again and again ends at.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sources.withColumn("number", F.row_number().over(by_name)).withColumns(
        {
            "weight": F.get(weights, (F.col("number") - 1) % len(WEIGHTS)).cast("long"),
            "cap": F.col("source_size") * max_epochs,
        }
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumns(
        {
            "level": (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(after)
        }
    ).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = levels.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("number"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return final.withColumn("target", target).select("number", "source", "source_size", "weight", "target")


def _running(rows: DataFrame, key: str, chunk: str, order: list, value: str, into: str) -> DataFrame:
    """``rows`` with ``into``, the sum of ``value`` over the rows before it in its ``key``: by ``chunk``, then by ``order``."""
    totals = rows.groupBy(key, chunk).agg(F.sum(value).alias("chunk_total"))
    along = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, chunk, F.coalesce(F.sum("chunk_total").over(along), F.lit(0)).alias("chunk_start"))
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, [key, chunk]).withColumn(
        into, F.col(into) + F.col("chunk_start")
    ).drop("chunk_start")


def shuffle_key(epoch: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def slots(sources: DataFrame, total: int, source_count: int) -> DataFrame:
    """``number`` (of the source), ``rank`` and ``slot`` of the schedule.

    ``sources`` has ``number`` and ``blocks``, how many blocks each is to give; ``total`` is their sum. The points
    leave a source a few blocks over or short; what is over is left out and what is short comes at the end.
    """
    spark, whole = sources.sparkSession, Window.partitionBy()
    along = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.where("blocks > 0").withColumn("share", F.col("blocks") / F.sum("blocks").over(whole))
    shares = shares.withColumn("upper", F.sum("blocks").over(along) / F.sum("blocks").over(whole))
    # The interval of a source is looked up through a grid of cells, so that the lookup is an equality.
    grid = 4 * source_count
    cells = shares.select(
        "number", "upper", (F.col("upper") - F.col("share")).alias("about"),
        F.lag("upper", 1, 0.0).over(Window.orderBy("number")).alias("lower"),
    )
    cells = cells.select(
        "number", "lower", "upper",
        F.explode(F.sequence(F.floor(F.col("lower") * grid), F.floor(F.col("upper") * grid))).alias("cell"),
    )
    cells = broadcast_if_small(store(cells, "mix-cells"))
    n = F.col("slot")
    golden = (n % _STEP) * F.lit(GOLDEN) + F.expr(f"slot div {_STEP}") * F.lit(_GOLDEN_STEP)
    drawn = spark.range(total).select(F.col("id").alias("slot")).withColumn("point", golden - F.floor(golden))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") * grid)).join(cells, "cell")
    drawn = drawn.where("point >= lower and point < upper").select(
        "slot", "number", F.expr(f"slot div {max(1 << 12, math.isqrt(total))}").alias("chunk"), F.lit(1).alias("one")
    )
    ranked = store(_running(drawn, "number", "chunk", ["slot"], "one", "rank").select("number", "rank", "slot"), "mix-slots")
    had = ranked.groupBy("number").agg(F.count("*").alias("had"))
    short = (
        sources.join(had, "number", "left")
        .withColumn("had", F.coalesce("had", F.lit(0).cast("long")))
        .where("had < blocks")
        .select("number", "had", F.explode(F.expr("sequence(had, blocks - 1)")).alias("rank"))
        .select("number", "rank", (F.lit(total) + (F.col("rank") - F.col("had")) * source_count + F.col("number")).alias("slot"))
    )
    allowed = broadcast_if_small(sources.select("number", "blocks"))
    used = ranked.join(allowed, "number").where("rank < blocks").select("number", "rank", "slot")
    return used.unionByName(short)


def mix(
    rows: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS
) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the mix: ``slot``, ``row``, ``epoch``, ``first`` and ``words``.

    ``rows``, a stored table, has ``row`` (unique), ``doc_id``, ``source`` and ``size``. Each row of the mix says that the slot takes
    ``words`` words of that row from its word ``first`` on. A source takes as many words as its target has, to the word.
    """
    spark = rows.sparkSession
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, max_epochs)
    sources = sources.withColumn("need", F.floor("target")).withColumn("blocks", F.expr(f"(need + {block - 1}) div {block}"))
    sources = store(sources, "mix-sources")
    counts = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
    schedule = slots(sources.select("number", "blocks"), counts["blocks"], max(1, counts["n"]))

    few = broadcast_if_small(sources.select(F.col("source").alias("of"), "number", "source_size", "need"))
    known = rows.join(few, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    chunks = max(1, math.isqrt(rows.count()))
    streams = None
    for epoch in range(max_epochs):
        shuffled = known.where(F.col("need") > epoch * F.col("source_size")).withColumn("key", shuffle_key(epoch, F.col("doc_id")))
        shuffled = shuffled.withColumn("chunk", F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) as long) * {chunks} div 4294967296"))
        placed = _running(shuffled, "number", "chunk", ["key", "doc_id", "size"], "size", "start")
        placed = placed.withColumns({"epoch": F.lit(epoch), "start": F.col("start") + epoch * F.col("source_size")}).drop("key", "chunk")
        streams = placed if streams is None else streams.unionByName(placed)
    pieces = streams.where("size > 0 and start < need").withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("need")))
    pieces = pieces.select(
        "row", "epoch", "number", "start", "stop",
        F.explode(F.expr(f"sequence(start div {block}, (stop - 1) div {block})")).alias("rank"),
    )
    begin = F.greatest(F.col("start"), F.col("rank") * block)
    words = F.least(F.col("stop"), (F.col("rank") + 1) * block) - begin
    taken = pieces.select("row", "epoch", "number", "rank", (begin - F.col("start")).alias("first"), words.alias("words"))
    return sources, taken.join(schedule, ["number", "rank"]).select("slot", "row", "epoch", "first", "words")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, stored, so that a row keeps its number."""
    return store(docs.withColumn("row", F.monotonically_increasing_id()), "mix-rows")


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` for every row of ``docs``."""
    rows = numbered(sizes(docs).select("doc_id", "source", "size"))
    sources, mixed = mix(rows)
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    few = broadcast_if_small(sources.select(F.col("source").alias("of"), "source_size", "target"))
    return (
        rows.join(few, F.col("source").eqNullSafe(F.col("of")))
        .join(taken, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """What the mix holds, in the columns of ``docs``: a row for each pass through a document that takes words of it, with those
    words as ``text`` (the whole text unchanged if it takes all) and their length as ``n_chars``."""
    rows = numbered(sizes(docs))
    _, mixed = mix(rows.select("row", "doc_id", "source", "size"))
    passes = mixed.groupBy("row", "epoch").agg(F.sum("words").alias("words"))
    part = F.array_join(F.slice(word_array(F.col("text")), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part)
    made = rows.join(passes, "row").withColumn("text", text)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS number, 2 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER
             (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / CAST(sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked),
final AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, number LIMIT 1),
target AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM final) * weight) AS target FROM levels),
placed AS (
  SELECT doc_id, size, s.source_size, s.target, floor(s.target) AS need, e.epoch,
         e.epoch * s.source_size + coalesce(sum(size) OVER (PARTITION BY d.source, e.epoch
           ORDER BY md5(e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, d.row
  FROM (SELECT *, row_number() OVER () AS row FROM sized) d JOIN target s ON d.source IS NOT DISTINCT FROM s.source
  CROSS JOIN (SELECT unnest([0, 1]) AS epoch) e)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(greatest(0, least(start + size, need) - start)) AS BIGINT) AS taken
FROM placed GROUP BY row
"""
