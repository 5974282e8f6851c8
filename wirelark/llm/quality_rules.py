"""Quality rules with adaptive thresholds: quantile sketches per language and source instead of fixed cutoffs.

A sketch is a count for each bin of a measure; a bin keeps the seven leading bits of an integer, so a quantile read
from it is off by less than 1/64 of itself. Sketches of parts are merged by adding counts, hence a group of any size costs a few
hundred rows per task. The fence of a group is Q75 + ``FENCE`` * max(Q75 - Q25, ``SPREAD``): what lies
beyond it is unlike its own language and source. ``SPREAD``, in the units of the measure, keeps a group whose documents
are all alike from rejecting the first that differs a little. A group without a single document that passes the base
rules has no fence and rejects nothing. DataFrame functions only.

Nulls and edge cases: a null, empty or blank text has no words and fails the base rules; a null language or
source is a value of its own; repeated rows each count; windows are compared by 64-bit hash.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelark.llm.common import SPACES, broadcast_if_small, evaluated_once, word_array
from wirelark.session import store

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
BITS = 7
FENCE = 3
# Measures per thousand words (characters: per hundred), and the least spread of each.
MEASURES = {
    "word_length": "word_chars * 100 div n_words",
    "symbols": "n_symbols * 1000 div n_words",
    "dup_lines": "n_dup_lines * 1000 div n_words",
    "repeats": "n_repeat_words * 1000 div n_words",
}
SPREAD = {"word_length": 100, "symbols": 40, "dup_lines": 12, "repeats": 110}


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS]
    split = evaluated_once(docs, words_=word_array(F.col("text")), lines_=lines)
    counted = split.withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.length(F.array_join("words_", "")).cast("long"),
            "n_symbols": sum(symbols[1:], symbols[0]).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        }
    )
    windows = F.expr(
        "transform(slice(words_, 1, greatest(n_words - 2, 0)), (w, i) -> xxhash64(w, words_[i + 1], words_[i + 2]))"
    )
    hashed = evaluated_once(counted.drop("lines_"), windows_=F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    hashed = hashed.drop("words_")
    sortable = F.expr("array_sort(transform(windows_, (h, i) -> named_struct('h', h, 'i', i)))")
    some = F.size(F.array_distinct("windows_")) < F.size("windows_")
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    ordered = evaluated_once(hashed, sorted_=F.when(some, sortable).otherwise(none)).drop("windows_")
    again = F.expr(
        "array_sort(filter(transform(sorted_, (x, k) -> if(x.h = get(sorted_, k - 1).h or x.h = get(sorted_, k + 1).h, x.i, null)),"
        " i -> i is not null))"
    )
    starts = evaluated_once(ordered, starts_=F.when(F.size("sorted_") > 0, again).otherwise(F.array().cast("array<int>"))).drop("sorted_")
    # Each start covers three words, fewer if the next one begins within them.
    covered = F.expr(
        "aggregate(transform(starts_, (s, k) -> least(3, coalesce(get(starts_, k + 1) - s, 3))), 0L, (a, x) -> a + x)"
    )
    done = evaluated_once(starts, n_repeat_words=covered).drop("starts_")
    failed = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"
    return done.withColumn("base_failed", F.expr(failed))


def fences(rows: DataFrame) -> DataFrame:
    """``lang``, ``source`` and a fence for each measure, from the rows that pass the base rules."""
    values = rows.where("not base_failed").select(
        "lang", "source",
        F.explode(F.create_map(*[x for n, e in MEASURES.items() for x in (F.lit(n), F.expr(e))])).alias("measure", "value"),
    )
    drop = F.greatest(F.length(F.bin("value")) - BITS, F.lit(0))
    sketch = values.withColumn("drop", drop).withColumn("bin", F.expr("shiftleft(shiftright(value, drop), drop)"))
    sketch = sketch.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source", "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(group)})
    quartile = {q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))) for q in (1, 3)}
    read = ranked.groupBy("lang", "source", "measure").agg(quartile[1].alias("q1"), quartile[3].alias("q3"))
    least = F.create_map(*[F.lit(x) for pair in SPREAD.items() for x in pair])
    read = read.withColumn("fence", F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")]))
    return read.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == n, F.col("fence"))).alias(f"{n}_fence") for n in MEASURES]
    )


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``lang``, ``source``, ``text``) without the text, with the measures, ``base_failed`` and ``kept``."""
    rows = store(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality")
    limits = store(fences(rows), "fences").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    within = [f"coalesce({e} <= {n}_fence, true)" for n, e in MEASURES.items()]
    kept = F.expr("case when base_failed then false else " + " and ".join(within) + " end")
    return rows.join(broadcast_if_small(limits), same, "left").withColumn("kept", kept).drop("of_lang", "of_source")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

_VALUES = ", ".join(
    f"('{n}', {e.replace(' div ', ' // ')}, {SPREAD[n]})" for n, e in MEASURES.items()
)
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT row, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2] FOR j IN range(1, len(ws) - 1)]) AS w
  FROM docs WHERE len(ws) >= 3),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
base AS (
  SELECT d.row, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')])
            - len(list_distinct([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')])) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON d.row = c.row),
failed AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM base),
measures AS (
  SELECT f.row, lang, source, m.measure, m.value, m.spread
  FROM failed f, LATERAL (SELECT * FROM (VALUES {_VALUES}) t(measure, value, spread)) m WHERE NOT base_failed),
bins AS (
  SELECT lang, source, measure, spread, (value >> greatest(length(bin(value)) - {BITS}, 0)) << greatest(length(bin(value)) - {BITS}, 0) AS bin,
         count(*) AS n FROM measures GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS every FROM bins),
quartiles AS (
  SELECT lang, source, measure, spread, min(bin) FILTER (upto * 4 >= every) AS q1, min(bin) FILTER (upto * 4 >= every * 3) AS q3
  FROM ranked GROUP BY ALL),
beyond AS (
  SELECT DISTINCT m.row FROM measures m JOIN quartiles q
  ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source AND m.measure = q.measure
  WHERE m.value > q3 + {FENCE} * greatest(q3 - q1, q.spread))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND b.row IS NULL AS kept
FROM failed f LEFT JOIN beyond b ON f.row = b.row
"""
