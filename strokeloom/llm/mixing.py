"""Mixing sources to target weights (operator 8), DataFrame functions only.

Sizes are summed per source, targets follow by water-filling, and every document is emitted
floor(rate) times plus one more with the probability that is left: a Bernoulli draw from the hash of
a seed, its doc_id and its text. A document's draw depends on itself alone, so reruns agree whatever
the order and the partitioning.

The probability is the fraction of the rate, corrected by what is drawn: with the fraction itself a
source of few or uneven documents comes out several per cent off its target. So the words are also
summed by the first ``GRAIN_BITS`` bits of the draws, in the aggregation that sums the sources, and
the probability is the multiple of 2**-GRAIN_BITS at which the words drawn come nearest to the target.
For a source of n even documents that differs from the fraction by some 1 / sqrt(n).

Targets: sources weigh 1, 2, 3, repeating, by code point with null last, and share the total by
weight, but none gets more than ``max_repeats`` times its size; what is over goes to the others by
weight until none is above. That fixed point is min(cap, weight * level) with one level for all:
with sources ordered by cap / weight, it is the first at which the sources beyond can take what is
left. The only ordered window runs over one row per source, after the aggregation.

Defined results: a null text has size 0; a null source is a source, the last; a source of size 0
has target 0 and takes 0 words; ``mix`` emits its empty documents once if ``keep_empty`` (they cost
nothing). Rows equal in doc_id and text draw alike, rows that share only a doc_id each for themselves.
An empty table gives no rows. A text may be of any length. Extra columns are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import runtime

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
DRAW_BITS, GRAIN_BITS = 48, 10


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size, target from rows with source and size: one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    weighted = per.select("*", F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).alias("weight"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighted.select("*", (max_repeats * F.col("source_size")).alias("cap")).select(
        "*",
        (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    level = F.col("left").cast("double") / F.col("left_weight")
    return ranked.select("source", "source_size", "weight", "cap", F.max(level).over(everyone).alias("level")).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target")
    )


def number(*parts: Column) -> Column:
    """48 bits of the hash of the parts as text."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The number that decides a row's last copy."""
    return number(F.lit(seed), F.col(doc_id), F.md5(F.col(text).cast("binary")))


def grains(rows: DataFrame) -> DataFrame:
    """source, grain, size: words of rows (source, size, _draw) by the first bits of their draws."""
    grain = F.shiftright("_draw", DRAW_BITS - GRAIN_BITS)
    return runtime.table(rows.groupBy("source", grain.alias("grain")).agg(F.sum("size").alias("size")))


def rates(summed: DataFrame, max_repeats: int, empty_copies: int) -> DataFrame:
    """source, source_size, target, whole, cut of summed grains: every document is taken whole times, and once more if its grain is below cut."""
    aims = targets(summed, max_repeats)
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(F.lit(empty_copies)).cast("long"))
    lacking = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("grain").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = summed.select("source", "grain", upto.cast("double").alias("upto"))
    met = aims.withColumn("lacking", lacking).join(taken.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    best = met.groupBy("source", "source_size", "target", "whole", "lacking").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("lacking")).alias("off"), (F.col("grain") + 1).alias("cut"))).alias("best"))
    nearer = (F.col("source_size") > 0) & (F.col("best.off") < F.abs("lacking"))
    return runtime.table(best.select("source", "source_size", "target", "whole", F.when(nearer, F.col("best.cut")).otherwise(0).cast("long").alias("cut")))


def with_copies(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (with source and _draw) and source_size, target and copies by the rates of their source."""
    met = rows.join(runtime.bounded_broadcast(made.withColumnRenamed("source", "_aim")), F.col("source").eqNullSafe(F.col("_aim")))
    more = F.shiftright("_draw", DRAW_BITS - GRAIN_BITS) < F.col("cut")
    return met.withColumn("copies", F.col("whole") + more.cast("long")).drop("_aim", "_draw", "whole", "cut")


def plan(docs: DataFrame, seed: int = 8, max_repeats: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs."""
    sizes = runtime.table(docs.select("doc_id", "source", words().alias("size"), draw(seed).alias("_draw")))
    return with_copies(sizes, rates(grains(sizes), max_repeats, 0)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = 8, max_repeats: int = 3, keep_empty: bool = True) -> DataFrame:
    """The mixed corpus: rows of docs, repeated or gone as planned, with all their columns. Texts are read twice and shuffled never."""
    made = rates(grains(docs.select("source", words().alias("size"), draw(seed).alias("_draw"))), max_repeats, int(keep_empty))
    rows = docs.select("source", F.struct(*docs.columns).alias("_row"), draw(seed).alias("_draw"))
    planned = with_copies(rows, made)
    return planned.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed rows, with the five columns of documents; other columns are dropped."""
    return mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def oracle(documents: str = "documents", seed: int = 8) -> str:
    """DuckDB SQL for the plan: doc_id, source, size, source_size, target, copies."""
    size = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"
    grain = f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 12) AS BIGINT) >> {DRAW_BITS - GRAIN_BITS}"
    return rf"""
WITH d AS (SELECT doc_id, source, {size} AS size, {grain} AS grain FROM {documents}
), s AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(least(target / source_size, 3.0::DOUBLE)) AS BIGINT) ELSE 0 END AS whole FROM (
    SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM (
      SELECT *, CAST(lefts AS DOUBLE) / left_weight AS level FROM (
        SELECT *, total - coalesce(sum(cap) OVER b, 0) AS lefts, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight FROM (
          SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source))
        WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))
), g AS (SELECT source, grain, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY grain) AS DOUBLE) AS upto FROM d GROUP BY 1, 2
), o AS (SELECT s.source, grain, target - CAST(whole * source_size AS DOUBLE) AS lacking, abs(upto - (target - CAST(whole * source_size AS DOUBLE))) AS away FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
), c AS (SELECT source, grain + 1 AS cut FROM o WHERE away < abs(lacking) QUALIFY row_number() OVER (PARTITION BY source ORDER BY away, grain) = 1)
SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.whole + CASE WHEN source_size > 0 AND d.grain < coalesce(c.cut, 0) THEN 1 ELSE 0 END AS copies
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


ORACLE = f"SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM ({oracle()})"
