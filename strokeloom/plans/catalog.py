"""The registered queries of the raster engine, and DuckDB SQL for those that SQL can express.

The driver's tables hold no images, so each query runs an operator on an adapter: vectors of 64
numbers as 8 x 8 rasters, line items as pixels, events as the segments of one plan per user, order
totals and text lengths as stroke lengths. The adapters are not data of any image library.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokeloom import model, prepare, runtime
from strokeloom.functions import scalar
from strokeloom.operators import cross, kernels, metrics, stencil, strokes
from strokeloom.plans import detect
from strokeloom.sources import rasters, synthetic
from strokeloom.timing import schedule

W = H = 8
TILE = "tile AS (SELECT vec_id AS map_id, CAST(j - 1 AS INTEGER) AS i, CAST((j - 1) % 8 AS INTEGER) AS x, CAST((j - 1) // 8 AS INTEGER) AS y, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings))"
MASK = f"{TILE}, mask AS (SELECT map_id, i, x, y FROM tile WHERE v > 0)"
STEPS = "steps AS (SELECT * FROM (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, 1, 0), (4, 1, 1), (5, 0, 1), (6, -1, 1), (7, -1, 0)) s(k, dx, dy))"
ORDERS = f"{TILE}, o AS (SELECT map_id, i, x, y, CAST(least(floor(v * 512), 254) AS INTEGER) AS ord FROM tile WHERE v > 0)"
DIFFS = "d AS (SELECT a.map_id, a.i, s.k, a.ord, b.ord AS other, abs(a.ord - b.ord) AS diff FROM o a CROSS JOIN steps s JOIN o b ON b.map_id = a.map_id AND b.x = a.x + s.dx AND b.y = a.y + s.dy)"
#: Nothing with fractions is compared to more digits than these.
DIGITS = 6
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def keep(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.tiles(read(spark, sf_dir, "embeddings"))


def mask_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.ink(tiles(spark, sf_dir))


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.orders(tiles(spark, sf_dir))


def item_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels of one map per supplier: colours from keys and quantities."""
    t = read(spark, sf_dir, "lineitem")
    part, order, quantity = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_quantity").cast("int")
    channel = lambda e: e.cast("int")
    return t.select(
        F.col("l_suppkey").alias("map_id"), order.alias("i"), channel(order % 100).alias("x"), channel(F.floor(order / 100) % 100).alias("y"),
        channel(part % 256).alias("br"), channel(order % 256).alias("bg"), channel((part + order) % 256).alias("bb"), F.lit(255).alias("ba"),
        channel((part * 7 + quantity) % 256).alias("cr"), channel((order * 3) % 256).alias("cg"), channel((part + order + quantity) % 256).alias("cb"), (180 + quantity).alias("ca"),
    )


ITEMS = "px AS (SELECT l_suppkey AS map_id, l_orderkey AS i, CAST(l_orderkey % 100 AS INTEGER) AS x, CAST((l_orderkey // 100) % 100 AS INTEGER) AS y, l_partkey % 256 AS br, l_orderkey % 256 AS bg, (l_partkey + l_orderkey) % 256 AS bb, (l_partkey * 7 + CAST(trunc(l_quantity) AS INTEGER)) % 256 AS cr, (l_orderkey * 3) % 256 AS cg, (l_partkey + l_orderkey + CAST(trunc(l_quantity) AS INTEGER)) % 256 AS cb, 180 + CAST(trunc(l_quantity) AS INTEGER) AS ca FROM lineitem)"
CLASSES = f"{ITEMS}, cl AS (SELECT *, CASE WHEN cr - cg > 35 THEN 'accent' ELSE 'road' END AS class FROM px WHERE abs(br - cr) + abs(bg - cg) + abs(bb - cb) > 18 AND ca >= 200)"


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as segments: one plan per user, in order of time and id, kinds by turns of type."""
    from pyspark.sql import Window

    t = read(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.select(F.col("user_id").alias("map_id"), place.alias("id"), "event_id", F.abs(F.coalesce("value", F.lit(0.0))).alias("size"))
    turn = F.col("event_id") % 5
    kind = F.when(F.col("id") == 0, "primaryStroke").when(turn == 1, "crossBackslash").when(turn == 2, "crossSlash").otherwise("annotation")
    return rows.select("map_id", F.col("id").cast("int").alias("id"), kind.alias("kind"), F.floor("size").alias("measure"), F.when(F.col("id") == 0, scalar.clamp(F.floor(F.col("size")) / 100, 0.0, 1.0)).alias("relative_length"))


SEGMENTS = """sg AS (SELECT map_id, CAST(id AS INTEGER) AS id, CASE WHEN id = 0 THEN 'primaryStroke' WHEN event_id % 5 = 1 THEN 'crossBackslash' WHEN event_id % 5 = 2 THEN 'crossSlash' ELSE 'annotation' END AS kind,
  floor(size) AS measure, CASE WHEN id = 0 THEN least(greatest(floor(size) / 100, 0), 1) END AS relative_length
  FROM (SELECT user_id AS map_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id, event_id, abs(coalesce(value, 0)) AS size FROM events)),
sp AS (SELECT *, CASE WHEN id = 0 OR kind = 'primaryStroke' THEN 0 WHEN kind = 'crossBackslash' THEN 120 WHEN kind = 'crossSlash' THEN 50
    WHEN coalesce(sum(CASE WHEN kind = 'annotation' THEN 1 ELSE 0 END) OVER (PARTITION BY map_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 30 ELSE 160 END AS gap,
  CAST(CASE WHEN kind = 'primaryStroke' THEN round(500 + 1500 * relative_length) WHEN kind LIKE 'cross%' THEN 220 ELSE round(least(greatest(measure * 4.0, 70), 220)) END AS BIGINT) AS span FROM sg),
wn AS (SELECT *, (upto - span) / CAST(total AS DOUBLE) AS wstart, upto / CAST(total AS DOUBLE) AS wend FROM (
  SELECT *, sum(gap + span) OVER (PARTITION BY map_id ORDER BY id) AS upto, sum(gap + span) OVER (PARTITION BY map_id) AS total FROM sp) WHERE total > 0)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# Pixels and plans ------------------------------------------------------------------------------
@query(f"WITH {CLASSES} SELECT map_id, class, count(*) AS pixels FROM cl GROUP BY 1, 2")
def classify_counts(spark, sf_dir):
    return detect.classify(item_pixels(spark, sf_dir)).groupBy("map_id", "class").agg(F.count(F.lit(1)).alias("pixels"))


@query(f"WITH {CLASSES} SELECT map_id, class, count(*) AS pixels, min(x) AS left_x, min(y) AS top_y, max(x) AS right_x, max(y) AS bottom_y FROM cl GROUP BY 1, 2")
def class_bbox(spark, sf_dir):
    return detect.class_boxes(detect.classify(item_pixels(spark, sf_dir)))


@query(f"WITH {MASK} SELECT map_id, count(*) AS pixels, min(x) AS left_x, min(y) AS top_y, max(x) AS right_x, max(y) AS bottom_y FROM mask GROUP BY 1")
def ink_bbox(spark, sf_dir):
    return detect.class_boxes(mask_of(spark, sf_dir).withColumn("class", F.lit("ink"))).drop("class")


@query(f"WITH {MASK} SELECT map_id, count(*) AS missing FROM mask m WHERE NOT EXISTS (SELECT 1 FROM tile t WHERE t.map_id = m.map_id AND t.i = m.i AND t.v > 0.1) GROUP BY 1")
def uncovered_pixels(spark, sf_dir):
    strong = tiles(spark, sf_dir).filter("v > 0.1")
    return detect.uncovered(mask_of(spark, sf_dir), strong).groupBy("map_id").agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT user_id AS map_id, CAST(least(3 + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 254) AS INTEGER) AS id, count(*) OVER (PARTITION BY user_id) AS chunks FROM events")
def overflow_merge(spark, sf_dir):
    from pyspark.sql import Window

    chunks = event_segments(spark, sf_dir).select("map_id", F.col("id").alias("chunk_no"), F.count(F.lit(1)).over(Window.partitionBy("map_id")).alias("chunks"))
    return detect.merged_overflow(chunks, 3).select("map_id", "id", "chunks")


@query(f"WITH {TILE}, s AS (SELECT map_id, i % 3 AS segment_id, x, y FROM tile WHERE v > 0) SELECT map_id, segment_id, count(*) AS pixel_count, min(x) AS left_x, min(y) AS top_y, max(x) AS right_x, max(y) AS bottom_y, CAST(max(x) - min(x) + 1 AS DOUBLE) AS measure FROM s GROUP BY 1, 2")
def segment_build(spark, sf_dir):
    return detect.segment_boxes(mask_of(spark, sf_dir).withColumn("segment_id", F.col("i") % 3))


@query(f"WITH {MASK}, b AS (SELECT map_id, min(x) AS l, max(x) AS r FROM mask GROUP BY 1) SELECT map_id, i, CAST(round(CASE WHEN r - l <= 0 THEN 1.0 ELSE least(greatest((x - l) / CAST(r - l AS DOUBLE), 0), 1) END * 65535) AS INTEGER) AS within FROM mask JOIN b USING (map_id)")
def segment_progress(spark, sf_dir):
    mask = mask_of(spark, sf_dir)
    box = mask.groupBy("map_id").agg(F.min("x").alias("l"), F.max("x").alias("r"))
    return mask.join(box, "map_id").select("map_id", "i", scalar.progress_within(F.col("x"), F.col("l"), F.col("r")).alias("within"))


@query(f"WITH {SEGMENTS} SELECT map_id, id, measure * 0.5 AS measure, relative_length FROM sg")
def scale_measures(spark, sf_dir):
    return detect.scaled_measures(event_segments(spark, sf_dir), 0.5).select("map_id", "id", F.col("measure").cast("double").alias("measure"), "relative_length")


# Scalars ---------------------------------------------------------------------------------------
NORM = "CASE WHEN {x} <= 0 THEN 0 ELSE pow({x}, 0.35) END"
NORMAL = f"round(least(greatest(({NORM} - pow(124.5, 0.35)) / (pow(905.7, 0.35) - pow(124.5, 0.35)), 0), 1), {DIGITS})"


@query("SELECT o_orderkey, " + NORMAL.format(x="(o_totalprice / 200)") + " AS relative_length FROM orders")
def stroke_length_norm(spark, sf_dir):
    return rounded(read(spark, sf_dir, "orders").select("o_orderkey", scalar.relative_length(F.col("o_totalprice") / 200).alias("relative_length")))


@query("SELECT doc_id, " + NORMAL.format(x="(n_chars * 420.0::DOUBLE / 840)") + " AS relative_length FROM documents")
def stroke_length_norm_at(spark, sf_dir):
    return rounded(read(spark, sf_dir, "documents").select("doc_id", scalar.relative_length_at(F.col("n_chars").cast("double"), F.lit(840)).alias("relative_length")))


@query(f"SELECT o_orderkey, round(least(greatest(o_totalprice / 299993 - 0.2, 0), 1), {DIGITS}) AS t FROM orders")
def ease_linear(spark, sf_dir):
    return rounded(read(spark, sf_dir, "orders").select("o_orderkey", scalar.linear_time(F.col("o_totalprice") / 299993 - 0.2).alias("t")))


PEN = "CASE WHEN {d} <= 0.06 / 0.88::DOUBLE THEN sqrt(0.24::DOUBLE * 0.88 * {d}) WHEN {d} >= 1 - 0.06 / 0.88::DOUBLE THEN 1 - sqrt(0.24::DOUBLE * 0.88 * (1 - {d})) ELSE {d} * 0.88::DOUBLE + 0.06 END"


@query(f"SELECT o_orderkey, round({PEN.format(d='d')}, {DIGITS}) AS t FROM (SELECT o_orderkey, least(greatest(o_totalprice / 299993 - 0.2, 0), 1) AS d FROM orders)")
def ease_pen(spark, sf_dir):
    return rounded(read(spark, sf_dir, "orders").select("o_orderkey", scalar.pen_time(F.col("o_totalprice") / 299993 - 0.2).alias("t")))


@query(f"SELECT DISTINCT k, CAST(greatest(1, 255 - ceil(255 / k)) AS INTEGER) AS max_order, round(255 / k, {DIGITS}) AS edge_codes FROM (SELECT CAST(l_quantity AS DOUBLE) AS k FROM lineitem)")
def max_order(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("k")).distinct()
    return rounded(k.select("k", scalar.max_order(F.col("k")).alias("max_order"), scalar.edge_codes(F.col("k")).alias("edge_codes")))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN o >= 255 THEN 0 ELSE least(greatest(24 * (p * 255 - o), 0), 255) END, {DIGITS}) AS alpha FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS o, l_discount * 10 AS p FROM lineitem)")
def alpha_at(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.alpha_at((F.col("l_partkey") % 256).cast("int"), F.col("l_discount") * 10, F.lit(24.0)).alias("alpha")))


@query(f"SELECT k, p, pos, round(CASE WHEN pos IN (0, 6, 12) THEN 1 WHEN pos = 15 THEN -k WHEN pos = 19 THEN k * p * 255 ELSE 0 END, {DIGITS}) + 0 AS cell FROM (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS k, l_discount AS p FROM lineitem), (SELECT CAST(unnest(range(20)) AS INTEGER) AS pos)")
def threshold_row(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("k"), F.col("l_discount").alias("p")).distinct()
    cells = t.select("k", "p", F.posexplode(scalar.threshold_matrix(F.col("k"), F.col("p"))).alias("pos", "cell"))
    return cells.select("k", "p", "pos", (F.round("cell", DIGITS) + 0.0).alias("cell"))


@query("SELECT o_orderkey, CAST(round(500 + 1500 * least(greatest(o_totalprice / 300000, 0), 1)) AS BIGINT) AS ms FROM orders")
def primary_millis(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.primary_millis(F.col("o_totalprice") / 300000).alias("ms"))


@query("SELECT doc_id, CAST(round(least(greatest(n_chars % 97 * 4.0, 70), 220)) AS BIGINT) AS ms FROM documents")
def annotation_millis(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalar.annotation_millis(F.col("n_chars") % 97).alias("ms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN w >= h THEN 420 ELSE CAST(greatest(1, round(w * 420 / CAST(h AS DOUBLE))) AS INTEGER) END AS fit_w, CASE WHEN w >= h THEN CAST(greatest(1, round(h * 420 / CAST(w AS DOUBLE))) AS INTEGER) ELSE 420 END AS fit_h FROM (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 4000 AS w, 1 + l_suppkey % 900 AS h FROM lineitem)")
def fit_long_side(spark, sf_dir):
    w, h = scalar.fit_long_side(1 + F.col("l_partkey") % 4000, 1 + F.col("l_suppkey") % 900, F.lit(420))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("fit_w"), h.alias("fit_h"))


@query(f"WITH {TILE}, m AS (SELECT map_id, max(v) AS top FROM tile GROUP BY 1) SELECT map_id, i, CASE WHEN v < 0 THEN 254 ELSE CAST(least(greatest(round(v / CASE WHEN top > 0 THEN top ELSE 1 END * 254), 0), 254) AS INTEGER) END AS ord, CAST(round(CASE WHEN v < 0 THEN 254 ELSE least(greatest(round(v / CASE WHEN top > 0 THEN top ELSE 1 END * 254), 0), 254) END * 65535 / 254) AS INTEGER) AS within FROM tile JOIN m USING (map_id)")
def order_normalize(spark, sf_dir):
    tile = tiles(spark, sf_dir)
    top = tile.groupBy("map_id").agg(F.max("v").alias("top"))
    field = F.when(F.col("v") >= 0, F.col("v"))
    coded = tile.join(top, "map_id").select("map_id", "i", scalar.order_code(field, F.col("top")).alias("ord"))
    return coded.select("map_id", "i", "ord", scalar.road_within(F.col("ord")).alias("within"))


@query("SELECT l_orderkey, l_linenumber, least(abs(a - b) % 180, 180 - abs(a - b) % 180) AS apart FROM (SELECT l_orderkey, l_linenumber, l_partkey % 180 AS a, l_suppkey % 180 AS b FROM lineitem)")
def angular_separation(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.angular_separation(F.col("l_partkey") % 180, F.col("l_suppkey") % 180).alias("apart"))


BOX = "l_partkey % 300 AS al, l_partkey % 300 + l_linenumber AS ar, l_orderkey % 300 AS tp, l_orderkey % 300 + 9 AS ab, l_suppkey % 300 AS bl, l_suppkey % 300 + 5 AS br, (l_partkey + l_suppkey) % 300 AS bt, (l_partkey + l_suppkey) % 300 + l_linenumber AS bb"


@query(f"SELECT l_orderkey, l_linenumber, round(sqrt(pow(greatest(0, al - br, bl - ar), 2) + pow(greatest(0, tp - bb, bt - ab), 2)), {DIGITS}) AS gap, round((least(ab, bb) - greatest(tp, bt) + 1) / CAST(least(ab - tp + 1, bb - bt + 1) AS DOUBLE), {DIGITS}) AS overlap FROM (SELECT l_orderkey, l_linenumber, {BOX} FROM lineitem)")
def box_relations(spark, sf_dir):
    p, o, s, n = (F.col(c) for c in ("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber"))
    a = {"left": p % 300, "right": p % 300 + n, "top": o % 300, "bottom": o % 300 + 9}
    b = {"left": s % 300, "right": s % 300 + 5, "top": (p + s) % 300, "bottom": (p + s) % 300 + n}
    return rounded(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.box_gap(a, b).alias("gap"), scalar.overlap_ratio(a["top"], a["bottom"], b["top"], b["bottom"]).alias("overlap")))


@query("SELECT o_orderkey, CASE WHEN p <= 0 THEN 'start' WHEN p < 0.4 THEN 'road' WHEN p < 0.7 THEN 'cross' ELSE 'end' END AS stage, CAST(round(2251000 * abs(1 - p) / 0.75) AS BIGINT) AS play_us FROM (SELECT o_orderkey, o_custkey % 11 / 10.0::DOUBLE AS p FROM orders)")
def stage_at(spark, sf_dir):
    p = F.col("o_custkey") % 11 / 10.0
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.stage_at(p, F.lit(0.4), F.lit(0.7)).alias("stage"), scalar.play_micros(F.lit(2251000), p, F.lit(1.0), F.lit(0.75)).alias("play_us"))


@query("SELECT c_mktsegment, median(c_acctbal) AS middle, list_sort(list(c_acctbal))[count(*) // 2 + 1] AS upper FROM customer GROUP BY 1")
def medians(spark, sf_dir):
    return metrics.medians(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@query(f"WITH RECURSIVE {ORDERS}, l AS (SELECT map_id, list(ord ORDER BY i) AS a FROM o GROUP BY 1), f(map_id, a, n, h) AS (SELECT map_id, a, 0, 2166136261::BIGINT FROM l UNION ALL SELECT map_id, a, n + 1, (xor(h, a[n + 1]::BIGINT) * 16777619) & 4294967295 FROM f WHERE n < len(a)) SELECT map_id, h AS digest FROM f WHERE n = len(a)")
def fnv32(spark, sf_dir):
    codes = orders_of(spark, sf_dir).groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("i", "ord"))).alias("s"))
    return codes.select("map_id", scalar.fnv32(F.col("s.ord")).alias("digest"))


# Timing ----------------------------------------------------------------------------------------
@query(f"WITH {SEGMENTS} SELECT map_id, id AS segment_id, kind, round(wstart, {DIGITS}) AS start, round(wend, {DIGITS}) AS \"end\", CAST(total AS BIGINT) AS total_ms FROM wn")
def schedule_windows(spark, sf_dir):
    return rounded(schedule.HandwritingPolicy().windows(event_segments(spark, sf_dir)).drop("edge"))


@query(f"WITH {SEGMENTS} SELECT map_id, CAST(sum(gap + span) AS BIGINT) AS total_ms FROM sp GROUP BY 1")
def schedule_total(spark, sf_dir):
    return schedule.totals(event_segments(spark, sf_dir))


@query(f"WITH {SEGMENTS}, e AS (SELECT map_id, max(wend) FILTER (kind = 'primaryStroke') AS p, max(wend) FILTER (kind LIKE 'cross%') AS c, max(wend) FILTER (kind = 'annotation') AS a FROM wn GROUP BY 1) SELECT map_id, round(coalesce(p, 0), {DIGITS}) AS primary_end, round(greatest(coalesce(p, 0), coalesce(c, 0)), {DIGITS}) AS cross_end, round(greatest(coalesce(p, 0), coalesce(c, 0), coalesce(a, 0)), {DIGITS}) AS annotation_end, c IS NOT NULL AS has_cross, a IS NOT NULL AS has_annotation FROM e")
def stage_marks(spark, sf_dir):
    segments = event_segments(spark, sf_dir)
    return rounded(schedule.stage_marks(schedule.HandwritingPolicy().windows(segments), segments))


COMPILED = f"{SEGMENTS}, px AS (SELECT map_id, id AS segment_id, w.w AS i, w.w * 13107 AS within FROM sg, (SELECT unnest(range(6)) AS w) w), t AS (SELECT px.map_id, px.segment_id, px.i, wn.wstart, wn.wend, wn.kind, px.within / 65535.0::DOUBLE AS d FROM px LEFT JOIN wn ON wn.map_id = px.map_id AND wn.id = px.segment_id AND px.i <> 5), c AS (SELECT map_id, segment_id, i, CASE WHEN wstart IS NULL THEN 255 ELSE CAST(least(round(least(greatest(wstart + (wend - wstart) * (CASE WHEN kind = 'annotation' THEN d ELSE {PEN.format(d='d')} END), 0), 1) * 244), 244) AS INTEGER) END AS ord FROM t)"


def compiled(spark, sf_dir) -> DataFrame:
    """Orders of six pixels per segment, the sixth without a window."""
    segments = event_segments(spark, sf_dir)
    pixels = segments.select("map_id", F.col("id").alias("segment_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("w"))
    pixels = pixels.select("map_id", F.when(F.col("w") == 5, -1).otherwise(F.col("segment_id")).alias("segment_id"), (F.col("segment_id") * 10 + F.col("w")).alias("i"), (F.col("w") * 13107).alias("within"))
    return schedule.compile_orders(pixels, schedule.HandwritingPolicy().windows(segments), last_id=None)


@query(f"WITH {COMPILED} SELECT map_id, segment_id * 10 + i AS i, ord FROM c")
def compile_order(spark, sf_dir):
    return compiled(spark, sf_dir)


@query(f"WITH {COMPILED} SELECT map_id, segment_id * 10 + i AS i, round(CASE WHEN ord >= 255 THEN 0 ELSE least(greatest(24 * (0.5 * 255 - ord), 0), 255) END, {DIGITS}) AS alpha FROM c")
def frame_alpha(spark, sf_dir):
    return rounded(schedule.frame_alpha(compiled(spark, sf_dir), 0.5))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(round(b{c} + (c{c} - b{c}) * a / 255) AS INTEGER) AS {c}" for c in "rgb") + " FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS br, l_orderkey % 256 AS bg, l_suppkey % 256 AS bb, (l_partkey * 7) % 256 AS cr, (l_orderkey * 3) % 256 AS cg, (l_suppkey * 5) % 256 AS cb, least(greatest(24 * (0.5::DOUBLE * 255 - (l_partkey + l_suppkey) % 255), 0), 255) AS a FROM lineitem)")
def frame_composite(spark, sf_dir):
    p, o, s = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    alpha = scalar.alpha_at((p + s) % 255, F.lit(0.5), F.lit(24.0))
    parts = {"r": (p % 256, p * 7 % 256), "g": (o % 256, o * 3 % 256), "b": (s % 256, s * 5 % 256)}
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(scalar.composite(a, b, alpha).alias(c) for c, (a, b) in parts.items()))


@query(f"WITH {ORDERS} SELECT map_id, i, ord AS r, ord AS g, ord AS b, 255 AS a FROM o")
def order_to_rgba(spark, sf_dir):
    return orders_of(spark, sf_dir).select("map_id", "i", rasters.gray(F.col("ord")).alias("c")).select("map_id", "i", "c.*")


# Stencils --------------------------------------------------------------------------------------
DILATE = "SELECT DISTINCT m.map_id, m.x + dx AS x, m.y + dy AS y FROM {m} m, (SELECT dx, dy FROM steps UNION ALL SELECT 0, 0) s WHERE m.x + dx BETWEEN 0 AND 7 AND m.y + dy BETWEEN 0 AND 7"
ERODE = "SELECT m.map_id, m.x, m.y FROM {m} m JOIN {m} n ON n.map_id = m.map_id AND abs(n.x - m.x) <= 1 AND abs(n.y - m.y) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9"
HITS = "h AS (SELECT m.map_id, m.i, m.x, m.y, count(n.i) AS n, coalesce(sum(1 << k) FILTER (n.i IS NOT NULL), 0)::BIGINT AS bits FROM mask m CROSS JOIN steps s LEFT JOIN mask n ON n.map_id = m.map_id AND n.x = m.x + s.dx AND n.y = m.y + s.dy GROUP BY 1, 2, 3, 4)"


@query(f"WITH {MASK}, {STEPS} SELECT map_id, y * 8 + x AS i, x, y FROM ({DILATE.format(m='mask')})")
def dilate(spark, sf_dir):
    return stencil.dilate(mask_of(spark, sf_dir), W, H)


@query(f"WITH {MASK} SELECT map_id, y * 8 + x AS i, x, y FROM ({ERODE.format(m='mask')})")
def erode(spark, sf_dir):
    return stencil.erode(mask_of(spark, sf_dir), W, H)


@query(f"WITH {MASK}, {STEPS}, m1 AS ({DILATE.format(m='mask')}), m2 AS ({ERODE.format(m='m1')}), m3 AS ({DILATE.format(m='m2')}), m4 AS ({ERODE.format(m='m3')}), m5 AS ({ERODE.format(m='m4')}), m6 AS ({DILATE.format(m='m5')}), m7 AS ({ERODE.format(m='m6')}), m8 AS ({DILATE.format(m='m7')}) SELECT map_id, y * 8 + x AS i, x, y FROM m8")
def close_open(spark, sf_dir):
    return stencil.close_open(mask_of(spark, sf_dir), W, H)


RING_SQL = " + ".join(f"(1 - ((bits >> {a}) & 1)) * ((bits >> {b}) & 1)" for a, b in zip(stencil.RING, stencil.RING[1:] + stencil.RING[:1], strict=True))


@query(f"WITH {MASK}, {STEPS}, {HITS} SELECT map_id, i, {RING_SQL} AS crossings FROM h")
def crossing_number(spark, sf_dir):
    return stencil.hits(mask_of(spark, sf_dir), W, H).select("map_id", "i", stencil.crossings(F.col("bits")).alias("crossings"))


@query(f"WITH {MASK}, {STEPS}, {HITS} SELECT map_id, i, n FROM h")
def neighbour_count(spark, sf_dir):
    return stencil.hits(mask_of(spark, sf_dir), W, H).select("map_id", "i", "n")


def _bit(k: int) -> str:
    return f"((bits >> {k}) & 1)"


@query(f"WITH {MASK}, {STEPS}, {HITS} SELECT map_id, i, x, y FROM h WHERE NOT (n BETWEEN 2 AND 6 AND {RING_SQL} = 1 AND {_bit(1)} * {_bit(3)} * {_bit(5)} = 0 AND {_bit(3)} * {_bit(5)} * {_bit(7)} = 0)")
def thin_substep(spark, sf_dir):
    return stencil.thin_substep(mask_of(spark, sf_dir), W, H)


@query(f"WITH {TILE}, f AS (SELECT map_id, i, x, y, v FROM tile WHERE v > 0) SELECT a.map_id, a.i, a.x, a.y, round(avg(b.v), 4) AS t FROM f a JOIN f b ON b.map_id = a.map_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3, 4")
def smooth_pass(spark, sf_dir):
    field = tiles(spark, sf_dir).filter("v > 0").withColumnRenamed("v", "t")
    return stencil.smooth_pass(field, W, H).withColumn("t", F.round(F.col("t").cast("double"), 4))


@query(f"WITH {ORDERS}, {STEPS}, {DIFFS} SELECT map_id, count(*) FILTER (diff > 255 / 24.0) AS jumps, max(diff) AS worst FROM d WHERE k IN (3, 5) AND ord < 254 AND other < 254 GROUP BY 1")
def edge_jumps(spark, sf_dir):
    return stencil.edge_jumps(orders_of(spark, sf_dir), W, H)


@query(f"WITH {ORDERS}, {STEPS}, {DIFFS} SELECT map_id, count(*) FILTER (diff > 255 / 24.0) AS jumps, max(diff) AS worst FROM d WHERE k IN (3, 5) GROUP BY 1")
def edge_jumps_all(spark, sf_dir):
    return stencil.edge_jumps(orders_of(spark, sf_dir), W, H, skip=None)


@query(f"WITH {ORDERS}, {STEPS}, {DIFFS}, q AS (SELECT o.map_id, o.i, o.ord, count(d.k) AS n, count(*) FILTER (24 * (0.3 * 255 - d.other) > 200) AS opened FROM o LEFT JOIN d USING (map_id, i) GROUP BY 1, 2, 3) SELECT map_id, count(*) FILTER (24 * (0.3 * 255 - ord) <= 200 AND n >= 6 AND opened >= 6) AS holes FROM q GROUP BY 1")
def isolated_holes(spark, sf_dir):
    return stencil.isolated_holes(orders_of(spark, sf_dir), W, H, 0.3)


@query(f"WITH {ORDERS}, {STEPS}, {DIFFS}, g AS (SELECT map_id, i, max(diff) AS g FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY g, i) AS r, count(*) OVER (PARTITION BY map_id) AS n FROM g) SELECT map_id, count(*) AS pixels, count(*) FILTER (g = 0) AS flat, max(g) FILTER (r = floor(n * 0.5) + 1) AS p50, max(g) FILTER (r = floor(n * 0.9) + 1) AS p90, max(g) AS worst FROM r GROUP BY 1")
def gradient_stats(spark, sf_dir):
    return stencil.gradient_stats(orders_of(spark, sf_dir), W, H)


@query(f"WITH {ORDERS}, {STEPS}, {DIFFS} SELECT CASE WHEN diff = 0 THEN '0' WHEN diff <= 2 THEN '1-2' WHEN diff <= 5 THEN '3-5' WHEN diff <= 10 THEN '6-10' ELSE 'over 10' END AS bucket, count(*) AS n FROM d WHERE k IN (3, 5) GROUP BY 1")
def jump_histogram(spark, sf_dir):
    return stencil.jump_histogram(orders_of(spark, sf_dir), W, H)


@query(f"WITH {ORDERS}, {STEPS}, {DIFFS}, g AS (SELECT map_id, i, max(diff) AS g FROM d GROUP BY 1, 2) SELECT k, count(*) FILTER (g > 255 / k) AS steps FROM g, (SELECT CAST(unnest([24, 32, 40, 48, 64]) AS DOUBLE) AS k) GROUP BY 1")
def sharpness_tradeoff(spark, sf_dir):
    return metrics.sharpness_tradeoff(orders_of(spark, sf_dir), W, H, [24.0, 32.0, 40.0, 48.0, 64.0])


@query(f"WITH {ORDERS}, a AS (SELECT k, p AS progress, round(least(greatest(k * (p * 255 - ord), 0), 255)) AS a FROM o, (SELECT CAST(unnest([24, 64]) AS DOUBLE) AS k), (SELECT CAST(unnest([0.1, 0.25, 0.5]) AS DOUBLE) AS p)) SELECT k, progress, count(*) FILTER (a = 255) AS opaque, count(*) FILTER (a > 0 AND a < 255) AS translucent FROM a GROUP BY 1, 2")
def translucency(spark, sf_dir):
    return metrics.translucency(orders_of(spark, sf_dir), [0.1, 0.25, 0.5], [24.0, 64.0])


@query(f"WITH {TILE}, e AS (SELECT v * 512 AS e FROM tile WHERE v > 0), a AS (SELECT p, e, round(e) AS c, 24 * (p * 255 - e) AS s, 24 * (p * 255 - round(e)) AS r FROM e, (SELECT CAST(unnest([0.1, 0.25]) AS DOUBLE) AS p)) SELECT p AS progress, count(*) FILTER (c < 255 AND r > 0 AND r < 255) AS codes_slope, count(*) FILTER (e < 255 AND s > 0 AND s < 255) AS exact_slope, count(*) FILTER (c <= p * 255) AS codes_step, count(*) FILTER (e <= p * 255) AS exact_step FROM a GROUP BY 1")
def band_factorial(spark, sf_dir):
    exact = tiles(spark, sf_dir).filter("v > 0").select("map_id", "i", (F.col("v") * 512).alias("ord_exact"))
    return metrics.band_factorial(exact, [0.1, 0.25])


@query(f"WITH {ORDERS}, n AS (SELECT map_id, x, y FROM o WHERE 24 * (0.3 * 255 - ord) >= 255 AND NOT 24 * (0.2 * 255 - ord) >= 255) SELECT map_id, count(*) AS pixels, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)), {DIGITS}) AS span FROM n GROUP BY 1")
def fresh_span(spark, sf_dir):
    return rounded(metrics.newly_lit_span(orders_of(spark, sf_dir), W, 0.2, 0.1))


@query(f"WITH {ORDERS} SELECT map_id, count(*) FILTER (a <> 255) AS partly, count(*) FILTER (a <> 255 AND (x IN (0, 7) OR y IN (0, 7))) AS on_border FROM (SELECT *, least(greatest(24 * (0.3 * 255 - ord), 0), 255) AS a FROM o) GROUP BY 1")
def alpha_shape(spark, sf_dir):
    return metrics.alpha_shape(orders_of(spark, sf_dir), W, H, 0.3)


@query(f"WITH {ORDERS} SELECT t.map_id, count(*) FILTER (o.i IS NULL) AS uncovered, count(*) FILTER (o.ord > 244) AS too_late FROM tile t LEFT JOIN o ON o.map_id = t.map_id AND o.i = t.i WHERE t.v > -0.05 GROUP BY 1")
def coverage(spark, sf_dir):
    return metrics.coverage(tiles(spark, sf_dir).filter("v > -0.05"), orders_of(spark, sf_dir))


@query(f"WITH {ORDERS}, f AS (SELECT map_id, y, row_number() OVER (PARTITION BY map_id ORDER BY ord, i) AS r, min(y) OVER (PARTITION BY map_id) AS t, max(y) OVER (PARTITION BY map_id) AS b FROM o) SELECT map_id, y <= t + (b - t) * 0.1 AS near_top FROM f WHERE r = 1")
def starts_near_top(spark, sf_dir):
    return metrics.starts_near_top(orders_of(spark, sf_dir).withColumnRenamed("ord", "within"))


@query(f"WITH {ITEMS} SELECT map_id, count(*) FILTER (x BETWEEN 10 AND 60 AND y BETWEEN 5 AND 80 AND abs(br - cr) + abs(bg - cg) + abs(bb - cb) > 40) AS n FROM px GROUP BY 1")
def changed_in_rect(spark, sf_dir):
    return metrics.changed_in(item_pixels(spark, sf_dir), 10, 5, 60, 80)


# Components ------------------------------------------------------------------------------------
CC = "r AS (SELECT map_id, i, i AS c FROM {m} UNION SELECT n.map_id, n.i, r.c FROM r JOIN {m} a ON a.map_id = r.map_id AND a.i = r.i JOIN {m} n ON n.map_id = a.map_id AND abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1{same}), cc AS (SELECT map_id, i, min(c) AS component FROM r GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {MASK}, {CC.format(m='mask', same='')} SELECT map_id, i, component FROM cc")
def connected_components(spark, sf_dir):
    return metrics.labels(mask_of(spark, sf_dir), W, H)


@query(f"WITH RECURSIVE {MASK}, {CC.format(m='mask', same='')}, s AS (SELECT map_id, component, count(*) AS pixels FROM cc GROUP BY 1, 2) SELECT map_id, component, pixels FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY pixels DESC, component) AS r FROM s) WHERE r = 1")
def largest_component(spark, sf_dir):
    return metrics.component_sizes(metrics.labels(mask_of(spark, sf_dir), W, H)).filter("rank = 1").drop("rank")


EQUAL = f"{ORDERS}, p AS (SELECT map_id, i, x, y, ord AS b FROM o), {CC.format(m='p', same=' AND n.b = a.b')}, sizes AS (SELECT map_id, component, count(*) AS pixels FROM cc GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {EQUAL} SELECT map_id, component, pixels FROM sizes")
def plateaus(spark, sf_dir):
    return metrics.component_sizes(metrics.labels(orders_of(spark, sf_dir), W, H, "ord")).drop("rank")


@query(f"WITH RECURSIVE {EQUAL}, five AS (SELECT *, CAST(row_number() OVER (PARTITION BY map_id ORDER BY pixels DESC, component) AS INTEGER) AS rank FROM sizes) SELECT five.map_id, rank, component, pixels, ord FROM five JOIN o ON o.map_id = five.map_id AND o.i = five.component WHERE rank <= 5")
def largest_plateaus(spark, sf_dir):
    """The five largest plateaus of every map, a report."""
    orders = orders_of(spark, sf_dir)
    five = metrics.component_sizes(metrics.labels(orders, W, H, "ord")).filter("rank <= 5")
    return five.join(orders.select("map_id", F.col("i").alias("component"), "ord"), ["map_id", "component"])


FRESH = "p AS (SELECT map_id, i, x, y FROM o WHERE 24 * (0.3 * 255 - ord) >= 255 AND NOT 24 * (0.2 * 255 - ord) >= 255)"
FRAMES = f"{ORDERS}, p AS (SELECT * FROM (SELECT map_id, i, x, y, CAST(ceil(2.5::DOUBLE + ord * (60 / 255.0::DOUBLE)) AS INTEGER) AS b FROM o) WHERE b <= 60), {CC.format(m='p', same=' AND n.b = a.b')}"


@query(f"WITH RECURSIVE {FRAMES}, pc AS (SELECT p.map_id, b, component, count(*) AS n FROM p JOIN cc ON cc.map_id = p.map_id AND cc.i = p.i GROUP BY ALL), mx AS (SELECT map_id, b, max(n) AS largest FROM pc GROUP BY 1, 2) SELECT map_id, b AS frame, count(*) AS pixels, round(sqrt(CAST(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) AS DOUBLE)), {DIGITS}) AS span, any_value(largest) AS largest FROM p JOIN mx USING (map_id, b) GROUP BY 1, 2")
def playback(spark, sf_dir):
    return rounded(metrics.playback(orders_of(spark, sf_dir), W, H))


PARTLY = "p AS (SELECT map_id, i, x, y FROM o WHERE 24 * (0.3 * 255 - ord) > 0 AND 24 * (0.3 * 255 - ord) < 255)"


@query(f"WITH RECURSIVE {ORDERS}, {FRESH}, {CC.format(m='p', same='')} SELECT map_id, max(n) AS largest FROM (SELECT map_id, component, count(*) AS n FROM cc GROUP BY 1, 2) GROUP BY 1")
def largest_fresh_component(spark, sf_dir):
    lit = lambda p: scalar.alpha_at(F.col("ord"), F.lit(p), F.lit(24.0)) >= 255
    sizes = metrics.component_sizes(metrics.labels(orders_of(spark, sf_dir).filter(lit(0.3) & ~lit(0.2)), W, H))
    return sizes.filter("rank = 1").select("map_id", F.col("pixels").alias("largest"))


@query(f"WITH RECURSIVE {ORDERS}, {PARTLY}, {CC.format(m='p', same='')} SELECT map_id, component, count(*) AS pixels FROM cc GROUP BY 1, 2")
def translucent_components(spark, sf_dir):
    alpha = scalar.alpha_at(F.col("ord"), F.lit(0.3), F.lit(24.0))
    return metrics.component_sizes(metrics.labels(orders_of(spark, sf_dir).filter((alpha > 0) & (alpha < 255)), W, H)).drop("rank")


ROADS = f"{TILE}, road AS (SELECT map_id, i, x, y FROM tile WHERE v > 0.05), acc AS (SELECT map_id, i, x, y FROM tile WHERE v < -0.2)"


@query(f"WITH RECURSIVE {ROADS}, {CC.format(m='road', same='')}, z AS (SELECT cc.map_id, component, count(DISTINCT cc.i) AS pixels, count(a.i) > 0 AS touches FROM cc LEFT JOIN acc a ON a.map_id = cc.map_id AND abs(a.x - cc.i % 8) <= 1 AND abs(a.y - cc.i // 8) <= 1 GROUP BY 1, 2), mv AS (SELECT map_id, sum(pixels) AS road, coalesce(sum(pixels) FILTER (touches AND pixels <= 12), 0) AS moved FROM z GROUP BY 1) SELECT vec_id AS map_id, CAST(coalesce(road - moved, 0) AS BIGINT) AS road, CAST(coalesce(moved, 0) + (SELECT count(*) FROM acc WHERE acc.map_id = vec_id) AS BIGINT) AS accent FROM embeddings LEFT JOIN mv ON mv.map_id = vec_id")
def stray_absorb(spark, sf_dir):
    def moved(v):
        road, accent = detect.absorb(v > 0.05, v < -0.2, model.DetectSettings().stray_pixels)
        yield int(road.sum()), int(accent.sum())

    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), moved, "road long, accent long")


CENTRES = f"{CC.format(m='acc', same='')}, ctr AS (SELECT map_id, component, avg(i % 8) AS cx, avg(i // 8) AS cy FROM cc GROUP BY 1, 2), dist AS (SELECT ctr.map_id, component, sqrt(min(pow(x - cx, 2) + pow(y - cy, 2))) AS d FROM ctr JOIN road USING (map_id) GROUP BY 1, 2)"


def centre_distances(spark, sf_dir) -> DataFrame:
    tile = tiles(spark, sf_dir)
    return cross.road_distances(metrics.labels(tile.filter("v < -0.2"), W, H), tile.filter("v > 0.05"), W)


@query(f"WITH RECURSIVE {ROADS}, {CENTRES} SELECT map_id, component, round(d, {DIGITS}) AS distance FROM dist")
def centroid_road_distance(spark, sf_dir):
    return rounded(centre_distances(spark, sf_dir))


@query(f"WITH RECURSIVE {ROADS}, {CENTRES}, k AS (SELECT *, row_number() OVER w AS r, lead(round(d, {DIGITS})) OVER w AS nxt FROM dist WINDOW w AS (PARTITION BY map_id ORDER BY round(d, {DIGITS}), component)) SELECT map_id, component, round(d, {DIGITS}) AS best, nxt AS second FROM k WHERE r = 1")
def nearest_two(spark, sf_dir):
    return cross.nearest_two(rounded(centre_distances(spark, sf_dir)))


# Crosses ---------------------------------------------------------------------------------------
AXES = f"{MASK}, n AS (SELECT map_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM mask GROUP BY 1), pr AS (SELECT map_id, a AS angle, floor(round((y - cy) * cos(radians(a)) - (x - cx) * sin(radians(a)), 6)) AS b FROM mask JOIN n USING (map_id), (SELECT CAST(unnest(range(0, 180)) AS INTEGER) AS a)), lo AS (SELECT map_id, angle, min(b) AS lo, max(b) AS hi FROM pr GROUP BY 1, 2), de AS (SELECT lo.map_id, lo.angle, lo, hi, s.b FROM lo, LATERAL (SELECT unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS b) s), hs AS (SELECT de.*, count(pr.b) AS c FROM de LEFT JOIN pr ON pr.map_id = de.map_id AND pr.angle = de.angle AND pr.b = de.b GROUP BY ALL), ru AS (SELECT *, sum(c) OVER (PARTITION BY map_id, angle ORDER BY b ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM hs), ax AS (SELECT map_id, angle, CASE WHEN hi - lo + 1 <= 3 THEN lo + (hi - lo + 1) / 2 ELSE b + 1.5 END AS normal_offset, CAST(s AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY map_id, angle ORDER BY s DESC, b) AS r FROM ru WHERE b = lo OR b + 2 <= hi) WHERE r = 1)"


@query(f"WITH {AXES} SELECT map_id, angle, CAST(normal_offset AS DOUBLE) AS normal_offset, score FROM ax")
def axis_sweep(spark, sf_dir):
    return cross.axis_sweep(mask_of(spark, sf_dir), 3)


PAIR = f"{AXES}, rk AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY score DESC, angle) AS r FROM ax), p AS (SELECT f.map_id, f.angle AS a1, f.normal_offset AS o1, s.angle AS a2, s.normal_offset AS o2, row_number() OVER (PARTITION BY f.map_id ORDER BY s.r) AS q FROM rk f JOIN rk s ON s.map_id = f.map_id AND f.r = 1 AND least(abs(f.angle - s.angle) % 180, 180 - abs(f.angle - s.angle) % 180) >= 25), pp AS (SELECT map_id, CASE WHEN a1 > 0 AND a1 < 90 THEN TRUE WHEN a2 > 0 AND a2 < 90 THEN FALSE ELSE a1 <= a2 END AS f, a1, o1, a2, o2 FROM p WHERE q = 1), bs AS (SELECT map_id, CASE WHEN f THEN a1 ELSE a2 END AS ba, CASE WHEN f THEN o1 ELSE o2 END AS bo, CASE WHEN f THEN a2 ELSE a1 END AS sa, CASE WHEN f THEN o2 ELSE o1 END AS so FROM pp)"


@query(f"WITH {PAIR} SELECT map_id, ba AS backslash_angle, CAST(bo AS DOUBLE) AS backslash_offset, sa AS slash_angle, CAST(so AS DOUBLE) AS slash_offset FROM bs")
def axis_pair(spark, sf_dir):
    return cross.axis_pair(cross.axis_sweep(mask_of(spark, sf_dir), 3))


@query(f"WITH {PAIR}, ds AS (SELECT map_id, i, round(abs((y - cy) * cos(radians(ba)) - (x - cx) * sin(radians(ba)) - bo) / 3, 6) AS db, round(abs((y - cy) * cos(radians(sa)) - (x - cx) * sin(radians(sa)) - so) / 3, 6) AS dsl FROM mask JOIN n USING (map_id) JOIN bs USING (map_id)) SELECT map_id, count(*) FILTER (db <= 0.5 OR db <= dsl) AS on_backslash, count(*) FILTER (NOT (db <= 0.5 OR db <= dsl)) AS on_slash FROM ds GROUP BY 1")
def cross_assign(spark, sf_dir):
    mask = mask_of(spark, sf_dir)
    owned = cross.assign(mask, cross.axis_pair(cross.axis_sweep(mask, 3)), 3)
    return owned.groupBy("map_id").agg(F.count_if("on_backslash").alias("on_backslash"), F.count_if(~F.col("on_backslash")).alias("on_slash"))


@query(f"SELECT o_orderkey, round(along, {DIGITS}) + 0.0::DOUBLE AS along FROM (SELECT o_orderkey, (o_custkey % 100) * cos(radians(o_orderkey % 180)) + (o_orderkey % 100) * sin(radians(o_orderkey % 180)) AS along FROM orders)")
def axis_direction(spark, sf_dir):
    """How far points lie along axes at whole degrees."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.round(scalar.along(customer % 100, key % 100, key % 180), DIGITS) + 0.0).alias("along"))


COLUMNS = f"{MASK}, cols AS (SELECT t.map_id, t.x, count(m.i) AS ink FROM (SELECT DISTINCT map_id, x FROM tile) t LEFT JOIN mask m ON m.map_id = t.map_id AND m.x = t.x GROUP BY 1, 2)"


@query(f"WITH {COLUMNS} SELECT map_id, x, ink FROM cols")
def column_ink(spark, sf_dir):
    return cross.column_ink(mask_of(spark, sf_dir), W)


@query(f"WITH {COLUMNS}, k AS (SELECT map_id, CAST(c.c AS INTEGER) AS cut, x, row_number() OVER (PARTITION BY map_id, c.c ORDER BY ink, x) AS r FROM cols JOIN (SELECT unnest([1, 2]) AS c) c ON x BETWEEN round(8 / 3.0 * c.c) - 1 AND round(8 / 3.0 * c.c) + 1 AND x > 0 AND x < 8) SELECT map_id, cut, x FROM k WHERE r = 1")
def cut_snap(spark, sf_dir):
    return cross.snap_cuts(cross.column_ink(mask_of(spark, sf_dir), W), W, 3)


@query(f"WITH {COLUMNS}, k AS (SELECT map_id, c.c AS cut, x, row_number() OVER (PARTITION BY map_id, c.c ORDER BY ink, x) AS r FROM cols JOIN (SELECT unnest([1, 2]) AS c) c ON x BETWEEN round(8 / 3.0 * c.c) - 1 AND round(8 / 3.0 * c.c) + 1 AND x > 0 AND x < 8) SELECT m.map_id, m.i, count(k.x) AS slot FROM mask m LEFT JOIN k ON k.map_id = m.map_id AND k.r = 1 AND m.x >= k.x GROUP BY 1, 2")
def cell_of_cut(spark, sf_dir):
    mask = mask_of(spark, sf_dir)
    return cross.cells(mask, cross.snap_cuts(cross.column_ink(mask, W), W, 3))


# Sources ---------------------------------------------------------------------------------------
@query("WITH r AS (SELECT o_orderkey AS name, [o_custkey % 5, o_custkey % 3, 2, o_orderkey % 4] AS runs FROM orders) SELECT name, unnest(list_concat(range(runs[1], runs[1] + runs[2]), range(runs[1] + runs[2] + 2, runs[1] + runs[2] + 2 + runs[4]))) AS i FROM r")
def rle_decode(spark, sf_dir):
    t = read(spark, sf_dir, "orders")
    runs = t.select(F.col("o_orderkey").alias("name"), F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 3, F.lit(2).cast("long"), F.col("o_orderkey") % 4).alias("runs"))
    return rasters.run_length_pixels(runs)


@query("SELECT 'm' || p_size AS map_id FROM part GROUP BY 1 HAVING count(DISTINCT CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 3 END) = 2")
def corpus_discovery(spark, sf_dir):
    third = F.col("p_partkey") % 3
    suffix = F.when(third == 0, "_base").when(third == 1, "_composed").otherwise("_other")
    return rasters.complete_pairs(read(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_size").cast("string"), suffix).alias("key")))


SCENE = "sc AS (SELECT CAST(i AS INTEGER) AS i, CAST(i % 90 AS INTEGER) AS x, CAST(i // 90 AS INTEGER) AS y FROM (SELECT unnest(range(8100)) AS i)), kd AS (SELECT *, CASE WHEN y BETWEEN 74 AND 82 AND (x BETWEEN 12 AND 23 OR x BETWEEN 32 AND 43 OR x BETWEEN 52 AND 63) THEN 'accent' WHEN y BETWEEN 55 AND 67 AND (abs((x - 45) - (y - 61)) <= 1 OR abs((x - 45) + (y - 61)) <= 1) THEN 'accent' WHEN x BETWEEN 43 AND 47 AND y BETWEEN 8 AND 58 THEN 'road' END AS class FROM sc)"


@query(f"WITH {SCENE} SELECT class, count(*) AS pixels, min(x) AS left_x, min(y) AS top_y, max(x) AS right_x, max(y) AS bottom_y FROM kd WHERE class IS NOT NULL GROUP BY 1")
def scene_classes(spark, sf_dir):
    return detect.class_boxes(detect.classify(synthetic.scene_pixels(spark))).drop("map_id")


# Kernels: every raster where its row is ---------------------------------------------------------
# What the SQL says of scenes follows from how they are painted: road, cross and words of each supplier's map.
MAPS = f"""{SCENE}, mp AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS map_id, CAST(s_suppkey % 7 AS INTEGER) AS d, s_suppkey % 3 > 0 AS crossed, s_suppkey % 4 AS words FROM supplier),
painted AS (SELECT map_id, 0 AS part, x + d AS x, y FROM mp, sc WHERE x BETWEEN 43 AND 47 AND y BETWEEN 8 AND 58 AND NOT (crossed AND y >= 55 AND (abs((x - 45) - (y - 61)) <= 1 OR abs((x - 45) + (y - 61)) <= 1))
  UNION ALL SELECT map_id, 1, x + d, y FROM mp, sc WHERE crossed AND y BETWEEN 55 AND 67 AND (abs((x - 45) - (y - 61)) <= 1 OR abs((x - 45) + (y - 61)) <= 1)
  UNION ALL SELECT map_id, 2 + n, x, y FROM mp, sc, (SELECT unnest([0, 1, 2]) AS n) WHERE n < words AND y BETWEEN 74 AND 82 AND x BETWEEN 12 + 20 * n AND 23 + 20 * n)"""


@query(f"WITH {MAPS} SELECT map_id, CAST(part AS INTEGER) AS part, CAST(count(*) AS BIGINT) AS pixels, min(x) AS left_x, min(y) AS top_y, max(x) AS right_x, max(y) AS bottom_y FROM painted GROUP BY 1, 2")
def detect_plan(spark, sf_dir):
    """Detected segments against what was painted: 0 the road, 1 the cross, from 2 on the words in their order."""
    segments = detect.segments_of(detect.plans(synthetic.table_maps(read(spark, sf_dir, "supplier").select("s_suppkey"))))
    place = F.row_number().over(Window.partitionBy("map_id", "kind").orderBy("id"))
    part = F.when(F.col("kind") == "primaryStroke", 0).when(F.col("kind") == "annotation", 1 + place).otherwise(1)
    parts = segments.select("map_id", part.alias("part"), "pixel_count", "left_x", "top_y", "right_x", "bottom_y").groupBy("map_id", "part")
    return parts.agg(F.sum("pixel_count").alias("pixels"), F.min("left_x").alias("left_x"), F.min("top_y").alias("top_y"), F.max("right_x").alias("right_x"), F.max("bottom_y").alias("bottom_y"))


KINDS = "CASE WHEN part = 0 THEN ['primaryStroke'] WHEN part = 1 THEN ['crossBackslash', 'crossSlash'] ELSE ['annotation'] END"


@query(f"WITH {MAPS}, ks AS (SELECT map_id, part, unnest({KINDS}) AS kind FROM (SELECT DISTINCT map_id, part FROM painted)) SELECT map_id, kind, CAST(row_number() OVER (PARTITION BY map_id ORDER BY part, kind) - 1 AS INTEGER) AS id FROM ks")
def detect_kinds(spark, sf_dir):
    return detect.segments_of(detect.plans(synthetic.table_maps(read(spark, sf_dir, "supplier").select("s_suppkey")))).select("map_id", "kind", "id")


@query(f"WITH {MAPS} SELECT map_id, CAST(count(*) AS BIGINT) AS pixels, TRUE AS in_range, TRUE AS in_order FROM painted GROUP BY 1")
def detect_orders(spark, sf_dir):
    """From rasters to orders: every painted pixel has one that opens in the end, and the road's come before the words'."""
    made = prepare.prepare(synthetic.table_maps(read(spark, sf_dir, "supplier").select("s_suppkey")))
    kinds = detect.segments_of(made.plan).select("map_id", F.col("id").alias("segment_id"), "kind")
    met = made.orders.join(detect.pixels_of(made.plan), ["map_id", "i"]).join(kinds, ["map_id", "segment_id"])
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("ord")))
    in_order = F.coalesce(of("primaryStroke", F.max) <= of("annotation", F.min), F.lit(True))
    return met.groupBy("map_id").agg(F.count(F.lit(1)).alias("pixels"), F.bool_and(F.col("ord").between(0, 244)).alias("in_range"), in_order.alias("in_order"))


@query("WITH t AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings) SELECT vec_id AS map_id, 16 * count(*) FILTER (v > 0.12::FLOAT) AS ink, 0::BIGINT AS hidden, 0::BIGINT AS stray FROM t GROUP BY 1")
def bake(spark, sf_dir):
    """What holds of every baked mask: all ink and nothing else has an order."""

    def told(v):
        mask = synthetic.enlarged(v, 0.12)
        order, _ = kernels.bake(np.where(mask, 255, 0))
        yield int(mask.sum()), int((order[mask] == model.HIDDEN).sum()), int((order[~mask] != model.HIDDEN).sum())

    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), told, "ink long, hidden long, stray long", spread=True)


@query("SELECT vec_id AS map_id, CAST(vec_id % 12 + 1 AS BIGINT) AS spur, CASE WHEN vec_id % 12 + 1 <= 6 THEN 31 ELSE 31 + vec_id % 12 END AS kept FROM embeddings")
def spur_prune(spark, sf_dir):
    """A stroke of 30 pixels with a spur of 1 to 12 above it: up to 6 all of it goes but the pixel at the junction."""

    def stamped(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spurs = [k % 12 + 1 for k in keys]
            kept = [len(kernels.prune(kernels.graph_of(synthetic.boxes(40, 40, (5, 20, 34, 20), (20, 20 - n, 20, 19))), 6)) for n in spurs]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spurs, pa.int64()), pa.array(kept, pa.int64())], names=["map_id", "spur", "kept"])

    runtime.ship(spark)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long")).mapInArrow(stamped, "map_id long, spur long, kept long")


@query(f"WITH RECURSIVE {MASK}, {CC.format(m='mask', same='')} SELECT map_id, count(*) AS met, min(i) AS first, CAST(count(DISTINCT component) AS BIGINT) AS parts FROM cc GROUP BY 1")
def traverse(spark, sf_dir):
    """One stroke over all ink: every pixel is met, the topmost first, and the clock starts once for each part without a way to it."""

    def clock(v):
        mask = v > 0
        times = kernels.traverse(kernels.graph_of(mask), 8)
        if times:
            at = list(times)
            steps = [0] + [abs(a % 8 - b % 8) > 1 or abs(a // 8 - b // 8) > 1 for a, b in zip(at, at[1:], strict=False)]
            parts = kernels.label(mask)[1]
            yield len(times), at[0], parts if sum(steps) >= parts - 1 else -1

    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), clock, "met long, first int, parts long")


@query(f"WITH {MASK} SELECT map_id, count(*) AS painted, 0::BIGINT AS outside, CAST(min(i) AS INTEGER) AS first FROM mask GROUP BY 1")
def brush_sweep(spark, sf_dir):
    """A brush over all of a mask's pixels paints the mask and nothing else, from the topmost pixel on."""

    def painted(v):
        mask = v > 0
        if mask.any():
            field = kernels.sweep(kernels.traverse(kernels.graph_of(mask), 8), mask)
            yield int((field >= 0).sum()), int((field[~mask] >= 0).sum()), int(np.flatnonzero(field.ravel() == 0)[0])

    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), painted, "painted long, outside long, first int")


@query(f"WITH RECURSIVE {MASK}, {CC.format(m='mask', same='')}, f AS (SELECT map_id, min(i) AS seed FROM mask GROUP BY 1) SELECT map_id, CAST(seed AS INTEGER) AS seed, count(*) AS reached FROM f JOIN cc USING (map_id) WHERE cc.component = f.seed GROUP BY 1, 2")
def geodesic_spread(spark, sf_dir):
    """From one seed, the topmost pixel, its whole component is reached and nothing else."""

    def reached(v):
        mask = v > 0
        if mask.any():
            seed = int(np.flatnonzero(mask.ravel())[0])
            yield seed, int((kernels.spread({seed: 3.0}, mask) == 3).sum())

    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), reached, "seed int, reached long")


NOTCHES = f"""{ORDERS}, st AS (SELECT unnest(range(5, 100, 5)) AS percent), w AS (
  SELECT a.map_id, a.i, a.x, a.y, percent, NOT 24 * (percent / 100.0::DOUBLE * 255 - a.ord) > 200 AS closed, count(*) AS n, count(*) FILTER (24 * (percent / 100.0::DOUBLE * 255 - b.ord) > 200) AS opened
  FROM o a JOIN o b ON b.map_id = a.map_id AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2, st GROUP BY ALL),
p AS (SELECT map_id * 100 + percent AS map_id, i, x, y FROM w WHERE closed AND n >= 8 AND opened >= 0.6 * n),
{CC.format(m='p', same='')}, g AS (SELECT map_id, component, count(*) AS n FROM cc GROUP BY 1, 2),
t AS (SELECT map_id, count(*) FILTER (n = 1) AS holes, count(*) FILTER (n > 1) AS bays, max(n) AS largest FROM g GROUP BY 1)"""


@query(f"WITH RECURSIVE {NOTCHES} SELECT vec_id AS map_id, CAST(percent AS BIGINT) AS percent, coalesce(holes, 0) AS holes, coalesce(bays, 0) AS bays, coalesce(largest, 0) AS largest FROM embeddings, st LEFT JOIN t ON t.map_id = vec_id * 100 + percent")
def notch_report(spark, sf_dir):
    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), lambda v: metrics.notches(synthetic.order_plane(v)), "percent long, holes long, bays long, largest long")


FNV = "list_reduce(list_concat([14695981039346656037::HUGEINT, 8, 0, 0, 0, 8, 0, 0, 0], {bytes}), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT)"


@query(f"WITH {TILE}, c AS (SELECT map_id, list(CASE WHEN v > 0 THEN CAST(least(floor(v * 512), 254) AS HUGEINT) ELSE 255 END ORDER BY i) AS bytes FROM tile GROUP BY 1) SELECT map_id, printf('%016x', {FNV.format(bytes='bytes')}::UBIGINT) AS digest FROM c")
def digest64(spark, sf_dir):
    return synthetic.by_vector(read(spark, sf_dir, "embeddings"), lambda v: [(f"{metrics.fnv64(synthetic.order_plane(v).tobytes(), W, H):016x}",)], "digest string")


# Stamps of boxes, moved by each supplier's number: left, top, right, bottom.
ONE_LINE, TWO_LINES = ((100, 10, 118, 30), (10, 10, 28, 30), (55, 10, 73, 30)), ((60, 60, 78, 80), (60, 10, 78, 30), (10, 60, 28, 80), (10, 10, 28, 30))
GLYPHS = ((4, 4, 9, 16), (13, 4, 17, 16), (4, 20, 17, 30), (18, 8, 31, 10), (32, 4, 46, 30))


def annotated(spark, sf_dir, stamps, width: int, height: int, syllables: int | None) -> DataFrame:
    """map_id, chunk, line, pixels, strokes, left_x of boxes read as handwriting, one map for each supplier."""

    def run(batches):
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                pixels = np.flatnonzero(synthetic.boxes(height, width, *((a + key % 5, b, c + key % 5, d) for a, b, c, d in stamps)).ravel())
                found = strokes.segment_annotation(pixels, width, height, model.AnnotationSettings(syllables=syllables))
                rows += [(key, k, c.line, len(c.pixels), len(c.strokes), c.left) for k, c in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["map_id", "chunk", "line", "pixels", "strokes", "left_x"])

    runtime.ship(spark)
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long")).mapInArrow(run, "map_id long, chunk long, line long, pixels long, strokes long, left_x long")


def box_sql(values: str) -> str:
    return f"SELECT s_suppkey AS map_id, CAST(chunk AS BIGINT) AS chunk, CAST(line AS BIGINT) AS line, CAST(pixels AS BIGINT) AS pixels, 0::BIGINT AS strokes, CAST(left_x + s_suppkey % 5 AS BIGINT) AS left_x FROM supplier, (VALUES {values}) b(chunk, line, pixels, left_x)"


@query(box_sql("(0, 0, 399, 10), (1, 0, 399, 55), (2, 0, 399, 100)"))
def annotate(spark, sf_dir):
    return annotated(spark, sf_dir, ONE_LINE, 200, 60, None)


@query(box_sql("(0, 0, 399, 10), (1, 0, 399, 60), (2, 1, 399, 10), (3, 1, 399, 60)"))
def annotate_lines(spark, sf_dir):
    return annotated(spark, sf_dir, TWO_LINES, 200, 120, None)


@query("SELECT s_suppkey AS map_id, 2::BIGINT AS chunks, 744::BIGINT AS pixels FROM supplier")
def syllables(spark, sf_dir):
    """Joined glyphs with a hint of two: two chunks, and no pixel is lost."""
    return annotated(spark, sf_dir, GLYPHS, 60, 40, 2).groupBy("map_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("pixels").alias("pixels"))


@query(f"WITH {TILE}, c AS (SELECT map_id, i, lpad(lower(to_hex(CASE WHEN v > 0 THEN CAST(least(floor(v * 512), 254) AS BIGINT) ELSE 255 END)), 2, '0') AS b FROM tile) SELECT map_id, string_agg(b || b || b || 'ff', '' ORDER BY i) AS rgba FROM c GROUP BY 1")
def packed_orders(spark, sf_dir):
    sizes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("map_id"), F.lit(W).alias("width"), F.lit(H).alias("height"))
    return rasters.pack_orders(orders_of(spark, sf_dir), sizes).select("map_id", F.lower(F.hex("rgba")).alias("rgba"))


# Stamps with known answers, whole maps each: what is measured must lie within what is known.
def stamp_masks() -> dict[str, np.ndarray]:
    """Masks by name: bars of known length, small regions at borders, roads that come near themselves."""
    bars = {"straight": [(100, 40, 106, 339)], "corner": [(60, 40, 259, 46), (253, 40, 259, 239)], "valley": [(60, 40, 66, 239), (60, 233, 199, 239), (193, 40, 199, 239)]}
    out = {name: synthetic.boxes(400, 400, *b) for name, b in bars.items()}
    out |= {f"bar{h}": synthetic.boxes(400, 400, (100, 30, 106, 29 + h)) for h in (60, 120, 200, 300)}
    out |= {"frame": synthetic.boxes(24, 24, (0, 0, 23, 0), (0, 23, 23, 23), (0, 0, 0, 23), (23, 0, 23, 23)), "corner_dot": synthetic.boxes(24, 24, (0, 0, 0, 0)), "row": synthetic.boxes(24, 24, (2, 0, 19, 0)), "full": synthetic.boxes(24, 24, (0, 0, 23, 23)), "empty": synthetic.boxes(20, 20)}
    out["dots"] = synthetic.boxes(20, 20, (3, 3, 3, 3), (6, 3, 6, 3), (3, 5, 3, 5), (5, 5, 5, 5))
    out["hairpin"] = synthetic.polyline(120, [(30, 15), (30, 75), (34, 90), (48, 90), (52, 75), (52, 15)], 6)
    out["snake"] = synthetic.polyline(120, [(20, 20), (95, 30), (25, 55), (95, 75), (25, 100)], 7)
    out["thick"] = synthetic.polyline(120, [(20, 60), (100, 60)], 11)
    return out


def baked_stamps(spark) -> DataFrame:
    """map_id, i, x, y, ord, length, width of every ink pixel of the stamps."""
    runtime.ship(spark)
    rows = [(name, m.shape[1], m.shape[0], bytearray(m.tobytes())) for name, m in stamp_masks().items()]

    def run(batches):
        for batch in batches:
            for name, w, h, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mask = np.frombuffer(raw, dtype=bool).reshape(h, w)
                order, length = kernels.bake(np.where(mask, 255, 0))
                at = np.flatnonzero(mask.ravel())
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *(pa.array(a.astype(np.int32)) for a in (at, at % w, at // w, order.ravel()[at])), pa.array(np.full(n, length)), pa.array(np.full(n, w, np.int32))], names=["map_id", "i", "x", "y", "ord", "length", "width"])

    return spark.createDataFrame(rows, "name string, width int, height int, mask binary").repartition(8).mapInArrow(run, "map_id string, i int, x int, y int, ord int, length double, width int")


@query("SELECT * FROM (VALUES ('straight', 300, TRUE), ('corner', 400, TRUE), ('valley', 540, TRUE)) t(map_id, known, near)")
def stroke_lengths(spark, sf_dir):
    """Measured lengths of bars lie within 15 percent of the known ones."""
    known = F.when(F.col("map_id") == "straight", 300).when(F.col("map_id") == "corner", 400).otherwise(540)
    found = baked_stamps(spark).filter(F.col("map_id").isin("straight", "corner", "valley")).groupBy("map_id").agg(F.max("length").alias("length"))
    return found.select("map_id", known.alias("known"), (F.abs(F.col("length") - known) <= 0.15 * known).alias("near"))


@query("SELECT * FROM (VALUES ('bar60', 1), ('bar120', 2), ('bar200', 3), ('bar300', 4)) t(map_id, place)")
def lengths_by_height(spark, sf_dir):
    found = baked_stamps(spark).filter("map_id like 'bar%'").groupBy("map_id").agg(F.max("length").alias("length"))
    return found.select("map_id", F.rank().over(Window.orderBy("length")).alias("place"))


@query("SELECT * FROM (VALUES (63, 0), (66, 254), (103, 0), (105, 0)) t(i, ord)")
def region_dots(spark, sf_dir):
    return baked_stamps(spark).filter("map_id = 'dots'").select("i", "ord")


@query("SELECT * FROM (VALUES ('frame', 92::BIGINT, 0::BIGINT), ('corner_dot', 1, 0), ('row', 18, 0), ('full', 576, 0)) t(map_id, ink, hidden)")
def region_borders(spark, sf_dir):
    found = baked_stamps(spark).filter(F.col("map_id").isin("frame", "corner_dot", "row", "full", "empty"))
    return found.groupBy("map_id").agg(F.count(F.lit(1)).alias("ink"), F.count_if(F.col("ord") == model.HIDDEN).alias("hidden"))


@query("SELECT * FROM (VALUES ('hairpin', 0::BIGINT, TRUE, 0::BIGINT), ('snake', 0, TRUE, 0), ('thick', 0, TRUE, 0)) t(map_id, jumps, smooth, holes)")
def smooth_orders(spark, sf_dir):
    """Roads that come near themselves: no jump, no step beyond what is known, and no hole at any tenth of the way."""
    orders = runtime.table(baked_stamps(spark).filter(F.col("map_id").isin("hairpin", "snake", "thick")).select("map_id", "i", "x", "y", "ord"))
    known = F.when(F.col("map_id") == "hairpin", 5).when(F.col("map_id") == "snake", 10).otherwise(4)
    jumps = stencil.edge_jumps(orders, 120, 120).select("map_id", "jumps", (F.col("worst") <= known).alias("smooth"))
    every = [stencil.isolated_holes(orders, 120, 120, p / 10) for p in range(1, 10)]
    holes = reduce(DataFrame.unionByName, every).groupBy("map_id").agg(F.sum("holes").alias("holes"))
    return jumps.join(holes, "map_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
