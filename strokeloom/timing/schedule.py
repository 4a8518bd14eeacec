"""Time for plans: windows per segment, stage ends, and the order raster. Re-timing reads a plan and never detects anew."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import model
from strokeloom.functions import scalar


class TimingPolicy(Protocol):
    """Gives each segment (map_id, id, kind, measure, relative_length) a window of 0..1."""

    def windows(self, segments: DataFrame) -> DataFrame: ...


class HandwritingPolicy:
    """Main stroke by its relative length, then the cross, then handwriting by width. Windows run in the order of ids."""

    def __init__(self, settings: model.TimingSettings | None = None):
        self.settings = settings or model.TimingSettings()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, HandwritingPolicy) and self.settings == other.settings

    def __hash__(self) -> int:
        return hash(self.settings)

    def spans(self, segments: DataFrame) -> DataFrame:
        """segments with gap and span in milliseconds."""
        s, kind = self.settings, F.col("kind")
        order = Window.partitionBy("map_id").orderBy("id")
        texts_before = F.count_if(kind == "annotation").over(order.rowsBetween(Window.unboundedPreceding, -1))
        gap = (
            F.when((F.row_number().over(order) == 1) | (kind == "primaryStroke"), 0)
            .when(kind == "crossBackslash", s.primary_to_cross_gap)
            .when(kind == "crossSlash", s.cross_gap)
            .otherwise(F.when(F.coalesce(texts_before, F.lit(0)) > 0, s.annotation_gap).otherwise(s.cross_to_annotation_gap))
        )
        span = (
            F.when(kind == "primaryStroke", scalar.primary_millis(F.col("relative_length"), s.primary_from, s.primary_to))
            .when(kind.isin("crossBackslash", "crossSlash"), F.lit(s.cross_duration).cast("long"))
            .otherwise(scalar.annotation_millis(F.col("measure"), s.per_pixel, s.annotation_from, s.annotation_to))
        )
        return segments.select("*", gap.cast("long").alias("gap_ms"), span.alias("span_ms"))

    def windows(self, segments: DataFrame) -> DataFrame:
        """map_id, segment_id, kind, start, end, edge (null: linear), total_ms. A map without duration has no windows."""
        order = Window.partitionBy("map_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = F.col("gap_ms") + F.col("span_ms")
        timed = self.spans(segments).select("*", F.sum(both).over(order).alias("until"), F.sum(both).over(Window.partitionBy("map_id")).alias("total_ms"))
        edge = F.when(F.col("kind") != "annotation", F.lit(self.settings.pen_edge))
        return timed.filter("total_ms > 0").select("map_id", F.col("id").alias("segment_id"), "kind", ((F.col("until") - F.col("span_ms")) / F.col("total_ms")).alias("start"), (F.col("until") / F.col("total_ms")).alias("end"), edge.alias("edge"), "total_ms")


def totals(segments: DataFrame, policy: HandwritingPolicy | None = None) -> DataFrame:
    """map_id, total_ms."""
    return (policy or HandwritingPolicy()).spans(segments).groupBy("map_id").agg(F.sum(F.col("gap_ms") + F.col("span_ms")).alias("total_ms"))


def stage_marks(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """map_id, primary_end, cross_end, annotation_end, has_cross, has_annotation. Windows and segments meet by id; an absent stage ends with the one before."""
    kinds = segments.select("map_id", F.col("id").alias("segment_id"), F.col("kind").alias("seg_kind"))
    met = windows.select("map_id", "segment_id", "end").join(kinds, ["map_id", "segment_id"])
    last = lambda *k: F.max(F.when(F.col("seg_kind").isin(*k), F.col("end")))
    ends = met.groupBy("map_id").agg(last("primaryStroke").alias("p"), last("crossBackslash", "crossSlash").alias("c"), last("annotation").alias("a"))
    primary = F.coalesce("p", F.lit(0.0))
    cross = F.greatest(primary, F.coalesce("c", F.lit(0.0)))
    return ends.select("map_id", primary.alias("primary_end"), cross.alias("cross_end"), F.greatest(cross, F.coalesce("a", F.lit(0.0))).alias("annotation_end"), F.col("c").isNotNull().alias("has_cross"), F.col("a").isNotNull().alias("has_annotation"))


#: The marks of a plan that is played as one stage.
SINGLE_STAGE = {"primary_end": 1.0, "cross_end": 1.0, "annotation_end": 1.0}


def in_order(marks: DataFrame) -> DataFrame:
    """map_id and ends, the marks of stage_marks as one array in playing order."""
    return marks.select("map_id", F.array("primary_end", "cross_end", "annotation_end").alias("ends"))


def eased(distance: Column, edge: Column, pen_edge: float = 0.12) -> Column:
    return F.when(edge.isNull(), scalar.linear_time(distance)).otherwise(scalar.pen_time(distance, pen_edge))


def compile_orders(plan_pixels: DataFrame, windows: DataFrame, sharpness: model.Sharpness | None = None, pen_edge: float = 0.12, last_id: int | None = model.MAX_SEGMENT_ID) -> DataFrame:
    """map_id, i, ord of every plan pixel (map_id, segment_id, i, within); one without a window, or with an id out of range, stays hidden.

    Plans of rasters have ids up to ``last_id``; None is for segments that come from a table and may be more.

    The join is on ids, the order is computed from matched rows only, and null means no match, so no
    clamp can turn a missing window into code 0.
    """
    top = scalar.max_order(F.lit((sharpness or model.Sharpness()).k))
    time = eased(F.col("within") / float(model.WITHIN_SCALE), F.col("edge"), pen_edge)
    met = plan_pixels.join(windows.select("map_id", "segment_id", "start", "end", "edge").withColumn("timed", F.lit(True)), ["map_id", "segment_id"], "left")
    in_range = (F.col("segment_id") >= 0) & (F.lit(True) if last_id is None else F.col("segment_id") <= last_id)
    code = F.when(F.col("timed") & in_range, scalar.order_of(F.col("start"), F.col("end"), time, top))
    return met.select("map_id", "i", F.coalesce(code, F.lit(model.HIDDEN)).cast("int").alias("ord"))


def frame_alpha(orders: DataFrame, progress: float, sharpness: model.Sharpness | None = None) -> DataFrame:
    """map_id, i, alpha at a progress; pixels without a row are transparent."""
    return orders.select("map_id", "i", scalar.alpha_at(F.col("ord"), F.lit(progress), F.lit((sharpness or model.Sharpness()).k)).alias("alpha"))


def frame(pixels: DataFrame, orders: DataFrame, progress: float, sharpness: model.Sharpness | None = None) -> DataFrame:
    """map_id, i, r, g, b of a frame: base, with the composed picture where the threshold lets it through."""
    met = pixels.join(frame_alpha(orders, progress, sharpness), ["map_id", "i"], "left")
    alpha = F.coalesce("alpha", F.lit(0.0))
    return met.select("map_id", "i", *(scalar.composite(F.col(f"b{c}"), F.col(f"c{c}"), alpha).alias(c) for c in "rgb"))
