"""From raster pairs to reveal plans. A plan is space and order; nothing here knows of time.

Pixel rules run as expressions over all pixels of all maps. What is sequential within a map runs in
one grouped kernel per map, so maps are the unit of parallelism: ``plans`` reads rasters and emits
segments and plan pixels of a map together, and its two halves are filters over one written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokeloom import model, runtime
from strokeloom.operators import kernels, strokes
from strokeloom.sources.rasters import validated


def changed(s: model.DetectSettings) -> Column:
    difference = sum((F.abs(F.col(f"b{c}").cast("int") - F.col(f"c{c}")) for c in "rgb"), F.lit(0))
    return (difference > s.min_change) & (F.col("ca") >= s.min_alpha)


def classify(pixels: DataFrame, settings: model.DetectSettings | None = None) -> DataFrame:
    """The changed pixels, with class accent (red) or road."""
    s = settings or model.DetectSettings()
    return pixels.filter(changed(s)).withColumn("class", F.when(F.col("cr").cast("int") - F.col("cg") > s.accent_excess, "accent").otherwise("road"))


def class_boxes(classified: DataFrame) -> DataFrame:
    """map_id, class, pixels and the inclusive box of each class."""
    return classified.groupBy("map_id", "class").agg(F.count(F.lit(1)).alias("pixels"), F.min("x").alias("left_x"), F.min("y").alias("top_y"), F.max("x").alias("right_x"), F.max("y").alias("bottom_y"))


def uncovered(changed_pixels: DataFrame, plan_pixels: DataFrame) -> DataFrame:
    """Changed pixels without a segment."""
    return changed_pixels.join(plan_pixels.select("map_id", "i"), ["map_id", "i"], "left_anti")


def scaled_measures(segments: DataFrame, factor: float) -> DataFrame:
    """Segments with measures at another scale; relative lengths stay."""
    return segments.withColumn("measure", F.col("measure") * factor)


def merged_overflow(chunks: DataFrame, taken: int) -> DataFrame:
    """map_id, id of chunks (map_id, chunk_no) when ``taken`` ids are used: those beyond the last id share it."""
    return chunks.withColumn("id", F.least(F.col("chunk_no") + taken, F.lit(model.MAX_SEGMENT_ID)).cast("int"))


def segment_boxes(plan_pixels: DataFrame) -> DataFrame:
    """map_id, segment_id, pixel_count, box and measure (box width) of plan pixels (map_id, segment_id, x, y)."""
    box = plan_pixels.groupBy("map_id", "segment_id").agg(F.count(F.lit(1)).alias("pixel_count"), F.min("x").alias("left_x"), F.min("y").alias("top_y"), F.max("x").alias("right_x"), F.max("y").alias("bottom_y"))
    return box.withColumn("measure", (F.col("right_x") - F.col("left_x") + 1).cast("double"))


# One map ---------------------------------------------------------------------------------------
def absorb(road: np.ndarray, accent: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Road blobs of at most ``most`` pixels that touch accents become accents; all at once, so none follows another."""
    if most <= 0 or not accent.any():
        return road, accent
    parts, n = kernels.label(road)
    if not n:
        return road, accent
    size = np.bincount(parts[road], minlength=n)
    touches = np.zeros(n, dtype=bool)
    touches[parts[road & kernels.dilate(accent)]] = True
    move = road & ((size <= most) & touches)[np.where(road, parts, 0)]
    return road & ~move, accent | move


def choose_cross(accent: np.ndarray, road: np.ndarray, s: model.DetectSettings) -> tuple[np.ndarray, strokes.Split] | None:
    """The accent blob that crosses the end of the road: near it, clearly nearer than any other, of the right size, and made of two strokes."""
    h, w = accent.shape
    if not accent.any() or not road.any():
        return None
    parts, n = kernels.label(road)
    main = np.flatnonzero(parts.ravel() == np.bincount(parts[road], minlength=n).argmax())
    ry, rx = main // w, main % w
    marked, m = kernels.label(accent)
    found = [np.flatnonzero(marked.ravel() == k) for k in range(m)]
    found = sorted((b for b in found if len(b) / (w * h) >= s.min_blob_share), key=lambda b: (-len(b), b[0]))
    if not found:
        return None
    far = [float(np.sqrt(((rx - (b % w).mean()) ** 2 + (ry - (b // w).mean()) ** 2).min())) for b in found]
    at = int(np.argmin(far))
    best, rest = far[at], far[:at] + far[at + 1 :]
    if best / w > s.max_road_distance or (rest and best > 0 and min(rest) / best < s.min_distance_ratio):
        return None
    if not s.min_area_share <= len(found[at]) / (w * h) <= s.max_area_share:
        return None
    split = strokes.split_cross(found[at], w)
    return None if split is None else (found[at], split)


class PlanBuilder:
    """Segments and plan pixels of one map."""

    def __init__(self, width: int):
        self.width, self.segments, self.pixels = width, [], []

    def add(self, pixels: np.ndarray, kind: str, progress: np.ndarray | None = None, measure: float | None = None, relative: float | None = None, within: np.ndarray | None = None) -> None:
        if not len(pixels) or len(self.segments) > model.MAX_SEGMENT_ID:
            return
        x, y = pixels % self.width, pixels // self.width
        left, right = int(x.min()), int(x.max())
        if within is None:
            share = progress if progress is not None else (np.ones(len(x)) if right == left else (x - left) / (right - left))
            within = np.floor(np.clip(share, 0, 1).astype(np.float64) * model.WITHIN_SCALE + 0.5)
        number = len(self.segments)
        self.segments.append((number, kind, len(pixels), left, int(y.min()), right, int(y.max()), float(right - left + 1) if measure is None else measure, relative))
        self.pixels.append((np.full(len(pixels), number), pixels, within.astype(np.int64)))


def relative_length(length: float, long_side: int) -> float:
    """The profile of scalar.relative_length_at for one number."""
    if long_side > 0 and long_side != model.REFERENCE_SIDE:
        length = length * model.REFERENCE_SIDE / long_side
    squeeze = lambda v: v**model.LENGTH_EXPONENT if v > 0 else 0.0
    low, high = squeeze(model.SHORTEST), squeeze(model.LONGEST)
    return min(max((squeeze(length) - low) / (high - low), 0.0), 1.0)


def detect(width: int, height: int, base: bytes, composed: bytes, settings: model.DetectSettings | None = None) -> PlanBuilder:
    """The plan of one raster pair: road, then the cross's strokes, then handwriting."""
    s = settings or model.DetectSettings()
    before, after = (np.frombuffer(p, np.uint8).reshape(height, width, 4).astype(np.int64) for p in (base, composed))
    drawn = (np.abs(before - after)[:, :, :3].sum(axis=2) > s.min_change) & (after[:, :, 3] >= s.min_alpha)
    accent = drawn & (after[:, :, 0] - after[:, :, 1] > s.accent_excess)
    road, accent = absorb(drawn & ~accent, accent, s.stray_pixels)
    out = PlanBuilder(width)
    if road.any():
        order, length = kernels.bake(np.where(road, 255, 0))
        at = np.flatnonzero(road.ravel())
        within = np.floor(order.ravel()[at].astype(np.float64) * model.WITHIN_SCALE / 254 + 0.5)
        out.add(at, "primaryStroke", measure=length, relative=relative_length(length, max(width, height)), within=within)
    left = np.flatnonzero(accent.ravel())
    chosen = choose_cross(accent, road, s)
    if chosen:
        blob, split = chosen
        out.add(blob[split.on_backslash], "crossBackslash", split.within[split.on_backslash], split.lengths[0])
        out.add(blob[~split.on_backslash], "crossSlash", split.within[~split.on_backslash], split.lengths[1])
        left = np.setdiff1d(left, blob)
    chunks = strokes.segment_annotation(left, width, height, s.annotation)
    room = model.MAX_SEGMENT_ID + 1 - len(out.segments)
    for chunk in chunks[: room - 1] if len(chunks) > room else chunks:
        out.add(np.array(chunk.pixels), "annotation", strokes.stroke_progress(chunk, width))
    if len(chunks) > room > 0:
        out.add(np.array([p for c in chunks[room - 1 :] for p in c.pixels]), "annotation")
    return out


PLAN = "map_id string, id int, kind string, pixel_count int, left_x int, top_y int, right_x int, bottom_y int, measure double, relative_length double, i array<int>, within array<int>"
PLAN_NAMES = [x.split()[0] for x in PLAN.split(", ")]


def plans(rasters: DataFrame, settings: model.DetectSettings | None = None) -> DataFrame:
    """One row per segment of every map, with its pixels' indices and within codes. Maps are handled one by one, whole."""
    runtime.ship(rasters.sparkSession)

    def run(batches):
        for batch in batches:
            for map_id, w, h, base, composed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plan = detect(w, h, base, composed, settings)
                rows = [(map_id, *seg, p[1].tolist(), p[2].tolist()) for seg, p in zip(plan.segments, plan.pixels, strict=True)]
                if rows:
                    types = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 5, pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=PLAN_NAMES)

    return validated(rasters).select("map_id", "width", "height", "base", "composed").mapInArrow(run, PLAN)


def empty_maps(rasters: DataFrame, plan: DataFrame) -> DataFrame:
    """map_id of the rasters whose plan is empty: nothing to reveal."""
    return rasters.select("map_id").join(plan.select("map_id").distinct(), "map_id", "left_anti")


def segments_of(plan: DataFrame) -> DataFrame:
    return plan.drop("i", "within")


def pixels_of(plan: DataFrame) -> DataFrame:
    """map_id, segment_id, i, within."""
    return plan.select("map_id", F.col("id").alias("segment_id"), F.explode(F.arrays_zip("i", "within")).alias("p")).select("map_id", "segment_id", "p.i", "p.within")
