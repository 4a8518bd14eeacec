"""Generated rasters with known answers, from integer stamps only, and kernels over tiles of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeloom import model, runtime
from strokeloom.operators import kernels
from strokeloom.sources.rasters import RASTERS

# Colours and places of the scene of 90 x 90.
SIDE = 90
PAGE, ROAD, CROSS, WORDS = (240, 238, 230), (40, 38, 36), (210, 40, 40), (205, 45, 50)
WORD_LEFTS, WORD_TOP, WORD_SIZE = (12, 32, 52), 74, (12, 9)


def scene_pixels(spark: SparkSession) -> DataFrame:
    """The scene as pixels, straight from a range: a road, a cross at its end, three words."""
    x, y = F.col("x"), F.col("y")
    word = y.between(WORD_TOP, WORD_TOP + WORD_SIZE[1] - 1) & (x.between(12, 23) | x.between(32, 43) | x.between(52, 63))
    cross = y.between(55, 67) & ((F.abs((x - 45) - (y - 61)) <= 1) | (F.abs((x - 45) + (y - 61)) <= 1))
    road = x.between(43, 47) & y.between(8, 58)

    def channel(k: int) -> Column:
        return F.when(word, WORDS[k]).when(cross, CROSS[k]).when(road, ROAD[k]).otherwise(PAGE[k])

    grid = spark.range(SIDE * SIDE).select(F.lit("scene").alias("map_id"), F.col("id").cast("int").alias("i"), (F.col("id") % SIDE).cast("int").alias("x"), F.floor(F.col("id") / SIDE).cast("int").alias("y"))
    base = [F.lit(PAGE[k]).cast("smallint").alias(f"b{c}") for k, c in enumerate("rgb")]
    composed = [channel(k).cast("smallint").alias(f"c{c}") for k, c in enumerate("rgb")]
    opaque = F.lit(255).cast("smallint")
    return grid.select("*", *base, opaque.alias("ba"), *composed, opaque.alias("ca"))


def scene(road: bool = True, cross: str = "both", words: int = 3, shift: tuple[int, int] = (0, 0)) -> tuple[bytes, bytes]:
    """Planes of the scene or a variant: without a road, with half a cross or none, or the cross moved away."""
    base = np.empty((SIDE, SIDE, 4), dtype=np.uint8)
    base[..., :3], base[..., 3] = PAGE, 255
    out = base.copy()
    if road:
        out[8:59, 43:48, :3] = ROAD
    for t in range(-6, 7):
        for thick in (-1, 0, 1):
            if cross in ("both", "half"):
                out[61 + t + shift[1], 45 + t + thick + shift[0], :3] = CROSS
            if cross == "both":
                out[61 + t + shift[1], 45 - t + thick + shift[0], :3] = CROSS
    for left in WORD_LEFTS[:words]:
        out[WORD_TOP : WORD_TOP + WORD_SIZE[1], left : left + WORD_SIZE[0], :3] = WORDS
    return base.tobytes(), out.tobytes()


def scenes(spark: SparkSession) -> DataFrame:
    """rasters of the scene and its variants."""
    variants = {"scene": {}, "half_cross": {"cross": "half"}, "no_cross": {"cross": ""}, "no_road": {"road": False}, "far_cross": {"shift": (30, -30)}}
    rows = [(name, SIDE, SIDE, *scene(**kw)) for name, kw in variants.items()]
    return spark.createDataFrame([(n, w, h, bytearray(b), bytearray(c)) for n, w, h, b, c in rows], RASTERS)


def disc(mask: np.ndarray, x: float, y: float, radius: float) -> None:
    """Stamp a disc."""
    yy, xx = np.ogrid[: mask.shape[0], : mask.shape[1]]
    mask |= (xx - x) ** 2 + (yy - y) ** 2 <= radius * radius


def polyline(side: int, points: list[tuple[float, float]], radius: float) -> np.ndarray:
    """The mask of a round pen going along a polyline in half steps, stamped at whole pixels."""
    mask = np.zeros((side, side), dtype=bool)
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        n = max(1, math.ceil(2 * max(abs(x1 - x0), abs(y1 - y0))))
        for x, y in sorted({(kernels.half_away(x0 + (x1 - x0) * k / n), kernels.half_away(y0 + (y1 - y0) * k / n)) for k in range(n + 1)}):
            disc(mask, x, y, radius)
    return mask


def boxes(height: int, width: int, *corners: tuple[int, int, int, int]) -> np.ndarray:
    """The mask of boxes (left, top, right, bottom), bounds included."""
    mask = np.zeros((height, width), dtype=bool)
    for left, top, right, bottom in corners:
        mask[top : bottom + 1, left : right + 1] = True
    return mask


#: Shapes of roads as turns of a unit square; the pen goes through them from the first on.
ROADS = {
    "gentle": lambda t: (0.5 + 0.09 * np.sin(2 * np.pi * t), 0.06 + 0.62 * t),
    "serpentine": lambda t: (0.5 + 0.28 * np.cos(4 * np.pi * t), 0.06 + 0.62 * t),
    "loop": lambda t: (0.5 + 0.2 * np.sin(2 * np.pi * t) * (t < 0.75) + (t >= 0.75) * (-0.2 + 0.8 * (t - 0.75)), 0.3 - 0.22 * np.cos(2 * np.pi * t) * (t < 0.75) + (t >= 0.75) * 1.4 * (t - 0.75)),
}


def road_map(shape: str = "serpentine", road_width: float = 14, words: int = 3, cross: bool = True, side: int = 420) -> tuple[bytes, bytes]:
    """Planes of a map: a spotted ground, and on it a road of one of ROADS, a cross at its end and boxes for words below it."""
    ground = np.empty((side, side, 4), dtype=np.int16)
    ground[..., :3], ground[..., 3] = (138, 119, 101), 255
    for k in range(28):  # spots by a fixed rule, alike on both planes
        spot = np.zeros((side, side), dtype=bool)
        disc(spot, (k * 151 % 97) / 97 * side, (k * 211 % 89) / 89 * side, (18 + k * 37 % 42) * side / 420)
        ground[spot, :3] -= 2
    out = ground.copy()
    t = np.linspace(0, 1, 200)
    x, y = ROADS[shape](t)
    points = list(zip((x * side).tolist(), (y * side).tolist(), strict=True))
    out[polyline(side, points, road_width / 2), :3] = (255, 253, 248)
    if cross:
        ex, ey, reach, thick = *points[-1], 0.05 * side, 0.012 * side
        for turn in (1, -1):
            out[polyline(side, [(ex - reach, ey - turn * reach), (ex + reach, ey + turn * reach)], thick), :3] = (249, 124, 124)
    for k in range(words):
        left, top = int((0.15 + 0.22 * k) * side), int(0.86 * side)
        out[top : top + int(0.08 * side), left : left + int(0.1 * side), :3] = (249, 124, 124)
    return ground.astype(np.uint8).tobytes(), out.astype(np.uint8).tobytes()


def table_maps(keys: DataFrame) -> DataFrame:
    """rasters (map_id, width, height, base, composed), one scene for each key: its number says how many words it has, whether a cross, and how far road and cross are shifted."""
    runtime.ship(keys.sparkSession)
    name = keys.columns[0]

    def run(batches):
        for batch in batches:
            for key in batch.column(0).to_pylist():
                base, out = scene(cross="", road=False, words=key % 4)
                moved = np.frombuffer(scene(cross="both" if key % 3 else "", words=0)[1], np.uint8).reshape(SIDE, SIDE, 4)
                out = np.frombuffer(out, np.uint8).reshape(SIDE, SIDE, 4).copy()
                out[:70] = np.roll(moved[:70], key % 7, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([SIDE], pa.int32()), pa.array([SIDE], pa.int32()), pa.array([base], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["map_id", "width", "height", "base", "composed"])

    spread = keys.select(F.col(name).cast("long")).repartition(keys.sparkSession.sparkContext.defaultParallelism)  # a number is much less than its map
    return spread.mapInArrow(run, "map_id string, width int, height int, base binary, composed binary")


def by_vector(embeddings: DataFrame, rows_of, schema: str, spread: bool = False) -> DataFrame:
    """vec_id as map_id, and the rows that ``rows_of(plane)`` gives for each vector as an 8 x 8 plane. Kernels run where the rows are; only for kernels that cost much more than a vector's way are rows ``spread`` before."""
    runtime.ship(embeddings.sparkSession)
    fields = [x.split() for x in ("map_id long, " + schema).split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            found = [(k, *row) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in rows_of(np.array(v, dtype=np.float64).reshape(8, 8))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding")
    return (rows.repartition(embeddings.sparkSession.sparkContext.defaultParallelism) if spread else rows).mapInArrow(run, f"map_id long, {schema}")


def order_plane(plane: np.ndarray) -> np.ndarray:
    """The order codes of a plane: cells above zero by their value, others hidden."""
    return np.where(plane > 0, np.minimum(np.floor(plane * 512), 254), model.HIDDEN).astype(np.uint8)


def enlarged(plane: np.ndarray, above: float, factor: int = 4) -> np.ndarray:
    """The mask of the cells above a value, each ``factor`` pixels wide and high."""
    return np.kron(plane > above, np.ones((factor, factor), dtype=bool))
