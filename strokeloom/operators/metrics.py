"""Quality of orders and frames: jumps, holes, plateaus, pen-tip spans, coverage and digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import model, runtime
from strokeloom.functions.scalar import alpha_at, max_order
from strokeloom.operators import kernels, stencil


def translucency(orders: DataFrame, progresses: list[float], ks: list[float]) -> DataFrame:
    """k, progress, opaque, translucent: counts of rounded alphas over all maps."""
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("progress")) for k in ks for p in progresses)))
    alpha = orders.select("ord", points.alias("s")).select("s.k", "s.progress", F.round(alpha_at(F.col("ord"), F.col("s.progress"), F.col("s.k"))).alias("alpha"))
    return alpha.groupBy("k", "progress").agg(F.count_if(F.col("alpha") == 255).alias("opaque"), F.count_if((F.col("alpha") > 0) & (F.col("alpha") < 255)).alias("translucent"))


def sharpness_tradeoff(orders: DataFrame, width: int, height: int, ks: list[float]) -> DataFrame:
    """k, steps: pixels with a neighbour whose order differs by more than 255 / k."""
    worst = stencil.differences(orders, width, height, stencil.ALL).groupBy("map_id", "i").agg(F.max("diff").alias("g"))
    return worst.select("g", F.explode(F.array(*map(F.lit, ks))).alias("k")).groupBy("k").agg(F.count_if(F.col("g") > 255 / F.col("k")).alias("steps"))


def band_factorial(highres: DataFrame, progresses: list[float], k: float = 24.0) -> DataFrame:
    """progress and counts of partly open pixels of orders with fractions (map_id, i, ord_exact): codes or exact, slope or step."""
    exact = F.col("ord_exact")
    rows = highres.select("ord_exact", F.explode(F.array(*map(F.lit, progresses))).alias("progress"))
    partly = lambda order: (alpha_at(order, F.col("progress"), F.lit(k)) > 0) & (alpha_at(order, F.col("progress"), F.lit(k)) < 255)
    opened = lambda order: order <= F.col("progress") * 255
    return rows.groupBy("progress").agg(
        F.count_if(partly(F.round(exact))).alias("codes_slope"), F.count_if(partly(exact)).alias("exact_slope"), F.count_if(opened(F.round(exact))).alias("codes_step"), F.count_if(opened(exact)).alias("exact_step")
    )


def newly_lit_span(orders: DataFrame, width: int, progress: float, step: float, k: float = 24.0) -> DataFrame:
    """map_id, pixels, span: how many pixels turn opaque in one step, and the diagonal of their box."""
    full = lambda p: alpha_at(F.col("ord"), F.lit(p), F.lit(k)) >= 255
    new = orders.filter(full(progress + step) & ~full(progress)).withColumns({"px": F.col("i") % width, "py": F.floor(F.col("i") / width)})
    dx, dy = F.max("px") - F.min("px"), F.max("py") - F.min("py")
    return new.groupBy("map_id").agg(F.count(F.lit(1)).alias("pixels"), F.sqrt((dx * dx + dy * dy).cast("double")).alias("span"))


def playback(orders: DataFrame, width: int, height: int, frames: int = 60, k: float = 24.0) -> DataFrame:
    """map_id, frame, pixels, span, largest for every frame that turns pixels opaque: how many, the diagonal of their box, and the largest 8-connected part of them.

    A pixel turns opaque in one frame, which follows from its code, so each is looked at once however many frames there are.
    """
    frame = F.ceil(frames / k + F.col("ord") * (frames / 255.0)).cast("int")
    fresh = orders.select("map_id", "i", (F.col("i") % width).alias("px"), F.floor(F.col("i") / width).alias("py"), frame.alias("frame")).filter(F.col("frame") <= frames)
    dx, dy = F.max("px") - F.min("px"), F.max("py") - F.min("py")
    lit = fresh.groupBy("map_id", "frame").agg(F.count(F.lit(1)).alias("pixels"), F.sqrt((dx * dx + dy * dy).cast("double")).alias("span"))
    parts = labels(fresh, width, height, "frame").join(fresh.select("map_id", "i", "frame"), ["map_id", "i"]).groupBy("map_id", "frame", "component").agg(F.count(F.lit(1)).alias("n"))
    return lit.join(parts.groupBy("map_id", "frame").agg(F.max("n").alias("largest")), ["map_id", "frame"])


def coverage(changed: DataFrame, orders: DataFrame, k: float = 24.0) -> DataFrame:
    """map_id, uncovered, too_late: changed pixels without an order, and with one that never becomes opaque."""
    met = changed.select("map_id", "i").join(orders.select("map_id", "i", "ord"), ["map_id", "i"], "left")
    return met.groupBy("map_id").agg(F.count_if(F.col("ord").isNull()).alias("uncovered"), F.count_if(F.col("ord") > max_order(F.lit(k))).alias("too_late"))


def starts_near_top(road: DataFrame) -> DataFrame:
    """map_id, near_top: whether the first pixel drawn lies in the top tenth of the road's box (map_id, i, y, within)."""
    found = road.groupBy("map_id").agg(F.min_by("y", F.struct("within", "i")).alias("y"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    return found.select("map_id", (F.col("y") <= F.col("top") + (F.col("bottom") - F.col("top")) * 0.1).alias("near_top"))


def alpha_shape(orders: DataFrame, width: int, height: int, progress: float, k: float = 24.0) -> DataFrame:
    """map_id, partly, on_border: pixels that are not opaque, and those of them on the canvas's border."""
    a = alpha_at(F.col("ord"), F.lit(progress), F.lit(k))
    x, y = F.col("i") % width, F.floor(F.col("i") / width)
    border = (x == 0) | (x == width - 1) | (y == 0) | (y == height - 1)
    return orders.groupBy("map_id").agg(F.count_if(a != 255).alias("partly"), F.count_if((a != 255) & border).alias("on_border"))


def changed_in(pixels: DataFrame, left: int, top: int, right: int, bottom: int, least: int = 40) -> DataFrame:
    """map_id, n: pixels in a rectangle whose colours differ by more than ``least`` in sum."""
    difference = sum((F.abs(F.col(f"b{c}").cast("int") - F.col(f"c{c}")) for c in "rgb"), F.lit(0))
    inside = F.col("x").between(left, right) & F.col("y").between(top, bottom)
    return pixels.groupBy("map_id").agg(F.count_if(inside & (difference > least)).alias("n"))


def medians(values: DataFrame, group: str, value: str) -> DataFrame:
    """group, middle, upper: the median, and the upper of the two middle values. Equal values are counted first, so a group's window runs over its distinct values only."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    ranked = counts.select("*", F.sum("n").over(whole.orderBy(value)).alias("upto"), F.sum("n").over(whole).alias("total"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    ends = ranked.groupBy(group).agg(at(F.floor((F.col("total") - 1) / 2)).alias("lower"), at(F.floor(F.col("total") / 2)).alias("upper"))
    return ends.select(group, (0.5 * F.col("lower") + 0.5 * F.col("upper")).alias("middle"), "upper")


def plane(table: pa.Table, width: int, height: int, column: str | None = None) -> np.ndarray:
    out = np.zeros(width * height, dtype=bool if column is None else np.int64)
    out[table["i"].to_numpy()] = True if column is None else table[column].to_numpy()
    return out.reshape(height, width)


def labels(mask: DataFrame, width: int, height: int, same: str | None = None) -> DataFrame:
    """map_id, i, component: the smallest pixel of each 8-connected component; with ``same`` only equal values connect. One map is one group."""
    runtime.ship(mask.sparkSession)
    kind = dict(mask.dtypes)["map_id"]

    def run(table: pa.Table) -> pa.Table:
        ink = plane(table, width, height)
        parts, _ = kernels.label(ink, plane(table, width, height, same) if same else None)
        flat, at = parts.ravel(), np.flatnonzero(ink.ravel())
        own = flat[at]
        first = at[np.unique(own, return_index=True)[1]]
        return pa.table({"map_id": pa.array([table["map_id"][0].as_py()] * len(at), table.schema.field("map_id").type), "i": pa.array(at.astype(np.int32)), "component": pa.array(first[own].astype(np.int32))})

    return mask.select("map_id", "i", *([same] if same else [])).groupBy("map_id").applyInArrow(run, f"map_id {kind}, i int, component int")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """map_id, component, pixels, rank: largest first, then by first pixel."""
    sizes = labelled.groupBy("map_id", "component").agg(F.count(F.lit(1)).alias("pixels"))
    return sizes.select("*", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("pixels"), "component")).alias("rank"))


def bays(code: np.ndarray, progress: float, k: float = 24.0, least: int = 8, share: float = 0.6) -> tuple[int, int, int]:
    """Holes, bays and the largest of them in an order plane: closed pixels amid open ink (5 x 5, at least ``least`` ink and ``share`` of it open), grouped; a group of one is a hole."""
    ink = code != model.HIDDEN
    lit = ink & (k * (min(max(progress, 0), 1) * 255 - code.astype(np.int64)) > 200)
    around = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3)]
    total = sum(kernels.shifted(ink, dx, dy).astype(int) for dx, dy in around)
    bright = sum(kernels.shifted(lit, dx, dy).astype(int) for dx, dy in around)
    odd = ink & ~lit & (total >= least) & (bright >= share * total)
    parts, n = kernels.label(odd)
    size = np.bincount(parts[odd], minlength=n)
    return int((size == 1).sum()), int((size > 1).sum()), int(size.max()) if n else 0


def notches(code: np.ndarray, k: float = 24.0) -> list[tuple[int, int, int, int]]:
    """percent, holes, bays, largest of an order plane at every fifth percent from 5 to 95."""
    return [(p, *bays(code, p / 100, k)) for p in range(5, 100, 5)]


def fnv64(data: bytes, width: int, height: int) -> int:
    """FNV-1a, 64 bits, of a plane and its size: the digest by which order, segment and within planes are told apart."""
    h = 0xCBF29CE484222325
    for byte in width.to_bytes(4, "little") + height.to_bytes(4, "little") + data:
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h
