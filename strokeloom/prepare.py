"""From raster pairs to what a player needs: validated, detected, scaled, timed, compiled and packed."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strokeloom import model, runtime
from strokeloom.plans import detect
from strokeloom.sources import rasters as sources
from strokeloom.timing import schedule


@dataclass(frozen=True)
class Prepared:
    """Tables by map_id: the plan, its windows and stage marks, orders by pixel, and packed order planes. ``log`` is stage by stage milliseconds."""

    plan: DataFrame
    windows: DataFrame
    marks: DataFrame
    orders: DataFrame
    textures: DataFrame
    log: tuple[tuple[str, float], ...]

    def report(self) -> str:
        """The log as one JSON line."""
        return json.dumps({"prepare_ms": dict(self.log), "total_ms": round(sum(ms for _, ms in self.log), 1)})

    def frame(self, pixels: DataFrame, progress: float, sharpness: model.Sharpness | None = None) -> DataFrame:
        return schedule.frame(pixels, self.orders, progress, sharpness)


def prepare(rasters: DataFrame, settings: model.DetectSettings | None = None, policy: schedule.TimingPolicy | None = None, sharpness: model.Sharpness | None = None, factor: float = 1.0) -> Prepared:
    """Everything for playing rasters (map_id, width, height, base, composed). The plan and the orders are written once, so a new policy re-times without detecting.

    ``factor`` scales measures from the size at which maps were baked to that at which they are shown.
    A map without a change has no segments, no windows and a texture that hides all.
    """
    log = []

    def timed(name: str, made: DataFrame) -> DataFrame:
        began = time.perf_counter()
        out = runtime.table(made)
        log.append((name, round(1000 * (time.perf_counter() - began), 1)))
        return out

    plan = timed("detect", detect.plans(rasters, settings))
    segments = detect.scaled_measures(detect.segments_of(plan), factor)
    windows = timed("schedule", (policy or schedule.HandwritingPolicy()).windows(segments))
    orders = timed("compile", schedule.compile_orders(detect.pixels_of(plan), windows, sharpness))
    textures = timed("pack", sources.pack_orders(orders, rasters.select("map_id", "width", "height")))
    return Prepared(plan, windows, schedule.stage_marks(windows, segments), orders, textures, tuple(log))
