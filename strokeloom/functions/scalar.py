"""Scalar rules as column expressions. Rounding is half away from zero, which is what F.round does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strokeloom import model


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def compressed(length: Column) -> Column:
    return F.when(length <= 0, F.lit(0.0)).otherwise(F.pow(length, F.lit(model.LENGTH_EXPONENT)))


def relative_length(length: Column, shortest: float = model.SHORTEST, longest: float = model.LONGEST) -> Column:
    """0 for the shortest and 1 for the longest stroke of the profile; 0 for NaN and for an empty profile."""
    low, high = compressed(F.lit(shortest)), compressed(F.lit(longest))
    share = (compressed(length) - low) / F.nullif(high - low, F.lit(0.0))
    return F.when((high - low <= 0) | F.isnan(length), F.lit(0.0)).otherwise(clamp(share, 0.0, 1.0))


def relative_length_at(length: Column, long_side: Column) -> Column:
    """The same for a length measured at another long side."""
    scaled = F.when((long_side <= 0) | (long_side == model.REFERENCE_SIDE), length).otherwise(length * F.lit(float(model.REFERENCE_SIDE)) / long_side)
    return relative_length(scaled)


def linear_time(distance: Column) -> Column:
    return clamp(distance, 0.0, 1.0)


def pen_time(distance: Column, edge: float = 0.12) -> Column:
    """When a pen that speeds up over ``edge`` of its time and slows down over as much has gone ``distance``."""
    d = clamp(distance, 0.0, 1.0)
    if edge <= 0:
        return d
    top_speed = 1 / (1 - edge)
    half_ramp = top_speed * edge / 2  # way gone while speeding up
    ramp = lambda way: F.sqrt(2 * edge / top_speed * way)
    return F.when(d <= half_ramp, ramp(d)).when(d >= 1 - half_ramp, 1 - ramp(1 - d)).otherwise(d / top_speed + edge / 2)


def max_order(k: Column) -> Column:
    return F.greatest(F.lit(1), 255 - F.ceil(255 / k)).cast("int")


def edge_codes(k: Column) -> Column:
    return 255 / k


def alpha_at(order: Column, progress: Column, k: Column) -> Column:
    return F.when(order >= model.HIDDEN, F.lit(0.0)).otherwise(clamp(k * (clamp(progress, 0.0, 1.0) * 255 - order), 0.0, 255.0))


def threshold_matrix(k: Column, progress: Column) -> Column:
    """The 4 x 5 colour matrix of the threshold, row by row: colours as they are, alpha from red."""
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [zero] * 15
    for colour in range(3):
        rows[6 * colour] = one
    return F.array(*rows, -k, zero, zero, zero, k * clamp(progress, 0.0, 1.0) * 255)


def angular_separation(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 180
    return F.least(d, 180 - d)


def normal_distance(x: Column, y: Column, angle: Column, offset: Column, band: Column) -> Column:
    turn = F.radians(angle.cast("double"))
    return F.abs(y * F.cos(turn) - x * F.sin(turn) - offset) / band


def along(x: Column, y: Column, angle: Column) -> Column:
    turn = F.radians(angle.cast("double"))
    return x * F.cos(turn) + y * F.sin(turn)


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Euclidean gap of two boxes, each a dict of left, top, right, bottom; 0 if they meet."""
    apart = lambda lo, hi: F.greatest(F.lit(0), a[lo] - b[hi], b[lo] - a[hi]).cast("double")
    dx, dy = apart("left", "right"), apart("top", "bottom")
    return F.sqrt(dx * dx + dy * dy)


def overlap_ratio(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    shared = F.least(bottom_a, bottom_b) - F.greatest(top_a, top_b) + 1
    return shared / F.least(bottom_a - top_a + 1, bottom_b - top_b + 1)


def primary_millis(relative: Column, low: int = 500, high: int = 2000) -> Column:
    """Duration of the main stroke. A missing relative length is an error."""
    a, b = min(low, high), max(low, high)
    known = F.coalesce(relative, F.raise_error(F.lit("a primary stroke needs its relative length")).cast("double"))
    return F.round(a + (b - a) * clamp(known, 0.0, 1.0)).cast("long")


def annotation_millis(width: Column, per_pixel: float = 4.0, low: int = 70, high: int = 220) -> Column:
    a, b = min(low, high), max(low, high)
    return F.round(clamp(width * per_pixel, float(a), float(b))).cast("long")


def fit_long_side(width: Column, height: Column, side: Column) -> tuple[Column, Column]:
    """Width and height with the longer one at ``side``; never below 1."""
    wide = width >= height
    fitted = lambda long, short: F.greatest(F.lit(1), F.round(short * side / long)).cast("int")
    return F.when(wide, side.cast("int")).otherwise(fitted(height, width)), F.when(wide, fitted(width, height)).otherwise(side.cast("int"))


def order_code(field: Column, longest: Column) -> Column:
    """0..254 from a time field; a pixel that was not reached (null) is drawn last."""
    code = F.round(field / F.when(longest > 0, longest).otherwise(F.lit(1.0)) * 254)
    return F.when(field.isNull(), F.lit(254)).otherwise(clamp(code, 0, 254)).cast("int")


def road_within(order: Column) -> Column:
    return F.round(order * model.WITHIN_SCALE / 254).cast("int")


def progress_within(x: Column, left: Column, right: Column) -> Column:
    """Left to right progress in a box, as a within code; a box one pixel wide is done at once."""
    share = F.when(right - left <= 0, F.lit(1.0)).otherwise((x - left) / F.nullif(right - left, F.lit(0)))
    return F.round(clamp(share, 0.0, 1.0) * model.WITHIN_SCALE).cast("int")


def order_of(start: Column, end: Column, eased: Column, top: Column) -> Column:
    """The order code of a pixel in a window of time, at most ``top``."""
    return F.least(F.round(clamp(start + (end - start) * eased, 0.0, 1.0) * top), top).cast("int")


def composite(base: Column, composed: Column, alpha: Column) -> Column:
    return F.round(base + (composed - base) * alpha / 255).cast("int")


def stage_at(progress: Column, primary_end: Column, cross_end: Column) -> Column:
    return F.when(progress <= 0, "start").when(progress < primary_end, "road").when(progress < cross_end, "cross").otherwise("end")


def play_micros(total_us: Column, now: Column, target: Column, speed: Column) -> Column:
    return F.round(total_us * F.abs(target - now) / speed).cast("long")


def fnv32(values: Column) -> Column:
    """FNV-1a over an array of byte values, 32 bits."""
    return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b.cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def upper_median(values: Column) -> Column:
    ordered = F.sort_array(values)
    return F.element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)
