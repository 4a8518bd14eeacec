"""Kernels that split and order ink: the two strokes of a cross, and handwriting in reading order."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from strokeloom import model
from strokeloom.operators.kernels import half_away, label


@dataclass(frozen=True)
class Axis:
    angle: int
    offset: float
    band: float
    score: int


@dataclass(frozen=True)
class Split:
    backslash: Axis
    slash: Axis
    on_backslash: np.ndarray
    within: np.ndarray
    lengths: tuple[float, float]


def densest_band(projection: np.ndarray, band: int) -> tuple[float, int]:
    """Centre and count of the fullest ``band`` unit bins in a row; the first of several."""
    base = math.floor(projection.min())
    bins = np.bincount(np.floor(projection - base).astype(np.int64))
    if len(bins) <= band:
        return base + len(bins) / 2, len(projection)
    sums = np.convolve(bins, np.ones(band, dtype=np.int64), "valid")
    at = int(sums.argmax())
    return base + at + band / 2, int(sums[at])


def axes(x: np.ndarray, y: np.ndarray, band: int) -> list[Axis]:
    """The best band at every degree, fullest first, then by angle. x and y are centred."""
    out = []
    for angle in range(model.ANGLES):
        turn = math.radians(angle)
        centre, score = densest_band(y * math.cos(turn) - x * math.sin(turn), band)
        out.append(Axis(angle, centre, float(band), score))
    return sorted(out, key=lambda a: (-a.score, a.angle))


def separation(a: int, b: int) -> int:
    d = abs(a - b) % 180
    return min(d, 180 - d)


def split_cross(pixels: np.ndarray, width: int) -> Split | None:
    """The two strokes of a blob of pixel indices, or None if it is no cross."""
    n = len(pixels)
    if n < 8 or width <= 0:
        return None
    x, y = (pixels % width).astype(np.float64), (pixels // width).astype(np.float64)
    extent = np.array([np.ptp(x), np.ptp(y)])
    diagonal = math.hypot(*extent)
    if diagonal <= 0:
        return None
    band = max(3, half_away(n / (model.BAND_DIVISOR * diagonal)))
    low, high = model.BAND_RATIO
    if not low <= band / (extent.max() + 1) <= high:
        return None
    x, y = x - x.sum() / n, y - y.sum() / n
    ranked = axes(x, y, band)
    best = ranked[0]
    other = next((a for a in ranked if separation(a.angle, best.angle) >= model.MIN_SEPARATION), None)
    if other is None or best.score / n < model.MIN_SCORE_RATIO:
        return None
    leaning = [a for a in (best, other) if 0 < a.angle < 90]
    backslash = leaning[0] if leaning else min((best, other), key=lambda a: a.angle)
    slash = other if backslash is best else best
    far = {}
    for axis in (backslash, slash):
        turn = math.radians(axis.angle)
        far[axis] = np.abs(y * math.cos(turn) - x * math.sin(turn) - axis.offset) / axis.band
    on = (far[backslash] <= model.OWN_BAND) | (far[backslash] <= far[slash])
    if on.all() or not on.any():
        return None
    within, lengths = np.zeros(n, dtype=np.float32), []
    for axis, own in ((backslash, on), (slash, ~on)):
        turn = math.radians(axis.angle)
        along = (x * math.cos(turn) + y * math.sin(turn))[own]
        reach = along.max() - along.min()
        within[own] = (along - along.min()) / reach if reach > 0 else 1.0
        lengths.append(float(reach))
    return Split(backslash, slash, on, within, (lengths[0], lengths[1]))


@dataclass
class Blob:
    """Pixels and their inclusive box."""

    pixels: list[int]
    left: int
    top: int
    right: int
    bottom: int

    def absorb(self, other: Blob) -> None:
        self.pixels += other.pixels
        self.left, self.top = min(self.left, other.left), min(self.top, other.top)
        self.right, self.bottom = max(self.right, other.right), max(self.bottom, other.bottom)

    @property
    def height(self) -> int:
        return self.bottom - self.top + 1


@dataclass
class Chunk(Blob):
    line: int = 0
    strokes: list[list[int]] = field(default_factory=list)


def blobs(pixels: np.ndarray, width: int, height: int) -> list[Blob]:
    """Connected blobs in the order of their first pixel."""
    mask = np.zeros(width * height, dtype=bool)
    mask[pixels] = True
    parts, n = label(mask.reshape(height, width))
    flat = parts.ravel()
    out = []
    for k in range(n):
        own = np.flatnonzero(flat == k)
        x, y = own % width, own // width
        out.append(Blob(own.tolist(), int(x.min()), int(y.min()), int(x.max()), int(y.max())))
    return out


def gap(a: Blob, b: Blob) -> float:
    dx = max(0, a.left - b.right, b.left - a.right)
    dy = max(0, a.top - b.bottom, b.top - a.bottom)
    return math.sqrt(dx * dx + dy * dy)


def overlap(a: Blob, b: Blob) -> float:
    return (min(a.bottom, b.bottom) - max(a.top, b.top) + 1) / min(a.height, b.height)


def attach(solid: list[Blob], orphans: list[Blob], reach: float) -> list[Blob]:
    """Give each orphan to its nearest host within reach of the hosts' upper median height; hosts grow as they take. Returns who found none."""
    if not orphans:
        return []
    limit = sorted(b.height for b in solid)[len(solid) // 2] * reach
    left = []
    for orphan in orphans:
        host = min(solid, key=lambda b: gap(orphan, b))  # noqa: B023
        if gap(orphan, host) <= limit:
            host.absorb(orphan)
        else:
            left.append(orphan)
    return left


def lines_of(items: list[Blob], ratio: float) -> list[list[Blob]]:
    """Text lines, top to bottom, each left to right. From the top down, a blob joins the first line with a member it overlaps."""
    lines: list[list[Blob]] = []
    for item in sorted(items, key=lambda b: b.top):
        home = next((line for line in lines if any(overlap(item, other) >= ratio for other in line)), None)
        if home is None:
            lines.append([item])
        else:
            home.append(item)
    lines.sort(key=lambda line: min(b.top for b in line))
    return [sorted(line, key=lambda b: b.left) for line in lines]


def jamo_order(parts: list[Blob], ratio: float) -> list[Blob]:
    """Strokes of a syllable: bands by overlap with the topmost one left, each left to right."""
    rest, out = sorted(parts, key=lambda b: b.top), []
    while rest:
        head = rest[0]
        band = [head] + [b for b in rest[1:] if overlap(head, b) >= ratio]
        rest = [b for b in rest[1:] if overlap(head, b) < ratio]
        out += sorted(band, key=lambda b: b.left)
    return out


def cuts(ink: np.ndarray, count: int) -> list[int]:
    """Columns at which a line of ``count`` syllables is cut: the thinnest near each equal share, the first of several."""
    cell = len(ink) / count
    slack = max(1, half_away(cell * 0.25))
    out = []
    for i in range(1, count):
        want = half_away(cell * i)
        near = [x for x in range(want - slack, want + slack + 1) if 0 < x < len(ink)]
        out.append(min(near, key=lambda x: (ink[x], x)) if near else want)
    return out


def plain_chunks(line: list[Blob], number: int) -> list[Chunk]:
    return [Chunk(b.pixels, b.left, b.top, b.right, b.bottom, number) for b in line]


def syllable_chunks(line: list[Blob], number: int, count: int, width: int, height: int, ratio: float) -> list[Chunk]:
    left, right = min(b.left for b in line), max(b.right for b in line)
    if right - left + 1 < count:
        return plain_chunks(line, number)
    pixels = np.array([p for b in line for p in b.pixels])
    columns = pixels % width - left
    slot = np.searchsorted(np.array(cuts(np.bincount(columns, minlength=right - left + 1), count)), columns, side="right")
    out = []
    for k in range(count):
        if not (slot == k).any():
            continue
        ordered = jamo_order(blobs(pixels[slot == k], width, height), ratio)
        whole = Blob([], 1 << 30, 1 << 30, -1, -1)
        for b in ordered:
            whole.absorb(Blob(list(b.pixels), b.left, b.top, b.right, b.bottom))
        out.append(Chunk(whole.pixels, whole.left, whole.top, whole.right, whole.bottom, number, [b.pixels for b in ordered]))
    return out or plain_chunks(line, number)


def segment_annotation(pixels: np.ndarray, width: int, height: int, settings: model.AnnotationSettings | None = None) -> list[Chunk]:
    """Chunks of handwriting in reading order."""
    s = settings or model.AnnotationSettings()
    found = blobs(pixels, width, height) if len(pixels) else []
    solid = [b for b in found if len(b.pixels) >= s.min_chunk_pixels]
    orphans = [b for b in found if len(b.pixels) < s.min_chunk_pixels]
    if not solid:
        solid, orphans = orphans, []
    solid = solid + attach(solid, orphans, s.orphan_reach)
    out: list[Chunk] = []
    for number, line in enumerate(lines_of(solid, s.line_overlap)):
        if s.syllables is not None and s.syllables > 1 and len(line) > 1:
            out += syllable_chunks(line, number, s.syllables, width, height, s.jamo_overlap)
        else:
            out += plain_chunks(line, number)
    return out


def stroke_progress(chunk: Chunk, width: int) -> np.ndarray | None:
    """Progress of each of a chunk's pixels through its strokes, row by row within each; None without strokes."""
    if not chunk.strokes:
        return None
    out = []
    for rank, stroke in enumerate(chunk.strokes):
        p = np.array(stroke)
        x, y = p % width, p // width
        columns = x.max() - x.min() + 1
        cells = (y.max() - y.min() + 1) * columns
        local = np.ones(len(p)) if cells <= 1 else ((y - y.min()) * columns + x - x.min()) / (cells - 1)
        out.append((rank + local) / len(chunk.strokes))
    return np.concatenate(out).astype(np.float32)
