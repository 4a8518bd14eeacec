"""Constants and settings of reveal plans. Values here fix the results and are stated as such."""

from __future__ import annotations

from dataclasses import dataclass, field

# Codes of the order raster and of plans.
HIDDEN = 255
MAX_SEGMENT_ID = 254
WITHIN_SCALE = 65535
INK_ALPHA = 128
ROI_PAD = 4

# Neighbour offsets (dx, dy), north-west first, then clockwise.
NEIGHBOURS = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))

# Stroke length profile.
REFERENCE_SIDE = 420
LENGTH_EXPONENT = 0.35
SHORTEST, LONGEST = 124.5, 905.7

# Cross strokes.
ANGLES = 180
MIN_SEPARATION = 25
BAND_DIVISOR = 1.5
BAND_RATIO = (0.1296, 0.3319)
MIN_SCORE_RATIO = 0.3509
OWN_BAND = 0.5

KINDS = ("primaryStroke", "crossBackslash", "crossSlash", "annotation")


@dataclass(frozen=True)
class AnnotationSettings:
    min_chunk_pixels: int = 24
    orphan_reach: float = 0.8
    line_overlap: float = 0.34
    jamo_overlap: float = 0.5
    syllables: int | None = None


@dataclass(frozen=True)
class DetectSettings:
    min_change: int = 18
    min_alpha: int = 200
    accent_excess: int = 35
    stray_pixels: int = 12
    min_blob_share: float = 6.9e-5
    max_road_distance: float = 0.05
    min_distance_ratio: float = 1.6
    min_area_share: float = 0.0050
    max_area_share: float = 0.0105
    annotation: AnnotationSettings = field(default_factory=AnnotationSettings)


@dataclass(frozen=True)
class TimingSettings:
    """Milliseconds, pixels and eases of the handwriting policy. Equal settings compare equal, so an unchanged plan need not be timed anew."""

    primary_from: int = 500
    primary_to: int = 2000
    primary_to_cross_gap: int = 120
    cross_duration: int = 220
    cross_gap: int = 50
    cross_to_annotation_gap: int = 160
    per_pixel: float = 4.0
    annotation_from: int = 70
    annotation_to: int = 220
    annotation_gap: int = 30
    pen_edge: float = 0.12


@dataclass(frozen=True)
class Sharpness:
    """The slope k of the threshold, which also bounds the order codes that can become opaque."""

    k: float = 24.0

    def __post_init__(self) -> None:
        if not self.k > 0:
            raise ValueError("k must be above 0")
