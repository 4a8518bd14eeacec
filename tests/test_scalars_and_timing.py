"""Scalar tables and worked schedules, as literals."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strokeloom import model
from strokeloom.functions import scalar
from strokeloom.plans import detect
from strokeloom.timing import schedule

LENGTHS = [(124.5, 0), (177.3, 0.131), (186.4, 0.151), (410.6, 0.517), (674.5, 0.804), (721.6, 0.847), (839.2, 0.947), (859.6, 0.964), (905.7, 1)]
MILLIS = [(0.0, 500), (0.131, 697), (0.151, 727), (0.517, 1276), (0.804, 1706), (0.847, 1771), (0.947, 1921), (0.964, 1946), (1.0, 2000)]


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {schema}").orderBy("n").select(column).collect()]


def test_relative_length(spark):
    got = values(spark, [(a,) for a, _ in LENGTHS] + [(-1.0,), (0.0,), (1e9,), (math.nan,)], "x double", scalar.relative_length(F.col("x")))
    assert [round(v, 3) for v in got[:9]] == [b for _, b in LENGTHS] and got[9:] == [0, 0, 1, 0]
    assert all(abs(detect.relative_length(a, 420) - b) < 6e-4 for a, b in LENGTHS)
    at = values(spark, [(2 * a, 840) for a, _ in LENGTHS] + [(410.6, 0)], "x double, s int", scalar.relative_length_at(F.col("x"), F.col("s")))
    assert [round(v, 3) for v in at] == [b for _, b in LENGTHS] + [0.517]


def test_relative_length_never_falls(spark):
    got = [r[0] for r in spark.range(2001).orderBy("id").select(scalar.relative_length(F.col("id").cast("double"))).collect()]
    assert got == sorted(got)


def test_durations(spark):
    assert values(spark, [(a,) for a, _ in MILLIS], "x double", scalar.primary_millis(F.col("x"))) == [b for _, b in MILLIS]
    assert values(spark, [(1.0,), (24.0,), (31.0,), (500.0,)], "x double", scalar.annotation_millis(F.col("x"))) == [70, 96, 124, 220]
    assert values(spark, [(0.5,)], "x double", scalar.primary_millis(F.col("x"), 2000, 500)) == [1250]
    with pytest.raises(PySparkException, match="relative length"):
        values(spark, [(None,)], "x double", scalar.primary_millis(F.col("x")))


def test_sharpness(spark):
    assert values(spark, [(24.0,), (32.0,), (128.0,), (0.5,)], "k double", scalar.max_order(F.col("k"))) == [244, 247, 253, 1]
    alpha = values(spark, [(0, 0.0), (0, 1.0), (244, 1.0), (255, 1.0), (100, 0.4), (None, 0.4)], "o int, p double", scalar.alpha_at(F.col("o"), F.col("p"), F.lit(24.0)))
    assert alpha[:4] == [0, 255, 255, 0] and abs(alpha[4] - 48) < 1e-9 and alpha[5] is None
    matrix = values(spark, [(0.5,)], "p double", scalar.threshold_matrix(F.lit(24.0), F.col("p")))[0]
    assert matrix == [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, -24, 0, 0, 0, 24 * 0.5 * 255]
    with pytest.raises(ValueError):
        model.Sharpness(0)
    assert model.Sharpness(24) == model.Sharpness() and model.TimingSettings() == model.TimingSettings()


@pytest.mark.parametrize("edge", [0.0, 0.12, 0.4])
def test_pen_ease_inverts_the_way_gone(spark, edge):
    def gone(t):
        top = 1 / (1 - edge)
        if edge and t < edge:
            return top * t * t / (2 * edge)
        if edge and t > 1 - edge:
            return 1 - top * (1 - t) ** 2 / (2 * edge)
        return top * (t - edge / 2)

    times = [i / 50 for i in range(51)]
    got = values(spark, [(gone(t),) for t in times], "d double", scalar.pen_time(F.col("d"), edge))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, times))


def test_rounding_and_small_rules(spark):
    assert values(spark, [(0.5,), (2.5,), (-0.5,), (0.49999999999999994,)], "x double", F.round("x")) == [1, 3, -1, 0]
    assert values(spark, [(None, 10.0), (-0.0, 0.0), (5.0, 10.0), (11.0, 10.0)], "f double, m double", scalar.order_code(F.col("f"), F.col("m"))) == [254, 0, 127, 254]
    assert values(spark, [(5, 5, 5), (5, 0, 10), (0, 0, 10)], "x int, l int, r int", scalar.progress_within(F.col("x"), F.col("l"), F.col("r"))) == [65535, 32768, 0]
    w, h = scalar.fit_long_side(F.col("w"), F.col("h"), F.lit(420))
    assert values(spark, [(840, 400), (400, 840), (5000, 1), (7, 7)], "w int, h int", F.struct(w, h)) == [(420, 200), (200, 420), (420, 1), (420, 420)]
    assert values(spark, [(0, 179), (10, 100), (170, 20)], "a int, b int", scalar.angular_separation(F.col("a"), F.col("b"))) == [1, 90, 30]
    assert values(spark, [([97],), ([],)], "a array<int>", scalar.fnv32(F.col("a"))) == [0xE40C292C, 0x811C9DC5]
    assert values(spark, [([3, 1, 2, 4],), ([5],)], "a array<int>", scalar.upper_median(F.col("a"))) == [3, 5]
    assert values(spark, [(0.0,), (0.2,), (0.5,), (0.9,)], "p double", scalar.stage_at(F.col("p"), F.lit(0.353), F.lit(0.661))) == ["start", "road", "cross", "end"]


SEGMENTS = "map_id string, id int, kind string, measure double, relative_length double"


def plan(name, widths, first="primaryStroke"):
    kinds = [(first, 0.0, 0.131), ("crossBackslash", 0.0, None), ("crossSlash", 0.0, None)] + [("annotation", float(w), None) for w in widths]
    return [(name, i, k, m, r if k == "primaryStroke" else None) for i, (k, m, r) in enumerate(kinds)]


def test_worked_schedule(spark):
    segments = spark.createDataFrame(plan("a", [31, 23, 27, 24]) + plan("b", [31, 51, 20, 19, 20, 14]), SEGMENTS).repartition(3)
    assert {r.map_id: r.total_ms for r in schedule.totals(segments).collect()} == {"a": 1977, "b": 2251}
    rows = schedule.HandwritingPolicy().windows(segments).filter("map_id = 'a'").orderBy("segment_id").collect()
    want = [(0.000, 0.353), (0.413, 0.525), (0.550, 0.661), (0.742, 0.805), (0.820, 0.866), (0.882, 0.936), (0.951, 1.000)]
    assert all(abs(r.start - a) < 6e-4 and abs(r.end - b) < 6e-4 for r, (a, b) in zip(rows, want)) and [r.edge for r in rows] == [0.12] * 3 + [None] * 4
    marks = schedule.stage_marks(schedule.HandwritingPolicy().windows(segments), segments).filter("map_id = 'a'").first()
    assert [round(x, 3) for x in marks[1:4]] == [0.353, 0.661, 1.0] and marks.has_cross and marks.has_annotation


def test_schedules_at_the_edges(spark):
    rows = [("only", 0, "annotation", 31.0, None), ("late", 0, "annotation", 31.0, None), ("late", 1, "primaryStroke", 0.0, 0.0)]
    windows = {(r.map_id, r.segment_id): (r.start, r.end) for r in schedule.HandwritingPolicy().windows(spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert windows == {("only", 0): (0, 1), ("late", 0): (0, 124 / 624), ("late", 1): (124 / 624, 1)}
    assert schedule.HandwritingPolicy().windows(spark.createDataFrame([], SEGMENTS)).count() == 0
    zero = schedule.HandwritingPolicy(model.TimingSettings(annotation_from=0, annotation_to=0))
    assert zero.windows(spark.createDataFrame(rows[:1], SEGMENTS)).count() == 0
    assert zero == schedule.HandwritingPolicy(model.TimingSettings(annotation_from=0, annotation_to=0)) != schedule.HandwritingPolicy()


def test_compile_hides_what_has_no_window(spark):
    windows = spark.createDataFrame([("m", 0, 0.0, 0.5, None), ("m", 300, 0.0, 1.0, None)], "map_id string, segment_id int, start double, end double, edge double")
    pixels = spark.createDataFrame([("m", 0, 1, 0), ("m", 0, 2, 65535), ("m", 7, 3, 0), ("m", 300, 4, 0), ("n", 0, 5, 0)], "map_id string, segment_id int, i int, within int")
    assert {r.i: r.ord for r in schedule.compile_orders(pixels, windows).collect()} == {1: 0, 2: 122, 3: 255, 4: 255, 5: 255}


def test_frame_strip(spark):
    pixels = spark.createDataFrame([("s", i, i, 0, 0, 0, 255, 255, 255, 0, 0, 255) for i in range(4)], "map_id string, i int, x int, y int, br int, bg int, bb int, ba int, cr int, cg int, cb int, ca int")
    orders = spark.createDataFrame([("s", 0, 0), ("s", 1, 100), ("s", 2, 200)], "map_id string, i int, ord int")
    for progress, reds in ((0.0, 0), (0.5, 2), (1.0, 3)):
        got = [(r.r, r.b) for r in schedule.frame(pixels, orders, progress).orderBy("i").collect()]
        assert got == [(255, 0)] * reds + [(0, 255)] * (4 - reds)
