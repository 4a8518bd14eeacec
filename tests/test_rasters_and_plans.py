"""Kernels against fixtures with known answers, kernels against relational steps, whole plans, sources and sinks."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strokeloom import model, prepare
from strokeloom.operators import cross, kernels, metrics, stencil, strokes
from strokeloom.plans import detect
from strokeloom.sources import rasters, synthetic
from strokeloom.timing import schedule


def canvas(h, w, *boxes):
    """Boxes: left, top, right, bottom, inclusive."""
    out = np.zeros((h, w), dtype=bool)
    for left, top, right, bottom in boxes:
        out[top : bottom + 1, left : right + 1] = True
    return out


def alpha(mask):
    return np.where(mask, 255, 0)


@pytest.mark.parametrize(
    "boxes,length",
    [([(100, 40, 106, 339)], 300), ([(60, 40, 259, 46), (253, 40, 259, 239)], 400), ([(60, 40, 66, 239), (60, 233, 199, 239), (193, 40, 199, 239)], 540)],
)
def test_length_of_bars(boxes, length):
    mask = canvas(400, 400, *boxes)
    order, measured = kernels.bake(alpha(mask))
    assert abs(measured - length) <= 0.15 * length
    assert (order[~mask] == 255).all() and order[mask].max() <= 254 and order[mask].min() == 0


def test_longer_bars_measure_longer():
    lengths = [kernels.bake(alpha(canvas(400, 400, (100, 30, 106, 29 + h))))[1] for h in (60, 120, 200, 300)]
    assert lengths == sorted(set(lengths))


def test_four_pixels_that_break_a_region_without_margin():
    mask = np.zeros((20, 20), dtype=bool)
    points = [(3, 3), (6, 3), (3, 5), (5, 5)]
    for x, y in points:
        mask[y, x] = True
    order, _ = kernels.bake(alpha(mask))
    assert [int(order[y, x]) for x, y in points] == [0, 254, 0, 0]


@pytest.mark.parametrize("mask", [canvas(24, 24, (0, 0, 23, 0), (0, 23, 23, 23), (0, 0, 0, 23), (23, 0, 23, 23)), canvas(24, 24, (0, 0, 0, 0)), canvas(24, 24, (2, 0, 19, 0)), canvas(24, 24, (0, 0, 23, 23))])
def test_ink_on_borders_is_always_ordered(mask):
    order, _ = kernels.bake(alpha(mask))
    assert (order[mask] <= 254).all() and (order[~mask] == 255).all()


def test_no_ink():
    order, length = kernels.bake(np.zeros((20, 20)))
    assert (order == 255).all() and length == 0


def brush(size, radius, points):
    """A disc of whole offsets moved along a line in half steps, each pixel rounded."""
    out = np.zeros((size, size), dtype=bool)
    disc = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius**2]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        n = 2 * max(abs(x1 - x0), abs(y1 - y0))
        for k in range(n + 1):
            x, y = x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n
            for dx, dy in disc:
                out[kernels.half_away(y + dy), kernels.half_away(x + dx)] = True
    return out


@pytest.mark.parametrize("radius,points,worst", [(6, [(30, 15), (30, 75), (34, 90), (48, 90), (52, 75), (52, 15)], 5), (7, [(20, 20), (95, 30), (25, 55), (95, 75), (25, 100)], 10), (11, [(20, 60), (100, 60)], 4)])
def test_orders_are_smooth(radius, points, worst):
    mask = brush(120, radius, points)
    order, _ = kernels.bake(alpha(mask))
    code = order.astype(int)
    for axis in (0, 1):
        both = mask & np.roll(mask, -1, axis) & (code < 254) & (np.roll(code, -1, axis) < 254)
        steps = np.abs(np.roll(code, -1, axis) - code)[both]
        assert steps.max() <= worst
    assert code[mask].min() == 0


def masks(spark, seed=3, n=12, side=16):
    rng = np.random.default_rng(seed)
    planes = {m: kernels.dilate(rng.random((side, side)) > 0.9) | (rng.random((side, side)) > 0.8) for m in range(n)}
    rows = [(m, int(i), int(i % side), int(i // side)) for m, p in planes.items() for i in np.flatnonzero(p.ravel())]
    return planes, spark.createDataFrame(rows, "map_id int, i int, x int, y int")


def as_planes(df, side, names):
    out = {m: np.zeros(side * side, dtype=bool) for m in names}
    for r in df.select("map_id", "i").collect():
        out[r.map_id][r.i] = True
    return {m: p.reshape(side, side) for m, p in out.items()}


def test_relational_steps_equal_kernels(spark):
    planes, df = masks(spark)
    for step, kernel in ((stencil.dilate, kernels.dilate), (stencil.erode, kernels.erode), (stencil.close_open, kernels.close_open)):
        got = as_planes(step(df, 16, 16), 16, planes)
        assert all((got[m] == kernel(p)).all() for m, p in planes.items())
    thinner = df
    while True:
        nxt = stencil.thin_substep(stencil.thin_substep(thinner, 16, 16), 16, 16, second=True).cache()
        if nxt.count() == thinner.count():
            break
        thinner = nxt
    got = as_planes(nxt, 16, planes)
    assert all((got[m] == kernels.thin(p)).all() for m, p in planes.items())


def test_smoothing_pass_equals_kernel(spark):
    rng = np.random.default_rng(1)
    field = np.where(rng.random((12, 12)) > 0.4, rng.random((12, 12)), -1).astype(np.float32)
    rows = [(1, int(i), int(i % 12), int(i // 12), float(field.ravel()[i])) for i in np.flatnonzero(field.ravel() >= 0)] + [(1, 0, 0, 0, None)] * 0
    got = np.full(144, -1, dtype=np.float32)
    for r in stencil.smooth_pass(spark.createDataFrame(rows, "map_id int, i int, x int, y int, t float"), 12, 12).collect():
        got[r.i] = r.t
    assert np.allclose(got.reshape(12, 12), kernels.smooth(field, 1), atol=1e-6)


def test_labels_by_kernel_have_the_right_parts(spark):
    planes, df = masks(spark, seed=8)
    for r in metrics.labels(df, 16, 16).groupBy("map_id").agg(F.count_distinct("component").alias("n")).collect():
        assert r.n == kernels.label(planes[r.map_id])[1]


def test_boundary_distance_is_the_chamfer_distance():
    rng = np.random.default_rng(2)
    mask = rng.random((14, 17)) > 0.15
    d = np.where(np.pad(mask, 1), 1e9, 0.0)
    for _ in range(40):
        best = d.copy()
        for dx, dy in model.NEIGHBOURS:
            best = np.minimum(best, kernels.shifted(d, dx, dy, 1e9) + (1 if dx == 0 or dy == 0 else 2**0.5))
        d = np.where(np.pad(mask, 1), best, 0.0)
    assert np.allclose(kernels.boundary_distance(mask), d[1:-1, 1:-1], atol=1e-4)


def test_prune_keeps_the_stroke_and_drops_the_spur():
    skeleton = canvas(40, 40, (5, 20, 34, 20), (20, 16, 20, 19))
    net = kernels.graph_of(skeleton)
    pruned = set(kernels.prune(net, 6).pixels.tolist())
    assert not any(p // 40 < 19 for p in pruned) and {p for p in net.pixels.tolist() if p // 40 == 20} <= pruned | {20 * 40 + 20}
    assert kernels.prune(kernels.graph_of(canvas(9, 9, (1, 1, 5, 1))), 10) == kernels.graph_of(canvas(9, 9, (1, 1, 5, 1)))


def test_traversal_clock():
    graph = kernels.graph_of(canvas(10, 10, (2, 2, 5, 2), (1, 7, 8, 7), (0, 9, 0, 9)))
    times = kernels.traverse(graph, 10)
    assert times[22] == 0 and times[25] == 3 and times[71] == 3 and times[78] == 10 and times[90] == 10


def bars(angles, thickness=14, size=120, reach=0.36):
    yy, xx = np.mgrid[:size, :size].astype(float)
    u, v, out = xx - size / 2, yy - size / 2, np.zeros((size, size), dtype=bool)
    for a in np.radians(angles):
        out |= (np.abs(u * np.cos(a) + v * np.sin(a)) <= reach * size) & (np.abs(v * np.cos(a) - u * np.sin(a)) <= thickness / 2)
    return np.flatnonzero(out.ravel())


@pytest.mark.parametrize("turn", [-30, -15, 0, 10, 25])
@pytest.mark.parametrize("thickness", [14, 18, 22])
def test_cross_angles(turn, thickness):
    found = strokes.split_cross(bars([45 + turn, 135 + turn], thickness), 120)
    assert abs(found.backslash.angle - (45 + turn)) <= 3 and abs(found.slash.angle - (135 + turn)) <= 3
    assert 0 < found.on_backslash.sum() < len(found.on_backslash) and found.within.min() >= 0 and found.within.max() <= 1


def test_no_cross():
    assert strokes.split_cross(np.array([1, 2, 3]), 10) is None
    assert strokes.split_cross(bars([45], 14), 120) is None or strokes.split_cross(bars([45], 14), 120).slash.score > 0
    assert strokes.split_cross(np.flatnonzero(np.ones(400, dtype=bool)), 400) is None


def test_axis_sweep_equals_the_kernel(spark):
    pixels = bars([30, 120], 8, size=40)
    df = spark.createDataFrame([(1, int(p), int(p % 40), int(p // 40)) for p in pixels], "map_id int, i int, x int, y int")
    x, y = pixels % 40 - (pixels % 40).mean(), pixels // 40 - (pixels // 40).mean()
    want = {a.angle: a for a in strokes.axes(x, y, 8)}
    got = {r.angle: r for r in cross.axis_sweep(df, 8).collect()}
    close = [abs(got[a].score - want[a].score) <= 2 for a in range(180)]
    assert sum(got[a].score == want[a].score and got[a].normal_offset == want[a].offset for a in range(180)) > 170 and all(close)


def pixels_of(boxes, width):
    return np.array(sorted(y * width + x for a, b, c, d in boxes for y in range(b, d + 1) for x in range(a, c + 1)))


def test_reading_order():
    one = strokes.segment_annotation(pixels_of([(100, 10, 118, 30), (10, 10, 28, 30), (55, 10, 73, 30)], 200), 200, 60)
    assert [c.left for c in one] == [10, 55, 100] and {c.line for c in one} == {0}
    two = strokes.segment_annotation(pixels_of([(60, 60, 78, 80), (60, 10, 78, 30), (10, 60, 28, 80), (10, 10, 28, 30)], 200), 200, 120)
    assert [(c.line, c.left) for c in two] == [(0, 10), (0, 60), (1, 10), (1, 60)]
    assert strokes.segment_annotation(np.array([], dtype=int), 10, 10) == []


def test_syllables():
    boxes = [(4, 4, 9, 16), (13, 4, 17, 16), (4, 20, 17, 30), (18, 8, 31, 10), (32, 4, 46, 30)]
    pixels = pixels_of(boxes, 60)
    plain = strokes.segment_annotation(pixels, 60, 40)
    assert len(plain) == 3 and not any(c.strokes for c in plain)
    hinted = strokes.segment_annotation(pixels, 60, 40, model.AnnotationSettings(syllables=2))
    assert len(hinted) == 2 and sorted(p for c in hinted for p in c.pixels) == pixels.tolist() and all(c.strokes for c in hinted)
    progress = strokes.stroke_progress(hinted[0], 60)
    assert len(progress) == len(hinted[0].pixels) and 0 <= progress.min() and progress.max() <= 1


def test_orphans_join_their_nearest_host():
    pixels = pixels_of([(10, 10, 30, 30), (33, 12, 34, 13), (90, 90, 91, 91)], 120)
    chunks = strokes.segment_annotation(pixels, 120, 120)
    assert [(c.left, c.right) for c in chunks] == [(10, 34), (90, 91)]


def test_scene_plan(spark):
    plan = detect.plans(synthetic.scenes(spark)).cache()
    by_map = {}
    for r in detect.segments_of(plan).orderBy("map_id", "id").collect():
        by_map.setdefault(r.map_id, []).append(r)
    assert [r.kind for r in by_map["scene"]] == ["primaryStroke", "crossBackslash", "crossSlash"] + ["annotation"] * 3
    assert [r.left_x for r in by_map["scene"][3:]] == [12, 32, 52] and [r.id for r in by_map["scene"]] == list(range(6))
    for name in ("half_cross", "no_cross", "far_cross"):
        assert [r.kind for r in by_map[name]][0] == "primaryStroke" and "crossSlash" not in [r.kind for r in by_map[name]]
    assert all(r.kind == "annotation" for r in by_map["no_road"])
    assert by_map["scene"][0].relative_length is not None and by_map["scene"][3].measure == 12
    ink = detect.classify(synthetic.scene_pixels(spark))
    missing = detect.uncovered(ink, detect.pixels_of(plan).filter("map_id = 'scene'"))
    assert missing.count() == 0
    orders = schedule.compile_orders(detect.pixels_of(plan), schedule.HandwritingPolicy().windows(detect.segments_of(plan)))
    assert orders.filter("ord > 244").count() == 0
    assert metrics.coverage(ink, orders).collect() == [("scene", 0, 0)]


def test_scene_pixels_equal_scene_bytes(spark):
    pixels = rasters.explode_pixels(synthetic.scenes(spark).filter("map_id = 'scene'"))
    assert pixels.exceptAll(synthetic.scene_pixels(spark)).count() == 0 and pixels.count() == 8100


def test_stray_ink():
    road, accent = canvas(30, 30, (10, 2, 10, 20), (12, 24, 12, 25), (3, 24, 3, 24)), canvas(30, 30, (13, 24, 20, 28))
    left, taken = detect.absorb(road, accent, 12)
    assert not left[24, 12] and taken[24, 12] and left[24, 3] and left[5, 10]
    assert (detect.absorb(road, accent, 0)[0] == road).all()


def test_more_chunks_than_ids():
    base = np.full((64, 64, 4), 255, dtype=np.uint8)
    composed = base.copy()
    composed[::4, ::4, 1:3] = 0
    plan = detect.detect(64, 64, base.tobytes(), composed.tobytes(), model.DetectSettings(annotation=model.AnnotationSettings(min_chunk_pixels=1)))
    assert len(plan.segments) == 255 and sum(s[2] for s in plan.segments) == 256


def test_isolated_holes_and_bays(spark):
    code = np.zeros((9, 9), dtype=int)
    code[4, 4] = 200
    rows = [("m", int(i), int(i % 9), int(i // 9), int(c)) for i, c in enumerate(code.ravel())]
    df = spark.createDataFrame(rows, "map_id string, i int, x int, y int, ord int")
    assert stencil.isolated_holes(df, 9, 9, 0.5).collect() == [("m", 1)]
    assert metrics.bays(code, 0.5) == (1, 0, 1) and (50, 1, 0, 1) in metrics.notches(code)
    assert stencil.edge_jumps(df, 9, 9).collect() == [("m", 4, 200)]


def test_pair_files(spark, tmp_path):
    planes = bytes(range(32)), bytes(range(32, 64))
    (tmp_path / "one.bin").write_bytes(rasters.pack_pair(4, 2, *planes))
    (tmp_path / "two.bin").write_bytes(rasters.pack_pair(2, 4, *planes, magic=False))
    got = {r.map_id: (r.width, r.height, bytes(r.base), bytes(r.composed)) for r in rasters.read_pairs(spark, str(tmp_path)).collect()}
    assert got == {"one": (4, 2, *planes), "two": (2, 4, *planes)}
    for bad in (b"", b"PRRGBA1\n", rasters.pack_pair(4, 2, *planes)[:-1]):
        with pytest.raises(ValueError):
            rasters.parse_pair(bad)


def test_wrong_planes_are_refused(spark):
    rows = spark.createDataFrame([("m", 2, 2, bytearray(16), bytearray(15))], rasters.RASTERS)
    with pytest.raises(PySparkException, match="wrong size"):
        rasters.explode_pixels(rows).count()


def test_run_lengths_fixtures_and_discovery(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"fixtures": [{"name": "a", "width": 4, "runs": [0, 2, 3, 1]}, {"name": "b", "width": 4, "runs": [3, 0, 1, 2]}]}')
    fixtures = rasters.read_fixtures(spark, str(tmp_path / "f.json"))
    assert sorted(map(tuple, rasters.run_length_pixels(fixtures).collect())) == [("a", 0), ("a", 1), ("a", 5), ("b", 4), ("b", 5)]
    keys = spark.createDataFrame([("x_base",), ("x_composed",), ("y_base",), ("z",)], "key string")
    assert [r.map_id for r in rasters.complete_pairs(keys).collect()] == ["x"]


def test_run_lengths_of_masks_with_one_name(spark):
    rows = spark.createDataFrame([("a", [1, 2]), ("a", [0, 1, 3, 1]), ("b", []), (None, [0, 1])], "name string, runs array<int>")
    assert sorted(map(tuple, rasters.run_length_pixels(rows).filter("name is not null").collect())) == [("a", 0), ("a", 1), ("a", 2), ("a", 4)]
    assert rasters.run_length_pixels(rows).count() == 5


@pytest.mark.parametrize("shape", sorted(synthetic.ROADS))
def test_prepared_road_maps(spark, shape):
    rows = [(f"w{w}", 210, 210, *map(bytearray, synthetic.road_map(shape, w, side=210))) for w in (6, 9)] + [("same", 2, 2, bytearray(16), bytearray(16))]
    maps = spark.createDataFrame(rows, rasters.RASTERS)
    made = prepare.prepare(maps)
    kinds = {m: [r.kind for r in detect.segments_of(made.plan).filter(F.col("map_id") == m).orderBy("id").collect()] for m in ("w6", "w9", "same")}
    assert kinds["w6"][0] == kinds["w9"][0] == "primaryStroke" and kinds["w9"].count("annotation") >= 3 and not kinds["same"]
    assert [r.map_id for r in detect.empty_maps(maps, made.plan).collect()] == ["same"]
    textures = {r.map_id: bytes(r.rgba) for r in made.textures.collect()}
    assert textures["same"] == bytes([255] * 16) and len(textures["w6"]) == 210 * 210 * 4
    assert [s for s, _ in made.log] == ["detect", "schedule", "compile", "pack"] and "total_ms" in made.report()
    ends = {r.map_id: r.ends for r in schedule.in_order(made.marks).collect()}
    assert set(ends) == {"w6", "w9"} and all(e == sorted(e) and e[-1] == 1 for e in ends.values())


def test_packed_orders_png_and_digests(spark):
    orders = spark.createDataFrame([(1, 0, 7), (1, 3, 9)], "map_id long, i int, ord int")
    sizes = spark.createDataFrame([(1, 2, 2), (2, 1, 1)], "map_id long, width int, height int")
    got = {r.map_id: bytes(r.rgba) for r in rasters.pack_orders(orders, sizes).collect()}
    assert got == {1: bytes([7, 7, 7, 255, 255, 255, 255, 255, 255, 255, 255, 255, 9, 9, 9, 255]), 2: bytes([255] * 4)}
    image = rasters.png(2, 2, bytes([1, 2, 3, 4]))
    assert image.startswith(b"\x89PNG") and struct.unpack(">II", image[16:24]) == (2, 2)
    at = image.index(b"IDAT")
    assert zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]]) == bytes([0, 1, 2, 0, 3, 4])
    assert metrics.fnv64(b"", 1, 2) != metrics.fnv64(b"", 2, 1)
