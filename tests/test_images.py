"""Whole images: kernels, colour, detectors, seams, blending, files, previews and scenes, against plain versions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import kernels as k
from lattica.operators import enhance, features, graph, layout, matching, pairs, preview, quality, seams, semantic, stitch
from lattica.plans import jobs
from lattica.sources import images as sources
from lattica.sources import sinks


def colour(spark, *arrays):
    rows = [(i, a.shape[0], a.shape[1], a.shape[2], bytearray(a.astype(np.uint8).tobytes()), f"p{i}") for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id long, height int, width int, n_channels int, data binary, path string")


def gray(spark, *arrays):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], a.ravel().astype(float).tolist()) for i, a in enumerate(arrays)], "image_id long, height int, width int, px array<double>")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).integers(0, 256, (60, 80, 3)).astype(np.uint8)


def test_lab_round_trip(noise):
    assert np.abs(k.from_lab(k.lab(noise)) - noise).max() < 0.01
    grays = np.repeat(np.arange(256)[:, None, None], 3, axis=2)
    assert np.abs(k.lab(grays)[..., 1:] - 128).max() < 0.1 and k.lab(grays)[255, 0, 0] == pytest.approx(255, abs=0.1)


def test_area_means_and_distances():
    assert k.area_resized(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert k.bounded(np.zeros((10, 40)), 20).shape == (5, 20) and k.bounded(np.zeros((10, 40)), 50).shape == (10, 40)
    mask = np.zeros((7, 7), bool)
    mask[1:6, 1:6] = True
    assert k.distance_inside(mask)[3, 3] == 3 and k.distance_inside(mask)[1, 1] == 1
    assert k.greatest_near(mask.astype(float), 1)[0, 0] == 1


def test_quality_of_several_sizes(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, s) for s in ((8, 8), (5, 9), (1, 6), (8, 8))]
    d = gray(spark, *images).unionByName(spark.createDataFrame([(9, 0, 0, [])], "image_id long, height int, width int, px array<double>"))
    got = {r["image_id"]: r["quality"] for r in quality.assess(d).collect()}
    assert got[9] == 0
    for i, m in enumerate(images):
        lap, high = (k.correlate(m.astype(float), c) for c in (k.LAPLACE, k.HIGH_PASS))
        gx, gy = k.sobel(m.astype(float))
        clip = lambda v: min(1.0, max(0.0, v))
        want = 0.4 * clip(lap.var() / 1000) + 0.3 * clip(np.hypot(gx, gy).mean() / 100) + 0.2 * clip(m.std() / 100) + 0.1 * (1 - clip(high.std() / 50))
        assert got[i] == pytest.approx(want)


def test_gray_and_proxies(spark, noise, tmp_path):
    d = colour(spark, noise, np.dstack([noise, noise[:, :, :1]]), noise[:, :, :1])
    got = {r["image_id"]: r for r in sources.gray(d).collect()}
    assert np.allclose(got[0]["px"], (noise @ k.GRAY_WEIGHTS).ravel()) and got[1]["alpha"] == noise[:, :, 0].ravel().tolist() and got[2]["px"] == noise[:, :, 0].ravel().tolist()
    cache = str(tmp_path / "cache")
    assert sources.cached_proxies(d.limit(1), cache, 20).count() == 1
    both = sources.cached_proxies(d, cache, 20).orderBy("image_id").collect()
    assert [(r["height"], r["width"], r["n_channels"]) for r in both] == [(15, 20, 3)] * 3
    assert sources.loaded(d, 40).first()["width"] == 40
    assert sources.or_half(F.lit(0)) is not None


def test_enhancement(spark, noise):
    d = colour(spark, noise[:24, :24], np.dstack([noise[:24, :24], noise[:24, :24, :1]]))
    for out in (enhance.enhance(d, "light"), enhance.processed(d, ["shadow", "sharpen", "colour", "repair"]), enhance.preview(d, ["denoise", "upscale"], 12)):
        rows = out.collect()
        assert len(rows) == 2 and all(len(r["data"]) == r["height"] * r["width"] * r["n_channels"] for r in rows)
    up = enhance.processed(d.limit(1), ["upscale"]).first()
    assert (up["height"], up["width"]) == (48, 48)
    flat = np.full((12, 12), 90.0)
    assert np.abs(k.equalised(flat, 2.0, 4) - k.equalised(flat, 2.0, 4)[0, 0]).max() < 1e-9
    # without clipping and with one tile it is plain equalisation
    m = np.random.default_rng(6).integers(0, 256, (16, 16))
    rank = np.searchsorted(np.sort(m.ravel()), m, side="right") / m.size * 255
    assert np.allclose(k.equalised(m, 1e9, 1), rank)


def test_detectors(spark, noise):
    d = gray(spark, noise @ k.GRAY_WEIGHTS, np.full((30, 30), 50.0))
    for name, width in (("orb", 256), ("akaze", 128), ("sift", 128), ("lp_sift", 128), ("enhanced", 128), ("unknown", 128)):
        rows = features.detector(name, 40)(d).collect()
        mine = [r for r in rows if r["image_id"] == 0]
        assert 10 < len(mine) <= 40 and all(len(r["descriptor"]) == width for r in mine)
        # a flat image has no corners; only the enhanced detector puts a lattice there
        assert bool([r for r in rows if r["image_id"] == 1]) == (name == "enhanced")
    keys = features.detector("sift", 5)(d)
    h = features.lab_histograms(keys, colour(spark, noise)).collect()
    lab = k.lab(noise)
    for r in h:
        p = keys.filter(f"kp_id = {r['kp_id']} and image_id = 0").first()
        y, x = int(p["y"]), int(p["x"])
        part = lab[max(0, y - 5) : y + 6, max(0, x - 5) : x + 6]
        want = np.concatenate([np.histogram(part[..., c], bins=16, range=(0, 256))[0] / part[..., c].size for c in range(3)])
        assert np.allclose(r["histogram"], want)
    assert len(features.with_colour(keys, colour(spark, noise)).first()["descriptor"]) == 176
    few = features.with_fallback(d, 10)
    assert few.filter("image_id = 0").count() > 10


def test_fast_corner_by_hand():
    m = np.zeros((9, 9))
    m[4, 4] = 100
    assert features.fast_corners(m)[4, 4] > 0 and features.fast_corners(np.full((9, 9), 7.0)).max() == 0


def test_nearest_overall_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(90, 6)).round(1)
    v[10] = v[50]
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "kp_id long, descriptor array<float>")
    got = {(r["kp_i"], r["rank"]): (r["kp_j"], r["distance"]) for r in matching.nearest_overall(d, 2, block=20).collect()}
    far = np.round(np.sqrt(((v[:, None].astype(np.float32).astype(float) - v[None].astype(np.float32).astype(float)) ** 2).sum(2)), 9)
    np.fill_diagonal(far, np.inf)
    for i in range(90):
        for place, j in enumerate(np.lexsort((np.arange(90), far[i]))[:2]):
            assert got[i, place + 1] == (j, pytest.approx(far[i, j]))


def test_boundaries(noise):
    label = np.zeros((6, 6))
    label[:, 3:] = 1
    assert semantic.label_boundary(label, 0, 0)[:, 2].tolist() == [255.0] * 6 and semantic.label_boundary(label, 0, 0).sum() == 6 * 255
    step = np.zeros((20, 20))
    step[:, 10:] = 200
    found = semantic.canny(step, 30, 100)
    assert set(np.nonzero(found)[1]) <= {9, 10} and (found.sum(axis=1) > 0).all()
    for name, f in semantic.MAPS.items():
        m = f(noise[:32, :32])
        assert m.shape == (32, 32) and 0 <= m.min() and m.max() <= 255, name
    halves = np.zeros((20, 20, 3), np.uint8)
    halves[:, 10:] = 255
    assert set(np.nonzero(semantic.colour_map(halves))[1]) == {9}
    assert len(np.unique(semantic.superpixels(noise[:20, :20], 16))) > 4
    assert semantic.foreground(label)[0, 0] < semantic.foreground(label)[0, 5]


def test_semantic_weights_and_modes(spark, noise):
    w = semantic.weight(30, 30, mode="sam")
    assert w[0, 0] == 0.5 and w[15, 15] == 1.0 and semantic.weight(30, 30)[15, 15] == pytest.approx(0.14)
    assert [semantic.resolved(m) for m in ("auto", "sam", "deeplab", "edge", "what")] == ["hybrid", "hybrid", "hybrid", "edge", "edge"]
    assert semantic.resolved("auto", ("sam", "edge")) == "sam"
    d = colour(spark, noise[:12, :12], noise[12:24, :12]).withColumns({"x0": F.lit(0), "y0": (F.col("image_id") * 6).cast("int")})
    for model in (None, lambda m: (m[:, :, 0] > 128).astype(int)):
        cells = semantic.blend(semantic.layers(d, "edge" if model is None else "auto", model)).collect()
        assert len(cells) == 18 * 12
        one = {(r["y"], r["x"]): r for r in cells}
        assert [one[0, 3][c] for c in "bgr"] == pytest.approx(noise[0, 3].tolist())


def test_seam_cost_and_join(spark, noise):
    a, b = noise[:16, :20], noise[20:36, :20]
    mixed = np.array([[1, 0, -1], [0, 0, 0], [-1, 0, 1]], float)
    want = np.sqrt(((k.lab(a) - k.lab(b)) ** 2).sum(2)) + 0.5 * sum(np.abs(k.correlate(np.rint(m @ k.GRAY_WEIGHTS), mixed)) for m in (a, b))
    overlap = np.ones((16, 20), bool)
    overlap[:, :3] = False
    cost = seams.seam_cost(a, b, overlap)
    assert np.allclose(cost[:, 3:], want[:, 3:]) and (cost[:, :3] == 0).all()
    d = spark.createDataFrame([(0, 16, 20, bytearray(a.tobytes()), bytearray(b.tobytes()), bytearray(overlap.astype(np.uint8).tobytes())), (1, 16, 20, bytearray(a.tobytes()), bytearray(b.tobytes()), bytearray(bytes(320)))], "image_id long, height int, width int, first binary, second binary, overlap binary")
    got = {r["image_id"]: np.frombuffer(r["data"], np.uint8).reshape(16, 20, 3) for r in seams.joined_at_seam(d, 1).collect()}
    assert (got[1] == a).all() and got[0].shape == a.shape
    assert (seams.seam_path(np.zeros((4, 5))) == 0).all()
    c = np.ones((3, 4))
    c[1] = 0
    assert seams.seam_path(c).tolist() == [1, 1, 1, 1]


def test_seam_path_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(20):
        c = rng.integers(0, 5, (4, 5)).astype(float)
        best = min(sum(c[p[x], x] for x in range(5)) for p in _paths(4, 5))
        path = seams.seam_path(c)
        assert c[path, np.arange(5)].sum() == best and (np.abs(np.diff(path)) <= 1).all()


def _paths(rows, cols):
    out = [[r] for r in range(rows)]
    for _ in range(cols - 1):
        out = [p + [r] for p in out for r in range(max(0, p[-1] - 1), min(rows, p[-1] + 2))]
    return out


def test_tiles_at_seams(spark):
    cells = spark.createDataFrame([(0, 0, True), (30, 11, True), (50, 50, False)], "y long, x long, overlap boolean")
    got = {tuple(r) for r in seams.tiles_at_seams(cells, 16, 0.25).collect()}
    want = {(j * 12, i * 12) for j in range(10) for i in range(10) for y, x in ((0, 0), (30, 11)) if j * 12 <= y < j * 12 + 16 and i * 12 <= x < i * 12 + 16}
    assert got == want and seams.tile_weights(8)[0, 0] == 0.25


def test_bundle_adjustment_of_a_chain(spark):
    rng = np.random.default_rng(9)
    turn = [(np.cos(t), np.sin(t)) for t in 0.05 * np.arange(6)]
    truth = [(a, b, 30.0 * i, 5.0 * i) for i, (a, b) in enumerate(turn)]
    back = lambda t, p: graph_inverse(t, p)
    rows = []
    for i in range(5):
        for n in range(12):
            p = rng.uniform(0, 40, 2) + [30.0 * i, 0]
            x, y = back(truth[i], p), back(truth[i + 1], p)
            rows.append((i, i + 1, *map(float, x), *map(float, y + (60 if n == 0 else 0))))
    d = spark.createDataFrame(rows, "image_i long, image_j long, x1 double, y1 double, x2 double, y2 double")
    got = stitch.adjusted(d).orderBy("image_id").collect()
    for r, t in zip(got, truth, strict=True):
        assert np.allclose((r["a"], r["b"], r["tx"], r["ty"]), t, atol=1e-3)


def graph_inverse(t, p):
    a, b, tx, ty = t
    q = a * a + b * b
    dx, dy = p[0] - tx, p[1] - ty
    return np.array([(a * dx + b * dy) / q, (a * dy - b * dx) / q])


def test_files_round_trip(spark, noise, tmp_path):
    ys, xs = np.indices((20, 30))
    m = noise[:20, :30]
    cells = spark.createDataFrame([(int(x) + 3, int(y) - 2, *map(int, v)) for y, x, v in zip(ys.ravel(), xs.ravel(), m.reshape(-1, 3), strict=True)], "x int, y int, b int, g int, r int")
    for kind in ("png", "tiff", "bmp"):
        assert sinks.save(cells, str(tmp_path / f"a.{kind}"), "low") > 100
    for kind in ("png", "bmp"):
        back = sources.images(spark, str(tmp_path), (kind,)).first()
        assert np.array_equal(np.frombuffer(back["data"], np.uint8).reshape(20, 30, 3), m)
    data = (tmp_path / "a.png").read_bytes()
    at = data.index(b"pHYs")
    assert struct.unpack(">IIB", data[at + 4 : at + 13]) == (11811, 11811, 1)
    large, small = (sinks.encode(cells, "jpg", q) for q in ("ultra_high", "minimum"))
    assert len(large) > len(small) and struct.unpack(">BHH", large[13:18]) == (1, 300, 300)
    g = spark.createDataFrame([(0, 0, 0.5), (2, 1, 1.0)], "x int, y int, value double")
    body = sinks.encode(g, "png")
    raw = zlib.decompress(body[body.index(b"IDAT") + 4 :][: struct.unpack(">I", body[body.index(b"IDAT") - 4 : body.index(b"IDAT")])[0]])
    assert raw == b"\0" + bytes([127, 0, 0]) + b"\0" + bytes([0, 0, 255])
    for bad in ("gif", "x"):
        with pytest.raises(ValueError):
            sinks.encode(g, bad)
    with pytest.raises(ValueError):
        sinks.encode(g.limit(0), "png")
    assert sinks.from_base64(sinks.to_base64(body)) == body
    sinks.write_tiles(g, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 1


def test_preview(spark, noise, tmp_path):
    d = colour(spark, noise[:30, :40], noise[30:, 40:]).withColumns({"seq": F.col("image_id"), "x0": (F.col("image_id") * 20).cast("int"), "y0": F.lit(0), "angle": F.col("image_id") * 30.0})
    cells = {(r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in preview.canvas(d).collect()}
    assert cells[0, 0] == (0, 0, 0) and cells[5, 5] == tuple(noise[5, 5].tolist())
    turned = preview.rotated(noise[30:, 40:].astype(float), 30.0)
    h, w = 30, 40
    assert turned.shape[:2] == (int(h * np.cos(np.pi / 6) + w * 0.5), int(h * 0.5 + w * np.cos(np.pi / 6)))
    assert np.allclose(preview.rotated(np.arange(12.0).reshape(3, 4), 0.0), np.arange(12.0).reshape(3, 4))
    assert preview.saved(d, str(tmp_path / "p.png")) > 0 and preview.saved(d.limit(0), str(tmp_path / "q.png")) is None
    assert preview.normalised(noise[:, :, 0]).shape == noise.shape


@pytest.fixture(scope="module")
def scene(spark):
    m = k.gaussian(np.random.default_rng(10).integers(0, 256, (64, 96)).astype(float), 0.8)
    at = [(y, x) for y in (0, 24) for x in (0, 24, 48)]
    return m, at, gray(spark, *[m[y : y + 40, x : x + 48] for y, x in at]).withColumn("width", F.col("width").cast("int")).cache()


def test_scene_is_put_together(spark, scene):
    m, at, d = scene
    got = stitch.placed(d).collect()
    assert {(r["image_id"], r["y0"], r["x0"]) for r in got} == {(i, y, x) for i, (y, x) in enumerate(at)}
    cells = stitch.stitched(d, stitch.Options(drop_duplicates=True)).collect()
    out = np.full(m.shape, np.nan)
    for r in cells:
        out[r["y"], r["x"]] = r["value"]
    assert np.nanmax(np.abs(out - m)) < 1e-3 and not np.isnan(out).any()
    view = {r["image_id"]: (r["x"], r["y"]) for r in stitch.grid_aligned(d, low=0.0).collect()}
    assert view[0] == (50, 50) and view[5][0] > view[4][0] > view[3][0] and view[5][1] > view[2][1]


def test_small_scenes(spark, scene):
    _, _, d = scene
    one = stitch.placed(d.limit(1)).collect()
    assert [(r["x0"], r["y0"]) for r in one] == [(0, 0)]
    assert stitch.stitched(d.limit(0)).count() == 0
    twice = d.filter("image_id < 3").withColumn("rk", F.col("image_id")).unionByName(d.filter("image_id = 0").withColumn("image_id", F.lit(9).cast("long")).withColumn("rk", F.lit(9).cast("long")))
    assert {r["image_id"] for r in stitch.without_duplicates(twice).collect()} == {0, 1, 2}
    assert stitch.without_duplicates(twice.limit(2)).count() == 2


def test_control_points_alone(spark):
    rows = [(i, i + 1, float(x), float(y), float(x + 7), float(y - 2)) for i in range(3) for x, y in ((0, 0), (9, 1), (4, 8))]
    points = spark.createDataFrame(rows, "image1_idx long, image2_idx long, x1 double, y1 double, x2 double, y2 double")
    got = {r["image_id"]: (r["tx"], r["ty"]) for r in stitch.align_with_points(points).collect()}
    low = got[0]
    assert {i: (round(v[0] - low[0], 6), round(v[1] - low[1], 6)) for i, v in got.items()} == {i: (-7.0 * i, 2.0 * i) for i in range(4)}


def test_modes_numbers_and_jobs(spark):
    p = spark.range(12).withColumnRenamed("id", "i")
    assert pairs.by_mode(p, 12, "exhaustive").count() == 66 and pairs.by_mode(p, 12, "chain").count() == 11 and pairs.by_mode(p, 12, "?").count() == pairs.candidates(p, 12).count()
    assert [r["index"] for r in graph.renumbered(spark.createDataFrame([(7,), (3,), (9,)], "image_id long")).orderBy("image_id").collect()] == [0, 1, 2]
    with jobs.step(spark, "count", "group-x"):
        assert p.count() == 12
    done, total = jobs.progress(spark, "group-x")
    assert 0 <= done <= total and jobs.memory(spark)
    jobs.cancel(spark, "group-x")
    thread = jobs.in_background(spark, p.count, "group-y")
    thread.join()
    assert layout.at_origin(spark.createDataFrame([(1, 4, 5)], "image_id long, width int, height int")).first()["x1"] == 4
