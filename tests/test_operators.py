"""Operators against values computed by hand and against plain Python."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import tiles as t
from lattica.operators import control_points, duplicates, filters, graph, layout, matching, pairs, quality, raster, seams
from lattica.plans import registry
from lattica.sources import images as sources
from lattica.sources import sinks


def tile(spark, *rows):
    return spark.createDataFrame([(i, 8, 8, [int(v) for v in np.asarray(r).ravel()]) for i, r in enumerate(rows)], "image_id long, width int, height int, px array<int>")


def test_constant_tile_scores_only_for_missing_noise(spark):
    r = quality.assess(tile(spark, np.full((8, 8), 100))).first()
    assert r["quality"] == pytest.approx(0.1)


def test_laplacian_matches_numpy(spark):
    m = np.random.default_rng(1).integers(0, 256, (8, 8))
    p = np.pad(m, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * m
    got = tile(spark, m).select(quality.laplacian_variance(F.col("px"), 8, 8)).first()[0]
    assert got == pytest.approx(lap.var())


def test_filter_falls_back_when_nothing_passes(spark):
    q = spark.createDataFrame([(1, 0.2), (2, 0.05), (3, None), (4, float("nan"))], "image_id long, quality double")
    assert {r[0] for r in quality.keep_good(q, 0.9).collect()} == {1, 3, 4}
    assert {r[0] for r in quality.keep_good(q, 0.5).collect()} == {3, 4}


def test_global_numbers_follow_the_order(spark):
    q = spark.createDataFrame([(i, (i * 7 % 10) / 10) for i in range(50)], "image_id long, quality double")
    got = {r["image_id"]: r["rk"] for r in quality.numbered(q, "image_id", "rk", "quality").collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(50), key=lambda i: (-(i * 7 % 10), i)))}


def test_brighter_copies_correlate(spark):
    m = np.random.default_rng(2).integers(0, 200, (8, 8))
    r = tile(spark, m).select(duplicates.ncc_similarity(F.col("px"), F.transform("px", lambda v: v + 10))).first()[0]
    assert r == pytest.approx(1.0)


def test_greedy_survivors_are_not_transitive(spark):
    ids = spark.createDataFrame([(0,), (1,), (2,), (3,)], "rk long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "rk_i long, rk_j long")
    assert sorted(r[0] for r in duplicates.greedy_survivors(ids, edges).collect()) == [0, 2]


@pytest.mark.parametrize(("n", "count"), [(10, 45), (11, 40), (20, 124), (30, 204), (50, 402), (100, 863), (500, 3949), (1000, 6922)])
def test_candidate_pair_counts(spark, n, count):
    assert pairs.candidates(spark.range(n).withColumnRenamed("id", "i"), n).count() == count


def test_cross_check_is_one_to_one(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i % 2, i, [float(x) for x in rng.normal(size=8)]) for i in range(40)], "image_id long, kp_id long, descriptor array<float>")
    one = spark.createDataFrame([(0, 1)], "image_i long, image_j long")
    m = matching.match(d, one, "disk").collect()
    assert len({r["kp_i"] for r in m}) == len({r["kp_j"] for r in m}) == len(m) > 0
    loose, tight = (matching.match(d, one, ratio=x).count() for x in (0.95, 0.7))
    assert tight <= loose


def test_ransac_leaves_outliers_out(spark):
    rng = np.random.default_rng(4)
    pts = [(0, 1, k, k, float(x), float(y), 0.9 * x - 0.2 * y + 5 + (100 if k % 5 == 0 else 0), 0.2 * x + 0.9 * y - 3) for k, (x, y) in enumerate(rng.uniform(0, 50, (40, 2)).tolist())]
    r = matching.ransac(spark.createDataFrame(pts, "image_i long, image_j long, kp_i long, kp_j long, x1 double, y1 double, x2 double, y2 double")).first()
    assert r["num_inliers"] == 32 and r["a"] == pytest.approx(0.9) and r["tx"] == pytest.approx(5)


def test_inverse_and_compose():
    p = (0.8, 0.3, 5.0, -2.0)
    assert graph.compose(p, graph.inverse(*p)) == pytest.approx((1, 0, 0, 0))


def test_components_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "image_i long, image_j long")
    assert {r["image_id"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert {r["image_id"]: r["level"] for r in graph.bfs(e, graph.reference(e)).collect()} == {2: 0, 1: 1, 3: 1, 4: 2}


def test_anchor_clusters_are_not_gap_based():
    assert graph.anchors([0.0, 0.08, 0.16, 0.24], 0.1) == [0.0, 0.16]


def test_identical_layers_blend_to_themselves(spark):
    layers = spark.createDataFrame([(0, 0, 77.0, w) for w in (0.1, 0.5, 2.0)] + [(0, 1, 9.0, 0.0)], "y int, x int, value double, weight double")
    assert {r["x"]: r["value"] for r in raster.weighted(layers).collect()} == {0: 77, 1: 0}


def test_warp_by_translation_moves_pixels(spark):
    m = np.arange(64).reshape(8, 8)
    i = tile(spark, m).withColumns({"a": F.lit(1.0), "b": F.lit(0.0), "tx": F.lit(3.0), "ty": F.lit(2.0)})
    got = {(r["x"], r["y"]): r["value"] for r in layout.warped(i).collect()}
    assert got[3, 2] == 0 and got[10, 9] == 63


def test_seam_takes_the_cheap_row():
    cost = np.ones((5, 6))
    cost[3] = 0
    assert (seams.seam_path(cost) == 3).all()


def test_filters_keep_constant_images():
    m = np.full((8, 8), 90.0)
    assert np.allclose(filters.nl_means(m), 90) and np.allclose(filters.inpaint(np.where(np.eye(8) > 0, 0, m)), 90)


def test_bundle_adjustment_recovers_a_shift(spark):
    rng = np.random.default_rng(5)
    o = spark.createDataFrame([(0, 1, float(x), float(y), float(x) - 7, float(y) + 4) for x, y in rng.uniform(0, 50, (30, 2))], "image_i long, image_j long, x1 double, y1 double, x2 double, y2 double")
    got = seams.bundle_adjust(o).set_index("image").loc[1]
    assert got.tx == pytest.approx(7, abs=1e-3) and got.ty == pytest.approx(-4, abs=1e-3)


def test_control_points(spark, tmp_path):
    p = spark.createDataFrame([(2, 1, 1.0, 2.0, 3.0, 5.0, None, None)], control_points.SCHEMA)
    control_points.write(p, str(tmp_path / "points"))
    back = control_points.read(spark, str(tmp_path / "points"))
    assert back.first()["confidence"] == 1.0 and control_points.of_pair(back, 1, 2).count() == 1
    r = control_points.transforms(back).first()
    assert (r["image_i"], r["tx"], r["ty"]) == (1, -2.0, -3.0)
    assert control_points.remove(back, back).count() == 0


def test_images_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(x, y, (x * 16 + y) % 256) for x in range(8) for y in range(8)], "x int, y int, value int")
    assert sinks.save(cells, f"file://{tmp_path}/a.png") > 0
    i = sources.gray(sources.images(spark, str(tmp_path))).first()
    assert (i["height"], i["width"]) == (8, 8) and i["px"][8 * 3 + 2] == (2 * 16 + 3) % 256
    with pytest.raises(ValueError):
        sinks.encode(cells, "xyz")


def test_reflection(spark):
    got = spark.range(1).select(F.transform(F.array(*map(F.lit, [-1, 0, 7, 8])), lambda v: t.reflect(v, 8))).first()[0]
    assert got == [1, 0, 7, 6]


def random_edges(spark, n, m, seed):
    rng = np.random.default_rng(seed)
    rows = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (m, 2)) if a != b})
    rows = [(a, b, float(rng.choice([0.1, 0.2, 0.3, 0.5])), float(rng.choice([0.5, 0.9]))) for a, b in rows]
    return rows, spark.createDataFrame(rows, "image_i long, image_j long, confidence double, inlier_ratio double")


def plain_cover(rows, limit=0.5):
    near = {}
    for i, j, c, r in rows:
        near.setdefault(i, {})[j] = near.setdefault(j, {})[i] = min(2 * c * r, 1.0)
    chosen = [min(near, key=lambda v: (-len(near[v]), v))]
    while True:
        most = {v: max(near[v][c] for c in near[v] if c in chosen) for v in {u for c in chosen for u in near[c]} - set(chosen)}
        gains = [(sum(u not in chosen for u in near[v]) + 2 * (1 - o), -v) for v, o in most.items() if o <= limit]
        if not gains:
            return chosen
        chosen.append(-max(gains)[1])


@pytest.mark.parametrize("seed", range(4))
def test_greedy_cover_chooses_as_the_plain_loop(spark, seed):
    rows, edges = random_edges(spark, 40, 30 + 60 * seed, seed)
    doubled = edges.unionByName(edges.limit(5).selectExpr("image_j AS image_i", "image_i AS image_j", "confidence", "inlier_ratio"))
    assert [r["image_id"] for r in graph.greedy_cover(doubled).orderBy("seq").collect()] == plain_cover(rows)


def test_greedy_cover_of_many_images_ends(spark):
    """The plain loop looks at all candidates in every step, minutes here."""
    rows, edges = random_edges(spark, 8000, 160_000, 7)
    edges = edges.withColumn("confidence", F.lit(0.1))
    began = time.time()
    assert len({r["image_id"] for r in graph.greedy_cover(edges).collect()}) == len({v for r in rows for v in r[:2]})
    assert time.time() - began < 60


def test_greedy_partition_of_many_images_ends(spark):
    """As by counting the links of every image with every cluster, which takes minutes here."""
    rows, edges = random_edges(spark, 20_000, 300_000, 8)
    began = time.time()
    got = {r["image_id"]: int(r["cluster"].split(".")[1]) for r in graph.clusters(edges, 10).collect()}
    assert time.time() - began < 60
    nodes, near = sorted(got), {}
    for a, b, _, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    k = len(nodes) // 10
    where, sizes = {v: i for i, v in enumerate(nodes[:k])}, [1] * k
    for v in nodes[k:]:
        links = {i: 0 for i in [next(i for i in range(k) if sizes[i] < 12)]}
        for u in near[v]:
            if u in where and sizes[where[u]] < 12:
                links[where[u]] = links.get(where[u], 0) + 1
        where[v] = max(links, key=lambda i: (links[i], -i))
        sizes[where[v]] += 1
    assert got == where


def test_hashed_pairs_are_those_of_the_bucket_join(spark):
    """In blocks smaller than buckets; the join itself makes a row of every two rows in a bucket and shuffles them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 6)).astype(np.float32))] + [(300, [0.5] * 6), (301, [0.5] * 6)]
    d = spark.createDataFrame(rows, "kp_id long, descriptor array<float>")
    left, right = d.filter("kp_id % 2 = 0"), d.filter("kp_id % 2 = 1")
    v = d.select("kp_id", array_to_vector(F.transform("descriptor", lambda x: x.cast("double"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=3, seed=7).fit(v)
    joined = model.approxSimilarityJoin(v.filter("kp_id % 2 = 0"), v.filter("kp_id % 2 = 1"), 1.9, "d")
    want = {(r[0], r[1]): r[2] for r in joined.select("datasetA.kp_id", "datasetB.kp_id", "d").collect()}
    found = matching.hashed_pairs(left, right, 1.9, 0.5, tables=3, block=20)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(i, j): pytest.approx(x, abs=1e-9) for i, j, x in got} == want
    assert 0 < len(want) and (300, 301) in want
    assert found.filter("distance < 0.1").count() == sum(x < 0.1 for x in want.values())
    plan = registry.QUERIES["lsh_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "datasetA" not in plan  # no aggregate over pairs
    assert matching.hashed_pairs(left.limit(0), right, 1.9, 0.5).collect() == []
