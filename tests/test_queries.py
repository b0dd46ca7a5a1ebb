"""Registered queries against their SQL twins at the smallest scale."""

from collections import Counter, defaultdict
from statistics import median

import duckdb
import pytest

from lattica.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part lineitem events documents embeddings".split()
SOME = ["tile_pixels", "quality_laplacian_var", "dhash_bits", "phash_bits", "pairs_smart", "ratio_test", "best_match", "cross_check", "similarity_ls_fit", "cluster_links", "grid_neighbors", "blend_weighted", "blend_first_wins", "blend_median", "unsharp", "percentile_stretch", "topk_by_response", "session_windows", "decode_gray", "thumbnails", "label_boundaries", "semantic_weights", "semantic_blend", "colour_stretch", "preview_canvas", "seam_tiles", "shadow_normalize", "keypoint_histograms"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    r = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    want = sorted(tuple(str(tidy(row[columns.index(c)])) for c in sorted(columns)) for row in r.fetchall())
    got = sorted(tuple(str(tidy(row[c])) for c in sorted(columns)) for row in df.collect())
    assert got == want and got


def test_correspondence_queries_read_every_supplier(spark):
    """On 100 suppliers, against plain Python over all line items."""
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity::DOUBLE, (l_partkey % 97)::DOUBLE FROM '{d}/lineitem.parquet'").fetchall()
    total, right, inside, moves = Counter(), Counter(), Counter(), defaultdict(list)
    for i, o, n, x, y in rows:
        x2, y2 = 0.9 * x - 0.1 * y + i + (40 + (o * 8 + n) % 50 if o % 9 == 0 else 0), 0.1 * x + 0.9 * y - i
        total[i] += 1
        right[i] += o % 9 != 0
        inside[i] += x < 60 and y < 90 and 0 <= x2 < 60 and 0 <= y2 < 90
        moves[i].append((x2 - x, y2 - y))
    assert len(total) == 100
    got = lambda name: {r[0]: r for r in registry.QUERIES[name](spark, d).collect()}
    assert {k: (r["num_matches"], r["num_inliers"]) for k, r in got("ransac_inliers").items()} == {k: (total[k], right[k]) for k in total}
    assert {k: r["n"] for k, r in got("similarity_ls_fit").items()} == right
    assert {k: r["n"] for k, r in got("refine_matches").items()} == right
    assert {k: r["n"] for k, r in got("control_point_bounds").items()} == {k: n for k, n in inside.items() if n}
    shifts = {k: tuple(median(c) for c in zip(*v, strict=True)) for k, v in moves.items()}
    for name in ("translation_median", "control_point_transforms"):
        assert {k: (r["tx"], r["ty"]) for k, r in got(name).items()} == {k: pytest.approx(v, abs=1e-5) for k, v in shifts.items()}


def test_panorama_of_tables_that_repeat_with_shifted_keys(spark, tmp_path):
    """Every 16 rows of the pattern look alike then, so two pairs of images are equal but for the marks."""
    copies = f"SELECT * REPLACE (l_orderkey + k * 15000 AS l_orderkey, l_partkey + k * 20000 AS l_partkey, l_suppkey + k * 1000 AS l_suppkey) FROM '/root/testdata/sf0.01/lineitem.parquet', range(6) r(k)"
    duckdb.sql(f"COPY ({copies}) TO '{tmp_path}/lineitem.parquet'")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = {(y, x): v for y, x, v in c.execute(registry.ORACLES["stitch_panorama"]).fetchall()}
    got = {(r["y"], r["x"]): r["value"] for r in registry.QUERIES["stitch_panorama"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len(want) == 48 * 64
    assert max(abs(got[k] - want[k]) for k in want) < 0.0015  # sums in another order may turn a tie


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
