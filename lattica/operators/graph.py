"""The image graph: edges, components, reference, coverage, clusters and transforms (A, C and T families)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import written


def usable(edges: DataFrame, least: int = 8, column: str = "num_matches") -> DataFrame:
    return edges.filter(F.col(column) >= least)


def both_ways(edges: DataFrame, a: str = "image_i", b: str = "image_j") -> DataFrame:
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("image_id")).agg(F.count("*").alias("degree"))


def reference(edges: DataFrame) -> DataFrame:
    """The image with most neighbours, the lowest id on ties (one row)."""
    return degrees(edges).orderBy(F.desc("degree"), "image_id").limit(1)


def bfs(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Rows image_id, level, parent from the start image: a frontier per round, first visits by the smallest parent."""
    links = written(both_ways(edges).distinct(), "links")
    seen = written(start.select(F.col("image_id"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")), "level")
    frontier, level = seen, 0
    while True:
        level += 1
        reached = frontier.select(F.col("image_id").alias("src")).join(links, "src").groupBy(F.col("dst").alias("image_id")).agg(F.min("src").alias("parent"))
        frontier = written(reached.join(seen.select("image_id"), "image_id", "left_anti").select("image_id", F.lit(level).alias("level"), "parent"), "level")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def components(edges: DataFrame) -> DataFrame:
    """Rows image_id, component: the smallest id reachable; edges are contracted round by round."""
    links = written(edges.select(F.col("image_i").cast("long").alias("a"), F.col("image_j").cast("long").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = both_ways(links, "a", "b")
        parent = both.groupBy(F.col("src").alias("a")).agg(F.min("dst").alias("p")).select("a", F.least("a", "p").alias("p"))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("image_id"), F.col("p").alias("component"))
        else:
            labels = written(labels.join(parent, labels["component"] == parent["a"], "left").select("image_id", F.coalesce("p", "component").alias("component")), "labels")
        x, y = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        links = written(links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        if links.isEmpty():
            return labels


def largest_component(edges: DataFrame) -> DataFrame:
    """Images of the largest component (the one with the smallest id on ties)."""
    c = components(edges)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(best, "component", "left_semi").select("image_id", "component")


def overlap_estimate(edges: DataFrame, areas: DataFrame) -> DataFrame:
    """Estimated overlap of each edge from its confidence, matches and the mean area of both images."""
    a = areas.select(F.col("image_id").alias("image_i"), F.col("area").alias("ai"))
    b = areas.select(F.col("image_id").alias("image_j"), F.col("area").alias("aj"))
    mean = (F.col("ai") + F.col("aj")) / 2
    estimate = F.when(mean <= 0, F.col("confidence")).otherwise(F.least(F.lit(1.0), 0.5 * F.col("confidence") + F.col("num_matches") / F.sqrt(mean) * 100 * 0.01))
    return edges.join(a, "image_i").join(b, "image_j").withColumn("overlap", estimate).drop("ai", "aj")


def overlap_band(edges: DataFrame, low: float, high: float) -> DataFrame:
    return edges.filter(F.col("overlap").between(low, high))


def kept_images(images: DataFrame, edges: DataFrame) -> DataFrame:
    """Images with an edge; all of them if there is no edge (ids stay as they are)."""
    touched = both_ways(edges).select(F.col("src").alias("image_id")).distinct().withColumn("_hit", F.lit(True))
    any_ = edges.limit(1).agg((F.count("*") == 0).alias("_none"))
    return images.join(touched, "image_id", "left").crossJoin(F.broadcast(any_)).filter(F.col("_hit") | F.col("_none")).drop("_hit", "_none")


def renumbered(images: DataFrame, name: str = "index") -> DataFrame:
    """Dense numbers from 0 in the order of image_id, as after a filter; ids stay as they are."""
    from lattica.operators.quality import numbered

    return numbered(images, "image_id", name)


def _one_task(df: DataFrame, by: str | None, run, schema: str) -> DataFrame:
    """A sequential operator on the edge table of each group, whose size the images of one scene bound."""
    return (df.withColumn("_g", F.lit(0)) if by is None else df.withColumn("_g", F.col(by))).groupBy("_g").applyInPandas(run, schema)


def _neighbours(a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted ids; where each one's neighbours start, their places and weights, from edges given once in either direction.

    Without weights only the neighbours before an id are listed. Places take four bytes, as this is one task's memory.
    """
    nodes = np.union1d(np.unique(a), np.unique(b))
    a, b = (np.searchsorted(nodes, v).astype(np.int32) for v in (a, b))
    src, dst = (np.maximum(a, b), np.minimum(a, b)) if weight is None else (np.concatenate([a, b]), np.concatenate([b, a]))
    del a, b
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(nodes)))])
    order = np.argsort(src)
    del src
    return nodes, first, dst[order], None if weight is None else weight[order % max(1, len(weight))]


def _given_once(edges: DataFrame) -> DataFrame:
    """Columns a < b of the edges between different images."""
    a, b = F.col("image_i").cast("long"), F.col("image_j").cast("long")
    return edges.filter(a != b).withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b))


def greedy_cover(edges: DataFrame, limit: float = 0.5) -> DataFrame:
    """Images chosen one after another: seq, image_id. Columns image_i, image_j, confidence, inlier_ratio.

    Starts at the highest degree; adds the connected candidate whose overlap with chosen ones is
    within the limit and which opens most new neighbours with least overlap. Of edges given twice the
    largest overlap counts.
    """

    # what a candidate gains only falls, and only when a neighbour of it is chosen, so a step looks at those alone; the
    # greatest gain of all is found through the greatest of each block

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, first, near, o = _neighbours(pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.overlap.to_numpy())
        n, wide = len(nodes), 512
        if not n:
            return pd.DataFrame({"seq": [], "image_id": []})
        left = np.diff(first)  # neighbours not chosen
        most, inside = np.full(n, -np.inf), np.zeros(n, dtype=bool)
        gain = np.full((-(-n // wide), wide), -np.inf)
        flat, best = gain.reshape(-1), np.full(len(gain), -np.inf)
        chosen, c = [], int(left.argmax())
        while True:
            chosen.append(c)
            inside[c], flat[c] = True, -np.inf
            near_c = near[first[c] : first[c + 1]]
            left[near_c] -= 1
            most[near_c] = np.maximum(most[near_c], o[first[c] : first[c + 1]])
            flat[near_c] = np.where(inside[near_c] | (most[near_c] > limit), -np.inf, left[near_c] + 2 * (1 - most[near_c]))
            touched = np.unique(np.append(near_c, c) // wide)
            best[touched] = gain[touched].max(axis=1)
            block = int(best.argmax())  # the first one, so the lowest id
            if best[block] == -np.inf:
                return pd.DataFrame({"seq": range(len(chosen)), "image_id": nodes[chosen]})
            c = block * wide + int(gain[block].argmax())

    overlap = F.max(F.least(2 * F.col("confidence") * F.col("inlier_ratio"), F.lit(1.0))).alias("overlap")
    return _one_task(_given_once(edges).groupBy("a", "b").agg(overlap), None, run, "seq int, image_id long")


def clusters(edges: DataFrame, size: int = 50) -> DataFrame:
    """Rows image_id, cluster: components, larger ones split greedily around their first images."""
    c = components(edges)
    e = _given_once(edges).select("a", "b").distinct().join(c.select(F.col("image_id").alias("a"), "component"), "a").select("a", "b", "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, first, near, _ = _neighbours(pdf.a.to_numpy(), pdf.b.to_numpy())
        n = len(nodes)
        if n <= size:
            return pd.DataFrame({"image_id": nodes, "cluster": [str(nodes[0])] * n})
        k = max(2, n // size)
        where = np.full(n, -1)
        where[:k] = np.arange(k)
        members, room = np.bincount(where[:k], minlength=k), 0  # room: no cluster before it takes more
        for v in range(k, n):
            # clusters of the neighbours before it, which are placed; all others have no link
            at, links = np.unique(where[near[first[v] : first[v + 1]]], return_counts=True)
            open_ = members[at] < 1.2 * size
            if open_.any():
                i = int(at[open_][links[open_].argmax()])
            else:
                while room < k and members[room] >= 1.2 * size:
                    room += 1
                i = room if room < k else 0
            members[i] += 1
            where[v] = i
        return pd.DataFrame({"image_id": nodes, "cluster": [f"{nodes[0]}.{i}" for i in where]})

    return e.groupBy("component").applyInPandas(run, "image_id long, cluster string")


def cluster_links(edges: DataFrame, membership: DataFrame, weight: str = "num_inliers") -> DataFrame:
    """Summed weights between different clusters."""
    a = membership.select(F.col("image_id").alias("image_i"), F.col("cluster").alias("ca"))
    b = membership.select(F.col("image_id").alias("image_j"), F.col("cluster").alias("cb"))
    j = edges.join(a, "image_i").join(b, "image_j").filter("ca <> cb")
    return j.groupBy(F.least("ca", "cb").alias("cluster_a"), F.greatest("ca", "cb").alias("cluster_b")).agg(F.sum(weight).alias("links"))


def inverse(a, b, tx, ty):
    """Inverse of the similarity [[a, -b, tx], [b, a, ty]]."""
    q = a * a + b * b
    return a / q, -b / q, -(a * tx + b * ty) / q, (b * tx - a * ty) / q


def compose(p, q):
    """p after q, each (a, b, tx, ty)."""
    a, b, tx, ty = p
    c, d, ux, uy = q
    return a * c - b * d, a * d + b * c, a * ux - b * uy + tx, b * ux + a * uy + ty


def propagate(transforms: DataFrame, tree: DataFrame) -> DataFrame:
    """Absolute transforms along a BFS tree (image_id, level, parent): a join per level."""
    cols = ["a", "b", "tx", "ty"]
    fwd = transforms.select(F.col("image_j").alias("parent"), F.col("image_i").alias("image_id"), *cols)
    inv = transforms.select(F.col("image_i").alias("parent"), F.col("image_j").alias("image_id"), *[x.alias(c) for x, c in zip(inverse(*map(F.col, cols)), cols, strict=True)])
    step = written(fwd.unionByName(inv).join(tree, ["image_id", "parent"]).select("image_id", "parent", "level", *cols), "steps")
    out = tree.filter("level = 0").select("image_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    done = done_level = written(out, "absolute")
    for level in range(1, (tree.agg(F.max("level")).first()[0] or 0) + 1):
        up = done_level.select(F.col("image_id").alias("parent"), *[F.col(c).alias("p_" + c) for c in cols])
        j = step.filter(F.col("level") == level).join(up, "parent")
        total = compose([F.col("p_" + c) for c in cols], [F.col(c) for c in cols])
        done_level = written(j.select("image_id", *[x.alias(c) for x, c in zip(total, cols, strict=True)]), "absolute")
        done = done.unionByName(done_level)
    return done


def grid_size(n: int) -> tuple[int, int]:
    """Rows and columns of a near-square grid."""
    if n <= 0:
        return 1, 1
    cols = math.ceil(math.sqrt(n))
    return math.ceil(n / cols), cols


def anchors(values: list[float], tolerance: float) -> list[float]:
    """Starts of 1-D clusters: a value further than `tolerance` from the last start begins one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def cluster_1d(positions: DataFrame, column: str, tolerance: float = 0.1) -> DataFrame:
    """Anchor-based clusters of a column of one scene's positions: start, size, by a fold over the sorted values."""
    folded = positions.agg(F.sort_array(F.collect_list(column)).alias("v")).select(
        F.aggregate("v", F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) == 0) | (x - F.element_at(s, -1) > tolerance), F.concat(s, F.array(x))).otherwise(s)).alias("starts"), "v"
    )
    starts = folded.select(F.posexplode("starts").alias("cluster", "start"), "starts", "v")
    nxt = F.get("starts", F.col("cluster") + 1)
    return starts.select("cluster", "start", F.size(F.filter("v", lambda x: (x >= F.col("start")) & (nxt.isNull() | (x < nxt)))).alias("size"))


def detect_grid(positions: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Rows image_id, row, col, confidence from positions (image_id, x, y) of a scene; none if there is no grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"image_id": [], "row": [], "col": [], "confidence": []})
        xs, ys = anchors(list(pdf.x), tolerance), anchors(list(pdf.y), tolerance)
        if len(pdf) < 4 or len(xs) < 2 or len(ys) < 2:
            return empty

        def even(v: list[float]) -> bool:
            gaps = pd.Series(v).diff().dropna()
            return gaps.std(ddof=0) / gaps.mean() < 0.3

        cell = [(min(range(len(ys)), key=lambda r: abs(ys[r] - p.y)), min(range(len(xs)), key=lambda c: abs(xs[c] - p.x)), p.image_id) for p in pdf.sort_values("image_id").itertuples()]
        taken = {(r, c): i for r, c, i in cell}
        confidence = len(taken) / (len(xs) * len(ys)) if even(xs) and even(ys) else 0.3
        return pd.DataFrame([(i, r, c, confidence) for (r, c), i in taken.items()], columns=empty.columns) if confidence >= 0.7 else empty

    return _one_task(positions.select("image_id", "x", "y"), None, run, "image_id long, row int, col int, confidence double")


def grid_neighbours(cells: DataFrame) -> DataFrame:
    """Rows image_id, nbr_id, direction of cells next to each other."""
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(d).alias("d")) for r, c, d in ((-1, 0, "up"), (1, 0, "down"), (0, -1, "left"), (0, 1, "right"))])
    near = cells.select("image_id", "row", "col", F.explode(moves).alias("m")).select("image_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"), F.col("m.d").alias("direction"))
    return near.join(cells.withColumnRenamed("image_id", "nbr_id"), ["row", "col"]).select("image_id", "nbr_id", "direction")


def relative_positions(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Positions from median offsets (image_i, image_j, dx, dy) along a BFS tree."""
    t = edges.select("image_i", "image_j", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.col("dx").alias("tx"), F.col("dy").alias("ty"))
    return propagate(t, tree).select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"))


