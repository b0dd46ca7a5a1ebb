"""Documents linked by the Jaccard similarity of their word shingles: a grouped prefix join.

1. Documents of one shingle set become one node (copies are never expanded).
2. Shingles get one global order in which common ones come last. Two sets that reach the
   similarity share a shingle among the first n - ceil(0.8 n) + 1 of each, their prefixes.
   A sketch of all prefix shingles tells which occur once only; those are not listed.
3. Nodes with the same prefix and size are one group. A shingle's list holds the groups that have
   it in their prefix, each once.
4. Group pairs are filtered: sizes within the similarity, places of a shared shingle that leave
   room for it, and enough shared prefix shingles to reach it with what comes after the prefixes. Each list's first group is paired with the
   others before; pairs of groups that are then in one component are left out, so that a large
   group of near copies is not paired with itself.
5. Pairs of groups that pass are expanded to members, and those are verified on the whole sets,
   computed again from the texts. Members of one component are not compared any more. So no link
   between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Sketch, cells_for, drop_table, free_name, sketch, spread_join, written
from .words import NON_BLANK, U64, Words, inside, lean, mix, rolling, segments

SHINGLE = 5
PER_CENT = 80
#: Frequent shingles whose counts are known to all tasks, at most; others count as rare in the order.
FREQUENT = 1 << 20
#: Rounds in which every list's first group is compared before what is left is compared pair by pair.
ROUNDS = 2
#: Rows of a list that one task pairs with the whole list; longer lists are split.
LIST_ROWS = 512
#: Bytes of text from which on a partition is not read together with others.
TASK_BYTES = 32 << 20
#: Cells of the sketch of prefix shingles, least and most (2 to 128 MB broadcast); too few only make lists longer.
CELLS = 1 << 24, 1 << 30


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the distinct shingles: text numbers, fingerprints (sorted within a text), and sizes."""
    words = Words(texts, NON_BLANK, lower=True)
    h = words.hashes()
    ok = inside(words, SHINGLE)
    docs, parts = [words.doc[: len(ok)][ok]], [rolling(h, SHINGLE)[ok]]
    for n in range(1, SHINGLE):
        few = np.flatnonzero(words.count == n)
        if len(few):
            at = (words.first[few][:, None] + np.arange(n)).ravel()
            docs.append(few)
            parts.append(rolling(h[at], n, seed=100 * n)[::n])
    doc, grams = np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])]) if len(doc) else np.zeros(0, bool)
    doc, grams = doc[new], grams[new]
    return doc, grams, np.bincount(doc, minlength=len(texts))


def _keys(values: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of consecutive sets of `sizes` fingerprints each (0: empty)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ mix(np.array([seed], np.uint64))), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)), U64(0))


def set_keys(doc: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit key of each text's set (0: empty)."""
    return _keys(grams, sizes, 1).view(np.int64)


class _Seen:
    """Which keys a task meets for the first time (it may forget, then a key is met again)."""

    def __init__(self):
        self.keys: set[int] = set()

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for i, k in enumerate(keys.tolist()):
            if k and k not in self.keys:
                self.keys.add(k)
                out[i] = True
        if len(self.keys) > 1_000_000:
            self.keys.clear()
        return out


def _scan(df: DataFrame, row_id: str) -> DataFrame:
    """Rows kind 0: each document's set key and size; rows kind 1: shingles that several sets of one task have, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        pending: list[np.ndarray] = []
        held = 0

        def frequent() -> pa.RecordBatch | None:
            nonlocal pending, held
            values = np.concatenate(pending)
            pending, held = [], 0
            values.sort()
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([first, [len(values)]]))
            often = counts >= 2
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.array(values[first][often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.array(np.ones(n, np.int32))], names=names) if n else None

        names = ["_id", "node", "n", "kind"]
        kind = pa.int64()
        for batch, texts in segments(batches, "_text"):
            kind = batch.column(0).type
            doc, grams, sizes = shingle_sets(texts)
            keys = set_keys(doc, grams, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sizes.astype(np.int64)), pa.array(np.zeros(len(keys), np.int32))], names=names)
            pending.append(grams[seen.fresh(keys)[doc]])
            held += len(pending[-1])
            if held > 1_500_000 and (out := frequent()) is not None:
                yield out
        if pending and (out := frequent()) is not None:
            yield out

    id_kind = df.schema[row_id].dataType.simpleString()
    return df.select(F.col(f"`{row_id}`").alias("_id"), F.col("text").alias("_text")).mapInArrow(lean(run), f"_id {id_kind}, node long, n long, kind int")


def _prefixes(texts: list[bytes], common: object, seen: _Seen) -> tuple[np.ndarray, ...] | None:
    """Of texts whose sets are new to the task: their numbers, set keys, sizes, group keys, prefix lengths, places in the prefixes, and prefix shingles."""
    values, ranks = common.value
    doc, grams, sizes = shingle_sets(texts)
    keys = set_keys(doc, grams, sizes)
    new = seen.fresh(keys)
    if not new.any():
        return None
    mine = new[doc]
    doc, grams = doc[mine], grams[mine]
    rank = np.zeros(len(grams), dtype=np.uint8)
    if len(values):
        at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
        rank = np.where(values[at] == grams, ranks[at], 0).astype(np.uint8)
    if rank.any():  # else the shingles are in order: by text, then fingerprint
        order = np.lexsort((grams, rank, doc))
        grams = grams[order]
    own = sizes[new]
    length = own - (PER_CENT * own + 99) // 100 + 1
    begin = np.cumsum(own) - own
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    tokens = grams[np.repeat(begin, length) + inner]
    group = mix(_keys(tokens, length, 2) + own.astype(np.uint64))
    return np.flatnonzero(new), keys[new], own, group, length, inner, tokens


def _listed(df: DataFrame, row_id: str, common: object, repeated: object, buckets: int) -> DataFrame:
    """Rows of members (bucket -1: _id, node, g, size) and, packed by bucket, of prefix shingles with their groups."""
    names = ["bucket", "_id", "node", "g", "size", "tokens", "groups", "sizes", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, groups = _Seen(), _Seen()
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        kind = pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal parts, held
            token, group, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts, held = [], 0
            bucket = ((token >> U64(20)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            rows = [order[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][cut[:-1]]), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())] + [pa.array([x[r].tobytes() for r in rows], pa.binary()) for x in (token, group, size, place)], names=names
            )

        for batch, texts in segments(batches, "_text"):
            kind = batch.column(0).type
            if (found := _prefixes(texts, common, seen)) is None:
                continue
            at, keys, own, group, length, inner, tokens = found
            hit = repeated.value.holds(mix(tokens))
            owner = np.repeat(np.arange(len(at)), length)
            listed = np.bincount(owner[hit], minlength=len(at)) > 0
            n = int(listed.sum())
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, -1)), batch.column(0).take(pa.array(at[listed])), pa.array(keys[listed]), pa.array(group[listed].view(np.int64)), pa.array(own[listed].astype(np.int32))] + [pa.nulls(n, pa.binary())] * 4, names=names
            )
            hit &= groups.fresh(group)[owner]  # a group's shingles go out once a task
            parts.append((tokens[hit], group[owner[hit]], own[owner[hit]].astype(np.uint32), inner[hit].astype(np.uint32)))
            held += int(hit.sum())
            if held > 500_000:
                yield flush()
        if held:
            yield flush()

    id_kind = df.schema[row_id].dataType.simpleString()
    return df.select(F.col(f"`{row_id}`").alias("_id"), F.col("text").alias("_text")).mapInArrow(lean(run), f"bucket long, _id {id_kind}, node long, g long, size int, tokens binary, groups binary, sizes binary, places binary")


def _lists(packed: DataFrame, tasks: int) -> DataFrame:
    """Rows token, g, size, place of prefix shingles that several groups have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, *arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append(arrays)
        while held:
            _, rows = held.popitem()
            token, group, size, place = (np.concatenate([np.frombuffer(r[i], dtype=t) for r in rows]) for i, t in enumerate((np.uint64, np.int64, np.uint32, np.uint32)))
            order = np.lexsort((group, token))
            token, group, size, place = token[order], group[order], size[order], place[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
            token, group, size, place = token[new], group[new], size[new], place[new]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([first, [len(token)]]))
            many = np.repeat(length, length) > 1
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(group[many]), pa.array(size[many].astype(np.int32)), pa.array(place[many].astype(np.int32))], names=["token", "g", "size", "place"])

    return packed.repartition(tasks, "bucket").mapInArrow(lean(run), "token long, g long, size int, place int")


def _need(a: str, b: str) -> str:
    """Shared shingles that sets of these sizes need at least (SQL)."""
    return f"ceil({PER_CENT} * ({a} + {b}) / {100 + PER_CENT})"


def _alike(x: str, y: str) -> str:
    """Whether groups x and y that share a prefix shingle at these places can reach the similarity (SQL).

    Shingles before it that both have are in both prefixes, so in lists: no more than the lesser of
    both ranks there. After it no more than either has left.
    """
    s, t = f"size{x}", f"size{y}"
    most = f"least(rank{x}, rank{y}) + least({s} - place{x}, {t} - place{y})"
    return f"(100 * least({s}, {t}) >= {PER_CENT} * greatest({s}, {t}) and {most} >= {_need(s, t)})"


def _least_common(a: str, b: str) -> str:
    """Prefix shingles that sets of these sizes must share to reach the similarity (SQL), one at least.

    All common shingles up to the nearer end of both prefixes are in both; what else is shared
    comes after that prefix.
    """
    after = f"greatest(({PER_CENT} * {a} + 99) div 100, ({PER_CENT} * {b} + 99) div 100) - 1"
    return f"({_need(a, b)} - ({after}))"


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b with ok: whether their whole sets reach the similarity.

    Each text of a `b` goes once to every route that has pairs with it, so one with many partners is no single task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch, part in segments(batches, "text"):
            _, grams, sizes = shingle_sets(part)
            ends = np.cumsum(sizes)
            rows: list[int] = []
            ok = []
            for i, kind in enumerate(batch.column(2).to_pylist()):
                own = grams[ends[i] - sizes[i] : ends[i]]
                if kind == 0:
                    lead = own
                    continue
                both = np.sort(np.concatenate([own, lead]))
                shared = int((both[1:] == both[:-1]).sum())
                rows.append(i)
                ok.append(100 * shared >= PER_CENT * (len(both) - shared))
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(1).take(at), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    spark = pairs.sparkSession
    routes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pairs.withColumn("route", F.pmod(F.xxhash64("a"), F.lit(routes)))
    member = p.join(texts.withColumnRenamed("node", "a"), "a").selectExpr("route", "b", "1 kind", "a", "text")
    lead = p.select("route", "b").distinct().join(texts.withColumnRenamed("node", "b"), "b").selectExpr("route", "b", "0 kind", "cast(null as bigint) a", "text")
    return member.unionByName(lead).repartition(routes, "route").sortWithinPartitions("route", "b", "kind").mapInArrow(lean(run), "a long, b long, ok boolean")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows node, comp: the smallest node reachable, for all nodes of the edges.

    Each round sends every node to its smallest neighbour's parent and contracts the edges, so
    the edges shrink fast; each round's tables are written, and dropped once they were read.
    """
    links = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            before, labels = labels, written(labels.join(parent, labels["comp"] == parent["a"], "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
            drop_table(before)
        one = parent.select(F.col("a"), F.col("p").alias("x"))
        two = parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        before, links = links, written(links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        drop_table(before)
        if links.isEmpty():
            return labels


def _texts_of(df: DataFrame, row_id: str, chosen: DataFrame) -> DataFrame:
    """Rows node, text of the chosen nodes (rows _id, node); a bitmap of their ids keeps other texts from being shuffled."""
    chosen = written(chosen.withColumn("tag", F.xxhash64("_id")), "chosen")

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield mix(batch.column(0).to_numpy().view(np.uint64))

    among, _ = sketch(chosen.select("tag"), tags, cells_for(chosen.count()), 1)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Sketch = among.value
        for batch in batches:
            hit = known.holds(mix(batch.column(1).to_numpy().view(np.uint64)))
            if hit.any():
                for part, texts in segments(iter([batch.filter(pa.array(hit))]), "text"):
                    keys = set_keys(*shingle_sets(texts))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), part.column(2)], names=["_id", "node", "text"])

    id_kind = df.schema[row_id].dataType.simpleString()
    picked = df.select(F.col(f"`{row_id}`").alias("_id"), F.xxhash64(F.col(f"`{row_id}`")).alias("tag"), "text").mapInArrow(lean(pick), f"_id {id_kind}, node long, text string")
    wanted = chosen.select(F.col("_id").alias("_one"), F.col("node").alias("_node"))
    # repeated rows of an id give a node's text more than once
    return written(picked.join(wanted, (F.col("node") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_one"))).groupBy("node").agg(F.min("text").alias("text")), "chosen-texts")


def linked(df: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """One row per input row: row_id, n_shingles, node (key of its set, null if empty), component_id.

    component_id is the smallest id of its component (its own if it has no words); null ids stay
    in the result, and a component of null ids only has null. Null and empty texts have no
    shingles and are linked with nothing; long texts are read whole. Repeated ids and rows each
    give a row. An empty table gives no rows. Extra columns, whatever their names, are left out.
    """
    spark = df.sparkSession
    # many small partitions are read together, so that a task sees which shingles are frequent
    size = df.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    df = df.select(F.col(f"`{row_id}`"), "text").coalesce(int(max(spark.sparkContext.defaultParallelism, size // TASK_BYTES)))
    scanned = written(_scan(df, row_id), "shingle-scan")
    nodes = scanned.filter("kind = 0").select(F.col("_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    rows, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    top = scanned.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
    values = top.column("node").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(values)
    ranks = np.log2(np.maximum(top.column("n").to_numpy(), 1)).astype(np.uint8) if top.num_rows else np.zeros(0, np.uint8)
    common = spark.sparkContext.broadcast((values[order], ranks[order]))

    def prefix_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen = _Seen()
        for _, texts in segments(batches, "_text"):
            if (found := _prefixes(texts, common, seen)) is not None:
                yield mix(found[-1])

    cells = min(max(CELLS[0], 1 << int(total).bit_length()), CELLS[1])  # about five cells a prefix shingle
    repeated, _ = sketch(df.select(F.col("text").alias("_text")), prefix_shingles, cells, 2)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000_000)
    packed = written(_listed(df, row_id, common, repeated, 4 * tasks), "prefixes")
    lists = _lists(packed.filter("bucket >= 0").select("bucket", "tokens", "groups", "sizes", "places"), tasks)
    # listed: how many of a group's shingles are in lists; rank: how many of them before this one
    own = Window.partitionBy("g")
    lists = written(lists.withColumn("rank", F.row_number().over(own.orderBy("place")) - 1).withColumn("listed", F.count("*").over(own)), "lists")
    # how much of its prefix a group shares with others: the source of near copies more than each of them
    share = lists.groupBy("g").agg((F.count("*") / F.first("size")).alias("share"))
    # nodes of one group share all its shingles, which are in lists with other groups or in none
    members = packed.filter("bucket < 0").groupBy("node").agg(F.min("_id").alias("_id"), F.first("g").alias("g"), F.first("size").alias("size"))
    alone = members.groupBy("g").agg(F.count("*").alias("m"), F.min("node").alias("first"))
    members = written(members.join(alone, "g").join(share, "g", "left").filter("m > 1 or share > 0").select("node", "_id", "g", "size", "first", F.coalesce("share", F.lit(0.0)).alias("share")), "members")
    drop_table(packed)
    tested = spark.createDataFrame([], "a long, b long, ok boolean")
    comps = spark.createDataFrame([], "node long, comp long")

    def test(pairs: DataFrame, name: str) -> bool:
        """Verify the pairs a, b and merge the components of those that are linked; false if there were none to test."""
        nonlocal tested, comps
        pairs = written(pairs.select("a", "b").distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), name)
        if pairs.isEmpty():
            return False
        chosen = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = _texts_of(df, row_id, members.select("node", "_id").join(chosen, "node", "left_semi"))
        done = written(_verified(pairs, texts), "verified")
        drop_table(texts)
        tested = tested.unionByName(done)
        if not done.filter("ok").isEmpty():
            comps = components(tested.filter("ok"))
        return True

    def units() -> DataFrame:
        """Members with their components."""
        return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def held() -> DataFrame:
        """The lists with each group's components and the first node of each."""
        return lists.join(units().groupBy("g", "comp").agg(F.min("node").alias("node"), F.first("share").alias("share")), "g")

    def leads(rows: DataFrame, turn: int) -> DataFrame:
        """Each list's other groups with its first, by share and then by turn; those that have several shingles in common."""
        prefer = F.struct(-F.col("share") if turn == 0 else F.lit(0), F.xxhash64("g", F.lit(turn)), F.col("g"), F.col("node"))
        lead = rows.groupBy("token").agg(F.min_by(F.struct("node", "comp", "size", "place", "rank"), prefer).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").selectExpr("token", "l.node b", "l.comp comp_b", "l.size size_b", "l.place place_b", "l.rank rank_b")
        pairs = rows.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("comp", "size", "place", "rank")], "token").join(lead, "token")
        pairs = pairs.filter("comp_a <> comp_b").filter(_alike("_a", "_b"))
        return pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("size_a").alias("size")).filter("c >= 1 + 0.05 * size").select("a", "b")

    inner = members.filter("node <> first").selectExpr("node a", "first b")
    firsts = lists.join(members.filter("node = first").selectExpr("g", "node", "node comp", "share"), "g")
    going = test(inner.unionByName(leads(firsts, 0)), "first-pairs")
    for turn in range(1, ROUNDS):
        going = going and test(leads(held(), turn), "more-pairs")
    # what is left: pairs of groups across components
    now = written(held(), "held")
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").selectExpr("token", f"(m + {LIST_ROWS - 1}) div {LIST_ROWS} parts")
    open_ = now.join(mixed, "token")
    x = open_.selectExpr("token", "pmod(xxhash64(g, comp), parts) part", "g gx", "comp cx", "size sizex", "place placex", "rank rankx", "listed listedx")
    y = open_.selectExpr("token", "explode(sequence(0l, parts - 1)) part", "g gy", "comp cy", "size sizey", "place placey", "rank ranky", "listed listedy")
    # of the shingles that a pair must share the first is among the first of the group that has fewer in lists
    once = f"cx <> cy and struct(listedx, gx, cx) < struct(listedy, gy, cy) and rankx <= listedx - {_least_common('sizex', 'sizey')}"
    met = x.join(y, ["token", "part"]).filter(once).filter(_alike("x", "y")).groupBy("gx", "gy").agg(F.first("sizex").alias("sx"), F.first("sizey").alias("sy"))
    prefix = now.groupBy("g").agg(F.collect_set("token").alias("p"))
    shared = met.join(prefix.selectExpr("g gx", "p px"), "gx").join(prefix.selectExpr("g gy", "p py"), "gy").withColumn("c", F.size(F.array_intersect("px", "py")))
    # a group whose members are in several components, and lists that no other group shares
    split = units().groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").selectExpr("g gx", "g gy")
    possible = shared.filter(f"gx <> gy and c >= {_least_common('sx', 'sy')}").selectExpr("gx", "gy", "c / least(sx, sy) near")
    possible = written(possible.unionByName(split.withColumn("near", F.lit(1.0))), "candidates")

    def expanded(rows: DataFrame) -> DataFrame:
        a, b = rows.selectExpr("g gx", "node a", "comp ca"), rows.selectExpr("g gy", "node b", "comp cb")
        return possible.join(a, "gx").join(b, "gy").filter("ca <> cb").selectExpr("least(a, b) a", "greatest(a, b) b", "near")

    if not possible.isEmpty():
        # one member of each component of a group first, of those each one's likeliest partner; then all whose components still differ
        for best in (True, False):
            pairs = expanded(units().groupBy("g", "comp").agg(F.min("node").alias("node")))
            if best:
                partner = pairs.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("b"))
                pairs = partner.unionByName(pairs.groupBy("b").agg(F.max_by("a", F.struct("near", "a")).alias("a")).select("a", "b"))
            test(pairs, "group-pairs")
        test(expanded(units()), "member-pairs")
    # copies are one row until here; a set that many documents have is dealt over several tasks
    sets = nodes.filter("node is not null").groupBy("node").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    keyed = sets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = keyed.groupBy("comp").agg(F.min("_least").alias("_first"))
    found = keyed.join(least, "comp").filter("_n > 1 or comp <> node or not _first <=> _least").selectExpr("node _node", "_first", "_n")
    found = written(found, "sets")
    hot = [r[0] for r in found.filter(F.col("_n") * 1000 > rows).select("_node").collect()]  # fewer than 1000
    out = spread_join(nodes, found, "node", "_node", hot, "_id", "left")
    return out.select(F.col("_id").alias(row_id), "n_shingles", "node", F.when(F.col("_node").isNull(), F.col("_id")).otherwise(F.col("_first")).alias("component_id"))


def one_of_each(df: DataFrame) -> DataFrame:
    """The rows whose document is the first of its component; all columns stay, whatever their names.

    Rows that repeat an id with the same text are one document and stay or go together; rows
    with a null id, or with a null or empty text, stay. An empty table stays empty.
    """
    judged = linked(df)
    one, set_key, mine = free_name(df, "one"), free_name(df, "set"), free_name(df, "key")
    drop = judged.filter("doc_id is not null and node is not null and doc_id <> component_id").select(F.col("doc_id").alias(one), F.col("node").alias(set_key)).distinct()
    drop_ids = written(drop, "near-copies")
    # an id that is dropped for one text stays for another: only then are keys of texts compared
    unclear = judged.filter("node is null or doc_id = component_id").select("doc_id").join(drop_ids, F.col("doc_id") == F.col(one), "left_semi")
    if unclear.isEmpty():
        return df.join(drop_ids.select(one).distinct(), F.col("doc_id") == F.col(one), "left_anti")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in segments(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_keys(*shingle_sets(texts)))], names=[*batch.schema.names, mine])

    keyed = df.mapInArrow(lean(key), T.StructType([*df.schema.fields, T.StructField(mine, T.LongType())]))
    return keyed.join(drop_ids, (F.col("doc_id") == F.col(one)) & (F.col(mine) == F.col(set_key)), "left_anti").drop(mine)
