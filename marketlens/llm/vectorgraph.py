"""Operator 2: embedding near-duplicates on a robust-pruned flat graph.

1. Equal vectors are one class, which goes on as one point with a weight.
2. Centroids are fitted on a bounded sample (``SAMPLE`` points of smallest hashed
   id); every point belongs to the shards of its two nearest centroids.  A
   crowded cluster is dealt to several shards that overlap in a ring.
3. In each shard every point gets robust-pruned neighbours: going outwards, a
   candidate is kept unless a kept one is nearer to it (by ``ALPHA``) than the
   point is.  The adjacency lists of a point's shards are united.
4. Every point searches the shards of all centroids whose cosine is within a
   margin of its nearest one's (``PROBES`` of them at least): greedily from the
   best of the shard's entry points (its medoid and one member in ``ENTRY``; and from
   itself where it is a member), then on from every member found within range until no
   new one is found.  Where it is a member and has none in range in its list, which its
   nearest one leads, there is nothing to find.
5. What is found is verified in double precision.  Both ends of a link count
   it, also where only one of them searched; a task returns counts and a forest
   of its links, never the pairs.

The margin is set on points held out of the centroids' sample, so the probes grow
with the cells as the data need it: of pairs made just in range, ``MEET`` must
have an end that searches the other's home cell.

``audit`` measures the recall against brute force on a set of queries.

Rows: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different lengths never link; rows that repeat a
vec_id are one vector (with different vectors, that of smallest hash);
rows without a vec_id link with nothing, have no component and are not
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import components, cut, sorted_groups

SAMPLE = 20_000
PER_CLUSTER, MOST_CLUSTERS = 8000, 4096
SHARD, QUERIES = 24_000, 16_384  # members of a shard, queries of a task, about; fewer where vectors are longer than
LENGTH = 128
PROBES, MEET, HELD = 4, 0.995, 4000  # probes at least; share of pairs that meet, on so many held-out points
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
BEAM, WIDE = 24, 12
ENTRY, BLOCK = 8, 256  # one member in so many is an entry point; queries that walk together


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, width: int) -> np.ndarray:
    """A list column as rows, filled up with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means, started from evenly spaced sample rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def probe_margin(x: np.ndarray, size: np.ndarray, c: np.ndarray, least: float) -> float:
    """How far below its nearest centroid's cosine a point must search, so that
    ``MEET`` of the pairs with a cosine of ``least`` meet in the home of one end.

    Each unit vector (of ``size`` components, then zeros) is paired with two
    made ones: one in a random direction, one towards another of the vectors."""
    rng = np.random.default_rng(0)
    there = np.arange(x.shape[1]) < size[:, None]
    s, every = x @ c.T, np.arange(len(x))
    home = np.argmax(s, axis=1)
    margin = 0.0
    for aside in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        aside = aside * there
        aside -= np.einsum("ij,ij->i", aside, x)[:, None] * x
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        y = least * x + np.sqrt(max(0.0, 1 - least**2)) * aside / np.maximum(length, 1e-9)
        t = y @ c.T
        other = np.argmax(t, axis=1)
        # one end is enough
        lacks = np.minimum(s[every, home] - s[every, other], t[every, other] - t[every, home])[length[:, 0] > 1e-6]
        if len(lacks):
            margin = max(margin, float(np.quantile(lacks, MEET, method="higher")))
    return margin


def _cosines(points: np.ndarray, what: np.ndarray, queries: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Of each pair of rows, in pieces that stay in the cache."""
    out = np.empty(len(what), np.float32)
    for lo in range(0, len(what), 1 << 12):
        part = slice(lo, lo + (1 << 12))
        out[part] = np.einsum("ij,ij->i", points.take(what[part], axis=0), queries.take(who[part], axis=0))
    return out


def _nearest(s: np.ndarray, m: int) -> np.ndarray:
    """The columns of the ``m`` largest values of each row: they lie in the ``m``
    runs of 16 columns with the largest maxima, so only those are looked at."""
    rows, n = s.shape
    wide = -(-n // 16)
    if wide <= 4 * m:
        return np.argpartition(-s, m - 1, axis=1)[:, :m]
    full = np.full((rows, 16 * wide), -4, s.dtype)
    full[:, :n] = s
    best = full.reshape(rows, 16, wide).max(axis=1)
    runs = np.argpartition(best, wide - m, axis=1)[:, wide - m:]
    cols = (runs[:, None, :] + np.arange(16)[:, None] * wide).reshape(rows, 16 * m)
    top = np.argpartition(np.take_along_axis(full, cols, 1), 15 * m, axis=1)[:, 15 * m:]
    return np.take_along_axis(cols, top, 1)


def robust_prune(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of unit vectors, the nearest first: those of row i are ``adjacent[first[i]:first[i + 1]]``."""
    n = len(x)
    x = x.astype(np.float32)
    m = min(CANDIDATES, n - 1)
    if m < 1:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    forward = np.full((n, DEGREE), -1, np.int32)
    for lo in range(0, n, 256):
        own = np.arange(lo, min(n, lo + 256))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -3
        cand = _nearest(s, m)
        order = np.argsort(-np.take_along_axis(s, cand, 1), axis=1)
        cand = np.take_along_axis(cand, order, 1)
        far = 1 - np.take_along_axis(s, cand, 1)
        there = x.take(cand, axis=0)
        between = 1 - there @ there.transpose(0, 2, 1)
        dropped = np.zeros(cand.shape, bool)
        count = np.zeros(len(own), np.int64)
        for j in range(m):
            keep = ~dropped[:, j] & (count < DEGREE)
            forward[own[keep], count[keep]] = cand[keep, j]
            count += keep
            # 1 - cosine is half the squared distance, hence alpha squared
            dropped |= keep[:, None] & (ALPHA**2 * between[:, j, :] <= far)
    # every link goes both ways, so no point is without a way to it
    a = np.repeat(np.arange(n), DEGREE)
    b = forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b.astype(np.int64) * n + a]))
    a, b = pairs // n, pairs % n
    order = np.lexsort((-_cosines(x, a, x, b), a))
    return np.searchsorted(a, np.arange(n + 1)), b[order]


def _lists(first: np.ndarray, adjacent: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``nodes`` one after the other, and how long each is."""
    size = first[nodes + 1] - first[nodes]
    return adjacent[np.arange(size.sum()) + np.repeat(first[nodes] - np.cumsum(size) + size, size)], size


def has_near(points: np.ndarray, first: np.ndarray, adjacent: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
    """Whether a member has any other in range.  Its nearest one leads its list, so the list tells."""
    out = np.zeros(len(nodes), bool)
    for lo in range(0, len(nodes), 4096):
        some = nodes[lo:lo + 4096]
        what, size = _lists(first, adjacent, some)
        who = np.repeat(np.arange(len(some)), size)
        out[lo + who[_cosines(points, what, points, some[who]) >= least - 1e-5]] = True
    return out


def entries(points: np.ndarray) -> np.ndarray:
    """Where searches enter a shard: its medoid and every ``ENTRY``-th member."""
    return np.union1d(np.arange(0, len(points), ENTRY), np.argmax(points @ points.mean(axis=0)))


def range_search(points: np.ndarray, first: np.ndarray, adjacent: np.ndarray, queries: np.ndarray, enter: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs found with a cosine of about ``least`` or more.

    Point i's neighbours are ``adjacent[first[i]:first[i + 1]]``.  A query starts
    from the best ``BEAM`` of the points ``enter``, and from the point ``own`` (-1 for
    none).  All queries walk the graph together: each step expands, for every query,
    the best ``WIDE`` points of its beam that are not expanded yet, and every new point in
    range; a query ends when there are none.

    A step costs what it expands; one bit of a query and point tells what was seen
    (the caller asks with blocks of ``BLOCK`` queries)."""
    n, q = len(points), len(queries)
    least32 = np.float32(least - 1e-5)
    s = queries @ points[enter].T
    k = min(BEAM, len(enter))
    who = np.concatenate([np.repeat(np.arange(q), k), np.flatnonzero(own >= 0)])
    what = np.concatenate([enter[np.argpartition(-s, k - 1, axis=1)[:, :k]].ravel(), own[own >= 0]])
    seen = np.zeros(q * n, bool)
    # the beams, best first; an empty place counts as expanded
    value, point, done = np.full((q, BEAM), -3, np.float32), np.zeros((q, BEAM), np.int64), np.ones((q, BEAM), bool)
    found = []

    def new(who, what):
        key = np.sort(who * n + what)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        key = key[~seen[key]]
        seen[key] = True
        return key

    key = new(who, what)
    while len(key):
        who, what = np.divmod(key, n)
        cosine = _cosines(points, what, queries, who)
        near = cosine >= least32
        found.append(key[near])
        up = cosine > value[who, -1]
        w = who[up]
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else w
        size = np.diff(np.append(starts, len(w)))
        for lo in range(0, len(starts), 64):  # few at a time, as one crowd makes all of them wide
            rows, count = w[starts[lo:lo + 64]], size[lo:lo + 64]
            part = slice(starts[lo], starts[lo] + count.sum())
            at = np.repeat(np.arange(len(rows)), count), BEAM + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            merged = [np.concatenate([old[rows], np.full((len(rows), count.max()), blank, old.dtype)], axis=1) for old, blank in ((value, -3), (point, 0), (done, True))]
            for m, now in zip(merged, (cosine[up][part], what[up][part], near[up][part]), strict=True):
                m[at] = now
            top = np.argpartition(-merged[0], BEAM - 1, axis=1)[:, :BEAM]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(merged[0], top, 1), axis=1), 1)
            value[rows], point[rows], done[rows] = (np.take_along_axis(m, top, 1) for m in merged)
        go = ~done
        go &= np.cumsum(go, axis=1) <= WIDE
        done |= go
        by, spot = np.nonzero(go)
        by, nodes = np.concatenate([by, who[near]]), np.concatenate([point[by, spot], what[near]])
        fresh = [np.zeros(0, np.int64)]
        for lo in range(0, len(nodes), 1 << 15):  # a crowd is expanded a part at a time
            next_, size = _lists(first, adjacent, nodes[lo:lo + (1 << 15)])
            fresh.append(new(np.repeat(by[lo:lo + (1 << 15)], size), next_))
        key = np.sort(np.concatenate(fresh)) if len(fresh) > 2 else fresh[-1]
    key = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return np.divmod(key, n)


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (doubles), h1 and h2 of the vectors that can link, one per vec_id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    # + 0.0 makes one zero of the two
    v = v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), F.reverse("vec"), F.size("vec"))})
    return v.groupBy("vec_id").agg(F.min(F.struct("h1", "h2", "vec")).alias("v")).select("vec_id", "v.vec", "v.h1", "v.h2")


def links(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    valid = cut(_valid(vectors), "vectors")
    classes = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    members = valid.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"]).select("vec_id", "id", "weight")
    points = cut(valid.join(classes.select("id", "weight"), F.col("vec_id") == F.col("id")).select("id", "weight", "vec", F.size("vec").alias("size")), "points")
    n, width = points.agg(F.count("*"), F.max("size")).first()
    none = spark.createDataFrame([], "id long, n long, a long, b long")
    found = cut(_search(points, n, width, least), "links") if n else none
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found.where("a is not null")) if n else none.select("id", F.col("n").alias("component_id"))
    linked = (members.join(counts, "id", "left").join(parts, "id", "left")
              .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.where("vec_id is not null").distinct().join(linked, "vec_id", "left").unionByName(ids.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def _search(points: DataFrame, n: int, width: int, least: float) -> DataFrame:
    """Rows (id, n): links counted, and (a, b): a forest of the links."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE + HELD).select("vec", "size").toArrow()
    fitted = sample.slice(0, SAMPLE)
    long = max(1.0, width / LENGTH)
    centres = centroids(_unit(_matrix(fitted["vec"], width)), max(1, min(MOST_CLUSTERS, math.ceil(n * long / PER_CLUSTER), fitted.num_rows)))
    held = sample.slice(max(0, sample.num_rows - HELD))  # a small table has no others than the fitted ones
    margin = probe_margin(_unit(_matrix(held["vec"], width)), held["size"].to_numpy(), centres, least)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _unit(_matrix(batch.column(2), width)) @ centres.T
                top = np.argsort(-s, axis=1, kind="stable").astype(np.int32)
                probes = np.maximum((s >= s.max(axis=1, keepdims=True) - margin).sum(axis=1), min(PROBES, s.shape[1]))
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(probes)]), pa.int32()), pa.array(top[np.arange(s.shape[1]) < probes[:, None]]))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    placed = cut(points.mapInArrow(assign, "id long, weight long, vec array<double>, size int, cells array<int>"), "cells")
    # one row a cluster, at most MOST_CLUSTERS of them
    cell = F.posexplode("cells").alias("rank", "cell")
    load = placed.select(cell).groupBy("cell").agg(F.sum(F.when(F.col("rank") < 2, 1).otherwise(0)).alias("held"), F.count("*").alias("asked")).select(
        "cell", F.greatest(F.lit(1), F.ceil(F.col("held") * long / SHARD)).cast("int").alias("shards"), F.ceil(F.col("asked") * long / QUERIES).cast("int").alias("chunks"))

    dealt = placed.select("*", cell).join(load, "cell")
    own = F.pmod(F.xxhash64("id", "cell"), "shards").cast("int")
    # home and second shard; the members of a split cluster also go to the next one
    stay = (dealt.where("rank < 2").withColumn("shard", own).withColumn("home", F.col("rank") == 0)
            .withColumn("spot", F.explode(F.when((F.col("shards") > 1) & (F.col("rank") == 0), F.array(F.struct("shard", "home"), F.struct(F.pmod(F.col("shard") + 1, "shards").alias("shard"), F.lit(False).alias("home")))).otherwise(F.array(F.struct("shard", "home")))))
            .select("cell", "spot.shard", "spot.home", "id", "weight", "vec", "size", "cells", "chunks"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            ids = group.column("id").to_numpy()
            first, adjacent = robust_prune(_unit(_matrix(group.column("vec"), width)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids[adjacent]))], ["id", "near"])

    lists = stay.select("cell", "shard", "id", "vec").repartition("cell", "shard").sortWithinPartitions("cell", "shard", "id").mapInArrow(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # of three shards at most

    spread = lambda df, number: df.withColumn("chunk", F.explode(number))
    indexed = spread(stay.join(united, "id"), F.sequence(F.lit(0), F.col("chunks") - 1)).select("cell", "shard", "chunk", F.lit(0).alias("role"), "id", "weight", "vec", "size", "cells", "home", "near")
    asking = spread(dealt, F.array(F.pmod(F.xxhash64(F.lit(7), "id"), "chunks").cast("int"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asking = asking.select("cell", "shard", "chunk", F.lit(1).alias("role"), "id", "weight", "vec", "size", F.slice("cells", 1, 1).alias("cells"), F.lit(False).alias("home"), F.lit(None).cast("array<long>").alias("near"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            role = group.column("role").to_numpy()
            m, q = (group.filter(pa.array(role == r)) for r in (0, 1))
            if not (m.num_rows and q.num_rows):
                continue
            here = group.column("cell")[0].as_py()
            ids, asked = m.column("id").to_numpy(), q.column("id").to_numpy()
            raw, raw_q = _matrix(m.column("vec"), width), _matrix(q.column("vec"), width)
            x, y = _unit(raw), _unit(raw_q)
            norm, norm_q = np.linalg.norm(raw, axis=1), np.linalg.norm(raw_q, axis=1)
            weight, weight_q = m.column("weight").to_numpy(), q.column("weight").to_numpy()
            size, size_q = m.column("size").to_numpy(), q.column("size").to_numpy()
            home = m.column("home").to_numpy(zero_copy_only=False).astype(bool)
            lists = m.column("cells").to_pylist()
            cells = np.full((m.num_rows, max(map(len, lists))), -1)
            for i, c in enumerate(lists):
                cells[i, :len(c)] = c
            home_q = np.array([c[0] for c in q.column("cells").to_pylist()])
            # members in id order (as sorted): neighbours that are not here drop out
            near = m.column("near").combine_chunks()
            sizes = np.diff(near.offsets.to_numpy())
            flat = near.flatten().to_numpy()
            at = np.searchsorted(ids, flat)
            at[at == len(ids)] = 0
            here_too = ids[at] == flat
            adjacent = at[here_too]
            first = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(ids)), sizes)[here_too], minlength=len(ids)))])
            x32, y32, enter = x.astype(np.float32), y.astype(np.float32), entries(x)
            n_m, n_q = np.zeros(len(ids), np.int64), np.zeros(len(asked), np.int64)
            root, link = np.arange(len(ids)), np.full(len(asked), -1)
            self_at = np.searchsorted(ids, asked)
            self_at[self_at == len(ids)] = 0
            self_at = np.where(ids[self_at] == asked, self_at, -1)
            # a member with none in range is done
            lone = self_at >= 0
            lone[lone] = ~has_near(x32, first, adjacent, self_at[lone], least)
            walk = np.flatnonzero(~lone)
            for lo in range(0, len(walk), BLOCK):
                block = walk[lo:lo + BLOCK]
                who, what = range_search(x32, first, adjacent, y32[block], enter, self_at[block], least)
                who = block[who]
                ok = (ids[what] != asked[who]) & (size[what] == size_q[who])
                who, what = who[ok], what[ok]
                exact = np.empty(len(who))
                for p in range(0, len(who), 1 << 16):
                    part = slice(p, p + (1 << 16))
                    exact[part] = np.einsum("ij,ij->i", raw[what[part]], raw_q[who[part]]) / (norm[what[part]] * norm_q[who[part]])
                who, what = who[exact >= least], what[exact >= least]
                # a member counts where it lives; where it does not search the
                # asking point's home, the point's find is the only one there is
                lives = home[what]
                np.add.at(n_q, who[lives], weight[what[lives]])
                blind = lives & (home_q[who] != here) & ~(cells[what] == home_q[who][:, None]).any(axis=1)
                np.add.at(n_m, what[blind], weight_q[who[blind]])
                # points found by one query are one tree
                while len(who):
                    low = np.full(block[-1] - block[0] + 1, len(ids))
                    np.minimum.at(low, who - block[0], root[what])
                    rename = np.arange(len(ids))
                    np.minimum.at(rename, root[what], low[who - block[0]])
                    if (rename[root] == root).all():
                        break
                    root = rename[root]
                if len(who):
                    link[who] = what
            tree = np.flatnonzero(root != np.arange(len(ids)))
            bound = np.flatnonzero(link >= 0)
            a = np.concatenate([ids[tree], asked[bound]])
            b = np.concatenate([ids[root[tree]], ids[root[link[bound]]]])
            keep_m, keep_q = np.flatnonzero(n_m), np.flatnonzero(n_q)
            some = np.concatenate([ids[keep_m], asked[keep_q]])
            blank = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.concatenate([n_m[keep_m], n_q[keep_q]])), blank(len(some)), blank(len(some))], ["id", "n", "a", "b"])
            yield pa.RecordBatch.from_arrays([blank(len(a)), blank(len(a)), pa.array(a), pa.array(b)], ["id", "n", "a", "b"])

    both = indexed.unionByName(asking).repartition("cell", "shard", "chunk").sortWithinPartitions("cell", "shard", "chunk", "role", "id")
    return both.mapInArrow(search, "id long, n long, a long, b long")


def audit(vectors: DataFrame, found: DataFrame, least: float = 0.9, every: int = 100) -> DataFrame:
    """Recall of ``found`` (from ``links``) against brute force: one row with the
    links of the vectors whose id is divisible by ``every``, and how many were found.

    The queries are a stated set; they meet every vector in groups of one block
    of queries and one part of the vectors, both of bounded size."""
    valid = cut(_valid(vectors).select("vec_id", "vec", (F.col("vec_id") % every == 0).alias("asks")), "audit")
    n, asks = valid.agg(F.count("*"), F.count_if("asks")).first()
    parts, blocks = max(1, -(-n // 20_000)), max(1, -(-asks // 2_000))
    deal = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = valid.where("asks").withColumn("part", all_(parts)).withColumn("block", deal(blocks)).withColumn("role", F.lit(0))
    right = valid.withColumn("part", deal(parts)).withColumn("block", all_(blocks)).withColumn("role", F.lit(1))

    def compare(rows):
        import pandas as pd

        q, v = rows[rows.role == 0], rows[rows.role == 1]
        width = max(map(len, rows.vec))
        pad = lambda s: np.array([np.pad(x, (0, width - len(x))) for x in s]).reshape(len(s), width)
        hits = _unit(pad(q.vec)) @ _unit(pad(v.vec)).T >= least
        hits &= q.vec.map(len).to_numpy(int)[:, None] == v.vec.map(len).to_numpy(int)[None, :]
        hits &= q.vec_id.to_numpy()[:, None] != v.vec_id.to_numpy()[None, :]
        return pd.DataFrame({"vec_id": q.vec_id, "n": hits.sum(axis=1)})

    true = left.unionByName(right).groupBy("block", "part").applyInPandas(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    return true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("n").alias("links"), F.sum(F.least("n", "n_links")).alias("found"))
