"""Nearest vectors by multiprobe p-stable hashing.

Vectors of inner-product search are first made into points whose Euclidean distance orders
them alike: each is scaled by the largest norm and gets one more component that fills its norm
up to one. So that one large norm does not press all others together, vectors are dealt into
bands of norms within a factor of two, each with a largest norm, hashes and probes of its own. A table's hash is a few whole numbers floor((a . x + b) / w) with normal (2-stable)
a. A query visits, besides its own bucket, those reached by stepping some of the numbers up or
down, in the order of the estimated chance of success. Candidates of all tables are ranked by
their exact inner product. Where the probes that a band needs are more than ``MAX_PROBES``, or a
query finds too few rows, all of its rows are visited in blocks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import hot_keys, save

SEED = 20240229
TABLES = 6
#: Interval width; points lie within the unit ball, so a projection's deviation is one at most.
WIDTH = 2.0
#: Share of the true neighbours that the probes are chosen to find.
RECALL = 0.97
MAX_PROBES = 4000
#: Vectors read to choose the number of probes, and how many of them are queries.
FIT_ROWS = 8192
FIT_QUERIES = 128
#: Vectors of a region that one task holds with its queries; larger regions are split.
REGION_ROWS = 4096
#: Bands of fewer vectors are visited whole.
LEAST_BAND = 256
#: Probes with which the number needed is first looked for, as long lists take time to make.
FIRST_PROBES = 600
#: The table number of vectors without hashes.
NO_TABLE = -1


@dataclass(frozen=True)
class Hashes:
    a: np.ndarray  # tables x functions x dimensions
    b: np.ndarray
    top: float  # largest norm
    probes: int
    coarse: int  # leading functions of a table that name its region

    def project(self, x: np.ndarray) -> np.ndarray:
        """Scaled projections: rows x tables x functions."""
        return (np.einsum("nd,tfd->ntf", x, self.a) + self.b) / WIDTH


def points(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension; queries are scaled to length one."""
    if query:
        return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]
    x = x / top
    return np.c_[x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]


@lru_cache(maxsize=64)
def _template(m: int, count: int) -> np.ndarray:
    """Sets of steps for ``m`` functions, one a row: ranks of steps by their cost, -1 where none, the empty
    set first. Rank j and rank 2m - 1 - j are the two ways of one function whatever the query is. Sets
    come by their expected cost (of order statistics of uniform numbers), twice ``count`` of them, so
    that a query finds its own best among them."""
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, (1 - j / (m + 1) + near)[::-1]]).tolist()
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < 2 * count:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (total + cost[last + 1] - cost[last], (*chosen[:-1], last + 1)))
        if len({min(i, 2 * m - 1 - i) for i in chosen}) == len(chosen):
            out.append(chosen)
    made = np.full((len(out), max(map(len, out))), -1, np.int64)
    for row, some in zip(made, out, strict=True):
        row[:len(some)] = some
    return made


def perturbations(fraction: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` best sets of steps, a row of -1, 0 and 1 for the functions each, for a query that lies
    ``fraction`` of an interval above its lower ends; no step at all first. A step costs the squared
    distance to the border it crosses; sets come by their sum, and none steps one function both ways."""
    m = len(fraction)
    sets = _template(m, min(count, 3 ** m))
    cost = np.concatenate([fraction, 1 - fraction]) ** 2
    order = np.argsort(cost, kind="stable")
    # the two ways of a function stand at mirrored places of the order, also where costs tie
    order[m:] = (order[:m][::-1] + m) % (2 * m)
    total = np.append(cost[order], 0.0)[sets].sum(1)
    best = np.argsort(total, kind="stable")[:count]
    out = np.zeros((len(best), m), np.int8)
    for column in sets[best].T:
        some = np.flatnonzero(column >= 0)
        step = order[column[some]]
        out[some, step % m] = np.where(step < m, -1, 1)
    return out


def _codes(numbers: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of hash numbers."""
    out = np.full(numbers.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(numbers.shape[-1]):
        out = (out ^ numbers[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def probe_codes(place: np.ndarray, probes: int, coarse: int) -> tuple[np.ndarray, np.ndarray]:
    """(region code, bucket code) of the buckets that one table's projections visit, best first."""
    base = np.floor(place)
    numbers = base + perturbations(place - base, probes)
    return _codes(numbers[:, :coarse]), _codes(numbers)


def fit(sample: np.ndarray, total: int, top: float, k: int) -> Hashes | None:
    """Hashes for ``total`` vectors, and the least number of probes with which the sample's queries
    find the ``RECALL`` part of their nearest in the sample. Of these as many are taken as the k
    nearest of all vectors leave in a sample, one at least, so the estimate errs to more probes.
    None where ``MAX_PROBES``, or all sets of single steps, do not find that part."""
    rng = np.random.default_rng(SEED)
    dims = sample.shape[1] + 1
    functions = int(np.clip(round(np.log2(max(2, total)) / 2), 2, 24))
    a = rng.normal(size=(TABLES, functions, dims))
    b = rng.uniform(0, WIDTH, size=(TABLES, functions))
    coarse = int(np.clip(round(np.log2(max(1, total / REGION_ROWS)) / 1.5), 0, functions))
    made = Hashes(a, b, top, 1, coarse)
    queries = sample[:FIT_QUERIES]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    wanted = min(sample.shape[0] - 1, max(1, int(np.ceil(len(sample) * k / max(1, total)))))
    if wanted < 1:
        return made
    v = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted].ravel()
    q = np.repeat(np.arange(len(queries)), wanted)
    of = np.unique(q)
    place = made.project(points(sample[of], top, True))
    code = _codes(np.floor(made.project(points(sample, top, False))))
    limit = min(MAX_PROBES, 3 ** functions)
    missed = limit  # a rank that no probe has
    rank = np.full(len(q), missed)
    for tried in sorted({min(limit, FIRST_PROBES), limit}):
        for i, who in enumerate(of):
            mine = np.flatnonzero((q == who) & (rank == missed))
            for t in range(TABLES if len(mine) else 0):
                _, visited = probe_codes(place[i, t], tried, coarse)
                order = np.argsort(visited, kind="stable")
                at = np.searchsorted(visited[order], code[v[mine], t]).clip(0, len(visited) - 1)
                hit = visited[order][at] == code[v[mine], t]
                rank[mine] = np.minimum(rank[mine], np.where(hit, order[at], missed))
        need = int(np.sort(rank)[int(np.ceil(RECALL * len(rank))) - 1]) + 1
        if need <= limit:
            return Hashes(a, b, top, min(limit, max(2, need)), coarse)
    return None


def visited(hashes: Hashes, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each query a mask of the vectors that its probes visit, in any table."""
    code = _codes(np.floor(hashes.project(points(vectors, hashes.top, False))))
    spots = hashes.project(points(queries, hashes.top, True))
    return np.array([np.logical_or.reduce([np.isin(code[:, t], probe_codes(spot[t], hashes.probes, hashes.coarse)[1]) for t in range(TABLES)])
                     for spot in spots])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(held: dict, query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Keep the k best (score, then smaller id) of a query's candidates."""
    if query in held:
        ids, scores = np.concatenate([held[query][0], ids]), np.concatenate([held[query][1], scores])
        ids, first = np.unique(ids, return_index=True)
        scores = scores[first]
    if len(ids) > k:
        order = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[order], scores[order]
    held[query] = (ids, scores)


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): ids not null with vectors that are finite and not zero, of the most common
    dimension; repeats of id and vector once."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (sizes["n"] if sizes else 0)).dropDuplicates(["id", "v"])


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id meets ``is_query`` (a function of the
    id column) the ``k`` rows of the largest inner product found among all others, ties to smaller ids.

    Null ids and vectors, zero vectors and those with null or non-finite components take no part.
    Equal vectors are indexed once, with their k + 1 smallest ids, and searched for once. Rows
    that share the query's id are not its neighbours. Other columns are not used; an empty table
    gives no rows.
    """
    rows = save(usable_vectors(vectors, id_col, vector_col), "ann-vectors")
    # rep: the smallest id of equal vectors; ids: its smallest k + 1. Hot vectors are cut before the shuffle
    order = Window.partitionBy("v").orderBy("id")
    copies = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    queries = rows.filter(is_query(F.col("id")))
    asked = queries.select("v").distinct().withColumn("asked", F.lit(True))
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    norm = F.aggregate(F.transform("v", lambda x: x / F.col("largest")), F.lit(0.0), lambda s, x: s + x * x)
    distinct = copies.join(asked, "v", "left").withColumn("largest", largest).withColumn("ratio", F.sqrt(norm))
    # bands lie around powers of two, so that vectors of length one are in one band
    band = F.round(F.log2("largest") + F.log2("ratio")).cast("int")
    distinct = save(distinct.select(
        F.xxhash64("v").alias("rep"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), band.alias("band"),
        (F.col("largest") * F.col("ratio")).alias("norm")), "ann-distinct")
    # at most one row for each power of two that a double can have
    bands = distinct.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy("band").collect()
    total = sum(r["n"] for r in bands)
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    hashes = {}
    for r in bands:
        if len(bands) == 1 or r["n"] >= LEAST_BAND:
            some = distinct.filter(F.col("band") == r["band"]).orderBy(F.xxhash64("rep", F.lit(3))).limit(FIT_ROWS).select("v").toArrow()["v"]
            made = fit(_matrix(some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some), r["n"], r["top"], k)
            if made:
                hashes[r["band"]] = made
    found = _search(distinct, hashes, k + 1)
    if hashes:
        found = save(found, "ann-found")
        whole = min(k + 1, total)
        counts = found.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        short = save(distinct.filter("asked").select("rep").join(counts, "rep", "left").filter(
            F.coalesce("n", F.lit(0)) < whole).select("rep", F.lit(True).alias("short")), "ann-short")
        if short.head(1):
            again = distinct.join(short, "rep", "left").withColumn("asked", F.coalesce("short", F.lit(False)))
            found = found.join(short, "rep", "left_anti").unionByName(_search(again, {}, k + 1).select(*found.columns))
    # expand copies: the k + 1 nearest ids of a vector, its own copies included
    near = found.join(distinct.select(F.col("rep").alias("near"), "ids"), "near")
    spread = near.select("rep", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    lists = spread.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("near"))
    lists = save(lists, "ann-lists")
    each = queries.select(F.col("id").alias("query_id"), F.xxhash64("v").alias("rep")).join(lists, "rep")
    own = each.select("query_id", F.expr(f"slice(filter(near, x -> x.id <> query_id), 1, {k})").alias("near"))
    out = own.select("query_id", F.posexplode("near").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _search(distinct: DataFrame, hashes: dict[int, Hashes], k: int) -> DataFrame:
    """(rep, near, score): for every asked vector the ``k`` best distinct vectors among the visited buckets
    of the bands with hashes and all vectors of the others."""
    held = distinct.sparkSession.sparkContext.broadcast(hashes)  # bands x tables x functions x dimensions
    # vectors without hashes meet the queries in blocks of both: each group of queries is a region
    bare = distinct.filter(~F.col("band").isin(list(hashes))) if hashes else distinct
    groups = -(-distinct.filter("asked").count() // REGION_ROWS) if bare.head(1) else 0

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "region", "asks", "rep", "codes", "v"]
        for b in parts:
            every, reps, bands = _matrix(b.column(1)), b.column(0).to_numpy(), b.column(3).to_numpy()
            asked = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
            without = np.flatnonzero(~np.isin(bands, list(held.value)))
            blocks = [(without, np.full(len(without), g), False) for g in range(groups)]
            for some, group, asks in [*blocks, (asked, reps[asked] % groups, True)] if groups else []:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), NO_TABLE, np.int32)), pa.array(group.astype(np.int64)), pa.array([asks] * len(some), pa.bool_()),
                     pa.array(reps[some]), pa.array([[0]] * len(some), pa.list_(pa.int64())), b.column(1).take(pa.array(some))], names)
            for j, (band, h) in enumerate(sorted(held.value.items())):
                here = np.flatnonzero(bands == band)
                x, rep, vectors = every[here], reps[here], b.column(1).take(pa.array(here))
                n = np.floor(h.project(points(x, h.top, False)))
                region, code = _codes(n[..., :h.coarse]), _codes(n)
                for t in range(TABLES if len(here) else 0):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), j * TABLES + t, np.int32)), pa.array(region[:, t]), pa.array([False] * len(x)), pa.array(rep),
                         pa.array([[c] for c in code[:, t].tolist()], pa.list_(pa.int64())), vectors], names)
                spots = h.project(points(every[asked], h.top, True)) if len(asked) else []
                for i, spot in zip(asked, spots, strict=True):
                    out = []
                    for t in range(TABLES):
                        regions, codes = probe_codes(spot[t], h.probes, h.coarse)
                        by = defaultdict(list)
                        for r, c in zip(regions.tolist(), codes.tolist(), strict=True):
                            by[r].append(c)
                        out += [(j * TABLES + t, r, cs) for r, cs in by.items()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([True] * len(out)),
                         pa.array([int(reps[i])] * len(out), pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64())),
                         b.column(1).take(pa.array([int(i)] * len(out), pa.int64()))], names)

    schema = "t int, region long, asks boolean, rep long, codes array<long>, v array<double>"
    dealt = save(distinct.select("rep", "v", "asked", "band").mapInArrow(place, schema), "ann-dealt")
    hot = hot_keys(dealt.filter("not asks"), ["t", "region"], REGION_ROWS, "ann-hot-regions")
    cut = dealt.join(hot, ["t", "region"], "left").withColumn(
        "cuts", F.coalesce(F.ceil(F.col("n_rows") / REGION_ROWS), F.lit(1)).cast("int"))
    one = F.array(F.pmod(F.xxhash64("rep", F.lit(17)), F.col("cuts")).cast("int"))
    cut = cut.select("t", "region", "asks", "rep", "codes", "v", F.explode(
        F.when(F.col("asks"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(one)).alias("cut"))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, reps, rows, asks, best = None, [], [], [], [], {}

        def visit():
            """Rank the asking vectors' visited buckets of the region that ends."""
            if not asks or not rows:
                return
            code, x, rep = np.concatenate(codes), np.concatenate(rows), np.concatenate(reps)
            order = np.argsort(code, kind="stable")
            code, x, rep = code[order], x[order], rep[order]
            wanted, who = np.concatenate([c for _, c, _ in asks]), np.repeat(np.arange(len(asks)), [len(c) for _, c, _ in asks])
            y = np.array([v for _, _, v in asks])
            lo, hi = np.searchsorted(code, wanted), np.searchsorted(code, wanted, "right")
            full = np.flatnonzero(hi > lo)
            full = full[np.argsort(lo[full], kind="stable")]  # the visits of one bucket together
            gathered = defaultdict(list)
            for mine in np.split(full, np.flatnonzero(np.diff(lo[full])) + 1) if len(full) else []:
                begin, end = lo[mine[0]], hi[mine[0]]
                for i, line in zip(who[mine], y[who[mine]] @ x[begin:end].T, strict=True):
                    gathered[int(i)].append((rep[begin:end], line))
            for i, seen in gathered.items():
                _best(best, asks[i][0], np.concatenate([p[0] for p in seen]), np.concatenate([p[1] for p in seen]), k)

        for b in parts:
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(6).to_pylist(), strict=True))
            at = 0
            while at < len(where):
                stop = at
                while stop < len(where) and where[stop] == where[at]:
                    stop += 1
                if where[at] != key:
                    visit()
                    key, codes, reps, rows, asks = where[at], [], [], [], []
                part = b.slice(at, stop - at)
                asking = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                x, rep = _matrix(part.column(5)), part.column(3).to_numpy()
                still = np.flatnonzero(~asking)
                if len(still):
                    taken = part.column(4).take(pa.array(still))
                    codes.append(taken.flatten().to_numpy())
                    reps.append(rep[still])
                    rows.append(x[still])
                for i in np.flatnonzero(asking):
                    asks.append((int(rep[i]), np.array(part.column(4)[int(i)].as_py(), np.int64), x[i]))
                    if len(asks) >= 2048:
                        visit()
                        asks = []
                at = stop
        visit()
        ids = [np.full(len(v[0]), q) for q, v in best.items()]
        none = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(ids) if ids else none), pa.array(np.concatenate([v[0] for v in best.values()]) if ids else none),
             pa.array(np.concatenate([v[1] for v in best.values()]) if ids else none.astype(float))], ["rep", "near", "score"])

    where = ["t", "region", "cut"]
    ordered = cut.select("t", "region", "asks", "rep", "codes", "v", "cut").repartition(*where).sortWithinPartitions(*where, "asks")
    partial = ordered.mapInArrow(search, "rep long, near long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
    top = partial.groupBy("rep", "near").agg(F.max("score").alias("score"))
    return top.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
