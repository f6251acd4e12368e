"""The most similar vectors of every vector, by several shifted Hilbert orderings.

1. Usable vectors have the asked number of finite components, not all zero. Equal vectors form a class; only the class with
   its smallest id takes part in the search, so copies cost nothing however many there are.
2. For each of ``curves`` orderings the vectors are projected onto ``DIMS`` random orthogonal directions, shifted, and put in the
   order of a Hilbert curve. Each ordering is cut into ranges of about ``RANGE`` vectors at quantiles taken from a sample of
   about ``PER_RANGE`` vectors a range (chosen by a hash of their ids), which the cluster aggregates; every vector is indexed.
3. Within a range, every block of ``block`` neighbours along the curve meets itself and the next block: products in single
   precision choose pairs near the least cosine, double precision decides. The best k of every vector leave the task.
   Windows do not cross the ends of a range, a small share of each ordering; the other orderings have their ends elsewhere.
4. The orderings' lists merge to the best k classes of each class, which their ids then spell out: of a class no more than k + 1
   ids can ever be needed.

Neighbours are ordered by cosine rounded to 9 decimals, descending, then by id. The result is approximate: a pair that no ordering
brings within a window is missed.

Cases: null vectors, vectors with a null, NaN or infinite component, of another length or all zero are unusable and in no result;
rows repeated under one id count once; a vector without neighbours has no rows; an empty table gives an empty result. Ids must not
be null (such rows are dropped). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.curves import hilbert_keys, to_cells
from skein.plans.cut import cut

DIMS, BITS = 10, 6
PER_RANGE, RANGE = 300, 60_000


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Columns id, v (array of float); one row per id."""
    v = F.col("v")
    ok = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & ok).dropDuplicates(["id"])


def _directions(curve: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions and shifts of one ordering, the same in every process."""
    rng = np.random.default_rng([11, curve])
    q, _ = np.linalg.qr(rng.standard_normal((size, min(DIMS, size))))
    return q.astype(np.float32), rng.uniform(-0.5, 0.5, min(DIMS, size)).astype(np.float32)


def _keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Places of unit vectors along one ordering; a component of a random unit vector has a deviation of 1 / sqrt(size)."""
    q, shift = _directions(curve, unit.shape[1])
    scaled = unit @ q * np.float32(np.sqrt(unit.shape[1])) + shift
    return hilbert_keys(to_cells(scaled, -4.0, 4.0, BITS), BITS)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    return (d / np.sqrt(np.einsum("ij,ij->i", d, d))[:, None]).astype(np.float32)


def best_of(a: np.ndarray, b: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best k rows of each a, by descending cosine and ascending b, of rows that may repeat."""
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, cos = a[new], b[new], cos[new]
    start = np.ones(len(a), dtype=bool)
    start[1:] = a[1:] != a[:-1]
    at = np.arange(len(a))
    keep = at - np.maximum.accumulate(np.where(start, at, 0)) < k
    return a[keep], b[keep], cos[keep]


def window_pairs(ids: np.ndarray, v: np.ndarray, least: float, block: int) -> tuple[np.ndarray, ...]:
    """Pairs of a range in curve order that share a window and have at least the cosine, with their cosines."""
    unit, found = _unit(v), []
    for s in range(0, len(ids), block):
        e, f = min(s + block, len(ids)), min(s + 2 * block, len(ids))
        near = unit[s:e] @ unit[s:f].T >= np.float32(least - 1e-4)
        near[:, : e - s] &= np.tri(e - s, k=-1, dtype=bool).T
        i, j = np.nonzero(near)
        found.append((i + s, j + s))
    i, j = (np.concatenate(x) for x in zip(*found))
    cos = np.empty(len(i))
    norm = np.sqrt(np.einsum("ij,ij->i", v.astype(np.float64), v.astype(np.float64)))
    for s in range(0, len(i), 100_000):
        x, y = i[s : s + 100_000], j[s : s + 100_000]
        cos[s : s + 100_000] = np.einsum("ij,ij->i", v[x].astype(np.float64), v[y].astype(np.float64)) / (norm[x] * norm[y])
    cos = cos.round(9)
    keep = cos >= least
    return ids[i[keep]], ids[j[keep]], cos[keep]


def _edges(reps: DataFrame, size: int, curves: int, ranges: int) -> list[np.ndarray]:
    """Per ordering the places at which its ranges begin, but for the first. Only these come to the driver, not the sample."""
    if ranges == 1:
        return [np.zeros(0, dtype=np.int64)] * curves
    sample = reps.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, RANGE // PER_RANGE))) == 0).select("v")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column(0), size))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), c, dtype=np.int32)), pa.array(_keys(unit, c))], ["curve", "key"])

    shares = [i / ranges for i in range(1, ranges)]
    found = sample.mapInArrow(keys, "curve int, key bigint").groupBy("curve").agg(F.percentile_approx("key", shares, 20 * ranges).alias("edges")).collect()
    by = {r.curve: np.array(r.edges, dtype=np.int64) for r in found}
    return [by.get(c, np.zeros(0, dtype=np.int64)) for c in range(curves)]


def similar_classes(reps: DataFrame, size: int, k: int, least: float, curves: int, block: int) -> DataFrame:
    """reps: id, v. The best k of each id among the others that any ordering brings near: a, b, cos."""
    ranges = max(1, -(-reps.count() // RANGE))
    edges = _edges(reps, size, curves, ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), size)
            unit = _unit(v)
            raw = pa.array([row.tobytes() for row in v], pa.binary())
            for c in range(curves):
                key = _keys(unit, c)
                part = c * ranges + np.searchsorted(edges[c], key, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(key), b.column(0), raw], ["part", "key", "id", "v"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        part, key, ids = (whole[n].to_numpy() for n in ("part", "key", "id"))
        v = np.frombuffer(b"".join(whole["v"].to_pylist()), dtype=np.float32).reshape(-1, size)
        order = np.lexsort((ids, key, part))
        ids, v, part = ids[order], v[order], part[order]
        for p in np.unique(part):  # one, unless parts share a task
            s, e = np.searchsorted(part, [p, p + 1])
            x, y, cos = window_pairs(ids[s:e], v[s:e], least, block)
            a, b, cos = best_of(np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([cos, cos]), k)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos)], ["a", "b", "cos"])

    placed = reps.select("id", "v").mapInArrow(place, "part int, key bigint, id bigint, v binary").repartitionById(curves * ranges, "part")
    found = placed.mapInArrow(windows, "a bigint, b bigint, cos double").distinct()
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def neighbours(df: DataFrame, key: str, vector: str, size: int, k: int, least: float, curves: int = 16, block: int = 256) -> DataFrame:
    """Columns id, place (from 1), other, cos: the k most similar others of every usable vector, at the least cosine or more."""
    same = [F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")]
    rows = usable(df, key, vector, size).select("id", "v", *same)
    reps = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"), F.count("*").alias("n")))
    members = cut(rows.drop("v").join(reps.select("h1", "h2", F.col("id").alias("rep"), "n"), ["h1", "h2"]).select("id", "rep", "n"))
    near = similar_classes(reps, size, k, least, curves, block)

    first = Window.partitionBy("rep").orderBy("id")
    copies = members.filter(F.col("n") > 1).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("rep", "id")
    heads = copies.unionByName(members.filter(F.col("n") == 1).select("rep", "id"))
    listed = near.join(heads.select(F.col("rep").alias("b"), F.col("id").alias("other")), "b").select(F.col("a").alias("rep"), "other", "cos")
    listed = listed.unionByName(copies.select("rep", F.col("id").alias("other"), F.lit(1.0).alias("cos")))
    order = Window.partitionBy("rep").orderBy(F.desc("cos"), "other")
    best = listed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = best.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "other", "cos"))).alias("list"))
    own = members.join(lists, "rep").select("id", F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k).alias("list"))
    return own.select("id", F.posexplode("list").alias("p", "x")).select("id", (F.col("p") + 1).alias("place"), F.col("x.other").alias("other"), F.col("x.cos").alias("cos"))
