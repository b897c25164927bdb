"""Exact top-k search by inner product, with norm-bucketed retrieval.

A task sorts the candidates of a batch by length and cuts them into buckets of similar length. With a
query's k-th best score so far and a bucket's greatest length comes a local cosine threshold: above 1
the bucket is passed over whole. Otherwise the query prunes by length (candidates too short for any
angle) or by a coordinate (the query's largest: candidates outside the interval that the threshold
leaves), whichever leaves fewer, and only what is left is multiplied and verified. Bounds are widened by
a small margin, so that rounding never loses a candidate; scores are exact integers. Vectors with a component of 2^28 or
more, beyond which sums of products may not fit a double, go a way of their own: products in doubles with a bound on their error say
which pairs can matter, and these are multiplied as integers of any size. Results of both ways are ordered by the exact
score as bytes (``sortable``).

Queries go out in chunks of about ``chunk`` vectors, one after the other: a chunk is broadcast (its size is bounded),
met with all candidates in one pass, and its result written; a task keeps k results for each query of the chunk. A pass reads
the vectors once more for ``chunk`` queries, which costs little beside their ``chunk`` products with each. Of equal vectors in a bucket only
those with the k + 1 smallest ids can matter, so that one common vector costs nothing.

Cases: vectors that are null, or hold a null or non-finite component, take no part, nor do rows with a
null id; a score beyond 64 bits is ranked as it is and returned as the nearest 64-bit integer; shorter vectors count as padded with zeros; ties go to the smaller id;
of rows with one id the best score counts, and none is a candidate of a query with that id;
further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHUNK, BUCKET, SHORTEST = 8192, 4096, 0.9
_LIMIT = float(1 << 28)


def usable(vec: Column) -> Column:
    """No null and no non-finite component."""
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))


def quantised(vec: Column, scale: float) -> Column:
    """floor(scale * x) as a double; from 2^52 on a double is whole, and ``floor``, which gives a 64-bit integer, isn't needed."""

    def each(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vec, each)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of doubles as a matrix, padded with zeros."""
    flat, lengths = np.asarray(column.flatten(), np.float64), np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, np.int64)
    width = int(lengths.max(initial=0)) if width is None else max(width, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Best:
    """The k best (score, id) of each query so far, distinct ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.row, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -np.inf)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        by = np.lexsort((-score, ids, row))
        row, ids, score = row[by], ids[by], score[by]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])]) if len(row) else np.empty(0, bool)
        row, ids, score = row[new], ids[new], score[new]
        by = np.lexsort((ids, -score, row))
        row, ids, score = row[by], ids[by], score[by]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]
        last = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.k - 1
        self.floor[self.row[last]] = self.score[last]


def product(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer-valued rows; ``bound`` is on the products of lengths."""
    if bound < 1 << 24:
        return a.astype(np.float32) @ b.T.astype(np.float32)
    return a @ b.T if bound < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)


def without_surplus_copies(ids: np.ndarray, vecs: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of equal vectors those with the k + 1 smallest ids."""
    raw = np.ascontiguousarray(vecs).view([("", np.void, vecs.shape[1] * vecs.itemsize)]).ravel() if vecs.shape[1] else np.zeros(len(ids), np.int8)
    group = np.unique(raw, return_inverse=True)[1]
    by = np.lexsort((ids, group))
    rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    return np.sort(by[rank <= k])


def search(best: Best, qids: np.ndarray, queries: np.ndarray, q_len: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
    """Meet the queries with a batch of candidates of distinct ids."""
    keep = without_surplus_copies(ids, vecs, best.k)
    ids, vecs = ids[keep], vecs[keep]
    length = np.sqrt((vecs * vecs).sum(1))
    by = np.argsort(-length, kind="stable")
    ids, vecs, length = ids[by], vecs[by], length[by]
    lo = 0
    while lo < len(ids):
        hi = min(lo + BUCKET, int(np.searchsorted(-length, -SHORTEST * length[lo], "right")))
        hi = max(hi, lo + 1)
        bucket(best, qids, queries, q_len, ids[lo:hi], vecs[lo:hi], length[lo:hi])
        lo = hi


def bucket(best: Best, qids: np.ndarray, queries: np.ndarray, q_len: np.ndarray, ids: np.ndarray, vecs: np.ndarray, length: np.ndarray) -> None:
    """One bucket, its candidates by falling length."""
    n, top = len(ids), length[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((best.floor > 0) & (q_len * top > 0), best.floor / (q_len * top), np.where(best.floor > 0, np.inf, -1.0))
    alive = np.flatnonzero(local <= 1 + 1e-9)  # a local cosine above 1 can't be reached
    need = np.where(local[alive] > 0, best.floor[alive] / np.maximum(q_len[alive], 1e-300) * (1 - 1e-9), 0.0)
    by_length = np.searchsorted(-length, -need, "right")
    dense, rows, cols, scores = [], [], [], []
    unit, ordered = None, {}
    for i, q in enumerate(alive):
        if local[q] <= 0 or by_length[i] < 64:
            dense.append(i)
            continue
        if unit is None:
            unit = vecs / np.maximum(length, 1e-300)[:, None]
        f = int(np.abs(queries[q]).argmax())
        if f not in ordered:
            at = np.argsort(unit[:, f], kind="stable")
            ordered[f] = at, unit[at, f]
        at, values = ordered[f]
        c, t = queries[q, f] / q_len[q], min(1.0, local[q])
        spread = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c)))
        a, b = np.searchsorted(values, [t * c - spread - 1e-9 if -c < t else -2.0, t * c + spread + 1e-9 if c < t else 2.0])
        if b - a > 0.25 * by_length[i]:
            dense.append(i)
        elif b > a:
            some = at[a:b]
            got = product(queries[q : q + 1], vecs[some], float(q_len[q] * top))[0]
            some, got = some[got >= best.floor[q]], got[got >= best.floor[q]]
            rows.append(np.full(len(some), q))
            cols.append(some)
            scores.append(got)
    for part in range(0, len(dense), 512):
        at = np.array(dense[part : part + 512])
        q, m = alive[at], int(by_length[at].max(initial=0)) if (local[alive[at]] > 0).all() else n
        if not m:
            continue
        got = product(queries[q], vecs[:m], float(q_len[q].max() * top)).astype(np.float64 if q_len[q].max() * top < 1 << 53 else np.int64)
        own = qids[q][:, None] == ids[None, :m]
        seen = np.where(own, -np.inf, got) if got.dtype == np.float64 else got
        kth = np.partition(seen, m - best.k - 1, axis=1)[:, m - best.k - 1] if m > best.k else np.full(len(q), -np.inf)
        r, c = np.nonzero((got >= np.maximum(kth, best.floor[q])[:, None]) & ~own)
        rows.append(q[r])
        cols.append(c)
        scores.append(got[r, c])
    if rows:
        r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
        other = ids[c] != qids[r]
        best.add(r[other], ids[c[other]], s[other].astype(np.int64))


def wide_search(found: dict[int, list[tuple[int, int]]], k: int, qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
    """Meet queries with candidates where either may have large components: ``found`` keeps the k best (-score, id) of each query.

    Every pair whose product in doubles, with its error, may reach the k-th best is multiplied as integers.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        sizes = np.sqrt((vecs * vecs).sum(1))
        for q in range(len(qids)):
            near = vecs @ queries[q]
            error = (vecs.shape[1] + 4) * 2.0**-52 * sizes * np.sqrt(queries[q] @ queries[q])
            low = np.where(np.isfinite(near - error), near - error, -np.inf)
            other = ids != qids[q]
            low[~other] = -np.inf
            kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            exact = list(map(int, queries[q].tolist()))
            best = dict((i, s) for s, i in found.get(q, ()))
            for c in np.flatnonzero(other & ~(near + error < kth)):
                score, i = -sum(x * y for x, y in zip(exact, map(int, vecs[c].tolist()), strict=True)), int(ids[c])
                best[i] = min(score, best.get(i, score))
            found[q] = sorted((s, i) for i, s in best.items())[:k]


def sortable(score: int) -> bytes:
    """Bytes in the order of integers of any size: sign, number of bytes and magnitude, complemented below zero."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(2) + abs(score).to_bytes(size)
    return b"\x01" + raw if score >= 0 else b"\x00" + bytes(255 - b for b in raw)


def layers(ids: np.ndarray):
    """Row sets of distinct ids that hold all rows together."""
    by = np.argsort(ids, kind="stable")
    nth = np.empty(len(ids), np.int64)
    nth[by] = np.arange(len(ids)) - np.searchsorted(ids[by], ids[by])
    for k in range(int(nth.max(initial=-1)) + 1):
        yield np.flatnonzero(nth == k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, scale: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, id, score: for each query row the k rows of other ids with the highest inner products.

    Components are floor(scale * x), so that scores are integers.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw")).where(F.col("id").isNotNull() & usable(F.col("raw")))
        return kept.select("id", quantised(F.col("raw"), scale).alias("vec"))

    asked, rows = ready(queries), ready(vectors)
    parts = max(1, -(-asked.count() // chunk))
    found = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).distinct().toArrow()
        qids, qvecs = np.asarray(some.column(0), np.int64) if some.num_rows else np.empty(0, np.int64), matrix(some.column(1).combine_chunks()) if some.num_rows else np.empty((0, 0))
        shared = spark.sparkContext.broadcast((qids, qvecs))

        def run(batches, shared=shared):
            qids, qvecs = shared.value
            large = (np.abs(qvecs) >= _LIMIT).any(1)
            usual, great = np.flatnonzero(~large), np.flatnonzero(large)
            best, q_len, wide = Best(len(usual), k), np.sqrt((qvecs[usual] * qvecs[usual]).sum(1)), {}
            for batch in batches:
                ids, vecs = np.asarray(batch.column(0), np.int64), matrix(batch.column(1), qvecs.shape[1])
                width = vecs.shape[1]
                asked_vecs = qvecs if qvecs.shape[1] == width else np.pad(qvecs, ((0, 0), (0, width - qvecs.shape[1])))
                high = (np.abs(vecs) >= _LIMIT).any(1)
                for rows in layers(ids) if len(qids) else ():
                    low = rows[~high[rows]]
                    if len(usual) and len(low):
                        search(best, qids[usual], asked_vecs[usual], q_len, ids[low], vecs[low])
                    for some, which in ((great, low), (np.arange(len(qids)), rows[high[rows]])):
                        if len(some) and len(which):
                            part = {n: wide[q] for n, q in enumerate(some.tolist()) if q in wide}
                            wide_search(part, k, qids[some], asked_vecs[some], ids[which], vecs[which])
                            wide.update((int(some[n]), kept) for n, kept in part.items())
            out = list(zip(qids[usual][best.row].tolist() if len(usual) else [], best.id.tolist(), best.score.tolist(), strict=True)) + [(int(qids[q]), i, -s) for q, kept in wide.items() for s, i in kept]
            clipped = [max(-(1 << 63), min((1 << 63) - 1, s)) for _, _, s in out]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([sortable(r[2]) for r in out], pa.binary()), pa.array(clipped, pa.int64())], ["query_id", "id", "key", "score"])

        merged = rows.mapInArrow(run, "query_id long, id long, key binary, score long").groupBy("query_id", "id").agg(F.max("key").alias("key"), F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
        here = written(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score"))
        shared.destroy()  # one chunk at a time is on the driver and the executors
        found = here if found is None else found.union(here)
    return found
