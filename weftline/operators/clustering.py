"""Clusters of texts by TF-IDF of hashed grams, by k-means.

Grams become counts by bucket once, a sparse row a document, written to the scratch folder. Each pass of k-means reads these rows
in Arrow tasks, which hold the centres and their sums as numpy arrays: k times the number of buckets, whatever the corpus's size.
Seeds are drawn as k-means++ does, by random numbers that hang on the seed and the document's id: no result depends on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.scratch import Scratch

#: Entries that a task works on at a time, and buckets whose sums go out as one value.
SLICE = 2_000_000
BLOCK = 1 << 14
_ROWS = "doc_id long, ids binary, counts binary"


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids, row of each entry, buckets, counts of slices of a batch of rows (doc_id, ids, counts)."""
    docs = np.asarray(batch.column("doc_id"))
    raw, counts = batch.column("ids"), batch.column("counts")
    sizes = np.array([len(x) // 4 for x in (v.as_buffer() for v in raw)], np.int64)
    part = np.cumsum(sizes) // SLICE
    for p in np.unique(part):
        rows = np.flatnonzero(part == p)
        a, n = int(rows[0]), len(rows)
        ids, tf = (np.frombuffer(b"".join(c.slice(a, n).to_pylist()), t) for c, t in ((raw, np.int32), (counts, np.float32)))
        yield docs[a : a + n], np.repeat(np.arange(n), sizes[a : a + n]), ids, tf.astype(np.float64)


def counted(grams: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """doc_id, ids, counts: the buckets of each document (doc_id, buckets: array<int>) with their counts, as packed numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ids, counts = [], []
            for i in range(len(lists)):
                b, n = np.unique(np.asarray(lists[i].values, np.int32), return_counts=True)
                ids.append(b.tobytes())
                counts.append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "ids", "counts"])

    return scratch.save(grams.mapInArrow(work, _ROWS), "counts")


def _sums(rows: DataFrame, work, names: list[str], size: int) -> dict[str, np.ndarray]:
    """Sums by name of the arrays that work(batches) -> {name: array of ``size``} gives in each task, added block by block."""
    schema = "name string, block int, part binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, values in work(batches).items():
            for at in range(0, len(values), BLOCK):
                part = values[at : at + BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["name", "block", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("part"):
                part = np.frombuffer(x.as_buffer(), np.float64)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["name", "block", "part"])

    out = {name: np.zeros(size) for name in names}
    for r in rows.mapInArrow(each, schema).groupBy("name", "block").applyInArrow(add, schema).collect():  # len(names) * size numbers
        part = np.frombuffer(r.part, np.float64)
        out[r.name][r.block * BLOCK : r.block * BLOCK + len(part)] = part
    return out


def _distances(docs: int, row: np.ndarray, ids: np.ndarray, w: np.ndarray, centres: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances of each document to each centre (a column of ``centres``, so that an entry meets all in one place)."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    dots, own = np.zeros((docs, len(norms))), np.zeros(docs)
    if len(starts):
        dots[row[starts]] = np.add.reduceat(centres[ids] * w[:, None], starts, axis=0)
        own[row[starts]] = np.add.reduceat(w * w, starts)
    return np.maximum(own[:, None] - 2 * dots + norms, 0)


class Clusters:
    """k-means over hashed grams: ``vocabulary`` (buckets in use), ``centres`` (k rows over all buckets), ``assigned``."""

    def __init__(self, grams: DataFrame, buckets: int, k: int, seed: int, steps: int = 20, tolerance: float = 1e-4, least: int = 2, most: float = 0.9):
        self.spark, self.size = grams.sparkSession, buckets
        rows = counted(grams, buckets, Scratch(self.spark, "clusters"))
        self.rows = rows.coalesce(max(1, self.spark.sparkContext.defaultParallelism))  # a task sends k * buckets sums, so one a core
        n = rows.count()

        def frequencies(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            df = np.zeros(buckets)
            for batch in batches:
                for _, _, ids, _ in _pieces(batch):
                    df += np.bincount(ids, minlength=buckets)
            return {"df": df}

        df = _sums(self.rows, frequencies, ["df"], buckets)["df"]
        used = (df >= least) & (df <= most * n)
        self.vocabulary = np.flatnonzero(used)
        self.weights = self.spark.sparkContext.broadcast(np.where(used, np.log((n + 1) / (df + 1)), 0.0))
        self.centres = self._seeds(k, seed)
        for _ in range(steps):
            before = self.centres
            self.centres = self._moved()
            if (((self.centres - before) ** 2).sum(1) <= tolerance**2).all():
                break

    def _shared(self):
        return self.spark.sparkContext.broadcast((np.ascontiguousarray(self.centres.T), (self.centres**2).sum(1))), self.weights

    def _seeds(self, k: int, seed: int) -> np.ndarray:
        """k-means++: the document of the least -ln(u) / d**2 is a draw in proportion to d**2, its squared distance to the seeds."""
        self.centres = np.zeros((0, self.size))
        for step in range(k):
            shared, weights = self._shared()

            def work(batches: Iterator[pa.RecordBatch], step=step, shared=shared, weights=weights) -> Iterator[pa.RecordBatch]:
                best = None
                for batch in batches:
                    u = np.asarray(batch.column("u"))
                    at = 0
                    for docs, row, ids, tf in _pieces(batch):
                        w = tf * weights.value[ids]
                        d = _distances(len(docs), row, ids, w, *shared.value).min(1) if step else np.ones(len(docs))
                        key = np.where(d > 1e-9, -np.log(u[at : at + len(docs)]) / np.maximum(d, 1e-9), np.inf)
                        i = np.lexsort((docs, key))[0]
                        found = (float(key[i]), int(docs[i]), ids[row == i], w[row == i])
                        best = found if best is None or found[:2] < best[:2] else best
                        at += len(docs)
                if best is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2].tobytes()], pa.binary()), pa.array([best[3].tobytes()], pa.binary())], ["key", "doc_id", "ids", "w"])

            u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "doc_id"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
            first = self.rows.withColumn("u", u).mapInArrow(work, "key double, doc_id long, ids binary, w binary").orderBy("key", "doc_id").first()
            centre = np.zeros((1, self.size))
            if first is not None:
                centre[0, np.frombuffer(first.ids, np.int32)] = np.frombuffer(first.w, np.float64)
            self.centres = np.concatenate([self.centres, centre])
        return self.centres

    def _moved(self) -> np.ndarray:
        """The centres' means; one without documents stays."""
        shared, weights = self._shared()
        k, size = self.centres.shape

        def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            sums, n = np.zeros(k * size), np.zeros(k)
            for batch in batches:
                for docs, row, ids, tf in _pieces(batch):
                    w = tf * weights.value[ids]
                    near = _distances(len(docs), row, ids, w, *shared.value).argmin(1)
                    np.add.at(sums, near[row] * size + ids, w)
                    n += np.bincount(near, minlength=k)
            return {"n": n} | {str(c): sums[c * size : (c + 1) * size] for c in range(k)}

        found = _sums(self.rows, work, ["n", *map(str, range(k))], max(size, k))
        shared.destroy()
        n = found["n"][:k]
        return np.stack([found[str(c)][:size] / n[c] if n[c] else self.centres[c] for c in range(k)])

    def assigned(self) -> DataFrame:
        """doc_id, cluster."""
        shared, weights = self._shared()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for docs, row, ids, tf in _pieces(batch):
                    near = _distances(len(docs), row, ids, tf * weights.value[ids], *shared.value).argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(near, pa.int32())], ["doc_id", "cluster"])

        return self.rows.mapInArrow(work, "doc_id long, cluster int")
