"""Compression of vectors to codes: a product quantiser whose nearest entries are found in kd-trees.

Components become integers floor(4096 x) and each vector is cut into equal parts; each part position has a codebook of its own.
A round broadcasts one kd-tree for each codebook (``parts`` x ``entries`` entries, at most 256 a codebook: the size is fixed by
the parameters). Tasks search them branch and bound: each node has the box of its entries, the nearer child is taken first, and
a node whose bound equals the best distance is still entered, so that of equally near entries the one of lowest index is found.
Sums and counts of the parts of each entry are added up within tasks, then over all tasks by Spark, in integers, so no order of
rows or tasks changes a result; ``parts * entries`` rows come to the driver a round.

Rows whose vector is null or holds a null or non-finite component are dropped. Rows with a null id are coded, but never start a
codebook; of several rows of one id the least vector starts it, all are coded. With fewer ids than entries codebooks are
smaller; without any id codes and errors are null. Components beyond +-2^27 after scaling count as that, so that distances fit in 64 bits. All vectors must have one
length, a multiple of ``parts``; if not, an error says so. An empty table gives an empty result. Null labels are one label.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.scratch import Scratch

SCALE = 4096
BOUND = 1 << 27
#: Vectors that one numpy pass handles.
SLICE_ROWS = 4096


@dataclass
class Forest:
    """A kd-tree for each codebook, the nodes of all trees in one numbering. entry is -1 for inner nodes."""

    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    entry: np.ndarray
    point: np.ndarray

    @staticmethod
    def grow(books: np.ndarray) -> Forest:
        """books: (codebook, entry, component). Nodes split their entries in half along the widest side of their box."""
        nodes: list[tuple] = []

        def node(book: np.ndarray, of: np.ndarray) -> int:
            low, high = book[of].min(axis=0), book[of].max(axis=0)
            at = len(nodes)
            nodes.append(())
            if len(of) == 1:
                nodes[at] = (-1, -1, low, high, int(of[0]), book[of[0]])
            else:
                axis = int(np.argmax(high - low)) if len(low) else 0
                order = of[np.argsort(book[of, axis], kind="stable")] if len(low) else of
                half = len(of) // 2
                nodes[at] = (node(book, order[:half]), node(book, order[half:]), low, high, -1, low)
            return at

        roots = [node(book, np.arange(len(book))) for book in books]
        columns = list(zip(*nodes, strict=True))
        return Forest(np.array(roots), *(np.array(c, np.int64) for c in columns))

    def bound(self, parts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance from each part to the box of its node: no entry below it is nearer."""
        off = np.maximum(np.maximum(self.low[nodes] - parts, parts - self.high[nodes]), 0)
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part in its codebook, the lowest index of equally near ones.

        One stack for each part; all parts take a step at a time.
        """
        n, depth = len(parts), 2 + int(np.ceil(np.log2(max(2, len(self.entry)))))
        best, which = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        stack, bounds, top = np.zeros((n, 2 * depth), np.int64), np.zeros((n, 2 * depth), np.int64), np.ones(n, np.int64)
        stack[:, 0] = self.roots[books]
        live = np.arange(n)
        while len(live):
            top[live] -= 1
            node, least = stack[live, top[live]], bounds[live, top[live]]
            go = least <= best[live]
            at, node = live[go], node[go]
            leaf = self.entry[node] >= 0
            a, entry = at[leaf], self.entry[node[leaf]]
            off = parts[a] - self.point[node[leaf]]
            far = np.einsum("ij,ij->i", off, off)
            better = (far < best[a]) | ((far == best[a]) & (entry < which[a]))
            best[a[better]], which[a[better]] = far[better], entry[better]
            a, node = at[~leaf], node[~leaf]
            one, two = self.left[node], self.right[node]
            b1, b2 = self.bound(parts[a], one), self.bound(parts[a], two)
            first = b1 <= b2
            stack[a, top[a]], bounds[a, top[a]] = np.where(first, two, one), np.maximum(b1, b2)
            stack[a, top[a] + 1], bounds[a, top[a] + 1] = np.where(first, one, two), np.minimum(b1, b2)
            top[a] += 2
            live = live[top[live] > 0]
        return which, best


def packed(values: np.ndarray) -> np.ndarray:
    """Integers in four bytes each, so that binary order is theirs."""
    return (values + (1 << 31)).astype(">u4")


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.int64) - (1 << 31)


def _slices(batch: pa.RecordBatch, dims: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows, each with its parts (row by row, in part order) and the codebook of each part."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        some = batch.slice(start, SLICE_ROWS)
        yield some, unpacked(b"".join(some.column("v").to_pylist())).reshape(some.num_rows * parts, dims // parts), np.tile(np.arange(parts), some.num_rows)


def _integers(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, label, size, v (packed components) of the rows whose components are all finite numbers, written once."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("embedding").isNotNull() & finite)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            with np.errstate(over="ignore"):
                whole = packed(np.clip(np.floor(np.asarray(lists.flatten()) * SCALE), -BOUND, BOUND).astype(np.int64))
            sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int32)
            ends = np.cumsum(sizes)
            v = [whole[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(sizes), pa.array(v, pa.binary())], names=["vec_id", "label", "size", "v"])

    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("size", T.IntegerType()), T.StructField("v", T.BinaryType())])
    return scratch.save(rows.mapInArrow(work, schema), "integers")


def _sums(kept: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """part, entry, n and the sum of each component over the parts nearest to the entry; a row a task and entry is shuffled."""
    parts, entries, width = books.shape
    forest = kept.sparkSession.sparkContext.broadcast(Forest.grow(books))
    names = [f"s{j}" for j in range(width)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for _, x, book in _slices(batch, dims, parts):
                key = book * entries + forest.value.nearest(x, book)[0]
                n += np.bincount(key, minlength=len(n))
                np.add.at(total, key, x)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full // entries), pa.array(full % entries), pa.array(n[full]), *(pa.array(total[full, j]) for j in range(width))], names=["part", "entry", "n", *names])

    schema = ", ".join(f"{c} long" for c in ["part", "entry", "n", *names])
    return kept.select("v").mapInArrow(work, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *names]))


def learn(kept: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """The codebooks, (part, entry, component), after all rounds. kept: the table of _integers."""
    low, high = kept.agg(F.min("size"), F.max("size")).first()
    if low != high or (low or 0) % parts:
        raise ValueError(f"vectors must have one length that {parts} parts divide, these have {low} to {high} components")
    if low is None:
        return np.zeros((parts, 0, 0), np.int64)
    dims = int(low)
    least = kept.filter(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    seeds = np.array([unpacked(r["v"]) for r in least], np.int64).reshape(len(least), parts, dims // parts)
    books = np.ascontiguousarray(seeds.transpose(1, 0, 2))
    for _ in range(rounds if len(least) else 0):
        for row in _sums(kept, books, dims).collect():
            books[row["part"], row["entry"]] = [row[f"s{j}"] // row["n"] for j in range(books.shape[2])]
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code (an index of two hex digits for each part), error (squared distance), label_error (its sum over the label),
    codebooks_sha256. vectors: vec_id, embedding, label; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "codes")
    kept = _integers(vectors, scratch)
    books = learn(kept, parts, entries, rounds)
    dims = parts * books.shape[2]
    mark = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    forest = vectors.sparkSession.sparkContext.broadcast(Forest.grow(books)) if books.shape[1] else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x, book in _slices(batch, dims, parts):
                entry, far = forest.value.nearest(x, book)
                code = [row.tobytes().hex() for row in entry.astype(np.uint8).reshape(-1, parts)]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(far.reshape(-1, parts).sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    if books.shape[1]:
        coded = kept.select("vec_id", "label", "v").mapInArrow(work, f"vec_id long, label {kind}, code string, error long")
    else:
        coded = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = scratch.save(coded, "coded")
    by_label = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")  # read by its size: broadcast if small
    joined = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(mark).alias("codebooks_sha256"))
