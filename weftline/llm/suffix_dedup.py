"""Suffix-array dedup with a logarithmic family of indexes.

Documents enter in batches of ascending id. In each bucket of :mod:`weftline.llm.windows` a batch's text gets a suffix array
(suffixes of ``length`` bytes and more, in lexicographic order of their first ``length`` bytes, which is all that a match of
that length looks at). The array is merge-scanned against every live level: a window found there, or in the batch under a
smaller id, is a duplicate. Then the batch becomes a level; two levels of one size merge into the next, as a binary counter
carries, so that b batches leave at most log2(b) levels and each window is merged log2(b) times at most.

``suffix_array_dedup`` is one call over a whole table, whose levels hold shared segments alone. A ``Family`` is stored in a folder
and takes batch after batch, in calls of their own; as nobody knows what later batches will hold, its levels have all segments
(about seven times the text's bytes before compression).

Null text counts as empty. Rows with a null id are kept whole and never matched. Repeated rows (one id) don't match each
other. Texts shorter than ``length`` bytes are kept whole; a text of any length is one block. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm import windows
from weftline.llm.scratch import Scratch

STEP_SCHEMA = "kind string, key long, a binary, b binary, c binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = RESULT + ", kept binary"


class Level:
    """Distinct segments of a bucket end to end, with the sorted starts of their windows."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, order: np.ndarray, length: int):
        self.data, self.sizes, self.order, self.length = data, sizes, order, length

    def heads(self) -> np.ndarray:
        """The windows in lexicographic order."""
        if len(self.order) == 0:
            return np.zeros(0, f"S{self.length}")
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        return np.ascontiguousarray(view[self.order]).view(f"S{self.length}").ravel()

    def has(self, heads: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted queries are windows of this level (heads: this level's)."""
        if len(heads) == 0 or len(queries) == 0:
            return np.zeros(len(queries), bool)
        at = np.minimum(np.searchsorted(heads, queries), len(heads) - 1)
        return heads[at] == queries

    @staticmethod
    def merge(x: Level, y: Level) -> Level:
        """One array of both texts; windows of y that x has are left out of the order."""
        hx, hy = x.heads(), y.heads()
        new = ~x.has(hx, hy)
        at = np.searchsorted(hx, hy[new]) + np.arange(int(new.sum()))
        order = np.empty(len(hx) + len(at), np.int64)
        mask = np.zeros(len(order), bool)
        mask[at] = True
        order[mask], order[~mask] = y.order[new].astype(np.int64) + len(x.data), x.order
        return Level(np.concatenate([x.data, y.data]), np.concatenate([x.sizes, y.sizes]), order, x.length)


def narrow(order: np.ndarray) -> bytes:
    """Three bytes a number where they are enough, else four; a last byte says which."""
    size = 3 if len(order) == 0 or int(order.max()) < 1 << 24 else 4
    return order.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes() + bytes([size])


def widen(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[-1], 4), np.uint8)
    out[:, : data[-1]] = np.frombuffer(data, np.uint8)[:-1].reshape(-1, data[-1])
    return out.view("<u4").ravel().astype(np.int64)


def scan_batch(table: pa.Table, length: int, merge_with: list[int], keep: bool) -> pa.Table:
    """One bucket: flag the batch's windows against its own smaller ids and all levels; carry levels upward."""
    local = windows.local_runs(table)
    if local is not None:
        return windows.to_table([{"kind": "run", "key": r["chunk"], "a": r["starts"], "b": r["counts"], "c": r["blocks"]} for r in local], STEP_SCHEMA)
    kinds = table.column("kind").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    fresh = table.filter(pa.array([k is None for k in kinds]))
    levels = {}
    for i, k in enumerate(kinds):
        if k is not None:
            data, sizes, order = (table.column(c)[i].as_py() for c in ("data", "sizes", "starts"))
            levels[k] = Level(np.frombuffer(data, np.uint8), np.frombuffer(sizes, np.int32), widen(order), length)
    out, batch = [], None
    if fresh.num_rows:
        g = windows.gather(fresh)
        rep, which = windows.collapse_bytes(g.data, g.offsets)
        begin, size = g.offsets[rep], np.diff(g.offsets)[rep]
        data = g.data[windows.ranges(begin, size)]
        ends = np.cumsum(size)
        count = size - length + 1
        starts = windows.ranges(ends - size, count)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, which, g.doc)
        batch = Level(data, size.astype(np.int32), starts, length)
        heads = batch.heads()
        order = np.argsort(heads, kind="stable")
        heads = heads[order]
        edge = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        first = np.minimum.reduceat(np.repeat(least, count)[order], edge)  # the least id that has each distinct window
        old = np.zeros(len(edge), bool)
        for level in levels.values():
            old |= level.has(level.heads(), heads[edge])
        first[old] = np.iinfo(np.int64).min
        of_window = np.empty(len(order), np.int64)
        of_window[order] = np.repeat(first, np.diff(np.append(edge, len(order))))
        per = count[which]
        base = np.cumsum(count) - count
        hit = of_window[windows.ranges(base[which], per)] < np.repeat(g.doc, per)
        out = [{"kind": "run", "key": r["chunk"], "a": r["starts"], "b": r["counts"], "c": r["blocks"]} for r in windows.pack_runs(g, hit, per)]
        batch.order = starts[order][edge]
    if keep:
        for k in merge_with:
            if k in levels:
                batch = Level.merge(levels[k], batch) if batch is not None else levels[k]
        if batch is not None:
            out.append({"kind": "level", "key": bucket, "a": batch.data.tobytes(), "b": batch.sizes.astype(np.int32).tobytes(), "c": narrow(batch.order)})
    return windows.to_table(out, STEP_SCHEMA)


def _step(length: int, merge_with: list[int], keep: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda table: scan_batch(table, length, merge_with, keep)


def _finish(plan: windows.Plan, with_text: bool):
    def finish(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray, gone: np.ndarray, _: windows.Symbols) -> pa.RecordBatch:
        starts, _ends = scan.spans(gone, offsets)
        n_spans = np.diff(np.searchsorted(starts, offsets))
        total = np.concatenate([[0], np.cumsum(gone)])
        left = buf[~gone]
        at = offsets - total[offsets]
        kept = [left[at[i] : at[i + 1]].tobytes() for i in range(len(ids))]
        columns = [pa.array(ids), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, schema=windows.arrow_schema(KEPT if with_text else RESULT))

    return finish


def _level_rows(level: DataFrame, k: int) -> DataFrame:
    none = F.lit(None).cast("binary")
    return level.select(F.col("key").cast("int").alias("bucket"), none.alias("blocks"), none.alias("docs"), F.col("c").alias("starts"), F.col("b").alias("sizes"), F.col("a").alias("data"), F.lit(k).alias("kind"))


def _run_rows(out: DataFrame) -> DataFrame:
    return out.filter("kind = 'run'").select(F.col("key").alias("chunk"), F.col("c").alias("blocks"), F.col("a").alias("starts"), F.col("b").alias("counts"))


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _kept_whole(docs: DataFrame, with_text: bool) -> DataFrame:
    """Result rows of documents that nothing is taken from."""
    n, zero = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    return docs.select("doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "UTF-8").alias("kept")] if with_text else []))


class Family:
    """A family of levels in a folder that all executors see; its batches come in any number of calls.

    With t batches in it there is a level for each 1 among t's binary digits, written by the batch that completed it: nothing but the
    finished steps in the folder has to be remembered, and a step that broke off is written anew. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, length: int = 50, buckets: int = 256):
        """length and buckets must be the same in all calls; a bucket's levels are one task's, so choose buckets for what the family is to
        hold at last (4 MB of text each)."""
        self.spark, self.length = spark, length
        self.scratch = Scratch(spark, "family")
        self.levels = self.scratch.at(root)
        self.plan = windows.Plan("bytes", length, max(1, length * 2 // 5), buckets)

    def batches(self) -> int:
        """How many batches the family holds."""
        t = 0
        while self.levels.done(f"step{t}"):
            t += 1
        return t

    def add_batch(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """The result of ``suffix_array_dedup`` for docs (doc_id, text), where every document of earlier batches counts as of smaller id;
        then docs is part of the family."""
        t, docs = self.batches(), _known(docs)
        live = [k for k in range(t.bit_length()) if t >> k & 1]
        carried = [k for k in live if all(j in live for j in range(k))]
        blocks = windows.make_blocks(self.scratch, docs.filter(F.col("doc_id").isNotNull()), [])
        fresh = windows.shared_segments(self.plan, blocks, None).withColumn("kind", F.lit(None).cast("int"))
        made = {k: (t >> k << k) - 1 for k in live}  # the step that wrote each level
        for k in live:
            fresh = fresh.unionByName(_level_rows(self.levels.read(f"step{made[k]}", STEP_SCHEMA).filter("kind = 'level'"), k))
        out = self.levels.save_parts(fresh.groupBy("bucket").applyInArrow(_step(self.length, carried, True), STEP_SCHEMA), f"step{t}", "kind")
        for k in carried:
            self.levels.drop(f"step{made[k]}/kind=level")
        result = windows.paint(self.plan, blocks, _run_rows(out), _finish(self.plan, with_text), KEPT if with_text else RESULT)
        return result.unionByName(_kept_whole(docs.filter(F.col("doc_id").isNull()), with_text))


def suffix_array_dedup(docs: DataFrame, length: int = 50, batches: int = 4, with_text: bool = False) -> DataFrame:
    """Remove from each text every byte that a string of ``length`` bytes covers which also starts in a document of smaller id.

    docs: doc_id (integer), text. batches: how many index batches the ids are dealt into, in order. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, and the bytes that stay as ``kept`` if with_text is set.
    """
    spark = docs.sparkSession
    docs = _known(docs)
    whole = docs.filter(F.col("doc_id").isNull())
    known = docs.filter(F.col("doc_id").isNotNull())
    edges = sorted({int(x) for x in known.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    scratch = Scratch(spark, "suffix")
    blocks = windows.make_blocks(scratch, known, edges)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    plan = windows.Plan("bytes", length, max(1, length * 2 // 5), max(64, int(size // 4_000_000)), windows.key_levels(size))
    bits = scratch.save(windows.shared_keys(plan, blocks, scratch), "bits")
    runs, levels = None, {}
    for t in range(len(edges) + 1):
        carried = []
        while len(carried) in levels:
            carried.append(len(carried))
        keep = t < len(edges)
        fresh = windows.shared_segments(plan, blocks.filter(F.col("batch") == t), bits).withColumn("kind", F.lit(None).cast("int"))
        for k, (_, level) in levels.items():
            fresh = fresh.unionByName(_level_rows(level, k))
        out = scratch.save_parts(fresh.groupBy("bucket").applyInArrow(_step(length, carried, keep), STEP_SCHEMA), f"step{t}", "kind")
        found = _run_rows(out)
        runs = found if runs is None else runs.unionByName(found)
        for k in carried:
            scratch.drop(f"step{levels.pop(k)[0]}/kind=level")
        levels[len(carried)] = (t, out.filter("kind = 'level'"))
    result = windows.paint(plan, blocks, runs, _finish(plan, with_text), KEPT if with_text else RESULT)
    return result.unionByName(_kept_whole(whole, with_text))
