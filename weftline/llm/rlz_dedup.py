"""Substring dedup by relative Lempel-Ziv parsing.

Each bucket of :mod:`weftline.llm.windows` is a reference block: the text of every segment that came to it, indexed by the
runs of ``length`` words that start in it, each with the least document that has it and a place there. A segment is parsed
greedily from its left end: the run at its head is looked up; if a document of smaller id has it, the factor is extended
word by word as far as the text at that place goes, and the parse goes on behind it; if not, it looks on for the next head.
Factors of ``length`` words and more are duplicate spans. Runs inside a factor are never looked up. A run that straddles the
end of a factor may occur elsewhere, so the runs at each boundary are.

Every run of ``length`` words lies in one segment, hence in one block, so that factoring each block factors each document
against every indexed reference that can match it. A segment that several documents share is factored for the least of them;
for the others it is one whole factor.

Words are compared by 64-bit hashes, runs by two. Null text has no words. Rows with a null id are kept whole and never
matched; repeated rows (one id) don't match each other. A text of any length is one block. An empty table gives an empty result. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm import windows
from weftline.llm.scratch import Scratch

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
KEPT = RESULT + ", kept string"


class Runs:
    """The runs of ``length`` words that start at ``starts``: for each distinct one the least of ``docs`` with it, and a place."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int):
        self.one, self.two = (scan.window_hashes(words, length, seed) for seed in (3, 4))
        one, two = self.one[starts], self.two[starts]
        order = np.lexsort((docs, two, one))
        one, two = one[order], two[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.keys, self.check = one[fresh], two[fresh]
        self.least, self.place = docs[order][fresh], starts[order][fresh]

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least document with the run at each of these places of words, and where it has it; all of them are indexed."""
        k = np.searchsorted(self.keys, self.one[at])
        while (wrong := self.check[k] != self.two[at]).any():  # runs that agree in the first hash follow each other
            k[wrong] += 1
        return self.least[k], self.place[k]


def parse(words: np.ndarray, offsets: np.ndarray, docs: np.ndarray, runs: Runs, length: int) -> np.ndarray:
    """For the runs of all segments end to end: is it inside a factor that an earlier document has, or found at its boundary?

    offsets: where each segment of ``words`` begins; docs: the segment's document. All segments are parsed side by side.
    """
    counts = np.diff(offsets) - length + 1
    base = np.concatenate([[0], np.cumsum(counts)])
    found = np.zeros(int(base[-1]), bool)
    seg, at, step = np.arange(len(docs)), np.zeros(len(docs), np.int64), np.ones(len(docs), np.int64)
    while len(seg):
        # Look for the next head in the next `step` runs; twice as far after each failure.
        ahead = np.minimum(step, counts[seg] - at)
        which, run = np.repeat(np.arange(len(seg)), ahead), windows.ranges(at, ahead)
        least, place = runs.find(offsets[seg[which]] + run)
        hit = np.flatnonzero(least < docs[seg[which]])
        live, first = np.unique(which[hit], return_index=True)
        head, there = run[hit[first]], place[hit[first]]
        at, step = at + ahead, step * 2
        if len(live):
            own = seg[live]
            here = offsets[own] + head
            limit = np.minimum(offsets[own + 1] - here, offsets[scan.owners(offsets, there) + 1] - there)
            size, growing = np.full(len(own), length), np.arange(len(own))
            while len(growing):
                growing = growing[size[growing] < limit[growing]]
                growing = growing[words[here[growing] + size[growing]] == words[there[growing] + size[growing]]]
                size[growing] += 1
            found[windows.ranges(base[own] + head, size - length + 1)] = True
            edge, n_edge = head + size - length + 1, np.minimum(length - 1, np.maximum(counts[own] - (head + size - length + 1), 0))
            near = windows.ranges(edge, n_edge)
            of = np.repeat(own, n_edge)
            found[base[of] + near] |= runs.find(offsets[of] + near)[0] < docs[of]
            at[live], step[live] = head + size, 1
        more = at < counts[seg]
        seg, at, step = seg[more], at[more], step[more]
    return found


def factor_block(table: pa.Table, length: int) -> pa.Table:
    """All segments of one reference block: runs of windows to remove, by document block."""
    local = windows.local_runs(table)
    if local is not None:
        return windows.to_table(local, windows.RUN_SCHEMA)
    g = windows.gather(table)
    starts, ends = scan.spans(scan.NOT_SPACE[g.data], g.offsets)
    words, offsets = scan.span_hashes(g.data, starts, ends), np.searchsorted(starts, g.offsets)
    rep, which = windows.collapse(words, offsets)
    size = np.diff(offsets)[rep]
    own = words[windows.ranges(offsets[rep], size)]
    at = np.concatenate([[0], np.cumsum(size)])
    count = size - length + 1
    base = np.concatenate([[0], np.cumsum(count)])
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, which, g.doc)
    runs = Runs(own, windows.ranges(at[:-1], count), np.repeat(least, count), length)
    found = parse(own, at, least, runs, length)
    per = count[which]
    hit = found[windows.ranges(base[which], per)] | np.repeat(g.doc > least[which], per)
    return windows.to_table(windows.pack_runs(g, hit, per), windows.RUN_SCHEMA)


def _factor(length: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: factor_block(table, length)


def _finish(with_text: bool):
    def finish(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray, gone: np.ndarray, s: windows.Symbols) -> pa.RecordBatch:
        starts, size = s.starts[~gone], (s.ends - s.starts)[~gone] + 1
        total = np.concatenate([[0], np.cumsum(size)])
        joined = np.concatenate([buf, [np.uint8(32)]]).astype(np.uint8)[windows.ranges(starts, size)]
        joined[total[1:] - 1] = 32
        cut = total[np.searchsorted(starts, offsets)]
        kept = [joined[cut[i] : max(cut[i], cut[i + 1] - 1)].tobytes() for i in range(len(ids))]
        lost = np.concatenate([[0], np.cumsum(gone)])
        columns = [pa.array(ids), pa.array(np.diff(s.offsets)), pa.array(np.diff(lost[s.offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        return pa.RecordBatch.from_arrays(columns + [pa.array([x.decode() for x in kept], pa.string())] * with_text, schema=windows.arrow_schema(KEPT if with_text else RESULT))

    return finish


def rlz_dedup(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """Remove each word that a run of ``length`` words covers which also starts in a document of smaller id.

    docs: doc_id (integer), text. Words are runs of other than ASCII white space. Returns doc_id, n_words, n_removed,
    kept_sha256 of the kept words joined by one space, and those as ``kept`` if with_text is set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scratch = Scratch(spark, "rlz")
    blocks = windows.make_blocks(scratch, docs.filter(F.col("doc_id").isNotNull()), [])
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    plan = windows.Plan("words", length, max(1, length // 3), max(64, int(size // 4_000_000)), windows.key_levels(size))
    bits = scratch.save(windows.shared_keys(plan, blocks, scratch), "bits")
    found = windows.shared_segments(plan, blocks, bits).groupBy("bucket").applyInArrow(_factor(length), windows.RUN_SCHEMA)
    result = windows.paint(plan, blocks, scratch.save(found, "runs"), _finish(with_text), KEPT if with_text else RESULT)
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    joined = F.array_join(words, " ")
    rest = docs.filter(F.col("doc_id").isNull()).select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(joined, 256).alias("kept_sha256"), *([joined.alias("kept")] if with_text else []))
    return result.unionByName(rest)
