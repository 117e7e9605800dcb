"""Routing of all windows of n symbols of a corpus, so that equal windows meet in one bucket.

A window of ``length`` symbols is routed by its minimiser: the least hash among its ``length - seed + 1`` runs of ``seed``
symbols. Equal windows have equal minimisers, and neighbouring windows mostly share theirs, so a text falls into *segments*
(runs of neighbouring windows with one minimiser) of little more than one window each, about one for every 16 symbols.

Three passes over the blocks (packed rows of 2 MB of text, written once; 4 blocks in a row are a chunk, by which the table is
bucketed, so that what comes back to a chunk is joined where its blocks are):

1. minimisers, each once a block, go to buckets by hash; a bit for each comes back: does another block have it? A chunk sends a
   fixed number of rows; where buckets must be more than that, they are reached in steps, and bits come back the same way;
2. segments whose minimiser occurs in more than one document go to the same buckets, text and all; what the caller's
   function finds there (runs of windows that also start in a document of smaller id) comes back per chunk. Of equal
   segments within ``HELD`` bytes of a task only those of the least id go out: the others are to be removed in any case;
3. each block paints its runs and yields its documents.

Rows of pass 1 follow the text, those of pass 2 are packed by task and bucket. Only minimisers of all
text and the text of shared segments are shuffled; a common passage costs one minimiser a block in pass 1 and its text once a
task in pass 2. Nothing is capped and no pair of documents is ever formed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm.scratch import Scratch

U = np.uint64
BLOCK_SCHEMA = "chunk long, block long, batch int, n_bytes long, ids binary, sizes binary, data binary"
KEY_SCHEMA = "bucket int, unit long, tag binary, counts binary, keys binary"
BITS_SCHEMA = "bucket int, unit long, tag binary, counts binary, bits binary"
SEGMENT_SCHEMA = "bucket int, blocks binary, docs binary, starts binary, sizes binary, data binary"
RUN_SCHEMA = "chunk long, blocks binary, starts binary, counts binary"
#: A chunk is 2^CHUNK blocks in a row.
CHUNK = 2
#: Bytes of keys or segments that a task holds before it sends them out.
HELD = 16_000_000


@dataclass(frozen=True)
class Plan:
    """unit: 'bytes' or 'words'; length: symbols of a window; seed: symbols of a minimiser; buckets: of segments. Keys go to
    ``fan`` buckets in each of ``levels`` steps (see ``key_levels``)."""

    unit: str
    length: int
    seed: int
    buckets: int = 64
    levels: int = 1
    fan: int = 256


def key_levels(size: int, fan: int = 256, bucket: int = 64_000_000) -> int:
    """Steps after which a bucket holds the keys of ``bucket`` bytes of text: one up to 16 GB, two up to 4 TB, three up to 1 PB."""
    levels = 1
    while fan**levels * bucket < size:
        levels += 1
    return levels


@dataclass
class Symbols:
    """The symbols of one block: hashes, per-document offsets, and the byte span of each symbol (words only)."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None


def symbols(plan: Plan, buf: np.ndarray, offsets: np.ndarray) -> Symbols:
    if plan.unit == "bytes":
        return Symbols(scan.BYTE_KEYS[buf], offsets, None, None)
    starts, ends = scan.spans(scan.NOT_SPACE[buf], offsets)
    return Symbols(scan.span_hashes(buf, starts, ends), np.searchsorted(starts, offsets), starts, ends)


def segments(plan: Plan, s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, key and document of each segment."""
    least = scan.slide_min(scan.window_hashes(s.hashes, plan.seed, linear=True), plan.length - plan.seed + 1)
    n = len(least)
    if n == 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U), np.zeros(0, np.int64))
    valid = np.ones(n + 1, bool)  # windows that cross the end of a document are none
    short = np.diff(s.offsets) < plan.length
    begin = np.where(short, s.offsets[:-1], s.offsets[1:] - plan.length + 1)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.minimum(begin, n), 1)
    np.subtract.at(edge, np.minimum(s.offsets[1:], n), 1)
    valid[:n] = np.cumsum(edge[:n]) == 0
    valid[n] = False
    fresh = np.ones(n, bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[s.offsets[:-1][s.offsets[:-1] < n]] = True
    fresh[1:] |= ~valid[: n - 1]
    first = np.flatnonzero(fresh & valid[:n])
    stop = np.flatnonzero(np.concatenate([(fresh[1:] | ~valid[1:n]) if n > 1 else np.zeros(0, bool), [True]]) & valid[:n]) + 1
    return first, stop - first, scan.mix(least[first]), scan.owners(s.offsets, first)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the key, so that a sorted array of keys is sorted by bucket."""
    return (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def unblock(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text bytes and offsets of a block."""
    sizes = np.frombuffer(row["sizes"], np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def make_blocks(scratch: Scratch, docs: DataFrame, edges: list[int], limit: int = scan.SLICE_BYTES) -> DataFrame:
    """Write docs (doc_id long not null, text) as blocks of ``limit`` bytes of text (or one document); a document's batch is the number of edges at or below its id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        cuts = np.array(edges, np.int64)
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text", limit):
                ids = np.asarray(part.column("doc_id"))
                which = np.searchsorted(cuts, ids, side="right")
                rows = []
                for b in np.unique(which):
                    mine = np.flatnonzero(which == b)
                    sizes = np.diff(offsets)[mine]
                    data = b"".join(buf[offsets[i] : offsets[i + 1]].tobytes() for i in mine)
                    rows.append({"chunk": number >> CHUNK, "block": number, "batch": int(b), "n_bytes": len(data), "ids": ids[mine].tobytes(), "sizes": sizes.tobytes(), "data": data})
                    number += 1
                yield to_batch(rows, BLOCK_SCHEMA)

    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    # Fewer buckets than shuffle partitions would have Spark shuffle the table in each join.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // 16_000_000))
    return scratch.save_bucketed(docs.select("doc_id", "text").mapInArrow(pack, BLOCK_SCHEMA), "blocks", buckets, "chunk")


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def to_batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(ddl))


def to_table(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=arrow_schema(ddl))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of bucket and where it stands, in order."""
    order = np.argsort(bucket, kind="stable")
    full, cut = np.unique(bucket[order], return_index=True)
    return zip(full.tolist(), np.split(order, cut[1:]) if len(order) else [], strict=True)


def shared_keys(plan: Plan, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Per chunk (unit) and bucket a bit for each of its blocks' (tag) distinct keys, in order: does another block have it?

    A chunk sends ``fan`` rows whatever the size of the corpus.
    """

    def packed(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for chunk in dict.fromkeys(c for c, _, _ in held):
            mine = [(b, keys) for c, b, keys in held if c == chunk]
            names, every = np.array([b for b, _ in mine], np.int64), np.concatenate([k for _, k in mine])
            owner, rows = np.repeat(np.arange(len(mine)), [len(k) for _, k in mine]), []
            for b, part in _split(bucket_of(every, plan.fan)):
                counts = np.bincount(owner[part], minlength=len(mine)).astype(np.int32)
                rows.append({"bucket": b, "unit": chunk, "tag": names.tobytes(), "counts": counts.tobytes(), "keys": every[part].tobytes()})
            if rows:
                yield to_batch(rows, KEY_SCHEMA)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows_of(batches):
            _, buf, offsets = unblock(row)
            held.append((row["chunk"], row["block"], np.unique(segments(plan, symbols(plan, buf, offsets))[2])))
            size += 8 * len(held[-1][2])
            if size > HELD:
                yield from packed(held)
                held, size = [], 0
        yield from packed(held)

    return _met(blocks.select("chunk", "block", "ids", "sizes", "data").mapInArrow(emit, KEY_SCHEMA), plan, 1, scratch)


def _met(pieces: DataFrame, plan: Plan, level: int, scratch: Scratch) -> DataFrame:
    """Bits for the keys of each piece. Buckets of the last level are looked at; before it the pieces of a bucket are packed anew,
    many to a unit, and each unit goes to the ``fan`` buckets within, so that rows stay long however many buckets there are."""
    if level == plan.levels:
        return pieces.groupBy("bucket").applyInArrow(_meet, BITS_SCHEMA)
    finer = scratch.save(_finer(pieces, plan, level), f"keys{level}")
    inner = _met(finer.filter("bucket >= 0"), plan, level + 1, scratch)
    whole = inner.unionByName(finer.filter("bucket < 0").withColumnRenamed("keys", "bits"))
    return whole.groupBy("unit").applyInArrow(_reassemble, BITS_SCHEMA)


def _meet(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, U) for x in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(parts))  # a block has each of its keys once
    again = np.append(every[1:][every[1:] == every[:-1]], U(2**64 - 1))  # sorted; the last entry ends searches
    bits = [np.packbits(again[np.searchsorted(again, p)] == p).tobytes() for p in parts]
    return table.select(["bucket", "unit", "tag", "counts"]).append_column("bits", pa.array(bits, pa.binary()))


def _finer(pieces: DataFrame, plan: Plan, level: int) -> DataFrame:
    """Units of pieces of one bucket: for each bucket within, the keys of all of them; and a row of bucket -1 that says what they were."""

    def packed(held: list[dict]) -> Iterator[pa.RecordBatch]:
        for bucket in dict.fromkeys(r["bucket"] for r in held):
            mine, rows = [r for r in held if r["bucket"] == bucket], []
            number[0] += 1
            counts, keys = (np.frombuffer(b"".join(r[c] for r in mine), kind) for c, kind in (("counts", np.int32), ("keys", U)))
            owner = np.repeat(np.arange(len(counts)), counts)
            for b, part in _split(bucket_of(keys, plan.fan ** (level + 1))):
                rows.append({"bucket": b, "unit": number[0], "tag": b"", "counts": np.bincount(owner[part], minlength=len(counts)).astype(np.int32).tobytes(), "keys": keys[part].tobytes()})
            origin = pickle.dumps([(r["bucket"], r["unit"], r["tag"], r["counts"]) for r in mine])
            yield to_batch([*rows, {"bucket": -1, "unit": number[0], "tag": origin, "counts": b"", "keys": b""}], KEY_SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number[0] = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row["keys"])
            if size > HELD:
                yield from packed(held)
                held, size = [], 0
        yield from packed(held)

    number = [0]
    return pieces.repartition("bucket", F.pmod("unit", F.lit(16))).mapInArrow(work, KEY_SCHEMA)


def _reassemble(table: pa.Table) -> pa.Table:
    """The pieces of a unit as they were, their bits in order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    origin, inner = pickle.loads(rows[0]["tag"]), rows[1:]
    counts = [np.frombuffer(r["counts"], np.int32) for r in inner]
    owner = np.concatenate([np.repeat(np.arange(len(c)), c) for c in counts])
    bits = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(c.sum())) for r, c in zip(inner, counts, strict=True)])
    bits = bits[np.argsort(owner, kind="stable")].astype(bool)
    sizes = [int(np.frombuffer(c, np.int32).sum()) for *_, c in origin]
    out = [{"bucket": b, "unit": u, "tag": t, "counts": c, "bits": np.packbits(x).tobytes()} for (b, u, t, c), x in zip(origin, np.split(bits, np.cumsum(sizes)[:-1]), strict=True)]
    return to_table(out, BITS_SCHEMA)


class Found:
    """What came back to a chunk, by block; parsed once for all blocks of the chunk that follow each other."""

    def __init__(self, parse: Callable[[list[dict]], dict]):
        self.parse, self.chunk, self.by_block = parse, None, {}

    def of(self, row: dict):
        if row["chunk"] != self.chunk:
            self.chunk, self.by_block = row["chunk"], self.parse(row["found"] or [])
        return self.by_block.get(row["block"])


def _bits_by_block(found: list[dict]) -> dict[int, list[tuple[int, np.ndarray]]]:
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for x in found:
        counts = np.frombuffer(x["counts"], np.int32)
        bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(counts.sum())).astype(bool)
        for block, part in zip(np.frombuffer(x["tag"], np.int64).tolist(), np.split(bits, np.cumsum(counts)[:-1]), strict=True):
            out.setdefault(block, []).append((x["bucket"], part))
    return out


def shared_segments(plan: Plan, blocks: DataFrame, bits: DataFrame | None) -> DataFrame:
    """Segments whose key more than one document has, packed by bucket; without bits all segments.

    Of the equal segments that a task holds only those of the least id are packed. The others start in a smaller id's document,
    whatever other tasks hold: they are runs to remove, in rows of a negative bucket (see ``local_runs``).
    """

    def packed(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        block = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        keys, docs, first, count = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
        texts = [x for h in held for x in h[5]]
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(x, len(number)) for x in texts), np.int64, len(texts))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, same, docs)
        later = docs > least[same]
        rows = []
        for b in np.unique(block[later]).tolist():
            mine = later & (block == b)
            local = -1 - int(scan.mix(np.array([b], U))[0] >> U(33))
            rows.append({"bucket": local, "blocks": block[mine].tobytes(), "docs": b"", "starts": first[mine].astype(np.int32).tobytes(), "sizes": count[mine].astype(np.int32).tobytes(), "data": b""})
        rest = np.flatnonzero(~later)
        bucket = bucket_of(keys[rest], plan.buckets)
        order = np.argsort(bucket, kind="stable")
        full, cut = np.unique(bucket[order], return_index=True)
        for b, part in zip(full.tolist(), np.split(rest[order], cut[1:]) if len(rest) else [], strict=True):
            mine = [texts[i] for i in part.tolist()]
            rows.append({"bucket": b, "blocks": block[part].tobytes(), "docs": docs[part].tobytes(), "starts": first[part].astype(np.int32).tobytes(), "sizes": np.array([len(x) for x in mine], np.int32).tobytes(), "data": b"".join(mine)})
        if rows:
            yield to_batch(rows, SEGMENT_SCHEMA)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back, held, size = Found(_bits_by_block), [], 0
        for row in rows_of(batches):
            ids, buf, offsets = unblock(row)
            s = symbols(plan, buf, offsets)
            first, count, keys, doc = segments(plan, s)
            unique, which = np.unique(keys, return_inverse=True)
            if len(unique) == 0:
                continue
            at = np.searchsorted(bucket_of(unique, plan.fan), np.arange(plan.fan + 1))
            shared = np.full(len(unique), every)
            for bucket, flags in back.of(row) or []:
                shared[at[bucket] : at[bucket + 1]] = flags
            order = np.lexsort((ids[doc], which))  # a key of two ids within this block
            twice = (which[order][1:] == which[order][:-1]) & (ids[doc][order][1:] != ids[doc][order][:-1])
            shared[which[order][1:][twice]] = True
            keep = np.flatnonzero(shared[which])
            begin, end = first[keep], first[keep] + count[keep] + plan.length - 1
            if s.starts is not None:
                begin, end = s.starts[begin], s.ends[end - 1]
            texts = [buf[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            held.append((row["block"], keys[keep], ids[doc[keep]], first[keep], count[keep], texts))
            size += int((end - begin).sum())
            if size > HELD:
                yield from packed(held)
                held, size = [], 0
        yield from packed(held)

    texts, every = blocks.select("chunk", "block", "ids", "sizes", "data"), bits is None
    if bits is None:
        return texts.withColumn("found", F.lit(None)).mapInArrow(emit, SEGMENT_SCHEMA)
    found = bits.groupBy(F.col("unit").alias("chunk")).agg(F.collect_list(F.struct("bucket", "tag", "counts", "bits")).alias("found"))
    return texts.join(found.hint("shuffle_hash"), "chunk", "left").mapInArrow(emit, SEGMENT_SCHEMA)


def local_runs(table: pa.Table) -> list[dict] | None:
    """Of a negative bucket the runs that a task found by itself; None for other buckets."""
    if table.column("bucket")[0].as_py() >= 0:
        return None
    rows = table.select(["blocks", "starts", "sizes"]).to_pylist()
    return [{"chunk": int(np.frombuffer(r["blocks"], np.int64)[0]) >> CHUNK, "blocks": r["blocks"], "starts": r["starts"], "counts": r["sizes"]} for r in rows]


@dataclass
class Gathered:
    """What one bucket holds: symbols of all segments end to end and, per segment, block, document, first window, offsets."""

    block: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def gather(table: pa.Table) -> Gathered:
    joined = {k: b"".join(table.column(k).to_pylist()) for k in ("blocks", "docs", "starts", "sizes", "data")}
    sizes = np.frombuffer(joined["sizes"], np.int32).astype(np.int64)
    return Gathered(np.frombuffer(joined["blocks"], np.int64), np.frombuffer(joined["docs"], np.int64), np.frombuffer(joined["starts"], np.int32).astype(np.int64), np.frombuffer(joined["data"], np.uint8), np.concatenate([[0], np.cumsum(sizes)]))


def collapse(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of segments (runs of symbols), one representative of each distinct one, and the representative's number for each.

    Segments count as equal by two 64-bit hashes of independent random values.
    """
    return _groups(*(scan.sum_at_places(hashes, np.diff(offsets), salt) for salt in (11, 12)))


def collapse_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of segments of bytes."""
    return _groups(*(scan.span_hashes(data, offsets[:-1], offsets[1:], salt) for salt in (11, 12)))


def _groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return order[fresh], which


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """arange(starts[i], starts[i] + counts[i]) for all i, end to end."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def pack_runs(g: Gathered, hit: np.ndarray, counts: np.ndarray) -> list[dict]:
    """hit: for the windows of all segments end to end, whether they are to go; counts: windows of each segment."""
    if not hit.any():
        return []
    base = np.concatenate([[0], np.cumsum(counts)])
    s, e = scan.spans(hit, base)
    seg = scan.owners(base, s)
    at = g.start[seg] + s - base[seg]
    block = g.block[seg]
    order = np.argsort(block, kind="stable")
    chunks, cut = np.unique(block[order] >> CHUNK, return_index=True)
    rows = []
    for chunk, part in zip(chunks.tolist(), np.split(order, cut[1:]), strict=True):
        rows.append({"chunk": chunk, "blocks": block[part].tobytes(), "starts": at[part].astype(np.int32).tobytes(), "counts": (e - s)[part].astype(np.int32).tobytes()})
    return rows


def _runs_by_block(found: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    block = np.frombuffer(b"".join(x["blocks"] for x in found), np.int64)
    starts, counts = (np.frombuffer(b"".join(x[k] for x in found), np.int32).astype(np.int64) for k in ("starts", "counts"))
    order = np.argsort(block, kind="stable")
    names, cut = np.unique(block[order], return_index=True)
    return {b: (starts[part], counts[part]) for b, part in zip(names.tolist(), np.split(order, cut[1:]), strict=True)} if len(names) else {}


def paint(plan: Plan, blocks: DataFrame, runs: DataFrame, finish: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Symbols], pa.RecordBatch], schema: str) -> DataFrame:
    """finish(ids, text bytes, offsets, removed symbols, symbols) makes a block's output rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Found(_runs_by_block)
        for row in rows_of(batches):
            ids, buf, offsets = unblock(row)
            s = symbols(plan, buf, offsets)
            a, n = back.of(row) or (np.zeros(0, np.int64),) * 2
            yield finish(ids, buf, offsets, scan.cover(len(s.hashes), a, a + n + plan.length - 1), s)

    grouped = runs.groupBy("chunk").agg(F.collect_list(F.struct("blocks", "starts", "counts")).alias("found"))
    return blocks.select("chunk", "block", "ids", "sizes", "data").join(grouped.hint("shuffle_hash"), "chunk", "left").mapInArrow(emit, schema)
