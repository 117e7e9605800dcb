"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lowered (A-Z) and cut into words of letters, digits and non-ASCII bytes. An item's windows are its runs of ``n``
words (of a shorter item, but not an empty one, the whole item). Tasks scan the hashes of all token windows of their documents
against the sorted set, one pass per window length, and verify each hit word by word.

The set is broadcast, so its size is checked: beyond ``max_bytes`` (reckoned from words and characters) the benchmark's
windows stay a table, hashes of the documents' windows are shuffled to them, and what matches goes back to its document,
where it is verified in the same way; both ways give equal rows.

Null text has no words. Repeated rows of documents are judged each on their own; items that share an id count once, with the
windows of all their rows. Items with a null id are searched under the id ''. Empty tables: no documents give no rows, no
items give n_hit 0. A text of any length is scanned in one task. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm import windows

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = RESULT + ", kept string"
#: Bytes that the set may hold in each task: two hashes, a place and items for each window, and the words themselves.
MAX_BYTES = 128_000_000
BYTES_A_WORD = 64


class Words:
    """Normalised words of a run of texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = scan.LOWER[buf]
        self.starts, self.ends = scan.spans(scan.ALNUM[buf], offsets)
        self.hashes = scan.span_hashes(self.buf, self.starts, self.ends)
        self.offsets = np.searchsorted(self.starts, offsets)

    def phrase(self, first: int, n: int) -> bytes:
        """n words joined by blanks."""
        return b" ".join(self.buf[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + n))

    def valid(self, n: int) -> np.ndarray:
        """First words of all windows of n words that lie in one text."""
        first = np.arange(len(self.hashes) - n + 1)
        if not len(first):
            return first
        return first[scan.owners(self.offsets, first) == scan.owners(self.offsets, first + n - 1)]


class TestSet:
    """Windows of the items in flat arrays: per length sorted hashes, a place of each distinct window, and its items."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.items = np.array([i for i, _ in items], dtype=object)
        self.words = w = Words(*scan.flat(pa.array([t or "" for _, t in items], pa.string())))
        sizes = np.diff(w.offsets)
        self.by_length = {}
        for size in np.unique(np.minimum(sizes[sizes > 0], n)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, n) == size)
            each = sizes[mine] - size + 1
            first, owner = windows.ranges(w.offsets[:-1][mine], each), np.repeat(mine, each)
            hashes, check = (scan.window_hashes(w.hashes, size, seed)[first] for seed in (3, 4))
            order = np.lexsort((owner, check, hashes))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(hashes[order]) != 0) | (np.diff(check[order]) != 0)
            at = np.flatnonzero(fresh)
            self.by_length[size] = (hashes[order][at], first[order][at], np.append(at, len(order)), owner[order].astype(np.int32))

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the items found in each text."""
        starts, ends, items = [], [], {}
        for size, (hashes, places, at, owners) in self.by_length.items():
            first = w.valid(size)
            if not len(first):
                continue
            own = scan.window_hashes(w.hashes, size)[first]
            low = np.searchsorted(hashes, own)
            found = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own)
            texts = scan.owners(w.offsets, first[found])
            for i, text in zip(found.tolist(), texts.tolist(), strict=True):
                k, phrase = int(low[i]), w.phrase(int(first[i]), size)
                while k < len(hashes) and hashes[k] == own[i]:
                    if self.words.phrase(int(places[k]), size) == phrase:
                        starts.append(int(first[i]))
                        ends.append(int(first[i]) + size)
                        items.setdefault(text, set()).update(owners[at[k] : at[k + 1]].tolist())
                    k += 1
        return scan.cover(len(w.hashes), np.array(starts, np.int64), np.array(ends, np.int64)), items


def _rows(ids: pa.Array, w: Words, hit: np.ndarray, names: list[list[str]], share: float, raw: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(hit)])
    n, h = np.diff(w.offsets), np.diff(total[w.offsets])
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    columns = [ids.cast(pa.int64()), pa.array(n), pa.array(h), pa.array([len(x) for x in names], pa.int64()), pa.array(digests), pa.array((h > 0) & (h >= share * n))]
    if raw is None:
        return pa.RecordBatch.from_arrays(columns, schema=windows.arrow_schema(RESULT))
    buf, offsets = raw
    gone = scan.cover(len(buf), w.starts[hit], w.ends[hit])
    kept = [buf[a:b][~gone[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())], schema=windows.arrow_schema(SPANS))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def test_set(benchmark: DataFrame, n: int, max_bytes: int) -> Broadcast | None:
    """The broadcast set, or None if the benchmark's would be larger than max_bytes."""
    words = F.size(F.regexp_extract_all("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0)))
    n_words, n_bytes = _items(benchmark).select(F.sum(words), F.sum(F.octet_length("text"))).first()
    if BYTES_A_WORD * (n_words or 0) + 2 * (n_bytes or 0) > max_bytes:
        return None
    rows = [tuple(r) for r in _items(benchmark).distinct().collect()]
    return benchmark.sparkSession.sparkContext.broadcast(TestSet(rows, n))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, with_text: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a benchmark window), n_items, items_sha256, contaminated.

    docs: doc_id, text; benchmark: item_id, text. contaminated: n_hit > 0 and n_hit >= share * n_words. with_text adds
    ``kept``: the text without the hit words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = _items(benchmark)
    schema = SPANS if with_text else RESULT
    test = test_set(benchmark, n, max_bytes)
    if test is None:
        return _by_shuffle(docs, items, n, share, with_text, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                w = Words(buf, offsets)
                hit, found = test.value.scan(w)
                names = [sorted({test.value.items[i] for i in found.get(k, ())}) for k in range(part.num_rows)]
                yield _rows(part.column("doc_id"), w, hit, names, share, (buf, offsets) if with_text else None)

    return docs.mapInArrow(work, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    test = test_set(benchmark, n, max_bytes)
    if test is None:
        bad = decontaminate(docs, benchmark, n, share, max_bytes=max_bytes).filter("contaminated").select("doc_id")
        return docs.join(bad.distinct(), "doc_id", "left_anti").select(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                w = Words(buf, offsets)
                total = np.concatenate([[0], np.cumsum(test.value.scan(w)[0])])
                hit = np.diff(total[w.offsets])
                yield part.filter(pa.array((hit == 0) | (hit < share * np.diff(w.offsets))))

    return docs.mapInArrow(work, docs.schema)


def _windows(n: int):
    """Windows of n words of items (of a shorter one all of it) as rows id, size, hash, phrase."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                w, ids, rows = Words(buf, offsets), part.column("id").to_pylist(), []
                sizes = np.minimum(np.diff(w.offsets), n)
                hashes = {size: scan.window_hashes(w.hashes, size) for size in np.unique(sizes[sizes > 0]).tolist()}
                for k, size in enumerate(sizes.tolist()):
                    rows += [{"id": ids[k], "size": size, "hash": int(hashes[size][f].astype(np.int64)), "phrase": w.phrase(f, size).decode()} for f in range(int(w.offsets[k]), int(w.offsets[k + 1]) - size + 1)] if size else []
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("phrase", pa.string())]))

    return work


def _by_shuffle(docs: DataFrame, items: DataFrame, n: int, share: float, with_text: bool, schema: str) -> DataFrame:
    """The same for a benchmark of any size: windows meet by hash, matches go back to their document's row and are verified."""
    tests = items.select(F.col("item_id").alias("id"), "text").mapInArrow(_windows(n), "id string, size int, hash long, phrase string").distinct()
    sizes = [r[0] for r in tests.select("size").distinct().collect()]  # n at most
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).withColumn("copies", F.lit(1))
    each = rows.groupBy("row", "doc_id", "text").agg(F.count("*").alias("copies"))  # repeated rows are scanned once

    def scan_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                w, ids = Words(buf, offsets), np.asarray(part.column("row"))
                for size in sizes:
                    first = w.valid(size)
                    if len(first):
                        text = scan.owners(w.offsets, first)
                        hashes = scan.window_hashes(w.hashes, size)[first].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array((first - w.offsets[text]).astype(np.int32)), pa.array(np.full(len(first), size, np.int32)), pa.array(hashes)], names=["row", "first", "size", "hash"])

    seen = each.select("row", "text").mapInArrow(scan_docs, "row long, first int, size int, hash long")
    grouped = tests.groupBy("size", "hash", "phrase").agg(F.collect_set("id").alias("ids"))
    hits = seen.join(grouped, ["size", "hash"]).groupBy("row").agg(F.collect_list(F.struct("first", "size", "phrase", "ids")).alias("spans"))
    joined = each.join(hits, "row", "left").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                w, at, names = Words(buf, offsets), [], []
                for k, spans in enumerate(part.column("spans").to_pylist()):
                    good = [s for s in spans or [] if w.phrase(int(w.offsets[k]) + s["first"], s["size"]) == s["phrase"].encode()]
                    at += [(int(w.offsets[k]) + s["first"], s["size"]) for s in good]
                    names.append(sorted({i for s in good for i in s["ids"]}))
                runs = np.array(at, np.int64).reshape(-1, 2)
                yield _rows(part.column("doc_id"), w, scan.cover(len(w.hashes), runs[:, 0], runs.sum(axis=1)), names, share, (buf, offsets) if with_text else None)

    return joined.select("doc_id", "text", "spans").mapInArrow(finish, schema)
