"""Packing of token sequences by shortest-pack-first over the length histogram.

1. Tasks tokenise whole documents and cut each into full pieces of ``length`` ids and a rest. Only the pieces' measures go on.
2. The histogram of piece lengths (at most ``length`` rows, whatever the corpus) is packed on the driver: lengths are placed
   longest first into the open packing pattern with the fewest ids that still fits, and pattern counts are updated.
3. Patterns become intervals of ranks per length. A piece's rank within its length is its number among those of its task, as
   counted while they were cut, and the counts of the tasks before it; ranks are joined to the intervals. No piece is sorted.

The histogram decides all, so the work on the driver doesn't grow with the corpus; ranks and sequence ids are longs.

Null text counts as empty and is one piece of the end id alone. Repeated rows and rows without an id are packed each on their
own. A text of any length is tokenised in one task. An empty table gives an empty result. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm import windows
from weftline.llm.scratch import Scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
LENGTH = 2048
END = 1
#: Distinct pieces that a worker's table holds (about 30 MB) before it starts anew.
MAX_WORDS = 800_000
#: Pieces that are encoded at once; the tokenizer's objects take about 2 kB each meanwhile.
ENCODED_AT_ONCE = 4096

_tables: dict[str, WordTable] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
#: 0 white space, 1 letters, 2 digits, 3 marks, 4 beyond ASCII.
KIND = np.where(~scan.NOT_SPACE, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, np.where(np.arange(256) < 128, 3, 4)))).astype(np.uint8)


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of text whose tokens don't depend on each other: lowered bytes, starts and ends.

    The tokenizer normalises to NFC, lowers, drops white space, cuts at changes between letters, digits and marks, and merges
    within what is left. So white space always ends a piece, and a change between ASCII letters, digits and marks does,
    except in words with an apostrophe (contractions) or "<|" (special tokens); those stay whole. ASCII letters may be lowered
    beforehand where no byte beyond ASCII (which might compose with them) is in the word and no "<|".
    """
    n = len(buf)
    starts, ends = scan.spans(KIND[buf] > 0, offsets)
    if n == 0:
        return buf, starts, ends
    kind = KIND[buf]
    word = np.searchsorted(starts, np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)), side="right") - 1
    special = np.zeros(len(starts) + 1, bool)
    special[word] = True
    whole = special.copy()
    whole[np.searchsorted(starts, np.flatnonzero(buf == 39), side="right") - 1] = True
    mixed = special.copy()
    mixed[np.searchsorted(starts, np.flatnonzero(buf >= 128), side="right") - 1] = True
    of_byte = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.flatnonzero(kind > 0)
    low = buf.copy()
    plain = at[~mixed[of_byte]]
    low[plain] = scan.LOWER[buf[plain]]
    change = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[1:] < 4) & (kind[:-1] < 4)
    cut = np.flatnonzero(change) + 1
    cut = cut[~whole[np.searchsorted(starts, cut, side="right") - 1]]
    cut = np.setdiff1d(cut, starts, assume_unique=True)
    return low, np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


class WordTable:
    """Token ids of the pieces of text seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel; threads each keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: sorted, none of them in the table yet."""
        parts, counts = [self.ids], []
        for a in range(0, len(words), ENCODED_AT_ONCE):
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + ENCODED_AT_ONCE], add_special_tokens=False)]
            counts += [len(x) for x in encoded]
            parts.append(np.fromiter((i for x in encoded for i in x), np.uint32))
        sizes = np.array(counts, np.int64)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate(parts)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.sizes = np.insert(self.hashes, at, hashes), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, with the end id after each text, and offsets per text."""
        low, starts, ends = units(buf, offsets)
        hashes = scan.span_hashes(low, starts, ends)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > MAX_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        new = np.ones(len(unique), bool) if not len(self.hashes) else self.hashes[at] != unique
        if new.any():
            self.add(unique[new], [low[starts[i] : ends[i]].tobytes().decode("utf-8") for i in first[new].tolist()])
        at = np.searchsorted(self.hashes, unique)[which]
        sizes = self.sizes[at]
        words_at = np.searchsorted(starts, offsets)
        n = len(offsets) - 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        cuts = total[words_at] + np.arange(n + 1)  # an end id after each text
        out = np.full(int(cuts[-1]), END, np.uint32)
        doc = scan.owners(words_at, np.arange(len(at)))
        out[windows.ranges(total[:-1] + doc, sizes)] = self.ids[windows.ranges(self.starts[at], sizes)]
        return out, cuts


def measure(docs: DataFrame, path: str, length: int) -> DataFrame:
    """Rows of pieces without their ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tables:
            _tables[path] = WordTable(path)
        table, seen, task = _tables[path], np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                ids, cuts = table.encode(buf, offsets)
                sizes = np.diff(cuts)
                each = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), each)
                start = windows.ranges(np.zeros(len(each), np.int64), each) * length
                size = np.minimum(length, sizes[doc] - start)
                data, at = memoryview(ids.astype("<u4").tobytes()), cuts[doc] + start
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                names = part.column("doc_id").take(pa.array(doc))
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order])
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - first + seen[size[order]]
                seen += np.bincount(size, minlength=length + 1)
                yield pa.RecordBatch.from_arrays([names, pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)], schema=windows.arrow_schema(PIECES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, PIECES)


def pack_histogram(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (their piece lengths, in order of placing) and how often each is used."""
    done: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[list]] = {}  # ids in the pattern -> [lengths, count]
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            filled = min((f for f in open_ if f + size <= length), default=None)
            if filled is None:
                per = length // size
                whole, rest = divmod(left, per)  # packs of this length alone
                if whole:
                    _put(open_, done, [(size,) * per, whole], length)
                if rest:
                    _put(open_, done, [(size,) * rest, 1], length)
                break
            lengths, count = open_[filled].pop()
            if not open_[filled]:
                del open_[filled]
            used = min(count, left)
            _put(open_, done, [(*lengths, size), used], length)
            if count > used:
                open_.setdefault(filled, []).append([lengths, count - used])
            left -= used
    return done + [(tuple(p), n) for group in open_.values() for p, n in group]


def _put(open_: dict[int, list[list]], done: list, pattern: list, length: int) -> None:
    total = sum(pattern[0])
    if total == length:
        done.append((tuple(pattern[0]), pattern[1]))
    else:
        open_.setdefault(total, []).append(pattern)


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks (sorted), the sequence id of each first rank, and the offset in the sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, count in patterns:
        at = 0
        for size in lengths:
            rank = used.get(size, 0)
            out.setdefault(size, []).append((rank, base, at))
            used[size] = rank + count
            at += size
        base += count
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in out.items()}


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text. path: the tokenizer's file (on every machine).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(measure(docs, path or tokenizer_path(), length), "pieces")
    counts = scratch.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = spark.sparkContext.broadcast(intervals(pack_histogram(histogram, length)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "task"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size).tolist():
                mine = np.flatnonzero(size == n)
                first, ids, at = table.value[n]
                k = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = ids[k] + rank[mine] - first[k], at[k]
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=windows.arrow_schema(PACKED))

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).cast("long").alias("rank")).mapInArrow(place, PACKED)
