"""Runs: stretches of words that repeat with one period, three times and more, found by Crochemore's partition refinement.

For l = 1, 2, ... positions of a text are divided into classes of equal factors of l words. From l to l + 1 a class falls apart
by the classes of the positions after its members; only classes that are new, and of those that one class became all but the
largest, can part others (the smaller half), so that each position moves at most log2(n) times. Two neighbouring members of a
class at distance l are a square of primitive root l; consecutive squares are one run. Levels end at a third of a text's words,
as a run has at least three periods.

A task refines the texts of a slice together, each by itself (classes never span two texts): a level is a few numpy passes over
the positions that move, whatever the number of texts. Slices hold texts of similar length, as all take the levels of the
longest. Words count as equal by two 64-bit hashes. Nothing is shuffled.

Null texts have no words. Rows with a null id are looked at as they are. Repeated rows get a row each. A text of any length is
one slice at least; an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm.windows import ranges

#: Bytes of text that one refinement takes (a longer text is one of its own).
SLICE_BYTES = 8_000_000
#: A run has this many words and this many periods, or more.
LEAST_WORDS = 24
LEAST_PERIODS = 3


class Partition:
    """Positions 0 .. n - 1 in classes, each with its members in a segment of ``order`` (any order within it) and linked from each
    position to the next one of its class."""

    def __init__(self, key: np.ndarray):
        """Classes by equal key, taken by position."""
        n = len(key)
        self.order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[self.order][1:] != key[self.order][:-1]
        first = np.flatnonzero(fresh)
        self.of, self.slot = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.order], self.slot[self.order] = np.cumsum(fresh) - 1, np.arange(n)
        self.n_classes = len(first)
        self.begin, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)  # there are never more classes than positions
        self.begin[: len(first)], self.size[: len(first)] = first, np.diff(np.append(first, n))
        self.next, self.before = np.full(n + 1, -1), np.full(n + 1, -1)  # the last entry takes what is written for "none"
        inner = np.flatnonzero(~fresh)
        self.next[self.order[inner - 1]], self.before[self.order[inner]] = self.order[inner], self.order[inner - 1]
        self.flag, self.number = np.zeros(n + 1, bool), np.zeros(n, np.int64)  # room for marks of one level

    def refine(self, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One level: part all classes by the classes of ``moved``. Returns the positions that are now in new classes, and those
        that have another next one."""
        at = np.sort(moved) - 1
        at = at[at >= 0]
        at = at[self.size[self.of[at]] > 1]
        if len(at) == 0:
            return at, at
        old = self.of[at]
        key = old * len(self.order) + self.of[at + 1]
        by = np.argsort(key, kind="stable")
        at, old, key = at[by], old[by], key[by]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # groups: those of one class that move alike
        size, parent = np.diff(np.append(cut, len(at))), old[cut]
        own = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))  # the first group of each class
        n_groups = np.diff(np.append(own, len(cut)))
        rest = self.size[parent[own]] - np.add.reduceat(size, own)
        largest = np.maximum.reduceat(size, own)
        # The largest part keeps the class's number: the rest, or the first of the largest groups, and then the rest moves too.
        stays = np.zeros(len(cut), bool)
        outgrown = np.repeat(largest > rest, n_groups) & (size == np.repeat(largest, n_groups))
        hit = np.flatnonzero(outgrown)
        stays[hit[np.append(True, parent[hit][1:] != parent[hit][:-1])] if len(hit) else hit] = True
        go = np.repeat(~stays, size)
        positions, group = at[go], np.repeat(np.arange(len(cut)), size)[go]
        swap = own[(largest > rest) & (rest > 0)]
        if len(swap):
            self.flag[at] = True
            every = self.order[ranges(self.begin[parent[swap]], self.size[parent[swap]])]
            others = np.sort(every[~self.flag[every]])
            self.flag[at] = False
            self.number[parent[swap]] = len(cut) + np.arange(len(swap))
            positions, group = np.concatenate([positions, others]), np.concatenate([group, self.number[self.of[others]]])
            by = np.lexsort((positions, group, self.of[positions]))
            positions, group = positions[by], group[by]
        return (positions, self._move(positions, group)) if len(positions) else (positions, positions)

    def _move(self, positions: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Take positions (sorted by class, group, place) out of their classes into a new one for each group."""
        old = self.of[positions]
        own = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        count, parent = np.diff(np.append(own, len(old))), old[own]
        # Links of what stays: chains of neighbours that go are skipped.
        self.flag[positions] = True
        heads, tails = positions[~self.flag[self.before[positions]]], positions[~self.flag[self.next[positions]]]
        n = np.int64(len(self.order))
        heads, tails = heads[np.argsort(self.of[heads] * n + heads)], tails[np.argsort(self.of[tails] * n + tails)]
        a, b = self.before[heads], self.next[tails]
        # Segments: those that go take the last slots, whose stayers take the slots that become free.
        last = ranges(self.begin[parent] + self.size[parent] - count, count)
        free = self.slot[positions][self.slot[positions] < np.repeat(self.begin[parent] + self.size[parent] - count, count)]
        stayers = self.order[last][~self.flag[self.order[last]]]
        self.flag[positions] = False
        self.order[free], self.slot[stayers] = stayers, free
        self.order[last], self.slot[positions] = positions, last
        self.next[a], self.before[b] = b, a
        self.next[-1] = self.before[-1] = -1
        self.size[parent] -= count
        fresh = np.append(True, group[1:] != group[:-1])
        cut = np.flatnonzero(fresh)
        self.of[positions] = self.n_classes + np.cumsum(fresh) - 1
        new = slice(self.n_classes, self.n_classes + len(cut))
        self.begin[new], self.size[new] = last[cut], np.diff(np.append(cut, len(positions)))
        self.n_classes += len(cut)
        after = np.append(positions[1:], -1)
        after[np.append(cut[1:], len(positions)) - 1] = -1
        ahead = np.append(-1, positions[:-1])
        ahead[cut] = -1
        changed = np.concatenate([positions[self.next[positions] != after], a[a >= 0]])
        self.next[positions], self.before[positions] = after, ahead
        return changed


def find_runs(words: np.ndarray, again: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (within the text), length and period of each run, by text, start and period. words, again: two hashes of
    each word of texts that lie end to end at offsets."""
    n_texts, sizes = len(offsets) - 1, np.diff(offsets)
    # A position of its own after each text ends all factors that reach it.
    n = len(words) + n_texts
    text = np.repeat(np.arange(n_texts), sizes + 1)
    ends = offsets[1:] + np.arange(n_texts)
    inside = np.ones(n, bool)
    inside[ends] = False
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[inside], two[inside] = words, again
    with np.errstate(over="ignore"):
        key = scan.mix(one + scan.keys(n_texts, 71)[text])
        two = scan.mix(two + scan.keys(n_texts, 72)[text])
        key[ends] = scan.keys(n_texts, 73)
    by = np.argsort(key, kind="stable")
    if np.any((key[by][1:] == key[by][:-1]) & (two[by][1:] != two[by][:-1])):  # the first hash alone doesn't tell
        by = np.lexsort((two, key))
        key[by] = np.cumsum(np.append(True, (key[by][1:] != key[by][:-1]) | (two[by][1:] != two[by][:-1])))
    p = Partition(key)
    furthest = (sizes // LEAST_PERIODS)[text]  # the last level of a position's text
    squares: dict[int, list[np.ndarray]] = defaultdict(list)  # by distance: positions whose next one is so far

    def note(positions: np.ndarray, level: int) -> None:
        gap = p.next[positions] - positions
        near = (gap >= level) & (gap <= furthest[positions])
        positions, gap = positions[near], gap[near]
        if len(gap) == 0:
            return
        by = np.argsort(gap, kind="stable")
        positions, gap = positions[by], gap[by]
        cut = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
        for g, a, b in zip(gap[cut].tolist(), cut.tolist(), np.append(cut[1:], len(gap)).tolist(), strict=True):
            squares[g].append(positions[a:b])

    found = []
    moved, level = np.arange(n), 1
    note(moved, 1)
    while True:
        if level in squares:
            at = np.unique(np.concatenate(squares.pop(level)))
            at = at[p.next[at] - at == level]
            if len(at):
                cut = np.flatnonzero(np.append(True, np.diff(at) != 1))
                length = np.diff(np.append(cut, len(at))) - 1 + 2 * level
                long = length >= max(LEAST_WORDS, LEAST_PERIODS * level)
                found.append((at[cut][long], length[long], np.full(int(long.sum()), level)))
        moved = moved[furthest[moved] > level]
        if len(moved) == 0 and not squares:
            break
        level += 1
        moved, changed = p.refine(moved)
        note(changed, level)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    owner = text[start]
    start = start - (offsets[:-1] + np.arange(n_texts))[owner]
    by = np.lexsort((period, start, owner))
    return owner[by], start[by], length[by], period[by]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) for the texts, a tenth, in which word i >= a is to be read as word a + (i - a) % p."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch's rows, short texts first."""
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0)
    return scan.pieces(batch.take(pa.compute.sort_indices(size)), "text", SLICE_BYTES)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest exact length / period; of equal ones the first in (start, period) order, in which runs come."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, tails: bool = False, with_text: bool = False) -> DataFrame:
    """Runs of each text and the text without their repeats.

    docs: doc_id, text. tails: first make a tenth of the texts end in repeats, as ``repeated_tail`` says. Returns a row for each
    document: doc_id, n_runs, the run of greatest exponent (start, length, period, 1000 * exponent; null if there is none), hashes
    of all runs and of the words that stay when each run keeps its first period alone; with_text adds all runs and the words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _slices(batch):
                ids, n_docs = part.column("doc_id").to_pylist(), part.num_rows
                starts, ends = scan.spans(scan.NOT_SPACE[buf], offsets)
                first = np.searchsorted(starts, offsets)
                source = np.arange(len(starts))
                for i, doc_id in enumerate(ids if tails else []):
                    repeat = repeated_tail(doc_id, int(first[i + 1] - first[i]))
                    if repeat:
                        tail = source[first[i] + repeat[0] : first[i + 1]]
                        tail[:] = tail[0] + np.arange(len(tail)) % repeat[1]
                one, two = scan.span_hashes(buf, starts, ends, 5)[source], scan.span_hashes(buf, starts, ends, 6)[source]
                owner, start, length, period = find_runs(one, two, first)
                gone = scan.cover(len(source), first[owner] + start + period, first[owner] + start + length)
                kept = source[~gone]
                at = np.cumsum(np.append(0, ends[kept] - starts[kept] + 1))
                text = buf[np.minimum(ranges(starts[kept], ends[kept] - starts[kept] + 1), max(0, len(buf) - 1))]
                text[at[1:] - 1] = 0x20
                text, at = text.tobytes(), at[first - np.append(0, np.cumsum(gone))[first]].tolist()
                cut, runs = np.searchsorted(owner, np.arange(n_docs + 1)).tolist(), list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                rows = []
                for i, doc_id in enumerate(ids):
                    mine, left = runs[cut[i] : cut[i + 1]], text[at[i] : max(at[i], at[i + 1] - 1)]
                    best = _best(mine) if mine else (None, None, None)
                    listed = "".join(f"{a},{b},{c}\n" for a, b, c in mine)
                    row = (doc_id, len(mine), *best, 1000 * best[1] // best[2] if mine else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                    rows.append((*row, [{"start": a, "length": b, "period": c} for a, b, c in mine], left) if with_text else row)
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES + ["runs", "kept"] * with_text)

    schema = RESULT + ", runs array<struct<start:long,length:long,period:long>>, kept binary" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
