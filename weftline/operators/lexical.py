"""Lexical search, cover density, heading search, markers.

Two scores of a text: distinct query tokens in it, then their total frequency (``lexical_topk``); or the density of the covers of
the query's lexemes (``cover_density_topk``). Ties go by id. An empty query matches nothing.

Texts are cut and hashed in tasks by numpy; words are known by 64-bit hashes. Queries are broadcast, at most ``MAX_TOKENS`` tokens
at once (beyond that in several passes over the texts, each with a part of the queries), and blocks of texts are scored against
all of them, so that a word that every text has costs no row: a block yields k rows a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.functions import text as T
from weftline.operators.fusion import ranked

#: Tokens of queries that are broadcast at once (about 100 bytes each), and bytes of folded text of a block.
MAX_TOKENS = 500_000
BLOCK_BYTES = 1_000_000
#: Counts by marker and source that a task holds.
MOST_COUNTS = 100_000
#: Texts of a block at most, and distinct tokens of the queries that are scored at once.
BLOCK = 1024
WIDTH = 8192


def _hashes(words: list[str]) -> np.ndarray:
    """As of the words of a block."""
    data = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64) if data else np.zeros(0, np.int64)
    return scan.span_hashes(np.frombuffer(b"".join(data), np.uint8), np.append(0, ends[:-1])[: len(data)], ends)


@dataclass
class Words:
    """The folded words of a block of texts: hash and text of each, in order."""

    hashes: np.ndarray
    owner: np.ndarray
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(buf: np.ndarray, offsets: np.ndarray) -> Words:
        starts, ends = scan.spans(scan.FOLDED[buf], offsets)
        return Words(scan.span_hashes(buf, starts, ends), scan.owners(offsets, starts), buf, starts, ends)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Words]]:
    """Ids and words of blocks of rows (id, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            for part, buf, offsets in scan.pieces(batch.slice(at, BLOCK), "text", BLOCK_BYTES):
                yield np.asarray(part.column("id")), Words.of(buf, offsets)


def _folded(rows: DataFrame, ident: str) -> DataFrame:
    return rows.select(F.col(ident).cast("long").alias(ident), T.fold_letters(F.coalesce("text", F.lit(""))).alias("text"))


def _passes(docs: DataFrame, queries: DataFrame, score: Callable[[DataFrame, list[tuple[int, str]]], DataFrame]) -> DataFrame:
    """score(docs, queries) over as many parts of the queries (query_id, folded text) as MAX_TOKENS asks for."""
    asked = _folded(queries, "query_id")
    tokens, n_queries = asked.agg(F.sum(F.regexp_count("text", F.lit("[a-z0-9]+"))), F.count("*")).first()
    parts = max(1, min(n_queries, -(-(tokens or 0) // max(1, MAX_TOKENS))))  # a pass has a query at least
    rows = _folded(docs, "id")
    if parts > 1:
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    each = [asked if parts == 1 else asked.filter(F.col("part") == i) for i in range(parts)]
    return reduce(DataFrame.unionByName, [score(rows, [(r["query_id"], r["text"]) for r in part.select("query_id", "text").collect()]) for part in each])


def _best(ids: np.ndarray, matched: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k matched rows of greatest order, ties by id (more if k falls into none)."""
    good = np.flatnonzero(matched)
    return good if len(good) <= k else good[np.lexsort((ids[good], -order[good]))[:k]]


class _Best:
    """The k best texts of each query (id, covers, score) among all that a task has seen; a task yields no more than these."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, {}

    def add(self, q: int, ids: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """Texts of no cover are left out."""
        before = self.rows.get(q)
        good = n > 0
        if before is not None and len(before[0]) >= self.k:
            good &= total >= before[2].min()
        good = np.flatnonzero(good)
        if len(good) == 0:
            return
        now = (ids[good], n[good], total[good])
        if before is not None:
            now = tuple(np.concatenate(x) for x in zip(before, now, strict=True))
        kept = _best(now[0], now[1], now[2], self.k)
        self.rows[q] = tuple(x[kept] for x in now)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """About 10,000 rows each."""
        some: list[tuple[int, tuple]] = []
        for i, x in enumerate(self.rows.items(), 1):
            some.append(x)
            if sum(len(r[0]) for _, r in some) >= 10_000 or i == len(self.rows):
                columns = [np.concatenate(c) for c in zip(*[r for _, r in some], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in some], [len(r[0]) for _, r in some]).astype(np.int64)), pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2])], names=["query_id", "id", "n_covers", "score"])
                some = []


def _by_width(asked: list[tuple[int, list[int]]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries (id, codes) in groups of at most WIDTH distinct codes: ids, sorted codes, and a 0/1 matrix of codes by queries."""
    groups: list[tuple[list[tuple[int, list[int]]], set[int]]] = [([], set())]
    for q, codes in asked:
        if groups[-1][0] and len(groups[-1][1].union(codes)) > WIDTH:
            groups.append(([], set()))
        groups[-1][0].append((q, codes))
        groups[-1][1].update(codes)
    out = []
    for queries, known in groups:
        wanted = np.array(sorted(known), np.int64)
        if len(wanted):
            want = np.zeros((len(wanted), len(queries)), np.float32)
            for j, (_, codes) in enumerate(queries):
                want[np.searchsorted(wanted, codes), j] = 1
            out.append((np.array([q for q, _ in queries], np.int64), wanted, want))
    return out


def _slices(asked: list[tuple[int, str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries in groups of at most WIDTH distinct tokens: ids, sorted hashes, and a 0/1 matrix of tokens by queries."""
    by_query: dict[int, dict[str, None]] = {}
    for q, text in asked:
        by_query.setdefault(q, {}).update(dict.fromkeys(re.findall("[a-z0-9]+", text)))
    groups: list[tuple[list[int], dict[str, None]]] = [([], {})]
    for q, tokens in by_query.items():
        if groups[-1][0] and len(groups[-1][1]) + len(tokens) > WIDTH:
            groups.append(([], {}))
        groups[-1][0].append(q)
        groups[-1][1].update(tokens)
    out = []
    for ids, words in groups:
        hashes = _hashes(list(words))
        order = np.argsort(hashes)
        place = {w: i for i, w in enumerate(np.array(list(words), object)[order])}
        m = np.zeros((len(words), len(ids)), np.float32)
        for j, q in enumerate(ids):
            m[[place[t] for t in by_query[q]], j] = 1
        out.append((np.array(ids, np.int64), hashes[order], m))
    return out


def _codes(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash, -1 if it isn't there."""
    if len(sorted_hashes) == 0:
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, at, -1)


def _scored(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, matched, tf: of each block of texts at least its k best for each query."""

    def score(rows: DataFrame, asked: list[tuple[int, str]]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(asked)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = _slices(shared.value)
            for ids, words in _blocks(batches):
                for names, hashes, want in groups:
                    code = _codes(hashes, words.hashes)
                    known = code >= 0
                    tf = np.bincount(words.owner[known] * len(hashes) + code[known], minlength=len(ids) * len(hashes)).reshape(len(ids), -1).astype(np.float32)
                    matched, total = ((tf > 0).astype(np.float32) @ want).astype(np.int64), (tf @ want).astype(np.int64)
                    order = (matched << 40) + np.minimum(total, (1 << 40) - 1)
                    for j, q in enumerate(names.tolist()):
                        good = _best(ids, matched[:, j], order[:, j], k)
                        if len(good):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), q)), pa.array(ids[good]), pa.array(matched[good, j]), pa.array(total[good, j])], names=["query_id", "id", "matched", "tf"])

        return rows.mapInArrow(work, "query_id long, id long, matched long, tf long")

    return _passes(docs, queries, score)


@dataclass(frozen=True)
class Language:
    """Words that carry nothing, and endings to take off: each pair (pattern, replacement) is applied once, in order."""

    stop: frozenset[str] = frozenset()
    endings: tuple[tuple[str, str], ...] = ()

    def lexeme(self, word: str) -> str:
        """Of a folded word; empty for a stop word."""
        if word in self.stop:
            return ""
        for pattern, new in self.endings:
            word = re.sub(pattern, new, word)
        return word


#: A light stemmer of French: plurals, adverbs, nouns of action, infinitives and feminines, at least three letters staying.
FRENCH = Language(
    frozenset("a au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me meme mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split()),
    ((r"^(.{2,})aux$", r"\1al"), (r"^(.{3,})[sx]$", r"\1"), (r"^(.{3,})ement$", r"\1"), (r"^(.{3,})ation$", r"\1"), (r"^(.{3,})(?:er|ir)$", r"\1"), (r"^(.{3,})e$", r"\1"), (r"^(.{3,})e$", r"\1")),
)


@dataclass
class _Lexemes:
    """From hashes of words to codes of lexemes, learnt word by word as they come."""

    language: Language
    codes: dict[str, int]
    known: dict[int, int] = field(default_factory=dict)

    def of(self, words: Words) -> np.ndarray:
        """The code of each word's lexeme, -1 of others."""
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        code = np.empty(len(distinct), np.int64)
        for i, (h, at) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            if h not in self.known:
                if len(self.known) > 200_000:
                    self.known.clear()
                word = words.buf[words.starts[at] : words.ends[at]].tobytes().decode()
                self.known[h] = self.codes.get(self.language.lexeme(word), -1)
            code[i] = self.known[h]
        return code[which]


Term = tuple[tuple[str, int], ...]


def parse_query(text: str, language: Language) -> list[Term]:
    """The distinct terms of a query: lexemes, and quoted phrases as several, each with its distance from the first. Stop words are
    left out, but count in distances."""
    out: dict[Term, None] = {}
    for phrase, word in re.findall(r'"([^"]*)"|([^"\s]+)', text):
        found = [(x, i) for i, x in enumerate(language.lexeme(w) for w in re.findall("[a-z0-9]+", phrase or word)) if x]
        for term in [tuple((x, i - found[0][1]) for x, i in found)] if phrase else [((x, 0),) for x, _ in found]:
            if term:
                out[term] = None
    return list(out)


def covers(owner: np.ndarray, first: np.ndarray, last: np.ndarray, term: np.ndarray, n_terms: int, need_all: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last position of the minimal covers of a query: they hold every term, or any if not need_all, and none
    holds a smaller one.

    Hits (text, first and last position, term) come by text and last position. The shortest cover that ends with a hit begins with
    the least of the terms' latest hits so far (the latest of all for any); it is minimal if it begins after the one before.
    """
    base = np.int64(last.max(initial=0) + 2)  # texts one after the other, so that running maxima can't reach back
    begin = np.full(len(owner), np.iinfo(np.int64).max)
    for t in range(n_terms if need_all else 1):
        here = term == t if need_all else np.ones(len(owner), bool)
        begin = np.minimum(begin, np.maximum.accumulate(np.where(here, owner * base + first + 1, 0)) - owner * base - 1)
    ends = np.flatnonzero(np.append((owner[1:] != owner[:-1]) | (last[1:] != last[:-1]), True)) if len(owner) else owner
    owner, begin, last = owner[ends], np.maximum(begin[ends], -1), last[ends]
    before = np.append(-1, begin[:-1])[: len(begin)]
    before[np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])] = -1
    new = begin > before
    return owner[new], begin[new], last[new]


def cover_density_topk(docs: DataFrame, queries: DataFrame, k: int, language: Language = FRENCH, need_all: bool = False, weight: float = 0.1) -> DataFrame:
    """query_id, id, n_covers, score, rank of the k densest texts of each query; docs: id, text; queries: query_id, text.

    Texts and queries become lexemes of the language, a word's place being its number in the text. A query is its lexemes and
    quoted phrases, any of them or all. Each minimal cover counts ``weight`` divided by 1 + the words in it that are no lexeme of
    the query; a text's score is the sum over its covers, rounded to 6 decimals.
    """

    def score(rows: DataFrame, asked: list[tuple[int, str]]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(asked)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parsed = [(q, parse_query(text, language)) for q, text in shared.value]
            codes: dict[str, int] = {}
            for _, terms in parsed:
                for term in terms:
                    for lexeme, _ in term:
                        codes.setdefault(lexeme, len(codes))
            lexemes, best = _Lexemes(language, codes), _Best(k)
            # If any lexeme will do, each occurrence of one is a cover by itself, and nothing but their number counts.
            single = [not need_all and all(len(term) == 1 for term in terms) for _, terms in parsed]
            counted = _by_width([(q, [codes[term[0][0]] for term in terms]) for (q, terms), alone in zip(parsed, single, strict=True) if alone])
            placed = [x for x, alone in zip(parsed, single, strict=True) if not alone]
            for ids, words in _blocks(batches):
                code = lexemes.of(words)
                hits = np.flatnonzero(code >= 0)
                for names, wanted, want in counted:
                    at = _codes(wanted, code[hits])
                    known = at >= 0
                    tf = np.bincount(words.owner[hits[known]] * len(wanted) + at[known], minlength=len(ids) * len(wanted)).reshape(len(ids), -1)
                    exact = np.float32 if len(hits) < 1 << 24 else np.float64
                    n = (tf.astype(exact) @ want.astype(exact, copy=False)).astype(np.int64)
                    for j, q in enumerate(names.tolist()):
                        best.add(q, ids, n[:, j], np.round(weight * n[:, j], 6))
                if not placed:
                    continue
                first = np.searchsorted(words.owner, np.arange(len(ids)))
                by = hits[np.argsort(code[hits], kind="stable")]
                cut = np.searchsorted(code[by], np.arange(len(codes) + 1))
                at = lambda lexeme: by[cut[codes[lexeme]] : cut[codes[lexeme] + 1]]  # noqa: E731, B023
                for q, terms in placed:
                    found, common = [], None
                    for t, term in enumerate(terms):
                        start = at(term[0][0])
                        for lexeme, away in term[1:]:
                            start = start[np.isin(start + away, at(lexeme))]
                        start = start[words.owner[start] == words.owner[np.minimum(start + term[-1][1], len(code) - 1)]]
                        if need_all:  # only texts that have every term so far
                            here = np.zeros(len(ids), bool)
                            here[words.owner[start]] = True
                            common = here if common is None else common & here
                            if not common.any():
                                break
                        found.append((start, t, term[-1][1]))
                    if len(found) < len(terms) or not found:
                        continue
                    if need_all:
                        found = [(start[common[words.owner[start]]], t, away) for start, t, away in found]
                    every = np.concatenate([np.stack([words.owner[x], x - first[words.owner[x]], x - first[words.owner[x]] + away, np.full(len(x), t)], axis=1) for x, t, away in found])
                    if len(every) == 0:
                        continue
                    owner, begin, end = covers(*every[np.lexsort((every[:, 2], every[:, 0]))].T, len(terms), need_all)
                    used = np.unique(np.concatenate([at(x) for term in terms for x, _ in term]))
                    head = first[owner]
                    inside = np.searchsorted(used, head + end, side="right") - np.searchsorted(used, head + begin)
                    total = np.round(np.bincount(owner, weight / (2 + end - begin - inside), len(ids)), 6)
                    best.add(q, ids, np.bincount(owner, minlength=len(ids)), total)
            yield from best.batches()

        return rows.mapInArrow(work, "query_id long, id long, n_covers long, score double")

    return ranked(_passes(docs, queries, score), ["query_id"], [F.desc("score"), F.col("id")], k)


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, matched, tf, rank; docs: id (one row each), text; queries: query_id, text."""
    return ranked(_scored(docs, queries, k), ["query_id"], [F.desc("matched"), F.desc("tf"), F.col("id")], k)


def heading_topk(headings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, matched, rank; headings: id, text."""
    once = headings.select("id", F.array_join(F.array_distinct(T.words(F.coalesce("text", F.lit("")))), " ").alias("text"))
    return ranked(_scored(once, queries, k).select("query_id", "id", "matched"), ["query_id"], [F.desc("matched"), F.col("id")], k)


def marker_search(docs: DataFrame, markers: DataFrame, most: int = 200_000) -> DataFrame:
    """Of each marker how many docs and sources contain it, and the first; markers: item_id, marker; docs: doc_id, source, body.

    The distinct markers (``most`` at most, else an error) are broadcast; each text is scanned once for all of them, and counts
    by marker and source are all that leaves a task. An empty marker is in every text.
    """
    wanted = [r[0] for r in markers.select("marker").distinct().limit(most + 1).collect()]
    if len(wanted) > most:
        raise ValueError(f"more than {most} markers")
    shared = docs.sparkSession.sparkContext.broadcast([m for m in wanted if m is not None])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, found = _finder(shared.value), {}
        for batch in batches:
            for doc, source, body in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), batch.column("body"), strict=True):
                for m in scan(body.as_py() or ""):
                    n, first = found.get((m, source), (0, None))
                    found[m, source] = n + 1, doc if first is None or (doc is not None and doc < first) else first
                if len(found) > MOST_COUNTS:
                    yield _counted(found)
                    found.clear()
        if found:
            yield _counted(found)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "body").mapInArrow(work, "marker string, source string, n long, doc long")
    counts = found.groupBy("marker").agg(F.sum("n").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.min("doc").alias("first_doc"))
    zero = F.lit(0).cast("long")
    return markers.join(counts, "marker", "left").select("item_id", "marker", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_sources", zero).alias("n_sources"), "first_doc")


def _counted(found: dict[tuple[str, str | None], tuple[int, int | None]]) -> pa.RecordBatch:
    """Counts and first texts by marker and source as rows."""
    columns = zip(*((m, s, n, doc) for (m, s), (n, doc) in found.items()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["marker", "source", "n", "doc"])


def _finder(markers: list[str]):
    """A function from a text to the markers in it."""
    everywhere = [m for m in markers if m == ""]
    try:
        import ahocorasick
    except ImportError:
        return lambda text: everywhere + [m for m in markers if m and m in text]
    machine = ahocorasick.Automaton()
    for m in markers:
        if m:
            machine.add_word(m, m)
    if not len(machine):
        return lambda text: everywhere
    machine.make_automaton()
    return lambda text: everywhere + list({m for _, m in machine.iter(text)})
