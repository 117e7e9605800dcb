"""Quality classifier: a generalised additive model with pairwise interactions.

Each document has about a dozen measures of its text. Cyclic boosting goes round the features; each step fits a shallow tree
on one feature's bins to the gradient and adds it, shrunk, to that feature's lookup table. Then the pairs of features with
the most left to explain get tables over their two coarse bins in the same way. A score is the sum of table entries, looked
up for whole batches at once, through the logistic function.

The measures of all documents are taken in one pass and written; the model is fitted on the driver on the measures of a
bounded sample of labelled rows (``max_labelled``), and scoring reads measures only.

Null text counts as empty and gets a score like any other. Rows with a null id are scored and count as held out. Without
labelled rows of both kinds every score is the share of label 1 (0.5 if there is none). Repeated rows are scored each; of
several rows of a labelled id the one with the least measures is learnt from. A text of any length is measured in one task. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm.labels import MAX_LABELLED, held_out, training_rows
from weftline.llm.quality_rules import sums, text_counts
from weftline.llm.scratch import Scratch

FEATURES = ["log_words", "log_chars", "word_length", "symbol_share", "upper_share", "digit_share", "other_share", "mark_share", "dup_lines", "repeat_words", "distinct_words", "line_words", "long_words", "bang_share"]
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.isin(np.arange(256), list(b".,;:'\"()-"))
_BANG = np.isin(np.arange(256), list(b"!?"))


def measures(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    words, chars, symbols, dup_lines, repeat = text_counts(buf, offsets)
    starts, ends = scan.spans(scan.NOT_SPACE[buf], offsets)
    at = np.searchsorted(starts, offsets)
    lines = sums(buf == 10, offsets) + 1
    doc = scan.owners(at, np.arange(len(starts)))
    with np.errstate(over="ignore"):
        keys = scan.mix(scan.span_hashes(scan.LOWER[buf], starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(doc[first], minlength=len(offsets) - 1)
    size, n = np.maximum(np.diff(offsets), 1), np.maximum(words, 1)
    share = lambda mask: sums(mask[buf], offsets) / size
    columns = [np.log1p(words), np.log1p(chars), chars / n, symbols / size, share(_UPPER), share(_DIGIT), sums(buf >= 128, offsets) / size, share(_MARK), dup_lines / lines, repeat / n, distinct / n, np.log1p(words / lines), sums(ends - starts > 12, at) / n, share(_BANG)]
    return np.stack([c.astype(np.float64) for c in columns], 1)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree of at most ``leaves`` leaves on ordered bins."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        lg, lh, rg, rh = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
        s = lg * lg / (lh + 1) + rg * rg / (rh + 1) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
        i = int(np.argmax(s))
        return float(s[i]), int(k[i])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in parts), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        parts.remove((best[2], best[3]))
        parts += [(best[2], best[1]), (best[1], best[3])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per cell: the better axis is cut once, each side along the other axis."""
    best, value = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            sides = [_tree(a[s].sum(0), b[s].sum(0), 2) for s in (slice(0, cut), slice(cut, None))]
            v = np.concatenate([np.tile(sides[0], (cut, 1)), np.tile(sides[1], (len(a) - cut, 1))])
            gain = float((v * a).sum())
            if gain > best:
                best, value = gain, v.T if flip else v
    return value


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, cells: int = 8, rounds: int = 60, pairs: int = 5, rate: float = 0.2) -> Gam:
    """Cyclic boosting of one table a feature, then of a grid for each of the ``pairs`` best pairs."""
    p = (y.mean() if len(y) else 0.5).clip(1e-3, 1 - 1e-3) if len(y) else 0.5
    cut = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n)) if len(v) else np.zeros(0)
    width = x.shape[1]
    edges, coarse = [cut(x[:, f], bins) for f in range(width)], [cut(x[:, f], cells) for f in range(width)]
    model = Gam(float(np.log(p / (1 - p))), edges, coarse, [np.zeros(len(e) + 1) for e in edges], [], [])
    if len(np.unique(y)) < 2:
        return model
    at, out = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)], np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-out))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f in range(width):
            g, h = slope()
            step = rate * _tree(np.bincount(at[f], g, len(edges[f]) + 1), np.bincount(at[f], h, len(edges[f]) + 1), 4)
            model.tables[f] += step
            out += step[at[f]]
    small = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]
    sizes = [len(c) + 1 for c in coarse]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slope()
        cell = small[a] * sizes[b] + small[b]
        return tuple(np.bincount(cell, v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for v in (g, h))

    gains = {}
    for a, b in combinations(range(width), 2):
        g, h = grid(a, b)
        gains[a, b] = float((g * g / (h + 1)).sum())
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.grids = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * _tree2(*grid(a, b))
            model.grids[k] += step
            out += step[small[a], small[b]]
    return model


_MEASURED = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
_SCORED = "doc_id long, score double"


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier), predicted (1 if score >= threshold)."""
    spark = docs.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                m = measures(buf, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    measured = Scratch(spark, "gam").save(texts.mapInArrow(measure, _MEASURED), "measures")
    rows = measured.join(F.broadcast(training_rows(labels, label, max_labelled)), "doc_id")
    known = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "y")).alias("m")).orderBy("doc_id").select("m.*").toPandas()  # max_labelled rows
    model = spark.sparkContext.broadcast(fit(known[FEATURES].to_numpy(np.float64), known["y"].to_numpy(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(f)) for f in FEATURES], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    scored = measured.mapInArrow(score, _SCORED)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
