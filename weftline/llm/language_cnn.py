"""Language identification by a convolutional network over bytes.

Texts are cut into windows of ``WINDOW`` bytes, the last one padded with byte 0. Each byte has a vector; filters of several
widths slide over the vectors, each filter's maximum over the window is kept if it is positive, and a softmax over these gives a
window's probabilities. All windows of a text are scored, and a text's probabilities are the geometric mean of its windows', by
their bytes. In scoring, the filters' products with each byte are looked up in tables, for two neighbouring bytes at once.

The network is trained in numpy on the driver, by Adam, on at most ``max_rows`` labelled documents (dealt evenly over the
languages, chosen by a hash of the id) and ``PER_TEXT`` stretches of each: whole windows and shorter ones, so that short texts
are learnt as well. These bounds are on what is learnt, not on what is scored. Nothing is shuffled in scoring.

A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learnt. Rows with a null id or
language are not learnt from; null ids count as held out. Of several rows of an id in one language the least text is learnt.
A text of any length is scored in one task. Repeated rows get a row each; an empty table gives an empty result. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMENSION = 8
MAX_ROWS = 4000
PER_TEXT = 4
STEPS = 400
BATCH = 96
#: Windows that one numpy pass scores.
PASS = 512


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def windows_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as rows of bytes, the text of each and how many of its bytes are text."""
    sizes = np.diff(offsets)
    each = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), each)
    start = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
    filled = np.minimum(offsets[1:][owner] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    rows = np.where(np.arange(WINDOW) < filled[:, None], buf[np.minimum(at, len(buf) - 1)], 0) if len(owner) else np.zeros((0, WINDOW))
    return rows.astype(np.uint8), owner, filled


@dataclass
class Network:
    """bytes: a vector for each byte; filters by width: (width * dimension, filters); thresholds by width; out, bias: softmax."""

    languages: list[str]
    bytes: np.ndarray
    filters: list[np.ndarray]
    thresholds: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], rng: np.random.Generator) -> Network:
        def normal(scale: float, *shape: int) -> np.ndarray:
            return (scale * rng.standard_normal(shape)).astype(np.float32)

        inner = [normal(1 / np.sqrt(w * DIMENSION), w * DIMENSION, FILTERS) for w in WIDTHS]
        return Network(languages, normal(1, 256, DIMENSION), inner, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(0.1, FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes, *self.filters, *self.thresholds, self.out, self.bias]

    def gradients(self, rows: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over windows of the labels y, and its gradient by each of parameters()."""
        n, vectors = len(rows), self.bytes[rows]
        pooled, chosen = [], []
        for width, filters, threshold in zip(WIDTHS, self.filters, self.thresholds, strict=True):
            length = WINDOW - width + 1
            responses = sum(vectors[:, k : k + length] @ filters[k * DIMENSION : (k + 1) * DIMENSION] for k in range(width))
            place = responses.argmax(axis=1)
            chosen.append(place)
            pooled.append(np.take_along_axis(responses, place[:, None], axis=1)[:, 0] + threshold)
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        z = hidden @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean())
        dz = p.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        dh = (dz @ self.out.T) * (raw > 0)
        d_bytes, d_filters, d_thresholds = np.zeros_like(self.bytes), [], []
        for i, (width, filters) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]  # only the window's best place of a filter has a gradient
            at = chosen[i][:, :, None] + np.arange(width)
            seen = rows[np.arange(n)[:, None, None], at]
            x = self.bytes[seen].reshape(n, FILTERS, width * DIMENSION)
            d_filters.append(np.einsum("nf,nfx->xf", d, x))
            d_thresholds.append(d.sum(axis=0))
            dx = np.einsum("nf,xf->nfx", d, filters).reshape(-1, DIMENSION)
            np.add.at(d_bytes, seen.reshape(-1), dx)
        return loss, [d_bytes, *d_filters, *d_thresholds, hidden.T @ dz, dz.sum(axis=0)]

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each width the sum of the filters' products with two bytes in a row, by 256 * first + second, or with a last one."""
        out = []
        for width, filters in zip(WIDTHS, self.filters, strict=True):
            one = [self.bytes @ filters[k * DIMENSION : (k + 1) * DIMENSION] for k in range(width)]
            out.append(tuple((one[k][:, None] + one[k + 1][None]).reshape(65536, FILTERS) if k + 1 < width else one[k] for k in range(0, width, 2)))
        return out

    def log_probabilities(self, rows: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Of each window, by language."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for a in range(0, len(rows), PASS):
            some = rows[a : a + PASS]
            pairs = some[:, :-1].astype(np.int32) * 256 + some[:, 1:]
            pooled = []
            for width, parts, threshold in zip(WIDTHS, tables, self.thresholds, strict=True):
                length = WINDOW - width + 1
                total = None
                for k, table in zip(range(0, width, 2), parts, strict=True):
                    seen = np.take(table, pairs[:, k : k + length] if len(table) > 256 else some[:, k : k + length], axis=0)
                    total = seen if total is None else np.add(total, seen, out=total)
                pooled.append(total.max(axis=1) + threshold)
            z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.bias
            z -= z.max(axis=1, keepdims=True)
            out[a : a + PASS] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def text_probabilities(self, buf: np.ndarray, offsets: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        rows, owner, filled = windows_of(buf, offsets)
        each, n = self.log_probabilities(rows, tables) * filled[:, None], len(offsets) - 1
        total = np.stack([np.bincount(owner, each[:, k], n) for k in range(len(self.languages))], axis=1) / np.maximum(1, np.diff(offsets))[:, None]
        total -= total.max(axis=1, keepdims=True)
        return np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)


def train(texts: list[bytes], y: np.ndarray, languages: list[str], steps: int = STEPS, rate: float = 0.01, seed: int = 11) -> Network:
    """texts: not empty; y: number of each one's language. Batches take each language equally often."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, rng)
    rows, labels = [], []
    for text, label in zip(texts, y.tolist(), strict=True):
        for j in range(PER_TEXT):
            size = min(len(text), WINDOW if j % 2 == 0 else int(rng.integers(12, WINDOW)))
            at = int(rng.integers(0, len(text) - size + 1))
            row = np.zeros(WINDOW, np.uint8)
            row[:size] = np.frombuffer(text, np.uint8, size, at)
            rows.append(row)
            labels.append(label)
    rows, labels = np.array(rows), np.array(labels)
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    m, v = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for t in range(1, steps + 1):
        of = rng.integers(0, len(languages), BATCH)
        pick = np.array([by_language[k][rng.integers(len(by_language[k]))] for k in of])
        _, gradient = net.gradients(rows[pick], labels[pick])
        now = rate * (1 - (t - 1) / steps)
        for p, g, a, b in zip(net.parameters(), gradient, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    return net


def fitted(docs: DataFrame, max_rows: int = MAX_ROWS) -> Network | None:
    """The network of docs (doc_id, text, lang); None if no text has a language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, max_rows / len(counts) / n)))])
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - 8 * WINDOW)).cast("int")
    rows = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", F.substr("text", start + 1, F.lit(8 * WINDOW)).alias("text")).toPandas().sort_values(["doc_id", "lang"])
    languages = sorted(rows["lang"].unique())
    if not languages:
        return None
    return train([t.encode() for t in rows["text"]], np.searchsorted(languages, rows["lang"].to_numpy(str)), languages)


RESULT = "doc_id long, lettered boolean, lang_pred string, score double"


def predict(docs: DataFrame, max_rows: int = MAX_ROWS, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score. docs: doc_id, text, and lang to learn from if no network is given."""
    net = network or fitted(docs, max_rows)
    model = docs.sparkSession.sparkContext.broadcast((net, net.tables()) if net else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                if model.value is None:
                    names, score = pa.nulls(part.num_rows, pa.string()), np.zeros(part.num_rows)
                else:
                    p = model.value[0].text_probabilities(buf, offsets, model.value[1])
                    names, score = pa.array([model.value[0].languages[k] for k in p.argmax(axis=1).tolist()], pa.string()), p.max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lettered"), names, pa.array(score)], names=["doc_id", "lettered", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lettered.alias("lettered"), "text").mapInArrow(work, RESULT)
    known = F.col("lettered") & F.col("lang_pred").isNotNull()
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))
