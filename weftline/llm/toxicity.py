"""Toxicity by multiple-instance learning.

Only whole documents are labelled. A sentence's score is a logistic function of the words in it, a document's is the noisy-or
of its sentences', 1 - prod(1 - s), and the word weights are fitted through the noisy-or to the documents' labels; so the
model also says which sentences offend.

Words of the vocabulary (at most ``max_vocabulary``, in ``least`` training documents and more) are chosen by their association
with the label over the training documents (a bounded sample, ``max_labelled``, whose texts are written once); weights are
fitted on the driver from sentences reduced to vocabulary words. These bounds are on what is learnt, not on what is scored.
Scoring is one pass over all texts, with no shuffle.

Sentences end at . ! ? and line breaks. Null text counts as empty: no sentence, score 0. Rows with a null id are scored and
count as held out. Without labelled rows of both kinds a score is below 1e-12 a sentence. Repeated rows are scored each; of several
rows of a labelled id the one with the least text is learnt from. A text of any length is scored in one task. An empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm.labels import MAX_LABELLED, held_out, training_rows
from weftline.llm.scratch import Scratch

END = np.isin(np.arange(256), list(b".!?\n"))
MAX_VOCABULARY = 2048
LEAST = 2


class Sentences:
    """Words of a run of texts: hash, document and sentence (numbered through all texts) of each; sentences with words only."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends = scan.spans(scan.ALNUM[buf], offsets)
        self.hashes = scan.span_hashes(scan.LOWER[buf], starts, ends)
        self.doc = scan.owners(offsets, starts)
        mark = np.cumsum(END[buf])[starts] if len(starts) else starts
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (mark[1:] != mark[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.sentence = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(starts)) - 1
        self.owner, self.starts, self.ends = self.doc[first], starts[first] if len(first) else first, ends[last] if len(first) else first


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        z = np.full(len(s.owner), self.bias)
        if len(self.words) and len(s.hashes):
            at = np.minimum(np.searchsorted(self.words, s.hashes), len(self.words) - 1)
            known = self.words[at] == s.hashes
            z += np.bincount(s.sentence[known], self.weights[at[known]], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(scores: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(scores, 1 - 1e-12)), n))


def fit(word: np.ndarray, sentence: np.ndarray, owner: np.ndarray, plain: np.ndarray, y: np.ndarray, n_words: int, start: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam. word, sentence: pairs; owner: document of each sentence; plain: sentences without any word of
    the vocabulary in each document."""
    w, b = start.astype(np.float64).copy(), -6.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(b + np.bincount(sentence, w[word], len(owner)), -30, 30)))
        s0 = 1 / (1 + np.exp(-b))
        log_q = np.bincount(owner, np.log1p(-np.minimum(s, 1 - 1e-12)), len(y)) + plain * np.log1p(-s0)
        p = np.maximum(-np.expm1(log_q), 1e-9)
        pull = np.where(y > 0, -np.exp(log_q) / p, 1.0) / len(y)  # dLoss/dz of a sentence is pull * s
        each = pull[owner] * s
        grad = np.append(np.bincount(word, each[sentence], n_words) + decay * w / max(1, len(w)), each.sum() + (pull * plain).sum() * s0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(texts: DataFrame, max_vocabulary: int = MAX_VOCABULARY, least: int = LEAST) -> Model:
    """texts: text, y; a bounded table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                s, y = Sentences(buf, offsets), np.asarray(part.column("y"))
                pairs = np.unique(np.stack([s.hashes, s.doc.astype(np.uint64)], 1), axis=0) if len(s.hashes) else np.zeros((0, 2), np.uint64)
                h, at = np.unique(pairs[:, 0], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.bincount(at, minlength=len(h)).astype(np.int64)), pa.array(np.bincount(at, y[pairs[:, 1].astype(np.int64)], len(h)).astype(np.int64))], names=["word", "n", "k"])

    n, k = texts.agg(F.count("*"), F.sum("y")).first()
    k = int(k or 0)
    if not n or k in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    counts = texts.select("text", "y").mapInArrow(count, "word long, n long, k long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).filter(F.col("n") >= least)
    odds = F.log((F.col("k") + 0.5) / (F.lit(k) - F.col("k") + 0.5)) - F.log((F.col("n") - F.col("k") + 0.5) / (F.lit(n - k) - F.col("n") + F.col("k") + 0.5))
    spread = F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("n") - F.col("k") + 0.5))
    best = counts.select("word", odds.alias("odds"), F.abs(odds / spread).alias("z")).orderBy(F.desc("z"), "word").limit(max_vocabulary).toPandas()
    if not len(best):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    vocabulary = best["word"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, start = vocabulary[order], np.clip(best["odds"].to_numpy(np.float64)[order], -3, 3)
    start[np.abs(best["z"].to_numpy(np.float64)[order]) < 4] = 0

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                s = Sentences(buf, offsets)
                at = np.minimum(np.searchsorted(vocabulary, s.hashes), len(vocabulary) - 1)
                known = vocabulary[at] == s.hashes if len(s.hashes) else np.zeros(0, bool)
                cut, n_sentences = np.searchsorted(s.doc[known], np.arange(part.num_rows + 1)), np.bincount(s.owner, minlength=part.num_rows)
                word, sentence = at[known].astype(np.int32), s.sentence[known].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(n_sentences.astype(np.int64)), pa.array([word[cut[i] : cut[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary()), pa.array([sentence[cut[i] : cut[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())], names=["y", "sentences", "words", "places"])

    rows = texts.select("text", "y").mapInArrow(reduce, "y int, sentences long, words binary, places binary").toPandas()
    word, sentence, owner, used, base = [], [], [], [], 0
    for i, (a, b) in enumerate(zip(rows["words"], rows["places"], strict=True)):
        own, place = np.unique(np.frombuffer(b, np.int32), return_inverse=True)
        word.append(np.frombuffer(a, np.int32))
        sentence.append(base + place)
        owner.append(np.full(len(own), i))
        used.append(len(own))
        base += len(own)
    y = rows["y"].to_numpy(np.float64)
    weights, bias = fit(np.concatenate(word), np.concatenate(sentence), np.concatenate(owner), rows["sentences"].to_numpy() - np.array(used), y, len(vocabulary), start)
    return Model(vocabulary, weights, bias)


RESULT = "doc_id long, score double, n_sentences long, offending array<struct<start:long,stop:long,score:double>>"


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int, label: str, max_vocabulary: int = MAX_VOCABULARY, least: int = LEAST) -> Model:
    """The model of docs (doc_id, text) and labels, its training texts written for the two passes over them."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = known.join(F.broadcast(training_rows(labels, label, max_labelled)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return train(Scratch(docs.sparkSession, "toxicity").save(rows.select("text", "y"), "training"), max_vocabulary, least)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED, label: str = "toxic", max_vocabulary: int = MAX_VOCABULARY, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending (UTF-8 byte spans of sentences that score threshold or more)."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, max_labelled, label, max_vocabulary, least))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                s = Sentences(buf, offsets)
                each = model.value.sentence_scores(s)
                n = part.num_rows
                bad: list[list[dict]] = [[] for _ in range(n)]
                for j in np.flatnonzero(each >= threshold).tolist():
                    base = int(offsets[s.owner[j]])
                    bad[s.owner[j]].append({"start": int(s.starts[j]) - base, "stop": int(s.ends[j]) - base, "score": float(each[j])})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(noisy_or(each, s.owner, n)), pa.array(np.bincount(s.owner, minlength=n).astype(np.int64)), pa.array(bad, kind)], names=["doc_id", "score", "n_sentences", "offending"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(work, RESULT).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED, label: str = "toxic", max_vocabulary: int = MAX_VOCABULARY, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, that score below threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, max_labelled, label, max_vocabulary, least))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                s = Sentences(buf, offsets)
                yield part.filter(pa.array(noisy_or(model.value.sentence_scores(s), s.owner, part.num_rows) < threshold))

    return docs.mapInArrow(work, docs.schema)
