"""Quality rules at the level of hosts.

Each document is tested by base rules on its words. Failures are counted by host; a host's rate is shrunk towards the corpus
by an empirical beta prior, so that hosts with few documents are judged mostly by the corpus and hosts with many by
themselves. A host is rejected if its rate is surely too high: if the shrunk rate less 1.645 standard deviations of its beta
posterior (so with a probability of about 0.95) passes ``times`` the corpus's rate, but at least ``least`` and at most
``most``. The verdict is joined back to the documents.

The prior is fitted by moments over all hosts: with weighted mean m and variance v of the hosts' rates, less the sampling
part, a + b = m (1 - m) / v - 1 (kept within 1 .. 10,000). Its three sums are all that reaches the driver. Counts are summed
within each task before they are shuffled, and the verdicts are joined by host as Spark sees fit: broadcast if they are few,
else with skewed hosts split.

Null text has no words and fails. A null host is a host of its own. Repeated rows count and come back as often as they occur.
A text of any length is counted in one task. An empty table gives an empty result. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm import windows

FEATURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WINDOW = 8


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[offsets])


def repeats(keys: np.ndarray, later_only: bool) -> np.ndarray:
    """Which keys occur more than once; with later_only, not the first of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if not later_only:
        out[order[:-1][same]] = True
    return out


def text_counts(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    with np.errstate(over="ignore"):
        inside = scan.NOT_SPACE[buf]
        starts, ends = scan.spans(inside, offsets)
        at = np.searchsorted(starts, offsets)
        chars = sums(inside & ((buf & 0xC0) != 0x80), offsets)
        line_starts, line_ends = scan.spans(buf != 10, offsets)
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[has_word], line_ends[has_word]
        doc = scan.owners(offsets, line_starts).astype(np.uint64)
        again = repeats(scan.mix(scan.span_hashes(buf, line_starts, line_ends) + doc * np.uint64(0x9E3779B97F4A7C15)), True)
        words = scan.window_hashes(scan.span_hashes(buf, starts, ends), WINDOW)
        first = np.arange(len(words))
        owner = scan.owners(at, first)
        first = first[first + WINDOW <= at[owner + 1]] if len(first) else first
        found = first[repeats(scan.mix(words[first] + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), False)]
        covered = scan.cover(len(starts), found, found + WINDOW)
        return [np.diff(at), chars, sums(SYMBOLS[buf], offsets), sums(again, np.searchsorted(line_starts, offsets)), sums(covered, at)]


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *map(pa.array, text_counts(buf, offsets))], schema=windows.arrow_schema(FEATURES))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, FEATURES)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def host_verdicts(tested: DataFrame, times: float, least: float, most: float) -> DataFrame:
    """host, docs, failed, shrunk_rate, sure_rate, rejected of rows with host and base_failed."""
    hosts = tested.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    n, hosts_n, failed, square = hosts.agg(F.sum("docs"), F.count("*"), F.sum("failed"), F.sum(F.col("docs") * rate * rate)).first()
    m = (failed or 0) / (n or 1)
    between = (square or 0) / (n or 1) - m * m - m * (1 - m) * (hosts_n or 1) / (n or 1)
    size = min(1e4, max(1.0, m * (1 - m) / between - 1)) if between > 0 else 1e4
    mean, weight = (F.col("failed") + F.lit(m * size)) / (F.col("docs") + F.lit(size)), F.col("docs") + F.lit(size)
    sure = mean - F.lit(1.645) * F.sqrt(mean * (1 - mean) / (weight + 1))
    judged = hosts.withColumn("shrunk_rate", F.round(mean, 9)).withColumn("sure_rate", F.round(sure, 9))
    return judged.withColumn("rejected", F.col("sure_rate") > round(min(most, max(least, times * m)), 9))


def quality_rules(docs: DataFrame, host: str = "source", times: float = 3.0, least: float = 0.1, most: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept (false if base_failed or the host is rejected), host, shrunk_rate, sure_rate."""
    from weftline.llm.scratch import Scratch

    tested = Scratch(docs.sparkSession, "rules").save(features(docs, host), "features").withColumn("base_failed", base_failed())
    verdicts = host_verdicts(tested, times, least, most).select(F.col("host").alias("host_"), "shrunk_rate", "sure_rate", "rejected")
    joined = tested.join(verdicts, F.col("host").eqNullSafe(F.col("host_")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"), "host", "shrunk_rate", "sure_rate")
