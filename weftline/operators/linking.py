"""How well titles and headings answer labels and queries, and the best title of each label.

Similarity of strings is that of matching blocks (``difflib``), the only step in Python; expressions and bounds decide first
where it can matter at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions import text as T
from weftline.operators.fusion import ranked

#: Tokens too common in labels and titles to tell anything.
STOP = "a au aux de des du et la le les un une dans pour sur fiche article juillet code general fonction publique".split()
#: Labels and titles of a block.
LABELS, TITLES = 256, 2048
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by matching blocks; null where one is null. Time grows with the product of their lengths."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _telling(folded: Column, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(F.split(folded, " "), lambda w: (F.length(w) > 1) & ~w.isin(stop)))


def heading_scores(pairs: DataFrame, stop: list[str] = STOP) -> DataFrame:
    """pairs (heading, path, query and others) with ``score``, all three folded.

    1 if heading or path contains the query or is contained in it, or if three quarters of the query's tokens occur and these are
    .45 of the heading's and path's; 0 without a common token. Else .7 and .3 of these shares, or the similarity of the strings
    if that is .72 and more, .99 at most. Only pairs whose lengths allow such a similarity above the shares are compared.
    """
    query, names = T.fold(F.col("query")), F.filter(F.array(T.fold(F.coalesce("heading", F.lit(""))), T.fold(F.coalesce("path", F.lit("")))), lambda x: x != "")
    rows = pairs.withColumn("__q", F.coalesce(query, F.lit(""))).withColumn("__names", names)
    asked, said = _telling(F.col("__q"), stop), _telling(F.array_join("__names", " "), stop)
    rows = rows.withColumn("__both", F.size(F.array_intersect(asked, said))).withColumn("__of_q", F.col("__both") / F.nullif(F.size(asked), F.lit(0))).withColumn("__of_h", F.col("__both") / F.nullif(F.size(said), F.lit(0)))
    inside = F.exists("__names", lambda x: F.contains(x, F.col("__q")) | F.contains(F.col("__q"), x))
    known = F.when((F.col("__q") == "") | (F.size("__names") == 0), 0.0).when(inside, 1.0).when(F.col("__both") == 0, 0.0).when((F.col("__of_q") >= 0.75) & (F.col("__of_h") >= 0.45), 1.0)
    rows = rows.withColumn("__known", known).withColumn("__share", 0.7 * F.col("__of_q") + 0.3 * F.col("__of_h"))

    def alike(i: int) -> Column:
        name = F.get("__names", F.lit(i))
        most = 2 * F.least(F.length(name), F.length("__q")) / (F.length(name) + F.length("__q"))
        return ratio(F.when(F.col("__known").isNull() & (most >= F.greatest(F.lit(0.72), "__share")), F.col("__q")), name)

    best = F.greatest(F.coalesce(alike(0), F.lit(0.0)), F.coalesce(alike(1), F.lit(0.0)))
    score = F.coalesce("__known", F.least(F.lit(0.99), F.greatest("__share", F.when(best >= 0.72, best).otherwise(0.0))))
    return rows.withColumn("score", F.round(score, 6)).drop("__q", "__names", "__both", "__of_q", "__of_h", "__known", "__share")


def _blocks(rows: DataFrame, prefix: str, size: int, columns: list[str]) -> DataFrame:
    """Rows of (id, strings...) in rows of lists, ``size`` of them in each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_pylist()], pa.list_(c.type)) for c in part.columns], names=[prefix + c for c in columns])

    return rows.mapInArrow(work, ", ".join(f"{prefix}{c} array<{'long' if c == 'id' else 'string'}>" for c in columns))


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter of ALPHABET occurs in each text."""
    return np.array([[t.count(c) for c in ALPHABET] for t in texts], np.int32).reshape(len(texts), len(ALPHABET))


class _Titles:
    """A block of titles, prepared for many labels."""

    def __init__(self, ids: list[int], titles: list[str], publishers: list[str], stop: frozenset[str]):
        self.ids, self.titles, self.publishers = np.array(ids, np.int64), titles, np.array(publishers, object)
        self.array = pa.array(titles, pa.string())
        self.tokens = [{w for w in t.split(" ") if len(w) > 1 and w not in stop} for t in titles]
        self.sizes = np.array([len(x) for x in self.tokens])
        self.length, self.letters = np.array([len(t) for t in titles]), _letters(titles)
        self.holds: dict[str, np.ndarray] = {}
        self.at: dict[str, list[int]] = {}
        for i, words in enumerate(self.tokens):
            for w in words:
                self.at.setdefault(w, []).append(i)

    def containing(self, part: str) -> np.ndarray:
        if part not in self.holds:
            self.holds[part] = np.asarray(pc.match_substring(self.array, part))
        return self.holds[part]

    def best(self, label: str, publisher: str, tag: str, stop: frozenset[str], first: int, boosts: tuple[float, float]) -> list[tuple[int, float]]:
        """The two best ids with their scores. Titles are compared in the order of what they could score at most, until none can
        come before the second."""
        words = sorted({w for w in label.split(" ") if len(w) > 1 and w not in stop})
        whole = self.containing(label)
        wanted = whole.copy()
        for w in words[:first]:
            wanted |= self.containing(w)
        wanted = np.flatnonzero(wanted)
        if len(wanted) == 0:
            return []
        both = np.zeros(len(self.ids))
        for w in words:
            both[self.at.get(w, [])] += 1
        both = both[wanted]
        shares = 0.7 * both / max(1, len(words)) + 0.3 * both / np.maximum(1, self.sizes[wanted])
        common = np.minimum(self.letters[wanted], _letters([label])[0]).sum(axis=1)
        most = np.maximum(shares, 0.85 * 2 * common / (self.length[wanted] + len(label)))
        titles = [self.titles[i] for i in wanted.tolist()]
        known = np.array([1.0 if t == label else 0.92 if t and (label in t or t in label) else -1.0 if t else 0.0 for t in titles])
        most = np.where(known >= 0, known, most)
        extra = boosts[0] * ((self.publishers[wanted] == publisher) & (publisher != ""))
        plus = boosts[1] * np.array([tag != "" and (tag in t or self.publishers[i] == tag) for i, t in zip(wanted.tolist(), titles, strict=True)])
        top = lambda s, j: round(min(min(s + extra[j], 1.0) + plus[j], 1.0), 4)
        bound = np.round(np.minimum(most + extra + plus, 1.0) + 1e-9, 4)
        found: dict[int, float] = {}
        second = -1.0
        for j in np.argsort(-bound, kind="stable").tolist():
            if bound[j] < second:
                break
            score = known[j] if known[j] >= 0 else max(shares[j], 0.85 * SequenceMatcher(None, label, titles[j]).ratio())
            key, value = int(self.ids[wanted[j]]), float(top(score, j))
            if value > found.get(key, -1.0):
                found[key] = value
                second = sorted(found.values())[-2] if len(found) > 1 else -1.0
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:2]


def entity_link(labels: DataFrame, candidates: DataFrame, floor: float = 0.05, least: float = 0.2, first: int = 6, boosts: tuple[float, float] = (0.08, 0.06), stop: list[str] = STOP) -> DataFrame:
    """query_id, cand_id, score, ambiguous: the best title of each label, if it scores ``least``.

    labels: query_id, label, publisher (preferred) and tag, both may be null or missing; candidates: cand_id (several rows an id: the best
    counts), title, publisher. All are folded. A title is looked at if it contains the label or one of the first ``first`` of its
    sorted telling tokens. The score is 1 if both are equal, .92 if one contains the other, else the greater of .7 label and .3
    title token coverage and .85 similarity of the strings; ``boosts`` are added for the publisher and for a tag that is the
    publisher or in the title, up to 1. ambiguous: the second best is within ``floor``.

    Blocks of labels meet blocks of titles; a block pair yields two rows a label, however common its tokens are, and compares
    strings only as long as counts of letters leave a title a chance.
    """
    words = frozenset(stop)
    text = lambda c: T.fold(F.coalesce(c, F.lit("")))
    labels = labels.withColumns({c: F.lit(None).cast("string") for c in ("publisher", "tag") if c not in labels.columns})
    candidates = candidates if "publisher" in candidates.columns else candidates.withColumn("publisher", F.lit(None).cast("string"))
    asked = labels.select(F.col("query_id").cast("long").alias("id"), text("label").alias("label"), text("publisher").alias("publisher"), text("tag").alias("tag")).filter("label <> ''")
    listed = candidates.select(F.col("cand_id").cast("long").alias("id"), text("title").alias("title"), text("publisher").alias("publisher"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if last is None or row["c_id"] != last[0]:
                    last = (row["c_id"], _Titles(row["c_id"], row["c_title"], row["c_publisher"], words))
                found = [(q, c, s) for q, *label in zip(row["q_id"], row["q_label"], row["q_publisher"], row["q_tag"], strict=True) for c, s in last[1].best(*label, words, first, boosts)]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "cand_id", "score"])

    pairs = _blocks(listed, "c_", TITLES, ["id", "title", "publisher"]).crossJoin(_blocks(asked, "q_", LABELS, ["id", "label", "publisher", "tag"]))
    scored = pairs.mapInArrow(work, "query_id long, cand_id long, score double").groupBy("query_id", "cand_id").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    best = ranked(scored, ["query_id"], [F.desc("score"), F.col("cand_id")], 2)
    return best.groupBy("query_id").agg(F.min_by("cand_id", "rank").alias("cand_id"), F.max("score").alias("score"), ((F.count("*") > 1) & (F.min("score") >= F.round(F.max("score") - floor, 4))).alias("ambiguous"))
