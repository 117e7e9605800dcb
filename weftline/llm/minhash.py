"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

1. Tasks cut texts into sets of word shingles and take ``bands * rows`` minima of them under universal hashes. Rows with one
   set (its size and two 64-bit hashes of it) form a class, which gets a number; only classes go on.
2. Classes that agree in all minima of a band meet in a bucket. Each is paired with its bucket's hub, the class whose buckets
   are the fullest (of many near copies that is the text they were made from, or the nearest to it); pairs whose signatures
   agree well enough are confirmed on the full sets. Components of the confirmed links follow.
3. Buckets that still hold more than one component may hide links that don't touch the hub. In each the classes outside its
   largest component are compared with all others, in tasks of at most ``part`` shingles a side: an index from shingles to
   sets counts the intersections of one set with all others exactly. Only links that join components leave the task.
   Components follow again.

Pairs never become rows. Rows of the third step are the classes of mixed buckets, once, as long as what lies outside the
largest component fits one part; each further part of it meets all parts, so that the comparisons (not the rows) of a bucket
of n classes of which k are outside the largest component are k * n. No method that finds every link does without them.

At similarity 0.8, 32 bands of 4 rows miss a pair with probability 5e-8, and the signature test (5 standard deviations)
3e-7. Links hold exactly: 100 * intersection >= 100 * threshold * union on the full sets (64-bit shingle hashes).

Null or wordless text has an empty set, links with nothing and is kept. Rows with a null id are kept, with a null component.
Rows of one id are one node: their sets are linked. A text of any length is one set in one task. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scan
from weftline.llm import windows
from weftline.llm.components import components
from weftline.llm.scratch import Scratch

U = np.uint64
BANDS, ROWS = 32, 4


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each text end to end, and offsets per text."""
    low = scan.LOWER[buf]
    starts, ends = scan.spans(scan.NOT_SPACE[buf], offsets)
    words, at = scan.span_hashes(low, starts, ends), np.searchsorted(starts, offsets)
    n = np.diff(at)
    first = windows.ranges(at[:-1], np.maximum(n - size + 1, 0))
    h, doc = scan.window_hashes(words, size)[first], scan.owners(at, first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        with np.errstate(over="ignore"):
            own = np.array([scan.window_hashes(words[at[i] : at[i + 1]], int(n[i]))[0] + U(n[i]) for i in short], U)
        h, doc = np.concatenate([h, own]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n minima per set as a matrix of uint64; all sets must have members."""
    out = np.empty((len(at) - 1, n), U)
    a, b = scan.keys(n, 21) | U(1), scan.keys(n, 22)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[:, i] = np.minimum.reduceat(h * a[i] + b[i], at[:-1])
    return out


def marks(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, 0 of an empty one."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((2, len(at) - 1), U)
    if len(full):
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0, 0x5851F42D4C957F2D)):
                out[k, full] = np.add.reduceat(scan.mix(h ^ U(salt)), at[:-1][full])
    return out[0].astype(np.int64), out[1].astype(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary())])


def sign(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), a, b (two hashes of the set), keys (one a band), signature (16 bits of each minimum)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                h, at = shingles(buf, offsets, size)
                n, full = np.diff(at), np.flatnonzero(np.diff(at))
                a, b = marks(h, at)
                keys: list = [None] * len(n)
                minima: list = [None] * len(n)
                if len(full):
                    cut = np.append(at[:-1][full], at[-1])
                    with np.errstate(over="ignore"):
                        s = signatures(h, cut, BANDS * ROWS)
                        band = np.zeros((len(full), BANDS), U)
                        for r in range(ROWS):
                            band = scan.mix(band + s[:, r::ROWS])
                        band = scan.mix(band + np.arange(BANDS, dtype=U))
                    small = (s >> U(48)).astype(np.uint16)
                    for j, i in enumerate(full.tolist()):
                        keys[i], minima[i] = band[j].astype(np.int64), small[j].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())], schema=SIGNED)

    return docs.mapInArrow(work, "doc_id long, n long, a long, b long, keys array<long>, signature binary")


def sets_of(wanted: DataFrame, size: int) -> DataFrame:
    """cid, shingles (sorted uint64 hashes as bytes). wanted: text, cid and n, a, b of the class; other texts of its id are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in scan.pieces(batch, "text"):
                h, at = shingles(buf, offsets, size)
                mine = np.stack([np.diff(at), *marks(h, at)]) == np.stack([np.asarray(part.column(c)) for c in ("n", "a", "b")])
                rows = np.flatnonzero(mine.all(axis=0)).tolist()
                yield pa.RecordBatch.from_arrays([part.column("cid").take(pa.array(rows, pa.int64())), pa.array([h[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], names=["cid", "shingles"])

    return wanted.select("text", "cid", "n", "a", "b").mapInArrow(work, "cid long, shingles binary")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _alike(percent: int) -> float:
    j = percent / 100
    return j - 5 * (j * (1 - j) / (BANDS * ROWS)) ** 0.5


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows u, v, x, y (sets): those that are linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return work


def _agree(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows u, v, x, y (signatures): those that agree well enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield batch.select(["u", "v"]).filter(pa.array((x == y).mean(axis=1) >= _alike(percent)))

    return work


class Index:
    """From shingles to the sets that hold them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, U)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))

    def shared(self, x: np.ndarray) -> np.ndarray:
        """How many members of x each set has."""
        at = np.searchsorted(self.values, x)
        at = at[self.values[np.minimum(at, len(self.values) - 1)] == x] if len(self.values) else at[:0]
        return np.bincount(self.owners[windows.ranges(self.first[at], self.first[at + 1] - self.first[at])], minlength=len(self.sizes))


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    """A spanning set of the links between components: of side 0 with side 1, or among side 0 if there is no other."""

    def work(table: pa.Table) -> pa.Table:
        node, side = np.asarray(table.column("cid")), np.asarray(table.column("side"))
        sets = [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]
        names, label = np.unique(np.asarray(table.column("component")), return_inverse=True)
        root = np.arange(len(names))  # union-find over components; flat whenever it is looked at
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        index, out = Index([sets[j] for j in right.tolist()]), []
        for i in left.tolist():
            other = root[label[right]] != root[label[i]]
            if other.any():
                both = index.shared(sets[i])
                good = np.flatnonzero(other & (100 * both >= percent * (len(sets[i]) + index.sizes - both)))
                new = good[np.unique(root[label[right[good]]], return_index=True)[1]]
                out += [(int(node[i]), int(node[j])) for j in right[new].tolist()]
                if len(new):
                    root[root[label[right[new]]]] = root[label[i]]
                    while not np.array_equal(root, root[root]):
                        root = root[root]
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return work


def _hubs(bands: DataFrame, scratch: Scratch) -> DataFrame:
    """key, cid, size, hub of the classes in buckets of two and more; bands: key, cid, size."""
    counts = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = scratch.save(bands.join(counts, "key"), "members")
    fullness = members.groupBy("cid").agg(F.sum("n").alias("fullness"))
    hubs = members.select("key", "cid").join(fullness, "cid").groupBy("key").agg(F.max_by("cid", F.struct("fullness", "cid")).alias("hub"))
    return scratch.save(members.select("key", "cid", "size").join(hubs, "key"), "hubs")


def _mixed(members: DataFrame, found: DataFrame, part: int) -> DataFrame:
    """key, i, j, cid, side, component: what is compared in which task, of buckets of more than one component."""
    labelled = members.select("key", "cid", "size").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "size", F.coalesce("component", "cid").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    largest = F.struct("c", "component")
    buckets = parts.groupBy("key").agg(F.count("*").alias("m"), F.max_by("component", largest).alias("main"), F.max_by("s", largest).alias("inside"), F.sum("s").alias("total")).filter("m > 1")
    pieces = lambda x: F.ceil(x / part).cast("int")
    buckets = buckets.select("key", "main", pieces(F.col("total") - F.col("inside")).alias("a"), pieces(F.col("inside")).alias("b"))
    work = labelled.join(buckets, "key").withColumn("h", F.xxhash64("cid"))
    # Parts 0 .. a - 1 are outside the largest component, a .. a + b - 1 inside. Part i < a meets each part from i on.
    inside = F.col("component") == F.col("main")
    own = F.when(inside, F.col("a") + F.pmod("h", "b")).otherwise(F.pmod("h", "a")).cast("int")
    after = F.transform(F.sequence(F.col("own"), F.col("a") + F.col("b") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    before = F.transform(F.sequence(F.lit(0), F.least("own", F.col("a")) - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<i:int,j:int,side:int>>")
    meetings = F.concat(F.when(inside, none).otherwise(after), F.when(F.col("own") > 0, before).otherwise(none))
    spread = work.withColumn("own", own).select("key", "cid", "component", F.explode(meetings).alias("m")).select("key", "cid", "component", "m.i", "m.j", "m.side")
    # Of the buckets in which the same classes meet, comparing them in one is enough.
    group = spread.groupBy("key", "i", "j").agg(F.sum(F.xxhash64("cid", "side").cast("decimal(20,0)")).alias("members"), F.count("*").alias("n"))
    once = group.groupBy("members", "n").agg(F.min(F.struct("key", "i", "j")).alias("g")).select("g.key", "g.i", "g.j")
    return spread.join(once, ["key", "i", "j"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, part: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the document is its component's least).

    docs: doc_id, text. size: words of a shingle; percent: similarity from which documents are linked.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.save(sign(docs, size), "signed")
    full = signed.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("signature").alias("signature"))
    # A number of its own for each class, so that no two can be taken for one; it holds once the table is written.
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.col("n")), "classes")
    members = _hubs(classes.select(F.explode("keys").alias("key"), "cid", "size"), scratch)
    pairs = members.filter("cid <> hub").select(F.col("cid").alias("u"), F.col("hub").alias("v")).distinct()
    signs = classes.select("cid", "signature")
    near = pairs.join(signs.select(F.col("cid").alias("u"), F.col("signature").alias("x")), "u").join(signs.select(F.col("cid").alias("v"), F.col("signature").alias("y")), "v")
    alike = scratch.save(near.select("u", "v", "x", "y").mapInArrow(_agree(percent), "u long, v long"), "alike")
    # Ids of several rows: their sets, if they differ, are linked; if not, one of them is enough.
    sums = F.struct("n", "a", "b")
    ids = full.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(sums).alias("lo"), F.max(sums).alias("hi")).filter("rows > 1")
    repeated = scratch.save(ids, "repeated")
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("doc_id", "cid", "n", "a", "b")
    sets = sets_of(docs.join(wanted, "doc_id"), size)
    some = not repeated.isEmpty()
    sets = scratch.save(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")) if some else sets, "sets")
    both = alike.join(sets.select(F.col("cid").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("cid").alias("v"), F.col("shingles").alias("y")), "v")
    links = both.select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u long, v long")
    if some:
        several = full.join(repeated.filter("lo <> hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "a", "b").distinct()
        several = several.join(classes.select("n", "a", "b", "cid"), ["n", "a", "b"])
        links = links.unionByName(several.join(several.groupBy("doc_id").agg(F.min("cid").alias("v")), "doc_id").select(F.col("cid").alias("u"), "v").filter("u <> v"))
    found = components(scratch.save(links, "links"), scratch, "cc")
    dense = scratch.save(_mixed(members, found, part), "mixed").join(sets, "cid")
    late = scratch.save(dense.select("key", "i", "j", "cid", "side", "component", "shingles").groupBy("key", "i", "j").applyInArrow(_compare(percent), "u long, v long"), "late")
    if not late.isEmpty():
        star = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(star.union(late), scratch, "cc-late")
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())  # roots as well
    linked = found.join(classes.select(F.col("cid").alias("node"), "doc_id"), "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    which = classes.select("cid", "n", "a", "b", "doc_id").join(found.join(least, "component").select(F.col("node").alias("cid"), "least"), "cid", "left").select("n", "a", "b", F.coalesce("least", "doc_id").alias("component_id"))
    out = full.select("doc_id", "n", "a", "b").join(which, ["n", "a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
