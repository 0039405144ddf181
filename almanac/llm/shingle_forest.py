"""Near-duplicate documents by a forest of MinHash tries over sets of five-word shingles.

Each tree orders a document by a path of minimum hashes; documents with a common prefix in any tree are
candidates.  The matched prefix is shortened from the full path until pairs at the threshold meet in some
tree with the target probability; what matches longer matches there too.  A pair is verified exactly, once,
in the first tree where it meets.

Texts with equal shingle sets are one class and never paired.  Pairs of classes are never rows: a task
takes two bounded blocks of one bucket and gives out, per class, how many documents it links, and one edge to a root of its
linked classes.  So links are counted in full while the rows stay in proportion to classes and blocks.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm import common
from almanac.operators.sieve import marked, passing
from almanac.plans.staging import write_once

WORDS = 5              # of a shingle
SIMILARITY = (4, 5)    # at least four fifths of the union in common
TREES = 20
FULL_DEPTH = 8
RECALL = 0.9999        # of pairs at the threshold
NARROW_BLOCK = 2048    # classes of a bucket compared by their paths at once
BLOCK = 256            # classes of a bucket compared by their shingles at once
COLUMNS = 1 << 14      # shingles multiplied at once

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def matched_depth(similarity: float, trees: int = TREES, full: int = FULL_DEPTH, recall: float = RECALL) -> int:
    """Shorten the prefix until a pair of this similarity meets in some tree with the wanted probability."""
    depth = full
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingles:
    """Sets of shingle hashes, with the hashes of known words remembered."""

    def __init__(self, trees: int = TREES):
        self.known: dict[str, int] = {}
        self.depth = matched_depth(SIMILARITY[0] / SIMILARITY[1], trees)
        odd = np.random.default_rng(20).integers(0, 1 << 63, trees * self.depth, dtype=np.uint64)
        self.trees, self.odd = trees, (odd << np.uint64(1)) | np.uint64(1)

    def of(self, text: str) -> np.ndarray:
        """Sorted different hashes; a text of fewer than five words is one shingle, one without words none."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > common.CACHE_ENTRIES:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(WORDS, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ hashes[k:len(words) - size + 1 + k]) * _MIX[k]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """The hash of the prefix in each tree."""
        least = np.full(len(self.odd), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(shingles), 512):
            part = shingles[start:start + 512, None] * self.odd
            np.minimum(least, part.min(axis=0), out=least)
        paths = least.reshape(self.trees, self.depth)
        out = np.arange(1, self.trees + 1, dtype=np.uint64) * _MIX[0]
        for level in range(self.depth):
            out = (out ^ paths[:, level]) * _MIX[1]
            out ^= out >> np.uint64(31)
        return out.astype(np.int64)


def shape_of(shingles: np.ndarray) -> bytes | None:
    """A hash of the whole set; none for a text without words."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, shape, paths``: a row per row, with a hash of its text; the paths are the keys of all trees as bytes."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingles()
        for batch in batches:
            shapes, paths = [], []
            for text in common.texts(batch):
                shingles = shingler.of(text)
                shapes.append(shape_of(shingles))
                paths.append(shingler.keys(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), pa.array(shapes, pa.binary()), pa.array(paths, pa.binary())],
                names=["doc_id", "copy", "shape", "paths"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("copy"), docs["text"])
    return rows.mapInArrow(sign, "doc_id long, copy long, shape binary, paths binary")


def groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal ``by`` (integers), each group whole, out of sorted batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by])
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        if kept and tuple(values[0]) != last:
            yield _joined(kept)
            kept = []
        for a, b in zip(starts[:-2], starts[1:-1]):
            yield _joined([*kept, batch.slice(a, b - a)])
            kept = []
        kept.append(batch.slice(starts[-2]))
        last = tuple(values[-1])
    if kept:
        yield _joined(kept)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def paths_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def first_meetings(left: np.ndarray, right: np.ndarray, tree: int) -> np.ndarray:
    """For rows of ``left`` by rows of ``right``: whether they meet in ``tree`` and in none before."""
    out = left[:, tree, None] == right[None, :, tree]
    for t in range(tree):
        out &= left[:, t, None] != right[None, :, t]
    return out


WORK = pa.schema([("work", pa.int64()), ("tree", pa.int32()), ("side", pa.int32()), ("shape", pa.binary()), ("paths", pa.binary()), ("size", pa.int64())])
WORK_DDL = "work long, tree int, side int, shape binary, paths binary, size long"


def work_of(group: pa.RecordBatch) -> list[tuple]:
    """Blocks of a bucket's classes that hold pairs which meet here first; classes without such a pair go no further."""
    tree, key = group.column("tree")[0].as_py(), group.column("key")[0].as_py()
    first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
    paths = paths_of(group.column("paths"))
    shapes, raw, sizes = (group.column(c).to_pylist() for c in ("shape", "paths", "size"))
    side = group.column("side").to_numpy(zero_copy_only=False)
    if first == second:
        sides = [np.arange(len(paths))] * 2
    else:
        sides = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    out = []
    for x in range(0, len(sides[0]), BLOCK):
        for y in range(x if first == second else 0, len(sides[1]), BLOCK):
            a, b = sides[0][x:x + BLOCK], sides[1][y:y + BLOCK]
            new = first_meetings(paths[a], paths[b], tree)
            within = first == second and x == y
            if within:
                new &= ~np.eye(len(a), dtype=bool)
            number = xxhash.xxh3_64_intdigest(f"{key} {first} {second} {x} {y}") >> 1
            for which, rows in ((0, a[new.any(axis=1)]), (1, () if within else b[new.any(axis=0)])):
                out += [(number, tree, 2 if within else which, shapes[i], raw[i], sizes[i]) for i in rows]
    return out


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``, by products of incidence matrices."""
    lengths = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    several = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[several]]
    owner = owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        matrix = np.zeros((len(sets), int(column[high - 1]) - start + 1), np.float32)
        matrix[owner[low:high], column[low:high] - start] = 1
        total += matrix[left] @ matrix[right].T
    return total.astype(np.int64)


def verified(group: pa.RecordBatch) -> list[tuple]:
    """Per class of a piece of work: documents linked to it here, and the root of its linked classes."""
    tree = group.column("tree")[0].as_py()
    chosen: dict[bytes, int] = {}
    for i, shape in enumerate(group.column("shape").to_pylist()):
        chosen.setdefault(shape, i)  # a class may have come with several of its documents
    rows = list(chosen.values())
    shapes = list(chosen)
    paths = paths_of(group.column("paths"))[rows]
    size = group.column("size").to_numpy(zero_copy_only=False)[rows]
    side = group.column("side").to_numpy(zero_copy_only=False)[rows]
    raw = group.column("shingles")
    sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in rows]
    within = bool((side == 2).any())
    left = np.arange(len(rows)) if within else np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    both = common_counts(sets, left, right)
    n = np.array([len(s) for s in sets])
    linked = SIMILARITY[1] * both >= SIMILARITY[0] * (n[left][:, None] + n[right][None, :] - both)
    linked &= first_meetings(paths[left], paths[right], tree)
    if within:
        linked &= ~np.eye(len(left), dtype=bool)
    links = np.zeros(len(rows), np.int64)
    links[left] += (linked * size[right][None, :]).sum(axis=1)
    if not within:
        links[right] += (linked * size[left][:, None]).sum(axis=0)
    root = np.arange(len(rows))
    a, b = (left[linked.nonzero()[0]], right[linked.nonzero()[1]])
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return [(shapes[i], int(links[i]), shapes[root[i]]) for i in range(len(rows)) if links[i]]


def components(edges: DataFrame) -> DataFrame:
    """``shape, root`` for the ends of ``edges`` (``a``, ``b``): the least shape of the connected component.

    Every class takes the least label among its neighbours' and then its label's label, each round a
    stored table, until nothing changes.
    """
    both = write_once(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = write_once(both.groupBy(F.col("a").alias("shape")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["shape"]).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["shape"] == near["a"]).select("shape", "root", F.least("root", "near").alias("new"))
        stepped = write_once(stepped)
        of = stepped.select(F.col("shape").alias("via"), F.col("new").alias("further"))
        jumped = stepped.join(of, F.col("new") == F.col("via")).select("shape", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("changed"))
        jumped = write_once(jumped)
        labels = jumped.select("shape", "root")
        if jumped.where("changed").isEmpty():
            return labels


def linked(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row.

    Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked, and the class
    is the connected component, named by its least id; ``n_links`` counts the other rows linked to this one.  Words are
    what stands between white space.  A null or empty text has no words and links to nothing; its class is its own id.  Null
    ids take part and are never the name of a class with other ids.  Repeated rows are linked copies.  Other columns are not read.
    """
    return classed(docs).select("doc_id", "class_id", "n_links")


def classed(docs: DataFrame) -> DataFrame:
    """``linked`` with ``copy``, a hash of the text, and ``root``, which no two classes share; a row without words has none."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = write_once(signatures(docs))
    classes = write_once(rows.where("shape IS NOT NULL").groupBy("shape").agg(
        F.min("doc_id").alias("name"), F.min(key).alias("row"), F.count("*").alias("size"), F.min("paths").alias("paths")))
    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = paths_of(batch.column("paths")) if batch.num_rows else np.zeros((0, TREES), np.int64)
            repeat = np.repeat(np.arange(batch.num_rows), TREES)
            yield pa.RecordBatch.from_arrays([
                pa.array(paths.ravel()), pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)),
                batch.column("shape").take(pa.array(repeat))], names=["key", "tree", "shape"])

    entries = classes.select("shape", "paths").mapInArrow(entries_of, "key long, tree int, shape binary")
    entries = write_once(entries)
    several = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    found = entries.join(several, "key").join(classes.select("shape", "paths", "size"), "shape")
    blocks = F.ceil(F.col("members") / NARROW_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("shape"), F.col("blocks")).cast("int")
    found = found.withColumn("blocks", blocks).withColumn("own", own)
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = found.select(
        "key", "tree", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "shape", "paths", "size")
    by = ["key", "first", "second"]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches, by):
            if group.num_rows > 1:
                out += work_of(group)
            if len(out) >= 4096:
                yield from common.batches(out, WORK)
                out = []
        yield from common.batches(out, WORK)

    work = write_once(found.repartition(*by).sortWithinPartitions(*by).mapInArrow(narrow, WORK_DDL))

    wanted = write_once(work.select("shape").distinct().join(classes.select("shape", "row"), "shape"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingles()
        for batch in batches:
            sets = [shingler.of(t) for t in common.texts(batch)]
            shapes = [shape_of(s) for s in sets]
            same = [a == b for a, b in zip(shapes, batch.column("shape").to_pylist())]  # ids may repeat with other texts
            kept = [(shape, s.tobytes()) for shape, s, ok in zip(shapes, sets, same) if ok]
            yield from common.batches(kept, pa.schema([("shape", pa.binary()), ("shingles", pa.binary())]))

    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("row"), docs["text"])
    texts = passing(texts, wanted.select("row"), ["row"])
    payload = texts.join(wanted, "row").select("shape", "text").mapInArrow(shingled, "shape binary, shingles binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shape", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
        for group in groups(batches, ["work"]):
            yield from common.batches(verified(group), schema)

    pieces = work.join(payload, "shape").repartition("work").sortWithinPartitions("work")
    links = write_once(pieces.mapInArrow(check, "shape binary, links long, root binary"))
    counted = links.groupBy("shape").agg(F.sum("links").alias("links"))
    roots = components(links.where("shape <> root").select(F.col("shape").alias("a"), F.col("root").alias("b")))
    named = classes.select("shape", "name", "size").join(counted, "shape", "left").join(roots, "shape", "left")
    named = write_once(named.select("shape", "name", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "shape").alias("root")))
    names = named.groupBy("root").agg(F.min("name").alias("class_id"))
    named = named.join(names, "root").select("shape", "root", "class_id", (F.col("size") - 1 + F.col("links")).alias("n_links"))
    return rows.select("doc_id", "copy", "shape").join(named, "shape", "left").select(
        "doc_id", "copy", "root", F.when(F.col("shape").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of a pipeline: of each class the document with the least id stays, with all its columns.

    Rows that repeat an id and its text are one; an id with different texts is a document for each of them, and of a class
    that has several texts of its least id one stays.  Documents without an id stay, as nothing names them, and so do those with
    null or empty texts, which are like no other.  An empty table stays empty; working columns have names that ``docs`` does not.
    """
    found = write_once(classed(docs))
    dropped = found.where("class_id <> doc_id")
    repeated = not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        naming = found.where("class_id = doc_id AND root IS NOT NULL").select("doc_id", "copy", "root").distinct()
        chosen = naming.groupBy("root").agg(F.min("copy").alias("chosen"))
        dropped = dropped.select("doc_id", "copy").unionByName(naming.join(chosen, "root").where("copy <> chosen").select("doc_id", "copy"))
    gone, copy, suspect = common.unused(docs, "dropped", "copy", "suspect")
    dropped = write_once(dropped.select("doc_id", F.col("copy").alias(copy)).distinct())
    told = marked(docs, dropped.select("doc_id"), ["doc_id"], suspect)
    dropped = dropped.withColumnRenamed("doc_id", gone)
    same = (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(copy))
    exact = told.where(suspect).join(dropped, same, "left_anti")
    kept = told.where(~F.col(suspect)).unionByName(exact).drop(suspect)
    if not repeated:
        return kept
    named = kept.where("doc_id IS NOT NULL").withColumn(copy, F.xxhash64("text")).dropDuplicates(["doc_id", copy]).drop(copy)
    return named.unionByName(kept.where("doc_id IS NULL"))
