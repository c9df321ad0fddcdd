"""Near duplicates by word n-gram sets: a chosen-path similarity join.

A document is the set of its five-word shingles; documents with equal sets are one *class* and go on as
one row. A class keeps ``COORDINATES`` samples of its set, the smallest shingle under as many hashes, and
two sets agree in one sample with a chance equal to their Jaccard similarity. Each run splits the classes
recursively: a bucket chooses ``1 / threshold`` samples on average, at random but alike for all its
members, and each chosen sample splits it by the shingle found there. A pair at the threshold is expected
to go on together in one bucket per level, dissimilar pairs part at once. Small buckets are compared by
brute force; large ones are split again. Independent runs repeat until the recall is reached that is
asked for.

What is found alike joins groups of classes; every group is then compared exactly, on whole sets, in
blocks, without writing its pairs: a class gets the number of its links, and a group the links that
keep it together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, utf8
from webcorpus.llm.components import components
from webcorpus.llm.hashing import Spans, mix
from webcorpus.llm.scratch import settled
from webcorpus.llm.words import ALPHANUMERIC, word_hashes, word_spans

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES = 64
START, DEEPEST = 2, 6  # levels of the first buckets and of the last
SMALL = 4096  # classes of a bucket that is compared and not split further
COMPARED = 4096  # classes of a block, when the last bucket of a path is still large
MARGIN = 0.25  # below the threshold, for the samples' error
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20  # of one side of an exact comparison
SLICE_BYTES = 1 << 20


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with the chance ``recall``.

    The number of common buckets of such a pair is a branching process with one child on average.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingles(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in a row, and where each text's start; a short text is one shingle."""
    starts, ends, firsts = word_spans(data, offsets, ALPHANUMERIC)
    words = word_hashes(data, starts, ends, lower=True)
    n = len(words)
    sizes = np.diff(firsts)
    last = np.repeat(firsts[1:], sizes)
    at = np.arange(n)
    short = np.repeat(sizes < length, sizes)
    heads = np.repeat(firsts[:-1], sizes) == at
    take = np.flatnonzero(np.where(short, heads, at + length <= last))
    stop = np.where(short[take], last[take], take + length)
    hashes = Spans(words, seed=2)(take, stop)
    owner = np.searchsorted(firsts, take, side="right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def _describe(length: int):
    """Rows to what is known of their sets: size, 128-bit class, samples."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            sets, firsts = shingles(*utf8(batch), length)
            sizes = np.diff(firsts)
            full = np.flatnonzero(sizes)
            one, two = Spans(mix(sets, seed=11), seed=8), Spans(mix(sets, seed=12), seed=9)
            name = np.stack([one(firsts[full], firsts[full + 1]), two(firsts[full], firsts[full + 1])], axis=1)
            samples = np.empty((len(full), COORDINATES), "<u4")
            for k in range(COORDINATES if len(full) else 0):
                samples[:, k] = np.minimum.reduceat(mix(sets, seed=100 + k) >> np.uint64(32), firsts[full]).astype(np.uint32)
            names, kept = [None] * batch.num_rows, [None] * batch.num_rows
            for j, row in enumerate(full.tolist()):
                names[row], kept[row] = name[j].tobytes(), samples[j].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(sizes.astype(np.int32)), pa.array(names, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "tie", "size", "cls", "samples"])

    return describe


def _children(paths: np.ndarray, samples: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of one path each: (row, path) of the buckets one level down."""
    limit = np.uint64(min(2**64 - 1, int(chance * 2**64)))
    rows, out = [], []
    for k in range(COORDINATES):
        step = mix(paths ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64), seed=21)
        chosen = np.flatnonzero(step < limit)
        rows.append(chosen)
        out.append(mix(step[chosen] ^ (samples[chosen, k].astype(np.uint64) << np.uint64(20)), seed=22))
    return np.concatenate(rows), np.concatenate(out)


def _descend(levels: int, threshold: float, runs: int | None):
    """Rows with ``samples`` to rows of (cls, path); from the roots of all runs, or from ``path``."""
    chance = 1 / (threshold * COORDINATES)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                samples = np.frombuffer(b"".join(part.column("samples").to_pylist()), "<u4").reshape(-1, COORDINATES)
                if runs is None:
                    rows = np.arange(part.num_rows)
                    paths = part.column("path").to_numpy().view(np.uint64)
                else:
                    rows = np.repeat(np.arange(part.num_rows), runs)
                    paths = np.tile(mix(np.arange(runs, dtype=np.uint64), seed=20), part.num_rows)
                for _ in range(levels):
                    chosen, paths = _children(paths, samples[rows], chance)
                    rows = rows[chosen]
                yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(rows)), pa.array(paths.view(np.int64))], names=["cls", "path"])

    return descend


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each member's smallest member of its component, after edges between members are added."""
    while len(a):
        a, b = root[a], root[b]
        apart = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        if not apart.size:
            break
        root = root.copy()
        np.minimum.at(root, apart[1], apart[0])
        while not np.array_equal(root, root[root]):
            root = root[root]
        a, b = apart
    return root


def _alike(samples: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Each row's smallest row of its group, joined by samples that do not rule out the threshold.

    Rows are compared some at a time, and the pairs of each time are joined at once.
    """
    n = len(samples)
    root = np.arange(n)
    step = max(1, (1 << 22) // (n * COORDINATES))
    for start in range(0, n, step):
        same = (samples[start:start + step, None, :] == samples[None, :, :]).sum(axis=2, dtype=np.int16)
        x, y = sizes[start:start + step, None], sizes[None, :]
        ok = (same >= (threshold - MARGIN) * COORDINATES) & (np.minimum(x, y) >= threshold * np.maximum(x, y))
        i, j = np.nonzero(ok)
        root = _joined(root, i + start, j)
    return root


def _compare(threshold: float):
    """A bucket, or two blocks of one, to edges that keep alike classes together."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")  # the smallest class is the root in every bucket
        samples = np.frombuffer(b"".join(table.column("samples").to_pylist()), "<u4").reshape(-1, COORDINATES)
        sizes = table.column("size").to_numpy()
        root = _alike(samples, sizes, threshold)
        child = np.flatnonzero(root != np.arange(len(root)))
        names = table.column("cls")
        return pa.table({"a": names.take(pa.array(child)), "b": names.take(pa.array(root[child]))})

    return compare


def _paired(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of groups cut into ``blocks``: each row goes to every pair of blocks that holds its own.

    Adds ``one`` and ``two``, the pair, and ``side``, the row's block.
    """
    side = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return rows.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other")).drop("other")


def _verify(threshold: float):
    """Exact similarities within a pair of blocks: links of each class, and edges that keep groups together."""

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        ids = table.column("cls").to_pylist()
        once = sorted({c: k for k, c in enumerate(ids)}.values())  # a document that is there twice
        table = table.take(pa.array(once))
        lists = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in lists])
        texts = table.column("texts").to_numpy()
        side = table.column("side").to_numpy()
        n = len(lists)
        _, token = np.unique(np.concatenate(lists), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        # Tokens of the same classes count together; those of one class tell nothing.
        marks = mix(np.arange(n, dtype=np.uint64), seed=31)
        pattern = np.zeros(token.max() + 1, np.uint64)
        np.add.at(pattern, token, marks[owner])
        often = np.bincount(token) > 1
        _, first, column, weight = np.unique(pattern[often], return_index=True, return_inverse=True, return_counts=True)
        place = np.full(len(often), -1)
        place[often] = column
        sample = np.flatnonzero(often)[first]  # one token of each pattern
        used = np.zeros(len(often), bool)
        used[sample] = True
        keep = used[token]
        rows, columns = owner[keep], place[token[keep]]
        common = np.zeros((n, n), np.float32)
        step = max(256, (8 << 20) // max(n, 1))
        turn = np.argsort(columns, kind="stable")
        rows, columns = rows[turn], columns[turn]
        for start in range(0, len(weight), step):
            low, high = np.searchsorted(columns, [start, start + step])
            part = np.zeros((n, min(step, len(weight) - start)), np.float32)
            part[rows[low:high], columns[low:high] - start] = 1
            common += (part * weight[start:start + step].astype(np.float32)) @ part.T
        either = sizes[:, None] + sizes[None, :] - common
        link = common >= threshold * either - 1e-6
        np.fill_diagonal(link, False)
        if key[1].as_py() != key[2].as_py():
            link &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(link))
        root = _joined(np.arange(n), a, b)
        names = table.column("cls")
        return pa.table({"cls": names, "links": pa.array((link * texts[None, :]).sum(axis=1).astype(np.int64)), "root": names.take(pa.array(root))})

    return verify


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text), ``class_id``, ``n_links``, ``n_copies``, ``keep`` and ``wordless``.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Documents linked
    directly or over others form a class; ``class_id`` is the smallest doc_id of it (null ids come
    last). ``n_links`` is the number of other texts whose shingle sets are at least ``threshold`` alike,
    ``n_copies`` the number of other rows with the same text. ``keep`` marks the rows of one text of
    each class, that of the smallest id. Texts under ``shingle`` words are one shingle; texts without words and null texts are alike
    to nothing but are copies of their like, and each row is kept, a class of its own. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), "text")
    known = settled(rows.mapInArrow(_describe(shingle), f"doc_id {kind}, tie long, size int, cls binary, samples binary"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    texts = settled(known.groupBy("tie", "cls").agg(F.count("*").alias("rows"), F.min(order).alias("least"), F.first("size").alias("size"), F.first("samples").alias("samples")))
    named = texts.filter("cls IS NOT NULL")
    classes = settled(named.groupBy("cls").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.first("size").alias("size"), F.first("samples").alias("samples")))

    edges = _candidates(classes.select("cls", "size", "samples"), threshold, runs_for(recall, DEEPEST))
    groups = components(edges.select(F.col("a").alias("node")).union(edges.select("b")), edges)
    links, exact = _exact(rows, classes, groups, shingle, threshold)
    final = components(links.select(F.col("cls").alias("node")), exact)

    of_class = classes.select("cls", "texts", F.col("least").alias("own")).join(links, "cls", "left").join(final.withColumnRenamed("node", "cls"), "cls", "left")
    of_class = settled(of_class.select("cls", F.coalesce("root", "cls").alias("root"), "own", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links")))
    heads = of_class.groupBy("root").agg(F.min("own").alias("head"))
    of_class = of_class.join(heads, "root").select("cls", "n_links", "head")
    of_text = texts.select("tie", F.col("cls").alias("of"), "rows")
    out = known.select("doc_id", "tie", "cls").join(of_class, "cls", "left").join(of_text.withColumnRenamed("tie", "at"), (F.col("tie") == F.col("at")) & F.col("cls").eqNullSafe(F.col("of")), "left")
    alone = F.col("cls").isNull()
    return out.select(
        "doc_id", "tie", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("rows") - 1).cast("long").alias("n_copies"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie")))).alias("keep"), alone.alias("wordless"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents with one left of each class, columns unchanged; texts without words all stay.

    Rows travel as one struct, so that no name of theirs can clash.
    """
    near = near_duplicates(docs, **options).filter("keep")
    kept = settled(near.groupBy(F.col("doc_id").alias("at_id"), "tie").agg(F.count("*").alias("rows"), F.bool_or("wordless").alias("wordless")))
    whole = docs.select(F.struct("*").alias("whole"))
    same = F.col("whole.doc_id").eqNullSafe(F.col("at_id")) & (F.coalesce(F.xxhash64("whole.text"), F.lit(0)) == F.col("tie"))
    stay = whole.join(kept, same)
    repeated = (F.col("rows") > 1) & ~F.col("wordless")
    if not kept.filter(repeated).isEmpty():
        # Equal ids and texts: one row of each, the others are gathered by key and let go.
        stay = stay.filter(~repeated).unionByName(stay.filter(repeated).dropDuplicates(["at_id", "tie"]))
    return stay.select("whole.*")


def _candidates(classes: DataFrame, threshold: float, runs: int) -> DataFrame:
    """Edges ``a``, ``b`` that join classes found alike by their samples."""
    found = None
    members = classes.select("cls", "samples").mapInArrow(_descend(START, threshold, runs), "cls binary, path long")
    for level in range(START, DEEPEST + 1):
        members = settled(members, free=True)
        counts = settled(members.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"))
        last = level == DEEPEST
        small = counts if last else counts.filter(F.col("n") <= SMALL)
        rows = members.join(small, "path").join(classes, "cls")
        paired = _paired(rows, F.ceil(F.col("n") / COMPARED))
        edges = settled(paired.groupBy("path", "one", "two").applyInArrow(_compare(threshold), "a binary, b binary").distinct(), free=True)
        found = edges if found is None else found.unionByName(edges)
        large = counts.filter(F.col("n") > SMALL)
        if last or large.isEmpty():
            return found
        members = members.join(large.select("path"), "path", "left_semi").join(classes.select("cls", "samples"), "cls").select("cls", "path", "samples")
        members = members.mapInArrow(_descend(1, threshold, None), "cls binary, path long").distinct()
    return found


def _exact(rows: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``cls`` and ``links`` of all classes in groups, and the edges of the groups that remain."""
    members = classes.join(groups.withColumnRenamed("node", "cls").withColumnRenamed("root", "grp"), "cls")
    totals = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    wanted = members.join(totals, "grp").select("cls", "grp", "blocks", "texts", F.col("least.doc_id").alias("at_id"), F.col("least.tie").alias("at_tie"))
    of_text = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("tie") == F.col("at_tie"))).select("cls", "grp", "blocks", "texts", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            sets, firsts = shingles(*utf8(batch), shingle)
            raw = [sets[a:b].tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("cls", "grp", "blocks", "texts")), pa.array(raw, pa.binary())], names=["cls", "grp", "blocks", "texts", "shingles"])

    spelt = of_text.mapInArrow(spell, "cls binary, grp binary, blocks long, texts long, shingles binary")
    paired = _paired(settled(spelt, free=True), F.col("blocks"))
    checked = settled(paired.groupBy("grp", "one", "two").applyInArrow(_verify(threshold), "cls binary, links long, root binary"), free=True)
    links = checked.groupBy("cls").agg(F.sum("links").alias("links"))
    exact = checked.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()
    return links, exact
