"""Ranked lexical search by a dual tree: the best documents for each item, exactly.

A document is a sparse vector of term impacts, an item one of term counts; a score is their product.
Both sides have hierarchies. A node holds the largest value of each coordinate below it, so the product
of two nodes bounds the score of every pair below them. A pair of nodes goes, with all documents and
items in it, when its bound is below the weakest k-th score of its items; the others are taken apart, the
most promising first, down to pairs of leaves, whose scores are computed.

Items are taken in blocks of a bounded number of terms. For a block, tasks turn whole texts into
postings of the block's terms (a table), and build document trees over them. A first pass over one
document of ``SEED_EVERY`` gives each item a k-th score to start from; the second takes all documents and
returns only those that reach it, at most k for an item and task. Starting scores change what is looked
at and never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.batches import by_bytes, ranges, utf8
from webcorpus.llm.scratch import Scratch
from webcorpus.llm.words import ALPHANUMERIC, LOWER, word_hashes, word_spans

SLICE_BYTES = 4 << 20
BLOCK_TERMS = 1 << 15  # distinct terms of items, summed over the items of a block
SEED_EVERY = 64
LEAF_DOCS, DOC_FAN = 32, 8
LEAF_ITEMS, ITEM_FAN = 8, 4
TREE_ENTRIES = 1 << 20  # postings of one document tree

#: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: letters and digits of ASCII and all beyond it
TERM = ALPHANUMERIC[LOWER]


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and row of every term, for ranges of a batch; a very long text comes in several."""
    data, offsets = utf8(batch)
    for start, stop in ranges(data, SLICE_BYTES, ~TERM):
        part = data[start:stop]
        starts, ends, firsts = word_spans(part, np.clip(offsets, start, stop) - start, TERM)
        yield word_hashes(part, starts, ends, lower=True), np.repeat(np.arange(batch.num_rows), np.diff(firsts))


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list per row of ``values``, which are sorted by row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", SLICE_BYTES):
        hashes, rows = (np.concatenate(x) for x in zip(*_terms(batch)))
        order = np.lexsort([hashes, rows])
        hashes, rows = hashes[order], rows[order]
        new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))[:len(hashes)])
        counts = np.diff(np.append(new, len(hashes)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("block_key"), _lists(rows[new], hashes[new].view(np.int64), batch.num_rows, pa.int64()), _lists(rows[new], counts, batch.num_rows, pa.int64())],
            names=["item_id", "block_key", "terms", "counts"])


POSTINGS = "doc_id long, n long, cols array<int>, tfs array<int>"


def _postings(vocabulary):
    """Texts to how many terms they have and which of the ``vocabulary`` (a broadcast, sorted), how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            n = np.zeros(batch.num_rows, np.int64)
            keys = []
            for hashes, rows in _terms(batch):
                n += np.bincount(rows, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                met = known[at] == hashes
                keys.append(rows[met] * len(known) + at[met])
            key, tfs = np.unique(np.concatenate(keys), return_counts=True)
            rows, cols = key // len(known), key % len(known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), _lists(rows, cols.astype(np.int32), batch.num_rows, pa.int32()), _lists(rows, tfs.astype(np.int32), batch.num_rows, pa.int32())],
                names=["doc_id", "n", "cols", "tfs"])

    return run


def _document_counts(size: int):
    """In how many of a task's documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("cols").flatten().to_numpy(), minlength=size)
        cols = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cols.astype(np.int32)), pa.array(counts[cols])], names=["col", "df"])

    return run


def _levels(n: int, leaf: int, fan: int) -> list[np.ndarray]:
    """Edges of the nodes of each level, leaves first, the root last."""
    levels = [np.append(np.arange(0, n, leaf), n)]
    while len(levels[-1]) > 2:
        nodes = len(levels[-1]) - 1
        levels.append(np.append(np.arange(0, nodes, fan), nodes))
    return levels


class ItemTree:
    """The items of a block under nodes of term maxima."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        """``items``: columns and counts of each; items that share their weightiest term stand side by side."""
        lead = [int(cols[np.argmax(weights[cols])]) for cols, _ in items]
        self.order = np.argsort(lead, kind="stable")
        self.counts = np.zeros((len(items), len(weights)), np.int64)
        for row, k in enumerate(self.order):
            self.counts[row, items[k][0]] = items[k][1]
        self.levels = _levels(len(items), LEAF_ITEMS, ITEM_FAN)
        below, self.maxima, self.spans = self.counts.astype(np.float64), [], []
        first, last = np.arange(len(items)), np.arange(len(items)) + 1
        for edges in self.levels:
            below = np.maximum.reduceat(below, edges[:-1], axis=0)
            first, last = first[edges[:-1]], last[edges[1:] - 1]
            self.maxima.append(below)
            self.spans.append(np.column_stack([first, last]))


class DocTree:
    """Documents under nodes of impact maxima, kept sparse: offsets, columns and values per level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, width: int):
        """Entries are sorted by row. Documents that share their greatest impact's term stand side by side."""
        order = np.lexsort([impacts, rows])
        last = np.append(rows[order][1:] != rows[order][:-1], True)[:len(rows)]
        lead = np.full(len(ids), width)
        lead[rows[order][last]] = cols[order][last]
        place = np.argsort(lead, kind="stable")
        self.ids = ids[place]
        spot = np.empty(len(ids), np.int64)
        spot[place] = np.arange(len(ids))
        rows = spot[rows]
        order = np.argsort(rows, kind="stable")
        self.rows, self.cols, self.impacts = rows[order], cols[order], impacts[order]
        self.starts = np.searchsorted(self.rows, np.arange(len(ids) + 1))
        self.edges = _levels(len(ids), LEAF_DOCS, DOC_FAN)
        self.levels = []
        rows, cols, values = self.rows, self.cols, self.impacts
        for edges in self.edges:
            key = (np.searchsorted(edges, rows, side="right") - 1) * width + cols
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[:len(key)])
            values = np.maximum.reduceat(values[order], new) if len(new) else values
            rows, cols = key[order][new] // width, key[order][new] % width
            self.levels.append((np.searchsorted(rows, np.arange(len(edges))), cols, values.astype(np.float64)))

    def bounds(self, level: int, nodes: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
        """No document below these nodes has a greater product with anything below ``coordinates``."""
        offsets, cols, values = self.levels[level]
        sizes = offsets[nodes + 1] - offsets[nodes]
        at = _spread(offsets[nodes], sizes)
        sums = np.zeros(len(at) + 1)
        np.cumsum(coordinates[cols[at]] * values[at], out=sums[1:])
        ends = np.cumsum(sizes)
        # What rounding of sums beyond 2**53 may lose is put on top.
        return (sums[ends] - sums[ends - sizes]) + sums[-1] * 1e-9


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Search:
    """The ``k`` best documents of every item so far; ``floor`` are scores that k documents are known to reach."""

    def __init__(self, items: ItemTree, k: int, floor: np.ndarray):
        self.items, self.k = items, k
        self.scores: list[np.ndarray] = [np.empty(0, np.int64) for _ in floor]
        self.ids: list[np.ndarray] = [np.empty(0, np.int64) for _ in floor]
        self.weakest = np.maximum(floor, 1).astype(np.int64)
        self.scored = 0  # pairs whose score was computed

    def add(self, docs: DocTree) -> None:
        """Take all documents of a tree into account."""
        if len(docs.ids):
            self._visit(docs, len(self.items.levels) - 1, 0, len(docs.edges) - 1, np.array([0]))

    def _visit(self, docs: DocTree, item_level: int, node: int, doc_level: int, nodes: np.ndarray) -> None:
        first, last = self.items.spans[item_level][node]
        bounds = docs.bounds(doc_level, nodes, self.items.maxima[item_level][node])
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds = nodes[order], bounds[order]
        keep = bounds >= self.weakest[first:last].min()
        nodes, bounds = nodes[keep], bounds[keep]
        if not len(nodes):
            return
        if doc_level == 0 and item_level == 0:
            for at in range(0, len(nodes), 8):
                good = bounds[at:at + 8] >= self.weakest[first:last].min()
                if not good[0]:
                    return
                self._score(docs, first, last, nodes[at:at + 8][good])
            return
        if doc_level:
            edges = docs.edges[doc_level]
            nodes = _spread(edges[nodes], edges[nodes + 1] - edges[nodes])
        below = (self.items.levels[item_level][node], self.items.levels[item_level][node + 1]) if item_level else (node, node + 1)
        for child in range(*below):
            self._visit(docs, max(item_level - 1, 0), child, max(doc_level - 1, 0), nodes)

    def _score(self, docs: DocTree, first: int, last: int, leaves: np.ndarray) -> None:
        edges = docs.edges[0]
        rows = _spread(edges[leaves], edges[leaves + 1] - edges[leaves])
        sizes = docs.starts[rows + 1] - docs.starts[rows]
        rows, sizes = rows[sizes > 0], sizes[sizes > 0]
        if not len(rows):
            return
        at = _spread(docs.starts[rows], sizes)
        products = docs.impacts[at] * self.items.counts[first:last][:, docs.cols[at]]
        scores = np.add.reduceat(products, np.cumsum(sizes) - sizes, axis=1)
        ids = docs.ids[rows]
        self.scored += scores.size
        for item in np.flatnonzero((scores >= self.weakest[first:last, None]).any(axis=1)):
            mine = scores[item] >= self.weakest[first + item]
            self._take(first + item, scores[item][mine], ids[mine])

    def _take(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        best = np.lexsort([ids, -scores])[:self.k]
        self.scores[item], self.ids[item] = scores[best], ids[best]
        if len(best) == self.k:
            self.weakest[item] = max(self.weakest[item], self.scores[item][-1])


def _impacts(n: np.ndarray, rows: np.ndarray, cols: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, terms: int) -> np.ndarray:
    if int(n.max(initial=0)) * documents * 75 < 2**63:
        length = 25 + (75 * n * documents) // terms
    else:
        length = np.array([25 + (75 * int(x) * documents) // terms for x in n], np.int64)
    return weights[cols] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * length[rows]))


NO_ID = -(2**63)  # a null doc_id, the smallest


def _searching(plan, k: int):
    """Postings to ``item`` (its place in the block's tree), ``doc_id`` and ``score``; ``plan`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, terms, floor = plan.value
        search = Search(items, k, floor)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            n = batch.column("n").to_numpy()
            lists = batch.column("cols")
            sizes = np.diff(lists.offsets.to_numpy())
            cols, tfs = lists.flatten().to_numpy().astype(np.int64), batch.column("tfs").flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(ids)), sizes)
            impacts = _impacts(n, rows, cols, tfs, weights, documents, terms)
            ends = np.cumsum(sizes)
            start = 0
            while start < len(ids):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + TREE_ENTRIES, side="right")))
                part = slice(before, int(ends[stop - 1]))
                search.add(DocTree(ids[start:stop], rows[part] - start, cols[part], impacts[part], len(weights)))
                start = stop
        found = [pa.array(np.concatenate(x)) for x in (search.ids, search.scores)]
        at = np.repeat(np.arange(len(search.ids)), [len(x) for x in search.ids])
        doc_ids = pc.if_else(pc.equal(found[0], NO_ID), pa.scalar(None, pa.int64()), found[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), doc_ids, found[1]], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, seed_every: int = SEED_EVERY) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs`` for each of ``items``, scores above 0 only.

    ``docs`` has ``doc_id`` (an integer) and ``text``, ``items`` ``item_id`` and ``text``. A term's weight
    is ``floor(1000 ln((2N+2) / (2df+1)))``; a document's score sums, over the item's terms with repeats,
    weight times ``(10**9 tf) div (1000 tf + 8 m)``, ``m = 25 + (75 n N) div L``; N documents have a term, L
    are all terms, n the document's. Equal scores rank by ``doc_id``, null first.

    Null and empty texts have no terms: such documents do not count and such items get no rows. Repeated
    document rows are documents of their own; items alike in id and text count once. An empty table gives
    no rows; other columns are not read. The driver holds one block of items at a time, with at most
    ``block_terms`` terms or a single longer item (blocks are cut by hash, so about that many).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct().withColumn("block_key", F.xxhash64("item_id", "text"))
    asked = scratch.keep(texts.mapInArrow(_item_terms, f"item_id {kind}, block_key long, terms array<long>, counts array<long>").filter(F.size("terms") > 0), free=False)
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    out = None
    for block in range(blocks):
        ranked = _search_block(scratch, docs, asked.filter(F.pmod("block_key", F.lit(blocks)) == block), kind, k, seed_every)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _search_block(scratch: Scratch, docs: DataFrame, asked: DataFrame, kind: str, k: int, seed_every: int) -> DataFrame:
    spark = docs.sparkSession
    block = asked.select("item_id", "terms", "counts").toArrow()
    if not block.num_rows:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    terms = [np.array(t, np.int64).view(np.uint64) for t in block.column("terms").to_pylist()]
    vocabulary = np.unique(np.concatenate(terms))
    held = spark.sparkContext.broadcast(vocabulary)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = scratch.keep(texts.mapInArrow(_postings(held), POSTINGS))
    held.destroy()
    documents, length = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    met = postings.select("cols").mapInArrow(_document_counts(len(vocabulary)), "col int, df long").groupBy("col").agg(F.sum("df").alias("df")).toArrow()
    frequency = np.zeros(len(vocabulary), np.int64)
    frequency[met.column("col").to_numpy()] = met.column("df").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    tree = ItemTree([(np.searchsorted(vocabulary, t), np.array(c)) for t, c in zip(terms, block.column("counts").to_pylist())], weights)

    def best(rows: DataFrame, floor: np.ndarray) -> DataFrame:
        plan = spark.sparkContext.broadcast((tree, weights, documents, max(length, 1), floor))
        found = rows.mapInArrow(_searching(plan, k), "item int, doc_id long, score long")
        place = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = scratch.keep(found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k), free=False)
        plan.destroy()
        return found

    nothing = np.zeros(block.num_rows, np.int64)
    matched = postings.filter(F.size("cols") > 0)
    few = matched.filter(F.pmod(F.xxhash64("doc_id"), F.lit(seed_every)) == 0)
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // seed_every)
    floor = nothing.copy()
    for row in best(few.repartition(parts), nothing).filter(F.col("rank") == k).select("item", "score").collect():
        floor[row.item] = row.score
    found = best(matched, floor)
    scratch.drop(postings)
    names = block.select(["item_id"]).take(pa.array(tree.order)).append_column("item", pa.array(np.arange(block.num_rows, dtype=np.int32)))
    return found.join(F.broadcast(spark.createDataFrame(names)), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
