"""Mix sources to target weights by the cube method.

Each source is to bring ``target`` words. A document is taken ``floor(target / source size)`` times, and
once more with the remaining fraction as its inclusion probability. Which documents get that extra copy
is settled by the cube method: probabilities move along directions that change neither the words nor the
documents of a block, until all but two of a block are 0 or 1. The two go to the next level; only the
last block of a source lands: a linear program over all ways to settle its last few small documents
finds the chances of each way that keep every document's own chance and come closest to the words. Where a few
large documents still keep a small source off its target, one or two are settled the other way.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
LARGEST = 64  # documents of a block that are settled against all smaller ones
LEFT_OVER = 2  # as many as there are constraints
NEAR = 0.005  # part of a source's open words that a landing may miss
LANDING = 10  # smallest documents of a source that are left for the landing


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``source``, ``source_size`` with ``rank`` (by code point, null last), ``weight`` and ``target``.

    The total of all sizes is shared by weight; what exceeds ``cap`` times a source's size is shared
    again among the others until nothing does. Each round is one aggregation over the sources.
    """
    spark = sources.sparkSession
    ordered = cut_lineage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(ordered.groupBy(part.alias("p")).count().collect())  # a row a partition
    before = [0, *accumulate(r["count"] for r in sizes)]
    bases = spark.createDataFrame([(r.p, b) for r, b in zip(sizes, before)], "p long, base long")
    ranked = ordered.join(F.broadcast(bases), part == F.col("p")).withColumn("rank", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1))
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(given, (F.col("rank") % len(weights) + 1).cast("int")))
    most = F.col("source_size") * float(cap)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = None, None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level > most
        row = ranked.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if level is not None and row.n == full or not row.open:
            break
        full, level = row.n, (total - row.held) / row.open
    target = F.least(F.col("weight") * (level or 0.0), most)
    return ranked.withColumn("target", target.cast("double")).drop("at", "p", "base")


def _bounds(x: np.ndarray, d: np.ndarray) -> tuple[float, float]:
    """How far ``x`` may go along ``d`` and back before a chance leaves 0 to 1."""
    moving = d != 0
    x, d = x[moving], d[moving]
    room_up, room_down = np.where(d > 0, 1 - x, x), np.where(d > 0, x, 1 - x)
    return float((room_up / np.abs(d)).min()), float((room_down / np.abs(d)).min())


def landing(sizes: list[float], chances: list[float], draw: random.Random) -> list[float]:
    """0 or 1 for a few documents, by their chances and with as little error in words as those allow.

    The ways to settle them are the variables of a linear program, their shares of all draws: each
    document's shares add up to its chance, and the mean error is least (errors in the number of
    documents weigh a millionth). Simplex steps start from the ways that take all documents above a
    threshold.
    """
    x, size, n = np.array(chances), np.array(sizes), len(chances)
    if not n:
        return []
    ways = ((np.arange(1 << n) >> np.arange(n)[:, None]) & 1).astype(float)  # a column each
    cost = np.abs(size @ ways - size @ x) + 1e-6 * np.abs(ways.sum(axis=0) - x.sum())
    full = np.vstack([ways, np.ones(1 << n)])
    order = np.argsort(-x, kind="stable")
    basis = np.concatenate([[0], np.cumsum(1 << order)])
    for turn in range(64 * n):
        inverse = np.linalg.inv(full[:, basis])
        shares = inverse @ np.append(x, 1.0)
        gain = cost - (cost[basis] @ inverse) @ full
        better = np.flatnonzero(gain < -1e-9 * (1 + size.max()))
        if not len(better):
            break
        enter = better[0] if turn % 4 == 3 else int(gain.argmin())  # the first one at times, against circles
        step = inverse @ full[:, enter]
        room = np.where(step > 1e-9, np.maximum(shares, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[int(room.argmin())] = enter
    shares = np.maximum(np.linalg.solve(full[:, basis], np.append(x, 1.0)), 0)
    pick = draw.random() * shares.sum()
    return ways[:, basis[min(int(np.searchsorted(np.cumsum(shares), pick, side="right")), n)]].tolist()


def nearer(size: np.ndarray, chances: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` with a few documents settled the other way, if its words miss the chances' by more than ``NEAR``.

    A few large documents cannot keep their chances and the words of a small source; the words go first.
    Only documents that were open change, one or two at a time, and each change comes closer.
    """
    open_ones = np.flatnonzero((chances > 0) & (chances < 1) & (size > 0))
    wanted = float(size @ chances)
    while len(open_ones) and abs(missing := wanted - float(size @ x)) > NEAR * wanted:
        change = np.where(x[open_ones] > 0.5, -size[open_ones], size[open_ones])
        order = np.argsort(change, kind="stable")
        ordered = change[order]
        # For each document the one that goes with it best: the closest to what is then still missing.
        spot = np.clip(np.searchsorted(ordered, missing - change), 1, max(1, len(ordered) - 1))
        partner = np.stack([order[spot - 1], order[np.minimum(spot, len(order) - 1)]])
        both = np.abs(missing - change - change[partner])
        both[partner == np.arange(len(change))] = np.inf
        single = np.abs(missing - change)
        best = min(single.min(), both.min())
        if best >= abs(missing):
            break
        flips = [int(single.argmin())] if single.min() == best else [int(both.min(axis=0).argmin())]
        if single.min() != best:
            flips.append(int(partner[both[:, flips[0]].argmin(), flips[0]]))
        x[open_ones[flips]] = 1 - x[open_ones[flips]]
    return x


def flight(sizes: list[float], chances: list[float], draw: random.Random, land: bool) -> list[float]:
    """Move ``chances`` to 0 or 1 while keeping sum(chance) and sum(chance * size).

    Each move follows the null space of the two constraints, one way or back with chances that keep
    every expectation, until a chance is 0 or 1. The largest documents go first, each against two halves
    of all smaller ones, since a large document that is left over could not be made up for. Then three
    documents at a time are enough. All but two documents end at 0 or 1; with ``land`` these and the
    ``LANDING`` smallest are settled together, see :func:`landing`.
    """
    size, x = np.array(sizes, float), np.array(chances, float)
    order = np.argsort(-size, kind="stable")
    order = order[(x[order] > 0) & (x[order] < 1)]

    def settle(members: np.ndarray, direction: np.ndarray) -> None:
        up, down = _bounds(x[members], direction)
        step = up if draw.random() * (up + down) < down else -down
        moved = x[members] + step * direction
        moved[moved < 1e-9], moved[moved > 1 - 1e-9] = 0, 1
        x[members] = moved

    for k in range(min(LARGEST, len(order))):
        unit = order[k]
        while 0 < x[unit] < 1:
            rest = order[k + 1:]
            rest = rest[(x[rest] > 0) & (x[rest] < 1)]
            if len(rest) < (LANDING if land else LEFT_OVER):
                break
            half = len(rest) // 2
            words, docs = (size[rest[:half]].sum(), size[rest[half:]].sum()), (half, len(rest) - half)
            det = words[0] * docs[1] - words[1] * docs[0]
            if abs(det) > 1e-9:
                alpha = (words[1] - size[unit] * docs[1]) / det
                beta = (size[unit] * docs[0] - words[0]) / det
            elif size[unit] * len(rest) == sum(words):  # all of one size
                alpha = beta = -1 / len(rest)
            else:
                break
            settle(np.append(rest, unit), np.concatenate([np.full(half, alpha), np.full(len(rest) - half, beta), [1.0]]))
    held: list[int] = []
    x = x.tolist()

    def move(members: list[int], direction: list[float]) -> None:
        up = min(((1 - x[k]) / d if d > 0 else x[k] / -d) for k, d in zip(members, direction) if d)
        down = min((x[k] / d if d > 0 else (1 - x[k]) / -d) for k, d in zip(members, direction) if d)
        step = up if draw.random() * (up + down) < down else -down
        for k, d in zip(members, direction):
            x[k] += step * d
            if x[k] < 1e-9:
                x[k] = 0.0
            elif x[k] > 1 - 1e-9:
                x[k] = 1.0

    moving = [k for k in order.tolist() if 0 < x[k] < 1]
    last = moving[-LANDING:] if land else []
    for k in moving[:len(moving) - len(last)]:
        held.append(k)
        while len(held) > LEFT_OVER:
            a, b, c = (sizes[i] for i in held)
            move(held, [b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0])
            held = [i for i in held if 0 < x[i] < 1]
    if land:
        held += last
        for k, taken in zip(held, landing([sizes[k] for k in held], [x[k] for k in held], draw)):
            x[k] = taken
    return x


def _fly(seed: int, level: int, land: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("salt", "doc_id", "tie", "size")])
        draw = random.Random(f"{seed}/{level}/{key[0]}/{key[1]}")
        words, before = rows["words"].to_pylist(), rows["chance"].to_pylist()
        chances = flight(words, before, draw, land)
        if land:
            chances = nearer(np.array(words), np.array(before), np.array(chances)).tolist()
        return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(chances, pa.float64()))

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """How often the mix takes each document.

    Columns: ``doc_id``, ``source``, ``tie`` (a hash of the text), ``rows`` (equal input rows, which are
    one unit of the sample and are taken equally often), ``size`` (words of one row), ``source_size``,
    ``target`` (of its source, words) and ``copies`` (of each row). The same input gives the same rows.
    Null or empty texts have size 0; a null source is a source of its own, the last; null ids are ids
    like others. An empty table gives an empty mix. No column but doc_id, source and text is read.

    Nothing but one row per document moves, and hot sources are cut into blocks of about ``block``
    documents.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), size.alias("size"))
    units = cut_lineage(units.groupBy("doc_id", "source", "tie", "size").agg(F.count("*").alias("rows")))
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    sources = cut_lineage(with_targets(per_source, weights, cap))
    most_units = sources.agg(F.max("units")).first()[0] or 0
    facts = sources.select(F.col("source").alias("of"), "rank", "source_size", "target", "units")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("chance", rate - F.floor(rate))
    rows = rows.withColumn("words", (F.col("size") * F.col("rows")).cast("double"))
    rows = rows.withColumn("salt", F.xxhash64(F.lit(seed), "doc_id", "tie"))
    rows = rows.withColumn("blocks", F.ceil(F.col("units") / block))
    open_rows, settled = rows, []
    level, most_blocks = 0, math.ceil(most_units / block)
    while True:
        land = most_blocks <= 1
        salt = F.xxhash64(F.lit(level), "salt")
        dealt = open_rows.withColumn("blk", F.pmod(salt, F.col("blocks")))
        flown = cut_lineage(dealt.groupBy("rank", "blk").applyInArrow(_fly(seed, level, land), dealt.schema).drop("blk"))
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.filter(~undecided))
        if land:
            break
        open_rows = flown.filter(undecided).withColumn("blocks", F.ceil(F.col("blocks") * LEFT_OVER / block))
        level, most_blocks = level + 1, math.ceil(most_blocks * LEFT_OVER / block)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("chance")).cast("long").alias("copies")
    return out.select("doc_id", "source", "tie", "rows", "size", "source_size", "target", copies)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as many times as the mix takes it, columns unchanged.

    Rows travel as one struct, so that no name of theirs can clash.
    """
    chosen = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("at_id"), F.col("source").alias("at_source"), "tie", "copies")
    whole = docs.select(F.struct("*").alias("whole"))
    same = F.col("whole.doc_id").eqNullSafe(F.col("at_id")) & F.col("whole.source").eqNullSafe(F.col("at_source")) & (F.xxhash64("whole.text") == F.col("tie"))
    return whole.join(chosen, same).select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
