"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (words); full pieces are
packs by themselves. The others are spread by hash over cells of about
CELL pieces, and each cell is packed by ISLANDS populations. A crossover injects
well-filled whole packs of one parent into the other, takes out the packs that
hold a piece twice, and places the displaced pieces by best fit, longest first.
After each epoch but the last every island sends its best packings to the next
one of its cell, where they evolve on; at the end the best packing of all islands counts: fewest packs, then the
greatest sum of squared fills.

A cell's work depends on the cell alone, so cost follows the number of
documents, and a seed made of cell, island and epoch makes a task that runs
again give the same result. Between epochs only numbers of packs move: texts
are read once, for their lengths.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm._common import cut

CAPACITY = 2048
CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 2000, 3, 3, 4, 6, 2
_STATE = "cell long, island int, role string, blob binary"
_STATE_SCHEMA = pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("role", pa.string()), ("blob", pa.binary())])


def best_fit(lengths: np.ndarray, order: np.ndarray, packs: np.ndarray, free: dict[int, int], capacity: int) -> None:
    """Places pieces in this order, each into the fullest pack that has room, else into a new one."""
    room = sorted((f, p) for p, f in free.items())
    new = max(free, default=-1) + 1
    for i in order.tolist():
        size = int(lengths[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            f, p = room.pop(k)
        else:
            f, p, new = capacity, new, new + 1
        packs[i] = p
        free[p] = f - size
        if f > size:
            insort(room, (f - size, p))


def quality(lengths: np.ndarray, packs: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(packs, weights=lengths)
    fill = fill[fill > 0] / capacity
    return -len(fill), float(np.square(fill).sum())


def fresh_packing(lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    """Best fit, longest first, with lengths blurred by ``noise``."""
    packs = np.full(len(lengths), -1, np.int64)
    order = np.argsort(-lengths * (1 + noise * rng.standard_normal(len(lengths))), kind="stable")
    best_fit(lengths, order, packs, {}, capacity)
    return packs


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of packing a with some of the best-filled packs of b."""
    fill = np.bincount(b, weights=lengths)
    good = np.argsort(-fill, kind="stable")[: max(1, int((fill > 0).sum()) // 2)]
    chosen = rng.choice(good, max(1, len(good) // 5), replace=False)
    injected = np.isin(b, chosen)
    child = a.copy()
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    least = np.argsort(np.bincount(a, weights=lengths, minlength=len(hit)), kind="stable")[: max(1, len(hit) // 50)]
    hit[least] = True  # mutation: the emptiest packs dissolve too
    displaced = np.flatnonzero(hit[a] & ~injected)
    _, child[injected] = np.unique(b[injected], return_inverse=True)
    child[injected] += len(hit)
    stay = ~injected & ~hit[a]
    used = np.bincount(child[stay | injected], weights=lengths[stay | injected]).astype(np.int64)
    free = {int(p): capacity - int(used[p]) for p in np.flatnonzero(used)}
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], child, free, capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, generations: int, size: int) -> list[np.ndarray]:
    """The population after some generations, best first."""
    while len(population) < size:
        population.append(fresh_packing(lengths, capacity, rng, 0.0 if not population else 0.1 * rng.random()))
    ranked = sorted(((quality(lengths, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0][0], -x[0][1], x[1]))
    count = len(population)
    for _ in range(generations):
        for _ in range(max(1, size // 2)):
            i, j = sorted(rng.choice(len(ranked), 2, replace=False)) if len(ranked) > 1 else (0, 0)
            child = crossover(lengths, ranked[i][2], ranked[j][2], capacity, rng)
            ranked.append((quality(lengths, child, capacity), count, child))
            count += 1
        ranked = sorted(ranked, key=lambda x: (-x[0][0], -x[0][1], x[1]))[:size]
    return [p for _, _, p in ranked]


def _epoch(table: pa.Table, capacity: int, epoch: int, islands: int, generations: int, size: int, migrants: int) -> pa.Table:
    cell, island = table["cell"][0].as_py(), table["island"][0].as_py()
    roles, blobs = table["role"].to_pylist(), table["blob"].to_pylist()
    items = next(b for r, b in zip(roles, blobs) if r == "items")
    lengths = np.frombuffer(items, np.int32).astype(np.int64)
    population = [np.frombuffer(b, np.int32).astype(np.int64) for _, b in sorted((r, b) for r, b in zip(roles, blobs) if r != "items")]
    rng = np.random.default_rng([abs(cell), island, epoch])
    ranked = evolve(lengths, population, capacity, rng, generations, size)
    rows = [(cell, island, "items", items)]
    rows += [(cell, island, f"member{k}", p.astype(np.int32).tobytes()) for k, p in enumerate(ranked)]
    rows += [(cell, (island + 1) % islands, f"migrant{k}", p.astype(np.int32).tobytes()) for k, p in enumerate(ranked[:migrants])]
    return pa.Table.from_pylist([dict(zip(_STATE_SCHEMA.names, r)) for r in rows], _STATE_SCHEMA)


def _stepper(capacity: int, epoch: int, islands: int, generations: int, population: int, migrants: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _epoch(table, capacity, epoch, islands, generations, population, migrants)


def _best(table: pa.Table, capacity: int) -> pa.Table:
    roles, blobs = table["role"].to_pylist(), table["blob"].to_pylist()
    lengths = np.frombuffer(next(b for r, b in zip(roles, blobs) if r == "items"), np.int32).astype(np.int64)
    best = max((quality(lengths, p, capacity), p.tolist()) for p in (np.frombuffer(b, np.int32) for r, b in zip(roles, blobs) if r != "items"))[1]
    return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int64()), "packs": pa.array([best], pa.list_(pa.int32()))})


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, n, copy, piece, first_token, n_tokens): each row of docs in pieces of at most ``capacity`` tokens.

    n is the row's number of tokens; rows that share doc_id (or have none) and n are numbered by copy, so the
    first four columns tell all pieces apart, and are the same however often a task runs.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")).cast("long").alias("n")).where("n > 0")
    rows = counted.groupBy("doc_id", "n").agg(F.count("*").alias("rows")).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    cuts = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))))
    first = F.col("piece").cast("long") * capacity
    return cuts.select("doc_id", "n", "copy", "piece", first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("n") - first).cast("int").alias("n_tokens"))


def in_cells(all_pieces: DataFrame, cells: int) -> DataFrame:
    """The pieces with the cell that packs them, by a hash of all that tells them apart: repeated rows spread too."""
    return all_pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "n", "copy", "piece"), F.lit(cells)).cast("long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(pack_id, slot, doc_id, piece, first_token, n_tokens): the pieces of all documents, in packs of at most ``capacity`` tokens.

    docs: doc_id, text; other columns are ignored. Tokens are runs without
    white space. A null text or one without tokens fills no place and has no
    row; a longer text than ``capacity`` has several pieces; repeated rows are
    packed each, as are rows without an id, with a null doc_id. An empty table
    gives an empty one.
    """
    all_pieces = cut(pieces(docs, capacity), "pieces")
    count = all_pieces.where(F.col("n_tokens") < capacity).count()
    cells = max(1, -(-count // cell))
    placed = in_cells(all_pieces, cells)
    whole = placed.where(F.col("n_tokens") == capacity).select(F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "n", "copy", "piece").alias("pack_id"), F.lit(0).alias("slot"), "doc_id", "piece", "first_token", "n_tokens")
    part = placed.where(F.col("n_tokens") < capacity)
    by_cell = part.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("n_tokens", "doc_id", "piece", "first_token", "n", "copy"))).alias("items"))
    by_cell = cut(by_cell, "cells")
    to_bytes = by_cell.mapInArrow(_lengths, "cell long, blob binary")
    state = to_bytes.select("cell", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit("items").alias("role"), "blob")
    tasks = max(1, min(cells * islands, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells * islands // 8)))
    for epoch in range(epochs):
        # a cell's rows are few bytes but much work: left to itself, adaptive execution would put all cells into one task
        state = state.repartition(tasks, "cell", "island")
        state = state.groupBy("cell", "island").applyInArrow(_stepper(capacity, epoch, islands, generations, population, ELITE if epoch + 1 < epochs else 0), _STATE)
        state = cut(state, "islands")
    best = state.groupBy("cell").applyInArrow(lambda t: _best(t, capacity), "cell long, packs array<int>")
    rows = by_cell.join(best, "cell").select("cell", F.posexplode(F.arrays_zip("items", "packs")).alias("at", "x"))
    rows = rows.select(F.concat_ws("-", "cell", "x.packs").alias("pack_id"), "at", "x.items.doc_id", "x.items.piece", "x.items.first_token", "x.items.n_tokens")
    slots = rows.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "piece", "first_token", "n_tokens"))).alias("s"))
    slots = slots.select("pack_id", F.posexplode("s").alias("slot", "x")).select("pack_id", "slot", "x.doc_id", "x.piece", "x.first_token", "x.n_tokens")
    return slots.unionByName(whole)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            values = batch["items"][i].values.field("n_tokens").to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["cell"].slice(i, 1), pa.array([values.tobytes()], pa.binary())], ["cell", "blob"])
