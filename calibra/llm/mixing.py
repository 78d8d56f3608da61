"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks. The j-th block of a source whose target weight is the
share w of all weights is released at floor(j/w) and due at ceil((j+1)/w), computed in whole
numbers from the exact weights; each slot goes to the released block that is due first. Every
block is so placed between its release and its deadline: after any number of slots each source
that has blocks left is less than one block away from its share. Slots of a source that has
ended stay empty. The slots of all blocks are a small table of one number a block; where each
document goes follows from its number in its source by a join with that table.

All steps on the documents are DataFrame functions. Numbers within a source come from hash
buckets of bounded size, so a source with most of the rows is spread over all tasks. The
schedule is made on the driver, one step a block; blocks grow with the table beyond MOST_BLOCKS
of them, so that it stays bounded.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a rounded cycle (more if there are many sources), documents of a block, sources at most.
SLOTS, BLOCK, MOST_SOURCES = 1_000, 16, 100_000
#: Blocks of the schedule at most (and one a source); larger tables have larger blocks.
MOST_BLOCKS = 1 << 21
#: Rows that a bucket of documents should have.
BUCKET_ROWS = 65_536
#: Blocks of a row of the table of slots.
CHUNK = 1_024


def slots_of_weights(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Slots of each source: largest remainders, at least one for a positive weight.

    The mix itself doesn't round: it takes its weights exactly."""
    positive = {s: w for s, w in weights.items() if w > 0}
    slots = max(slots, 4 * len(positive))
    total = sum(positive.values())
    exact = {s: w / total * slots for s, w in positive.items()}
    given = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(positive, key=lambda s: (given[s] - exact[s], s))
    at = 0
    while sum(given.values()) < slots:
        given[by_rest[at % len(by_rest)]] += 1
        at += 1
    while sum(given.values()) > slots:
        given[max(given, key=lambda s: (given[s] - exact[s], given[s], s))] -= 1
    return given


def pfair_slots(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, array]:
    """Slots of the blocks of each source of positive weight, by earliest deadline first among
    released blocks. Weights count exactly, blocks is how many blocks each source has."""
    names = sorted(s for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0)
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    share, total = [int(exact[s] * scale) for s in names], sum(int(w * scale) for w in exact.values())
    left, out = [blocks[s] for s in names], [array("q") for _ in names]
    if any(-(-n * total // w) >> 57 for n, w in zip(left, share)):
        raise ValueError("a weight is too small: its slots don't fit in a long")
    waiting = [(0, i) for i in range(len(names))]
    ready: list[tuple[int, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[i]) + 1) * total // share[i]), i))
        _, i = heapq.heappop(ready)
        out[i].append(t)
        if len(out[i]) < left[i]:
            heapq.heappush(waiting, (len(out[i]) * total // share[i], i))
        t += 1
    return dict(zip(names, out))


def pfair_cycle(given: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block of the cycle, slot) of a cycle in which each source has its weight in blocks."""
    return sorted(((s, j, t) for s, slots in pfair_slots(given, given).items() for j, t in enumerate(slots)), key=lambda x: x[2])


def source_name() -> Column:
    """Source of a row; null counts as the empty name."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def numbered_in_source(docs: DataFrame, columns: list[str], n_rows: int) -> DataFrame:
    """(row, src, number) of each row of docs: a struct of these columns, its source, its number
    from 0 within the source in the order of the MD5 of doc_id; a bucket has the ids whose
    digests begin alike. Rows without doc_id are spread by their place in the input."""
    digits = max(2, math.ceil(math.log(max(1, n_rows / BUCKET_ROWS), 16)))
    hash_ = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.monotonically_increasing_id())))
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), source_name().alias("src"), hash_.alias("hash")).withColumn("bucket", F.substring("hash", 1, digits))
    counts = keyed.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("src", "bucket", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("hash", "id"))
    return keyed.withColumn("rank", rank).join(offsets, ["src", "bucket"]).select("row", "src", (F.col("before") + F.col("rank") - 1).alias("number"))


def placed(docs: DataFrame, columns: list[str], weights: dict[str, float] | None = None, block: int = BLOCK, power: float = 0.5) -> DataFrame:
    """(row, src, number, block, slot, position) of each row of docs, position ascending in the mix.

    weights: target weight of each source; by default its row count to the given power. A
    source without weight follows after all others, in the order of its numbers. block is the
    number of documents of a block, more in a table of over block * MOST_BLOCKS rows."""
    sizes = {r.src: r.n for r in docs.groupBy(source_name().alias("src")).agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    n_rows = sum(sizes.values())
    block = max(block, -(-n_rows // MOST_BLOCKS))
    targets = {s: float(weights.get(s, 0.0)) for s in sizes} if weights is not None else {s: n**power for s, n in sizes.items()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    slots = pfair_slots(targets, blocks) if any(w > 0 for w in targets.values()) else {}
    # sources without weight follow one after the other
    last = max((x[-1] + 1 for x in slots.values()), default=0)
    for s in sorted(blocks.keys() - slots.keys()):
        slots[s] = array("q", range(last, last + blocks[s]))
        last += blocks[s]
    rows = numbered_in_source(docs, columns, n_rows).withColumn("block", F.floor(F.col("number") / block).cast("long")).withColumn("chunk", F.floor(F.col("block") / CHUNK).cast("long"))
    # the table has MOST_BLOCKS numbers and one a source at most
    rows = rows.join(F.broadcast(_slot_table(docs, slots)), ["src", "chunk"], "left")
    slot = F.element_at("slots", (F.col("block") % CHUNK + 1).cast("int"))
    return rows.withColumn("slot", slot).select("row", "src", F.col("number").cast("long").alias("number"), "block", "slot", (F.col("slot") * block + F.col("number") % block).alias("position"))


def with_mix_position(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, name: str = "mix_position") -> DataFrame:
    """docs with their place in the mix in a last column of that name, which replaces one that docs has.

    Rows are neither dropped nor repeated; a null source counts as the source with the empty
    name, rows may repeat a doc_id or have none. Columns may have any names; an empty table
    gives an empty result."""
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    return placed(docs, columns, weights, block).select("row.*", F.col("position").alias(name))


def _slot_table(docs: DataFrame, slots: dict[str, array]) -> DataFrame:
    """(src, chunk, slots): the slots of CHUNK blocks in a row."""
    cuts = [(s, at) for s, x in slots.items() for at in range(0, len(x), CHUNK)]
    if not cuts:
        return docs.sparkSession.createDataFrame([], "src string, chunk long, slots array<long>")
    lengths = [min(CHUNK, len(slots[s]) - at) for s, at in cuts]
    values = np.concatenate([np.frombuffer(x, np.int64) for x in slots.values() if len(x)])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    columns = [pa.array([s for s, _ in cuts], pa.string()), pa.array([at // CHUNK for _, at in cuts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
    return docs.sparkSession.createDataFrame(pa.table(columns, names=["src", "chunk", "slots"]))


def mix_plan(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, source_number, block, slot, mix_position) of each row; no row is dropped or repeated.

    A null source counts as the source with the empty name. Rows that repeat a doc_id are
    placed one after the other. Other columns are ignored; an empty table gives an empty plan."""
    return placed(docs, ["doc_id"], weights, block).select("row.doc_id", F.col("src").alias("source"), F.col("number").alias("source_number"), "block", "slot", F.col("position").alias("mix_position"))


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """docs in the order of the mix; its columns stay as they are, whatever their names."""
    return placed(docs, docs.columns, weights, block).orderBy("position").select("row.*")
