"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample. Each different vector is described
by its nearest pivots in order. Two vectors are candidates if they share two pivots whose
positions (from 0) sum to at most `span` in both orders; candidates are verified by their
cosine in double precision. The span follows the pivots in use: it is the least one that finds
RECALL of pairs at a cosine of exactly 0.9, planted beside sampled vectors and met among them.
Where that takes more than SPAN, half of the pivots are used (few dimensions, where a cell of
many pivots is smaller than the threshold's angle). The index has an inverted list for each
pivot, split by buckets of the second pivot so that a list has about LENGTH vectors. A pair
that meets in several lists counts in the one of its first shared pair of pivots only. Each
dimension has pivots and lists of its own.

Equal vectors are one entry with a count. Lists over a bound are split into blocks that meet
pair by pair, so no task holds an unbounded list. Tasks return sums of links for each vector
and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import UnionFind, cut_lineage, ranges, run_starts
from calibra.llm.components import connected_components

#: Vectors sampled for pivots (64 of a dimension at least), pivots of a dimension at most,
#: vectors that a list should have, vectors of a block.
SAMPLE, MOST_PIVOTS, LENGTH, BLOCK = 8_192, 4_096, 512, 2_048
#: Share of pairs at the threshold that the order of pivots must find, largest span before the
#: pivots are halved, positions of an order that are looked at, pairs tried.
RECALL, SPAN, POSITIONS, TRIED = 0.975, 13, 24, 2_000
THRESHOLD = 0.9


def matrix_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers with a usable vector, their components as doubles); no null or non-finite
    component."""
    rows, dims = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                rows.append(i)
                dims.append(x)
    return np.array(rows, np.int64), dims


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec_key, unit) of each row; key and unit (doubles) are null for an unusable vector.

    vec_key is a hash of the components, equal for equal vectors (0.0 and -0.0 are equal)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys: list[int | None] = [None] * batch.num_rows
            units: list[bytes | None] = [None] * batch.num_rows
            for i, x in zip(*matrix_of(batch.column("embedding"))):
                with np.errstate(over="ignore"):
                    norm = math.sqrt(float(x @ x))
                unit = x
                if not 1e-140 < norm < 1e140 and x.any():  # squares leave the range of a double
                    unit = x / np.abs(x).max()
                    norm = math.sqrt(float(unit @ unit))
                if norm > 0:
                    keys[i] = int(np.uint64(xxhash.xxh3_64_intdigest((x + 0.0).tobytes())).astype(np.int64))
                    units[i] = (unit / norm).tobytes()
            yield pa.record_batch([batch.column("vec_id"), pa.array(keys, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "vec_key", "unit"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vec_key long, unit binary")


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the sampled vectors, without near duplicates among them where possible."""
    kept: list[np.ndarray] = []
    rest = sample
    while len(rest) and len(kept) < n:
        kept.append(rest[0].copy())  # a view would keep the whole array
        rest = rest[1:][rest[1:] @ rest[0] < THRESHOLD]
    return np.array(kept)


def nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the m nearest pivots of each row, the nearest first."""
    return np.concatenate([np.argsort(-(x[i : i + 1024] @ pivots.T), axis=1, kind="stable")[:, :m] for i in range(0, len(x), 1024)])


def _places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of each pivot of order a in order b, row by row; far behind where b lacks it."""
    same = a[:, :, None] == b[:, None, :]
    return np.where(same.any(2), same.argmax(2), 1 << 10)


def _pairs_within(m: int, span: int) -> list[tuple[int, int]]:
    """Pairs of positions below m that sum to at most span."""
    return [(i, j) for i in range(m) for j in range(i + 1, m) if i + j <= span]


def needed_span(x: np.ndarray, y: np.ndarray, pivots: np.ndarray, share: float = RECALL) -> int:
    """Least span by which the given share of the pairs (x[i], y[i]) have two pivots in common."""
    m = min(POSITIONS, len(pivots))
    spans = []
    for at in range(0, len(x), 500):
        there = _places(nearest(x[at : at + 500], pivots, m), nearest(y[at : at + 500], pivots, m))
        best = np.full(len(there), 2 * m)
        for i, j in _pairs_within(m, 2 * m):
            best = np.minimum(best, np.maximum(i + j, there[:, i] + there[:, j]))
        spans.append(best)
    return int(np.quantile(np.concatenate(spans), share, method="higher"))


def pairs_at_threshold(sample: np.ndarray, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors at the threshold's cosine: partners planted in any direction, and, where
    the sample has at least 100, pairs of its own just above it."""
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))[:TRIED]]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    out = [(x, THRESHOLD * x + math.sqrt(1 - THRESHOLD**2) * away / np.where(size > 0, size, 1))]
    i, j = np.nonzero(np.triu((x @ x.T >= THRESHOLD) & (x @ x.T < THRESHOLD + 0.02), 1))
    if len(i) >= 100:
        some = rng.permutation(len(i))[:TRIED]
        out.append((x[i[some]], x[j[some]]))
    return out


def fitted_pivots(sample: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(pivots, span): at most n pivots of the sample, so few that the span is SPAN at most."""
    pivots = choose_pivots(sample, n)
    own = {p.tobytes() for p in pivots}
    rest = np.array([v for v in sample if v.tobytes() not in own]).reshape(-1, sample.shape[1])
    pairs = pairs_at_threshold(rest if len(rest) >= 64 else sample)
    while True:
        span = max(needed_span(x, y, pivots) for x, y in pairs)
        if span <= SPAN or len(pivots) <= 64:
            return pivots, max(5, span)
        pivots = pivots[: len(pivots) // 2]


def _list_of(first: np.ndarray, second: np.ndarray, buckets: int, dim: int) -> np.ndarray:
    """Number of the list of two pivots, the lesser one first."""
    return (first.astype(np.int64) + dim * MOST_PIVOTS) * MOST_PIVOTS + second % buckets


def _described(index: dict[int, tuple[int, np.ndarray, int, int]]):
    """Adds to each vector its nearest pivots in order and its lists.

    index: number, pivots, span and buckets of each width of a vector in bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                rows = batch.take(pa.array(np.flatnonzero(widths == width)))
                dim, pivots, span, buckets = index[width]
                x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(rows.num_rows, -1)
                m = min(span + 1, len(pivots))
                near = nearest(x, pivots, m)
                pairs = _pairs_within(m, span) or [(0, 0)]
                lists = np.stack([_list_of(np.minimum(near[:, i], near[:, j]), np.maximum(near[:, i], near[:, j]), buckets, dim) for i, j in pairs], axis=1)
                yield pa.record_batch(
                    [rows.column("node"), rows.column("copies"), rows.column("unit"), pa.array(list(near.astype(np.int16)), pa.list_(pa.int16())), pa.array([np.unique(x) for x in lists], pa.list_(pa.int64())), pa.array(np.full(len(x), span, np.int32)), pa.array(np.full(len(x), buckets, np.int32))],
                    names=["node", "copies", "unit", "near", "lists", "span", "buckets"],
                )

    return run


def _first_list(a: np.ndarray, b: np.ndarray, span: int, buckets: int, dim: int) -> np.ndarray:
    """List of the first pair of pivots that both orders list, row by row; -1 where there is none."""
    m = a.shape[1]
    if m == 1:
        return np.where(a[:, 0] == b[:, 0], _list_of(a[:, 0], b[:, 0], buckets, dim), -1)
    there = _places(a, b).astype(np.int32)
    none = np.int32(MOST_PIVOTS * MOST_PIVOTS)
    first = np.full(len(a), none)
    a = a.astype(np.int32)
    for i, j in _pairs_within(m, span):
        code = np.minimum(a[:, i], a[:, j]) * MOST_PIVOTS + np.maximum(a[:, i], a[:, j])
        first = np.minimum(first, np.where(there[:, i] + there[:, j] <= span, code, none))
    return np.where(first < none, _list_of(first // MOST_PIVOTS, first % MOST_PIVOTS, buckets, dim), -1)


def _close_pairs(unit: np.ndarray, side: np.ndarray, one: np.ndarray, two: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list, or of two of its blocks, whose cosine reaches the threshold."""
    lengths = np.diff(cuts)
    small = (lengths <= 64) & (one[cuts[:-1]] == two[cuts[:-1]])
    found = []
    if small.any():
        begin = ranges(cuts[:-1][small], lengths[small])
        after = np.repeat(cuts[1:][small], lengths[small]) - 1 - begin
        steps = np.concatenate([[0], np.cumsum(after)])
        for lo in range(0, int(steps[-1]), 1 << 18):
            i, j = np.searchsorted(steps, [lo, lo + (1 << 18)])
            a = np.repeat(begin[i:j], after[i:j])
            b = ranges(begin[i:j] + 1, after[i:j])
            good = np.einsum("ij,ij->i", unit[a], unit[b]) >= THRESHOLD
            found.append((a[good], b[good]))
    for lo, hi in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist()):
        left, right = lo + np.flatnonzero(side[lo:hi] == one[lo]), lo + np.flatnonzero(side[lo:hi] == two[lo])
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            a, b = np.nonzero(unit[i] @ unit[right].T >= THRESHOLD)
            a, b = i[a], right[b]
            fresh = (a < b) if one[lo] == two[lo] else np.ones(len(a), bool)
            found.append((a[fresh], b[fresh]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _links_of(rows: pa.Table) -> pa.RecordBatch:
    """Sums of links and spanning links of whole lists of one dimension; a pair counts in its first list only."""
    node, copies, key, side, one, two = (rows.column(c).to_numpy() for c in ("node", "copies", "list", "block", "one", "two"))
    unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(node), -1)
    near, span, buckets = np.array(rows.column("near").to_pylist(), np.int16), rows.column("span")[0].as_py(), rows.column("buckets")[0].as_py()
    whole = np.stack([key, one, two], axis=1)
    cuts = run_starts(np.cumsum(np.concatenate([[True], (whole[1:] != whole[:-1]).any(1)])))
    a, b = _close_pairs(unit, side, one, two, cuts)
    kept_a, kept_b = [], []
    for at in range(0, len(a), 1 << 17):
        i, j = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
        good = _first_list(near[i], near[j], span, buckets, int(key[0] // MOST_PIVOTS**2)) == key[i]
        kept_a.append(i[good])
        kept_b.append(j[good])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept_a, kept_b))
    ids, number = np.unique(node, return_inverse=True)
    links = np.bincount(number[a], copies[b], len(ids)) + np.bincount(number[b], copies[a], len(ids))
    sets = UnionFind(len(ids))
    for u, v in zip(number[a].tolist(), number[b].tolist()):
        sets.union(u, v)
    some = np.flatnonzero(links)
    return pa.record_batch([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[[sets.find(i) for i in some.tolist()]] if len(some) else ids[:0])], names=["node", "links", "root"])


def _index_of(distinct: DataFrame) -> dict[int, tuple[int, np.ndarray, int, int]]:
    """Number, pivots, span and buckets of each width that more than one vector has."""
    sizes = {r.width: r.n for r in distinct.groupBy("width").agg(F.count("*").alias("n")).where("n > 1").orderBy("width").collect()}
    if not sizes:
        return {}
    roots = sum(math.sqrt(n) for n in sizes.values())
    wanted = {w: min(n, max(64, int(SAMPLE * math.sqrt(n) / roots))) for w, n in sizes.items()}
    # a share by hash that gives somewhat more than is wanted
    shares = distinct.sparkSession.createDataFrame([(w, int(min(1.0, (k + 6 * math.sqrt(k)) / sizes[w]) * (1 << 30))) for w, k in wanted.items()], "_width int, _share long")
    drawn = distinct.select("node", "unit", "width", F.xxhash64("node").alias("hash")).join(F.broadcast(shares), F.col("width") == F.col("_width")).where(F.pmod("hash", F.lit(1 << 30)) < F.col("_share"))
    picked: dict[int, list[tuple[int, int, bytes]]] = {}
    for r in drawn.select("width", "hash", "node", "unit").collect():
        picked.setdefault(r.width, []).append((r.hash % (1 << 30), r.node, bytes(r.unit)))
    index = {}
    for number, (w, n) in enumerate(sizes.items()):
        sample = np.frombuffer(b"".join(unit for *_, unit in sorted(picked[w])[: wanted[w]]), np.float64).reshape(-1, w // 8)
        pivots, span = fitted_pivots(sample, int(np.clip(4 * math.isqrt(n), 16, MOST_PIVOTS)))
        index[w] = (number, pivots, span, int(np.clip(-(-n * (span + 1) // (len(pivots) * LENGTH)), 1, MOST_PIVOTS)))
    return index


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of embeddings (vec_id, embedding).

    Vectors link at a cosine of 0.9 and more. A vector that is null, empty, zero or holds null or non-finite
    components links with nothing and is its own component. Vectors of different dimensions
    don't link; each dimension has an index of its own. Copies link with each other. Rows that repeat a vec_id are returned as often as they come, each
    counted as a vector of its own. A null vec_id takes part; kept is null where vec_id is."""
    vectors = cut_lineage(unit_vectors(embeddings))
    spark = embeddings.sparkSession
    usable = vectors.where("unit is not null")
    distinct = cut_lineage(usable.groupBy("vec_key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first(F.octet_length("unit")).alias("width")).withColumnRenamed("vec_key", "node"))
    index = _index_of(distinct)
    if index:
        entries = cut_lineage(distinct.where(F.col("width").isin(list(index))).select("node", "copies", "unit", "width").mapInArrow(_described(index), "node long, copies long, unit binary, near array<smallint>, lists array<long>, span int, buckets int"))
        listed = entries.select("node", F.explode("lists").alias("list"))
        lengths = listed.groupBy("list").agg(F.count("*").alias("length")).where("length > 1").withColumn("blocks", F.ceil(F.col("length") / BLOCK).cast("long"))
        placed = listed.join(lengths, "list").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        placed = placed.withColumn("other", other).select("node", "list", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
        held = placed.join(entries.select("node", "copies", "unit", "near", "span", "buckets"), "node")
        found = cut_lineage(_by_list(held))
    else:
        found = spark.createDataFrame([], "node long, links long, root long")
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.select("node", "least", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = nodes.join(ids, "component").select(F.col("node").alias("vec_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = vectors.select("vec_id", "vec_key").join(per_node, "vec_key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _by_list(held: DataFrame) -> DataFrame:
    """Links of all lists; a task walks its lists one after the other."""
    schema = "node long, links long, root long"

    def links_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = run_starts(rows.column("list").to_numpy() // MOST_PIVOTS**2)  # by dimension
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield _links_of(rows.slice(lo, hi - lo))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            if not rows.num_rows:
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("list", "one", "two")], axis=1)
            done = int(np.argmax((key == key[-1]).all(1)))
            rest = rows.slice(done)
            if done:
                yield from links_of(rows.slice(0, done))
        if rest is not None and rest.num_rows > 1:
            yield from links_of(rest)

    sorted_ = held.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two")
    return sorted_.select("node", "copies", "unit", "near", "span", "buckets", "list", "block", "one", "two").mapInArrow(run, schema)
