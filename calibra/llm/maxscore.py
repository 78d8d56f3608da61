"""Exact top-k search by MaxScore over integer vectors.

Each component of a vector is a term; its contribution to a query's score lies between bounds
known for the shard. Terms are ordered by the width of these bounds. The widest, whose rest
cannot lift a vector over the k-th best score known, are essential: their postings (columns)
are traversed for all vectors of the shard. The others are probed term group by term group
for the vectors that are still competitive. Shards and query blocks have bounded sizes and
every query block meets every shard; the top k of all shards are merged by a window. Blocks
and shards are large, since a vector is sent once a block and a query once a shard: with 10^8
vectors of 64 components there are about 60 blocks.

Sums are taken in doubles (a matrix product) while they are whole numbers below 2^53, else
in longs; a table whose inner products could leave the range of a long is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import cut_lineage
from calibra.llm.pivot_dedup import matrix_of

#: Components of all vectors of a shard and of all queries of a block; vectors of a shard that is worth a task.
SHARD, QUERY_BLOCK, LEAST_SHARD = 1 << 22, 1 << 20, 2_048
#: Terms probed at once, and vectors scored in full for the first threshold.
GROUP, FIRST = 8, 256
_LARGEST = float(1 << 53)


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q, width, most) with q the components floor(scale * x) as packed longs and most their
    greatest absolute value, in doubles; unusable vectors are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = matrix_of(batch.column("embedding"))
            whole = [np.floor(scale * x) for x in vectors]
            most = [float(np.abs(x).max()) for x in whole]
            packed = [np.clip(x, -_LARGEST, _LARGEST).astype(np.int64).tobytes() for x in whole]
            yield pa.record_batch([batch.column("vec_id").take(pa.array(rows)), pa.array(packed, pa.binary()), pa.array([len(x) for x in whole], pa.int64()), pa.array(most, pa.float64())], names=["vec_id", "q", "width", "most"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, q binary, width long, most double")


def max_score(query: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores) of all vectors of a shard that may be among the k best of a query.

    columns has a row for each term; low and high are its least and greatest value; skip is
    the number of the query's own vector, or -1."""
    n = columns.shape[1]
    least, most = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    order = np.argsort(-(most - least), kind="stable")
    rest_most = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
    rest_least = np.concatenate([np.cumsum(least[order][::-1])[::-1], [0]])
    first = query @ columns[:, : min(n, FIRST)]
    if 0 <= skip < len(first):
        first = np.delete(first, skip)
    floor = int(np.partition(first, len(first) - k)[len(first) - k]) if len(first) >= k else -(1 << 62)
    # essential terms: with the others alone no vector would reach the floor
    done = int(np.argmax(rest_most - rest_least < max(0, floor - int(rest_least[0])))) if floor > rest_least[0] else len(order)
    done = max(1, done)
    score = query[order[:done]] @ columns[order[:done]]
    alive = np.arange(n)
    if skip >= 0:
        alive, score = np.delete(alive, skip), np.delete(score, skip)
    while True:
        if len(score) >= k:
            floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]) + int(rest_least[done]))
        keep = score + rest_most[done] >= floor
        alive, score = alive[keep], score[keep]
        if done >= len(order):
            return alive, score
        terms = order[done : done + GROUP]
        score = score + query[terms] @ columns[np.ix_(terms, alive)]
        done += len(terms)


def _top_of_cell(k: int, width: int, exact: bool):
    kind = np.float64 if exact else np.int64

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, asks = rows[~rows["asks"]].sort_values(["nameless", "id", "row"]), rows[rows["asks"]]
        out: dict[str, list] = {"query_id": [], "query_row": [], "nameless": [], "id": [], "row": [], "score": []}
        # a vector of fewer components has zeros in the others
        nameless, ids, numbers = (held[c].to_numpy(np.int64) for c in ("nameless", "id", "row"))
        columns = np.zeros((width, len(held)), kind)
        for i, q in enumerate(held["q"]):
            columns[: len(q) // 8, i] = np.frombuffer(q, np.int64)
        if len(held):
            low, high = columns.min(1), columns.max(1)
            place = {r: i for i, r in enumerate(numbers.tolist())}
            for qid, row, q in zip(asks["id"].tolist(), asks["row"].tolist(), asks["q"]):
                query = np.zeros(width, kind)
                query[: len(q) // 8] = np.frombuffer(q, np.int64)
                found, score = max_score(query, columns, low, high, k, place.get(row, -1))
                best = np.lexsort((found, -score))[:k]  # held is in the order of ids
                out["query_id"] += [qid] * len(best)
                out["query_row"] += [row] * len(best)
                for name, of in (("nameless", nameless), ("id", ids), ("row", numbers)):
                    out[name] += of[found[best]].tolist()
                out["score"] += score[best].astype(np.int64).tolist()
        return pd.DataFrame(out).astype("int64")

    return run


def exact_top_k(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query.

    Queries are the vectors whose vec_id is divisible by every, candidates all rows but the
    query's own; ties go to the smaller vec_id. Vectors that are null, empty or hold null or
    non-finite components take no part. Rows that repeat a vec_id are candidates and queries of
    their own; a row without vec_id is a candidate, last among ties. A vector of fewer
    components counts as zero in the others. Other columns are ignored; an empty table gives an
    empty result. Components over 2^53 / scale, or sums that a long can't hold, are an error."""
    vectors = cut_lineage(quantised(embeddings, scale).withColumn("row", F.monotonically_increasing_id()))
    n, width, most, asked = vectors.agg(F.count("*"), F.max("width"), F.max("most"), F.count_if(F.col("vec_id") % every == 0)).first()
    width, most = width or 1, most or 0.0
    if most > _LARGEST or most * most * width >= float(1 << 62):
        raise ValueError("components too large: inner products don't fit in a long")
    tasks = embeddings.sparkSession.sparkContext.defaultParallelism * 2
    shards = max(1, -(-n * width // SHARD), min(tasks, n // LEAST_SHARD))
    blocks = max(1, -(-asked * width // QUERY_BLOCK))
    shard, block = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    named = vectors.select("row", "q", F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().cast("long").alias("nameless"), F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("asked"))
    held = named.select("id", "nameless", "row", "q", F.lit(False).alias("asks"), shard.alias("shard"), number(blocks).alias("block"))
    asks = named.where("asked").select("id", "nameless", "row", "q", F.lit(True).alias("asks"), number(shards).alias("shard"), block.alias("block"))
    tops = held.union(asks).groupBy("shard", "block").applyInPandas(_top_of_cell(k, width, most * most * width < _LARGEST), "query_id long, query_row long, nameless long, id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "nameless", "id", "row")
    best = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("nameless") == 0, F.col("id")).alias("vec_id"), "score")
