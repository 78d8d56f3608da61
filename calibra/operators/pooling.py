"""Counts pooled over a tree of cells, without a group that holds a region.

A node's count model sees only the node's own windows, so nodes are scored in shards of nodes,
window by window, with the models of one shard in memory. What couples the nodes of a window,
the evidence going up and the weights going down, is a join on (parent, window) for each level
of the tree; both are rows of numbers. At last each cell mixes the predictions of the nodes on
its path, one join on (node, window). The same rules as models.pool.TreePool, whose nodes are
names where a parent is the name without its last digit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.special import gammaln
from calibra.models.count import VERSION, CountBank, CountParams, conservative, randomised
from calibra.operators.shared import written

#: Pooled rows carry their own version; children of a node; cells of a stream where nothing happens.
POOLED, CHILDREN, EMPTY = 100 + VERSION, 4, ""
_SCORED = "stream_id string, node string, win_start long, score double, known boolean, leaf boolean, missing int, asks array<struct<n:long,size:int,below:double,point:double>>"


def _log_sum(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b))."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def node_windows(windows: DataFrame, coarsest: int) -> DataFrame:
    """(stream_id, node, win_start, y, leaf, missing, asks): counts of all nodes of the cells' paths.

    asks: the different (count, name length) of the cells below, for which a prediction of the
    node at the cell's share is needed; missing: children of the node that no cell lies in. The
    empty region is a node of its own that counts nothing."""
    size = F.length("cell")
    path = F.transform(F.sequence(F.lit(coarsest + 1), size), lambda k: F.substring("cell", F.lit(1), k))
    rows = windows.select("stream_id", "cell", "win_start", "n", F.explode(path).alias("node"))
    leaf = F.col("node") == F.col("cell")
    child = F.when(~leaf, F.substring("cell", F.length("node") + 1, F.lit(1)))
    found = rows.groupBy("stream_id", "node", "win_start").agg(F.sum("n").alias("y"), F.max(leaf).alias("leaf"), F.collect_set(child).alias("children"), F.collect_set(F.struct("n", size.alias("size"))).alias("asks"))
    nodes = found.select("stream_id", "node", "win_start", "y", "leaf", F.when(F.col("leaf"), 0).otherwise(CHILDREN - F.size("children")).alias("missing"), "asks")
    none = F.array().cast("array<struct<n:bigint,size:int>>")
    empty = windows.select("stream_id", "win_start").distinct().select("stream_id", F.lit(EMPTY).alias("node"), "win_start", F.lit(0).cast("long").alias("y"), F.lit(False).alias("leaf"), F.lit(0).alias("missing"), none.alias("asks"))
    return nodes.unionByName(empty)


class _Shard:
    """Models of the nodes of one shard, advanced window by window."""

    def __init__(self, names: list[str], width: int, par: CountParams) -> None:
        self.names, self.width, self.par = names, width, par
        self.bank, self.score, self.last = CountBank(len(names), par), np.zeros(len(names)), None
        self.log_area = np.log(float(CHILDREN)) * -np.array([len(x) for x in names], float)

    def step(self, ts: int, y: np.ndarray, asks: list) -> tuple[np.ndarray, list[list[dict]]]:
        """(evidence of each node with this window, its answers); unknown nodes have nan answers."""
        seconds = self.width if self.last is None else ts - self.last
        first = self.last is None
        self.last = ts
        self.bank.discount(seconds)
        e = self.bank.exposure(ts)
        pmf, _ = self.bank.predictive(y, e)
        keep = np.exp(-seconds / self.par.memory)
        own = np.log(np.maximum((np.exp(self.bank.logw) * pmf).sum(1), 1e-300))
        gain = own + np.where(np.array([x == EMPTY for x in self.names]), 0.0, gammaln(y + 1.0) - y * self.log_area)
        self.score = keep * self.score + (0.0 if first else gain)
        of = np.repeat(np.arange(len(asks)), [len(a) for a in asks])
        n = np.array([q["n"] for a in asks for q in a], np.int64)
        size = np.array([q["size"] for a in asks for q in a], np.int64)
        answers: list[list[dict]] = [[] for _ in asks]
        if len(of):
            part = CountBank(len(of), self.par)
            part.a, part.b, part.logw = self.bank.a[of], self.bank.b[of], self.bank.logw[of]
            share = np.exp(-np.log(float(CHILDREN)) * size - self.log_area[of])
            point, below = part.predictive(n, e[of] * share)
            w = np.exp(part.logw)
            for i, *values in zip(of.tolist(), n.tolist(), size.tolist(), (w * below).sum(1).tolist(), (w * point).sum(1).tolist()):
                answers[i].append(dict(zip(("n", "size", "below", "point"), values)))
        self.bank.learn(ts, y, e, np.where(first, 1.0, pmf))
        return self.score, answers


def node_scores(nodes: DataFrame, width: int, nodes_a_shard: int, n_nodes: int, par: CountParams) -> DataFrame:
    """Evidence and answers of each node and window.

    Rows of a shard come sorted by window, so a task holds one window and the models of one
    shard, however long the history is."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        shard: _Shard | None = None
        key = None

        def closed() -> pd.DataFrame:
            nonlocal shard, key
            rows = held[0] if len(held) == 1 else pd.concat(held)
            names, now = rows["node"].tolist(), (rows["stream_id"].iloc[0], rows["_shard"].iloc[0])
            if now != key:
                shard, key = _Shard(names, width, par), now
            if names != shard.names:
                raise ValueError("each window must have a row of each node")
            known, ts = shard.last is not None, int(rows["win_start"].iloc[0])
            score, answers = shard.step(ts, rows["y"].to_numpy(np.int64), rows["asks"].tolist())
            return pd.DataFrame({"stream_id": rows["stream_id"], "node": names, "win_start": ts, "score": score, "known": known, "leaf": rows["leaf"], "missing": rows["missing"], "asks": answers})

        for batch in batches:
            cuts = np.flatnonzero((batch[["stream_id", "_shard", "win_start"]] != batch[["stream_id", "_shard", "win_start"]].shift()).any(axis=1).to_numpy())
            done = []
            for i, j in zip(cuts, [*cuts[1:], len(batch)]):
                part = batch.iloc[i:j]
                if held and (part["stream_id"].iloc[0], part["_shard"].iloc[0], part["win_start"].iloc[0]) != (held[0]["stream_id"].iloc[0], held[0]["_shard"].iloc[0], held[0]["win_start"].iloc[0]):
                    done.append(closed())
                    held.clear()
                held.append(part)
            if done:
                yield pd.concat(done)
        if held:
            yield closed()

    shard = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-n_nodes // nodes_a_shard)))).cast("int")
    keyed = nodes.withColumn("_shard", shard).repartition("stream_id", "_shard").sortWithinPartitions("stream_id", "_shard", "win_start", "node")
    return keyed.mapInPandas(run, _SCORED)


def tree_weights(scores: DataFrame, rho: float = 0.1) -> DataFrame:
    """scores (stream_id, node, win_start, score, leaf, missing, empty_score) with weight: the
    probability that the node is the block that a cell below it belongs to.

    Up, level by level: Z is the score of a leaf; of another node the log-sum of being one block
    (rho) and of being split into its children, missing ones at the empty region's score. Down:
    a node is reached if no node above it is a block."""
    keys = ["stream_id", "node", "win_start"]
    low, high = scores.agg(F.min(F.length("node")), F.max(F.length("node"))).first()
    if low is None:
        return scores.withColumn("weight", F.lit(None).cast("double"))
    z, levels = None, {}
    for size in range(high, low - 1, -1):
        level = scores.where(F.length("node") == size)
        if z is None:
            level = level.withColumn("split", F.lit(0.0))
        else:
            sums = z.groupBy("stream_id", F.substring("node", 1, size).alias("node"), "win_start").agg(F.sum("z").alias("split"))
            level = level.join(sums, keys, "left").withColumn("split", F.coalesce("split", F.lit(0.0)))
        block = F.lit(float(np.log(rho))) + F.col("score")
        split = F.lit(float(np.log1p(-rho))) + F.col("split") + F.col("missing") * F.col("empty_score")
        z = written(level.withColumn("z", F.when(F.col("leaf"), F.col("score")).otherwise(_log_sum(block, split))).drop("split"))
        levels[size] = z.withColumn("as_block", F.when(F.col("leaf"), 1.0).otherwise(F.exp(F.least(F.lit(0.0), F.lit(float(np.log(rho))) + F.col("score") - F.col("z")))))
    out = above = None
    for size in range(low, high + 1):
        level = levels[size]
        if above is None:
            level = level.withColumn("reach", F.lit(1.0))
        else:
            over = above.select("stream_id", F.col("node").alias("_above"), "win_start", (F.col("reach") * (1 - F.col("as_block"))).alias("reach"))
            level = level.withColumn("_above", F.substring("node", 1, size - 1)).join(over, ["stream_id", "_above", "win_start"], "left").drop("_above").withColumn("reach", F.coalesce("reach", F.lit(1.0)))
        above = level
        rows = level.withColumn("weight", F.col("reach") * F.col("as_block")).select(*scores.columns, "weight")
        out = rows if out is None else out.unionByName(rows)
    return out


def _drawn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Quantiles of rows (stream_id, cell, bin_start, number, below, upto), by the cell's seed and the window's number."""
    for rows in batches:
        seeds = np.array([zlib.crc32(f"{s}|{c}".encode()) for s, c in zip(rows["stream_id"], rows["cell"])], np.uint64)
        lo, hi = rows["below"].to_numpy(), rows["upto"].to_numpy()
        yield rows[["stream_id", "cell", "bin_start"]].assign(q_value=randomised(lo, hi, seeds, rows["number"].to_numpy()), q_detect=conservative(lo, hi), model_version=POOLED)


def score_pooled(windows: DataFrame, width: int, coarsest: int = 1, rho: float = 0.1, par: CountParams = CountParams(), nodes_a_shard: int = 256) -> DataFrame:
    """Quantiles of count windows (stream_id, cell, win_start, n) of cells, pooled over their tree.

    windows has a row for each cell and window of its stream, quiet ones included; null counts
    as zero. The first window of a stream has 0.5. Node rows are written to the shared folder
    once, and each level's log-sums after it."""
    windows = windows.select("stream_id", "cell", "win_start", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    keys = ["stream_id", "node", "win_start"]
    nodes = written(node_windows(windows, coarsest))
    n_nodes = nodes.agg(F.approx_count_distinct("node")).first()[0]
    scored = written(node_scores(nodes, width, nodes_a_shard, n_nodes, par))
    empty = scored.where(F.col("node") == EMPTY).select("stream_id", "win_start", F.col("score").alias("empty_score"))
    tree = scored.where(F.col("node") != EMPTY).select(*keys, "score", "leaf", "missing").join(empty, ["stream_id", "win_start"])
    weights = tree_weights(tree, rho).select(*keys, "weight")
    answers = scored.where("known").select(*keys, "asks").join(weights, keys)
    path = F.transform(F.sequence(F.lit(coarsest + 1), F.length("cell")), lambda k: F.substring("cell", F.lit(1), k))
    asked = windows.withColumn("node", F.explode(path)).join(answers, keys, "left")
    answer = F.filter("asks", lambda a: (a["n"] == F.col("n")) & (a["size"] == F.length("cell")))[0]
    mixed = asked.groupBy("stream_id", "cell", "win_start").agg(F.sum("weight").alias("all"), F.sum(F.col("weight") * answer["below"]).alias("below"), F.sum(F.col("weight") * answer["point"]).alias("point"))
    below, upto = F.coalesce(F.col("below") / F.col("all"), F.lit(0.5)), F.coalesce((F.col("below") + F.col("point")) / F.col("all"), F.lit(0.5))
    clipped = [F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in (below, upto)]
    begin = windows.groupBy("stream_id").agg(F.min("win_start").alias("_begin"))
    number = (F.floor((F.col("win_start") - F.col("_begin")) / width) + 1).cast("long")
    rows = mixed.join(begin, "stream_id").select("stream_id", "cell", F.col("win_start").alias("bin_start"), number.alias("number"), clipped[0].alias("below"), clipped[1].alias("upto"))
    return rows.mapInPandas(_drawn, "stream_id string, cell string, bin_start long, q_value double, q_detect double, model_version int")
