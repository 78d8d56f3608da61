"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are a bounded sample of rows labelled good; the unlabelled set is every text
outside the fold. Its statistics are written once, and each pass of the fit adds up sums of
fixed size in the tasks, so neither the risk, the bins, the class prior nor the calibration is
of a sample of it. The class prior is the least ratio, over score thresholds, of the share of
unlabelled texts above to the share of held-back positives above, with a margin for the sizes
(best-bin estimate), from halves that the first model has not seen. A logistic model on binned
text statistics minimises the non-negative unbiased risk: prior * positive loss + max(0,
unlabelled negative loss - prior * positives' negative loss), with a small decay. With the
logistic loss both branches are convex; Newton steps go down and stop at the edge where the
negative part would fall below zero. The density ratio of positives and all texts along the
model's margin, times the prior and made monotone, turns margins into probabilities. Labels of
bad texts are never used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, cut_lineage, texts_of
from calibra.llm.folds import in_fold, label_sample
from calibra.llm.shingles import shingle_sets, word_hashes

#: Labelled positives at most, steps of the optimiser, bins of a statistic, decay of the weights.
SAMPLE, STEPS, BINS, DECAY = 6_000, 25, 10, 1e-3
#: Cells in which statistics and margins are counted: cells a unit (of log1p of a statistic, of a margin), cells.
STAT_CELLS, MARGIN_CELLS = (512, 8_192), (64, 4_096)
THRESHOLD = 0.7

STATISTICS = (
    "log_chars", "upper", "lower", "digit", "space", "newline", "exclaim", "bar", "symbol", "stop", "comma", "other",
    "word_length", "distinct_words", "distinct_shingles", "distinct_lines", "line_words", "short_words", "bits",
)
_UPPER, _LOWER, _DIGIT, _SPACE, _NEWLINE, _EXCLAIM, _BAR, _SYMBOL, _STOP, _COMMA, _OTHER = range(11)


def _kinds() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = _UPPER if ch.isupper() else _LOWER if ch.isalpha() else _DIGIT if ch.isdigit() else _SPACE if ch.isspace() else _OTHER
    for chars, kind in (("\n\r", _NEWLINE), ("!", _EXCLAIM), ("|", _BAR), ("%$&#*@^~+=<>{}[]\\_", _SYMBOL), (".?", _STOP), (",;:", _COMMA)):
        for ch in chars:
            table[ord(ch)] = kind
    table[0x3000:] = _LOWER
    return table


def statistics(texts: list[str], kinds: np.ndarray) -> np.ndarray:
    """One row of STATISTICS a text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * 11 + kinds[code], minlength=len(texts) * 11).reshape(-1, 11)
    chars = np.maximum(sizes, 1)[:, None]
    out = np.zeros((len(texts), len(STATISTICS)))
    out[:, 0] = np.log1p(sizes)
    out[:, 1:12] = np.log1p(1000 * counts / chars)
    for i, (text, shingles) in enumerate(zip(texts, shingle_sets(texts, 4))):
        starts, words = word_hashes(np.frombuffer(text.encode(), np.uint8)) if text else (np.zeros(0), np.zeros(0))
        n = len(words)
        if not n:
            continue
        lines = text.split("\n")
        out[i, 12] = (sizes[i] - counts[i, _SPACE] - counts[i, _NEWLINE]) / n
        out[i, 13] = len(np.unique(words)) / n**0.8
        out[i, 14] = len(shingles) / max(1, n - 3)
        out[i, 15] = len(set(lines)) / len(lines)
        out[i, 16] = np.log1p(n / len(lines))
        gaps = np.diff(starts)
        out[i, 17] = float((gaps <= 4).mean()) if len(gaps) else 1.0
    classes = counts / chars
    out[:, 18] = -(classes * np.log2(np.maximum(classes, 1e-12))).sum(1)
    return out


def stat_cells(x: np.ndarray) -> np.ndarray:
    """Cell of each statistic (none is negative)."""
    per, n = STAT_CELLS
    return np.clip(np.rint(np.log1p(np.maximum(x, 0)) * per), 0, n - 1).astype(np.int64)


def margin_cells(z: np.ndarray) -> np.ndarray:
    per, n = MARGIN_CELLS
    return np.clip(np.floor(z * per) + n // 2, 0, n - 1).astype(np.int64)


def _cut_cells(counts: np.ndarray, parts: int) -> np.ndarray:
    """Cells at which counts are cut into parts of about one size."""
    total = np.cumsum(counts)
    return np.unique(np.searchsorted(total, total[-1] * np.arange(1, parts) / parts))


class BinnedLogistic:
    """Logistic model on one-hot quantile bins and standardised values.

    cells: counts of all texts in the cells of each statistic."""

    def __init__(self, cells: np.ndarray) -> None:
        self.n = int(cells[0].sum())
        bins = int(np.clip(self.n // 200, 2, BINS))
        at = np.expm1(np.arange(cells.shape[1]) / STAT_CELLS[0])
        self.edges = [np.expm1((_cut_cells(c, bins) + 0.5) / STAT_CELLS[0]) for c in cells]
        self.mean = cells @ at / self.n
        self.scale = np.sqrt(np.maximum(cells @ at**2 / self.n - self.mean**2, 0)) + 1e-9
        self.weights = np.zeros(1 + len(cells) + sum(len(e) + 1 for e in self.edges))

    def expand(self, x: np.ndarray) -> np.ndarray:
        cols = [np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -6, 6)]
        for c, edges in zip(x.T, self.edges):
            cols.append(np.eye(len(edges) + 1)[np.searchsorted(edges, c, "right")])
        return np.hstack(cols)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def calibrate(self, good: np.ndarray, any_: np.ndarray, prior: float) -> None:
        """Learn P(good | margin) = prior * density among positives / density among all, made monotone.

        good and any_ are counts of margins by cell."""
        cuts = _cut_cells(any_, int(np.clip(any_.sum() // 60, 4, 60)))
        edges = (cuts + 1 - MARGIN_CELLS[1] // 2) / MARGIN_CELLS[0]
        starts = np.concatenate([[0], cuts + 1])
        starts = starts[starts < len(any_)]
        at_p, at_u = np.add.reduceat(good, starts), np.add.reduceat(any_, starts)
        blocks: list[list[float]] = []
        for hits, all_ in zip(at_p / at_p.sum() * prior, at_u / at_u.sum()):
            blocks.append([hits, all_ + 1e-12, 1])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                hits, all_, k = blocks.pop()
                blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + all_, blocks[-1][2] + k]
        level = np.repeat([min(1.0, h / a) for h, a, _ in blocks], [int(k) for *_, k in blocks])
        self.edges_of_margin, self.level = edges[: len(level) - 1], level

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.margin(x)
        slope = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        edges = self.edges_of_margin
        middle = np.concatenate([edges[:1], (edges[1:] + edges[:-1]) / 2, edges[-1:]])
        return 0.98 * (np.interp(z, middle, self.level) if len(edges) else self.level[0]) + 0.02 * slope


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Summed = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]


def risk_sums(model: BinnedLogistic, weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What a batch of unlabelled statistics adds: rows, negative loss, its gradient and curvature."""

    def of(x: np.ndarray) -> np.ndarray:
        u = model.expand(x)
        z = u @ weights
        s = _sigmoid(z)
        return np.concatenate([[len(x), _softplus(z).sum()], u.T @ s, ((u * (s * (1 - s))[:, None]).T @ u).ravel()])

    return of


def fit_non_negative(model: BinnedLogistic, good: np.ndarray, unlabelled: Summed, prior: float, steps: int = STEPS) -> None:
    """Minimise the non-negative positive-unlabelled risk by Newton steps over all unlabelled texts."""
    p = model.expand(good)
    mean_p, k = p.mean(0), len(model.weights)

    def at(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Risk, its negative part, gradient and curvature where the negative part counts."""
        sums = unlabelled(risk_sums(model, w))
        n, loss = sums[0], sums[1] / sums[0]
        zp = p @ w
        negative = loss - prior * _softplus(zp).mean()
        risk = prior * _softplus(-zp).mean() + negative + DECAY / 2 * w @ w
        # softplus(-z) - softplus(z) = -z, so the positives' part of this branch is linear
        return risk, negative, sums[2 : 2 + k] / n - prior * mean_p + DECAY * w, sums[2 + k :].reshape(k, k) / n + DECAY * np.eye(k)

    w = model.weights
    risk, negative, slope, curve = at(w)
    share = 1.0
    for _ in range(steps):
        step = np.linalg.solve(curve, slope)
        if share == 1 and np.abs(step).max() < 1e-3:
            w = w - step  # what is left after it is of the order of its square
            break
        if share < 1 / 64:
            break
        new = at(w - share * step)
        if new[0] > risk + 1e-12 or (new[1] < 0 <= negative):
            share /= 2  # too far, or past the edge of the non-negative part
            continue
        w, share = w - share * step, min(1.0, 2 * share)
        risk, negative, slope, curve = new
    model.weights = np.round(w, 6)  # sums of tasks differ in their last bits


def class_prior(good: np.ndarray, any_: np.ndarray) -> float:
    """Share of positives in the unlabelled set, from counts of margins by cell of held-back positives and unlabelled texts."""
    if not good.sum() or not any_.sum():
        return 0.5
    cuts = _cut_cells(good, 60)
    above = lambda counts: 1 - np.concatenate([[0], np.cumsum(counts)])[cuts] / counts.sum()
    p, u = above(good), above(any_)
    slack = np.sqrt(np.log(120) / (2 * good.sum())) + np.sqrt(np.log(120) / (2 * any_.sum()))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


def _margins(model: BinnedLogistic) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.bincount(margin_cells(model.margin(x)), minlength=MARGIN_CELLS[1])


def fit_quality(good: np.ndarray, halves: tuple[Summed, Summed], unlabelled: Summed) -> tuple[BinnedLogistic, float] | None:
    """Model and class prior from statistics of trusted positives and sums over the unlabelled texts; None without texts."""
    k = len(STATISTICS)
    cells = unlabelled(lambda x: np.bincount((stat_cells(x) + np.arange(k) * STAT_CELLS[1]).ravel(), minlength=k * STAT_CELLS[1])).reshape(k, -1)
    if not cells.sum() or not len(good):
        return None
    good = good[np.random.default_rng(7).permutation(len(good))]
    half = max(1, len(good) // 2)
    model = BinnedLogistic(cells)
    prior = 0.5
    if halves[0](lambda x: np.array([len(x)]))[0]:
        fit_non_negative(model, good[:half], halves[0], 0.5, steps=STEPS // 2)
        prior = class_prior(_margins(model)(good[min(half, len(good) - 1) :]), halves[1](_margins(model)))
    fit_non_negative(model, good, unlabelled, prior)
    model.calibrate(_margins(model)(good), unlabelled(_margins(model)), prior)
    return model, prior


def sums_over(rows: DataFrame) -> Summed:
    """Sums of a function of batches of statistics over all rows (x array<double>); tasks add up, then 16 groups of tasks.

    Rows stream through two tasks a core, however many partitions they lie in."""
    few = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)

    def summed(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        zero = of(np.zeros((0, len(STATISTICS))))

        def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = zero.astype(np.float64), 0
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
                    for lo in range(0, len(x), 4_096):
                        total = total + of(x[lo : lo + 4_096])
                    n += batch.num_rows
            if n:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for sums in batch.column("sums").to_pylist():
                    x = np.frombuffer(sums, np.float64)
                    total = x if total is None else total + x
            if total is not None:
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        found = few.mapInArrow(part, "sums binary").repartition(16).mapInArrow(whole, "sums binary").collect()
        return sum((np.frombuffer(r.sums, np.float64) for r in found), zero.astype(np.float64))

    return summed


def _with_statistics(rows: DataFrame) -> DataFrame:
    """(doc_id, x) of rows (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches_of(batches, "text", 2 << 20):
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(statistics(texts_of(batch), kinds)), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, "doc_id long, x array<double>")


def fitted_quality(docs: DataFrame, labels: DataFrame, mod: int, rest: int, bound: int) -> tuple[BinnedLogistic, float] | None:
    """Model and class prior by documents outside the fold; an id that rows repeat stands, as a
    positive, for the least of its statistics."""
    good = label_sample(labels.where(F.col("quality") == 1), "quality", mod, rest, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = cut_lineage(_with_statistics(rows.where(F.col("doc_id").isNotNull() & ~in_fold(mod, rest))))
    positive = learned.join(F.broadcast(good.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()
    side = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    halves = tuple(sums_over(learned.where(side == i).select("x")) for i in (0, 1))
    return fit_quality(np.array([r.x for r in positive]).reshape(-1, len(STATISTICS)), halves, sums_over(learned.select("x")))


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Positives come from labels (doc_id, quality = 1) outside the fold crc32(doc_id) mod mod =
    rest (bound of them at most), unlabelled texts are all rows with an id outside it. Passes of
    the fit run as jobs while the result is built. A null text counts as empty; empty texts get
    the score of their statistics. Where no positive or no text may teach every score is 0.5.
    Rows come out as they go in, repeated ones too; a null doc_id is scored and not held out;
    other columns are ignored; an empty table gives an empty result."""
    fitted = fitted_quality(docs, labels, mod, rest, bound)
    model = fitted[0] if fitted else None

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds()
        for batch in batches_of(rows, "text", 2 << 20):
            x = statistics(texts_of(batch), kinds)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
