"""Language identification with string kernels.

A text is cut into blocks of about equal length. A block is described by the presence of byte
n-grams of several lengths (a blended spectrum) in lower case, and the kernel of two blocks is
the cosine of their presence vectors. Landmarks are blocks of a bounded, documented sample of
training texts; n-grams are told apart by their bytes, and those of the landmarks are the
vocabulary: what no landmark has can't be mistaken for what one has. The Nyström map
k(x, landmarks) K^(-1/2) takes a batch of blocks to landmark coordinates by one matrix product.
A text is the mean of its blocks, each weighted by the fourth power of its familiarity, the
share of its longest n-grams that the vocabulary knows; so an image in base64 or a table of
numbers, however long, hardly moves the text around it, and a long text is described as sharply
as a short one. One-versus-rest kernel ridge regression needs only the sums Z'Z and Z'Y over
all training texts, which the tasks add up; scores are another matrix product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, texts_of
from calibra.llm.folds import in_fold
from calibra.llm.shingles import mix

#: Landmarks (one of each language at least), n-gram lengths, ridge weight, languages at most (more are an error).
LANDMARKS, LENGTHS, RIDGE, MOST_LANGUAGES = 160, (1, 2, 3, 4), 1e-3, 512
#: Parts of a language whose landmarks are ranked apart.
PARTS = 64
#: Bytes of a block, about; blocks mapped by one product; power and floor of the familiarity that weights a block.
BLOCK, TOGETHER, POWER, FLOOR = 4096, 64, 4, 1e-3
UNKNOWN = "und"


def blocks_of(text: str) -> list[np.ndarray]:
    """Bytes of the lower-case text, a space before and after it, in blocks of about BLOCK bytes."""
    whole = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, round(len(whole) / BLOCK))
    cuts = [len(whole) * i // n for i in range(n + 1)]
    return [whole[i:j] for i, j in zip(cuts, cuts[1:])]


def gram_codes(block: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> list[np.ndarray]:
    """Code of the n-gram at each place of a block, for each length: its bytes and its length, so no two share one."""
    b, code, out = block.astype(np.uint64), np.zeros(len(block), np.uint64), []
    for n in range(1, max(lengths) + 1):
        if len(b) < n:
            code = code[:0]
        else:
            code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        if n in lengths:
            out.append(code | np.uint64(n << 40))
    return out


def presence(block: np.ndarray) -> np.ndarray:
    """Ascending codes of the different n-grams of a block."""
    return np.unique(np.concatenate(gram_codes(block)))


class Vocabulary:
    """Numbers of known codes, in an open hash table a quarter full at most."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.mask = np.uint64((1 << max(4, int(4 * len(codes) - 1).bit_length())) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # of several for one place the last stays
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & int(self.mask)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(codes) & self.mask).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Number of each code, -1 for an unknown one."""
        at = self._home(codes)
        found = self.table[at]
        other = np.flatnonzero((found >= 0) & (self.codes[found] != codes))
        while len(other):
            at[other] = (at[other] + 1) & int(self.mask)
            found[other] = self.table[at[other]]
            other = other[(found[other] >= 0) & (self.codes[found[other]] != codes[other])]
        return found


class Nystroem:
    """Map of texts onto landmark coordinates."""

    def __init__(self, landmarks: list[np.ndarray]) -> None:
        """landmarks: the ascending codes of each landmark block."""
        self.vocabulary = Vocabulary(np.unique(np.concatenate(landmarks)))
        self.has = np.zeros((len(self.vocabulary.codes), len(landmarks)), np.uint8)
        for i, own in enumerate(landmarks):
            self.has[np.searchsorted(self.vocabulary.codes, own), i] = 1
        self.norm = np.sqrt(np.array([len(x) for x in landmarks], float))
        shared = np.zeros((len(landmarks), len(landmarks)))
        for at in range(0, len(self.has), 1 << 16):
            part = self.has[at : at + (1 << 16)].astype(np.float32)
            shared += part.T @ part
        value, vector = np.linalg.eigh(shared / np.outer(self.norm, self.norm))
        keep = value > 1e-6 * value[-1]
        self.root = vector[:, keep] / np.sqrt(value[keep])

    def kernel(self, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel of each block with each landmark, familiarity of each block)."""
        n_blocks, familiar = len(blocks), np.zeros(len(blocks))
        seen = np.zeros((n_blocks, len(self.vocabulary.codes)), bool)
        for codes in zip(*map(gram_codes, blocks)):  # of one length in all blocks, the longest last
            sizes = np.array([len(x) for x in codes])
            owner, number = np.repeat(np.arange(n_blocks), sizes), self.vocabulary.find(np.concatenate(codes))
            known = number >= 0
            seen[owner[known], number[known]] = True
            familiar = np.where(sizes > 0, np.bincount(owner, known, n_blocks) / np.maximum(sizes, 1), familiar)
        shared = np.zeros((n_blocks, len(self.norm)))
        for at in range(0, len(self.has), 1 << 14):
            part = np.s_[at : at + (1 << 14)]
            shared += seen[:, part].astype(np.float32) @ self.has[part].astype(np.float32)
        return shared / np.outer(np.sqrt(np.maximum(seen.sum(1), 1)), self.norm), familiar

    def map(self, texts: list[str]) -> np.ndarray:
        """One row of coordinates a text, with a last column of ones."""
        out, held, owners = np.zeros((len(texts), self.root.shape[1])), [], []
        total = np.zeros(len(texts))

        def flush() -> None:
            kernel, familiar = self.kernel(held)
            weight, who = np.maximum(familiar, FLOOR) ** POWER, np.array(owners)
            np.add.at(out, who, weight[:, None] * (kernel @ self.root))
            np.add.at(total, who, weight)
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for block in blocks_of(text):
                held.append(block)
                owners.append(i)
                if len(held) == TOGETHER:
                    flush()
        if held:
            flush()
        return np.hstack([out / np.maximum(total, 1e-300)[:, None], np.ones((len(texts), 1))])


def _landmark(text: str, key: int) -> bytes:
    """Codes of the block of a text that its key names."""
    blocks = blocks_of(text)
    return presence(blocks[key % len(blocks)]).tobytes()


def fit_languages(docs: DataFrame, mod: int, rest: int, n_landmarks: int = LANDMARKS) -> tuple[Nystroem, np.ndarray, list[str]] | None:
    """(map, ridge weights of each language, languages) from texts outside the fold; None without any."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "doc_id").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold(mod, rest))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: group them first")
    each = max(1, n_landmarks // len(languages))
    keyed = rows.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("key"))
    # the least keys of a language, of parts of it first, so that no task ranks all of a common one
    first = F.row_number().over(Window.partitionBy("lang", F.pmod("key", F.lit(PARTS))).orderBy("key"))
    last = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    best = keyed.select("lang", "key").distinct().withColumn("rank", first).where(F.col("rank") <= each).withColumn("rank", last).where(F.col("rank") <= each)
    picked = [r.key for r in best.collect()]  # a bounded number

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 2 << 20):
            codes = [_landmark(t, k) for t, k in zip(texts_of(batch), batch.column("key").to_pylist())]
            yield pa.record_batch([batch.column("lang"), batch.column("key"), pa.array(codes, pa.binary())], names=["lang", "key", "codes"])

    chosen = keyed.where(F.col("key").isin(picked)).mapInArrow(described, "lang string, key long, codes binary").groupBy("lang", "key").agg(F.min("codes").alias("codes"))
    net = Nystroem([np.frombuffer(r.codes, np.uint64) for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.key))])
    width, number = net.root.shape[1] + 1, {x: i for i, x in enumerate(languages)}
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 160 blocks of 4 kB, or one a language, bound its size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width + len(languages)))
        for batch in batches_of(batches, "text", 2 << 20):
            z = shared.value.map(texts_of(batch))
            y = -np.ones((len(z), len(languages)))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                y[i, number[lang]] = 1
            sums += z.T @ np.hstack([z, y])
        i, j = np.indices(sums.shape)
        yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(sums.ravel())], names=["i", "j", "v"])

    added = rows.select("text", "lang").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    sums = np.zeros((width, width + len(languages)))
    sums[added["i"].to_numpy(), added["j"].to_numpy()] = added["v"].to_numpy()
    zz, zy = sums[:, :width], sums[:, width:]
    return net, np.linalg.solve(zz + RIDGE * max(1.0, zz[-1, -1]) * np.eye(width) / width, zy), languages


def language_predictions(docs: DataFrame, mod: int = 3, rest: int = 1, n_landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row.

    Learns from the text and non-null lang of rows outside the fold crc32(doc_id) mod mod =
    rest. A text that is null or has no letter is `und` with score 0, as is every text where
    there is nothing to learn from. Ties go to the first language in order. Rows come out as
    they go in, repeated ones too; doc_id may be null; other columns are ignored; an empty
    table gives an empty result."""
    fitted = fit_languages(docs, mod, rest, n_landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, "text", 2 << 20):
            texts = texts_of(batch)
            lettered = [any(map(str.isalpha, t)) for t in texts]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if shared.value:
                net, weights, languages = shared.value
                margin = net.map(texts) @ weights
                best = margin.argmax(1)
                odds = np.exp(4 * (margin - margin.max(1, keepdims=True)))
                score = np.where(lettered, (odds / odds.sum(1, keepdims=True))[np.arange(len(texts)), best], 0.0)
                lang = [languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), lettered)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
