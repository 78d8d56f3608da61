"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. Tokens that look disguised (signs or digits among letters, letters three times or more,
   letters spaced out one by one) become a lattice: each position has the letters that the
   sign may stand for, with a channel cost, and runs may shrink. Viterbi search under the
   character model finds the likeliest reading.
3. Words and word beginnings of the restored texts of a bounded labelled sample are counted
   by label, with a sketch of the words before them so that copies of one text don't count as
   many uses. Those that are strongly toxic are kept with their precision.
4. A text's score is the noisy-or of the precisions of its restored tokens.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, cut_lineage, texts_of
from calibra.llm.folds import in_fold, label_sample

#: Labelled rows that the lexicon is fitted on at most.
SAMPLE = 30_000
#: Features that a task counts before it sends them.
COUNTED = 200_000
#: An entry needs that precision, and that many nats above the best chance entry.
PRECISION, MARGIN = 0.95, 1.0
#: Bits of the sketch of the words before an entry.
CONTEXTS = 32
#: Score of a text without any toxic token.
LEAK = 0.02
THRESHOLD = 0.7
#: Tokens whose reading a worker remembers before it starts afresh, and their length at most.
REMEMBERED, MEMORABLE = 300_000, 64
N_CLASSES = 64
#: Bytes of text that a task reads at once.
SLICE = 1 << 20

# Letters that a sign or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
_EDGES = ".,;:?!'\"()[]{}%&*#<>-_~`/\\|="
#: Nats for reading a sign as a letter, for dropping a sign, and for shrinking a run.
COST_SIGN, COST_DROP, COST_SHRINK, COST_PAIR = 1.0, 4.0, 1.0, 4.0
#: Readings so many nats from the best count too.
CLOSE = 3.0
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][ ._*-]{1,2}){3,}[^\W_](?!\w)")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_RUNS = re.compile(r"(.)\1*", re.S)
#: More than three of one character are read as three.
_LONGER_RUN = re.compile(r"(.)\1{3,}", re.S)
#: Inner signs that no letter is written with, and those that some letter may be.
_PARTS = (re.compile(r"[^\w@$!|+(<€£¡*#]+|_+"), re.compile(r"[^\w@$!€£¡]+|_+"))


def char_class(c: str) -> int:
    """0 for a word edge, 1-26 for a-z, else one of the other classes."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (N_CLASSES - 27)


@functools.lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = char_class(low[0])
    return table


def char_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of character c after a, b, counted over all texts."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _class_table(), np.zeros(N_CLASSES**3, np.int64)
        for batch in batches_of(rows, "text", SLICE):
            text = "  " + "  ".join(texts_of(batch)) + " "
            for at in range(0, len(text), SLICE):  # the two characters before a slice come with it
                code = table[np.frombuffer(text[max(0, at - 2) : at + SLICE].encode("utf-32-le"), np.uint32)].astype(np.int32)
                counts += np.bincount((code[:-2] * N_CLASSES + code[1:-1]) * N_CLASSES + code[2:], minlength=N_CLASSES**3)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_CLASSES**3)
    for gram, n in rows:  # at most N_CLASSES^3 rows
        counts[gram] = n
    three = counts.reshape(N_CLASSES, N_CLASSES, N_CLASSES)
    two = three.sum(0)
    one = (two.sum(0) + 1) / (two.sum() + N_CLASSES)
    p2 = (two + 8 * one) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
    return np.log(p3).astype(np.float32)


def _joined(linked: tuple) -> str:
    letters = []
    while linked:
        linked, last = linked
        letters.append(last)
    return "".join(reversed(letters))


def _lettered(token: str) -> bool:
    """Whether a token has enough letters to be a disguised word."""
    letters = sum(c.isalpha() for c in token)
    return letters >= 2 and letters * 3 >= len(token)


class Restorer:
    """Reads disguised tokens under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model

    def decode(self, token: str) -> tuple[str, ...]:
        """Likeliest readings of one lower-case token, the best first."""
        segments: list[list[tuple[str, float]]] = []
        for m in _RUNS.finditer(token):
            c, n = m.group(1), len(m.group(0))
            if c.isalpha():
                segments.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, COST_PAIR)] if n == 2 else [(c, 0.0), (c * 2, COST_SHRINK)])
            elif c in LEET:
                times = [n] if n <= 2 else [1, 2]
                segments.append([(x * k, COST_SIGN * k) for x in LEET[c] for k in times] + [("", COST_DROP)])
            else:
                segments.append([("", 0.0)])
        # readings are linked backwards, so a token costs time in proportion to its length
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in segments:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, text) in best.items():
                for letters, extra in options:
                    total, x, y = cost + extra, a, b
                    for c in letters:
                        z = char_class(c)
                        total -= float(self.model[x, y, z])
                        x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (text, letters) if letters else text)
            best = after
        ended = sorted((cost - float(self.model[a, b, 0]), _joined(text)) for (a, b), (cost, text) in best.items())
        return tuple(text for cost, text in ended if text and cost <= ended[0][0] + CLOSE)

    def readings(self, raw: str) -> tuple[str, ...]:
        """The plain token, and what it and its parts between signs are read as if it looks disguised."""
        plain = raw.strip(_EDGES + "$@")
        if plain.isalpha() and not _LONG_RUN.search(plain) and len(plain) == len(raw.strip(_EDGES)):
            return (plain,)
        core = raw.strip(".,;:?'\"%&~`=")
        core = re.sub(r"([$@#*!])\1{2,}$", "", core)
        core = _LONGER_RUN.sub(r"\1\1\1", core)
        if core == plain and plain.isalpha() and not _LONG_RUN.search(plain):
            return (plain,)
        whole = self.decode(core) if _lettered(core) else ()
        parts = dict.fromkeys(x for signs in _PARTS for x in signs.split(core) if x != core and _lettered(x))
        return tuple(dict.fromkeys((plain, *whole, *(word for x in parts for word in self.decode(x)))))

    def spaced(self, text: str) -> list[str]:
        """Words whose letters stand one by one."""
        return [word for m in _SPACED.findall(text) for word in self.decode(re.sub(r"[ ._*-]", "", m))]

    def restore(self, text: str) -> str:
        """The text in lower case with its disguised tokens read."""
        joined = _SPACED.sub(lambda m: re.sub(r"[ ._*-]", "", m.group(0)), text.lower())
        return " ".join(r[min(1, len(r) - 1)] for r in map(self.readings, joined.split()))


def _tokens(text: str) -> Iterable[str]:
    """Tokens between white space, without a list of them where a text is long."""
    return text.split() if len(text) < SLICE else (m.group() for m in re.finditer(r"\S+", text))


def _first_contexts(text: str) -> dict[str, str]:
    """The token before the first use of each token."""
    found, prev = {}, ""
    for token in _tokens(text):
        found.setdefault(token, prev)
        prev = token
    return found


def features_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to six characters."""
    return (word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n))


def fit_lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, mod: int, rest: int, bound: int = SAMPLE) -> tuple[dict[str, float], float]:
    """(precision of each strongly toxic feature, share of toxic texts among those without one)."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, toxic, clean, contexts = Restorer(model), Counter(), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            return pa.record_batch([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, clean, contexts))], names=["feature", "toxic", "clean", "contexts"])

        for batch in batches_of(rows, "text", SLICE):
            for text, label in zip(texts_of(batch), batch.column("label").to_pylist()):
                low = text.lower()
                own: dict[str, str] = {}
                for raw, prev in _first_contexts(low).items():
                    for word in restorer.readings(raw):
                        for f in features_of(word):
                            own.setdefault(f, prev)
                for word in restorer.spaced(low):
                    for f in features_of(word):
                        own.setdefault(f, low[:40])
                own[""] = ""  # counts the texts
                (toxic if label else clean).update(own.keys())
                if label:
                    for f, prev in own.items():
                        contexts[f] |= 1 << zlib.crc32(prev.encode()) % CONTEXTS
            if len(toxic) + len(clean) > COUNTED:
                yield counted()
                toxic.clear(), clean.clear(), contexts.clear()
        yield counted()

    sample = label_sample(labels, "toxic", mod, rest, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one text for each labelled id
    counts = rows.select("text", "label").mapInArrow(run, "feature string, toxic long, clean long, contexts long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("contexts").alias("contexts"))
    counts = cut_lineage(counts)
    base = counts.agg(F.count("*"), F.max(F.when(F.col("feature") == "", F.col("toxic"))), F.max(F.when(F.col("feature") == "", F.col("clean")))).first()
    n_features, toxic, clean = base[0], base[1] or 0, base[2] or 0
    if not toxic:
        return {}, LEAK
    rate = (toxic + 0.5) / (toxic + clean + 1)
    precision = (F.col("toxic") + rate / 4) / (F.col("toxic") + F.col("clean") + 0.25)
    # copies of one text repeat its words after the same words: no more toxic uses count than contexts
    seen = F.bit_count("contexts")
    uses = F.least(F.col("toxic"), F.when(seen >= CONTEXTS - 1, F.col("toxic")).otherwise(-CONTEXTS * F.ln(1 - seen / CONTEXTS)))
    # log likelihood ratio against the base rate, beyond what the best of so many features has by chance
    gain = uses * F.ln(precision / rate) + F.col("clean") * F.ln((1 - precision) / (1 - rate))
    kept = counts.where(F.col("feature") != "").withColumn("precision", precision).where((F.col("precision") >= PRECISION) & (gain >= math.log(n_features) + MARGIN))
    # bounded by the words of the sample
    return {r.feature: float(r.precision) for r in kept.select("feature", "precision").collect()}, LEAK


class ToxicScorer:
    """Scores of texts under a lexicon; remembers tokens it has read."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], leak: float) -> None:
        self.restorer, self.lexicon, self.leak = Restorer(model), lexicon, leak
        self.seen: dict[str, float] = {}

    def evidence(self, raw: str) -> float:
        found = 0.0
        for word in self.restorer.readings(raw):
            for f in features_of(word):
                found = max(found, self.lexicon.get(f, 0.0))
        return found

    def score(self, text: str) -> float:
        low, seen = text.lower(), self.seen
        clean = math.log(1 - self.leak)
        if len(seen) > REMEMBERED:
            seen.clear()
        for raw in set(_tokens(low)):
            p = seen.get(raw)
            if p is None:
                p = self.evidence(raw)
                if len(raw) <= MEMORABLE:
                    seen[raw] = p
            if p:
                clean += math.log(1 - p)
        for word in self.restorer.spaced(low):
            p = max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)
            if p:
                clean += math.log(1 - p)
        return 1 - math.exp(clean)


def toxicity_scores(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, bound: int = SAMPLE, threshold: float = THRESHOLD, with_restored: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted[, restored]) of each row.

    labels (doc_id, toxic) teach from ids outside the fold crc32(doc_id) mod mod = rest only.
    A null or empty text, and a text without a toxic word, has the constant score LEAK; without
    labels every text has. Of rows that repeat a labelled id the least text teaches. A null
    doc_id is scored and not held out. Rows come out as they go in, repeated ones too; other
    columns are ignored; an empty table gives an empty result."""
    model = char_model(docs)
    lexicon, leak = fit_lexicon(docs, labels, model, mod, rest, bound)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ToxicScorer(model, lexicon, leak)
        for batch in batches_of(rows, "text", SLICE):
            texts = texts_of(batch)
            score = np.array([scorer.score(t) for t in texts])
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            if with_restored:
                cols.append(pa.array([scorer.restorer.restore(t) for t in texts], pa.string()))
            yield pa.record_batch(cols, names=["doc_id", "held_out", "score", "predicted", "restored"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(mod, rest).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + ", restored string" * with_restored)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the texts whose toxicity reaches the threshold; all columns stay as they are.

    Null and empty texts stay; each of repeated rows is judged for itself. Columns may have any
    other names and types; an empty table, or one without labels, loses nothing."""
    model = char_model(docs)
    lexicon, leak = fit_lexicon(docs, labels, model, 3, 1)
    at = docs.columns.index("text")

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ToxicScorer(model, lexicon, leak)
        for batch in batches_of(rows, "text", SLICE):
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
