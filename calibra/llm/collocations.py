"""Phrases whose words keep company: counts of all phrases by Suffix-sigma, then scores of cuts.

Each word begins a suffix of its piece of text, cut off after max_n words. The distinct
suffixes of a slice of texts, with their counts, are shuffled by language, first word and, where
one first word fills more than a range, by the words after it: ranges of the suffixes' order,
whose bounds come from a sample. A task sorts its range in reverse and counts all prefixes with
a stack that is kept as arrays: sorted suffixes share a prefix until it is popped, so the count
of a prefix is the sum of a run at its level. All suffixes with a prefix lie side by side; so
only the first and the last run of a level can go on in a neighbouring range. These are
emitted whatever their count and summed afterwards; all others are final in their task and
leave it only with the least count, which every part of a frequent phrase reaches too. Counts
of parts are then joined to the phrases that they are cut from.

The bounds of ranges decide where a suffix is counted, never whether or how often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, cut_lineage, encoded_runs, joined_bytes, ranges, run_starts, texts_of

#: Bytes of text whose suffixes are made together, bytes of text per range, suffixes counted at once.
SLICE, RANGE_BYTES, BLOCK = 4 << 20, 6 << 20, 3_000_000
#: Most ranges, sampled suffixes for each, and most sampled suffixes.
MOST_RANGES, PER_RANGE, MOST_SAMPLED = 1 << 16, 64, 1 << 20
_WORD, _GAP, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = _END
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PACKED = "range int, lang string, shape binary, counts binary, words binary"
_COUNTED = "lang string, words int, phrase string, f long"


def _ranked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rank from 1 of each word in byte order, place of each rank's word)."""
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(1, len(words) + 1)
    return rank, order


def _sorted_suffixes(lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Stable order of suffixes by language, then by the ranks of their words (0: none)."""
    base = int(words.max(initial=0)) + 1
    if words.shape[1] == 4 and (int(lang.max(initial=0)) + 1) * base * base < 1 << 62:
        return np.lexsort((words[:, 2] * base + words[:, 3], (lang * base + words[:, 0]) * base + words[:, 1]))
    return np.lexsort((*words.T[::-1], lang))


def _shared(lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of leading words that each suffix shares with the one before; -1 where the language differs."""
    same = np.concatenate([[False], lang[1:] == lang[:-1]])
    shared, upto = np.where(same, 0, -1), same
    for d in range(words.shape[1]):
        upto = upto & np.concatenate([[False], (words[1:, d] == words[:-1, d]) & (words[1:, d] > 0)])
        shared += upto
    return shared


class SliceSuffixes:
    """Suffixes of a slice of texts, beside the bounds of ranges, in ranks of one dictionary."""

    def __init__(self, texts: list[str], langs: list[str], max_n: int, bounds: list[tuple[bytes, ...]] = ()) -> None:
        data, begins = joined_bytes(texts)
        data = _LOWER[data]
        kind = _KIND[data]
        starts, codes, different = encoded_runs(data, kind == _WORD)
        piece = np.cumsum(kind == _END)[starts]
        cut_words = [w for b in bounds for w in b[1:]]
        union = pa.chunked_array([different, pa.array(cut_words, pa.binary())]).combine_chunks().dictionary_encode()
        places, self.dictionary = union.indices.to_numpy()[len(different) :], union.dictionary
        rank, self.order = _ranked(self.dictionary)
        empty = rank[union.dictionary.index(pa.scalar(b"", pa.binary())).as_py()] if b"" in cut_words else 0
        # ranks from 1 leave 0 for "no word"; the empty word of a short bound sorts first anyway and becomes 0
        rank, self.shift = rank - (1 if empty else 0), 1 if empty else 0
        n, m = len(starts), len(bounds)
        words = np.zeros((m + n, max_n), np.int64)
        words[:m] = rank[places].reshape(m, max_n) if m else 0
        mine = rank[codes]
        for d in range(min(max_n, n)):
            inside = piece[: n - d] == piece[d:]
            words[m : m + n - d, d] = np.where(inside, mine[d:], 0)
        names = sorted({*langs, *(b[0].decode("utf-8", "surrogatepass") for b in bounds)}, key=lambda x: x.encode("utf-8", "surrogatepass"))
        at = {name: i for i, name in enumerate(names)}
        doc = np.searchsorted(begins, starts, "right") - 1
        self.names = names
        self.lang = np.concatenate([np.array([at[b[0].decode("utf-8", "surrogatepass")] for b in bounds], np.int64), np.array([at[x] for x in langs], np.int64)[doc]])
        self.words, self.n_bounds = words, m

    def packed(self) -> Iterator[pa.RecordBatch]:
        """One row for each range and language: distinct suffixes in order, each as the number of
        words shared with the one before, its length and its other words, with its count."""
        order = _sorted_suffixes(self.lang, self.words)
        bound = order < self.n_bounds
        part = np.cumsum(bound)[~bound]
        order = order[~bound]
        if not len(order):
            return
        lang, words = self.lang[order], self.words[order]
        shared, length = _shared(lang, words), (words > 0).sum(axis=1)
        first = (shared < length) | (length != np.concatenate([[0], length[:-1]]))
        # a bound equal to a suffix lies before all of its occurrences, so equal ones share a range
        at = np.flatnonzero(first)
        counts = np.diff(np.append(at, len(order)))
        lang, words, length, part = lang[at], words[at], length[at], part[at]
        group = run_starts(part * len(self.names) + lang)
        shared = np.maximum(_shared(lang, words), 0)
        shared[group[:-1]] = 0
        fresh = (np.arange(words.shape[1]) >= shared[:, None]) & (np.arange(words.shape[1]) < length[:, None])
        spaced = pc.binary_join_element_wise(self.dictionary, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))
        taken = spaced.take(pa.array(self.order[words[fresh] - 1 + self.shift]))
        offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)
        cuts = np.concatenate([[0], np.cumsum(length - shared)])[group]
        text = pa.Array.from_buffers(pa.binary(), len(group) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets[cuts])), taken.buffers()[2]])
        shape = pa.Array.from_buffers(pa.binary(), len(group) - 1, [None, pa.py_buffer(group.astype(np.int32)), pa.py_buffer((shared + 16 * length).astype(np.uint8))])
        times = pa.Array.from_buffers(pa.binary(), len(group) - 1, [None, pa.py_buffer((4 * group).astype(np.int32)), pa.py_buffer(counts.astype(np.uint32))])
        head = group[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), pa.array([self.names[i] for i in lang[head].tolist()]), shape, times, text], names=["range", "lang", "shape", "counts", "words"])

    def every(self, step: int) -> pa.RecordBatch:
        """Every step-th suffix as (lang, w0, w1, ...), for choosing bounds."""
        rows = np.arange(self.n_bounds, len(self.words), step)
        some = self.words[rows]
        columns = [pa.array(self.names).take(pa.array(self.lang[rows])).cast(pa.binary())]
        for d in range(some.shape[1]):
            place = pa.array(self.order[np.maximum(some[:, d], 1) - 1], mask=some[:, d] == 0)
            columns.append(pc.fill_null(self.dictionary.take(place), b""))
        return pa.RecordBatch.from_arrays(columns, names=["lang", *(f"w{d}" for d in range(some.shape[1]))])


def _unpacked(rows: list[tuple[str, bytes, bytes, bytes]], max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], pa.Array, np.ndarray]:
    """(language, ranks of words, counts, languages, dictionary, place of each rank) of packed rows."""
    shape = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
    counts = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).astype(np.int64)
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    shared, length = (shape & 15).astype(np.int64), (shape >> 4).astype(np.int64)
    _, codes, dictionary = encoded_runs(data, data != 32)
    rank, order = _ranked(dictionary)
    mine, begin, row = rank[codes], np.concatenate([[0], np.cumsum(length - shared)])[:-1], np.arange(len(shape))
    words = np.zeros((len(shape), max_n), np.int64)
    for d in range(max_n):
        source = np.maximum.accumulate(np.where((shared <= d) & (d < length), row, 0))
        has = d < length
        source = source[has]
        words[has, d] = mine[begin[source] + d - shared[source]]
    names = sorted({r[0] for r in rows}, key=lambda x: x.encode("utf-8", "surrogatepass"))
    at = {name: i for i, name in enumerate(names)}
    lang = np.repeat([at[r[0]] for r in rows], [len(r[1]) for r in rows])
    return lang, words, counts, names, dictionary, order


def count_prefixes(rows: list[tuple[str, bytes, bytes, bytes]], max_n: int, least: int, whole: bool) -> pa.RecordBatch:
    """Counts of all prefixes of a range's suffixes, and (words = 0) the number of suffixes of each language.

    With whole, the rows are all of their range, so a prefix with fewer than least occurrences
    is left out unless it is the first or last of its level; else all are given."""
    lang, words, counts, names, dictionary, place = _unpacked(rows, max_n)
    order = _sorted_suffixes(lang, words)[::-1]
    lang, words, counts = lang[order], words[order], counts[order]
    shared, length = _shared(lang, words), (words > 0).sum(axis=1)
    langs, lengths, phrases, sums = [], [], [], []
    for level in range(max_n + 1):
        # the stack pops its entry of a level where fewer words are shared
        popped = np.flatnonzero(shared < level) if level else np.flatnonzero(shared < 0)
        total = np.add.reduceat(counts, popped)
        good = length[popped] >= level
        if level and whole:
            edge = np.zeros(len(popped), bool)
            edge[[0, -1]] = True
            good &= (total >= least) | edge
        at = popped[good]
        langs.append(lang[at])
        lengths.append(np.full(len(at), level, np.int32))
        sums.append(total[good])
        if level:
            parts = [dictionary.take(pa.array(place[words[at, d] - 1])) for d in range(level)]
            phrases.append(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if level > 1 else parts[0])
        else:
            phrases.append(pa.array([b""] * len(at), pa.binary()))
    return pa.RecordBatch.from_arrays(
        [pa.array(names).take(pa.array(np.concatenate(langs))), pa.array(np.concatenate(lengths)), pa.chunked_array(phrases).combine_chunks().cast(pa.string()), pa.array(np.concatenate(sums))],
        names=["lang", "words", "phrase", "f"],
    )


def _over_texts(max_n: int, bounds: list[tuple[bytes, ...]], give: Callable[[SliceSuffixes], Iterable[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", SLICE):
            yield from give(SliceSuffixes(texts_of(batch), batch.column("lang").to_pylist(), max_n, bounds))

    return run


def _over_ranges(max_n: int, least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks rows sorted by range; a range of more than BLOCK suffixes is counted in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now, parts = [], 0, None, False
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "shape", "counts", "words"))):
                if rows and (part != now or held + len(row[1]) > BLOCK):
                    parts = parts or part == now
                    yield count_prefixes(rows, max_n, least, not parts)
                    rows, held, parts = [], 0, parts and part == now
                now, held = part, held + len(row[1])
                rows.append(tuple(row))
        if rows:
            yield count_prefixes(rows, max_n, least, not parts)

    return run


def range_bounds(texts: DataFrame, max_n: int, n_ranges: int, n_bytes: int) -> list[tuple[bytes, ...]]:
    """(lang, w0, w1, ...) of the least suffix of each range but the first, from sampled texts.

    A bounded number of suffixes, at most about MOST_SAMPLED, reaches the driver."""
    share = min(1.0, n_ranges * (1 << 14) / max(1, n_bytes))
    step = max(1, int(n_bytes * share / 6 / min(MOST_SAMPLED, n_ranges * PER_RANGE)))
    schema = ", ".join(["lang binary", *(f"w{d} binary" for d in range(max_n))])
    drawn = texts if share == 1 else texts.sample(share, seed=1)
    found = drawn.mapInArrow(_over_texts(max_n, [], lambda s: [s.every(step)]), schema).toArrow()
    found = found.sort_by([(c, "ascending") for c in found.column_names])
    picked = found.take(pa.array((np.arange(1, n_ranges) * found.num_rows // n_ranges)[: max(0, found.num_rows - 1)]))
    return sorted({tuple(r.values()) for r in picked.to_pylist()})


def phrase_counts(documents: DataFrame, max_n: int = 4, least: int = 30) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to max_n words with least occurrences, and
    with words = 0 the number of word occurrences of each language.

    Texts are lower-cased in A-Z, split into pieces at .,;:!? and 0x0A-0x0D and those into
    words at space and tab; phrases lie within pieces. A null lang counts as und. Written to
    the shared folder."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    (n_bytes,) = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = min(MOST_RANGES, max(partitions, -(-n_bytes // RANGE_BYTES)))
    bounds = range_bounds(texts, max_n, n_ranges, n_bytes)
    packed = texts.mapInArrow(_over_texts(max_n, bounds, SliceSuffixes.packed), _PACKED)
    counted = packed.repartitionById(n_ranges, "range").sortWithinPartitions("range").mapInArrow(_over_ranges(max_n, least), _COUNTED)
    summed = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return cut_lineage(summed.where((F.col("words") == 0) | (F.col("f") >= least)))


def _words(phrase: Column, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, length), " ")


def phrase_collocations(documents: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000, cover: int = 80) -> DataFrame:
    """The top phrases of each language by the score of their weakest cut.

    A phrase of 2 to max_n words with a >= least occurrences is cut after each k; with l and r
    the occurrences of both parts, its score is the least floor(2000000 * a / (l + r)), ties to
    the smallest k. Phrases inside a longer one that has cover % of their occurrences are
    dropped. Null texts count as empty; a language without such phrases has no rows; extra
    columns are ignored. Decimals keep products exact beyond 64 bits."""
    counts = phrase_counts(documents, max_n, least)
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = counts.where("words > 0").select("lang", "phrase", "f")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _words(F.col("phrase"), 1, F.col("k")), "right": _words(F.col("phrase"), F.col("k") + 1, F.col("words"))})
    left, right = (parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(to)) for side, to in (("left", "l"), ("right", "r")))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr("(cast(a AS decimal(25, 0)) * 2000000BD) div (cast(l AS decimal(25, 0)) + cast(r AS decimal(25, 0)))")
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spans = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(n).alias("n")) for n in range(2, max_n) for i in range(max_n - n + 1)))
    inside = phrases.where("words > 2").withColumn("span", F.explode(spans)).where("span.n < words AND span.i + span.n <= words + 1")
    covered = inside.groupBy("lang", _words(F.col("phrase"), F.col("span.i"), F.col("span.n")).alias("phrase")).agg(F.max("a").alias("most"))
    left_over = weakest.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a"))).select("lang", "phrase", "a", "cut.*")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each sixteenth of a language first, so that no task ranks a whole language
    near = left_over.withColumn("at", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*best))).where(F.col("at") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
