"""Quality rules from tokeniser fertility: how well public vocabularies fit a text.

Each word is encoded by two public vocabularies, a piece vocabulary with byte fallback and a
byte-level one. A text's characters per token under either, its share of byte-fallback tokens
and the entropy of its tokens are compared with bands. The bands of a language are its own:
fences around the quartiles of all its texts that pass the base rule, for texts of one order
of length, since short texts vary more. Where a language has few texts of a length, its band
over all lengths is taken, then the one of the script.

Words are told apart exactly by Arrow's dictionary encoding of a slice's words; a worker keeps
what it knows of words (tokens, script), so a word is encoded about once a worker. Quartiles
come from exact histograms of whole-numbered measures, which tasks combine before the shuffle;
the result doesn't depend on how the table is split.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, cut_lineage, encoded_runs, fresh_names, joined_bytes, ranges, texts_of

#: Bytes of text measured together; words that a worker remembers, beyond them it starts afresh.
SLICE, KNOWN = 3 << 20, 200_000
#: A window of so many words that recurs in a text counts as repetition.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Fences lie so many times the distance of the quartiles beyond them; a band needs SUPPORT texts.
#: They lie at least a measure's least distance from the median, doubled for a text of SHORT
#: tokens and growing with the standard error of a mean below that.
FENCE, SUPPORT, SHORT = 4, 50, 128
#: Measure: (step of its histogram, largest value, least distance as a share of the median, least distance).
MEASURES = {
    "piece_chars": (10, 64_000, 0.12, 0),  # thousandths of a character per token
    "byte_chars": (10, 64_000, 0.12, 0),
    "fallback": (5, 1_000, 0.0, 50),  # thousandths of all tokens
    "entropy": (20, 16_000, 0.15, 0),  # thousandths of a bit
}
#: First code point after each run of scripts, in order: a coarse split of the letters.
_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))
SCRIPTS = (*(name for name, *_ in _SCRIPTS), "other")

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = BASE + ", script string, size int, n_tokens long, piece_chars long, byte_chars long, fallback long, entropy long"


def default_vocabularies() -> tuple[str, str]:
    """Paths of the piece vocabulary and of the byte-level one."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(chars: str) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[[ord(c) for c in chars]] = True
    return marks


_IS_SYMBOL, _IS_SPACE = _table(SYMBOLS), _table(" \t\n\x0b\x0c\r")


def repeated_words(words: np.ndarray, doc: np.ndarray, docs: int, window: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it.

    words: a code of each word; doc: its document, ascending. Windows are named exactly: equal
    pairs of words get one number, equal pairs of pairs get one, and so on (window: a power of 2)."""
    names, width = words.astype(np.int64), 1
    while width < window and len(names) > width:
        left, right = names[:-width], names[width:]
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1]
        width *= 2
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    keys, counts = np.unique(doc[inside].astype(np.int64) * (int(names.max()) + 1) + names[inside], return_inverse=True, return_counts=True)[1:]
    again = inside[counts[keys] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


class Vocabularies:
    """What a worker knows of words: tokens under both vocabularies, length and script."""

    def __init__(self, piece: str, byte_level: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_level, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece)
        self.byte_level = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())], bool)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.tokens, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.byte_tokens = self.script = np.zeros(0, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Place of each of some different words; new ones are encoded, with the space before them."""
        if len(self.place) + len(words) > KNOWN:
            self._forget()
        new = [w for w in words if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            pieces = self.piece.encode(new, num_threads=1)
            lengths = np.fromiter(map(len, pieces), np.int64, len(new))
            self.tokens = np.concatenate([self.tokens, np.fromiter((t for p in pieces for t in p), np.int32, int(lengths.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            encode = self.byte_level.encode_ordinary
            self.byte_tokens = np.concatenate([self.byte_tokens, np.fromiter((len(encode(" " + w)) for w in new), np.int64, len(new))])
            self.script = np.concatenate([self.script, self._scripts(new)])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _scripts(words: list[str]) -> np.ndarray:
        """Script of most letters of each word; the first of SCRIPTS on a tie, other without any."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        votes = np.zeros((len(words), len(SCRIPTS)), np.int64)
        for i, (_, low, high) in enumerate(_SCRIPTS):
            inside = (points >= low) & (points <= high)
            votes[:, i] = np.bincount(of[inside], minlength=len(words))
        votes[:, -1] = votes[:, :-1].max(axis=1) == 0
        return votes.argmax(axis=1)


def measure(texts: list[str], vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    """The columns of _SCHEMA for some texts."""
    n = len(texts)
    data, begins = joined_bytes(texts)
    doc_of = lambda at: np.searchsorted(begins, at, "right") - 1
    solid = ~_IS_SPACE[data]
    starts, codes, different = encoded_runs(data, solid)
    doc = doc_of(starts)
    n_words = np.bincount(doc, minlength=n)
    words = [w.decode("utf-8", "surrogatepass") for w in different.to_pylist()]
    chars = np.fromiter(map(len, words), np.int64, len(words))
    word_chars = np.bincount(doc, chars[codes], n).astype(np.int64)
    symbols = np.bincount(doc_of(np.flatnonzero(_IS_SYMBOL[data])), minlength=n)
    line_starts, line_codes, _ = encoded_runs(data, data != 10)
    solid_before = np.concatenate([[0], np.cumsum(solid)])
    line_ends = np.append(line_starts[1:], len(data))
    full = solid_before[line_ends] > solid_before[line_starts]
    line_doc = doc_of(line_starts[full])
    lines = np.bincount(line_doc, minlength=n)
    base = int(line_codes.max(initial=0)) + 1
    lines -= np.bincount(np.unique(line_doc * base + line_codes[full]) // base, minlength=n)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated_words(codes, doc, n)}
    if not len(words):
        return out | {"script": np.full(n, len(SCRIPTS) - 1), "size": np.zeros(n, np.int64), **{k: np.zeros(n, np.int64) for k in ("n_tokens", *MEASURES)}}
    place = vocabularies.places(words)
    first, length = vocabularies.starts[place], np.diff(vocabularies.starts)[place]
    tokens, byte_tokens = np.bincount(doc, length[codes], n), np.bincount(doc, vocabularies.byte_tokens[place][codes], n)
    votes = np.bincount(doc * len(SCRIPTS) + vocabularies.script[place][codes], chars[codes], n * len(SCRIPTS)).reshape(n, -1)
    votes[:, -1] = np.where(votes[:, :-1].any(axis=1), 0, 1)
    # Tokens of a text's different words, weighted by how often the text has the word.
    pairs, times = np.unique(doc * len(words) + codes, return_counts=True)
    pair_doc, pair_word = pairs // len(words), pairs % len(words)
    ids = vocabularies.tokens[ranges(first[pair_word], length[pair_word])].astype(np.int64)
    token_doc, weight = np.repeat(pair_doc, length[pair_word]), np.repeat(times, length[pair_word])
    fallback = np.bincount(token_doc, weight * vocabularies.is_byte[ids], n)
    keys, back = np.unique(token_doc * len(vocabularies.is_byte) + ids, return_inverse=True)
    count = np.bincount(back, weight)
    spread = np.bincount(keys // len(vocabularies.is_byte), count * np.log2(np.maximum(count, 1)), n)
    some = np.maximum(tokens, 1)
    return out | {
        "script": votes.argmax(axis=1),
        "size": np.log2(some).astype(np.int64),
        "n_tokens": tokens.astype(np.int64),
        "piece_chars": np.minimum(1000 * word_chars // some, MEASURES["piece_chars"][1]).astype(np.int64),
        "byte_chars": np.minimum(1000 * word_chars // np.maximum(byte_tokens, 1), MEASURES["byte_chars"][1]).astype(np.int64),
        "fallback": (1000 * fallback // some).astype(np.int64),
        "entropy": np.round(1000 * np.maximum(0, np.log2(some) - spread / some), 6).astype(np.int64),
    }


def fertility_measures(documents: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and lang of each document with its base columns and measures.

    A null text counts as one without words; all of its numbers are 0."""
    paths = vocabularies or default_vocabularies()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabularies(*paths)
        names = pa.array(SCRIPTS)
        for batch in batches_of(batches, "text", SLICE):
            found = measure(texts_of(batch), known)
            script = names.take(pa.array(found.pop("script")))
            columns = {"doc_id": batch.column("doc_id"), "lang": batch.column("lang")} | {k: pa.array(v.astype(np.int32 if k == "size" else np.int64)) for k, v in found.items()}
            columns["script"] = script
            order = ["doc_id", "lang", *(c.split()[0] for c in _SCHEMA.split(", "))]
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in order})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id long, lang string, {_SCHEMA}")


def base_failed() -> Column:
    """The rule on words alone: under 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _levels() -> Column:
    """The keys of a text's bands, the closest first."""
    language, size = F.concat(F.lit("lang:"), F.col("lang")), F.col("size").cast("string")
    return F.filter(F.array(F.concat(language, F.lit(":"), size), language, F.concat(F.lit("script:"), F.col("script"))), lambda k: k.isNotNull())


def rejection_bands(measures: DataFrame) -> DataFrame:
    """(key, measure, low, middle, high) from all texts that pass the base rule, for keys with SUPPORT texts.

    Quartiles are the least histogram steps that a quarter, a half and three quarters of the
    texts reach; bounds are whole multiples of a step."""
    each = F.array(*(F.named_struct(F.lit("measure"), F.lit(m), F.lit("value"), F.col(m) - F.col(m) % step) for m, (step, *_) in MEASURES.items()))
    bins = measures.where(~base_failed()).select(F.explode(_levels()).alias("key"), each.alias("each")).select("key", F.explode("each").alias("x")).select("key", "x.*").groupBy("key", "measure", "value").agg(F.count("*").alias("n"))
    by = Window.partitionBy("key", "measure")
    reached = bins.withColumn("upto", F.sum("n").over(by.orderBy("value"))).withColumn("all", F.sum("n").over(by)).where(F.col("all") >= SUPPORT)
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("value")))
    found = reached.groupBy("key", "measure").agg(quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"))
    far, step = FENCE * (F.col("q3") - F.col("q1")), F.create_map(*(x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[0]))))
    return found.select("key", "measure", (F.col("q1") - far).alias("low"), F.col("q2").alias("middle"), (F.col("q3") + far + step[F.col("measure")]).alias("high"))


def _leaves(measure: str, band: Column) -> Column:
    """Whether a measure lies outside a band; false where there is no band."""
    _, _, share, least = MEASURES[measure]
    room = F.greatest(share * band["middle"], F.lit(float(least))) * (1 + F.sqrt(SHORT / F.greatest("n_tokens", F.lit(1))))
    low, high = F.least(band["low"].cast("double"), band["middle"] - room), F.greatest(band["high"].cast("double"), band["middle"] + room)
    return F.coalesce((F.col(measure) < low) | (F.col(measure) > high), F.lit(False))


def quality_rules(documents: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Base columns, measures and verdict of each document.

    kept is false where the base rule fails or a measure leaves its band; a text whose
    language and script have too few texts for a band is judged by the base rule alone. Null
    and empty texts fail the base rule. Repeated rows are judged one by one; extra columns
    are ignored; an empty table gives no rows. The measures are written to the shared folder
    and read twice, for the bands and for the verdicts."""
    measured = cut_lineage(fertility_measures(documents, vocabularies))
    bands = cut_lineage(rejection_bands(measured).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "middle", "high")))).alias("band")))
    (n_bands,) = bands.agg(F.count("*")).first()
    judged, names = measured, fresh_names(measured, "band0", "band1", "band2")
    for i, name in enumerate(names):
        side = bands.select(F.col("key").alias(f"{name}_key"), F.col("band").alias(name))
        judged = judged.join(F.broadcast(side) if n_bands <= 20_000 else side, F.get(_levels(), F.lit(i)) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    band = F.coalesce(*names)
    reasons = F.filter(F.array(*(F.when(_leaves(m, band[m]), F.lit(m)) for m in MEASURES)), lambda r: r.isNotNull())
    judged = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", reasons)
    return judged.select("doc_id", *(c.split()[0] for c in BASE.split(", ")), "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "n_tokens", *MEASURES, F.array_join("rejected_by", ",").alias("rejected_by"))
