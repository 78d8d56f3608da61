"""BPE encoding and decoding with a pair occurrence index.

A task takes a batch of texts, splits them into pieces and lists the different new pieces of
the batch (told apart by their bytes) one after the other as one symbol array with links to the left and right
neighbour. An index maps each mergeable pair, by its rank, to all its positions in that
array. Ranks are applied in ascending order: all occurrences of the lowest active rank are
merged at once, and the pairs that arise left and right of them are added to the lists of
their ranks. A pair that contains a merged symbol has a higher rank than the merge that made
the symbol, so no rank comes up again.

Split pattern, byte alphabet and special tokens are those of the tokenizer file.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, ranges, run_starts, texts_of
from calibra.llm.shingles import eights, load, mix


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    chars, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + extra)
            extra += 1
    return [chars[b] for b in range(256)]


#: Pieces whose ids a worker keeps from batch to batch; beyond them it starts afresh.
KNOWN = 250_000
#: Bytes of text encoded together, characters split at once, tokens decoded at once.
SLICE, SPLIT, DECODE = 4 << 20, 1 << 20, 1 << 18
#: Pieces of so many bytes are kept as two numbers; longer ones are told apart one by one.
SHORT = 16
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_CUT = re.compile("(?<=[a-z]) (?=[a-z])")


@functools.lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    """Class of every code point under the split pattern."""
    kinds = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return kinds


class PairIndexBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.of_byte = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.base = max(vocab.values()) + 2
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        parts: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in special}
        parts |= {i: token.encode() for token, i in special.items()}
        size = max(parts) + 1
        lengths = np.array([len(parts.get(i, b"")) for i in range(size)], np.int64)
        self.token_bytes = np.frombuffer(b"".join(parts.get(i, b"") for i in range(size)), np.uint8)
        self.token_at, self.token_len = np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths
        self.kinds = char_kinds()
        self._forget()
        self.special_splitter = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None

    def _forget(self) -> None:
        """Empty the pieces kept: key, first and second eight bytes, length; place and number of ids."""
        self.known = np.zeros((3, 0), np.uint64)
        self.known_bytes = self.known_at = self.known_len = np.zeros(0, np.int64)
        self.known_ids = np.zeros(0, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, start of each piece and the end)."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sym = self.of_byte[data[ranges(starts, lengths)]]
        n = len(sym)
        piece = np.repeat(np.arange(len(starts)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.concatenate([piece[1:] != piece[:-1], [True]])
        after[ends] = -1
        before[np.concatenate([[True], ends[:-1]])] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            """Add the pairs that begin at these positions to the lists of their ranks."""
            at = at[after[at] >= 0]
            if not len(at):
                return
            rank = self._rank(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = run_starts(rank)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b > a:
                    r = int(rank[a])
                    if r not in lists:
                        lists[r] = []
                        heapq.heappush(active, r)
                    lists[r].append(at[a:b])

        index(np.arange(n))
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            left, right = self.left[r], self.right[r]
            if left == right:
                at = np.unique(at)
            at = at[alive[at] & (sym[at] == left) & (after[at] >= 0)]
            at = at[sym[after[at]] == right]
            if left == right and len(at) > 1:
                # in a run of equal symbols every second pair, from the left, is merged
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                first = np.maximum.accumulate(np.where(joined, -1, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.made[r]
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            before[nxt[nxt >= 0]] = at[nxt >= 0]
            prev = before[at]
            index(np.concatenate([at, prev[prev >= 0]]))
        counts = np.bincount(piece[alive], minlength=len(starts))
        return sym[alive], np.concatenate([[0], np.cumsum(counts)])

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, start byte of each piece, number of pieces of each text).

        Character classes decide where pieces begin: a run of letters, of numbers or of other
        characters takes one space before it; the last character of a white-space run is cut
        off if something follows; an apostrophe that no space or sign comes before takes the
        endings s, t, m, d, re, ve, ll with it."""
        data = "".join(texts).encode("utf-32-le")
        code = np.frombuffer(data, np.uint32)
        n = len(code)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not n:
            return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.kinds[code]
        first = np.zeros(n + 1, bool)
        first[np.concatenate([[0], np.cumsum(sizes)])] = True
        begins = first[:-1].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        ends_text = first[1:]
        # the last character of a white-space run with something after it
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~ends_text[:-1]
        begins |= last
        joins = np.flatnonzero(last & (code == 32)) + 1
        begins[joins] = False
        # endings after an apostrophe
        quote = np.flatnonzero((code == 39) & begins)
        if len(quote):
            after = lambda d, c: (quote + d < n) & (code[np.minimum(quote + d, n - 1)] == ord(c)) & ~first[np.minimum(quote + d, n)]
            one = after(1, "s") | after(1, "t") | after(1, "m") | after(1, "d")
            two = (after(1, "r") & after(2, "e")) | (after(1, "v") & after(2, "e")) | (after(1, "l") & after(2, "l"))
            length = np.where(two, 3, np.where(one, 2, 0))
            # a run of several signs isn't an apostrophe with an ending; its next character is no letter
            quote, length = quote[length > 0], length[length > 0]
            begins[quote + 1] = False
            stop = quote + length
            begins[stop[stop < n]] |= ~space[stop[stop < n]]
        widths = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(widths)])
        starts = np.flatnonzero(begins)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(np.searchsorted(starts, edges))
        return np.frombuffer("".join(texts).encode(), np.uint8), at[starts], counts

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts and 8 spare ones, start and length of each piece, pieces of each text).

        Texts are split in groups; a text of more than SPLIT characters is cut before a space
        between two letters a-z, where a piece always begins."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > SPLIT and (m := _CUT.search(text, at + SPLIT)):
                parts.append(text[at : m.start()])
                owner.append(i)
                at = m.start()
            parts.append(text[at:])
            owner.append(i)
        data, starts, per, size, at = [], [], np.zeros(len(texts), np.int64), 0, 0
        while at < len(parts):
            to, total = at + 1, len(parts[at])
            while to < len(parts) and total + len(parts[to]) <= SPLIT:
                total += len(parts[to])
                to += 1
            own, begin, counts = self.split(parts[at:to])
            data.append(own)
            starts.append(begin + size)
            np.add.at(per, owner[at:to], counts)
            size, at = size + len(own), to
        data.append(np.zeros(8, np.uint8))
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return np.concatenate(data), start, np.diff(np.concatenate([start, [size]])), per

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if self.special_splitter and any(t in text for t in self.special for text in texts):
            return self._with_specials(texts)
        data, starts, lengths, per = self.pieces(texts)
        n = len(starts)
        if not n:
            return [np.zeros(0, np.int32) for _ in texts]
        # short pieces are equal if both halves and the length are; the key only finds them
        short = np.flatnonzero(lengths <= SHORT)
        size, rows = lengths[short], eights(data)
        halves = np.stack([load(rows, starts[short], size), load(rows, np.minimum(starts[short] + 8, len(data) - 8), size - 8)])
        with np.errstate(over="ignore"):
            key = mix(mix(halves[0] + size.astype(np.uint64)) + halves[1])
        keys, first, number = np.unique(key, return_index=True, return_inverse=True)
        same = (halves == halves[:, first[number]]).all(0) & (size == size[first[number]])
        at = np.minimum(np.searchsorted(self.known[0], keys), max(0, self.known.shape[1] - 1))
        hit = np.zeros(len(keys), bool)
        if self.known.shape[1]:
            hit = (self.known[:, at] == np.stack([keys, *halves[:, first]])).all(0) & (self.known_bytes[at] == size[first])
        fresh = np.flatnonzero(~hit)
        # all others, among them pieces whose key is another one's, by their bytes
        others: dict[bytes, tuple[int, int]] = {}
        rest = np.concatenate([np.flatnonzero(lengths > SHORT), short[~same]])
        of_rest = [others.setdefault(data[starts[i] : starts[i] + lengths[i]].tobytes(), (len(others), i))[0] for i in rest.tolist()]
        spans = np.concatenate([short[first[fresh]], np.array([i for _, i in others.values()], np.int64)])
        flat, cuts = self.encode_spans(data, starts[spans], lengths[spans])
        flat, shift = flat.astype(np.int32), len(self.known_ids)
        ids_of = np.concatenate([self.known_ids, flat])
        begin, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        own_at, own_len = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        own_at[hit], own_len[hit] = self.known_at[at[hit]], self.known_len[at[hit]]
        own_at[fresh], own_len[fresh] = cuts[: len(fresh)] + shift, np.diff(cuts[: len(fresh) + 1])
        begin[short], count[short] = own_at[number], own_len[number]
        begin[rest], count[rest] = (cuts[:-1] + shift)[len(fresh) :][of_rest], np.diff(cuts)[len(fresh) :][of_rest]
        ids = ids_of[ranges(begin, count)]
        if self.known.shape[1] + len(fresh) > KNOWN:
            self._forget()
        else:
            self._keep(np.stack([keys[fresh], *halves[:, first[fresh]]]), size[first[fresh]], own_at[fresh], own_len[fresh], ids_of[: shift + int(cuts[len(fresh)])])
        tokens = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(per)])]
        return [ids[a:b] for a, b in zip(tokens[:-1].tolist(), tokens[1:].tolist())]

    def _keep(self, key: np.ndarray, size: np.ndarray, at: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Add new pieces to those kept, in the order of their keys."""
        order = np.argsort(np.concatenate([self.known[0], key[0]]), kind="stable")
        self.known, self.known_ids = np.hstack([self.known, key])[:, order], ids
        self.known_bytes, self.known_at, self.known_len = (np.concatenate(x)[order] for x in ((self.known_bytes, size), (self.known_at, at), (self.known_len, length)))

    def _with_specials(self, texts: list[str]) -> list[np.ndarray]:
        """The same for texts that hold special tokens: these are cut out first."""
        parts = [self.special_splitter.split(t) for t in texts]
        plain = iter(self.encode_batch_plain([x for p in parts for x in p if x not in self.special]))
        return [np.concatenate([np.array([self.special[x]], np.int32) if x in self.special else next(plain) for x in p]) for p in parts]

    def encode_batch_plain(self, texts: list[str]) -> list[np.ndarray]:
        held, self.special_splitter = self.special_splitter, None
        try:
            return self.encode_batch(texts)
        finally:
            self.special_splitter = held

    def decode(self, ids: np.ndarray) -> str:
        """Text of a token sequence; bytes that are no UTF-8 become U+FFFD."""
        parts = (ids[i : i + DECODE] for i in range(0, len(ids), DECODE))
        return b"".join(self.token_bytes[ranges(self.token_at[x], self.token_len[x])].tobytes() for x in parts).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def _bpe(path: str) -> PairIndexBpe:
    """The encoder of a worker process."""
    return PairIndexBpe(path)


def bpe_encode(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256, decoded, decoded_sha256) of each row.

    A null or empty text has no tokens and decodes to the empty text. Rows come out as they
    go in, repeated ones too; doc_id may be null; other columns are ignored. ids and decoded
    are left out unless with_ids; the columns in keep are passed on at the end. tokenizer is the
    path of a byte-level BPE file that every executor has."""
    path = tokenizer or default_tokenizer()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches_of(rows, "text", SLICE):
            out: dict[str, list] = {c: [] for c in ("n", "ids", "ids_sha", "text", "text_sha")}
            for ids in bpe.encode_batch(texts_of(batch)):
                text = bpe.decode(ids)
                out["n"].append(len(ids))
                out["ids_sha"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["text_sha"].append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(ids.astype(np.int32))
                    out["text"].append(text)
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(out["n"], pa.int64())}
            if with_ids:
                cols |= {"ids": pa.array(out["ids"], pa.list_(pa.int32())), "decoded": pa.array(out["text"], pa.string())}
            cols |= {"ids_sha256": pa.array(out["ids_sha"], pa.string()), "decoded_sha256": pa.array(out["text_sha"], pa.string())}
            cols |= {c: batch.column(c) for c in keep}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    schema = "doc_id long, n_tokens long, " + "ids array<int>, decoded string, " * with_ids + "ids_sha256 string, decoded_sha256 string" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep).mapInArrow(run, schema)


def bpe_decode(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids array<int>); null ids give the empty text."""
    path = tokenizer or default_tokenizer()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in rows:
            texts = [bpe.decode(np.asarray(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
