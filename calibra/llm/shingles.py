"""Word-shingle sets of texts as sorted 64-bit hashes, computed on the UTF-8 bytes of a batch.

Words are runs of bytes other than space and 0x09-0x0D after A-Z became a-z; both sets are
ASCII, so working on bytes is the same as working on code points. A word's hash takes its bytes
by eights: each step adds the next eight to the state and mixes it by a 64-bit bijection, so
words of one length up to eight bytes never collide and longer ones collide by chance only,
however regular they are. Words over LONG bytes are hashed by BLAKE2. A shingle's hash chains
the hashes of its words in the same way.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_PIECE = 1 << 21
#: Bytes of a word that are hashed step by step for all words of a batch at once.
LONG = 64
#: Mask of the first n bytes of eight.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(b: np.ndarray) -> np.ndarray:
    """A view of a byte buffer whose row i is bytes i to i+8; the buffer must end with 8 spare bytes."""
    return np.lib.stride_tricks.as_strided(b, (max(0, len(b) - 7), 8), (1, 1), writeable=False)


def load(rows: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each position on as a number; bytes past a length are zero."""
    return rows[at].view(np.uint64).ravel() & _FIRST[np.clip(lengths, 0, 8)]


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of each word of a byte buffer."""
    b = np.concatenate([buf, np.full(8, 32, np.uint8)])
    b[(b >= 65) & (b <= 90)] += 32
    solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[False], solid]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, span_hashes(b, starts, ends - starts)


def span_hashes(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each span of a byte buffer that ends with 8 spare bytes."""
    with np.errstate(over="ignore"):
        h = mix(lengths.astype(np.uint64) * _STEP + _BASE)
        rows, active = eights(b), np.flatnonzero(lengths <= LONG)
        at, left = starts[active], lengths[active]
        while len(active):
            h[active] = mix(h[active] + load(rows, at, left))
            more = left > 8
            active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        h[i] = int.from_bytes(blake2b(b[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _pieces(data: bytes) -> list[bytes]:
    """Parts of about _PIECE bytes that end where a word ends."""
    out, at = [], 0
    while len(data) - at > _PIECE:
        cut = at + _PIECE
        while cut < len(data) and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def _chain(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each first on."""
    with np.errstate(over="ignore"):
        h = mix(words[first] + np.uint64(k) * _BASE)
        for j in range(1, k):
            h = mix(h * _STEP + words[first + j])
        return h


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text.

    A text of fewer than k words gives its whole word sequence as one shingle, one without
    words an empty set."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        to, total = at, 0
        while to < len(raw) and (to == at or total + len(raw[to]) <= _PIECE):
            total += len(raw[to]) + 1
            to += 1
        group = raw[at:to]
        if len(group) == 1 and len(group[0]) > _PIECE:
            words = np.concatenate([word_hashes(np.frombuffer(p, np.uint8))[1] for p in _pieces(group[0])])
            begins = np.array([0, len(words)])
        else:
            starts, words = word_hashes(np.frombuffer(b" ".join(group), np.uint8)) if total > len(group) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            begins = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in group])]))
        last = np.maximum(begins[1:] - k + 1, begins[:-1])
        if len(words) >= k:
            whole = _chain(words, np.arange(len(words) - k + 1), k)
        else:
            whole = np.zeros(0, np.uint64)
        for b, e, stop in zip(begins[:-1].tolist(), begins[1:].tolist(), last.tolist()):
            if e - b >= k:
                s = np.sort(whole[b:stop])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif e > b:
                out.append(_chain(words, np.array([b]), e - b))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def set_key(s: np.ndarray, seed: int = 0) -> int:
    """64-bit key of a set, as a signed long: a digest of its sorted hashes."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)


def set_keys(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """The key of a set and 64 further bits of the same strength."""
    return set_key(s, seed), int.from_bytes(blake2b(s.tobytes(), digest_size=8, person=b"check").digest(), "little", signed=True)
