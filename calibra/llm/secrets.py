"""Secret scan with a trigram inverted index.

Each rule's regex is parsed once and turned into a Boolean trigram query: a sequence asks for
all its parts (AND), alternatives for one of theirs (OR), and literal runs for each of their
trigrams, in lower case. Every task builds the postings of the trigrams that occur in some
query for each batch of texts (a segment), evaluates the queries by intersecting and uniting
postings, and runs a rule's regex only on its candidates. A rule whose query has no mandatory
trigram scans every text.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as regex_parser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import batches_of, run_starts, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group: the group whose length counts; least: its least length."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = True


_BREAK, _KEY = r"(?:[\x20\t\r\n]|\\[rn])", "(?:RSA |EC |OPENSSH |DSA |ENCRYPTED |)PRIVATE KEY-----"
#: A key from its first line to its last: headers, lines of base64, with line breaks or their
#: escapes between them. Of a key that is cut off, the lines that are there.
PRIVATE_KEY = f"-----BEGIN {_KEY}(?:{_BREAK}+[A-Za-z-]+:\\x20[^\\r\\n\\\\]*)*(?:{_BREAK}+[A-Za-z0-9+/=]{{16,}})*(?:{_BREAK}*(?:[A-Za-z0-9+/=]+{_BREAK}*)?-----END {_KEY})?"

# The base kinds, then the kinds that the method adds. A match of hex is a whole
# run of its characters, so its least length can stand in the pattern. The added patterns are
# possessive, begin at the edge of a run or have parts of bounded length, so that a long run
# which is no match is read once.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", PRIVATE_KEY, 1, 0, False),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 1, 0, False),
    Rule("repo_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 1, 0, False),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0, False),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 1, 0, False),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[^\s:/@]++:[^\s:/@]++@[A-Za-z0-9.-]++", 1, 0, False),
)

#: A query is True (no mandatory trigram), a trigram string, or ("and" | "or", parts).
Query = bool | str | tuple


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _one_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query that each text with a match satisfies."""

    def literal(run: str) -> Query:
        low = run.lower()
        return _all_of([low[i : i + 3] for i in range(len(low) - 2)]) if low.isascii() else True

    def spellings(node) -> list[str] | None:
        """All texts that a short node can match, or None."""
        op, arg = node
        if op is C.LITERAL:
            return [chr(arg)]
        if op is C.IN and len(arg) <= 8 and all(x[0] is C.LITERAL for x in arg):
            return [chr(x[1]) for x in arg]
        if op is C.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and len(arg[2]) == 1:
            own = spellings(arg[2][0])
            return None if own is None else ["", *own]
        return None

    def of(seq) -> Query:
        runs, parts = [""], []

        def close() -> None:
            parts.append(_one_of([literal(r) for r in runs]))
            runs[:] = [""]

        for op, arg in seq:
            own = spellings((op, arg))
            if own is not None and len(runs) * len(own) <= 16:
                runs[:] = [r + x for r in runs for x in own]
                continue
            if op is C.MAX_REPEAT and arg[0] >= 1 and len(arg[2]) == 1 and arg[2][0][0] is C.LITERAL:
                runs[:] = [r + chr(arg[2][0][1]) * arg[0] for r in runs]
                close()
                continue
            close()
            if op is C.SUBPATTERN:
                parts.append(of(arg[-1]))
            elif op is C.BRANCH:
                parts.append(_one_of([of(b) for b in arg[1]]))
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                parts.append(of(arg[2]))
        close()
        return _all_of(parts)

    return of(regex_parser.parse(pattern))


def _trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


class SecretScanner:
    """Rules compiled once a task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.plans = [trigram_query(r.pattern) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        grams = sorted(set().union(*map(_trigrams, self.plans)))
        self.slot = {g: i for i, g in enumerate(grams)}
        self.lookup = np.full(1 << 24, -1, np.int16)
        for g, i in self.slot.items():
            self.lookup[(ord(g[0]) << 16) | (ord(g[1]) << 8) | ord(g[2])] = i

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each trigram of the queries: the texts that have it, ascending."""
        raw = [t.encode() for t in texts]
        b = np.frombuffer(b"\x00".join(raw), np.uint8).copy()
        b[(b >= 65) & (b <= 90)] += 32
        if len(b) < 3:
            return [np.zeros(0, np.int64) for _ in self.slot]
        slots = self.lookup[(b[:-2].astype(np.int32) << 16) | (b[1:-1].astype(np.int32) << 8) | b[2:]]
        at = np.flatnonzero(slots >= 0)
        text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), at, "right")
        pairs = np.unique(slots[at].astype(np.int64) * len(texts) + text)
        gram, text = pairs // len(texts), pairs % len(texts)
        cuts = np.searchsorted(gram, np.arange(len(self.slot) + 1))
        return [text[cuts[i] : cuts[i + 1]] for i in range(len(self.slot))]

    def candidates(self, q: Query, posts: list[np.ndarray], n: int) -> np.ndarray:
        if q is True:
            return np.arange(n)
        if isinstance(q, str):
            return posts[self.slot[q]]
        parts = [self.candidates(x, posts, n) for x in q[1]]
        if q[0] == "or":
            return np.unique(np.concatenate(parts))
        found = min(parts, key=len)
        for x in parts:
            found = np.intersect1d(found, x, assume_unique=True)
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Of each text: (start, rule, end) of its matches by start and rule, code points, end exclusive."""
        posts, out = self.postings(texts), [[] for _ in texts]
        for r, (rule, rx, plan) in enumerate(zip(self.rules, self.compiled, self.plans)):
            for i in self.candidates(plan, posts, len(texts)).tolist():
                for m in rx.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), r, m.end()))
        for spans in out:
            spans.sort()
        return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) of each row; offsets in code points.

    A null or empty text has no spans. Rows come out as they go in; doc_id may be null; other
    columns are ignored; an empty table gives an empty result. Spans of different kinds may overlap."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches_of(rows, "text", 2 << 20):
            found = [[{"kind": rules[r].kind, "start": s, "end": e, "base": rules[r].base} for s, r, e in spans] for spans in scanner.scan(texts_of(batch))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with the secrets in its text replaced by a mark and n_chars recounted where text changed.

    The body of a private key goes with its first and last line; of a URL with a login, the
    login, the scheme and the host go together.

    All columns stay, in their order and types, whatever other names they have; texts without a
    secret stay as they are, null ones null. Repeated rows are treated alike; an empty table gives an empty result."""
    at, count = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rules)
        for batch in batches_of(rows, text, 2 << 20):
            old = batch.column(at).to_pylist()
            spans = scanner.scan([t or "" for t in old])
            new = [redact(t, s) if s else t for t, s in zip(old, spans)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if count is not None:
                cols[count] = pa.array([len(t) if s else c for t, s, c in zip(new, spans, cols[count].to_pylist())], cols[count].type)
            yield pa.record_batch(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as text and their number.

    One row for each row of docs, with the cases of find_secrets: a null or empty text counts
    nothing and has the digest of the empty text."""
    found = find_secrets(docs, rules)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in rules if r.base]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
