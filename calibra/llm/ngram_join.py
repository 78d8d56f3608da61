"""N-gram Jaccard join by T-occurrence search (DivideSkip) over distributed inverted lists.

Two texts link when their shingle sets reach the Jaccard threshold p/q. A text of n shingles
needs T = ceil(n*p/q) shared shingles at least, so with its shingles ordered from the rarest
to the most frequent, T-1 of them can be set aside as long lists and every partner appears in
one of the remaining short lists. Shingles that no other text has come first and have no
list, so most texts drop out as soon as their shared shingles are counted.

1. One pass hashes the texts; equal sets become one set, whose key is 64 bits of a digest of
   the set. 64 further bits are compared wherever keys are equal; should two different sets
   ever have one key, the keys are dealt anew with another seed.
2. A second pass packs (shingle, set) entries by shingle range into byte rows. A range task
   sorts its entries and returns to each set the shingles that others have too, with their
   frequency. A shingle found in many sets of one flush is not sent to its range: its
   entries are echoed under spread keys and a marker makes the whole range treat it as
   frequent, so a passage that a third of all texts quote meets in no single task.
3. Each set that still can link lists its short shingles. Each short list names one leader,
   the set whose shingles are the most shared. A set that links with its leader is absorbed.
   Any two linked sets share a short list, hence a leader.
4. Around a leader only pairs with an unabsorbed set are still open. Blocks of the unabsorbed
   sets are sent as queries to shards of the leader's sets, both of bounded size. A shard merges the short
   lists of a query, keeps sets that occur T-L times, and probes the L long lists for these by
   binary search. Links between sets that the shard has already connected aren't repeated.
5. Connected components of the links.

The links found connect exactly what all links connect. Set sizes and overlaps come from
hashes that mix eight bytes a step (not a polynomial, so regular texts don't collide either):
two different shingles are taken as one with probability 2^-64 within a text and 2^-56 between
texts; two different sets are taken as one with probability 2^-128.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from calibra.llm.common import UnionFind, batches_of, binary_array, cut_lineage, fresh_names, ranges, run_starts, texts_of
from calibra.llm.components import connected_components
from calibra.llm.shingles import mix, set_key, set_keys, shingle_sets

#: Entries that a map task packs before it sends rows; fixes the memory of a task.
FLUSH = 1_000_000
#: Bytes of text that a task hashes at once.
SLICE = 4 << 20
#: Entries that a range task should get.
RANGE = 3_000_000
#: A shingle is frequent if that many of a flush's sets have it, and that share of them.
FREQUENT, FREQUENT_SHARE = 64, 0.01
#: Sets that one shard of a leader or one block of queries holds, and their shingles.
SHARD, SHARD_SHINGLES = 256, 1_000_000
FREQUENT_DF = np.int32(1 << 30)

_SIZES = "doc_id long, n_shingles long, set_key long, set_check long"
_PACKED = "key long, docs binary, sizes binary, toks binary, refs binary, marks binary"
_SHARED = "set_key long, n long, toks binary, dfs binary"


def _needed(n: int, p: int, q: int) -> int:
    return -(-n * p // q)


def pack(toks: np.ndarray) -> bytes:
    """Ascending 56-bit numbers as the first and the steps, of five bytes where these suffice."""
    if not len(toks):
        return b""
    steps = np.diff(toks)
    if len(steps) and int(steps.max()) >> 40:
        return b"\x01" + toks.tobytes()
    return b"\x00" + toks[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    if data[0]:
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 5)
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, :5] = steps
    first = np.frombuffer(data, np.uint64, count=1, offset=1)
    return np.cumsum(np.concatenate([first, wide.reshape(-1).view("<u8")]), dtype=np.uint64)


def set_sizes(docs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, set_key, set_check) of each row; the keys are null for an empty set."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, "text", SLICE):
            sets = shingle_sets(texts_of(batch), k)
            keys = [set_keys(s, seed) if len(s) else (None, None) for s in sets]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in keys], pa.int64()) for i in (0, 1))],
                names=["doc_id", "n_shingles", "set_key", "set_check"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SIZES)


def keyed_sets(docs: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(materialised set_sizes, seed) under a seed that gives different sets different keys."""
    seed = 0
    while True:
        sizes = cut_lineage(set_sizes(docs, k, seed))
        clashes = sizes.where("set_key is not null").groupBy("set_key").agg(F.min("set_check").alias("lo"), F.max("set_check").alias("hi")).where("lo <> hi")
        if clashes.isEmpty():
            return sizes, seed
        seed += 1


def _packed(docs: DataFrame, k: int, n_ranges: int, seed: int) -> DataFrame:
    """Entries (shingle, set) packed by shingle range; keys from n_ranges on hold echoes.

    A row has the keys and sizes of its sets, a token (the upper 56 bits of its hash) and a set
    number for each entry, and the tokens that are frequent."""

    def flush(keys: list[int], sizes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sets:
            return
        toks, refs = np.concatenate(sets) >> np.uint64(8), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(toks, kind="stable")
        toks, refs = toks[order], refs[order]
        cuts = run_starts(toks)
        often = np.diff(cuts) >= max(FREQUENT, FREQUENT_SHARE * len(sets))
        frequent = np.repeat(often, np.diff(cuts))
        marks = toks[cuts[:-1][often]]
        key_arr, size_arr = np.array(keys, np.int64), np.array(sizes, np.int32)
        out: dict[str, list] = {c: [] for c in ("key", "docs", "sizes", "toks", "refs", "marks")}

        def put(key: int, t: np.ndarray, r: np.ndarray, m: np.ndarray) -> None:
            at, back = np.unique(r, return_inverse=True)
            out["key"].append(key)
            out["docs"].append(key_arr[at].tobytes())
            out["sizes"].append(size_arr[at].tobytes())
            out["toks"].append(pack(t))
            out["refs"].append(back.astype(np.uint16).tobytes())
            out["marks"].append(m.tobytes())

        plain_t, plain_r = toks[~frequent], refs[~frequent]
        width = (1 << 56) // n_ranges + 1
        edges = np.array([i * width for i in range(1, n_ranges)], np.uint64)
        parts, mark_parts = np.concatenate([[0], np.searchsorted(plain_t, edges), [len(plain_t)]]), np.concatenate([[0], np.searchsorted(marks, edges), [len(marks)]])
        for i in range(n_ranges):
            a, b, c, d = parts[i], parts[i + 1], mark_parts[i], mark_parts[i + 1]
            if b > a or d > c:
                put(i, plain_t[a:b], plain_r[a:b], marks[c:d])
        if len(marks):
            spread = (mix(key_arr.view(np.uint64)) % np.uint64(n_ranges)).astype(np.int64)[refs[frequent]]
            order = np.argsort(spread, kind="stable")
            t, r, s = toks[frequent][order], refs[frequent][order], spread[order]
            cuts = run_starts(s)
            for a, b in zip(cuts[:-1], cuts[1:]):
                put(n_ranges + int(s[a]), t[a:b], r[a:b], np.zeros(0, np.uint64))
        yield pa.record_batch([pa.array(out["key"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in list(out)[1:])], names=list(out))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, sets, held, total = [], [], [], set(), 0
        for batch in batches_of(rows, "text", SLICE):
            for s in shingle_sets(texts_of(batch), k):
                if len(s) and (key := set_key(s, seed)) not in held:
                    if total + len(s) > FLUSH or len(sets) == 65_000:
                        yield from flush(keys, sizes, sets)
                        keys, sizes, sets, held, total = [], [], [], set(), 0
                    held.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                    sets.append(s)
                    total += len(s)
        yield from flush(keys, sizes, sets)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _PACKED)


def _shared_of_range(n_ranges: int):
    """For each set of a range: its shingles that another set has, and their frequency."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        docs, sizes, toks, refs, marks, at = [], [], [], [], [], 0
        for i in range(table.num_rows):
            d, z, t, r, m = (table.column(c)[i].as_py() for c in ("docs", "sizes", "toks", "refs", "marks"))
            docs.append(np.frombuffer(d, np.int64))
            sizes.append(np.frombuffer(z, np.int32))
            toks.append(unpack(t))
            refs.append(np.frombuffer(r, np.uint16).astype(np.int32) + np.int32(at))
            marks.append(np.frombuffer(m, np.uint64))
            at += len(docs[-1])
        doc, size, tok, ref = np.concatenate(docs), np.concatenate(sizes), np.concatenate(toks), np.concatenate(refs)
        del docs, sizes, toks, refs
        # one number for each set, though several flushes sent it
        uniq, first, number = np.unique(doc, return_index=True, return_inverse=True)
        size, ref = size[first].astype(np.int64), number.astype(np.int32)[ref]
        if key < n_ranges:
            order = np.argsort(tok, kind="stable")
            tok, ref = tok[order], ref[order]
            cuts = run_starts(tok)
            lengths = np.diff(cuts)
            mark = np.unique(np.concatenate(marks))
            frequent = np.isin(tok[cuts[:-1]], mark)
            keep = np.repeat((lengths > 1) | frequent, lengths)
            tok, ref = tok[keep], ref[keep]
            order = np.lexsort((ref, tok))
            tok, ref = tok[order], ref[order]
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (ref[1:] != ref[:-1])
            tok, ref = tok[new], ref[new]
            cuts = run_starts(tok)
            lengths = np.diff(cuts)
            df = np.where(np.isin(tok[cuts[:-1]], mark), FREQUENT_DF, lengths).astype(np.int32)
            keep = np.repeat(df > 1, lengths)
            df = np.repeat(df, lengths)[keep]
            tok, ref = tok[keep], ref[keep]
        else:
            df = np.full(len(tok), FREQUENT_DF, np.int32)
        order = np.argsort(ref, kind="stable")
        tok, ref, df = tok[order], ref[order], df[order]
        cuts = run_starts(ref)
        owner = ref[cuts[:-1]]
        return pa.table({"set_key": pa.array(uniq[owner]), "n": pa.array(size[owner]), "toks": binary_array(tok, cuts), "dfs": binary_array(df, cuts)})

    return run


def _short_lists(p: int, q: int):
    """Sets that can still link: sorted shared shingles, short list, and how shared they are."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {c: [] for c in ("set_key", "n", "toks", "short", "weight")}
            for key, n, toks, dfs in zip(*(batch.column(c).to_pylist() for c in ("set_key", "n", "toks", "dfs"))):
                t, d = np.frombuffer(b"".join(toks), np.uint64), np.frombuffer(b"".join(dfs), np.int32)
                # a shingle may come from its range and as an echo; the echo says that it is frequent
                order = np.lexsort((-d, t))
                t, d = t[order], d[order]
                new = np.ones(len(t), bool)
                new[1:] = t[1:] != t[:-1]
                t, d = t[new], d[new]
                need = _needed(n, p, q)
                if len(t) < need:
                    continue
                short = t[np.lexsort((t, d))[: len(t) - need + 1]]
                out["set_key"].append(key)
                out["n"].append(n)
                out["toks"].append(t.tobytes())
                out["short"].append(short.view(np.int64))
                out["weight"].append(len(t) / n + float(np.minimum(d, 1 << 20).mean()) / (1 << 22))
            yield pa.record_batch([pa.array(out["set_key"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["toks"], pa.binary()), pa.array(out["short"], pa.list_(pa.int64())), pa.array(out["weight"], pa.float64())], names=list(out))

    return run


def _with_leader(p: int, q: int):
    """Whether each set links with its leader."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            linked = []
            for n, toks, m, leads in zip(*(batch.column(c).to_pylist() for c in ("n", "toks", "lead_n", "lead_toks"))):
                if p * max(n, m) > q * min(n, m):
                    linked.append(False)
                    continue
                both = len(np.intersect1d(np.frombuffer(toks, np.uint64), np.frombuffer(leads, np.uint64), assume_unique=True))
                linked.append(q * both >= p * (n + m - both))
            yield pa.record_batch([batch.column("set_key"), batch.column("leader"), batch.column("n"), pa.array(linked, pa.bool_())], names=["set_key", "leader", "n", "linked"])

    return run


def divide_skip(query: np.ndarray, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, p: int, q: int, n: int) -> np.ndarray:
    """Sets of an index that share enough with a query of n shingles.

    tokens is sorted, owner ascends within a token. The longest lists, fewer than the least
    overlap T, are set aside; the others are merged; sets that occur T-L times in these are
    looked up in each long list by binary search."""
    need = _needed(n, p, q)
    lo, hi = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    lengths = hi - lo
    some = lengths > 0
    lo, hi, lengths = lo[some], hi[some], lengths[some]
    if len(lo) < need:
        return np.zeros(0, np.int64)
    order = np.argsort(lengths, kind="stable")
    lo, hi, lengths = lo[order], hi[order], lengths[order]
    n_long = min(need - 1, int(need / (0.02 * np.log2(max(2, lengths[-1])) + 1)))
    n_short = len(lo) - n_long
    merged = owner[ranges(lo[:n_short], lengths[:n_short])]
    counts = np.bincount(merged, minlength=len(sizes))
    found = np.flatnonzero(counts >= max(1, need - n_long))
    found = found[(p * np.maximum(sizes[found], n) <= q * np.minimum(sizes[found], n))]
    counts = counts[found]
    for i in range(len(lo) - 1, n_short - 1, -1):
        if not len(found):
            break
        part = owner[lo[i] : hi[i]]
        at = np.minimum(np.searchsorted(part, found), len(part) - 1)
        counts = counts + (part[at] == found)
        alive = counts + (i - n_short) >= need
        found, counts = found[alive], counts[alive]
    return found[q * counts >= p * (n + sizes[found] - counts)]


def _links_of_shard(p: int, q: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows[~rows["asking"]].drop_duplicates("set_key").sort_values("set_key")
        asks = rows[rows["asking"]].drop_duplicates("set_key")
        if held.empty or asks.empty:
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        parts = [np.frombuffer(t, np.uint64) for t in held["toks"]]
        tokens, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        sizes, keys = held["n"].to_numpy(np.int64), held["set_key"].tolist()
        number = {key: i for i, key in enumerate(keys)}
        for key in asks["set_key"]:
            number.setdefault(key, len(number))
        names, sets, a, b = list(number), UnionFind(len(number)), [], []
        first = np.flatnonzero(held["absorbed"].to_numpy(bool))
        for i in first[1:]:
            sets.union(int(first[0]), int(i))
        for key, n, toks in zip(asks["set_key"], asks["n"], asks["toks"]):
            me = number[key]
            for other in divide_skip(np.frombuffer(toks, np.uint64), tokens, owner, sizes, p, q, int(n)).tolist():
                if sets.union(me, other):
                    a.append(names[me])
                    b.append(names[other])
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return run


def jaccard_links(docs: DataFrame, sizes: DataFrame, k: int, p: int, q: int, seed: int = 0) -> DataFrame:
    """Links (a, b) between set keys that connect what all links of Jaccard >= p/q connect.

    sizes is the (materialised) result of set_sizes for docs under this seed."""
    total = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n_ranges = max(16, -(-int(total) // RANGE))
    shared = _packed(docs, k, n_ranges, seed).groupBy("key").applyInArrow(_shared_of_range(n_ranges), _SHARED)
    gathered = (
        shared.groupBy("set_key", "n").agg(F.collect_list("toks").alias("toks"), F.collect_list("dfs").alias("dfs"), F.sum(F.octet_length("toks")).alias("bytes"))
        .where(F.col("bytes") / 8 * q >= F.col("n") * p)
        .drop("bytes")
    )
    live = cut_lineage(gathered.mapInArrow(_short_lists(p, q), "set_key long, n long, toks binary, short array<long>, weight double"))

    entries = live.select(F.explode("short").alias("tok"), "set_key", "weight")
    lists = entries.groupBy("tok").agg(F.max_by("set_key", F.struct("weight", "set_key")).alias("leader"), F.count("*").alias("length")).where("length > 1")
    stars = entries.join(lists, "tok").select("set_key", "leader").distinct()
    members = stars.where("set_key <> leader").join(live.select("set_key", "n", "toks"), "set_key")
    leaders = live.select(F.col("set_key").alias("leader"), F.col("n").alias("lead_n"), F.col("toks").alias("lead_toks"))
    verdict = cut_lineage(members.join(leaders, "leader").mapInArrow(_with_leader(p, q), "set_key long, leader long, n long, linked boolean"))

    # pairs with a set that its leader doesn't link with are still open
    blocks = lambda sets, shingles: F.ceil(F.greatest(sets / SHARD, shingles / SHARD_SHINGLES)).cast("long")
    loose, zero = ~F.col("linked"), F.lit(0).cast("long")
    open_stars = verdict.groupBy("leader").agg(
        blocks(F.count("*"), F.sum("n")).alias("shards"), blocks(F.count_if(loose), F.sum(F.when(loose, F.col("n")).otherwise(0))).alias("asks"), F.count("*").alias("size")
    ).where("asks > 0 and size > 1")
    around = verdict.join(open_stars, "leader").withColumn("hash", F.xxhash64("set_key"))
    number = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    held = around.select("leader", "set_key", F.col("linked").alias("absorbed"), F.lit(False).alias("asking"), F.pmod("hash", "shards").alias("shard"), number("asks").alias("part"))
    asks = around.where(loose).select("leader", "set_key", F.lit(False).alias("absorbed"), F.lit(True).alias("asking"), number("shards").alias("shard"), F.pmod("hash", "asks").alias("part"))
    found = held.union(asks).join(live.select("set_key", "n", "toks"), "set_key").groupBy("leader", "shard", "part").applyInPandas(_links_of_shard(p, q), "a long, b long")
    return verdict.where("linked").select(F.col("set_key").alias("a"), F.col("leader").alias("b")).union(found)


def ngram_jaccard_classes(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of each text under Jaccard >= p/q of k-word shingles.

    Every input row gives one row. component_id is the smallest doc_id of the class. A null,
    empty or blank text has an empty set and is its own class. A text with fewer than k words
    has one shingle, its whole word sequence. Equal texts are in one class; rows that repeat a
    doc_id are returned as often as they come. A row without doc_id takes part; its class id is
    the smallest doc_id in its class, or null. Other columns are ignored; an empty table gives
    an empty result."""
    return _classes(docs, k, p, q).select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def _classes(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, set_check, first) of each row; first is the least (doc_id, set_key) of its class."""
    sizes, seed = keyed_sets(docs, k)
    links = jaccard_links(docs, sizes, k, p, q, seed)
    classes = connected_components(links)
    least = sizes.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rooted = least.join(classes.select(F.col("node").alias("set_key"), F.col("component").alias("root")), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    firsts = rooted.groupBy("root").agg(F.min(F.when(F.col("least").isNotNull(), F.struct(F.col("least").alias("doc_id"), "set_key"))).alias("first"))
    per_set = rooted.join(firsts, "root").select("set_key", "first")
    return sizes.join(per_set, "set_key", "left").select("doc_id", "n_shingles", "set_key", "set_check", "first")


def with_set_check(docs: DataFrame, k: int, name: str) -> DataFrame:
    """docs and a column of that name, the seedless key of each row's shingle set (null for an empty set)."""
    at = docs.columns.index("text")

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, "text", SLICE):
            sets = shingle_sets([t or "" for t in batch.column(at).to_pylist()], k)
            yield pa.record_batch([*batch.columns, pa.array([set_keys(s)[1] if len(s) else None for s in sets], pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each_class(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """The row with the smallest (doc_id, set key) of each class; all columns stay as they are.

    Documents without words or without doc_id stay. Of rows that repeat the doc_id and the
    shingles (or the wordless text) of one document one stays. Rows that share a doc_id but
    not a class are decided one by one. Other columns may have any name but doc_id and text;
    an empty table gives an empty result."""
    classes = cut_lineage(_classes(docs, k, p, q))
    lost = classes.where("doc_id is not null and set_key is not null and (doc_id <> first.doc_id or set_key <> first.set_key)").select("doc_id", "set_check")
    repeated = cut_lineage(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs.join(lost.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    set_, words = fresh_names(docs, "set", "words")
    kept = docs.join(lost.select("doc_id").union(repeated).distinct(), "doc_id", "left_anti").select(*docs.columns)
    some = with_set_check(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns), k, set_)
    once = some.join(lost.select("doc_id", F.col("set_check").alias(set_)), ["doc_id", set_], "left_anti")
    once = once.withColumn(words, F.when(F.col(set_).isNull(), F.col("text"))).dropDuplicates(["doc_id", set_, words])
    return kept.unionByName(once.select(*docs.columns))
