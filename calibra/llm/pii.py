"""Personal data by base patterns and bootstrapped contexts, with SQL functions only.

Base entities are found by regex; their offsets follow from the lengths of the matches and of
the pieces between them. The patterns are written so that Java's matcher neither recurses nor
scans a run twice: runs are possessive, and a match begins at the start of a run or where the
match before it ended.

The method adds spans in contexts. Each token that holds a digit or an at sign, with a word next
to it, is an edge of a graph of lexical patterns (that word and its side) and instances (the
token). Base entities are the first seeds. In each round a pattern's confidence for a kind is
the mean score of its instances; an instance of the kind's shape scores the noisy-or of its
patterns' confidences. An instance that scores SURE or more counts as a seed from then on, so
patterns that no base entity supports can come in by what others have found. Patterns with
enough different seeds, a high confidence and a clear lift over the kind's base rate are
trusted, and identifiers next to them are found in all texts by a join with these patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import cut_lineage

# The base patterns, in order of their kinds. Each equals the plain pattern in its
# comment; \G and the look-behind only keep a match from beginning inside a run that failed.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ with 14 digits at least
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap test that a text can have a kind at all.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Shapes that an unseen identifier of a kind may have.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]++\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]++)*+",
    "ip": r"[0-9]{1,3}+(?:[.:\[\]-]++[0-9]{1,3}+){3}+",
    "card": r"[0-9](?:[ ./-]?[0-9]){11,18}+",
    "phone": r"\(?+[0-9](?:[ ()./-]{0,2}+[0-9]){6,14}+",
}
#: Rounds of scoring, different seeds that a pattern needs, its confidence and lift, the score of a seed.
ROUNDS, SEEDS, CONFIDENCE, LIFT, SURE = 4, 8, 0.6, 3.0, 0.5
#: Matches of a text that are placed together.
CHUNK = 1024
_NONE = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"
#: A word and the identifier after it: a spelled-out address, a number with blanks, or a token
#: with a digit or at sign. Group 1 is the word after these.
_EDGE = (
    r"(?<!\S)[^\s0-9@]++\s(?:[A-Za-z0-9._%+-]++\s?[(\[]at[)\]]\s?[A-Za-z0-9-]++(?:\s?(?:\.|[(\[]dot[)\]])\s?[A-Za-z0-9-]++)*+|[+(]{0,2}+[0-9](?:[ ()./-]{0,2}+[0-9]){6,}+|(?=[^\s0-9@]*+[0-9@])\S++)"
    r"(?:(?=\s([^\s0-9@]++))|)"
)


def _offsets(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Array of (start, ord, kind, end, value) of all matches; code points, end exclusive.

    Pieces and matches are folded in chunks, so that a text of very many matches costs no
    square of their number. The array of all is bound to a variable to be evaluated once."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m"))
    kind_of = "struct<p:string,m:string>"

    def after(at: Column, x: Column) -> Column:
        return at + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def place(acc: Column, chunk: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("at"), chunk.alias("chunk")))
        return F.struct(F.aggregate(chunk, acc["at"], after).alias("at"), F.concat(acc["placed"], one).alias("placed"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))
        return F.struct(after(acc["at"], x).alias("at"), F.when(x["m"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    def spans(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_, i * CHUNK + 1, CHUNK))
        placed = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,chunk:array<{kind_of}>>>").alias("placed")), place)["placed"]
        return F.flatten(F.transform(placed, lambda c: F.aggregate(c["chunk"], F.struct(c["at"].alias("at"), F.array().cast(_NONE).alias("spans")), add)["spans"]))

    return F.element_at(F.transform(F.array(zipped), spans), 1)


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _valid(kind: str):
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare) > 3, 999).when(bare == "", 0).otherwise(bare.cast("int")) <= 255)

    def ok(span: Column) -> Column:
        digits = F.regexp_replace(span["value"], "[^0-9]", "")
        if kind == "ip":
            return F.forall(F.split(span["value"], r"\."), small)
        if kind == "card":
            return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn_ok(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(10, 15)
        return F.lit(True)

    return ok


def base_spans(text: Column) -> Column:
    """All valid base entities of a text by start, then kind."""
    parts = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        hint = F.contains(text, F.lit(HINT[kind])) if HINT[kind] else F.lit(True)
        some = hint & text.rlike(pattern)
        parts.append(F.when(some, F.filter(_offsets(text, pattern, kind, order), _valid(kind))).otherwise(F.array().cast(_NONE)))
    return F.array_sort(F.concat(*parts))


def _edges(docs: DataFrame) -> DataFrame:
    """(digest, start, end, instance, pattern) of each identifier-like token and each word next to it.

    digest stands for the text; pattern is the word in lower case behind its side."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.arrays_zip(_offsets(text, _EDGE, "edge", 0).alias("span"), F.regexp_extract_all(text, F.lit(_EDGE), 1).alias("after"))
    rows = docs.where(text.rlike("[0-9@]")).select(F.sha2(text, 256).alias("digest"), F.explode(found).alias("x"))
    before = F.regexp_extract("x.span.value", r"^(\S+)", 1)
    bare = F.regexp_replace(F.regexp_replace("x.span.value", r"^\S+\s", ""), r"[.,;!?)\]'\"&%$*#]+$", "")
    start = F.col("x.span.start") + F.length(before) + 1
    one = rows.select("digest", start.alias("start"), bare.alias("instance"), F.array(F.concat(F.lit("before "), F.lower(before)), F.when(F.col("x.after") != "", F.concat(F.lit("after "), F.lower("x.after")))).alias("sides"))
    return one.where("instance <> ''").select("digest", "start", (F.col("start") + F.length("instance")).alias("end"), "instance", F.explode(F.array_compact("sides")).alias("pattern"))


def _has_shape(kind: Column, instance: Column) -> Column:
    """Whether an instance has the shape of a kind."""
    out = F.lit(False)
    for k, shape in SHAPES.items():
        out = F.when(kind == k, instance.rlike(f"^(?:{shape})$")).otherwise(out)
    return out


def learn_contexts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, confidence) of the trusted patterns; many collections have none."""
    graph = cut_lineage(_edges(docs).select("pattern", "instance").distinct())
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("instance").rlike(BASE[k]).cast("double").alias("seed"), F.col("instance").rlike(f"^(?:{SHAPES[k]})$").alias("shaped")) for k in BASE])
    own = graph.select("pattern", "instance", F.explode(F.filter(kinds, lambda k: k["shaped"] | (k["seed"] > 0))).alias("k")).select("pattern", "instance", "k.kind", "k.seed")
    own = cut_lineage(own)
    all_ = graph.groupBy("pattern").agg(F.count("*").alias("all"))
    rates = own.groupBy("kind").agg(F.sum("seed").alias("rate")).crossJoin(graph.agg(F.count("*").alias("edges"))).select("kind", (F.col("rate") / F.col("edges")).alias("rate"))  # a row a kind, with one row
    score = own.withColumn("score", F.col("seed"))
    for round_ in range(rounds):
        sums = score.groupBy("kind", "pattern").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= SURE).alias("seeds")).where(F.col("seeds") >= SEEDS)
        confidence = sums.join(all_, "pattern").select("kind", "pattern", (F.col("mass") / (F.col("all") + 1)).alias("confidence"))
        if round_ + 1 == rounds:
            break
        lifted = own.join(confidence, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))).alias("lifted"))
        score = cut_lineage(own.join(lifted, ["kind", "instance"], "left").select("kind", "pattern", "instance", F.greatest("seed", F.coalesce("lifted", F.lit(0.0))).alias("score")))
    good = confidence.join(rates, "kind").where((F.col("confidence") >= CONFIDENCE) & (F.col("confidence") >= LIFT * F.col("rate")))
    return cut_lineage(good.select("kind", "pattern", "confidence"))


def context_spans(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(digest, more): the identifiers next to trusted patterns in each text that has some."""
    near = _edges(docs).join(trusted.select("kind", "pattern"), "pattern").where(_has_shape(F.col("kind"), F.col("instance")))
    order = F.array_position(F.array(*map(F.lit, BASE)), F.col("kind")).cast("int") - 1 + len(BASE)
    span = F.struct(F.col("start"), order.alias("ord"), F.concat("kind", F.lit("_context")).alias("kind"), F.col("end"), F.col("instance").alias("value"))
    return near.groupBy("digest").agg(F.collect_set(span).alias("more"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of (start, ord, kind, end, value).

    spans has the base entities and those that contexts add outside of them. A null or empty
    text has none. Rows come out as they go in, repeated ones and ties too; doc_id may be null;
    other columns are ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trusted = learn_contexts(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), F.sha2(text, 256).alias("digest"))
    if trusted.isEmpty():
        return base.select("doc_id", "base", F.col("base").alias("spans"))
    found = base.join(context_spans(docs, trusted), "digest", "left")
    new = F.filter("more", lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(new, F.array().cast(_NONE)))).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, all spans as text and their number.

    One row for each row of docs, with the cases of find_pii."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs).select("doc_id", *map(count, BASE), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
