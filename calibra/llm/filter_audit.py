"""Audit of how filters interact: what each removes, alone and behind the others, in any order.

Direct relational replay: every document's flags meet all orders of the filters, which are a
broadcast table of 120 rows; the first failing step of a document under an order is an
expression over its flags, the five steps are exploded, and conditional sums by (part, order,
step) are combined in the tasks before anything is shuffled. So a task sends at most one row
for each part, order and step, however many documents a part has.

The only shuffles of documents carry a fingerprint or an id with five flags: one finds texts
that a smaller doc_id has, one brings the labels.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"


def filter_orders(spark: SparkSession) -> DataFrame:
    """(filter_order, bits): every order of the filters with the flag bit of each step."""
    rows = [("".join(p), [1 << FILTERS.index(c) for c in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def text_flags(text: Column) -> Column:
    """Bits of the failure conditions A to D of a text.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals A-Z > 5 * code
    points; D: holds one of #$%&*|. Words are maximal runs of characters other than space and
    0x09-0x0D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    conditions = (n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def document_flags(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, good, toxic) of each document; bit i of flags is the failure of filter i.

    part is the source, a null one counting as the empty string; a null text counts as empty.
    E holds where a smaller doc_id has the same text; a null doc_id is neither smaller nor has
    a smaller one, and rows that repeat the smallest doc_id don't fail. Labels of one doc_id
    count as 1 if any of its rows has 1."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("print"))
    # Grouped by more than the later join's key, so that the join has an exchange of its own whose hot keys Spark can split.
    least = docs.where("doc_id is not null").groupBy("print", F.length("text").alias("n")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("print", "least")
    mine = docs.select("doc_id", "part", "print", text_flags(F.col("text")).alias("flags"))
    copies = mine.join(least, "print", "left").select("doc_id", "part", (F.col("flags") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)).alias("flags"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.pmod("doc_id", F.lit(2)).alias("half")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    return copies.join(marks.where("good + toxic > 0").drop("half"), "doc_id", "left").select("part", "flags", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def replay_orders(flags: DataFrame) -> DataFrame:
    """Counts of each part, order and step from (part, flags, good, toxic); see filter_audit."""
    orders = F.broadcast(filter_orders(flags.sparkSession))
    bit = lambda i: F.element_at("bits", i)
    first = F.lit(6)
    for i in range(5, 0, -1):
        first = F.when(F.col("flags").bitwiseAND(bit(i)) != 0, i).otherwise(first)
    replayed = flags.crossJoin(orders).select("*", first.alias("first"))
    steps = replayed.select("*", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    removed, fails = F.col("first") == F.col("step"), F.col("flags").bitwiseAND(F.col("bit")) != 0
    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": F.col("flags") == F.col("bit"),
        "good_lost": removed & (F.col("good") == 1),
        "toxic_lost": removed & (F.col("toxic") == 1),
    }
    sums = steps.groupBy("part", "filter_order", "step", "bit").agg(*(F.sum(F.when(c, F.lit(1).cast("long")).otherwise(0)).alias(name) for name, c in counts.items()))
    # 120 rows for each part and filter, whatever the table's size
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).select("part", "filter_order", "step", *counts, "shapley")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the five filters and step (1 to 5), zeros included.

    kept: documents of the part left after this step; removed: here; redundant: failing its
    filter but removed before; unique_fails: failing its filter only; good_lost and toxic_lost:
    removed here with quality or toxic 1; shapley: what its filter removes, summed over all
    orders at any step. An empty table of documents gives no rows; extra columns are ignored."""
    return replay_orders(document_flags(documents, labels))
