"""One pass over the open alerts: scores of whole evidence, what is created, what escalates.

Evidence rows have alert_id, stream_id, cell, modality, class, q, tail, kind and the stream's
policy: push_score, extreme, q_tail, min_sensors (null where the configuration is silent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions.pit import tail_p
from calibra.operators.alerts import ESCALATE, EXTREME, LEAST_LOG_P

# The kind of an item that a feed issued itself; defaults of a stream's policy.
ISSUED, PUSH_SCORE, Q_TAIL, SENSORS = "source_alert", 5.0, 1e-4, 1


def one_sided_p(q: Column, tail: Column) -> Column:
    """Tail probability for a confirmation: the nearer side counts once."""
    return F.when(tail == "upper", 1 - q).when(tail == "lower", q).otherwise(F.least(q, 1 - q))


def scores(evidence: DataFrame) -> DataFrame:
    """(alert_id, score, modalities, confirmed, stage) of each alert's whole evidence.

    Each (stream, cell) counts its most improbable reading, an issued item without a reading
    the score of its feed; readings of a class that issued an item restate it and add nothing.
    The sum is multiplied by the number of modalities from two on. An alert is confirmed by two
    modalities, by an issued item, or by enough cells of a stream that may confirm alone."""
    issued = F.coalesce(F.col("kind") == ISSUED, F.lit(False))
    restated = F.col("class").isNotNull() & F.max(issued).over(Window.partitionBy("alert_id", "class"))
    p = F.greatest(tail_p(F.col("q"), F.coalesce("tail", F.lit("both"))), F.lit(LEAST_LOG_P))
    strong = ~issued & F.coalesce(F.col("extreme"), F.lit(False)) & (one_sided_p(F.col("q"), F.coalesce("tail", F.lit("both"))) <= F.coalesce("q_tail", F.lit(Q_TAIL)))
    rows = evidence.select(
        "alert_id", "stream_id", "cell", F.coalesce("modality", F.lit("")).alias("modality"), issued.alias("issued"), F.coalesce(strong, F.lit(False)).alias("strong"), F.coalesce("min_sensors", F.lit(SENSORS)).alias("min_sensors"),
        F.when(~restated & F.col("q").isNotNull(), -F.log10(p)).alias("e"), F.when(issued & F.col("q").isNull(), F.coalesce("push_score", F.lit(PUSH_SCORE))).alias("feed"),
    )
    cells = rows.groupBy("alert_id", "stream_id", "cell").agg(F.max("e").alias("e"), F.sum("feed").alias("feed"), F.max("issued").alias("issued"), F.max("strong").alias("strong"), F.max("min_sensors").alias("need"), F.collect_set("modality").alias("mods"))
    streams = cells.groupBy("alert_id", "stream_id").agg(F.sum("e").alias("e"), F.sum("feed").alias("feed"), F.max("issued").alias("issued"), (F.count_if("strong") >= F.max("need")).alias("alone"), F.count_if("strong").alias("n_strong"), F.flatten(F.collect_set("mods")).alias("mods"))
    total = streams.groupBy("alert_id").agg(
        (F.coalesce(F.sum("e"), F.lit(0.0)) + F.coalesce(F.sum("feed"), F.lit(0.0))).alias("sum"), F.max("issued").alias("issued"), F.max(F.col("alone") & (F.col("n_strong") > 0)).alias("alone"), F.size(F.array_distinct(F.flatten(F.collect_list("mods")))).alias("modalities")
    )
    confirmed = F.col("issued") | F.col("alone") | (F.col("modalities") >= 2)
    score = F.col("sum") * F.when(F.col("modalities") >= 2, F.col("modalities")).otherwise(1)
    return total.select("alert_id", score.alias("score"), "modalities", confirmed.alias("confirmed"), stage(score, confirmed).alias("stage"))


def stage(score: Column, confirmed: Column, extreme: float = EXTREME) -> Column:
    """0 unconfirmed, 1 confirmed, 2 confirmed and extreme."""
    return F.when(confirmed, F.when(score >= extreme, 2).otherwise(1)).otherwise(0)


def effective_stage(kept: DataFrame, harm: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert_id, score, stage) as a person should see it: of the kept evidence, raised by a harm stage; -1 if none is kept.

    harm: alert_id, harm_stage."""
    joined = alerts.select("alert_id").join(scores(kept), "alert_id", "left").join(harm, "alert_id", "left")
    shown = F.when(F.col("stage").isNull(), -1).otherwise(F.greatest("stage", F.coalesce("harm_stage", F.lit(0))))
    return joined.select("alert_id", F.coalesce("score", F.lit(0.0)).alias("score"), shown.cast("int").alias("stage"))


def escalations(alerts: DataFrame, evidence: DataFrame, candidates: DataFrame, now: int) -> DataFrame:
    """(alert_id, new_stage, severity, added) of open young alerts whose stage rises with the readings of their region.

    alerts: alert_id, region, opened_at, status, severity, stage; candidates: the columns of
    evidence without alert_id, and region. The alert's own evidence counts too; a silent feed
    (no q) confirms nothing; a (stream, cell) that the alert has isn't added again."""
    young = alerts.where((F.col("status") == "open") & (F.col("opened_at") >= now - ESCALATE) & (F.col("stage") < 2))
    have = evidence.select("alert_id", "stream_id", "cell").distinct()
    extra = young.select("alert_id", "region").join(candidates.where("q is not null"), "region").drop("region").join(have, ["alert_id", "stream_id", "cell"], "left_anti")
    own = evidence.join(extra.select("alert_id").distinct(), "alert_id", "left_semi")
    merged = scores(own.unionByName(extra)).select("alert_id", F.col("stage").alias("new_stage"))
    added = extra.groupBy("alert_id").agg(F.array_sort(F.collect_set(F.struct("stream_id", "cell"))).alias("added"))
    risen = young.join(merged, "alert_id").where(F.col("new_stage") > F.col("stage")).join(added, "alert_id")
    return risen.select("alert_id", "new_stage", F.greatest("severity", F.when(F.col("new_stage") == 2, 0.95).otherwise(0.8)).alias("severity"), "added")


def alert_rows(members: DataFrame, by: list[str], severity: Column, now: int) -> DataFrame:
    """New alerts of members (stream_id, cell, bin_start, scale, q, presence_q, extremity, s): evidence by falling extremity, least scale."""
    entry = F.struct((-F.col("extremity")).alias("order"), "stream_id", "cell", "bin_start", "scale", "q", "presence_q", F.when(F.abs("s") < float("inf"), F.round("s", 2)).alias("s"))
    sorted_ = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("order"))
    return members.groupBy(*by).agg(F.least(F.lit(1.0), severity).alias("severity"), F.min("scale").alias("scale"), sorted_.alias("evidence")).withColumns({"opened_at": F.lit(now), "status": F.lit("open")})


def swept(created: list[DataFrame], escalated: DataFrame) -> DataFrame:
    """(alert_id, policy) of all that a pass created, policy after policy, and of what escalated without being new."""
    new = created[0]
    for more in created[1:]:
        new = new.unionByName(more)
    new = new.select("alert_id", "policy")
    return new.unionByName(escalated.select("alert_id").join(new.select("alert_id"), "alert_id", "left_anti").withColumn("policy", F.lit("escalated")))
