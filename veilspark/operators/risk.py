"""Risk scoring and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark import config as C


def weight_of(entity_type: Column) -> Column:
    """Risk weight of a type; a short literal chain, so no lookup join."""
    chain = None
    for weight in sorted(set(C.RISK_WEIGHTS.values())):
        types = [t for t, w in C.RISK_WEIGHTS.items() if w == weight]
        cond = entity_type.isin(types)
        chain = F.when(cond, weight) if chain is None else chain.when(cond, weight)
    return chain.otherwise(C.DEFAULT_WEIGHT)


def _exact(score: Column) -> Column:
    return score.cast("decimal(18,4)")


def contribution(entity_type: Column, score: Column) -> Column:
    return weight_of(entity_type) * _exact(score)


def level_of(score: Column) -> Column:
    chain = None
    for name, bound in C.LEVEL_BOUNDS:
        cond = score < bound
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain.otherwise(C.TOP_LEVEL)


def span_risk(spans: Column) -> Column:
    """Risk of a span array, summed exactly and rounded once."""
    total = F.aggregate(
        spans,
        F.lit(0).cast("decimal(38,4)"),
        lambda acc, s: (acc + contribution(s["entity_type"], s["score"])).cast("decimal(38,4)"),
    )
    return F.round(total, 2).cast("double")


def score_docs(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Entity count, risk and level from the span array; no shuffle."""
    return (
        docs.withColumn("entity_count", F.size(spans))
        .withColumn("risk_score", span_risk(F.col(spans)))
        .withColumn("threat_level", level_of(F.col("risk_score")))
    )


# ---- on a table of spans ----------------------------------------------------

def risk_score(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    total = F.sum(contribution(F.col("entity_type"), F.col("score")))
    return entities.groupBy(key).agg(F.round(total, 2).cast("double").alias("risk_score"))


def threat_level(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    return risk_score(entities, key).withColumn("threat_level", level_of(F.col("risk_score")))


def entity_breakdown(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Count, mean and best confidence per document and type."""
    n, total = F.count("*"), F.sum(_exact(F.col("score")))
    return entities.groupBy(key, "entity_type").agg(
        n.alias("count"),
        F.round(total / n, 3).cast("double").alias("avg_confidence"),
        F.max("score").alias("max_confidence"),
    ).withColumn("risk_weight", weight_of(F.col("entity_type")))


def top_detections(entities: DataFrame, key: str = "doc_id", order: str = "ord", k: int = 10) -> DataFrame:
    """The ``k`` riskiest spans per document, ties in input order.

    The rank filter lets Spark cut every map task to ``k`` rows per document
    before the shuffle, so one huge document does not land in one task.
    """
    risk = F.round(contribution(F.col("entity_type"), F.col("score")), 2).cast("double")
    ranked = Window.partitionBy(key).orderBy(F.desc("risk_contribution"), F.asc(order))
    return (
        entities.withColumn("risk_contribution", risk)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .withColumn("position", F.format_string("chars %d-%d", "start_pos", "end_pos"))
        .select(key, "rank", "entity_type", F.col("score").alias("confidence"),
                "risk_contribution", "position")
    )


def actions_of(level: Column) -> Column:
    """Follow-up steps of a level; unknown levels get those of LOW."""
    def steps(name: str) -> Column:
        return F.array(*[F.lit(a) for a in C.ACTIONS[name]])

    return (
        F.when(level == "MEDIUM", steps("MEDIUM"))
        .when(level == "HIGH", steps("HIGH"))
        .when(level == "CRITICAL", steps("CRITICAL"))
        .otherwise(steps("LOW"))
    )


def threat_report(entities: DataFrame, docs: DataFrame, key: str = "doc_id",
                  order: str = "ord") -> DataFrame:
    """One nested report per document of ``docs(key, filename, text_length)``.

    Totals come from the per-type breakdown (at most one row per type), so raw
    spans are shuffled once for it and once, already cut to ten, for the top list.
    """
    n, total = F.count("*"), F.sum(contribution(F.col("entity_type"), F.col("score")))
    per_type = entities.groupBy(key, "entity_type").agg(
        n.alias("n"), total.alias("risk"), F.sum(_exact(F.col("score"))).alias("conf"),
        F.max("score").alias("max_confidence"),
    )
    info = F.struct(
        F.col("n").alias("count"),
        F.col("max_confidence"),
        weight_of(F.col("entity_type")).alias("risk_weight"),
        F.round(F.col("conf") / F.col("n"), 3).cast("double").alias("avg_confidence"),
    )
    summary = per_type.groupBy(key).agg(
        F.round(F.sum("risk"), 2).cast("double").alias("risk_score"),
        F.sum("n").alias("total_entities"),
        F.count("*").alias("unique_types"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", info)))).alias("breakdown"),
    )
    top = top_detections(entities, key, order).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "entity_type", "confidence", "risk_contribution", "position"))).alias("top"))
    joined = docs.join(summary, key, "left").join(top, key, "left")
    score = F.coalesce(F.col("risk_score"), F.lit(0.0))
    return joined.select(
        key, "filename", "text_length",
        level_of(score).alias("threat_level"),
        score.alias("risk_score"),
        F.coalesce("total_entities", F.lit(0)).alias("total_entities"),
        F.coalesce("unique_types", F.lit(0)).alias("unique_types"),
        F.coalesce("breakdown", F.create_map().cast(
            "map<string,struct<count:bigint,max_confidence:double,risk_weight:int,avg_confidence:double>>"
        )).alias("breakdown"),
        F.transform(
            F.coalesce("top", F.array().cast(
                "array<struct<rank:int,entity_type:string,confidence:double,"
                "risk_contribution:double,position:string>>")),
            lambda t: t.dropFields("rank")).alias("top_detections"),
        actions_of(level_of(score)).alias("recommended_actions"),
    )


def report_json(report: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reports as stored: one JSON string plus the columns filtered on."""
    body = F.struct(
        F.struct("filename", "text_length").alias("report_metadata"),
        F.struct("threat_level", "risk_score",
                 F.col("total_entities").alias("total_entities_detected"),
                 F.col("unique_types").alias("unique_entity_types")).alias("threat_assessment"),
        F.col("breakdown").alias("entity_breakdown"), "top_detections", "recommended_actions",
    )
    return report.select(key, F.to_json(body).alias("report_json"), "threat_level",
                         "risk_score", "total_entities")


def report_text(report: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fixed-width rendering of a report."""
    # The wording and widths of the report.
    rule, dash = "=" * 70, "-" * 70
    types = F.transform(
        F.array_sort(F.map_entries("breakdown")),
        lambda e: F.concat(
            F.lit("    • "), F.rpad(e["key"], 20, " "),
            F.lit("  Count: "), F.rpad(e["value"]["count"].cast("string"), 4, " "),
            F.lit("  Avg Conf: "), F.format_string("%.3f", e["value"]["avg_confidence"]),
            F.lit("  Weight: "), e["value"]["risk_weight"].cast("string"),
        ),
    )
    steps = F.transform(
        F.col("recommended_actions"),
        lambda a, i: F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(". "), a),
    )
    head = F.array(
        F.lit(rule), F.lit("             THREAT INTELLIGENCE REPORT"), F.lit(rule), F.lit(""),
        F.concat(F.lit("  Document:      "), F.col("filename")),
        F.concat(F.lit("  Text Length:   "), F.col("text_length").cast("string"), F.lit(" characters")),
        F.lit(""), F.lit(dash),
        F.concat(F.lit("  THREAT LEVEL:  *** "), F.col("threat_level"), F.lit(" ***")),
        F.concat(F.lit("  Risk Score:    "), F.format_string("%.2f", "risk_score")),
        F.concat(F.lit("  Total PII:     "), F.col("total_entities").cast("string"), F.lit(" entities")),
        F.concat(F.lit("  Entity Types:  "), F.col("unique_types").cast("string")),
        F.lit(dash), F.lit(""), F.lit("  ENTITY BREAKDOWN:"),
    )
    lines = F.concat(head, types, F.array(F.lit(""), F.lit("  RECOMMENDED ACTIONS:")), steps,
                     F.array(F.lit(""), F.lit(rule)))
    return report.select(key, F.array_join(lines, "\n").alias("report_text"))


def media_risk(counts: DataFrame, count: str = "entity_count") -> DataFrame:
    """Level and score of a transcript by its number of covered words."""
    n = F.col(count)
    return counts.withColumn(
        "threat_level", F.when(n >= 5, "HIGH").when(n >= 1, "MEDIUM").otherwise("LOW")
    ).withColumn("risk_score", F.least(n * 15, F.lit(100)))
