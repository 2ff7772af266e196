"""Risk scoring and reports over spans read from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.operators import risk as r
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query


@query("risk_score", f"WITH {o.ENT_CTE} SELECT doc_id, {o.RISK} AS risk_score FROM ent GROUP BY doc_id")
def risk_score(spark, sf_dir):
    return r.risk_score(fx.entities(spark, sf_dir))


@query("threat_level", f"""WITH {o.ENT_CTE}, r AS (SELECT doc_id, {o.RISK} AS risk_score FROM ent GROUP BY doc_id)
 SELECT doc_id, risk_score, {o.level('risk_score')} AS threat_level FROM r""")
def threat_level(spark, sf_dir):
    return r.threat_level(fx.entities(spark, sf_dir))


# Mean confidence in thousandths, rounded half up in whole numbers.
_AVG = ("CAST((2 * sum(CAST(round(score * 100) AS BIGINT)) * 10 + count(*)) // (2 * count(*)) AS DOUBLE) / 1000")


@query("entity_breakdown", f"""WITH {o.ENT_CTE} SELECT doc_id, entity_type, count(*) AS count, {_AVG} AS avg_confidence,
 max(score) AS max_confidence, {o.WEIGHT} AS risk_weight FROM ent GROUP BY doc_id, entity_type""")
def entity_breakdown(spark, sf_dir):
    return r.entity_breakdown(fx.entities(spark, sf_dir))


# Twenty suppliers' line items per document, so that more than ten compete.
_WIDE = "wide AS (SELECT * REPLACE (CAST(floor(doc_id / 20) AS BIGINT) AS doc_id, doc_id * 10 + ord AS ord) FROM ent)"
_TOP = f"""top AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY risk_contribution DESC, ord, start_pos, entity_type, score) AS rank,
 entity_type, score AS confidence, risk_contribution, concat('chars ', start_pos, '-', end_pos) AS position
 FROM (SELECT *, CAST(round({o.WEIGHT} * CAST(score AS DECIMAL(18,4)), 2) AS DOUBLE) AS risk_contribution FROM wide))"""


def _wide(spark, sf_dir):
    ent = fx.entities(spark, sf_dir)
    tie = F.struct((F.col("doc_id") * 10 + F.col("ord")).alias("o"), "start_pos", "entity_type", "score")
    return ent.withColumn("ord", tie).withColumn("doc_id", F.floor(F.col("doc_id") / 20).cast("long"))


@query("top_detections", f"WITH {o.ENT_CTE}, {_WIDE}, {_TOP} SELECT * FROM top WHERE rank <= 10")
def top_detections(spark, sf_dir):
    return r.top_detections(_wide(spark, sf_dir))


_ACTIONS = "CASE threat_level " + " ".join(
    f"WHEN '{lv}' THEN [{', '.join(repr(a) for a in acts)}]" for lv, acts in C.ACTIONS.items()) + " END"


@query("recommended_actions", f"""WITH {o.ENT_CTE}, r AS (SELECT doc_id, {o.RISK} AS risk_score FROM ent GROUP BY doc_id),
 l AS (SELECT doc_id, {o.level('risk_score')} AS threat_level FROM r)
 SELECT doc_id, threat_level, unnest(range(1, len({_ACTIONS}) + 1)) AS step, unnest({_ACTIONS}) AS action FROM l""")
def recommended_actions(spark, sf_dir):
    levels = r.threat_level(fx.entities(spark, sf_dir))
    steps = levels.select("doc_id", "threat_level",
                          F.posexplode_outer(r.actions_of(F.col("threat_level"))).alias("pos", "action"))
    return steps.select("doc_id", "threat_level", (F.col("pos") + 1).alias("step"), "action")


def _report(spark, sf_dir):
    docs = fx.files(spark, sf_dir).select(
        "doc_id", "filename", F.length("filename").alias("text_length"))
    ent = fx.entities(spark, sf_dir)
    tie = F.struct("ord", "start_pos", "entity_type", "score")
    return r.threat_report(ent.withColumn("ord", tie), docs)


_REPORT_CTES = f"""{o.ENT_CTE}, {o.FILES_CTE}, wide AS (SELECT * FROM ent), {_TOP},
 b AS (SELECT doc_id, entity_type, count(*) AS n, {_AVG} AS avg_conf, {o.WEIGHT} AS w FROM ent GROUP BY doc_id, entity_type),
 agg AS (SELECT doc_id, {o.RISK} AS risk_score, count(*) AS total_entities, count(DISTINCT entity_type) AS unique_types FROM ent GROUP BY doc_id),
 rep AS (SELECT doc_id, filename, length(filename) AS text_length, coalesce(risk_score, 0) AS risk_score,
 coalesce(total_entities, 0) AS total_entities, coalesce(unique_types, 0) AS unique_types FROM files LEFT JOIN agg USING (doc_id))"""


@query("threat_report", f"""WITH {_REPORT_CTES} SELECT doc_id, filename, text_length, {o.level('risk_score')} AS threat_level,
 risk_score, total_entities, unique_types,
 coalesce((SELECT string_agg(concat(entity_type, '=', n, 'x', w), ',' ORDER BY entity_type) FROM b WHERE b.doc_id = rep.doc_id), '') AS breakdown,
 coalesce((SELECT string_agg(concat(entity_type, ' ', position), ',' ORDER BY rank) FROM top WHERE rank <= 10 AND top.doc_id = rep.doc_id), '') AS top_detections
 FROM rep""")
def threat_report(spark, sf_dir):
    rep = _report(spark, sf_dir)
    types = F.transform(F.array_sort(F.map_entries("breakdown")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["count"].cast("string"), F.lit("x"), e["value"]["risk_weight"].cast("string")))
    top = F.transform("top_detections", lambda t: F.concat_ws(" ", t["entity_type"], t["position"]))
    return rep.select("doc_id", "filename", "text_length", "threat_level", "risk_score", "total_entities", "unique_types",
                      F.array_join(types, ",").alias("breakdown"), F.array_join(top, ",").alias("top_detections"))


_RULE, _DASH = "=" * 70, "-" * 70
_NL = "chr(10)"


@query("threat_report_text", f"""WITH {_REPORT_CTES}, l AS (SELECT *, {o.level('risk_score')} AS threat_level FROM rep)
 SELECT doc_id, concat_ws({_NL}, '{_RULE}', '             THREAT INTELLIGENCE REPORT', '{_RULE}', '',
 concat('  Document:      ', filename), concat('  Text Length:   ', text_length, ' characters'), '', '{_DASH}',
 concat('  THREAT LEVEL:  *** ', threat_level, ' ***'), concat('  Risk Score:    ', printf('%.2f', risk_score)),
 concat('  Total PII:     ', total_entities, ' entities'), concat('  Entity Types:  ', unique_types), '{_DASH}', '', '  ENTITY BREAKDOWN:',
 (SELECT string_agg(concat('    • ', rpad(entity_type, 20, ' '), '  Count: ', rpad(CAST(n AS VARCHAR), 4, ' '), '  Avg Conf: ',
  printf('%.3f', avg_conf), '  Weight: ', w), {_NL} ORDER BY entity_type) FROM b WHERE b.doc_id = l.doc_id),
 '', '  RECOMMENDED ACTIONS:',
 array_to_string(list_transform({_ACTIONS}, lambda a, i: concat('    ', i, '. ', a)), {_NL}), '', '{_RULE}') AS report_text FROM l""")
def threat_report_text(spark, sf_dir):
    return r.report_text(_report(spark, sf_dir))


@query("media_risk", f"""WITH {o.ENT_CTE}, {o.FILES_CTE}, n AS (SELECT doc_id, count(*) AS entity_count FROM ent GROUP BY doc_id)
 SELECT doc_id, coalesce(entity_count, 0) AS entity_count, CASE WHEN coalesce(entity_count, 0) >= 5 THEN 'HIGH'
 WHEN coalesce(entity_count, 0) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level,
 least(coalesce(entity_count, 0) * 15, 100) AS risk_score FROM files LEFT JOIN n USING (doc_id)""")
def media_risk(spark, sf_dir):
    counts = fx.entities(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = fx.files(spark, sf_dir).select("doc_id").join(counts, "doc_id", "left")
    return r.media_risk(docs.select("doc_id", F.coalesce("n", F.lit(0)).alias("entity_count")))
