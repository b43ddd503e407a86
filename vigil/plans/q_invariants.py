"""Registered invariants of the trained-model queries: what must hold for any
model is counted on Spark, and the oracle states the count."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.plans import q_explain as E
from vigil.plans.registry import QUERIES, register
from vigil.schema import FEATURES


def _off(x, y):
    return F.count_if(F.abs(x - y) > 1e-9)


@register("forest_shap_invariants", """
SELECT count(*) AS events, CAST(0 AS BIGINT) AS not_additive, CAST(0 AS BIGINT) AS not_probability FROM security_logs
""", cte=True)
def q_forest_shap_invariants(spark, sf):
    """Base + contributions give the forest's probability for every event."""
    s = E.q_forest_shap_values(spark, sf)
    total = sum((F.col(f"phi_{c}") for c in FEATURES), F.col("base"))
    return s.agg(F.count("*").alias("events"), _off(total, F.col("p_forest")).alias("not_additive"),
                 F.count_if(~F.col("p_forest").between(0, 1)).alias("not_probability"))


@register("forest_shap_reason_invariants", """
SELECT event_id, CAST(3 AS BIGINT) AS reasons, true AS ranked FROM security_logs
""", cte=True)
def q_forest_shap_reason_invariants(spark, sf):
    """Three reasons an event, the strongest first."""
    r = E.q_forest_shap_top_reasons(spark, sf).groupBy("event_id").agg(
        F.count("*").alias("reasons"), F.array_sort(F.collect_list(F.struct("rank", F.abs("contribution").alias("c")))).alias("l"))
    return r.select("event_id", "reasons", ((F.col("l")[0]["c"] >= F.col("l")[1]["c"])
                                            & (F.col("l")[1]["c"] >= F.col("l")[2]["c"])).alias("ranked"))


@register("forest_importance_invariants", """
SELECT CAST(6 AS BIGINT) AS features, 100.0::DOUBLE AS shap_total, 1.0::DOUBLE AS impurity_total
""", cte=True)
def q_forest_importance_invariants(spark, sf):
    """Six shares that add up."""
    shap = E.q_forest_shap_importance(spark, sf).agg(
        F.count("*").alias("features"), F.round(F.sum("percentage"), 6).alias("shap_total"))
    gain = QUERIES["forest_feature_importance"](spark, sf)
    value = next(c for c, t in gain.dtypes if t == "double")
    return shap.select("*", F.lit(gain.select(F.round(F.sum(value), 6)).scalar()).alias("impurity_total"))


@register("lime_invariants", """
SELECT CAST(6 * count(*) AS BIGINT) AS weights, count(*) AS events, CAST(0 AS BIGINT) AS without_condition,
       CAST(0 AS BIGINT) AS wrong_direction
FROM security_logs
""", cte=True)
def q_lime_invariants(spark, sf):
    """Six weights for every event, each with its condition and direction."""
    w = E.q_lime_explanations(spark, sf)
    up = F.col("direction") == "🔺 Increases threat"
    return w.agg(F.count("*").alias("weights"), F.count_distinct("event_id").alias("events"),
                 F.count_if(F.col("condition").isNull()).alias("without_condition"),
                 F.count_if(up != (F.col("weight") > 0)).alias("wrong_direction"))
