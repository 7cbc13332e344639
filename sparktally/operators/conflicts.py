"""Conflicting readings of one span: one aggregation, then a rule per strategy.

candidates: key, type, is_rule, conf, ord (first of equal ones wins). Each key
is reduced to its best rule and its best model reading, before and after the
shuffle; strategies choose between these two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds and weights by span type.
RULE_AT_LEAST = {"QUANTITY": 0.6, "DIMENSION": 0.55, "UNIT": 0.7, "GRADE": 0.8, "STANDARD": 0.65}
MODEL_AT_LEAST = {"MATERIAL": 0.6, "LOCATION": 0.6, "ACTION": 0.6}
MODEL_WEIGHT = {"QUANTITY": 0.3, "MATERIAL": 0.6, "LOCATION": 0.65, "GRADE": 0.2, "STANDARD": 0.5, "DIMENSION": 0.35, "UNIT": 0.3, "ACTION": 0.6}
STRATEGIES = ["rules_first", "model_first", "highest_confidence", "ensemble", "threshold_margin", "type_specific", "hybrid_ensemble"]


def by_type(values: dict[str, float], default: float | None) -> Column:
    out = F.lit(default).cast("double")
    for k, v in values.items():
        out = F.when(F.col("type") == k, v).otherwise(out)
    return out


def best_readings(candidates: DataFrame) -> DataFrame:
    """key, type, rule and model: the best reading (conf, ord) of either kind."""
    reading = F.struct("conf", (-F.col("ord")).alias("nord"), "ord")
    return candidates.groupBy("key").agg(
        F.min_by("type", "ord").alias("type"), F.max(F.when(F.col("is_rule"), reading)).alias("rule"), F.max(F.when(~F.col("is_rule"), reading)).alias("model")
    )


def winner(strategy: str) -> Column:
    """ord of the reading that a strategy picks, on rows of best_readings."""
    r, m = F.col("rule.conf"), F.col("model.conf")
    rule, model = F.col("rule.ord"), F.col("model.ord")

    def prefer(rule_wins: Column) -> Column:
        return F.when(rule.isNull(), model).when(model.isNull(), rule).when(rule_wins, rule).otherwise(model)

    def scored(rule_score: Column, model_score: Column) -> Column:
        return prefer((rule_score > model_score) | ((rule_score == model_score) & (rule < model)))

    weight = by_type(MODEL_WEIGHT, 0.5)
    return {
        "rules_first": prefer(r >= 0.7),
        "model_first": prefer(m < 0.6),
        "highest_confidence": scored(F.greatest(r, F.lit(0.9)), m),
        "ensemble": scored(r * 0.4, m * 0.6),
        # Without a clear lead of the model the rules have it.
        "threshold_margin": prefer(~(m > r + 0.15)),
        "type_specific": prefer(F.coalesce(r >= by_type(RULE_AT_LEAST, None), m < by_type(MODEL_AT_LEAST, 0.6))),
        "hybrid_ensemble": scored(r * (1 - weight), m * weight),
    }[strategy]


def resolve(candidates: DataFrame, strategy: str) -> DataFrame:
    """key and ord of the reading that stays."""
    return best_readings(candidates).select("key", winner(strategy).alias("ord"))
