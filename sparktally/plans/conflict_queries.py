"""Conflict resolution over two readings of every line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conflicts as cf
from .bridge import BOQ, boq_rows, pick, quoted
from .registry import query

_TYPE = pick("part", quoted(list(cf.MODEL_WEIGHT)))
_R, _M = "(part % 101) / 100.0::double", "(part * 7 % 101) / 100.0::double"


def _case(values: dict[str, float], default: str) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


_W = _case(cf.MODEL_WEIGHT, "0.5")
_RULE_WINS = {
    "rules_first": "r >= 0.7", "model_first": "m < 0.6", "highest_confidence": "greatest(r, 0.9) >= m", "ensemble": "r * 0.4::double >= m * 0.6::double", "threshold_margin": "NOT (m > r + 0.15::double)",
    "type_specific": f"coalesce(r >= {_case(cf.RULE_AT_LEAST, 'NULL')}, m < {_case(cf.MODEL_AT_LEAST, '0.6')})", "hybrid_ensemble": f"r * (1 - ({_W})::double) >= m * ({_W})::double",
}


@query(
    "conflict_strategies",
    "SELECT line_key, " + ", ".join(f"cast(min(CASE WHEN {c} THEN 0 ELSE 1 END) AS int) AS {s}" for s, c in _RULE_WINS.items())
    + f" FROM (SELECT line_key, min({_TYPE}) AS type, max({_R}) AS r, max({_M}) AS m FROM {BOQ} GROUP BY line_key) GROUP BY line_key",
)
def conflict_strategies(spark, sf):
    """0 where the rule's reading stays, 1 where the model's does."""
    b = boq_rows(spark, sf).select(F.col("line_key").alias("key"), "part", F.expr(_TYPE).alias("type"))
    rule = b.select("key", "type", F.lit(True).alias("is_rule"), (F.col("part") % 101 / 100).alias("conf"), F.lit(0).alias("ord"))
    model = b.select("key", "type", F.lit(False).alias("is_rule"), (F.col("part") * 7 % 101 / 100).alias("conf"), F.lit(1).alias("ord"))
    best = cf.best_readings(rule.unionByName(model))
    return best.select(F.col("key").alias("line_key"), *(cf.winner(s).alias(s) for s in cf.STRATEGIES))
