"""Top forecasts of every strategy and topic."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm.topn import top_n
from skein.sources.tables import table

N = 5


def p2_found(spark, d):
    forecasts = table(spark, d, "scored_forecasts").select("strategy_id", "topic_id", "forecast_id", "joint_score").filter(F.col("topic_id").isNotNull())
    return top_n(forecasts, ["strategy_id", "topic_id"], "forecast_id", "joint_score", N).select("strategy_id", "topic_id", "forecast_id", "place")


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": f"""select strategy_id, topic_id, forecast_id, place from (
  select *, row_number() over (partition by strategy_id, topic_id order by joint_score desc, forecast_id) place from (
   select distinct strategy_id, topic_id, forecast_id, joint_score from scored_forecasts
   where topic_id is not null and joint_score is not null and not isnan(joint_score))) where place <= {N}"""
}
