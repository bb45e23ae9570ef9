"""Program logs to typed events.

Transactions are (signature, err, logs ARRAY<STRING>). A log line holds a tag and a JSON
object after its first brace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNAL_SUBMITTED = "model_id BIGINT, signal_id BIGINT, strategy_id BIGINT, submitter BIGINT, timestamp BIGINT, signal_type STRING, verified BOOLEAN"
SIGNAL_EXECUTED = "model_id BIGINT, signal_id BIGINT, strategy_id BIGINT, executor BIGINT, timestamp BIGINT, execution_result DOUBLE, price DOUBLE"


def events(transactions: DataFrame, tag: str, schema: str) -> DataFrame:
    """Decoded events of one tag with their position; failed transactions and bad JSON are left out.

    An event is identified by (signature, position), so replays of the same transaction
    add nothing.
    """
    lines = transactions.filter(F.col("err").isNull()).select("signature", F.posexplode("logs").alias("position", "line"))
    lines = lines.filter(F.col("line").contains(tag))
    data = F.from_json(F.regexp_extract("line", r"(\{.*)", 1), schema, {"mode": "PERMISSIVE"})
    return lines.select("signature", "position", data.alias("d")).filter(F.col("d").isNotNull()).select("signature", "position", "d.*")


def once(decoded: DataFrame) -> DataFrame:
    return decoded.dropDuplicates(["signature", "position"])
