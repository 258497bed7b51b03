"""Chat formatting of a log that streams, edits, regenerates and deletes its messages.

The events of a user are a conversation, those of a day a turn; what an event does follows
from its id. Its answer depends on the order of events within a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.chat import fold_events, read_back, render

KINDS = ("message", "edit", "regenerate", "delete", "delta", "delta", "delta")


def event_log(events: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, kind, role, text) of the driver's events."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    role = F.when(F.col("event_id") % 2 == 0, "assistant").otherwise("user")
    text = F.concat("event_type", F.lit("<"), F.col("event_id").cast("string"), F.lit("[INST]"))
    return events.select(F.col("user_id").alias("conv_id"), F.dayofmonth("ts").alias("turn"), F.col("event_id").alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read_back(render(fold_events(event_log(spark.read.parquet(f"{sf_dir}/events.parquet")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"))


CHAT_LOG_SQL = """
WITH e AS (
  SELECT user_id AS conv_id, day(ts) AS turn, event_id AS seq, event_id % 7 AS k, CASE WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, event_type || '<' || event_id || '[INST]' AS text FROM events
), last AS (
  SELECT conv_id, turn, coalesce(max(seq) FILTER (WHERE k <= 3), -1) AS at, coalesce(arg_max(k, seq) FILTER (WHERE k <= 3), 3) AS k FROM e GROUP BY conv_id, turn
), turns AS (
  SELECT e.conv_id, e.turn, arg_min(e.role, e.seq) AS role, string_agg(e.text, '' ORDER BY e.seq) AS text
  FROM e JOIN last l ON l.conv_id = e.conv_id AND l.turn = e.turn AND (e.seq > l.at OR e.seq = l.at AND l.k < 3) GROUP BY e.conv_id, e.turn
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256 FROM turns GROUP BY conv_id
"""
