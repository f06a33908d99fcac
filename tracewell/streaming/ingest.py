"""Ingestion of hook events with the checks of each endpoint: good rows and rejected ones go to tables of their own.

A row is an endpoint and a body (JSON text). Bodies become VARIANT values, so an endpoint's fields are read where its
rule names them and others are kept as they are. Files of a batch are written under the batch's number, so a replayed
batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: the endpoints and the fields that each requires
REQUIRED = {
    "session-start": ["session_id", "cwd"],
    "session-end": ["session_id"],
    "pre-tool-use": ["session_id", "tool_name"],
    "post-tool-use": ["session_id", "tool_name"],
    "stop": [],
    "subagent-stop": [],
    "notification": [],
    "permission-request": [],
    "user-prompt-submit": [],
    "pre-compact": [],
}
#: endpoints that take an unreadable body for an empty one, or do not read it
BODY_OPTIONAL = ["stop", "subagent-stop", "permission-request", "pre-compact"]
#: the event of ``live.live_sessions`` that an endpoint stands for
EVENT_OF = {"session-start": "start", "session-end": "end", "pre-tool-use": "pre", "post-tool-use": "post", "stop": "awaiting", "user-prompt-submit": "resumed"}


def _given(body: Column, field: str) -> Column:
    """Whether a field is there and is neither null, false, zero nor an empty text."""
    text = F.try_variant_get(body, f"$.{field}", "string")
    number = F.schema_of_variant(F.try_variant_get(body, f"$.{field}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)") & (text.try_cast("double") == 0)
    false = F.schema_of_variant(F.try_variant_get(body, f"$.{field}", "variant")).isin("BOOLEAN") & (text == "false")
    return F.coalesce((text != "") & ~F.coalesce(number, F.lit(False)) & ~F.coalesce(false, F.lit(False)), F.lit(False))


def validated(rows: DataFrame) -> DataFrame:
    """rows (endpoint, body) with ``data`` (VARIANT) and ``reason``: null for good rows, else what is wrong."""
    data = F.try_parse_json("body")
    is_object = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    optional = F.col("endpoint").isin(BODY_OPTIONAL)
    parsed = rows.withColumn("data", F.when(is_object | ~optional, data).otherwise(F.parse_json(F.lit("{}"))))
    lacking = [F.when((F.col("endpoint") == endpoint) & ~_given(F.col("data"), field), F.lit(field)) for endpoint, fields in REQUIRED.items() for field in fields]
    missing = F.array_compact(F.array(*lacking))
    known = F.coalesce(F.col("endpoint").isin(list(REQUIRED)), F.lit(False))
    reason = F.when(~known, "unknown endpoint").when(~is_object & ~F.coalesce(optional, F.lit(False)), "body is no JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    return parsed.withColumn("reason", reason)


def hook_events(good: DataFrame) -> DataFrame:
    """Good rows as the events of ``live.live_sessions``; endpoints that do not touch a session are left out."""
    kind = F.coalesce(*[F.when(F.col("endpoint") == k, F.lit(v)) for k, v in EVENT_OF.items()])
    field = lambda name, kind="string": F.try_variant_get("data", f"$.{name}", kind).alias(name)
    return good.select(kind.alias("event"), field("tool_use_id"), field("session_id"), field("tool_name"), field("timestamp", "long"), field("error"), field("cwd")).where("event is not null and session_id is not null")


class Intake:
    """The tables ``good`` and ``rejected`` below ``folder``; ``append`` is a ``foreachBatch`` function."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, rows: DataFrame, batch: int) -> None:
        checked = validated(rows.select("endpoint", "body")).persist()
        try:
            checked.where("reason is null").select("endpoint", "body").write.mode("overwrite").parquet(f"{self.folder}/good/batch={batch}")
            checked.where("reason is not null").select("endpoint", "body", "reason").write.mode("overwrite").parquet(f"{self.folder}/rejected/batch={batch}")
        finally:
            checked.unpersist()

    def good(self) -> DataFrame:
        rows = self.spark.read.schema("endpoint string, body string, batch long").parquet(f"{self.folder}/good")
        return rows.withColumn("data", F.coalesce(F.try_parse_json("body"), F.parse_json(F.lit("{}"))))

    def rejected(self) -> DataFrame:
        return self.spark.read.schema("endpoint string, body string, reason string, batch long").parquet(f"{self.folder}/rejected")
