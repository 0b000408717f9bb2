"""Change data capture: messages and a resumable sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import json_number
from ..operators.reads import ChangeEventsFilter, change_events
from ..plans.accept import BALANCES

#: The message's fields of the transfer, and of either account besides its balances, by the columns of change_events().
TRANSFER = ("id", "amount", "pending_id", "user_data_128", "user_data_64", "user_data_32", "timeout", "code", "flags", "timestamp")
ACCOUNT = ("user_data_128", "user_data_64", "user_data_32", "code", "flags", "timestamp")


def body(changes: DataFrame) -> DataFrame:
    """timestamp, headers and body of each change event, out of change_events().

    The body is JSON without blanks; integers from 2 ** 53 on are strings, so that every reader can hold them. In the
    headers numbers are text, and the timestamp is cut to seconds.
    """

    def item(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def group(*items: Column) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))

    n = lambda c: json_number(changes, c)
    side = lambda s, key: group(item("id", n(key)), *[item(b, n(f"{s}_{b}")) for b in BALANCES], *[item(f, n(f"{key.removesuffix('_id')}_now_{f}")) for f in ACCOUNT])
    whole = group(
        item("timestamp", n("timestamp")), item("type", F.concat(F.lit('"'), "type", F.lit('"'))), item("ledger", n("ledger")),
        item("transfer", group(*[item(f, n("amount" if f == "amount" else f"transfer_{f}")) for f in TRANSFER])),
        item("debit_account", side("dr", "debit_account_id")), item("credit_account", side("cr", "credit_account_id")),
    )
    named = {"event_type": "type", "ledger": "ledger", "transfer_code": "transfer_code", "debit_account_code": "debit_account_now_code", "credit_account_code": "credit_account_now_code"}
    pairs = [x for k, c in named.items() for x in (F.lit(k), F.col(c).cast("string"))]
    headers = F.create_map(*pairs, F.lit("content_type"), F.lit("application/json"), F.lit("timestamp"), F.expr("timestamp div 1000000000").cast("string"))
    return changes.select("timestamp", headers.alias("headers"), whole.alias("body"))


def follow(
    spark: SparkSession, path: str, schema: str, publish: Callable[[DataFrame, int], None], checkpoint: str, transfers: Callable[[], DataFrame], accounts: Callable[[], DataFrame], after: int = 0, files_per_trigger: int | None = None, interval: str | None = None
) -> StreamingQuery:
    """Publish a message for each new event of the log at path, at least once; progress is kept in checkpoint, after publishing.

    transfers and accounts give the tables as they are when a batch comes, for what the log doesn't hold. after skips events up to
    that timestamp; files_per_trigger and interval limit the rate. Without an interval the stream ends when it has caught up.
    """

    def send(rows: DataFrame, number: int) -> None:
        publish(body(change_events(rows, transfers(), accounts(), ChangeEventsFilter(limit=2**31 - 1), None)), number)

    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path).where(F.col("timestamp") > after)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def deduplicated(messages: DataFrame) -> DataFrame:
    """What a consumer does about delivery more than once: timestamps are unique."""
    return messages.dropDuplicates(["timestamp"])
