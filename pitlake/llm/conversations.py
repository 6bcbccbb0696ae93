"""Message rows folded into turns, ordered and validated conversations.

The rows are an event log: creates, edits, deletes and retries of one message fold, by version, into its final turn. Validation is done by
aggregates: seq by counts, replies by one aggregation over messages and the rows that name them, combined before the shuffle, so that neither a run nor a
message that everyone answers is ever gathered in one task. A run with a third of all rows meets its verdict in a join of which adaptive execution splits
the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def speaker(name: Column) -> Column:
    """A sender regardless of case, outer spaces, and space or underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), r"[\s_]", "_")


def folded(log: DataFrame, message: str, version: Column, fields: dict[str, Column], deleted: Column | None = None) -> DataFrame:
    """The last version of each message as (message, fields); a message whose last version is deleted is left out.

    Of rows of one version (a retry) the greatest fields stand, which makes no difference to exact copies. Rows without a message id are left out.
    """
    gone = (F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))).alias("_gone")
    last = log.where(F.col(message).isNotNull()).groupBy(F.col(message).alias("message")).agg(F.max(F.struct(version.alias("_version"), gone, *[c.alias(k) for k, c in fields.items()])).alias("m"))
    return last.where("not m._gone").select("message", *[f"m.{k}" for k in fields])


def conversations(
    log: DataFrame, roles: DataFrame, run: str = "run_id", seq: str = "seq", message: str = "message_id", sender: str = "sender", payload: str = "payload", replies: str = "in_reply_to",
    version: Column | None = None, deleted: Column | None = None,
) -> DataFrame:
    """(run_id, turn, message_id, speaker_role) of each message of each sound run, turn = seq.

    A run is sound if its seq are 1 to n without gap or clash, every id in its replies is a message of the run with a smaller seq, it has a requester's
    message, and each of those is named by a non-requester's message of the run with content. No content: a null, unreadable or bare payload, no `content`,
    or white space alone. Messages with a null run are in none; a null seq or a null id among the replies damages the run; a null array names nobody.
    Senders that roles doesn't know have a null role and count as non-requesters. Repeated rows count once. Empty tables give no rows.
    """
    content = F.coalesce(F.get_json_object(F.col(payload), "$.content").rlike(r"(?U)\S"), F.lit(False))
    fields = {"run": F.col(run), "seq": F.col(seq).cast("int"), "sender": speaker(F.col(sender)), "content": content, "replies": F.array_distinct(F.col(replies))}
    turns = folded(log, message, F.unix_micros("created_at") if version is None and "created_at" in log.columns else (F.lit(0) if version is None else version), fields, deleted)
    role = F.broadcast(  # a fixed dimension of senders
        roles.select(speaker(F.col("sender")).alias("sender"), F.col("speaker_role").alias("role")).where("sender is not null").dropDuplicates(["sender"])
    )
    # read three times from one shuffle: that of the fold
    turns = turns.where("run is not null").join(role, "sender", "left").drop("sender")
    asks = F.coalesce(F.col("role") == "requester", F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    messages = turns.select("run", "message", "seq", asks.alias("asks"), none("int").alias("first"), none("boolean").alias("answered"))
    named = turns.select("run", F.explode("replies").alias("message"), none("int"), none("boolean"), F.coalesce("seq", F.lit(-(2**31))).alias("first"), (F.col("content") & ~asks).alias("answered"))
    # a message and the rows that name it: the message has one row, so its seq and asks are those of that row
    both = messages.withColumn("here", F.lit(1)).unionAll(named.withColumn("here", F.lit(0))).groupBy("run", "message").agg(
        F.max("seq").alias("seq"), F.max("asks").alias("asks"), F.min("first").alias("first"), F.max("answered").alias("answered"), F.max("here").alias("here")
    )
    # counts of each seq first, so that a clash shows without a distinct count of a whole run
    per = both.groupBy("run", "seq").agg(
        F.sum("here").alias("k"),
        F.max(F.coalesce((F.col("here") == 0) | F.col("seq").isNull() | (F.col("seq") >= F.col("first")), F.lit(False))).alias("broken"),
        F.max(F.coalesce(F.col("asks") & ~F.coalesce("answered", F.lit(False)), F.lit(False))).alias("unanswered"),
        F.max(F.coalesce("asks", F.lit(False))).alias("asked"),
    )
    sound = (
        per.groupBy("run")
        .agg(F.sum("k").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.max("k").alias("clash"), F.max("broken").alias("broken"), F.max("unanswered").alias("unanswered"), F.max("asked").alias("asked"))
        .where("low = 1 and high = n and clash = 1 and not broken and not unanswered and asked")
        .select(F.col("run").alias("sound_run"))
    )
    out = turns.join(sound, F.col("run") == F.col("sound_run"))
    return out.select(F.col("run").alias(run), F.col("seq").alias("turn"), F.col("message").alias(message), F.col("role").alias("speaker_role"))
