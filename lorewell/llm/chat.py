"""Chat formatting: conversations are rebuilt from event logs and rendered with a reversible template and a loss mask.

Events are ordered by sequence within their conversation. `message` opens a message; `delta` appends to the target
message; `edit` and `regenerate` begin a new version of it, which replaces all its earlier text. A target is the ordinal
of a message in its conversation; where it is null, deltas go to the message that the event before them touched and new
versions to the latest assistant message. Without a kind column every row is a message.
Null texts and roles count as empty, a null kind as `message`, null conversation ids form one conversation, events of
equal sequence are in order of kind, role and text, repeated rows are repeated events, an event without any message to
go to opens one, an empty table makes no conversations. DataFrame functions only. The events of a conversation are
folded by windows, which spill; its rendered text is one string, as any chat format needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings cannot appear inside texts, as their first characters are escaped; & first, so that it can be undone.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
LINE = ("\n", "&nl;")


def escape(text: Column, role: bool = False) -> Column:
    for a, b in (*ESCAPES, *[LINE] * role):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed((*ESCAPES, LINE)):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def fold(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text", kind_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """conv_id, ordinal, role, text of the final messages."""
    e = events.select(
        F.col(conv_col).alias("conv_id"), F.col(seq_col).alias("seq"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(kind_col), F.lit("message")).alias("kind") if kind_col else F.lit("message").alias("kind"), (F.col(target_col) if target_col else F.lit(None)).cast("long").alias("target"),
    )
    by = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    rows = by.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind") == "message"
    e = e.withColumn("n", F.row_number().over(by)).withColumn("opened", F.sum(opens.cast("long")).over(rows) - 1)
    latest = F.last(F.when(opens & (F.col("role") == "assistant"), F.col("opened")), ignorenulls=True).over(rows)
    e = e.withColumn("touched", F.when(opens, F.col("opened")).when(F.col("target").isNotNull(), F.col("target")).when(F.col("kind") != "delta", F.coalesce(latest, F.col("opened"))))
    e = e.withColumn("ordinal", F.coalesce(F.last("touched", ignorenulls=True).over(rows), F.lit(-1)))
    own = Window.partitionBy("conv_id", "ordinal").orderBy("n")
    fresh = (F.col("kind") != "delta").cast("long")
    e = e.withColumn("version", F.sum(fresh).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("versions", F.sum(fresh).over(Window.partitionBy("conv_id", "ordinal")))
    e = e.withColumn("said", F.first(F.when(opens, F.col("role")), ignorenulls=True).over(Window.partitionBy("conv_id", "ordinal").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    e = e.filter(F.col("version") == F.col("versions"))
    parts = F.sort_array(F.collect_list(F.struct("n", "text")))
    return e.groupBy("conv_id", "ordinal").agg(F.coalesce(F.first("said"), F.first("role")).alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points of each text under the loss mask)."""
    m = messages.withColumn("body", escape(F.col("text")))
    m = m.withColumn("piece", F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"), "body", F.lit(CLOSE)))
    rows = Window.partitionBy("conv_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("end", F.sum(F.length("piece").cast("long")).over(rows))
    span = F.struct((F.col("end") - len(CLOSE) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))
    m = m.withColumn("span", F.when(F.col("role") == loss_role, span))
    turns = F.sort_array(F.collect_list(F.struct("ordinal", "piece", "span")))
    g = m.groupBy("conv_id").agg(turns.alias("turns"))
    return g.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The template's inverse: array of (role, text)."""
    pieces = F.split(formatted, "<\\|im_end\\|>\n", -1)
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))

    def turn(p: Column) -> Column:
        at = F.locate("\n", p)
        return F.struct(unescape(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(F.substring(p, at + 1, F.length(p))).alias("text"))

    return F.transform(turns, turn)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all conversations and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(fold(rows)).withColumn("read", parse(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS body,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;') AS who
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(who) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
