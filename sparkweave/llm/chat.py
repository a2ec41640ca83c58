"""Chat formatting with Spark expressions only: sort turns, merge neighbours of one role, concatenate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", start: str = START, end: str = END) -> DataFrame:
    """One row per conversation: ``(conv_id, n_turns, n_messages, chat)``.

    Turns are sorted by (turn, role, text), so ties and repeated rows give one defined order;
    a null turn sorts first, a null role is ``user`` and a null text is empty. Adjacent turns of one role
    become one message, joined by a newline. Markers inside a text or a role are broken with a zero-width space, so
    neither can open or close a message. Rows with a null conversation id form one conversation of their own.
    An empty table gives an empty result; further columns are ignored.
    """
    safe, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit("user"))
    for mark in (start, end):
        safe, who = (F.replace(c, F.lit(mark), F.lit(mark[:1] + "​" + mark[1:])) for c in (safe, who))
    item = F.struct(F.col(turn).cast("long").alias("turn"), who.alias("role"), safe.alias("text"))
    sorted_turns = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("_turns"))
    # Break points first, then one slice per message: linear in the turns, where folding into a growing array would not be.
    n = F.size("_turns")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(F.col("_turns"), i)["role"] != F.get(F.col("_turns"), i - 1)["role"]))
    cut = sorted_turns.withColumn("_heads", heads)
    nexts = F.concat(F.slice("_heads", 2, F.size("_heads")), F.array(n))
    message = F.transform(
        F.arrays_zip(F.col("_heads").alias("a"), nexts.alias("b")),
        lambda s: F.concat(
            F.lit(start), F.get(F.col("_turns"), s["a"])["role"], F.lit("\n"),
            F.array_join(F.transform(F.slice(F.col("_turns"), s["a"] + 1, s["b"] - s["a"]), lambda t: t["text"]), "\n"), F.lit(end + "\n"),
        ),
    )
    return cut.select("conv_id", n.cast("long").alias("n_turns"), F.size("_heads").cast("long").alias("n_messages"), F.array_join(message, "").alias("chat"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'user'), '{START}', '<' || chr(8203) || '|im_start|>'), '{END}', '<' || chr(8203) || '|im_end|>') AS role,
                  replace(replace(coalesce(text, ''), '{START}', '<' || chr(8203) || '|im_start|>'), '{END}', '<' || chr(8203) || '|im_end|>') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
b AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY k) = role THEN 0 ELSE 1 END AS head FROM o),
g AS (SELECT *, sum(head) OVER (PARTITION BY conv_id ORDER BY k) AS msg FROM b),
m AS (SELECT conv_id, msg, count(*) AS n, '{START}' || any_value(role) || chr(10) || string_agg(text, chr(10) ORDER BY k) || '{END}' || chr(10) AS body FROM g GROUP BY conv_id, msg)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages, string_agg(body, '' ORDER BY msg) AS chat FROM m GROUP BY conv_id
"""
