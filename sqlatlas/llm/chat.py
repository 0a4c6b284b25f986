r"""Chat formatting: relational, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role make a block:

    ### role: text</turn>text</turn>\n

so a block opens once and every turn inside it ends with ``</turn>``. Inside texts and roles ``\`` is written
``\\``, ``</turn>`` is ``\e``, ``###`` is ``\h``, and in roles ``:`` is ``\c``; no control string is left in them, and
``parsed`` reads everything back. ``loss_spans`` are the code-point ranges of the assistant texts.

Turns sort by turn, role, text (nulls first), so ties and repeated rows have a defined order; repeated rows are turns of
their own. Null text or role is empty. Rows with a null conv_id make one conversation. An empty table gives no rows. Extra columns
are ignored. One output row is one conversation, so its turns meet in one task; one shuffle by conv_id serves both aggregates and the window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

END, MARK = "</turn>", "### "
#: Code points that a span is cut from.
CHUNK = 1024


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), (END, "\\e"), ("###", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Split at the pairs of backslashes, left to right, then undo the other codes in what lies between."""

    def part(x: Column) -> Column:
        for plain, code in ((END, "\\e"), ("###", "\\h"), (":", "\\c")):
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: the optimiser does not copy an array into the lambdas that index it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<lo, hi>> (code points from 0, hi exclusive).

    Time is linear in a conversation's turns: each turn meets only the one before it, and places are a running sum.
    """
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"])), 1, F.size("turns"))

    def part(t: Column, before: Column) -> Column:
        head = F.concat(F.lit(MARK), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
        head = F.when(before.isNull(), head).when(before != t["role"], F.concat(F.lit("\n"), head)).otherwise("")
        return F.struct(head.alias("head"), t["role"].alias("role"), escaped(t["text"]).alias("text"))

    # a block opens where the role changes; the others of its turns merge into it
    parts = convs.select("conv_id", F.posexplode(F.zip_with("turns", before, part)).alias("k", "p"))
    piece = F.concat("p.head", "p.text", F.lit(END))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum(F.length(piece).cast("long")).over(upto) - len(END)
    told = parts.select("conv_id", F.struct("k", piece.alias("piece"), F.col("p.role").alias("role"), (hi - F.length("p.text")).alias("lo"), hi.alias("hi")).alias("t"))
    chats = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["lo"].alias("lo"), t["hi"].alias("hi")))
    return chats.select("conv_id", F.concat(F.array_join(F.transform("turns", lambda t: t["piece"]), ""), F.lit("\n")).alias("formatted"), spans.alias("loss_spans"))


def parsed(chats: DataFrame) -> DataFrame:
    """Reads formatted conversations back: adds turns array<struct<role, text>> and loss_text (what the spans cover)."""

    def block(texts: Column) -> Column:
        """The turns of a block, from its texts; the first has the role before it."""
        return let(F.substring_index(F.get(texts, F.lit(0)), ": ", 1), lambda role: let(unescaped(role), lambda plain: F.transform(texts, lambda x, i: F.struct(plain.alias("role"), unescaped(F.when(i == 0, F.substring(x, F.length(role) + 3, F.length(x))).otherwise(x)).alias("text")))))

    # block heads can only follow an end mark and a newline, since texts hold no '###'
    body = F.substring(F.col("formatted"), F.lit(len(MARK) + 1), F.length("formatted") - (len(MARK) + len(END) + 1))
    turns = F.flatten(F.transform(F.split(body, f"{END}\n{MARK}"), lambda b: let(F.split(b, END), block)))

    def covered(chunks: Column) -> Column:
        """Each span from the chunks that hold it, so that a long conversation is not passed once a span."""

        def cut(s: Column) -> Column:
            first, last = F.floor(s["lo"] / CHUNK).cast("int"), F.floor(s["hi"] / CHUNK).cast("int")
            return unescaped(F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), (s["lo"] % CHUNK + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))

        return F.array_join(F.transform("loss_spans", cut), "")

    loss = let(F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), covered)
    return chats.withColumns({"turns": turns, "loss_text": loss})


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    read = parsed(formatted(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h') AS etext,
         replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c') AS erole,
         lag(role) OVER w AS before, row_number() OVER w AS k
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(etext) + 7 + CASE WHEN k = 1 THEN length(erole) + 6 WHEN before <> role THEN length(erole) + 7 ELSE 0 END) + 1 AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
