"""Conversations as training texts with a loss mask. Spark expressions only.

The rows of a conversation are collected and sorted by turn. Adjacent turns of one role are merged into one block; blocks are joined to

    <s>[INST]role[/INST]first text[NEXT]second text</s><s>[INST]...

with the role's name between the INST marks and [NEXT] between the merged turns' texts, so the turns can be read back. In role names and
texts a backslash becomes two and a control string gets one after its first character, so no text can pose as a mark and
`unescaped` gives it back. The loss mask lists the places of the assistant's texts, without any mark.

Work grows in proportion to the text of a conversation, whatever its number of turns: offsets are running sums of rows.

Defined cases: a null text or role is empty. Turns are ordered by turn (null first), then role, then text; repeated rows are turns of
their own. Rows without conv_id are one conversation without id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
#: Code points of a page of formatted text
PAGE = 1024
#: What follows < or [ in the control strings of the template and of the usual chat formats; none of them has < or [ itself
CONTROLS = (r"/?s>", r"/?INST\]", r"NEXT\]", r"/?SYS>>", r"\|[A-Za-z_]+\|>")
_NAMES = "|".join(CONTROLS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_NAMES})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\(?={_NAMES})", "$1"), F.lit("\\\\"), F.lit("\\"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often a function inside reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (array of first, n: code points of formatted from 0)."""
    clean = rows.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # what a turn adds and where that ends is known per row, before a conversation becomes one array
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = [F.coalesce(f("role").over(order) == F.col("role"), F.lit(False)) for f in (F.lag, F.lead)]
    head = F.when(same[0], F.lit("[NEXT]")).otherwise(F.concat(F.lit("<s>[INST]"), escaped(F.col("role")), F.lit("[/INST]")))
    pieces = clean.select("conv_id", "turn", "role", "text", head.alias("mark"), escaped(F.col("text")).alias("safe"), F.when(same[1], F.lit("")).otherwise(F.lit("</s>")).alias("end"))
    pieces = pieces.withColumn("until", F.sum(F.length("mark") + F.length("safe") + F.length("end")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("until") - F.length("safe") - F.length("end")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(first.cast("int").alias("first"), F.length("safe").alias("n")))
    piece = F.struct("turn", "role", "text", "until", F.concat("mark", "safe", "end").alias("piece"), span.alias("span"))
    chats = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return chats.select("conv_id", F.size("p").cast("long").alias("n_turns"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
                        F.transform(F.filter("p", lambda x: x["span"].isNotNull()), lambda x: x["span"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array of (role, text): the turns of a formatted conversation."""
    # a backslash follows the first character of any control string inside a text, so the marks split nothing else
    blocks = F.filter(F.split(formatted, "<s>\\[INST\\]", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        texts = F.split(F.regexp_replace(F.substring_index(b, "</s>", 1), r"^(?s).*?\[/INST\]", ""), r"\[NEXT\]", -1)
        return _let(unescaped(F.substring_index(b, "[/INST]", 1)), lambda role: F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order. A span is cut from the pages of the text it lies on, not from the text's start."""
    def cut(pages: Column, s: Column) -> Column:
        page = F.floor(s["first"] / PAGE).cast("int")
        last = F.floor((s["first"] + F.greatest(s["n"], F.lit(1)) - 1) / PAGE).cast("int")
        return unescaped(F.substring(F.array_join(F.slice(pages, page + 1, last - page + 1), ""), s["first"] - page * PAGE + 1, s["n"]))

    return _let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PAGE}}}"), 0), lambda pages: F.array_join(F.transform(spans, lambda s: cut(pages, s)), ""))


def chat_digest(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts."""
    read = format_conversations(rows).select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars")


#: The conversation that tries to pose as marks
INTRUDER = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|NEXT\]|/?SYS>>|\|[A-Za-z_]+\|>)', '\1.\2', 'g')) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|NEXT\]|/?SYS>>|\|[A-Za-z_]+\|>)', '\1.\2', 'g')) AS r
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before = role THEN 6 ELSE 16 + r END + CASE WHEN after = role THEN 0 ELSE 4 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id
"""
