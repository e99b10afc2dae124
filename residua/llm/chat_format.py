r"""Conversations as training text: a template whose output a deterministic parser reads back to the same turns.

The grammar is

    conversation = turn*
    turn         = "### " name ": " content "\n</turn>\n"

A name is the role where that is lower-case letters only, else "%" and the role's UTF-8 bytes in hex. Content is the text
with one backslash before each control string ("### " or "</turn>"). A parser ends a turn at the first "\n</turn>\n", takes
what lies between the first "### " and ": " as name, refuses content that holds a control string without a backslash, and
takes one backslash away before each control string.

Every conversation is rendered as it is, parsed, and compared with its source; turns that come back otherwise are escaped,
and the result is parsed and compared again. One round of escaping suffices: it adds one backslash to each control string,
so k of them become k + 1 and are read as k; control strings hold no line feed, so none arises across the joints of the
template, and an escaped text cannot hold "\n</turn>\n". `identical` says so for each row all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = "(### |</turn>)"
END = "\n</turn>\n"

#: Fixed values of the query's extra conversation.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(content: Column) -> Column:
    return F.regexp_replace(content, r"\\" + CONTROL, "$1")


def _name(role: Column) -> Column:
    return F.when(role.rlike(r"^[a-z]+\z"), role).otherwise(F.concat(F.lit("%"), F.hex(role)))


def _role(name: Column) -> Column:
    return F.when(name.startswith("%"), F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8")).otherwise(name)


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), _name(role), F.lit(": "))


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; a turn that the grammar refuses is null."""
    blocks = F.split(formatted, END)  # the last one is what follows the last end: nothing

    def turn(block: Column) -> Column:
        name = F.regexp_extract(block, r"\A### ([a-z]+|%[0-9A-F]*): ", 1)
        content = F.substr(block, F.length(name) + 7)
        return F.when((name != "") & ~content.rlike(r"(?<!\\)" + CONTROL), F.struct(_role(name).alias("role"), unescape(content).alias("text")))

    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(id, formatted, turns, identical): each conversation's training text, and for each turn
    struct(role, start, length, loss): where its content stands in formatted, in code points from 0, and whether the loss counts it.

    Turns are in the order of turn (nulls first), role, text. Each text is escaped, measured and checked in its own row; only
    finished turns meet. A conversation's text is one string, as its digests are, so it must stay under Spark's 2 GB a value.

    Defined cases: a null text or role is empty (an empty role is the name "%"); a null id is a conversation of its own;
    repeated rows are repeated turns; tied turns go by role and text; other columns are ignored; an empty table gives an
    empty table.
    """
    rows = conversations.select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    alone = parse_chat(F.concat(_head(F.col("r")), F.col("x"), F.lit(END)))  # the turn as it is, read back
    same = (F.size(alone) == 1) & F.coalesce((F.get(alone, F.lit(0))["role"] == F.col("r")) & (F.get(alone, F.lit(0))["text"] == F.col("x")), F.lit(False))
    rows = rows.withColumn("content", F.when(same, F.col("x")).otherwise(escape(F.col("x"))))
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "x").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"head": F.length(_head(F.col("r"))).cast("long"), "length": F.length("content").cast("long")})
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("head") + F.col("length") + len(END)).over(order), F.lit(0)) + F.col("head"))
    chats = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("start", "length", "r", "x", "content"))).alias("list"))
    chats = chats.select(
        "c",
        F.array_join(F.transform("list", lambda z: F.concat(_head(z["r"]), z["content"], F.lit(END))), "").alias("formatted"),
        F.transform("list", lambda z: F.struct(z["r"].alias("role"), z["start"], z["length"], (z["r"] == loss_role).alias("loss"))).alias("turns"),
        F.transform("list", lambda z: F.struct(z["r"].alias("role"), z["x"].alias("text"))).alias("source"),
    )
    return chats.select(F.col("c").alias(id_col), "formatted", "turns", F.coalesce(parse_chat(F.col("formatted")) == F.col("source"), F.lit(False)).alias("identical"))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) and one more conversation, whose texts hold what the template escapes."""
    said = conversations.sparkSession.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(said)


def chat_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader of format_chats' output finds: the parser's turns, and their texts where the mask counts them."""
    read = formatted.select(id_col, "formatted", "turns", "identical", parse_chat(F.col("formatted")).alias("back"))
    lost = F.array_join(F.transform(F.filter(F.arrays_zip("back", "turns"), lambda z: z["turns"]["loss"]), lambda z: z["back"]["text"]), "")
    read = read.withColumn("lost", lost).withColumn("all", F.array_join(F.transform("back", lambda z: F.concat(z["role"], F.lit("\n"), z["text"], F.lit("\n"))), ""))
    return read.select(
        id_col, F.size("back").cast("long").alias("n_turns"), F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "identical",
    )


def chat_sql() -> str:
    """DuckDB SQL of the query, from the source turns alone."""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'
), sized AS (
  SELECT *, 15 + length(CASE WHEN regexp_full_match(role, '[a-z]+') THEN role ELSE '%' || hex(role) END) + length(regexp_replace(text, '{CONTROL}', '\\\\\\1', 'g')) AS chars FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS lost, sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars, true AS identical FROM whole"""
