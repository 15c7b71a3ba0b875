"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``. Control strings inside roles and texts are escaped with a
backslash after their first character (backslashes are doubled first), which :func:`unescape` undoes exactly.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
# Openings of the control strings of common chat templates.
CONTROL = r"([<\[])(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(SEP), escape(text), F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """Back from formatted text to an array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 2**31 - 2)

    def one(part: Column) -> Column:
        body = F.left(part, F.length(part) - F.lit(len(END)))
        return F.struct(unescape(F.substring_index(body, SEP, 1)).alias("role"), unescape(F.substring(body, F.length(F.substring_index(body, SEP, 1)) + len(SEP) + 1, 2**31 - 1)).alias("text"))

    return F.transform(parts, lambda p: F.struct(*[one(p)[n].alias(n) for n in ("role", "text")]))


def expand_chats(turns: DataFrame) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text).

    One row per assistant turn: ``formatted`` is the context and the reply, ``loss_start`` / ``loss_end`` the half-open
    code-point span of the reply. Turns after the last reply (or a conversation without one) give one more row with an
    empty span, so that no turn is lost. ``n_turns`` is the number of turns in the row.

    * Null roles and texts count as empty; turns that tie on ``turn`` go by role and text; null turns come first.
    * Rows of one conversation are gathered by its id (a conversation is one text in the end, so it must fit a row); the
      examples are made row by row after that, without another exchange.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    formatted = clean.select("conv_id", F.struct("turn", "role", "text", format_turn(F.col("role"), F.col("text")).alias("f"), F.length(escape(F.col("text"))).alias("n")).alias("t"))
    whole = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select("conv_id", F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("a"), t["f"].alias("f"), t["n"].alias("n"))).alias("ts"))
    last = F.size("ts")
    spots = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at(F.col("ts"), i)["a"] | (i == F.size("ts")))
    rows = whole.select("conv_id", "ts", F.explode(spots).alias("n_turns"))
    rows = rows.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform(F.slice("ts", 1, F.col("n_turns")), lambda t: t["f"]), "").alias("formatted"),
        F.element_at("ts", F.col("n_turns")).alias("t"),
    )
    end = F.length("formatted") - len(END)
    return rows.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        "formatted",
        F.when(F.col("t.a"), end - F.col("t.n")).otherwise(end).alias("loss_start"),
        end.alias("loss_end"),
    )


def chat_digest(turns: DataFrame) -> DataFrame:
    """Read back from the examples: each conversation's turns and all text under the loss mask."""
    examples = expand_chats(turns)
    masked = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = examples.select(
        "conv_id",
        "n_turns",
        masked.alias("reply"),
        F.length("formatted").cast("long").alias("chars"),
        "formatted",
    )
    # only the longest example has all turns; it is parsed after the conversation's rows have met
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("formatted", "n_turns").alias("formatted"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_turns", "reply"))), lambda r: r["reply"]), "").alias("reply"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size(parse_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("reply").cast("long").alias("loss_chars"),
        F.sha2(F.col("reply").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    cols = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    return turns.select(*cols).unionByName(probe)


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         32 + length(regexp_replace(replace(role, chr(92), chr(92) || chr(92)), '([<\[])(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1#\2', 'g'))
            + length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '([<\[])(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1#\2', 'g'))
           + 1 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), prefix AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM prefix GROUP BY conv_id
"""
