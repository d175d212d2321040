r"""Chat formatting with a loss mask, in Spark functions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role are merged into a block. A block reads

    ### role:\n text <next> text </turn>\n        (without the spaces)

and texts are escaped (\ to \b, < to \l, # to \h) so that no marker can occur
in them; roles also have their line feeds escaped. The escape is undone exactly.
The loss mask comes as spans of the formatted text's UTF-8 bytes, in order. Every
assistant text is one span; headers, <next> and </turn> never are under the mask.

Turns are first collected in chunks of CHUNK_TURNS, so a long conversation is
sorted in parts before its rows meet in the one row that must hold it.

Results in special cases: null text or role reads back as empty; turns of equal
number are ordered by role, then text, as they are before escaping; a null turn number comes first; rows with
a null conv_id form one conversation; repeated rows are repeated turns; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_TURNS = 256
HEAD, NEXT, END = "### ", "<next>", "</turn>\n"
#: Escapes, in the order in which they are applied; undone in reverse.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _sums_before(lengths: Column, start: Column) -> Column:
    """start and the lengths before each of them, summed up; for short arrays."""
    zero = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _places(lengths: Column) -> Column:
    """The sums of the lengths before each, in two levels, so that arrays stay short."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK_TURNS).cast("int")), lambda k: F.slice(lengths, k * CHUNK_TURNS + 1, F.lit(CHUNK_TURNS)))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(parts, _sums_before(totals, F.lit(0).cast("long")), _sums_before))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and mask (start, length) of every conversation in
    turns(conv_id, turn, role, text); mask spans are in bytes, starts from 0."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = turns.groupBy("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    chats = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "turns"))).alias("parts"))
    in_order = chats.select("conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("t"))
    escaped = F.transform("t", lambda x: F.struct(_escape_role(x["role"]).alias("role"), escape(x["text"]).alias("text")))
    sorted_turns = in_order.select("conv_id", escaped.alias("t"))
    t = F.col("t")
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at(t, F.greatest(i - 1, F.lit(1)))["role"] != F.element_at(t, i)["role"]))
    merged = sorted_turns.withColumn("s", starts).withColumn(
        "blocks",
        F.transform(
            "s",
            lambda i, k: F.struct(
                F.element_at(t, i)["role"].alias("role"),
                F.transform(F.slice(t, i, F.coalesce(F.get("s", k + 1), F.size("t") + 1) - i), lambda x: x["text"]).alias("texts"),
            ),
        ),
    )
    never = F.lit(False)

    def segments(b: Column) -> Column:
        texts = F.flatten(F.transform(b["texts"], lambda x, k: F.when(k == 0, F.array(_segment(x, b["role"] == "assistant"))).otherwise(F.array(_segment(F.lit(NEXT), never), _segment(x, b["role"] == "assistant")))))
        return F.concat(F.array(_segment(F.concat(F.lit(HEAD), b["role"], F.lit(":\n")), never)), texts, F.array(_segment(F.lit(END), never)))

    cut = merged.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    lengths = cut.select("conv_id", "segments", F.transform("segments", lambda x: F.octet_length(x["text"]).cast("long")).alias("lengths"))
    placed = lengths.select("conv_id", "segments", "lengths", _places(F.col("lengths")).alias("starts"))
    spans = F.zip_with("starts", "lengths", lambda a, n: F.struct(a.alias("start"), n.alias("length")))
    mask = F.filter(F.zip_with("segments", spans, lambda x, p: F.when(x["loss"], p)), lambda p: p.isNotNull())
    return placed.select("conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), mask.alias("mask"))


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    blocks = F.split(formatted, END)
    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        head = F.substring_index(b, ":\n", 1)
        role = _unescape_role(F.substr(head, F.lit(len(HEAD) + 1)))
        return F.transform(F.split(F.substr(b, F.length(head) + 3), NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(whole, turns))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, read from the formatted text and unescaped."""
    data = formatted.cast("binary")
    read = F.transform(mask, lambda m: unescape(F.substr(data, (m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string")))
    return F.array_join(read, "")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    chats = format_chats(turns)
    read = chats.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold marker-like strings of chat templates.
PROBE = r"\### Assistant: </turn> ok"


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
         length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))) AS n,
         length(role) + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), chr(10), ''))) AS nr
  FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN prev IS NULL OR prev <> role THEN nr + 14 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
