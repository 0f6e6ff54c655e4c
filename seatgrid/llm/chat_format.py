r"""Chat formatting with a grammar round trip.

Grammar of a rendered conversation: ``<s>`` then one piece per turn, ``header text </s>``. Headers are
``<<SYS>> `` (system), ``[INST] `` (user), ``[/INST] `` (assistant) and ``<|name|> `` for any other role,
its name percent-encoded. Every control string (``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``<|...|>``, ``[INST]``,
``[/INST]``) is a token wherever it stands. The parser is deterministic: cut at ``</s>``, read the header, end the text at
the next token, unescape it. So a text with a control string in it never comes back whole unless it is escaped.

Escape: inside a text, a control string with k backslashes after its first character (``[INST]``,
``<\/s>``, ...) gets k + 1, and the parser takes one away, so the map is one to one on all texts.
Each conversation is first rendered as it is and reparsed; only where the recovered turns differ from the
source (a header in a text that is no encoded name counts as different) are its conflicting texts escaped and the parse repeated. A conversation that still differs
(none can, see the grammar) is reported by ``exact = false``.

Rows of a conversation go by turn (nulls first; ties by role, then text; repeated rows are turns of their
own). Null texts and roles are empty; a null conv_id is a conversation of its own. Only ``conv_id``,
``turn``, ``role`` and ``text`` are read. An empty table gives an empty result. One conversation becomes one
row, as its result is one string: that is the largest piece any task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
START, END = "<s>", "</s>"
HEADERS = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": "[/INST] "}
# After the first character and any backslashes; every control string starts with < or [.
TAILS = r"(s>|/s>|<SYS>>|<\/SYS>>|\|[^|<>\[\]]*\|>|INST\]|/INST\])"
CONTROL = r"([<\[])(\\*)" + TAILS
ESCAPED = r"([<\[])\\(\\*)" + TAILS
TOKEN = r"<(?:/?s>|</?SYS>>|\|[^|<>\[\]]*\|>)|\[/?INST\]"  # a control string as it is live, without backslashes


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _header(role: Column) -> Column:
    out = F.concat(F.lit("<|"), F.url_encode(role), F.lit("|> "))
    for name, mark in HEADERS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def render(turns: Column, escaped: bool) -> Column:
    """turns: array<struct<role, text>> to one string."""
    one = lambda t: F.concat(_header(t["role"]), escape(t["text"]) if escaped else t["text"], F.lit(END))
    return F.concat(F.lit(START), F.array_join(F.transform(turns, one), ""))


def parse_pieces(rendered: Column) -> Column:
    """Rendered string to array<struct<role, raw, skip>>: raw text as it stands, skip: header characters."""
    pieces = F.split(F.substring(rendered, len(START) + 1, 2_147_483_647), END, -1)
    body = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last </s> is empty

    def one(p: Column) -> Column:
        other = F.regexp_extract(p, r"^<\|([^|]*)\|> ", 1)
        role, skip = F.try_url_decode(other), F.char_length(other) + 5  # null: not a name that was ever encoded
        for name, mark in HEADERS.items():
            role = F.when(p.startswith(mark), F.lit(name)).otherwise(role)
            skip = F.when(p.startswith(mark), F.lit(len(mark))).otherwise(skip)
        raw = F.get(F.split(p.substr(skip + 1, F.char_length(p)), TOKEN, 2), F.lit(0))  # up to the next token
        return F.struct(role.alias("role"), raw.alias("raw"), skip.alias("skip"))

    return F.transform(body, one)


def parse(rendered: Column) -> Column:
    """Rendered string to array<struct<role, text>>."""
    return F.transform(parse_pieces(rendered), lambda p: F.struct(p["role"].alias("role"), unescape(p["raw"]).alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped (whether it had to be), exact (round trip
    holds), loss_spans array<struct<start, stop>> over code points of ``formatted``, assistant texts only."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    conv = conv.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = conv.withColumn("plain", render(F.col("turns"), False))
    tried = plain.withColumn("same", F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    done = tried.select("conv_id", "turns", (~F.col("same")).alias("escaped"),
                        F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("turns"), True)).alias("formatted"))
    checked = done.withColumn("pieces", parse_pieces(F.col("formatted"))).withColumn(
        "back", F.transform("pieces", lambda p: F.struct(p["role"].alias("role"), unescape(p["raw"]).alias("text"))))
    sizes = F.transform("pieces", lambda p: F.struct(p["role"].alias("role"), p["skip"].alias("skip"), F.char_length(p["raw"]).alias("n")))
    seen = F.aggregate(
        sizes, F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + p["skip"] + p["n"] + len(END)).alias("at"),
            F.when(p["role"] == "assistant", F.concat(a["spans"], F.array(F.struct(
                (a["at"] + p["skip"]).alias("start"), (a["at"] + p["skip"] + p["n"]).alias("stop"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return checked.select("conv_id", "formatted", "escaped", (F.col("back") == F.col("turns")).alias("exact"), seen.alias("loss_spans"))


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the rendered string and its loss mask alone."""
    f = F.col("formatted")
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(f.substr(s["start"] + 1, s["stop"] - s["start"]))), "")
    return formatted.withColumn("back", parse(f)).withColumn("learnt", learnt).select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length(f).cast("bigint").alias("formatted_chars"))


# The escape level and length of each conversation are worked out without parsing: a conversation is
# escaped if one of its texts holds a control string, with or without backslashes.
ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|<SYS>>|</SYS>>|\|[^|<>\[\]]*\|>|INST\]|/INST\])')) AS marks FROM r),
c AS (SELECT conv_id, max(marks) > 0 AS esc FROM e GROUP BY conv_id)
SELECT e.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(4 + length(text) + CASE WHEN esc THEN marks ELSE 0 END
                    + CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 7 WHEN 'assistant' THEN 8 ELSE 5 + length(role) END) AS BIGINT) AS formatted_chars
FROM e JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY e.conv_id"""
