"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes a row of segments, in turn order, whose texts in a row are the formatted conversation. Every
assistant turn is a target; expand() explodes them into one example each: all preceding turns as context, that reply
alone trainable. Prefixes are slices of the one row of segments, so they are stored once and grow only when expanded.

Texts are escaped reversibly (& as &amp; and <| as &lt;|), and so are roles with their line breaks, so control strings
inside them can't be taken for marks. Null texts and roles are empty. Turns that tie are ordered by role and text, null
turns first; rows of a null conv_id are a conversation of their own. Conversations without an assistant turn have no
target. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def formatted(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, segments (array of struct text, target), targets (array of int).

    Each turn makes three segments: its head, its body, its end. targets are the numbers of the bodies of assistant
    turns, from 0.
    """
    turns = df.select(F.col(conv_col), F.struct(F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    rows = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list("t")).alias("t"))
    part = lambda text, target: F.struct(text.alias("text"), target.alias("target"))
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;"))
    no = F.lit(False)
    segments = F.flatten(F.transform("t", lambda t: F.array(part(F.concat(F.lit(START), role(t), F.lit("\n")), no), part(escape(t["text"]), t["role"] == "assistant"), part(F.lit(END), no))))
    return rows.select(conv_col, segments.alias("segments")).select("*", F.filter(F.transform("segments", lambda s, i: F.when(s["target"], i)), lambda i: i.isNotNull()).alias("targets"))


def expand(of: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per assistant turn: conv_col, example (from 0), context (all text before the reply), reply, end."""
    text = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), "")
    return of.select(conv_col, "segments", F.posexplode("targets").alias("example", "_k")).select(conv_col, "example", text(F.slice("segments", 1, F.col("_k"))).alias("context"), F.get("segments", F.col("_k"))["text"].alias("reply"), F.get("segments", F.col("_k") + 1)["text"].alias("end"))


def read_back(of: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Conversations from their formatted text: conv_col, turns (array of struct role, text), loss (array of string), formatted_chars.

    Turns are parsed from the marks in the text; loss holds what each target leaves trainable, unescaped.
    """
    d = of.select(conv_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("_f"), F.transform("targets", lambda k: unescape(F.get("segments", k)["text"])).alias("loss"))
    return _turns(d, conv_col)


def _turns(d: DataFrame, conv_col: str) -> DataFrame:
    """conv_col, turns, loss, formatted_chars from conv_col, _f (formatted text) and loss."""
    d = d.select(conv_col, "loss", F.length("_f").cast("long").alias("formatted_chars"), F.filter(F.split("_f", r"<\|im_end\|>\n"), lambda x: x != "").alias("_p"))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        role = unescape(F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit("&#10;"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substr(x, F.length(head) + 2)).alias("text"))

    return d.select(conv_col, F.transform("_p", turn).alias("turns"), "loss", "formatted_chars")


def joined(of: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, _f (formatted text), loss: conversations put together from their examples.

    The text is the last example and the turns after it; a reply counts as loss if its context ends in an assistant's
    head. Conversations without an example are their turns alone.
    """
    loss = F.when(F.endswith("context", F.lit(f"{START}assistant\n")), unescape(F.col("reply")))
    by = expand(of, conv_col).groupBy(F.col(conv_col).alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]).alias("loss"), F.max_by(F.concat("context", "reply", "end"), "example").alias("_head"))
    after = F.slice("segments", F.coalesce(F.get("targets", F.size("targets") - 1), F.lit(-2)) + 3, F.size("segments"))
    rest = of.select(conv_col, F.array_join(F.transform(after, lambda s: s["text"]), "").alias("_rest"))
    d = rest.join(by, F.col(conv_col).eqNullSafe(F.col("_c")), "left")
    return d.select(conv_col, F.concat(F.coalesce("_head", F.lit("")), "_rest").alias("_f"), F.coalesce("loss", F.array().cast("array<string>")).alias("loss"))


def digest(of: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the examples of formatted()."""
    d = _turns(joined(of, conv_col), conv_col)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = d.select(conv_col, F.size("turns").cast("long").alias("n_turns"), said.alias("_s"), F.array_join("loss", "").alias("_l"), "formatted_chars")
    return d.select(conv_col, "n_turns", F.sha2(F.encode("_s", "utf-8"), 256).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"), F.sha2(F.encode("_l", "utf-8"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS t, replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
