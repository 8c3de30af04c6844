"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn := "<s>" role newline text "</s>"              role assistant, under the loss mask
          | "[INST]" role newline text "[/INST]"        any other role

Every turn is rendered, parsed again and compared with its source. A turn that doesn't come back the same, or whose
content holds a control string, is escaped: a backslash goes after the first sign of every control string, and one more
where some are there already, so taking one away restores the text. Escaped turns are parsed and compared too; a turn
that still differs is an error. Conversations are put together from chunks of 64 turn numbers, so that a long one isn't
sorted in one piece.

Null roles and texts count as empty. Turns of one number are ordered by role, then text; a null number comes first.
Repeated rows are turns of their own. A null conversation id is one conversation. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that one chunk of a conversation spans.
CHUNK = 64
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
TURN = r"(?s)(?:<s>|\[INST\])(.*?)(?:</s>|\[/INST\])"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """One more backslash inside every control string."""
    return F.regexp_replace(text, r"([<\[])(\\*/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    """One backslash less inside every escaped control string."""
    return F.regexp_replace(text, r"([<\[])\\(\\*/?(?:s>|INST\]))", "$1$2")


def role_line(role: Column) -> Column:
    """A role as one line: per cent signs and newlines by their codes."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def role_of_line(line: Column) -> Column:
    """The inverse of ``role_line``."""
    return F.replace(F.replace(line, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, line: Column, text: Column) -> Column:
    """One turn in the template."""
    masked = role == ASSISTANT
    return F.concat(F.when(masked, "<s>").otherwise("[INST]"), line, F.lit("\n"), text, F.when(masked, "</s>").otherwise("[/INST]"))


def bodies(rendered: Column) -> Column:
    """What stands between the marks of each turn."""
    return F.regexp_extract_all(rendered, F.lit(TURN), F.lit(1))


def body_role(body: Column) -> Column:
    return role_of_line(unescape(F.substring_index(body, "\n", 1)))


def body_text(body: Column) -> Column:
    return unescape(F.substring(body, F.locate("\n", body) + 1, F.length(body)))


def returns(rendered: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn parses to exactly its source and holds no control string but its own two marks."""
    parsed = bodies(rendered)
    whole = (F.size(parsed) == 1) & (F.size(F.regexp_extract_all(rendered, F.lit(CONTROL), F.lit(0))) == 2)
    return F.coalesce(whole & (body_role(parsed[0]) == role) & (body_text(parsed[0]) == text), F.lit(False))


def format_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` with ``rendered``, raw where that round trip is exact, escaped elsewhere; a column of that name is replaced."""
    named = turns.withColumns({role: F.coalesce(role, F.lit("")), text: F.coalesce(text, F.lit(""))})
    r, t = F.col(role), F.col(text)
    plain, safe = render(r, role_line(r), t), render(r, escape(role_line(r)), escape(t))
    return named.withColumn("rendered", F.when(returns(plain, r, t), plain).when(returns(safe, r, t), safe).otherwise(F.raise_error(F.lit("a turn can't be rendered reversibly"))))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted): one row per conversation."""
    rendered = format_turns(turns.select(conv_id, turn, role, text), role, text)
    chunk = F.floor(F.col(turn) / CHUNK).alias("chunk")
    text_of = lambda rows: F.array_join(F.transform(rows, lambda x: x["rendered"]), "")
    chunks = rendered.groupBy(conv_id, chunk).agg(text_of(F.array_sort(F.collect_list(F.struct(F.coalesce(turn, F.lit(-(1 << 63))).alias("n"), role, text, "rendered")))).alias("rendered"))
    return chunks.groupBy(conv_id).agg(text_of(F.array_sort(F.collect_list(F.struct(F.coalesce("chunk", F.lit(-(1 << 63))).alias("n"), "rendered")))).alias("formatted"))


def read_back(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars): turns is an array of (role, text) as the parser finds them.

    ``loss_text`` is the unescaped text of all assistant turns in order.
    """
    turns = F.transform(bodies(F.col("formatted")), lambda b: F.struct(body_role(b).alias("role"), body_text(b).alias("text")))
    masked = F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"])
    return formatted.select(conv_id, turns.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars")).withColumn("loss_text", F.array_join(masked, ""))
