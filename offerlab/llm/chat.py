"""Chat formatting with a grammar round trip, in Spark SQL functions only.

Template, one turn after the other in turn order::

    ### <role>: <text></turn>\\n

Parser (deterministic): cut the string at every ``</turn>\\n``; each piece is
``### ``, a role without an unescaped ``:``, ``: `` and the body. A backslash
inside a role or a body stands for the character after it.

Round trip: every turn is first written raw, reparsed alone and compared to
its source; a turn that does not come back is escaped (a backslash before
each backslash and inside each control string). The whole string is then
reparsed and compared; if turns still differ, all of them are escaped, which
provably parses back: an escaped part holds neither ``</turn>`` nor an
unescaped ``:`` in its role. A string that still differed would raise.

Defined results: null text and null role read as empty; rows whose conv_id is
null form one conversation; ties in turn order break by role, then text;
repeated rows stay as turns of their own; an empty table gives no rows;
further columns of the input are not carried (one row per conversation).

One conversation becomes one string, so a conversation is the unit that must
fit a task; rows are gathered per conversation only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlab.llm.common import need, text_or_empty

OPEN, CLOSE, END = "### ", "</turn>", "</turn>\n"


def _each(array: Column, f) -> Column:
    return F.transform(array, f)


def escape_body(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(CLOSE), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("###"), F.lit("#\\##"))


def escape_role(role: Column) -> Column:
    return F.replace(escape_body(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    """A backslash gives the character after it; read left to right, once."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(END))


def parse_turn(piece: Column) -> Column:
    """One piece between turn ends -> struct(role, body), both still escaped."""
    header = r"(?s)\A### ((?:[^\\:]++|\\.)*+): (.*)\z"
    return F.struct(F.regexp_extract(piece, header, 1).alias("role"),
                    F.regexp_extract(piece, header, 2).alias("body"))


def pieces_of(formatted: Column) -> Column:
    pieces = F.split(formatted, F.lit(r"\Q" + END + r"\E"), F.lit(-1))
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what follows the last turn end is empty


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as array of struct(role, text)."""
    def one(piece):
        t = parse_turn(piece)
        return F.struct(unescape(t["role"]).alias("role"), unescape(t["body"]).alias("text"))

    return _each(pieces_of(formatted), one)


def spans(formatted: Column, loss_role: str) -> Column:
    """(start, chars) of each escaped body of ``loss_role``, in code points from 0."""
    sized = _each(pieces_of(formatted), lambda p: F.struct(
        F.char_length(p).alias("n"), F.char_length(parse_turn(p)["body"]).alias("b"),
        (unescape(parse_turn(p)["role"]) == loss_role).alias("on")))
    empty = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<struct<start:int,chars:int>>)").alias("found"))

    def add(acc, x):
        span = F.struct((acc["next"] + x["n"] - x["b"]).cast("int").alias("start"), x["b"].cast("int").alias("chars"))
        return F.struct((acc["next"] + x["n"] + len(END)).cast("int").alias("next"),
                        F.when(x["on"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sized, empty, add)["found"]


def _sources(turns: Column) -> Column:
    return _each(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _render(turns: Column) -> Column:
    return F.array_join(_each(turns, lambda t: t["shown"]), "")


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted string, loss_spans (start, chars of each body under the loss mask)."""
    need(rows, conv, turn, role, text)
    r, t = text_or_empty(role), text_or_empty(text)
    raw = render_turn(r, t)
    escaped = render_turn(escape_role(r), escape_body(t))
    # round 1, per turn: written raw, cut and parsed alone, compared to its source
    pieces = F.split(F.col("_raw"), F.lit(r"\Q" + END + r"\E"), F.lit(-1))
    alone = parse_turn(F.element_at(pieces, 1))
    came_back = ((F.size(pieces) == 2) & (F.element_at(pieces, 2) == "") & (F.col("_raw") == F.concat(
        F.lit(OPEN), alone["role"], F.lit(": "), alone["body"], F.lit(END)))
        & (unescape(alone["role"]) == F.col("_role")) & (unescape(alone["body"]) == F.col("_text")))
    turns = (rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), r.alias("_role"), t.alias("_text"),
                         raw.alias("_raw"), escaped.alias("_escaped"))
             .withColumn("_shown", F.when(F.coalesce(came_back, F.lit(False)), F.col("_raw")).otherwise(F.col("_escaped"))))
    grouped = turns.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct(
        F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"),
        F.col("_shown").alias("shown")))).alias("_turns"))
    # round 2: the whole string; round 3 (all turns escaped) only where round 2 differs
    first = grouped.withColumn("_first", _render(F.col("_turns")))
    second = first.withColumn("formatted", F.when(
        _sources(parse(F.col("_first"))) == _sources(F.col("_turns")), F.col("_first")).otherwise(
        F.array_join(_each(F.col("_turns"), lambda x: render_turn(escape_role(x["role"]), escape_body(x["text"]))), "")))
    checked = F.when(_sources(parse(F.col("formatted"))) == _sources(F.col("_turns")), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a formatted conversation does not parse back to its turns")))
    return second.select(F.col("_conv").alias(conv), checked.alias("formatted")).withColumn(
        "loss_spans", spans(F.col("formatted"), loss_role))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, taken from the string and its loss spans alone."""
    turns = formatted.withColumn("_turns", parse(F.col("formatted")))
    loss = F.array_join(_each(F.col("loss_spans"), lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["chars"]))), "")
    said = F.array_join(_each(F.col("_turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.withColumn("_loss", loss).select(
        F.col(conv), F.size("_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
