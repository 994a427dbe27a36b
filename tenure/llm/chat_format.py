r"""Chat formatting with a grammar round trip.

Each turn is rendered as ``<|im_start|>role``, a line break, the text and
``<|im_end|>``, and a line break. A deterministic parser reads the rendered text
back. Where the recovered turn differs from its source, the turn's text is
escaped and rendered again; a conversation whose parse still differs has every
turn escaped. Escaping puts one more backslash between ``<`` and ``|`` (``<|``
becomes ``<\|``, ``<\|`` becomes ``<\\|``), and the parser takes one away, so an
escaped text holds no control string and always comes back as it was. Roles are
written with ``%``, ``<`` and line breaks as ``%25``, ``%3C`` and ``%0A``.

Only DataFrame functions run. The turns of a conversation meet in one row, as the
formatted text is one value; equal conversations stay apart. The places of the texts are
running sums of lengths over a conversation's turns, and texts are cut out of their own
turn's part, so the time grows with the turns and not with their square.

Defined results. A null role or text counts as empty, a null turn sorts first, and
turns of the same number are ordered by role and text; repeated rows are repeated
turns. A null conversation id is a conversation of its own. Texts and conversations of
any length that one value can hold are formatted whole. Columns beyond the four are not
read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_written(role: Column) -> Column:
    for char, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def role_read(role: Column) -> Column:
    for char, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role_written(role), F.lit("\n"), body, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """The turns ``role, text`` that a formatted text holds, in order.

    The text is cut at each start mark. A part's role ends at its first line
    break and its body at its first end mark; a part without either is a turn of
    what is there.
    """
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(part: Column) -> Column:
        head = F.split(part, r"\n", 2)
        body = F.split(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"<\|im_end\|>", -1)
        return F.struct(role_read(head[0]).alias("role"), unescaped(body[0]).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``id, formatted, turns, places, loss_spans, round_trip``, a row per conversation.

    ``turns`` are read back from the formatted text. ``places`` says for each turn where
    its escaped text is (``start`` and exclusive ``end``, in code points), the length of
    its written role, and whether it counts for the ``loss``; ``loss_spans`` are the
    places that do, those of the assistant texts. ``round_trip`` says that the turns read
    back equal the source.
    """
    source = conversations.select(
        F.col(id_col).alias("_id"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    alone = parsed(rendered(F.col("role"), F.col("text")))
    same = alone == F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    turns = source.withColumn(
        "body", F.when(same, F.col("text")).otherwise(escaped(F.col("text")))
    ).select(
        "*",
        F.length(role_written(F.col("role"))).alias("role_chars"),
        F.length("body").alias("body_chars"),
        F.length(escaped(F.col("text"))).alias("escaped_chars"),
    )
    # Where the turn's text ends, if only the turns in need are escaped and if all are.
    so_far = Window.partitionBy("_id").orderBy("_turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    marks = len(START) + 1 + len(END) + 1

    def end_of(chars: str) -> Column:
        total = F.sum(F.col("role_chars") + F.col(chars) + marks).over(so_far)
        return (total - len(END) - 1).cast("int")

    ended = turns.select(
        "*", end_of("body_chars").alias("end"), end_of("escaped_chars").alias("escaped_end")
    )
    fields = "_turn role text end escaped_end body role_chars body_chars escaped_chars".split()
    whole = ended.groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("_turns")
    )

    def joined(body) -> Column:
        return F.array_join(
            F.transform("_turns", lambda t: rendered(t["role"], body(t))), ""
        )

    def places(end: str, chars: str) -> Column:
        return F.transform(
            "_turns",
            lambda t: F.struct(
                (t[end] - t[chars]).alias("start"), t[end].alias("end"),
                t["role_chars"].alias("role_chars"), (t["role"] == LOSS_ROLE).alias("loss"),
            ),
        )

    plain = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = whole.select(
        "_id", "_turns", plain.alias("_plain"), joined(lambda t: t["body"]).alias("_first")
    ).withColumn("_same", parsed(F.col("_first")) == F.col("_plain"))
    final = first.select(
        "_id",
        "_plain",
        F.when(F.col("_same"), F.col("_first"))
        .otherwise(joined(lambda t: escaped(t["text"])))
        .alias("formatted"),
        F.when(F.col("_same"), places("end", "body_chars"))
        .otherwise(places("escaped_end", "escaped_chars"))
        .alias("places"),
    )
    return final.select(
        F.col("_id").alias(id_col),
        "formatted",
        parsed(F.col("formatted")).alias("turns"),
        "places",
        F.transform(
            F.filter("places", lambda p: p["loss"]),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")),
        ).alias("loss_spans"),
        "_plain",
    ).select(
        id_col, "formatted", "turns", "places", "loss_spans",
        (F.col("turns") == F.col("_plain")).alias("round_trip"),
    )


def loss_texts(formatted: Column, places: Column) -> Column:
    """The texts under the loss mask, unescaped, in order.

    Each is cut out of its own turn's part of the formatted text.
    """
    def cut(part: Column, place: Column) -> Column:
        text = F.substring(part, place["role_chars"] + 2, place["end"] - place["start"])
        return F.when(place["loss"], unescaped(text))

    parts = F.split(formatted, r"<\|im_start\|>", -1)
    # Before the first mark stands nothing.
    before = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("role_chars"), F.lit(False).alias("loss")
    )
    return F.filter(F.zip_with(parts, F.concat(F.array(before), places), cut), lambda t: t.isNotNull())
