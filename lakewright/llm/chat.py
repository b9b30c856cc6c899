"""Chat formatting with Spark expressions only: sorted turn structs, merged roles, escaped control strings, a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a block opens with START, role and line feed, its turns are told apart by PART, and END closes it.
START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"
#: The role whose texts are learned from.
LEARNED = "assistant"
#: Turns that one inner array aggregation merges; arrays that grow step by step stay this short.
CHUNK = 64


def escaped(text: Column) -> Column:
    """``text`` with one more backslash in each ``<``, any backslashes, ``|``: no control string is left in it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """What ``escaped`` made ``text`` from."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """``role`` without line feeds and bars, by percent signs; the header of a block ends at its line feed."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, although ``body`` names it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _segment(text: Column, loss: Column | bool) -> Column:
    return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def _segments(turns: Column, learned: str) -> Column:
    """The segments of sorted turns. Chunks of turns are merged one by one by an array aggregation whose state
    is the role of the turn before, which a chunk takes from the last turn of the chunk before it."""
    def add(state: Column, turn: Column) -> Column:
        fresh = F.concat(F.when(state["role"].isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(START), turn["role"], F.lit("\n"))
        glue = F.when(state["role"] == turn["role"], F.lit(PART)).otherwise(fresh)
        return F.struct(turn["role"].alias("role"), F.concat(state["segments"], F.array(
            _segment(glue, False), _segment(turn["text"], turn["role"] == learned))).alias("segments"))

    def chunk(begin: Column) -> Column:
        before = F.when(begin > 1, F.element_at(turns, F.greatest(begin - 1, F.lit(1)))["role"])
        empty = F.array().cast("array<struct<text: string, loss: boolean>>")
        return F.aggregate(F.slice(turns, begin, CHUNK), F.struct(before.alias("role"), empty.alias("segments")), add, lambda s: s["segments"])

    merged = F.flatten(F.transform(F.sequence(F.lit(1), F.size(turns), F.lit(CHUNK)), chunk))
    return F.concat(merged, F.array(_segment(F.lit(END), False)))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>) of every conversation, from rows (conv_id, turn, role, text).

    The segments in order are the formatted conversation, ``formatted`` joins
    them, and those with ``loss`` are the loss mask: the escaped text of each
    turn of the role ``learned``, without the marks around it. Adjacent turns
    of one role share one block of the template, where a mark outside the mask
    tells them apart, so the turns can be read back one by one (``read_back``).

    Rows are ordered by turn, null last, then by role and text, so ties have a
    fixed order and equal rows stay as often as they are. A null text or role
    counts as empty. Rows with a null id form one conversation. Control strings
    in texts and roles are escaped reversibly, whatever they are. No rows give
    no rows; other columns are ignored. A
    conversation is one row of the result, so it is gathered in one row, and its
    work is in proportion to its turns.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).isNull().alias("no_turn"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("turn"))
    held = rows.groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))
    written = F.transform(F.array_sort("turns"), lambda t: F.struct(escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    # Roles compare as they are written, also the learned one.
    return held.select("conv_id", _let(written, lambda t: _segments(t, _written(learned))).alias("segments"))


def _written(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("|", "%7C")


def formatted(segments: Column) -> Column:
    """The formatted conversation as one string."""
    return F.array_join(segments["text"], "")


def loss_spans(segments: Column) -> Column:
    """array<struct<begin, end>>: the code points of ``formatted`` under the loss mask, end exclusive.

    Sums run over chunks of segments first, so arrays that grow step by step stay short.
    """
    kind = "array<struct<begin: bigint, end: bigint>>"

    def add(state: Column, s: Column) -> Column:
        end = state["at"] + F.length(s["text"])
        return F.struct(end.alias("at"), F.when(s["loss"], F.concat(state["spans"], F.array(F.struct(state["at"].alias("begin"), end.alias("end")))))
                        .otherwise(state["spans"]).alias("spans"))

    def local(begin: Column) -> Column:
        return F.aggregate(F.slice(segments, begin, CHUNK), F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans")), add)

    def place(state: Column, c: Column) -> Column:
        moved = F.transform(c["spans"], lambda s: F.struct((s["begin"] + state["at"]).alias("begin"), (s["end"] + state["at"]).alias("end")))
        return F.struct((state["at"] + c["at"]).alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    chunks = F.transform(F.sequence(F.lit(1), F.size(segments), F.lit(CHUNK)), local)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("spans"))
    return F.flatten(F.aggregate(chunks, start, place, lambda s: s["spans"]))


def read_back(text: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation was made from."""
    def block(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(head) + 2, F.length(b) - F.length(head) - 1 - len(END))
        return _let(unescaped_role(head), lambda role: F.transform(
            F.split(body, PART.replace("|", r"\|"), -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))))

    blocks = F.split(text, START.replace("|", r"\|"), -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), block))


def digests(conversations: DataFrame, **columns) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks) of ``format_conversations``.

    All is read back from the formatted conversation: turns from the marks in
    its text, learned texts from the segments under the loss mask.
    """
    made = format_conversations(conversations, **columns)
    read = made.select("conv_id", formatted(F.col("segments")).alias("formatted"), F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("learned"))
    turns = read.select("conv_id", "formatted", "learned", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.regexp_count("formatted", F.lit(START.replace("|", r"\|"))).cast("long").alias("n_blocks"))
