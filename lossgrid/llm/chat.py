"""Chat formatting with Spark expressions only: turns are sorted, merged by role, marked and joined to one text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossgrid.llm.common import keep, maybe_broadcast, text_or_empty

ASSISTANT = "assistant"
# a conversation with more rows is put together from parts of about this many rows each
MOST_TURNS = 512


@dataclass(frozen=True)
class Template:
    """Control strings around the messages of a role.

    `other` encloses the name of any further role and its messages, `divider` stands between merged messages. Every
    control string is one < or [, then characters without < > [ ] and backslash, then > or ]. So no control string can
    arise across the border of two pieces, and none is the beginning of another.
    """

    begin: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), ASSISTANT: ("", "</s>")}
    )
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    divider: str = "[MSG]"

    def marks(self) -> list[str]:
        pairs = [*self.roles.values(), self.other]
        return [m for m in [self.begin, self.divider, *[x for p in pairs for x in p]] if m]

    def escaped(self, text: Column) -> Column:
        """The text with one backslash more in every mark, after its first character and any backslashes there."""
        for first, rests in self._by_first().items():
            text = F.regexp_replace(text, rf"{_literal(first)}(\\*(?:{rests}))", _replacement(first) + r"\\$1")
        return text

    def unescaped(self, text: Column) -> Column:
        for first, rests in self._by_first().items():
            text = F.regexp_replace(text, rf"{_literal(first)}\\(\\*(?:{rests}))", _replacement(first) + "$1")
        return text

    def _by_first(self) -> dict[str, str]:
        firsts = sorted({m[0] for m in self.marks()})
        return {f: "|".join(_literal(m[1:]) for m in sorted(set(self.marks())) if m[0] == f) for f in firsts}

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.divider))
        for name, (mark, _) in self.roles.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.other[1])
        for name, (_, mark) in self.roles.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out


def _literal(text: str) -> str:
    """A regular expression for this very text."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def _replacement(text: str) -> str:
    return text.replace("\\", r"\\").replace("$", r"\$")


def _blocks(turns: Column) -> Column:
    """Turns in order as blocks (role, texts): a turn joins the block before it when the roles are equal."""

    def merge(blocks: Column, turn: Column) -> Column:
        last, text = F.try_element_at(blocks, F.lit(-1)), F.array(turn["text"])
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], text).alias("texts"))
        before = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
        fresh = F.struct(turn["role"].alias("role"), text.alias("texts"))
        same = last["role"] == turn["role"]  # null, so not the same, while there is no block
        return F.when(same, F.concat(before, F.array(longer))).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), merge)


def _part(turns: Column, template: Template) -> Column:
    """Turns in order as one part: its text without the first opening and last closing mark, and the loss spans in it."""
    blocks = _blocks(turns)

    def pieces(block: Column, i: Column, blocks: Column) -> Column:
        before = F.concat(template.closing(F.get(blocks, i - 1)["role"]), template.opening(block["role"]))
        first = F.when(i == 0, F.lit("")).otherwise(before)

        def piece(text: Column, j: Column) -> Column:
            mark = F.when(j == 0, first).otherwise(F.lit(template.divider))
            loss = block["role"] == ASSISTANT
            return F.array(
                F.struct(mark.alias("text"), F.lit(False).alias("loss")),
                F.struct(template.escaped(text).alias("text"), loss.alias("loss")),
            )

        return F.flatten(F.transform(block["texts"], piece))

    def place(state: Column, piece: Column) -> Column:
        size = F.octet_length(piece["text"]).cast("long")
        span = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        spans = F.when(piece["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )

    # each step's array is bound to a variable by a transform over a single element, so that it is computed once
    def from_blocks(blocks: Column) -> Column:
        flat = F.flatten(F.transform(blocks, lambda b, i: pieces(b, i, blocks)))
        return _once(
            flat,
            lambda flat: F.struct(
                F.element_at(blocks, 1)["role"].alias("first"),
                F.element_at(blocks, -1)["role"].alias("last"),
                F.array_join(F.transform(flat, lambda p: p["text"]), "").alias("text"),
                F.aggregate(flat, start, place)["spans"].alias("spans"),
                F.size(turns).cast("long").alias("n_turns"),
            ),
        )

    return _once(blocks, from_blocks)


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _joined(parts: Column, template: Template) -> Column:
    """Parts in order as the whole conversation: (formatted, loss_spans, n_turns)."""
    return _once(parts, lambda parts: _linked(parts, template))


def _linked(parts: Column, template: Template) -> Column:
    def link(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)["last"]
        turn = F.concat(template.closing(before), template.opening(part["first"]))
        inner = F.when(before == part["first"], F.lit(template.divider)).otherwise(turn)
        return F.when(i == 0, F.concat(F.lit(template.begin), template.opening(part["first"]))).otherwise(inner)

    def place(state: Column, part: Column) -> Column:
        at = state["at"] + F.octet_length(part["link"])
        return F.struct(
            (at + F.octet_length(part["text"])).alias("at"),
            F.concat(state["starts"], F.array(at)).alias("starts"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def whole(linked: Column) -> Column:
        text = F.array_join(F.transform(linked, lambda p: F.concat(p["link"], p["text"])), "")

        def spans(starts: Column) -> Column:
            moved = F.transform(
                linked,
                lambda p, i: F.transform(
                    p["spans"],
                    lambda s: F.struct((s["start"] + F.get(starts, i)).alias("start"), s["length"].alias("length")),
                ),
            )
            return F.flatten(moved)

        return F.struct(
            F.concat(text, template.closing(F.element_at(linked, -1)["last"])).alias("formatted"),
            _once(F.aggregate(linked, start, place)["starts"], spans).alias("loss_spans"),
            F.aggregate(linked, F.lit(0).cast("long"), lambda n, p: n + p["n_turns"]).alias("n_turns"),
        )

    linked = F.transform(
        parts,
        lambda p, i: F.struct(link(p, i).alias("link"), p["text"].alias("text"), p["spans"].alias("spans"),
                              p["last"].alias("last"), p["n_turns"].alias("n_turns")),
    )
    return _once(linked, whole)


def format_chats(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template | None = None,
    most_turns: int = MOST_TURNS,
) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns) per conversation: its turns in order as one marked text.

    `loss_spans` are (start, length) in UTF-8 bytes of `formatted`, one for each assistant text. Adjacent turns of one
    role share one pair of marks, with a divider between their texts. Marks inside texts and role names are escaped;
    `read_turns` and `read_loss` give all of it back. Rows are ordered by turn (null first), then role, then text, so
    ties and repeated rows stand side by side. A null text or role is empty, a null conversation is one of its own. An
    empty table gives an empty result; other columns are not read.

    A conversation of up to `most_turns` rows is collected in one shuffle. The others, found by a count that combines
    before it shuffles, are dealt by ranges of their order (repeated rows as one row and a count) and cut into parts of
    at most twice `most_turns` turns. Each part is formatted by itself, and only the texts of the parts meet: no task
    takes an unbounded number of rows. As the result has one text per conversation, that text must fit into a row (2 GB).
    """
    template = template or Template()
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        text_or_empty(role).alias("role"),
        text_or_empty(text).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    long = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most_turns)
    long = keep(long.select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")), "long-chats")
    n_long = long.count()

    def collected(part: DataFrame, keys: list[str], messages: Column) -> DataFrame:
        return part.groupBy(*keys).agg(F.sort_array(F.collect_list(messages)).alias("turns"))

    messages = F.struct("turn", "role", "text")
    columns = ["conv_id", "whole.formatted", "whole.loss_spans", "whole.n_turns"]
    if n_long == 0:
        grouped = collected(rows, ["conv_id"], messages)
        whole = _joined(F.array(F.col("part")), template)
        return grouped.select("conv_id", _part(F.col("turns"), template).alias("part")).select(
            "conv_id", whole.alias("whole")
        ).select(*columns)

    marked = rows.join(maybe_broadcast(long, n_long), rows["conv_id"].eqNullSafe(long["long_id"]), "left")
    short = marked.where("is_long is null").select(*order)
    distinct = marked.where("is_long").groupBy(*order).agg(F.count("*").alias("copies"))
    ranges = distinct.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranges = keep(ranges, "chat-ranges")  # the numbers of the ranges are fixed once written
    # a range is cut again by the turns before each row, and a row that repeats very often into several
    size = F.lit(most_turns).cast("long")
    many = ranges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / size))).alias("piece"))
    many = many.withColumn("n", F.least(size, F.col("copies") - F.col("piece") * size))
    before = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text", "piece")
    at = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = many.withColumn("segment", F.floor(at / size))

    def repeat(t: Column) -> Column:
        return F.array_repeat(F.struct(t["role"].alias("role"), t["text"].alias("text")), t["n"].cast("int"))

    repeated = F.flatten(F.transform("turns", repeat))
    many = collected(many, ["conv_id", "range", "segment"], F.struct("turn", "role", "text", "piece", "n"))
    many = many.select("conv_id", F.struct("range", "segment", _part(repeated, template).alias("part")).alias("part"))
    many = many.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    many = many.select("conv_id", F.transform("parts", lambda p: p["part"]).alias("parts"))
    few = collected(short, ["conv_id"], messages).select(
        "conv_id", F.array(_part(F.col("turns"), template)).alias("parts")
    )
    return few.unionByName(many).select("conv_id", _joined(F.col("parts"), template).alias("whole")).select(*columns)


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation in order, as an array of (role, text); merged ones are apart again."""
    template = template or Template()
    ends = "|".join(_literal(c) for c in sorted({c for _, c in [*template.roles.values(), template.other]}))
    blocks = F.filter(F.split(formatted, rf"(?<={ends})"), lambda b: b != "")
    skip = len(template.begin)

    def read(block: Column, i: Column) -> Column:
        block = F.when(i == 0, F.substring(block, F.lit(skip + 1), F.length(block))).otherwise(block)

        def inner(block: Column, pair: tuple[str, str]) -> Column:
            text = F.substring(block, F.lit(len(pair[0]) + 1), F.length(block) - F.lit(len(pair[0]) + len(pair[1])))
            return F.split(text, _literal(template.divider))

        def named(texts: Column, role: Column) -> Column:
            return F.transform(texts, lambda t: F.struct(role.alias("role"), template.unescaped(t).alias("text")))

        def messages(block: Column) -> Column:
            texts = inner(block, template.other)
            rest = F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0)))
            out = named(rest, template.unescaped(F.get(texts, F.lit(0))))
            for name, (start, end) in sorted(template.roles.items(), key=lambda x: len(x[1][0])):
                mine = F.startswith(block, F.lit(start)) & F.endswith(block, F.lit(end))
                out = F.when(mine, named(inner(block, (start, end)), F.lit(name))).otherwise(out)
            return out

        return _once(block, messages)

    return F.flatten(F.transform(blocks, read))


def read_loss(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """The texts under the loss spans of a formatted conversation, in order and unescaped."""
    template = template or Template()

    def cut(data: Column) -> Column:
        part = lambda s: F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return F.transform(spans, lambda s: template.unescaped(part(s).cast("string")))

    return _once(formatted.cast("binary"), cut)
