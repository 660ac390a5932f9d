r"""Training text from conversations (DataFrame functions only).

A template says, for each role, what stands before and after a turn's text and whether the loss is taken
on it. A turn becomes three segments, (text, loss) each: mark, text, mark. The loss is taken on texts of
turns alone, never on marks. Control strings inside texts are made harmless, reversibly: a backslash
is put behind their first character, and backslashes of the text are doubled. So the segments of a
conversation, joined, can be read back exactly, whatever its texts say.

A finite-state machine over roles checks the order of turns. Its state after a turn is named by the role (the
constructor holds to that), so that any stretch of a conversation can be checked from its turns
and the turn before it; after a turn out of order it goes on from that turn's state. All turns are formatted; those out of order are counted
and their numbers (first of each stretch) given.

Scale: turns are gathered by conversation in one shuffle. Conversations of more than LONG turns (found by a count
that is summed before it is shuffled) are formatted and checked in blocks of BLOCK turn numbers first; the
state is carried over block borders, and `blocks` gives them as they are. Only what needs a whole conversation in one value,
the digests of `digests`, puts the blocks of one together; a conversation of over 2 GB can have no such digest, and stops the query.

Edge cases: a null text is empty, a null role is the role ''. Roles that the template doesn't name are written out by its
`other` turn and are out of order. Null turn numbers come first; turns with equal numbers are in order of
role and text; repeated rows are turns of their own. A null conversation id is a conversation. An empty table gives no
conversations. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import small

LONG, BLOCK = 1024, 256


@dataclass(frozen=True)
class Turn:
    """How turns of a role are written."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Machine:
    """States and transitions {state: {role: next state}}; the order is complete if it ends in one of `accepting`."""

    transitions: dict[str, dict[str, str]]
    start: str
    accepting: frozenset[str]

    def __post_init__(self):
        for role in {r for t in self.transitions.values() for r in t}:
            if len({t[role] for t in self.transitions.values() if role in t}) > 1:
                raise ValueError(f"role {role!r} leads to different states")

    def after(self, role: Column) -> Column:
        """State after a turn of `role`; null for roles that the machine doesn't know."""
        states = {r: s for t in self.transitions.values() for r, s in t.items()}
        return _choose(role, {r: F.lit(s) for r, s in states.items()}, F.lit(None).cast("string"))

    def allows(self, state: Column, role: Column) -> Column:
        pairs = [F.struct(F.lit(s).alias("s"), F.lit(r).alias("r")) for s, t in self.transitions.items() for r in t]
        return F.coalesce(F.array_contains(F.array(*pairs), F.struct(state.alias("s"), role.alias("r"))), F.lit(False))


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of other roles (their name stands between `other.before` and `named`), and what must not occur in texts."""

    turns: dict[str, Turn]
    other: Turn
    named: str
    machine: Machine
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = [m for t in (*self.turns.values(), self.other) for m in (t.before, t.after)] + [self.named]
        controls = tuple(sorted(set(marks), key=lambda m: (-len(m), m)))
        firsts = {m[:1] for m in controls}
        if any(len(m) < 2 or "\\" in m or firsts & set(m[1:]) for m in controls):
            raise ValueError("a mark has two characters or more, no backslash, and no first character of a mark but its own first")
        if len({t.before for t in (*self.turns.values(), self.other)}) <= len(self.turns):
            raise ValueError("roles need different opening marks")
        object.__setattr__(self, "controls", controls)

    def escape(self, text: Column) -> Column:
        firsts = "".join(sorted({m[0] for m in self.controls}))
        rests = "|".join(re.escape(m[1:]) for m in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"([{re.escape(firsts)}])(?={rests})", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(?s:(.))", "$1")

    def segments(self, role: Column, text: Column) -> Column:
        """Array of (text, loss) of a turn."""

        def of(before: Column, body: Column, after: str, loss: bool) -> Column:
            return F.array(*(F.struct(t.alias("text"), F.lit(flag).alias("loss")) for t, flag in ((before, False), (body, loss), (F.lit(after), False))))

        body = self.escape(text)
        other = of(F.concat(F.lit(self.other.before), self.escape(role), F.lit(self.named)), body, self.other.after, self.other.loss)
        return _choose(role, {r: of(F.lit(t.before), body, t.after, t.loss) for r, t in self.turns.items()}, other)

    def read(self, text: Column) -> Column:
        """The turns (role, text) of formatted text."""

        def between(turn: Turn, inner: str = "") -> str:
            return f"{re.escape(turn.before)}{inner}.*?{re.escape(turn.after)}"

        pattern = "(?s)" + "|".join([*(between(t) for t in self.turns.values()), between(self.other, f".*?{re.escape(self.named)}")])

        def parsed(piece: Column) -> Column:
            def row(role: Column, before: Column, after: str) -> Column:
                body = F.substring(piece, before + 1, F.length(piece) - before - F.lit(len(after)))
                return F.struct(role.alias("role"), self.unescape(body).alias("text"))

            name = F.substring_index(F.substring(piece, F.lit(len(self.other.before) + 1), F.length(piece)), self.named, 1)
            found = row(self.unescape(name), F.length(name) + F.lit(len(self.other.before) + len(self.named)), self.other.after)
            for role, t in self.turns.items():
                found = F.when(F.startswith(piece, F.lit(t.before)), row(F.lit(role), F.lit(len(t.before)), t.after)).otherwise(found)
            return found

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parsed)


def _choose(key: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for value, result in cases.items():
        out = F.when(key == value, result).otherwise(out)
    return out


#: at most one system turn, at the start; then user and assistant in turn, ending with the assistant
DIALOGUE = Machine(
    {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    "start",
    frozenset({"answered"}),
)
INSTRUCT = Template(
    {"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    Turn("[ROLE]", "[/TURN]"),
    "[/ROLE]",
    DIALOGUE,
)


def blocks(rows: DataFrame, template: Template = INSTRUCT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> DataFrame:
    """Conversations, those of more than `long` turns in blocks, as segments.

    Columns: conv_id, block (null: whole conversation), n_turns, first_role, last_role, segments (array of text and loss),
    out_of_order (numbers within the block of the turns that the machine doesn't allow there; a block's first turn is judged by `ordered`).
    """
    own = rows.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    lengths = rows.groupBy(F.col(key).alias("of")).count().where(F.col("count") > long).select("of", F.lit(True).alias("long"))
    marked = own.join(small(lengths), F.col("conv").eqNullSafe(F.col("of")), "left")
    number = F.when(F.col("long"), F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62))))
    # the segments are made before turns are gathered, by the tasks that read them
    made = marked.select("conv", number.alias("block"), "turn", "role", F.md5("text").alias("tie"), template.segments(F.col("role"), F.col("text")).alias("segments"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "tie", "segments")))
    gathered = made.groupBy("conv", "block").agg(turns.alias("turns"))
    machine = template.machine

    def step(acc: Column, t: Column) -> Column:
        wrong = (acc["at"] > 0) & ~machine.allows(acc["state"], t["role"])
        return F.struct(
            (acc["at"] + 1).alias("at"), machine.after(t["role"]).alias("state"), F.when(wrong, F.array_append(acc["wrong"], acc["at"])).otherwise(acc["wrong"]).alias("wrong")
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("state"), F.array().cast("array<int>").alias("wrong"))
    return gathered.select(
        F.col("conv").alias("conv_id"),
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.get(F.col("turns"), F.lit(0))["role"].alias("first_role"),
        F.element_at("turns", -1)["role"].alias("last_role"),
        F.flatten(F.transform("turns", lambda t: t["segments"])).alias("segments"),
        F.aggregate("turns", zero, step, lambda acc: acc["wrong"]).alias("out_of_order"),
    )


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def formatted(rows: DataFrame, template: Template = INSTRUCT, **columns) -> DataFrame:
    """Each conversation, or block of a long one, as text with the spans (start, length in characters) on which the loss is taken."""
    made = blocks(rows, template, **columns)
    ends = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["text"])).alias("at"),
            F.when(s["loss"], F.array_append(acc["spans"], F.struct(acc["at"].alias("start"), F.length(s["text"]).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return made.select("conv_id", "block", "n_turns", joined(F.col("segments")).alias("text"), ends.alias("loss_spans"))


def _edge() -> Column:
    """What the machine has to know of a block."""
    return F.struct("first_role", "last_role", "n_turns", F.size("out_of_order").alias("wrong"))


def _verdict(edges: Column, machine: Machine) -> Column:
    """Turns, turns out of order and whether the order is complete, from the blocks of a conversation."""

    def step(acc: Column, b: Column) -> Column:
        wrong = F.when(machine.allows(acc["state"], b["first_role"]), 0).otherwise(1)
        return F.struct(machine.after(b["last_role"]).alias("state"), (acc["n"] + b["n_turns"]).alias("n"), (acc["wrong"] + b["wrong"] + wrong).alias("wrong"))

    zero = F.struct(F.lit(machine.start).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("wrong"))
    ends = F.array(*map(F.lit, sorted(machine.accepting)))
    return F.aggregate(edges, zero, step, lambda acc: F.struct(acc["n"].alias("n"), acc["wrong"].alias("wrong"), F.coalesce(F.array_contains(ends, acc["state"]), F.lit(False)).alias("complete")))


def ordered(made: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the machine says of each conversation of `blocks`: conv_id, n_turns, n_out_of_order, complete."""
    edges = F.transform(F.sort_array(F.collect_list(F.struct("block", _edge().alias("edge")))), lambda b: b["edge"])
    found = made.groupBy("conv_id").agg(edges.alias("edges")).select("conv_id", _verdict(F.col("edges"), template.machine).alias("v"))
    return found.select("conv_id", F.col("v.n").alias("n_turns"), F.col("v.wrong").alias("n_out_of_order"), "v.complete")


def digests(made: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of the conversations, read back from the segments of `blocks`."""
    whole = made.where("block is null").select("conv_id", "segments", F.array(_edge()).alias("edges"))
    parts = made.where("block is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "segments", _edge().alias("edge")))).alias("b"))
    parts = parts.select("conv_id", F.flatten(F.transform("b", lambda b: b["segments"])).alias("segments"), F.transform("b", lambda b: b["edge"]).alias("edges"))
    each = whole.union(parts).select("conv_id", _verdict(F.col("edges"), template.machine).alias("v"), "segments", joined(F.col("segments")).alias("text"))
    turns = template.read(F.col("text"))
    loss = template.unescape(joined(F.filter("segments", lambda s: s["loss"])))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = each.select("conv_id", "v", turns.alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("v.wrong").alias("n_out_of_order"),
        "v.complete",
    )


def with_control_strings(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of `rows`, and a conversation -1 whose texts look like marks."""
    said = "</s>[INST] ok [/INST]"
    own = rows.select("conv_id", "turn", "role", "text")
    more = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return own.union(more.select(*(F.col(f.name).cast(f.dataType) for f in own.schema)))


_ESCAPED = r"length(regexp_replace(replace({0}, '\', '\\'), '(\[|<)(s>|/s>|/?SYS\]|/?INST\]|/?ROLE\]|/TURN\])', '\1\\\2', 'g'))"

ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, md5(text) DESC) AS from_end FROM c),
e AS (SELECT *, {_ESCAPED.format("text")} + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + {_ESCAPED.format("role")} END AS n,
        NOT coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' END, false) AS wrong
      FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars, count(*) FILTER (wrong)::BIGINT AS n_out_of_order,
       bool_or(from_end = 1 AND role = 'assistant') AS complete
FROM e GROUP BY conv_id
"""
