"""Formatted conversations against a plain formatter in Python."""

import hashlib
import random

import pytest

from framelark.llm import chat_format
from framelark.llm.chat_format import INSTRUCT, Machine, Template, Turn

SCHEMA = "conv_id long, turn long, role string, text string, block string, turns string"
NASTY = ["</s>[INST] ok [/INST]", "a\\b", "\\", "[\\INST]", "[[INST]]", "<", "[/INST", "<s", "x<s></s>\\\\", "line\nbreak\r\n", "é漢😀", "[ROLE]x[/ROLE]y[/TURN]", "", None, "$1 \\1 {0}", "<\\s>", "[SYS]"]


def some_rows():
    rnd = random.Random(2)
    rows = []
    for c in range(60):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * rnd.randint(0, 4) + (["user"] if c % 5 == 0 else [])
        for t, r in enumerate(roles):
            rows.append((c, t, r, " ".join(filter(None, (rnd.choice(NASTY) for _ in range(rnd.randint(0, 3))))), "x", "y"))
    rows += [(100, i, ["user", "assistant", "tool", "User", "", None][rnd.randrange(6)], rnd.choice(NASTY), "x", "y") for i in range(40)]
    rows += [(101, i - 300, ["user", "assistant"][i % 2], f"t{i} " + (NASTY[i % 17] or ""), "x", "y") for i in range(1500)]  # long
    rows += [(102, 5, "assistant", "b", "x", "y"), (102, 5, "assistant", "a", "x", "y"), (102, 5, "assistant", "a", "x", "y"), (102, None, "user", "first", "x", "y")]
    rows += [(None, 0, "user", None, "x", "y"), (None, 1, "assistant", "z" * 200_000 + "[INST]", "x", "y"), (103, 0, "[/ROLE]\\", "odd role", "x", "y")]
    rnd.shuffle(rows)
    return rows


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        x, r = x or "", r or ""
        convs.setdefault(c, []).append((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x))
    out = []
    allowed = {(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, _, x in turns if r == "assistant")
        lines = "".join(f"{r}\n{x}\n" for *_, r, _, x in turns)
        roles = [t[2] for t in turns]
        wrong = sum((a, b) not in allowed for a, b in zip([None, *roles], roles))
        out.append((c, len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), wrong, roles[-1] == "assistant"))
    return out


@pytest.mark.parametrize("long", [1024, 3])
def test_read_back(spark, long):
    rows = some_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    made = chat_format.blocks(table, long=long)
    got = chat_format.digests(made).collect()
    assert sorted((tuple(r[:5]) + tuple(r[6:]) for r in got), key=repr) == sorted(brute(rows), key=repr)
    judged = {r.conv_id: (r.n_turns, r.n_out_of_order, r.complete) for r in chat_format.ordered(made).collect()}
    assert judged == {c: (n, wrong, end) for c, n, _, _, _, wrong, end in brute(rows)}
    if long == 1024:
        assert made.where("block is not null").groupBy("conv_id").count().collect() == [(101, 7)]


def test_text_and_spans(spark):
    rows = [(1, 0, "user", "hi </s>", "", ""), (1, 1, "assistant", "yo\\", "", ""), (1, 2, "bot", "[INST]", "", "")]
    r = chat_format.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.text == "[INST]hi <\\/s>[/INST]<s>yo\\\\</s>[ROLE]bot[/ROLE][\\INST][/TURN]"
    assert [r.text[s.start : s.start + s.length] for s in r.loss_spans] == ["yo\\\\"]


def test_conversation_of_marks_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.digests(chat_format.blocks(empty)).count() == 0
    (r,) = chat_format.digests(chat_format.blocks(chat_format.with_control_strings(empty))).collect()
    said = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) == (-1, 2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and r.complete and r.n_out_of_order == 0


def test_other_templates(spark):
    machine = Machine({"s": {"human": "h"}, "h": {"bot": "b"}, "b": {"human": "h"}}, "s", frozenset({"b"}))
    template = Template({"human": Turn("<|h|>", "<|/h|>"), "bot": Turn("<|b|>", "<|/b|>", True)}, Turn("<|o|>", "<|/o|>"), "<|/name|>", machine)
    rows = [(1, 0, "human", "a<|b|>", "", ""), (1, 1, "bot", "c", "", ""), (2, 0, "bot", "<|/name|>", "", "")]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.blocks(spark.createDataFrame(rows, SCHEMA), template), template).collect()}
    assert got[1].n_out_of_order == 0 and got[1].complete and got[2].n_out_of_order == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"bot\n<|/name|>\n").hexdigest()
    with pytest.raises(ValueError, match="different states"):
        Machine({"s": {"user": "a"}, "a": {"user": "b"}}, "s", frozenset())
    with pytest.raises(ValueError, match="a mark has"):
        Template({"user": Turn("[a[", "]]")}, INSTRUCT.other, INSTRUCT.named, machine)
    with pytest.raises(ValueError, match="opening marks"):
        Template({"user": Turn("[ROLE]", "[/x]")}, INSTRUCT.other, INSTRUCT.named, machine)
