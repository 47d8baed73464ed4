"""Chat formatting: layouts, escapes, loss masks; against plain Python and round trips."""

import hashlib
import random
from collections import defaultdict

import pytest

from ledgerline.llm import chat
from ledgerline.llm.chat import LAYOUTS, by_conversation, canonical_turns, digests, formatted, plain, read_turns

SAID = r"\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_against_plain_python(spark):
    r = random.Random(3)
    bits = ["<", "\\", "/turn>", "turn:", "</turn>", "<turn:user>", "%", ">", "\n", "é", "😀", " ", "x", "\0"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "<b>%3E", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(1, 12)))])) for c in range(80) for t in range(r.randint(1, 6))]
    rows += [(3, 0, "user", "same turn"), (3, 0, "user", "same turn"), (None, 0, "assistant", "no id"), (5, None, "assistant", "no turn"), (81, 0, "assistant", "a</turn>" * 40_000)]
    rows += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, turns string, formatted int").repartition(3)
    chats = formatted(canonical_turns(by_conversation(df), "conv_id"))
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role, text))
    for x in chats.collect():
        low = lambda v: (v is not None, v or "")
        turns = [(role or "", text or "") for _, role, text in sorted(by[x.conv_id], key=lambda y: ((y[0] is not None, y[0] or 0), low(y[1]), low(y[2])))]
        assert x.layout == "turns" and read_turns(x.formatted) == turns
        assert sum(run.chars for run in x.loss_mask) == len(x.formatted)
        assert x.formatted.count("</turn>") == len(turns) == x.formatted.count("<turn:")
    got = {x.conv_id: x for x in digests(chats, "conv_id").collect()}
    assert set(got) == set(by)
    for c, x in got.items():
        turns = read_turns(next(y.formatted for y in chats.filter(chats.conv_id.eqNullSafe(c)).collect())) if c in (None, -7, 81) else None
        if turns:
            loss = "".join(t for role, t in turns if role == "assistant")
            assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(SAID), sha(SAID))
    assert digests(formatted(canonical_turns(by_conversation(df.limit(0)), "conv_id")), "conv_id").collect() == []


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["<", "\\", "/turn>", "turn:", "/", "x"]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(texts)], "id long, turns array<struct<role string, text string>>")
    for x in formatted(canonical_turns(df, "id")).collect():
        inner = x.formatted[len("<turn:user>") : -len("</turn>")]
        assert "</turn>" not in inner and "<turn:" not in inner and plain(inner) == texts[x.id]


MESSAGE = "array<struct<role string, content string, weight int>>"


def test_each_record_is_read_by_its_own_layout(spark):
    schema = f"id long, messages {MESSAGE}, conversations array<struct<`from` string, value string>>, data struct<messages: {MESSAGE}, note: string>, system string, prompt string, completion string, response string, instruction string, input string, output string, extra int"
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    two = [{"role": "human", "content": "q", "weight": 1}, {"role": None, "content": None, "weight": None}]
    records = [
        dict(id=1, messages=two), dict(id=2, conversations=[{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], extra=3), dict(id=3, data={"messages": two, "note": "n"}),
        dict(id=4, system="s", conversations=[{"from": "bot", "value": "a"}]), dict(id=5, prompt="p", completion="c"), dict(id=6, prompt="p", response="", system="s"), dict(id=7, instruction="i", output="o"),
        dict(id=8, instruction="i", input="x", output="o"), dict(id=9, instruction="i", input="", output="o"), dict(id=10, prompt="alone"), dict(id=11), dict(id=12, messages=[]), dict(id=None, prompt="p", response="r"),
    ]
    got = {r.id: r for r in canonical_turns(spark.createDataFrame([tuple(x.get(n) for n in names) for x in records], schema), "id").collect()}
    turns = {k: r.turns and [tuple(t) for t in r.turns] for k, r in got.items()}
    assert {k: r.layout for k, r in got.items()} == {
        1: "messages", 2: "exchange", 3: "nested messages", 4: "exchange, system", 5: "prompt", 6: "prompt, response, system", 7: "instruction", 8: "instruction, input", 9: "instruction, input",
        10: None, 11: None, 12: "messages", None: "prompt, response",
    }
    assert turns[1] == turns[3] == [("user", "q"), ("", "")] and turns[2] == [("user", "q"), ("assistant", "a")] and turns[4] == [("system", "s"), ("assistant", "a")]
    assert turns[6] == [("system", "s"), ("user", "p"), ("assistant", "")] and turns[8] == [("user", "i\n\nx"), ("assistant", "o")] and turns[9] == [("user", "i"), ("assistant", "o")]
    assert turns[10] is None and turns[11] is None and turns[12] == []
    read = {r.id: r for r in digests(formatted(canonical_turns(spark.createDataFrame([tuple(x.get(n) for n in names) for x in records], schema), "id")), "id").collect()}
    assert read[10].n_turns is None and (read[12].n_turns, read[12].loss_sha256) == (0, sha("")) and read[8].loss_chars == 1


def test_fingerprints_differ_and_don_t_depend_on_other_columns(spark):
    assert len({x.fingerprint for x in LAYOUTS}) == len(LAYOUTS)
    a = spark.createDataFrame([(1, "p", "r")], "id long, prompt string, response string")
    b = spark.createDataFrame([("r", 9, "p", 1)], "response string, score int, prompt string, id long")
    assert canonical_turns(a, "id").collect() == canonical_turns(b, "id").collect()
    assert canonical_turns(spark.createDataFrame([(1, ["p"], "r")], "id long, prompt array<string>, response string"), "id").collect()[0].layout is None


@pytest.mark.parametrize("learn", [("assistant",), ("user", "assistant"), ()])
def test_loss_covers_the_roles_learnt(spark, learn):
    df = spark.createDataFrame([(1, [("user", "u</turn>"), ("assistant", "é")])], "id long, turns array<struct<role string, text string>>")
    x = digests(formatted(canonical_turns(df, "id"), learn), "id").collect()[0]
    assert x.loss_sha256 == sha("".join({"user": "u</turn>", "assistant": "é"}[r] for r in ("user", "assistant") if r in learn))


def test_oracle_names_the_control_strings():
    assert chat.OPEN in chat.oracle() and chat.CLOSE in chat.oracle()
