import hashlib

from lumenql.llm import chat


def make(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blocks int")


ROWS = [
    (1, 2, "assistant", "fine </s> <s>[INST]x[/INST] \\e \\l", 0),
    (1, 0, "system", None, 0),
    (1, 1, "user", "how\nare [you]?", 0),
    (1, 3, "assistant", "second <s/> answer", 0),
    (1, None, "user", "no turn", 0),
    (2, 0, "user", "", 0),
    (2, 0, "assistant", "tie", 0),
    (3, 0, None, "no role", 0),
    (None, 0, "user", "no conversation", 0),
    (4, 1, "assistant", "", 0),
    (4, 1, "assistant", "", 0),
]


def test_turns_come_back_in_order_and_merged(spark):
    done = chat.format_chats(make(spark, ROWS))
    got = {r.conv_id: [tuple(t) for t in r.t] for r in done.select("conv_id", chat.read_back(done.formatted).alias("t")).collect()}
    want = {}
    for c, n, role, text, _ in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    one = done.filter("conv_id = 1").first()
    assert one.formatted.count(chat.OPEN) == 4 and one.formatted.count(chat.NEXT) == 1
    assert "".join(s.text for s in one.segments) == one.formatted


def test_loss_text_is_what_assistants_said(spark):
    done = chat.format_chats(make(spark, ROWS))
    got = {r.conv_id: r.l for r in done.select("conv_id", chat.loss_text(done.segments).alias("l")).collect()}
    assert got == {1: "fine </s> <s>[INST]x[/INST] \\e \\lsecond <s/> answer", 2: "tie", 3: "", None: "", 4: ""}


def test_long_conversations_and_empty_tables(spark):
    many = [(1, i, "user" if i % 3 else "assistant", f"t{i}", 0) for i in range(3000)]
    done = chat.format_chats(make(spark, many))
    turns = done.select(chat.read_back(done.formatted).alias("t")).first().t
    assert [t.text for t in turns] == [f"t{i}" for i in range(3000)]
    assert chat.format_chats(make(spark, [])).collect() == []


def test_planted_conversation(spark, data):
    row = chat.op4_chat_formatting(spark, data).filter("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_no_python_in_the_plan(spark, data):
    plan = chat.op4_chat_formatting(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
