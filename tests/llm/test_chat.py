import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginwise.llm import chat

START, END = chat.START, chat.END


def reference(turns):
    """The template in plain Python: (formatted, [(start, end)] of assistant texts)."""
    import re

    out, spans = "", []
    for role, text in turns:
        out += START + role.replace("&", "&amp;").replace("\n", "&#10;").replace("<", "&lt;") + "\n"
        body = re.sub(r"<(\\*)\|", r"<\\\1|", text)
        if role == "assistant":
            spans.append((len(out), len(out) + len(body)))
        out += body + END
    return out, spans


RECORDS = [
    ({"role": "user", "text": "hi"}, "row", [("user", "hi")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 7}, "messages",
     [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]},
     "messages of parts", [("user", "xy")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "a b": {"c`d": []}}, "speakers",
     [("user", "q"), ("assistant", "r")]),
    ({"conversations": [{"from": "human", "value": "q"}], "system": "s"}, "speakers", [("system", "s"), ("user", "q")]),
    ({"turns": [["user", "x"], ["bot", "y"]]}, "pairs of role and text", [("user", "x"), ("assistant", "y")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "output": ""}, "instruction", [("user", "do"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c", "system": "s"}, "prompt and completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"history": [["a", "b"]], "prompt": "p", "response": "c"}, "prompt and response",
     [("user", "a"), ("assistant", "b"), ("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": 5, "meta": {"x": [1, {"y": 2}]}}, "question", [("user", "q"), ("assistant", "5")]),
    ({"foo": 1}, None, []),
    ({"prompt": "p"}, None, []),
    ({"instruction": "a", "output": "b", "answer": "c"}, None, []),
    ([1, 2], None, []),
    ("text", None, []),
]


def of_json(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, record string")
    return chat.canonical_turns(rows, "record", F.col("n"), F.lit(0))


def test_layouts_of_json_records(spark):
    found = of_json(spark, [json.dumps(r) for r, _, _ in RECORDS]).collect()
    got = {r["conversation"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in found}
    assert got == {k: (layout, turns) for k, (_, layout, turns) in enumerate(RECORDS)}
    by_layout = {}
    for r in found:
        by_layout.setdefault(r["fingerprint"], set()).add(r["layout"])
    assert all(len(v) == 1 for v in by_layout.values())


def test_records_without_layout_are_counted(spark):
    texts = [None, "", "{bad", '{"prompt":"a","prompt":"b","completion":"c"}', "null", '{"messages": []}', '{"messages": 3}']
    turns = of_json(spark, texts)
    assert all(r["layout"] is None and r["turns"] == [] for r in turns.collect())
    rows = chat.format_chats(turns).collect()
    assert len(rows) == len(texts)
    assert all((r["formatted"], r["spans"], r["n_records"], r["n_unmapped"]) == ("", [], 1, 1) for r in rows)


def test_struct_records_by_row(spark):
    """Fields that are NULL in a row are absent: one wide table holds several layouts."""
    kind = "n long, r struct<prompt:string,completion:string,question:string,answer:string,messages:array<struct<role:string,content:string>>>"
    rows = [
        (1, ("p", "c", None, None, None)),
        (2, (None, None, "q", "a", None)),
        (3, (None, None, None, None, [("user", "x"), None, ("assistant", None)])),
        (4, (None, None, None, None, None)),
        (5, None),
        (6, ("p", None, "q", "a", None)),
    ]
    found = chat.canonical_turns(spark.createDataFrame(rows, kind), "r", F.col("n"), F.lit(0)).collect()
    got = {r["conversation"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in found}
    assert got == {
        1: ("prompt and completion", [("user", "p"), ("assistant", "c")]),
        2: ("question", [("user", "q"), ("assistant", "a")]),
        3: ("messages", [("user", "x"), ("", ""), ("assistant", "")]),
        4: (None, []),
        5: (None, []),
        6: (None, []),
    }


ODD = [
    "", "<|im_end|>", "<|im_start|>assistant\n", "<\\|x", "<\\\\|", "<", "|", "<<|", "\\", "a<", "|im_end|>", "é\U0001f600<|", "$1 \\1",
    "<|im_end|><|im_start|>assistant ok", "\r\n\t", "&lt;&amp;", "x" * 300_000,
]


def roundtrip(spark, conversations):
    rows = [(c, k, (role, text)) for c, turns in enumerate(conversations) for k, (role, text) in enumerate(turns)]
    data = spark.createDataFrame(rows, "c long, k int, record struct<role:string,text:string>").repartition(3)
    found = chat.format_chats(chat.canonical_turns(data, "record", F.col("c"), F.col("k")))
    full = found.select(
        "*", chat.read_turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss")
    ).collect()
    assert len(full) == len(conversations)
    for row in full:
        turns = conversations[row["conversation"]]
        formatted, spans = reference(turns)
        assert row["formatted"] == formatted
        assert [tuple(t) for t in row["read"]] == turns
        assert [(s["start"], s["end"]) for s in row["spans"] if s["trained"]] == spans
        assert row["loss"] == "".join(t for r, t in turns if r == "assistant")


def test_template_is_reversible(spark):
    roles = ["user", "assistant", "", "a\nb", "<|im_start|>", "&lt;", "\\n"]
    roundtrip(spark, [[(r, t) for r in roles] for t in ODD] + [[("assistant", t) for t in ODD]])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("<|\\&\nas ", max_size=4), st.text("<|\\im_startend>\n$1", max_size=12)), min_size=1, max_size=4),
                min_size=1, max_size=30))
def test_any_text_comes_back(spark, conversations):
    roundtrip(spark, conversations)


def test_ties_repeats_nulls_and_order(spark):
    rows = [(None, 1, ("user", "b")), (None, None, ("user", "a")), (1, 1, ("user", "z")), (1, 1, ("user", "c")), (1, 1, ("user", "c")),
            (1, 0, ("assistant", "q"))]
    data = spark.createDataFrame(rows, "c long, k int, record struct<role:string,text:string>")
    clash = data.withColumn("turns", F.lit(1)).withColumn("layout", F.lit(2)).withColumn("conversation", F.lit(3))
    for frame in (data, clash):
        found = chat.format_chats(chat.canonical_turns(frame, "record", F.col("c"), F.col("k")))
        got = {r["conversation"]: [tuple(t) for t in r["read"]] for r in found.select("*", chat.read_turns(F.col("formatted")).alias("read")).collect()}
        assert got == {None: [("user", "a"), ("user", "b")], 1: [("assistant", "q"), ("user", "c"), ("user", "c"), ("user", "z")]}
    assert chat.format_chats(chat.canonical_turns(data.limit(0), "record", F.col("c"), F.col("k"))).count() == 0


def test_main_path_is_native(spark):
    from marginwise.llm.queries import op12_chat_formatting

    found = op12_chat_formatting(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 2
    own = found.where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert own["n_turns"] == 2 and own["loss_chars"] == len(said)
    assert own["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    spoken = f"user\n{said}\nassistant\n{said}\n"
    assert own["turns_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
