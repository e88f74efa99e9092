import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import chat


def brute(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    return {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}


def test_round_trip_with_control_strings_nulls_and_long_texts(spark):
    texts = [chat.PROBE, "&lt;|&amp;<|&", None, "", "a\n<|im_end|>\n<|im_start|>user\nb", "é漢😀", "y" * 200_000, "<|", "|>", "&", "&amp;lt;|"]
    rows = [(k, j, ("user", "assistant")[j % 2], t, "clash") for k in range(3) for j, t in enumerate(texts)] + [(7, None, None, "late", ""), (7, 0, "us\ner", "x", ""), (None, 0, "user", "z", "")]
    got = run(spark, rows)
    for k in range(3):
        assert tuple(got[k])[1:5] == brute([(("user", "assistant")[j % 2], t) for j, t in enumerate(texts)])
    assert tuple(got[7])[1:5] == brute([("us\ner", "x"), (None, "late")])
    assert got[None].n_turns == 1


def test_the_machine_validates_the_order_of_turns(spark):
    orders = {1: ["system", "user", "assistant"], 2: ["user", "assistant", "user"], 3: ["assistant", "user"], 4: ["user", "user", "assistant"], 5: ["user", "assistant"], 6: ["user", "system", "assistant"]}
    rows = [(k, j, r, "t", "") for k, v in orders.items() for j, r in enumerate(v)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    got = {r.conv_id: (r.valid, r.state) for r in chat.formatted(df).collect()}
    assert got == {1: (True, "assistant"), 2: (False, "user"), 3: (False, "error: >assistant"), 4: (False, "error: user>user"), 5: (True, "assistant"), 6: (False, "error: user>system")}


def test_loss_flags_cover_assistant_texts_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "a<|", "")], "conv_id long, turn long, role string, text string, state string")
    out = chat.formatted(df).first()
    assert "".join(s.text for s in out.segments) == out.formatted
    assert [s.text for s in out.segments if s.loss] == ["a&lt;|"]


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(df)).count() == 0
    assert chat.with_probe(df).count() == 2
    got = run(spark, [(1, 0, "user", "a", ""), (1, 0, "user", "a", "")])
    assert tuple(got[1])[1:5] == brute([("user", "a"), ("user", "a")])


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="<|&;amplt>im_x\n", max_size=30))
def test_escaping_is_reversible(text):
    t = chat.Template()
    escaped = text.replace("&", "&amp;").replace(t.control, t.escaped)
    assert t.control not in escaped
    assert escaped.replace(t.escaped, t.control).replace("&amp;", "&") == text


INST = chat.Template(start="[INST]", after_role=": ", end="[/INST]\n", control="[", escaped="&lb;", loss=("bot",), moves=(("", "me"), ("me", "bot"), ("bot", "me")), final=("bot",))
PIPES = chat.Template(start="<|$1(a|b)*\\E|>", end="<|.|>")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["me", "bot", "r: s", "[x]", "a&lb;b"]), st.text("[]INST/:& lb;<|\\\\Ea\n", max_size=20)), min_size=1, max_size=4), min_size=1, max_size=6), st.sampled_from([INST, PIPES, chat.Template()]))
def test_any_template_reads_back(spark, conversations, template):
    rows = [(k, j, r, t) for k, turns in enumerate(conversations) for j, (r, t) in enumerate(turns)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    got = {r["conv_id"]: [(x["role"], x["text"]) for x in r["turns"]] for r in out.select("conv_id", chat.read_back(F.col("formatted"), template).alias("turns")).collect()}
    assert got == dict(enumerate(conversations))


@pytest.mark.parametrize("wrong", [{"start": "[INST]"}, {"control": ""}, {"after_role": ""}, {"escaped": "<|"}, {"escaped": "&amp;x"}, {"end": "<|im_start|>x"}, {"control": "<|<", "start": "<|<a", "end": "<|<b"}])
def test_ambiguous_templates_are_refused(wrong):
    with pytest.raises(ValueError):
        chat.Template(**wrong)
