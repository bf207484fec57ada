"""Rendered conversations of every family, and thoughts."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import templates as t

ASK = [("user", "How many {content} moons?"), ("assistant", "Two.")]
TALK = [("user", "q0"), ("assistant", "<think>\nhm\n</think>\n\na0"), ("user", "q1"), ("assistant", "a1")]


def table(spark, *talks):
    return spark.createDataFrame([(k, x) for k, x in enumerate(talks)], "k int, m array<struct<role:string,content:string>>")


def pairs(spark, name, talk, **settings):
    (r,) = table(spark, talk).select(t.multi_turn(F.col("m"), name, **settings).alias("p")).collect()
    return [tuple(x) for x in r.p]


def single(spark, name, talk, **settings):
    (r,) = table(spark, talk).select(t.one_turn(F.col("m"), name, **settings).alias("p")).collect()
    return tuple(r.p)


def test_every_family_holds_the_content_once(spark):
    df = table(spark, ASK)
    got = df.select(*(t.multi_turn(F.col("m"), n, system=F.lit("Be kind.")).alias(n) for n in t.TEMPLATES)).first()
    for name, f in t.TEMPLATES.items():
        ((source, target),) = got[name]
        assert source.count("How many {content} moons?") == 1 and target.count("Two.") == 1 and ("Be kind." in source), name
        assert target == f.format("assistant").replace("{content}", "Two.").replace("{eos}", "</s>")
        assert all(x in ("</s>", *f.stop) for x in t.stop_words(name))


@pytest.mark.parametrize(("name", "source", "target"), [
    ("alpaca", "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\nHi\n\n### Response:\n", "Yo</s>\n\n"),
    ("llama2", "<s>[INST] Hi [/INST]", "Yo</s>"), ("mistral", "<s>[INST] Hi[/INST]", " Yo</s>"), ("falcon", "User: Hi\nFalcon:", "Yo\n"), ("glm4", "[gMASK]<sop><|user|>\nHi<|assistant|>", "\nYo"), ("olmo", "</s><|user|>\nHi<|assistant|>\n", "Yo</s>"),
    ("qwen", "<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n", "Yo<|im_end|>\n"),
    ("qwen3", "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n", "Yo<|im_end|>\n"), ("baichuan2", "<reserved_106>Hi<reserved_107>", "Yo"),
    ("ziya", "<human>:Hi\n<bot>:", "Yo\n"), ("bluelm", "[|Human|]:Hi[|AI|]:", "Yo</s>"), ("mistral_small", "<s>[INST]Hi[/INST]", "Yo</s>"), ("seed_oss", "<s>user\nHi</s><s>assistant\n<seed:think></seed:think>", "Yo</s>"),
])
def test_texts(spark, name, source, target):
    assert pairs(spark, name, [("user", "Hi"), ("assistant", "Yo")]) == [(source, target)]


def test_rounds_are_numbered(spark):
    assert [s for s, _ in pairs(spark, "chatglm2", TALK)] == ["[gMASK]sop[Round 0]\n\n问：q0\n\n答：", "[Round 1]\n\n问：q1\n\n答："]


def test_system_is_fused(spark):
    ((source, _),) = pairs(spark, "llama2", [("user", "Hi"), ("assistant", "Yo")], system=F.lit("S"), tools=F.lit("T"))
    assert source == "<s>[INST] <<SYS>>\nST\n<</SYS>>\n\nHi [/INST]"
    ((source, _),) = pairs(spark, "gemma", [("user", "Hi"), ("assistant", "Yo")], system=F.lit("S"))
    assert source == "<s><start_of_turn>user\nS\n\nHi<end_of_turn>\n<start_of_turn>model\n"


def test_thoughts(spark):
    empty = "<think>\n\n</think>\n\n"
    keep = pairs(spark, "qwen3", TALK)
    assert keep[0][1].startswith("<think>\nhm") and keep[1][0].endswith(empty) and keep[1][1] == "a1<|im_end|>\n"
    assert pairs(spark, "qwen3", TALK, thinking=True)[1][1] == empty + "a1<|im_end|>\n"
    off = pairs(spark, "qwen3", TALK, thinking=False)
    assert off[0][1] == "a0<|im_end|>\n" and all(s.endswith(empty) for s, _ in off)
    prompt, response = single(spark, "qwen3", TALK)
    assert "hm" not in prompt and "a0" in prompt and prompt.endswith(empty) and response == "a1<|im_end|>\n"
    prompt, response = single(spark, "qwen3", TALK[:2], thinking=False)
    assert response == "a0<|im_end|>\n" and prompt.endswith(empty)
    assert single(spark, "deepseekr1", TALK[:2], thinking=True)[1] == "<think>\nhm\n</think>\n\na0</s>"


def test_tool_turns_and_faults(spark):
    talk = [("user", "q"), ("function", "CALL"), ("observation", "42"), ("assistant", "a")]
    got = pairs(spark, "mistral", talk)
    assert got[0][1] == "[TOOL_CALLS] CALL</s>" and got[1][0] == '[TOOL_RESULTS] {"content": 42}[/TOOL_RESULTS]'
    assert pairs(spark, "vicuna", talk)[1][0] == "USER: 42 ASSISTANT:"
    assert pairs(spark, "yi", [("user", "alone")]) == []
    with pytest.raises(Exception, match="unexpected role"):
        pairs(spark, "yi", [("judge", "x"), ("assistant", "y")])
    with pytest.raises(KeyError):
        t.chat_template("no such family")
