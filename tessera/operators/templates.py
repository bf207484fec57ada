"""Chat templates: messages rendered to the texts that a model family is trained on.

A format is a text with ``{content}`` (its first occurrence is filled) and the marks ``{bos}`` and ``{eos}``; ahead of
the content ``{round}`` stands for the number of the exchange, from 0. What a
template does not name follows the rules of :class:`Template`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "{content}"


@dataclass(frozen=True)
class Template:
    """user, assistant, system, observation, function: role formats. The answer ends in ``{eos}`` unless ``bare_end``;
    tool results look like user turns and tool calls like answers unless they have formats of their own. fused: the
    system text goes into the first user turn. reasoning: answers hold a thought between ``thought_words``."""

    user: str = SLOT
    assistant: str | None = None
    system: str = SLOT
    observation: str | None = None
    function: str | None = None
    prefix: str = ""
    default_system: str = ""
    stop: tuple[str, ...] = ()
    bare_end: bool = False
    fused: bool = False
    reasoning: bool = False
    tool_format: str = "default"
    thought_words: tuple[str, str] = ("<think>\n", "\n</think>\n\n")

    def format(self, role: str) -> str:
        answer = self.assistant or (SLOT if self.bare_end else SLOT + "{eos}")
        return {"user": self.user, "assistant": answer, "system": self.system, "observation": self.observation or self.user, "function": self.function or answer}[role]


_IM = {"user": "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "assistant": "{content}<|im_end|>\n", "system": "<|im_start|>system\n{content}<|im_end|>\n"}
_QWEN = {**_IM, "function": "{content}<|im_end|>\n", "observation": "<|im_start|>user\n<tool_response>\n{content}\n</tool_response><|im_end|>\n<|im_start|>assistant\n", "stop": ("<|im_end|>",), "tool_format": "qwen"}
_TURN = {"user": "<start_of_turn>user\n{content}<end_of_turn>\n<start_of_turn>model\n", "assistant": "{content}<end_of_turn>\n", "system": "{content}\n\n", "observation": "<start_of_turn>tool\n{content}<end_of_turn>\n<start_of_turn>model\n", "prefix": "{bos}", "fused": True}

# The formats of public model families.
TEMPLATES: dict[str, Template] = {
    "alpaca": Template("### Instruction:\n{content}\n\n### Response:\n", "{content}{eos}\n\n", default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"),
    "aquila": Template("Human: {content}###Assistant:", "{content}###", "System: {content}###", default_system="A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.", stop=("</s>",)),
    "atom": Template("{bos}Human: {content}\n{eos}{bos}Assistant:", "{content}\n{eos}"),
    "baichuan": Template("<reserved_102>{content}<reserved_103>", bare_end=True),
    "baichuan2": Template("<reserved_106>{content}<reserved_107>", bare_end=True),
    "bailing": Template("<role>HUMAN</role>{content}<role>ASSISTANT</role>", system="<role>SYSTEM</role>{content}", observation="<role>OBSERVATION</role>{content}<role>ASSISTANT</role>", stop=("<|endoftext|>",), bare_end=True),
    "belle": Template("Human: {content}\n\nBelle: ", "{content}{eos}\n\n", prefix="{bos}"),
    "bluelm": Template("[|Human|]:{content}[|AI|]:"),
    "breeze": Template("[INST] {content} [/INST] ", prefix="{bos}", bare_end=True),
    "chatglm2": Template("[Round {round}]\n\n问：{content}\n\n答：", prefix="[gMASK]sop", bare_end=True),
    "chatglm3": Template("<|user|>\n{content}<|assistant|>", "\n{content}", "<|system|>\n{content}", "<|observation|>\n{content}<|assistant|>", SLOT, "[gMASK]sop", stop=("<|user|>", "<|observation|>"), bare_end=True, tool_format="glm4"),
    "chatml": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", stop=("<|im_end|>", "<|im_start|>")),
    "chatml_de": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", default_system="Du bist ein freundlicher und hilfsbereiter KI-Assistent.", stop=("<|im_end|>", "<|im_start|>")),
    "codegeex2": Template(prefix="[gMASK]sop"),
    "codegeex4": Template("<|user|>\n{content}<|assistant|>\n", system="<|system|>\n{content}", observation="<|observation|>\n{content}<|assistant|>\n", function=SLOT, prefix="[gMASK]<sop>", default_system="你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。", stop=("<|user|>", "<|observation|>"), bare_end=True, tool_format="glm4"),
    "cohere": Template("<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{content}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>", system="<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{content}<|END_OF_TURN_TOKEN|>", prefix="{bos}"),
    "cpm": Template("<用户>{content}<AI>", prefix="{bos}"),
    "cpm3": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", prefix="{bos}", stop=("<|im_end|>",)),
    "dbrx": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", default_system="You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\nYOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\nYou assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\nThis is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. You should be responding appropriately and usually that means not mentioning this.\nYOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY.", stop=("<|im_end|>",)),
    "deepseek": Template("User: {content}\n\nAssistant:", system="{content}\n\n", prefix="{bos}"),
    "deepseek3": Template("<｜User｜>{content}<｜Assistant｜>", prefix="{bos}"),
    "deepseekcoder": Template("### Instruction:\n{content}\n### Response:", "\n{content}\n<|EOT|>\n", prefix="{bos}", default_system="You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"),
    "deepseekr1": Template("<｜User｜>{content}<｜Assistant｜>", prefix="{bos}", reasoning=True),
    "default": Template("Human: {content}{eos}\nAssistant:", "{content}{eos}\n", "System: {content}{eos}\n"),
    "empty": Template(assistant=SLOT),
    "ernie": Template("<|im_start|>user\n{content}<|im_end|>\n\n<|im_start|>assistant\n", "{content}<|im_end|>\n\n", "<|im_start|>system\n{content}<|im_end|>\n\n", "<|im_start|>tool\n{content}<|im_end|>\n\n<|im_start|>assistant\n", default_system="<global_setting>\nthink_mode=True\n</global_setting>", stop=("<|im_end|>",)),
    "exaone": Template("[|user|]{content}\n[|assistant|]", "{content}{eos}\n", "[|system|]{content}[|endofturn|]\n"),
    "falcon": Template("User: {content}\nFalcon:", "{content}\n", bare_end=True),
    "falcon_h1": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", prefix="{bos}", stop=("<|im_end|>", "<|end_of_text|>")),
    "fewshot": Template(assistant="{content}\n\n", bare_end=True),
    "gemma": Template(**_TURN, stop=("<end_of_turn>",)),
    "gemma2": Template(**_TURN, stop=("<eos>", "<end_of_turn>"), bare_end=True),
    "gemma3n": Template(**_TURN, stop=("<end_of_turn>",)),
    "glm4": Template("<|user|>\n{content}<|assistant|>", "\n{content}", "<|system|>\n{content}", "<|observation|>\n{content}<|assistant|>", SLOT, "[gMASK]<sop>", stop=("<|user|>", "<|observation|>"), bare_end=True, tool_format="glm4"),
    "glm4_moe": Template("<|user|>\n{content}<|assistant|>", "\n{content}", "<|system|>\n{content}", "<|observation|>\n{content}<|assistant|>", SLOT, "[gMASK]<sop>", stop=("<|user|>", "<|observation|>"), bare_end=True, reasoning=True, tool_format="glm4_moe"),
    "glmz1": Template("<|user|>\n{content}<|assistant|>", "\n{content}", "<|system|>\n{content}", "<|observation|>\n{content}<|assistant|>", SLOT, "[gMASK]<sop>", stop=("<|user|>", "<|observation|>"), bare_end=True, reasoning=True, tool_format="glm4"),
    "gpt": Template("<|start|>user<|message|>{content}<|end|><|start|>assistant", "{content}<|end|>", "<|start|>system<|message|>{content}<|end|>", default_system="You are ChatGPT, a large language model trained by OpenAI.", bare_end=True, reasoning=True, thought_words=("<|channel|>analysis<|message|>", "<|end|><|start|>assistant<|channel|>final<|message|>")),
    "granite3": Template("<|start_of_role|>user<|end_of_role|>{content}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "{content}<|end_of_text|>\n", "<|start_of_role|>system<|end_of_role|>{content}<|end_of_text|>\n"),
    "granite4": Template("<|start_of_role|>user<|end_of_role|>{content}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>", "{content}<|end_of_text|>\n", "<|start_of_role|>system<|end_of_role|>{content}<|end_of_text|>\n", "<|start_of_role|>tool<|end_of_role|>{content}<|end_of_text|>\n<|start_of_role|>assistant\n", "{content}<|end_of_text|>\n", default_system="You are Granite, developed by IBM. You are a helpful AI assistant.", stop=("<|end_of_text|>",)),
    "hunyuan": Template("{content}<|extra_0|>", "{content}<|eos|>", "{content}<|extra_4|>", prefix="<|startoftext|>", stop=("<|eos|>",)),
    "index": Template("reserved_0{content}reserved_1", system="<unk>{content}", bare_end=True),
    "intern": Template("<|User|>:{content}\n<|Bot|>:", "{content}<eoa>\n", "<|System|>:{content}\n", prefix="{bos}", default_system="You are an AI assistant whose name is InternLM (书生·浦语).\n- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文.", stop=("<eoa>",)),
    "intern2": Template(**_IM, prefix="{bos}", default_system="You are an AI assistant whose name is InternLM (书生·浦语).\n- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文.", stop=("<|im_end|>",)),
    "llama2": Template("{bos}[INST] {content} [/INST]", system="<<SYS>>\n{content}\n<</SYS>>\n\n", fused=True),
    "llama2_zh": Template("{bos}[INST] {content} [/INST]", system="<<SYS>>\n{content}\n<</SYS>>\n\n", default_system="You are a helpful assistant. 你是一个乐于助人的助手。", fused=True),
    "llama3": Template(
        "<|start_header_id|>user<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "{content}<|eot_id|>",
        "<|start_header_id|>system<|end_header_id|>\n\n{content}<|eot_id|>",
        "<|start_header_id|>ipython<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
        "{content}<|eot_id|>",
        "{bos}",
        stop=("<|eot_id|>", "<|eom_id|>"),
        tool_format="llama3",
    ),
    "llama4": Template(
        "<|header_start|>user<|header_end|>\n\n{content}<|eot|><|header_start|>assistant<|header_end|>\n\n",
        "{content}<|eot|>",
        "<|header_start|>system<|header_end|>\n\n{content}<|eot|>",
        "<|header_start|>ipython<|header_end|>\n\n{content}<|eot|><|header_start|>assistant<|header_end|>\n\n",
        "{content}<|eot|>",
        "{bos}",
        stop=("<|eot|>", "<|eom|>"),
        tool_format="llama3",
    ),
    "marco": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", default_system="你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.\n## 重要！！！！！\n当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。\n<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。\n", stop=("<|im_end|>",)),
    "mimo": Template(**_QWEN, default_system="You are a helpful assistant.", reasoning=True),
    "ministral": Template("[INST]{content}[/INST]", system="{content}\n\n", observation='[TOOL_RESULTS]{"content": {content}}[/TOOL_RESULTS]', function="[TOOL_CALLS]{content}{eos}", prefix="{bos}", fused=True, tool_format="mistral"),
    "mistral": Template("[INST] {content}[/INST]", " {content}{eos}", "{content}\n\n", '[TOOL_RESULTS] {"content": {content}}[/TOOL_RESULTS]', "[TOOL_CALLS] {content}{eos}", "{bos}", fused=True, tool_format="mistral"),
    "mistral_small": Template("[INST]{content}[/INST]", system="[SYSTEM_PROMPT]{content}[/SYSTEM_PROMPT]", observation='[TOOL_RESULTS]{"content": {content}}[/TOOL_RESULTS]', function="[TOOL_CALLS]{content}{eos}", prefix="{bos}", tool_format="mistral"),
    "moonlight": Template("<|im_user|>user<|im_middle|>{content}<|im_end|><|im_assistant|>assistant<|im_middle|>", "{content}<|im_end|>", "<|im_system|>system<|im_middle|>{content}<|im_end|>", default_system="You are a helpful assistant provided by Moonshot-AI.", stop=("<|im_end|>",)),
    "olmo": Template("<|user|>\n{content}<|assistant|>\n", prefix="{eos}"),
    "openchat": Template("GPT4 Correct User: {content}{eos}GPT4 Correct Assistant:", prefix="{bos}"),
    "openchat-3.6": Template("<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n", prefix="{bos}", stop=("<|eot_id|>",)),
    "opencoder": Template(**_IM, observation="<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n", default_system="You are OpenCoder, created by OpenCoder Team.", stop=("<|im_end|>",)),
    "orion": Template("Human: {content}\n\nAssistant: {eos}", prefix="{bos}"),
    "phi": Template("<|user|>\n{content}<|end|>\n<|assistant|>\n", "{content}<|end|>\n", "<|system|>\n{content}<|end|>\n", stop=("<|end|>",)),
    "phi4": Template("<|im_start|>user<|im_sep|>{content}<|im_end|><|im_start|>assistant<|im_sep|>", "{content}<|im_end|>", "<|im_start|>system<|im_sep|>{content}<|im_end|>", stop=("<|im_end|>",)),
    "phi_small": Template("<|user|>\n{content}<|end|>\n<|assistant|>\n", "{content}<|end|>\n", "<|system|>\n{content}<|end|>\n", prefix="<|endoftext|>", stop=("<|end|>",)),
    "qwen": Template(**_QWEN, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "qwen3": Template(**_QWEN, reasoning=True),
    "qwen3_nothink": Template(**_QWEN),
    "sailor": Template("<|im_start|>question\n{content}<|im_end|>\n<|im_start|>answer\n", "{content}<|im_end|>\n", "<|im_start|>system\n{content}<|im_end|>\n", default_system="You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed.", stop=("<|im_end|>",)),
    "seed_coder": Template("{bos}user\n{content}{eos}{bos}assistant\n", system="{bos}system\n{content}{eos}", default_system="You are an AI programming assistant, utilizing the Seed-Coder model, developed by ByteDance Seed, and you only answer questions related to computer science. For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n\n"),
    "seed_oss": Template("{bos}user\n{content}{eos}{bos}assistant\n", system="{bos}system\n{content}{eos}", function="{bos}\n{content}{eos}", reasoning=True, tool_format="seed_oss", thought_words=("<seed:think>", "</seed:think>")),
    "smollm": Template(**_IM, stop=("<|im_end|>",)),
    "smollm2": Template(**_IM, default_system="You are a helpful AI assistant named SmolLM, trained by Hugging Face.", stop=("<|im_end|>",)),
    "solar": Template("### User:\n{content}\n\n### Assistant:\n", system="### System:\n{content}\n\n", bare_end=True),
    "starchat": Template("<|user|>\n{content}<|end|>\n<|assistant|>", "{content}<|end|>\n", "<|system|>\n{content}<|end|>\n", stop=("<|end|>",)),
    "telechat": Template("<_user>{content}<_bot>", system="<_system>{content}<_end>"),
    "telechat2": Template("<_user>{content}<_bot>", system="<_system>{content}", default_system="你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。"),
    "vicuna": Template("USER: {content} ASSISTANT:", default_system="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."),
    "xuanyuan": Template("Human: {content} Assistant:", default_system="以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"),
    "xverse": Template("Human: {content}\n\nAssistant: "),
    "yayi": Template("<|Human|>:\n{content}\n\n<|YaYi|>:", "{content}\n\n", "<|System|>:\n{content}\n\n", default_system="You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information.", stop=("<|End|>",)),
    "yi": Template(**_IM, stop=("<|im_end|>",)),
    "yuan": Template("{content}<sep>", "{content}<eod>\n", stop=("<eod>",)),
    "zephyr": Template("<|user|>\n{content}{eos}<|assistant|>\n", system="<|system|>\n{content}{eos}", default_system="You are Zephyr, a helpful assistant."),
    "ziya": Template("<human>:{content}\n<bot>:", "{content}\n"),
}


def chat_template(name: str) -> Template:
    if name not in TEMPLATES:
        raise KeyError(f"unknown template {name!r}; known: {sorted(TEMPLATES)}")
    return TEMPLATES[name]


def _fill(form: str, content: Column, bos: str, eos: str, i: Column | None = None) -> Column:
    marks = lambda s: F.lit(s.replace("{bos}", bos).replace("{eos}", eos))
    head, _, tail = form.partition(SLOT)
    first, numbered, second = head.partition("{round}")
    led = F.concat(marks(first), F.floor(i / 2).cast("string"), marks(second)) if numbered else marks(head)
    return F.concat(led, content, marks(tail))


def without_thought(t: Template, content: Column) -> Column:
    """Content without the thoughts of the family, and without line feeds at its start."""
    a, b = (re.escape(w) for w in t.thought_words)
    return F.regexp_replace(F.regexp_replace(content, f"(?s){a}(.*?){b}", ""), "^\\n+", "")


def _thoughtless(t: Template, content: Column) -> Column:
    return ~F.contains(content, F.lit(t.thought_words[0].strip())) & ~F.contains(content, F.lit(t.thought_words[1].strip()))


def _rendered(t: Template, messages: Column, system: Column | None, tools: Column | None, bos: str, eos: str) -> Column:
    """Array of texts, one a message; the first begins with the prefix and the system text (with the tool text)."""
    said = F.lit(t.default_system) if system is None else F.when(F.coalesce(system, F.lit("")) == "", F.lit(t.default_system)).otherwise(system)
    listed = F.lit("") if tools is None else F.coalesce(tools, F.lit(""))
    intro = F.when((said == "") & (listed == ""), F.lit("")).otherwise(_fill(t.system, F.concat(said, listed), bos, eos))
    prefix = F.lit(t.prefix.replace("{bos}", bos).replace("{eos}", eos))

    def one(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        asked = F.when((i == 0) & F.lit(t.fused), F.concat(intro, content)).otherwise(content)
        text = F.raise_error(F.concat(F.lit("unexpected role: "), m["role"])).cast("string")
        for role in ("function", "observation", "assistant", "user"):
            text = F.when(m["role"] == role, _fill(t.format(role), asked if role == "user" else content, bos, eos, i)).otherwise(text)
        return F.when(i == 0, F.concat(prefix, F.lit("") if t.fused else intro, text)).otherwise(text)

    return F.transform(messages, one)


def _edited(messages: Column, where, change) -> Column:
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(where(i), change(m["content"])).otherwise(m["content"]).alias("content")))


def multi_turn(messages: Column, name: str, *, system: Column | None = None, tools: Column | None = None, bos: str = "<s>", eos: str = "</s>", thinking: bool | None = None) -> Column:
    """Array of (source, target) texts of a conversation whose turns alternate (an even number of messages).

    Reasoning families: with ``thinking`` False the thoughts of all answers go. An answer without a thought gets an
    empty one: on the source (not trained) unless ``thinking`` is True, then on the target.
    """
    t = chat_template(name)
    plain = _edited(messages, lambda i: i % 2 == 1, lambda c: without_thought(t, c)) if t.reasoning and thinking is False else messages
    texts = _rendered(t, plain, system, tools, bos, eos)
    empty = F.lit("".join(t.thought_words))

    def pair(i: Column) -> Column:
        source, target = F.get(texts, i), F.get(texts, i + 1)
        if t.reasoning:
            bare = _thoughtless(t, F.get(plain, i + 1)["content"])
            if thinking:
                target = F.when(bare, F.concat(empty, target)).otherwise(target)
            else:
                source = F.when(bare, F.concat(source, empty)).otherwise(source)
        return F.struct(source.alias("source"), target.alias("target"))

    return F.when(F.size(messages) < 2, F.array().cast("array<struct<source:string,target:string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(messages) - 2, F.lit(0)), F.lit(2)), pair))


def one_turn(messages: Column, name: str, *, system: Column | None = None, tools: Column | None = None, bos: str = "<s>", eos: str = "</s>", thinking: bool | None = None) -> Column:
    """Struct (prompt, response): all texts but the last, joined, and the last.

    Reasoning families: thoughts of earlier answers go, and that of the last with ``thinking`` False; a last answer
    without a thought gets an empty one as in :func:`multi_turn`.
    """
    t = chat_template(name)
    n = F.size(messages)
    plain = messages
    if t.reasoning:
        plain = _edited(messages, lambda i: (i % 2 == 1) & (F.lit(thinking is False) & (i == n - 1) | (i < n - 2)), lambda c: without_thought(t, c))
    texts = _rendered(t, plain, system, tools, bos, eos)
    prompt, response = F.array_join(F.slice(texts, F.lit(1), F.greatest(n - 1, F.lit(0))), ""), F.element_at(texts, -1)
    if t.reasoning:
        bare, empty = _thoughtless(t, F.element_at(plain, -1)["content"]), F.lit("".join(t.thought_words))
        if thinking:
            response = F.when(bare, F.concat(empty, response)).otherwise(response)
        else:
            prompt = F.when(bare, F.concat(prompt, empty)).otherwise(prompt)
    return F.struct(prompt.alias("prompt"), response.alias("response"))


def stop_words(name: str, eos: str = "</s>") -> list[str]:
    """Texts that end an answer: the end mark and the family's own."""
    return list(dict.fromkeys([eos, *chat_template(name).stop]))
