"""Chat templates: slots with {{name}} places, rendered and encoded as columns.

A template has a slot for each role. `{{content}}` is the turn's text; `{{bos}}` and `{{eos}}` stand for a
tokenizer's own marks and are given when rendering. Of a name that a slot has twice, the first place
is filled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[Column], Column]  # text -> array<int>

IGNORE = -100


def fill(slot: str, **values: Column | str) -> Column:
    """The slot with the first place of each name filled; other places stay as they are."""
    parts: list[Column] = []
    at, seen = 0, set()
    for m in re.finditer(r"\{\{([a-zA-Z_][a-zA-Z0-9_]*)\}\}", slot):
        if m[1] in values and m[1] not in seen:
            seen.add(m[1])
            value = values[m[1]]
            parts += [F.lit(slot[at : m.start()]), F.lit(value) if isinstance(value, str) else value]
            at = m.end()
    return F.concat(*parts, F.lit(slot[at:]))


@dataclass(frozen=True)
class Template:
    user: str = "{{content}}"
    assistant: str = "{{content}}{{eos}}"
    system: str = "{{content}}"
    observation: str | None = None  # as the user's
    function: str | None = None  # as the assistant's
    prefix: str = ""
    default_system: str = ""
    system_in_user: bool = False  # the system message goes into the first user turn
    marks: dict[str, str] = field(default_factory=lambda: {"bos": "<s>", "eos": "</s>"})

    def __post_init__(self):
        for slot in (self.user, self.assistant, self.system):
            if not re.search(r"\{\{[a-zA-Z_][a-zA-Z0-9_]*\}\}", slot):
                raise ValueError("a slot needs a place to fill")

    def turn(self, role: Column, content: Column) -> Column:
        """One turn's text by its role; unknown roles give null."""
        slots = {"user": self.user, "assistant": self.assistant, "observation": self.observation or self.user, "function": self.function or self.assistant}
        out = F.lit(None).cast("string")
        for name, slot in slots.items():
            out = F.when(role == name, fill(slot, content=content, **self.marks)).otherwise(out)
        return out

    def texts(self, turns: Column, system: Column | None = None) -> Column:
        """Texts of the turns, the prefix and the system message in front of the first."""
        said = F.coalesce(F.nullif(system, F.lit("")), F.lit(self.default_system)) if system is not None else F.lit(self.default_system)
        lead = F.when(said != "", fill(self.system, content=said, **self.marks)).otherwise("")
        prefix = fill(self.prefix, **self.marks)

        def one(t: Column, i: Column) -> Column:
            if self.system_in_user:
                return F.when(i == 0, F.concat(prefix, self.turn(t["role"], F.concat(lead, t["content"])))).otherwise(self.turn(t["role"], t["content"]))
            text = self.turn(t["role"], t["content"])
            return F.when(i == 0, F.concat(prefix, lead, text)).otherwise(text)

        return F.transform(turns, one)

    def render(self, turns: Column, system: Column | None = None) -> Column:
        return F.array_join(self.texts(turns, system), "")


CHATML_USER, CHATML = "<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n", "{{content}}<|im_end|>\n"

#: The slots of common chat formats.
TEMPLATES: dict[str, Template] = {
    "empty": Template(assistant="{{content}}"),
    "default": Template("Human: {{content}}{{eos}}\nAssistant:", "{{content}}{{eos}}\n", "System: {{content}}{{eos}}\n"),
    "alpaca": Template(
        "### Instruction:\n{{content}}\n\n### Response:\n", "{{content}}{{eos}}\n\n",
        default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n",
    ),
    "chatml": Template(CHATML_USER, CHATML, "<|im_start|>system\n{{content}}<|im_end|>\n", "<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n"),
    "gemma": Template("<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n", "{{content}}<end_of_turn>\n", "{{content}}\n\n", "<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n", prefix="{{bos}}", system_in_user=True),
    "mistral": Template("[INST] {{content}}[/INST]", " {{content}}{{eos}}", "{{content}}\n\n", '[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]', "[TOOL_CALLS] {{content}}{{eos}}", prefix="{{bos}}", system_in_user=True),
    "phi": Template("<|user|>\n{{content}}<|end|>\n<|assistant|>\n", "{{content}}<|end|>\n", "<|system|>\n{{content}}<|end|>\n"),
    "qwen": Template(CHATML_USER, CHATML, "<|im_start|>system\n{{content}}<|im_end|>\n", "<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n", CHATML, default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant."),
    "vicuna": Template("USER: {{content}} ASSISTANT:", default_system="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."),
    "zephyr": Template("<|user|>\n{{content}}{{eos}}<|assistant|>\n", system="<|system|>\n{{content}}{{eos}}", default_system="You are Zephyr, a helpful assistant."),
}


def register(name: str, template: Template) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} is registered already")
    TEMPLATES[name] = template
