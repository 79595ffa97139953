"""Column expressions over conversations: arrays of (role, content) turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER_SIDE, MODEL_SIDE = ("user", "human", "observation"), ("assistant", "gpt", "function_call", "function")


def ordered_turns(order: str = "turn", role: str = "role", content: str = "text") -> Column:
    """Aggregate: the turns of a group in order, as (role, content)."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return F.transform(packed, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))


def system_of(turns: Column) -> Column:
    """The leading system message, or an empty string."""
    return F.when(F.get(turns, F.lit(0))["role"] == "system", F.get(turns, F.lit(0))["content"]).otherwise(F.lit(""))


def without_system(turns: Column) -> Column:
    return F.when(F.get(turns, F.lit(0))["role"] == "system", F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def alternates(turns: Column) -> Column:
    """Whether user-side and model-side turns alternate, user first."""
    sides = F.transform(turns, lambda t, i: F.when(i % 2 == 0, t["role"].isin(*USER_SIDE)).otherwise(t["role"].isin(*MODEL_SIDE)))
    return F.forall(sides, lambda ok: F.coalesce(ok, F.lit(False)))


def is_complete(turns: Column) -> Column:
    """A supervised example: alternating, not empty and closed by the model."""
    return alternates(turns) & (F.size(turns) > 0) & (F.size(turns) % 2 == 0)


def repair_alternation(rows: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", first: str = "user", last: str = "assistant") -> DataFrame:
    """Rows of a conversation that alternate: other roles go, then everything before the
    first user turn, then each row whose role equals that of the row kept before it, then
    a trailing user turn. Of a run of equal roles the first stays, so two windows do it."""
    w = Window.partitionBy(by).orderBy(order)
    ours = rows.filter(F.col(role).isin(first, last)).withColumn("__seen", F.max(F.when(F.col(role) == first, 1).otherwise(0)).over(w)).filter("__seen = 1")
    runs = ours.withColumn("__before", F.lag(role).over(w)).filter(F.col("__before").isNull() | (F.col("__before") != F.col(role)))
    tail = runs.withColumn("__next", F.lead(role).over(w))
    return tail.filter(~((F.col(role) == first) & F.col("__next").isNull())).drop("__seen", "__before", "__next")


def round_numbers(turns: Column) -> Column:
    """Round of each turn of an array of roles: a new round begins when the role was seen
    in the current one."""
    start = F.struct(F.lit(1).alias("round"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        again = F.array_contains(s["seen"], r)
        number = F.when(again, s["round"] + 1).otherwise(s["round"])
        return F.struct(number.alias("round"), F.when(again, F.array(r)).otherwise(F.array_append(s["seen"], r)).alias("seen"), F.array_append(s["out"], number).alias("out"))

    return F.aggregate(turns, start, step, lambda s: s["out"])


def placeholder_count(text: Column, mark: str = "<image>") -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def with_placeholders(text: Column, images: Column, mark: str = "<image>") -> Column:
    """The text with as many marks in front as it lacks."""
    missing = F.greatest(F.size(images) - placeholder_count(text, mark), F.lit(0))
    return F.concat(F.repeat(F.lit(mark), missing), text)


def instruction_turns(instruction: Column, query: Column, history: Column | None = None) -> Column:
    """History pairs and the prompt of an instruction row as turns; empty parts are left out
    of the prompt."""
    prompt = F.concat_ws("\n", F.nullif(instruction, F.lit("")), F.nullif(query, F.lit("")))
    now = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    if history is None:
        return now
    old = F.flatten(F.transform(history, lambda p: F.array(F.struct(F.lit("user").alias("role"), p[0].alias("content")), F.struct(F.lit("assistant").alias("role"), p[1].alias("content")))))
    return F.concat(F.coalesce(old, F.array().cast("array<struct<role:string,content:string>>")), now)


def render(turns: Column, slots: dict[str, tuple[str, str]], system: Column | None = None, prefix: str = "", system_slot: tuple[str, str] = ("", "\n")) -> Column:
    """Turns as one text: each role's content between its two slot texts, after the prefix and
    the system message, where there is one."""

    def one(t: Column) -> Column:
        out = t["content"]
        for role, (before, after) in slots.items():
            out = F.when(t["role"] == role, F.concat(F.lit(before), t["content"], F.lit(after))).otherwise(out)
        return out

    head = F.lit(prefix)
    if system is not None:
        head = F.concat(head, F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit(system_slot[0]), system, F.lit(system_slot[1]))).otherwise(""))
    return F.concat(head, F.array_join(F.transform(turns, one), ""))


def labelled(source: Column, target: Column, ignore: int = -100, train_on_prompt: bool = False) -> tuple[Column, Column, Column]:
    """input_ids, attention_mask and labels of token arrays: the prompt is masked."""
    ids = F.concat(source, target)
    masked = source if train_on_prompt else F.array_repeat(F.lit(ignore), F.size(source))
    return ids, F.array_repeat(F.lit(1), F.size(ids)), F.concat(masked, target)


def pad(ids: Column, length: int, value: int) -> Column:
    return F.concat(F.slice(ids, F.lit(1), F.lit(length)), F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def packed_segments(sizes: Column, total: int) -> Column:
    """Segment-numbered attention mask of packed sequences: 1s, then 2s, ..., 0s as padding."""
    runs = F.flatten(F.transform(sizes, lambda n, i: F.array_repeat(i + 1, n)))
    return pad(runs, total, 0)


def block_mask(segments: Column) -> Column:
    """For each pair of places whether the first may look at the second: equal segments, not
    padding, not later. For small arrays."""
    return F.transform(segments, lambda a, i: F.transform(segments, lambda b, j: F.when((a == b) & (a != 0) & (j <= i), 1).otherwise(0)))


def tool_calls(text: Column) -> Column:
    """(name, arguments) of tagged JSON calls; entries that are not JSON objects are null."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    return F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))


def action_calls(text: Column) -> Column:
    """(name, arguments) of Action / Action Input pairs."""
    found = F.regexp_extract_all(text, F.lit(r"Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(\{[^\n]*\})"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"Action:\s*([a-zA-Z0-9_]+)", 1).alias("name"), F.regexp_extract(m, r"Action Input:\s*(.*)$", 1).alias("arguments")))


def call_text(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))), "\n")


def expand_placeholders(text: Column, sizes: Column, mark: str = "<image>", start: str = "<s>", pad_mark: str = "<p>", end: str = "</s>") -> Column:
    """Each mark in turn becomes start, its number of pads, end; marks beyond the sizes stay."""
    parts = F.split(text, mark)
    joined = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i <= F.size(sizes), F.concat(F.lit(start), F.repeat(F.lit(pad_mark), F.get(sizes, i - 1)), F.lit(end))).otherwise(F.lit(mark)), p)))
    return F.array_join(joined, "")


def tagged_calls(text: Column) -> Column:
    """(name, arguments) of calls written as <function=name><parameter=key>value</parameter>..
    </function>: arguments are a JSON object; values that are JSON stay so, others are strings."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<function=[^>]+>.*?</function>"), F.lit(0))
    pattern = r"(?s)<parameter=([^>]+)>\s*(.*?)\s*</parameter>"

    def one(b: Column) -> Column:
        found = F.regexp_extract_all(b, F.lit(pattern), F.lit(0))
        part = lambda m, i: F.regexp_extract(m, pattern, i)
        value = lambda v: F.when(F.try_parse_json(v).isNotNull(), v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        args = F.transform(found, lambda m: F.concat(F.lit('"'), part(m, 1), F.lit('": '), value(part(m, 2))))
        return F.struct(F.regexp_extract(b, r"<function=([^>]+)>", 1).alias("name"), F.concat(F.lit("{"), F.array_join(args, ", "), F.lit("}")).alias("arguments"))

    return F.transform(bodies, one)


def tool_text(tools: Column) -> Column:
    """A description of tools (name, description, params: name -> (type, description))."""

    def one(t: Column) -> Column:
        lines = F.transform(F.map_entries(t["params"]), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(" ("), e["value"]["type"], F.lit("): "), e["value"]["description"]))
        return F.concat(F.lit("> Tool Name: "), t["name"], F.lit("\nTool Description: "), t["description"], F.lit("\nTool Args:\n"), F.array_join(F.array_sort(lines), "\n"))

    return F.array_join(F.transform(tools, one), "\n")


#: Templates by name: the slot texts of each role, prefix and system slot.
TEMPLATES = {
    "plain": ({"user": ("User: ", "\n"), "assistant": ("Assistant: ", "\n")}, "", ("", "\n")),
    "chatml": ({"user": ("<|im_start|>user\n", "<|im_end|>\n"), "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n")}, "", ("<|im_start|>system\n", "<|im_end|>\n")),
}


def register_template(name: str, slots: dict[str, tuple[str, str]], prefix: str = "", system_slot: tuple[str, str] = ("", "\n")) -> None:
    if name in TEMPLATES:
        raise ValueError(f"template {name} is registered already")
    TEMPLATES[name] = (slots, prefix, system_slot)


def render_with(name: str, turns: Column, system: Column | None = None) -> Column:
    slots, prefix, system_slot = TEMPLATES[name]
    return render(turns, slots, system, prefix, system_slot)
