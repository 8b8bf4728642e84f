"""Chat formatting: nested field paths of a record are hashed to select a declarative mapping to canonical turns, which a template renders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import column

TURNS = "array<struct<role:string,text:string>>"
#: Column of the texts that a record refers to.
TEXTS = "record_texts"
#: The template: marks of a turn, in ChatML's form.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that steer some chat model; inside texts and roles each is written as a backslash and its letter, a backslash as \e.
CONTROL = {"<|im_start|>": "s", "<|im_end|>": "t", "<|endoftext|>": "x", "<s>": "b", "</s>": "c", "[INST]": "i", "[/INST]": "j", "<<SYS>>": "y", "<</SYS>>": "z"}
#: In roles a line break too, since it ends the role.
BREAK = {"\n": "n"}


@dataclass(frozen=True)
class Mapping:
    """How records with exactly these nested field paths become turns.

    ``shape``: the paths as ``shape()`` writes them. ``single``: (role, path) of turns in order. ``each``: (list path, role
    field, text field), with ``roles`` renaming roles.
    """

    name: str
    shape: str
    single: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self, record: Column) -> Column:
        if self.each is None:
            parts = [F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text")) for role, path in self.single]
            return F.array(*parts)
        where, role, text = self.each
        items = F.coalesce(F.try_variant_get(record, f"$.{where}" if where else "$", "array<variant>"), F.array().cast("array<variant>"))
        renamed = dict(self.roles)

        def turn(item: Column) -> Column:
            said = F.coalesce(F.try_variant_get(item, f"$.{role}", "string"), F.lit(""))
            for old, new in renamed.items():
                said = F.when(F.try_variant_get(item, f"$.{role}", "string") == old, new).otherwise(said)
            return F.struct(said.alias("role"), F.coalesce(F.try_variant_get(item, f"$.{text}", "string"), F.lit("")).alias("text"))

        return F.transform(items, turn)


_SHAREGPT = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", each=("messages", "role", "content")),
    Mapping("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", each=("conversations", "from", "value"), roles=_SHAREGPT),
    Mapping("named conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>, id>", each=("conversations", "from", "value"), roles=_SHAREGPT),
    Mapping("list of messages", "ARRAY<OBJECT<content, role>>", each=("", "role", "content")),
    Mapping("prompt response", "OBJECT<prompt, response>", (("user", "prompt"), ("assistant", "response"))),
    Mapping("system prompt response", "OBJECT<prompt, response, system>", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt completion", "OBJECT<completion, prompt>", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question answer", "OBJECT<answer, question>", (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction output", "OBJECT<instruction, output>", (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction input output", "OBJECT<input, instruction, output>", (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def shape(record: Column) -> Column:
    """All nested field paths of a variant as one text, at any depth: its schema without the types of leaves.

    ``schema_of_variant`` sorts the names of each level and merges the items of a list, so records of one layout have one shape
    whatever their length and values.
    """
    named = F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]+\))?", "")
    return F.regexp_replace(named, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]+\))?>", "ARRAY<>")


def fingerprint(shape_of: Column) -> Column:
    """Hash of the nested field paths."""
    return F.xxhash64(shape_of)


def canonical(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` (JSON texts) with ``layout`` (name of the mapping, null: none) and ``turns``, an array of role and text.

    Records that are null, no JSON, or of a layout without a mapping have null turns. An empty list of messages has no fields
    below it and so no mapping; give it turns of its own. Existing columns layout and turns are replaced.

    Texts may stand beside the record, since JSON parsers bound the length of a string: where ``records`` has a column
    ``record_texts``, an array of texts, the text ``#k`` of a turn is a reference to its k-th entry (from 0).
    """
    parsed = records.withColumn("__record", F.try_parse_json(column(records, record_col)))
    printed = parsed.withColumn("__print", fingerprint(shape(F.col("__record"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        known = F.col("__print") == fingerprint(F.lit(m.shape))
        layout, turns = F.when(known, m.name).otherwise(layout), F.when(known, m.turns(F.col("__record"))).otherwise(turns)
    if dict(records.dtypes).get(TEXTS) == "array<string>":
        told = lambda t: F.coalesce(F.get(TEXTS, F.substring(t["text"], 2, 10).try_cast("int")), F.lit(""))
        turns = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), told(t).alias("text")))
    return printed.withColumns({"layout": layout, "turns": turns}).drop("__record", "__print")


def escaped(text: Column, more: dict[str, str] | None = None) -> Column:
    """Backslashes and control strings as escapes; without a control string left, and reversible by ``restored``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for mark, letter in (CONTROL | (more or {})).items():
        out = F.replace(out, F.lit(mark), F.lit("\\" + letter))
    return out


def restored(text: Column, more: dict[str, str] | None = None) -> Column:
    """Every backslash begins an escape of one letter, so the letters can be replaced in turn and the backslash last."""
    out = text
    for mark, letter in (CONTROL | (more or {})).items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(mark))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def rendered(chats: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """``chats`` with ``segments`` (text, loss) in order and ``formatted``, their texts joined.

    Only the text of a turn of ``loss_role`` has loss; marks, roles and other texts have none. Null turns give null columns.
    """
    def parts(turn: Column) -> Column:
        role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
        seg = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
        return F.array(seg(F.concat(F.lit(BEGIN), escaped(role, BREAK), F.lit(MIDDLE)), F.lit(False)), seg(escaped(text), role == loss_role), seg(F.lit(END), F.lit(False)))

    with_segments = chats.withColumn("segments", F.flatten(F.transform(column(chats, turns_col), parts)))
    return with_segments.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted chat, escapes undone: its marks alone show where turns begin and end."""
    pieces = F.filter(F.split(formatted, F.lit(r"\Q" + END + r"\E")), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        return F.struct(restored(F.substring(role, len(BEGIN) + 1, 2**31 - 1), BREAK).alias("role"), restored(F.substr(piece, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, escapes undone, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: restored(s["text"])), "")


def records_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turn rows as one JSON record per conversation: ``conv_id``, ``record`` and ``record_texts``, to which its texts refer.

    Turns are ordered by turn, then role, then text (null first); null roles and texts are empty; repeated rows stay. The pair
    of user and assistant, with or without a system turn before it, is written as a prompt record, other chats as messages.
    """
    said = F.struct(column(rows, turn_col).cast("long").alias("turn"), F.coalesce(column(rows, role_col), F.lit("")).alias("role"), F.coalesce(column(rows, text_col), F.lit("")).alias("text"))
    chats = rows.groupBy(column(rows, conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("t"))
    order = F.array_join(F.transform("t", lambda x: x["role"]), "\n")
    text = lambda k: F.lit(f"#{k}")
    told = F.transform("t", lambda x, k: F.struct(x["role"].alias("role"), F.concat(F.lit("#"), k.cast("string")).alias("content")))
    record = (F.when((F.size("t") == 2) & (order == "user\nassistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
              .when((F.size("t") == 3) & (order == "system\nuser\nassistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
              .otherwise(F.to_json(F.struct(told.alias("messages")))))
    return chats.select("conv_id", record.alias("record"), F.transform("t", lambda x: x["text"]).alias(TEXTS))
