"""Chat formatting: conversations rendered through compiled templates, with loss masks.

``TEMPLATE`` marks every turn with its role and wraps assistant texts in generation
blocks.  Texts cannot forge a mark: the ``escape`` filter puts ``SHIELD`` after the first
character of each control string and after each ``SHIELD`` character already there, and
``unescape`` takes it out again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.template import compile_template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
SHIELD = "⁠"  # word joiner
TEMPLATE = (
    "{% for m in messages %}"
    "<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}"
    "</s>{% endfor %}"
)
_HIDE = re.compile("|".join([re.escape(SHIELD), *map(re.escape, CONTROLS)]))
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\](.*?)\[/INST\]|(.*?))</s>", re.S)


def escape(text: str | None) -> str:
    return _HIDE.sub(lambda m: m[0][0] + SHIELD + m[0][1:], text or "")


def unescape(text: str) -> str:
    """Takes out the ``SHIELD`` after each character that ``escape`` put one after."""
    return re.sub(f"(.){SHIELD}", r"\1", text, flags=re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])))
        at = m.end()
    return turns


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: ``id_col, formatted, loss_spans`` (code-point start and end
    of what generation blocks wrote).

    Rows are ordered by turn, then role, then text (nulls first); repeated rows stay.  Null
    text and null role count as empty.  Rows with a null id make one conversation with a null id.
    Other columns are not read.  An empty table gives an empty result."""
    rows = turns.select(F.col(id_col).alias("id"), F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("m"))
    convs = rows.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        render = compile_template(template, {"escape": escape})
        for batch in batches:
            made = [render({"messages": [{"role": x["role"] or "", "text": x["text"] or ""} for x in m]}) for m in batch.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([t for t, _ in made], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "formatted", "loss_spans"])

    return convs.mapInArrow(run, f"id {kind}, formatted string, loss_spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What reading the rendered text back gives: ``id_col, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                       len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["id", *names])

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col(id_col).alias("id"), "formatted", "loss_spans").mapInArrow(run, schema).withColumnRenamed("id", id_col)
