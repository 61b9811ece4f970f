"""Chat formatting with typed content parts: a visitor flattens parts to ordered placeholders, reversibly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks, and what other templates use; a text that holds one of them is escaped.
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
CONTROL = re.compile(r"<\||</?s>|\[/?INST\]|<</?SYS>>")
#: Attachments in a text: an image in brackets, or a tag with a source.
PART = re.compile(r"!\[[^\[\]\n]*\]\([^()\s]+\)|<(?:image|audio|document) src=\"[^\"<>]*\" ?/>")
#: Tokens that a placeholder of each kind stands for once expanded.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}

CHAT = """conv_id long, n_turns long, formatted string, roles array<string>,
    spans array<struct<start:int,end:int,loss:boolean>>, attachments array<struct<kind:string,source:string,at:int,tokens:int>>, expanded_tokens long"""


def escape(text: str) -> str:
    """A backslash before each backslash, and after the first character of each control string."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parts_of(text: str) -> Iterator[tuple[str, str]]:
    """(kind, content) of the typed parts of a text, in order."""
    at = 0
    for m in PART.finditer(text):
        if m.start() > at:
            yield "text", text[at : m.start()]
        yield ("image" if m[0][0] == "!" else m[0][1:].split(" ")[0]), m[0]
        at = m.end()
    if at < len(text):
        yield "text", text[at:]


class Flatten:
    """Visits parts in order: text is escaped, any other part becomes a placeholder and an attachment reference."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def add(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit(self, kind: str, content: str) -> None:
        if kind == "text":
            self.add(escape(content))
        else:
            self.attachments.append({"kind": kind, "source": content, "at": self.size, "tokens": EXPANDED[kind]})
            self.add(f"<|{kind}|>")


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[dict], list[dict]]:
    """The formatted conversation, the span of each turn's content (and if it is trained on), the attachments."""
    f, spans = Flatten(), []
    for role, text in turns:
        f.add(START + escape(role) + MESSAGE)
        start = f.size
        for kind, content in parts_of(text):
            f.visit(kind, content)
        spans.append({"start": start, "end": f.size, "loss": role == loss_role})
        f.add(END)
    return "".join(f.out), spans, f.attachments


def restore(content: str, at: int, attachments: list[dict]) -> str:
    """The text behind formatted content that starts at ``at``: placeholders become their sources, escapes go."""
    out, pos = [], 0
    for a in attachments:
        here = a["at"] - at
        if 0 <= here < len(content):
            out += [unescape(content[pos:here]), a["source"]]
            pos = here + len(f"<|{a['kind']}|>")
    return "".join([*out, unescape(content[pos:])])


def read_turns(formatted: str, attachments: list[dict]) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for m in re.finditer(re.escape(START) + r"(.*?)" + re.escape(MESSAGE) + r"(.*?)" + re.escape(END), formatted, re.S):
        turns.append((unescape(m[1]), restore(m[2], m.start(2), attachments)))
    return turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns = [(t["role"] or "", t["text"] or "") for t in r["turns"]]
            formatted, spans, attached = format_turns(turns)
            rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "formatted": formatted, "roles": [t[0] for t in turns], "spans": spans, "attachments": attached, "expanded_tokens": sum(a["tokens"] for a in attached)})
        schema = schema or pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("roles", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))),
            ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("source", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())]))), ("expanded_tokens", pa.int64()),
        ])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation (columns of ``CHAT``), its turns in order of turn, role and text.

    A conversation is one formatted string, so its rows meet in one task, as many as it has; nothing else does.
    Null role or text: empty. Null conv_id: a conversation of its own. Repeated rows are turns of their own.
    Spans are code points of ``formatted``; an attachment's ``at`` is where its placeholder stands.
    An empty table gives an empty table.
    """
    t = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).mapInArrow(_format, CHAT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens")}
        for r in batch.to_pylist():
            turns, loss = read_turns(r["formatted"], r["attachments"]), hashlib.sha256()
            chars = 0
            for s in r["spans"]:
                if s["loss"]:
                    got = restore(r["formatted"][s["start"] : s["end"]], s["start"], r["attachments"])
                    chars += len(got)
                    loss.update(got.encode())
            said = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            for k, v in zip(cols, (r["conv_id"], len(turns), said, chars, loss.hexdigest(), len(r["formatted"]), r["expanded_tokens"]), strict=True):
                cols[k].append(v)
        yield pa.record_batch([pa.array(v, pa.string() if "sha" in k else pa.int64()) for k, v in cols.items()], names=list(cols))


def chat_report(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, digests of the turns and of all text under the loss mask, as read back from the output."""
    return format_conversations(df).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long")
