"""Formatting conversations with a compiled template, and reading them back.

Scale: rows are dealt by conversation and sorted within their partition; rendering
and reading stream over them with a turn in memory at a time, so even a conversation
that holds a third of all rows needs no more than its one task's time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.chat_template import compile_template, unescape

TEMPLATE = (
    "{% for m in messages %}<turn {{ m.role | escape }}>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_PIECES = "conv_id long, piece long, text string, start long, spans array<struct<start:bigint,stop:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_BATCH = 1024


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, len(batch), _BATCH):
            yield from batch.slice(start, _BATCH).to_pylist()


def _formatted(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), _SPAN]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "piece", "text", "start", "spans"])

        for conv_id, rows in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            taken = 0

            def messages(rows=rows) -> Iterator[dict]:
                nonlocal taken
                for r in rows:
                    taken += 1
                    yield {"role": r["role"] or "", "text": r["text"] or ""}

            piece, start, at, texts, spans, seen = 0, 0, 0, [], [], 0
            for text, learned in render(messages=messages()):
                if taken != seen and texts:
                    out.append((conv_id, piece, "".join(texts), start, spans))
                    piece, start, texts, spans = piece + 1, at, [], []
                    if len(out) >= _BATCH:
                        yield flush()
                seen = taken
                if learned and text:
                    if spans and spans[-1]["stop"] == at:
                        spans[-1]["stop"] = at + len(text)
                    else:
                        spans.append({"start": at, "stop": at + len(text)})
                texts.append(text)
                at += len(text)
            if texts:
                out.append((conv_id, piece, "".join(texts), start, spans))
            for _ in rows:  # a template need not walk all messages
                pass
        yield flush()

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, piece, text, start, spans): the formatted conversations in pieces.

    A conversation is its pieces' texts one after the other, about one for each turn;
    ``start`` is a piece's place in it and ``spans`` are the stretches of it, in code
    points of the whole, that the template marks as generated.

    Rows are ordered by turn, ties by role and text, nulls first. A null text or role
    is an empty one; null conv_ids make one conversation. Repeated rows are turns
    each. An empty table gives no rows; other columns are not read.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatted(template), _PIECES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []
    for conv_id, pieces in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        turns, learned, n_turns, chars, loss, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
        for p in pieces:
            for span in p["spans"]:
                text = unescape(p["text"][span["start"] - p["start"] : span["stop"] - p["start"]])
                learned.update(text.encode())
                loss += len(text)
            chars += len(p["text"])
            rest += p["text"]
            while (end := rest.find("</turn>\n")) >= 0:
                head, _, body = rest[:end].partition(">")
                if not head.startswith("<turn "):
                    raise ValueError("a turn does not begin with its mark")
                turns.update(f"{unescape(head[6:])}\n{unescape(body)}\n".encode())
                n_turns, rest = n_turns + 1, rest[end + 8 :]
        if rest:
            raise ValueError("text after the last turn")
        out.append((conv_id, n_turns, turns.hexdigest(), loss, learned.hexdigest(), chars))
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of conversations that ``format_conversations`` made with ``TEMPLATE``.

    Pieces have to come as they were made, a conversation's together and in order;
    turns are found by their marks, learned text by its spans alone. A null conv_id is a
    conversation like any other; texts of any length stream by pieces; an empty table
    gives no rows; other columns are not read.
    """
    return pieces.select("conv_id", "text", "start", "spans").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
