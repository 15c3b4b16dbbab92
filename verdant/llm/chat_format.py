"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>``; the three marks are special tokens.
Control strings inside roles and texts are escaped by one backslash more between ``<`` and ``|``, which
one backslash less undoes. A rendered conversation is encoded once, with offsets; the turn spans that
carry loss (texts of ``assistant``) and the token spans, both sorted, are intersected by binary search.

No conversation is gathered in one task: rows are dealt by ranges of (conv_id, turn, ...), so a large
conversation spreads over many tasks, and each task renders and encodes segments of at most
``SEGMENT`` characters (or one turn). As a special token ends every turn, no token spans two segments:
the segments' tokens, one after another, are the tokens of the whole conversation. Offsets become those
of the conversation by a running sum over segments.

Cases: NULL texts and roles count as empty; NULL turns come first; equal turns go by role, then by a hash
of the text, and repeated rows are all kept; NULL conv_ids are one conversation; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SEGMENT = 1 << 20
LEARNED = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of learned texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in re.finditer(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", formatted, re.DOTALL)]


def intersect(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask, covered): which of the sorted token spans meet a span, and the stretches of the spans they cover."""
    if not len(tokens) or not spans:
        return np.zeros(len(tokens), dtype=bool), []
    starts, ends = np.array(spans).T
    first = np.searchsorted(ends, tokens[:, 0], side="right")  # the first span that ends after the token begins
    after = np.searchsorted(starts, tokens[:, 1], side="left")  # the first span that begins at its end or later
    many = np.where(tokens[:, 0] < tokens[:, 1], np.maximum(after - first, 0), 0)
    mask = many > 0
    token = np.repeat(np.arange(len(tokens)), many)
    span = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    low, high = np.maximum(tokens[token, 0], starts[span]), np.minimum(tokens[token, 1], ends[span])
    if not len(low):
        return mask, []
    reached = np.maximum.accumulate(high)
    apart = np.flatnonzero(low[1:] > reached[:-1]) + 1  # a stretch begins beyond all before it
    return mask, list(zip(low[np.r_[0, apart]].tolist(), reached[np.r_[apart - 1, len(low) - 1]].tolist(), strict=True))


def loader(vocabulary: str):
    """The encoder of a worker: the vocabulary with the three marks as special tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    encoder = Tokenizer.from_file(vocabulary)
    encoder.add_special_tokens([AddedToken(mark, special=True, normalized=False) for mark in (START, SEP, END)])
    encoder.post_processor = processors.ByteLevel(trim_offsets=False)
    return encoder


TOKENS = ("token_ids", "token_starts", "token_ends", "loss_mask")


def format_conversations(rows: DataFrame, vocabulary: str, segment: int = SEGMENT, without: tuple[str, ...] = ()) -> DataFrame:
    """Per segment: conv_id, part, seg, n_turns, char_start, formatted, token_ids, token_starts, token_ends, loss_mask, loss_spans.

    ``vocabulary`` is a file of the tokenizers library that every worker can read. ``part`` and ``seg`` order a
    conversation's segments. Offsets and spans count code points of the segment; ``char_start`` is where it
    begins in the conversation. Columns named in ``without`` (of ``TOKENS``) are not handed on.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [
            T.StructField("conv_id", rows.schema["conv_id"].dataType),
            *[T.StructField(n, T.LongType()) for n in ("part", "seg", "n_turns", "n_chars")],
            T.StructField("formatted", T.StringType()),
            *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("token_ids", "token_starts", "token_ends")],
            T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
            T.StructField("loss_spans", span),
        ]
    )
    schema = T.StructType([f for f in schema if f.name not in without])
    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "tie"]
    dealt = named.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "role", "text", F.spark_partition_id().cast("long").alias("part"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loader(vocabulary)
        kinds = pa.schema(
            [("conv_id", key), *[(n, pa.int64()) for n in ("part", "seg", "n_turns", "n_chars")], ("formatted", pa.string())]
            + [(n, pa.list_(pa.int32())) for n in ("token_ids", "token_starts", "token_ends")]
            + [("loss_mask", pa.list_(pa.bool_())), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        )
        kinds = pa.schema([f for f in kinds if f.name not in without])

        def together(segments):
            return pa.RecordBatch.from_arrays([pa.array([s[f.name] for s in segments], f.type) for f in kinds], schema=kinds)

        def encoded(conv, part, seg, turns):
            formatted, spans = render(turns)
            encoding = encoder.encode(formatted, add_special_tokens=False)
            offsets = encoding.offsets
            tokens = np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)
            mask, covered = intersect(tokens, spans)
            return {
                "conv_id": conv, "part": part, "seg": seg, "n_turns": len(turns), "n_chars": len(formatted), "formatted": formatted,
                "token_ids": () if "token_ids" in without else np.array(encoding.ids, np.int32), "token_starts": tokens[:, 0].astype(np.int32), "token_ends": tokens[:, 1].astype(np.int32),
                "loss_mask": mask, "loss_spans": [{"start": a, "end": b} for a, b in covered],
            }

        turns, size, seg, current = [], 0, 0, None
        for batch in rows:
            done, weight = [], 0
            for conv, role, text, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if turns and (conv != current[0] or size + len(text) > segment):
                    done.append(encoded(*current, seg, turns))
                    weight += size
                    seg, turns, size = (seg + 1 if conv == current[0] else 0), [], 0
                    if weight > segment:
                        yield together(done)
                        done, weight = [], 0
                current = (conv, part)
                turns.append((role, text))
                size += len(role) + len(text)
            if done:
                yield together(done)
        if turns:
            yield together([encoded(*current, seg, turns)])

    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(rows.schema["conv_id"].dataType)
    before = W.partitionBy("conv_id").orderBy("part", "seg").rowsBetween(W.unboundedPreceding, -1)
    return dealt.mapInArrow(batches, schema).withColumn("char_start", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says, read back segment by segment with running hashes.

    A conversation's digest needs its turns in order, so one task reads them all, but holds one batch at a time.
    """
    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField("conv_id", segments.schema["conv_id"].dataType), *[T.StructField(n, t) for n, t in fields]])
    names = [f.name for f in schema]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", key), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state = None

        def closed():
            return (state["conv"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

        for batch in rows:
            done = []
            for conv, formatted, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != state["conv"]:
                    if state is not None:
                        done.append(closed())
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in read_back(formatted):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    learned = unescape(formatted[s["start"] : s["end"]])
                    state["loss"].update(learned.encode())
                    state["loss_chars"] += len(learned)
                state["chars"] += len(formatted)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], kinds)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, closed(), strict=True))], kinds)

    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(segments.schema["conv_id"].dataType)
    ordered = segments.select("conv_id", "part", "seg", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    return ordered.select("conv_id", "formatted", "loss_spans").mapInArrow(batches, schema)
