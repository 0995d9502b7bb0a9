"""Chat formatting at the level of tokens.

A conversation becomes <|im_start|>role\\ntext<|im_end|>\\n for each of its turns. Roles and texts are
encoded as segments of their own and the reserved ids are spliced between them, so nothing that a text
says can become a control token; besides, control strings within it are escaped, reversibly. The loss
mask is the prefix sum of +1 where a trained segment begins and -1 after it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder, load
from .textkit import int_lists


@dataclass(frozen=True)
class Chat:
    vocabulary: str = VOCABULARY
    #: Roles whose text, with its end token, is trained on.
    trained: tuple[str, ...] = ("assistant",)
    #: Reserved ids lie behind the vocabulary: its size is left to the end of text.
    controls: tuple[str, ...] = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")


def escape(text: str, controls: tuple[str, ...] = Chat.controls) -> str:
    """Control strings get a backslash behind their <, and those that have some get one more."""
    inner = "|".join(regex.escape(c[1:]) for c in controls)
    return regex.sub(rf"<(\\*)({inner})", r"<\\\1\2", text)


def unescape(text: str, controls: tuple[str, ...] = Chat.controls) -> str:
    inner = "|".join(regex.escape(c[1:]) for c in controls)
    return regex.sub(rf"<\\(\\*)({inner})", r"<\1\2", text)


def assemble(conversations: list[list[tuple[str, str]]], encode, size: int, config: Chat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids and mask of all conversations one after the other, and where each begins."""
    start, end = size + 1, size + 2
    segments, turns, trained = ["\n"], [], []
    for talk in conversations:
        turns.append(len(talk))
        for role, text in talk:
            segments += [role + "\n", escape(text, config.controls)]
            trained.append(role in config.trained)
    ids, begin = encode(segments)
    newline = ids[: begin[1]]
    ids, begin = ids[begin[1] :], begin[1:] - begin[1]
    head, body = begin[1::2] - begin[:-1:2], begin[2::2] - begin[1::2]
    n_line = len(newline)
    first = np.concatenate([[0], np.cumsum(1 + head + body + 1 + n_line)])  # places of the turns
    out = np.empty(first[-1], np.int32)
    out[first[:-1]] = start
    place = np.repeat(first[:-1] + 1 - begin[:-1:2], head + body) + np.arange(len(ids))
    out[place] = ids
    ends = first[:-1] + 1 + head + body
    out[ends] = end
    for i in range(n_line):
        out[ends + 1 + i] = newline[i]
    edge = np.zeros(len(out) + 1, np.int64)
    on = np.array(trained, bool)
    np.add.at(edge, (first[:-1] + 1 + head)[on], 1)
    np.add.at(edge, ends[on] + 1, -1)
    return out, np.cumsum(edge[:-1]).astype(np.int8), first[np.concatenate([[0], np.cumsum(turns)])]


def formatted(conversations: DataFrame, config: Chat = Chat()) -> DataFrame:
    """(conv_id, n_turns, n_tokens, tokens, loss_mask), one row for each conv_id.

    Turns are in order of turn (nulls first), then role, then text; repeated turns stay. A null text is
    empty, a null role is "unknown" and not trained on. Rows with null conv_id are one conversation. An
    empty table gives no rows; columns but conv_id, turn, role and text are ignored.
    """
    shared = conversations.sparkSession.sparkContext.broadcast(load(config.vocabulary))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    talks = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        own = encoder(shared, config.vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                talk = [list(zip(r, t, strict=True)) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                ids, mask, begin = assemble(talk, own, len(own.vocabulary.tokens), config)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in talk], pa.int64()), pa.array(np.diff(begin), pa.int64()), int_lists(ids, begin, pa.int32()), int_lists(mask, begin, pa.int8())],
                    names=["conv_id", "n_turns", "n_tokens", "tokens", "loss_mask"],
                )

    return talks.mapInArrow(run, "conv_id long, n_turns long, n_tokens long, tokens array<int>, loss_mask array<tinyint>")
