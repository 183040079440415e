"""Chat formatting by assembling tokens: segments are encoded apart and reserved ids spliced between them.

A turn becomes ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. The marks are reserved ids above the vocabulary,
so no text can produce them; so that the rendered string is unambiguous too, a control string inside a text gets a
backslash between ``<`` and ``|`` (one more if there are some already), which reading takes away again. The mask of tokens
that count in training covers the text of assistant turns; segment bounds come from prefix sums of segment lengths.

Encoding works row by row where the rows are. Only finished turns are shuffled, by conversation, and read back as a
sorted stream: one conversation of any length takes constant memory.

Defined results: null role or text is the empty string; turns with a null id form one conversation with a null id;
turns are ordered by number (null first), ties by role and the text's digest, repeated rows all stay. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archidex.llm.bpe import Vocabulary, worker_codec
from archidex.llm.common import sliced, texts_of

# The marks' strings, in the order of their reserved ids.
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
START, SEPARATOR, END = range(3)
TRAINED_ROLE = "assistant"

# A vocabulary's own special strings are escaped as well, by the same rule for everything that starts like a mark.
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(ids: np.ndarray, vocabulary: Vocabulary, decoder) -> str:
    """The formatted string of a turn's ids, marks included."""
    base, out, at = len(vocabulary.pieces), [], 0
    for place in [*np.flatnonzero(ids >= base).tolist(), len(ids)]:
        out += decoder.decode(ids[at:place], np.array([0, place - at]))
        if place < len(ids):
            out.append(MARKS[ids[place] - base])
        at = place + 1
    return "".join(out)


def format_turns(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """conv_id, turn, ``ids`` and ``loss_mask`` of each turn, plus role and text as sort keys of ties."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = worker_codec(shared.value)
        base = len(shared.value.pieces)
        mark = [np.array([base + k], dtype=np.int32) for k in range(len(MARKS))]
        for part in sliced(batches, "text"):
            ids, masks = [], []
            for role, text in zip(texts_of(part, "role"), texts_of(part, "text"), strict=True):
                words = [np.frombuffer(encoder.encode(escape(s)), dtype=np.int32) for s in (role, text)]
                segments = [mark[START], words[0], mark[SEPARATOR], words[1], mark[END]]
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
                # +1 where a trained segment begins, -1 where it ends; the running sum is the mask.
                steps = np.zeros(bounds[-1] + 1, dtype=np.int8)
                if role == TRAINED_ROLE:
                    np.add.at(steps, bounds[3], 1)
                    np.add.at(steps, bounds[4], -1)
                ids.append(np.concatenate(segments))
                masks.append(np.cumsum(steps)[:-1].astype(bool))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("conv_id"),
                    part.column("turn"),
                    part.column("role"),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(masks, pa.list_(pa.bool_())),
                    part.column("tie"),
                ],
                ["conv_id", "turn", "role", "ids", "loss_mask", "tie"],
            )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    wanted = rows.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("tie"))
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, ids array<int>, loss_mask array<boolean>, tie string"
    return wanted.mapInArrow(run, schema)


class _Conversation:
    """Running digests of the conversation being read."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, vocabulary: Vocabulary, decoder) -> None:
        marks = np.flatnonzero(ids >= len(vocabulary.pieces))
        start, separator, end = marks.tolist()
        role, text = (
            unescape(decoder.decode(ids[a + 1 : b], np.array([0, b - a - 1]))[0])
            for a, b in ((start, separator), (separator, end))
        )
        trained = ids[mask]
        loss = unescape(decoder.decode(trained, np.array([0, len(trained)]))[0])
        self.turns += 1
        self.chars += len(render(ids, vocabulary, decoder))
        self.loss_chars += len(loss)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())


def read_back(formatted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per conversation, from the ids and masks alone: turns, digests of turns and of trained text, lengths."""
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = worker_codec(shared.value)
        current, state, done = None, None, []

        def finished() -> tuple:
            return (current, state.turns, state.all.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars)

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            conv = batch.column("conv_id").to_pylist()
            for i, c in enumerate(conv):
                if state is None or c != current:
                    if state is not None:
                        done.append(finished())
                    current, state = c, _Conversation()
                ids = batch.column("ids")[i].values.to_numpy()
                mask = batch.column("loss_mask")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                state.add(ids, mask, shared.value, decoder)
            if done:
                yield out()
                done.clear()
        if state is not None:
            done.append(finished())
            yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
