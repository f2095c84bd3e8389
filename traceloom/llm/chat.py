"""Conversations as token ids with a loss mask, assembled from separately encoded segments (operator 6).

A turn is: TURN, the id of its role (OTHER, the spelled role and ROLE_END for roles outside ROLES), the content, END. These
reserved ids lie above the tokenizer's, so no content encodes to them; control strings inside contents are also escaped
in the text, so that the rendered text reads back to the same turns. Segments stay rows, one per turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import prepare
from traceloom.session import materialise

ROLES = ("system", "user", "assistant", "tool")
LOSS_ROLE = "assistant"
CONTROLS = ("<|turn|>", "<|end|>", "<|role|>", *(f"<|{r}|>" for r in ROLES), "<|other|>")
#: Control strings of common templates, fixed values: they are escaped in contents too.
FOREIGN = "<s> </s> [INST] [/INST] <<SYS>> <</SYS>> <|im_start|> <|im_end|> <|endoftext|> <|startoftext|> <|eot_id|>".split()
ESCAPE = "\\"
# A control string with any number of escapes after its first character; escaping adds one, reading back takes one.
_CONTROL = re.compile("|".join(f"({re.escape(c[0])})({re.escape(ESCAPE)}*)({re.escape(c[1:])})" for c in (*CONTROLS, *FOREIGN)))

_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    """``text`` with an escape character inside every control string, escaped ones included; reversible."""
    return _CONTROL.sub(lambda m: (p := [g for g in m.groups() if g is not None])[0] + p[1] + ESCAPE + p[2], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: (p := [g for g in m.groups() if g is not None])[0] + p[1][1:] + p[2], text)


class Template:
    """Encodes segments and renders ids; needs a tokenizer whose decoding gives back every text (byte-level)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ids = {c: first + i for i, c in enumerate(CONTROLS)}
        self.controls = dict(zip(self.ids.values(), CONTROLS))
        self.first = first
        self.turn, self.end, self.role_end, self.other = (self.ids[c] for c in ("<|turn|>", "<|end|>", "<|role|>", "<|other|>"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)]

    def role(self, role: str) -> list[int]:
        if role in ROLES:
            return [self.ids[f"<|{role}|>"]]
        return [self.other, *self.encode([role])[0], self.role_end]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, int, str]:
        """Role, content, characters of the rendered turn, and the unescaped text under the mask."""
        values = ids.tolist()
        if values[1] == self.other:
            stop = values.index(self.role_end)
            spelled = self.decode(values[2:stop])
            role, head = unescape(spelled), len("<|other|>") + len(spelled) + len("<|role|>")
        else:
            stop, role = 1, self.controls[values[1]][2:-2]
            head = len(self.controls[values[1]])
        body = self.decode(values[stop + 1 : -1])
        loss = unescape(self.decode(ids[mask.astype(bool)].tolist()))
        return role, unescape(body), len("<|turn|>") + head + len(body) + len("<|end|>"), loss


def template(path: str) -> Template:
    if path not in _tokenizers:
        _tokenizers[path] = Template(path)
    return _tokenizers[path]


def format_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, position, ids, mask): each row of ``conversations`` as a segment of token ids.

    ``position`` orders the turns of a conversation from 0: by turn, repeated turns by role and text, nulls first.
    ``mask`` is 1 on the content of assistant turns. Null texts and roles are empty; a null conv_id is a conversation of
    its own; rows that are repeated are turns of their own; other columns are ignored.
    """
    prepare(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, turn long, role string, position long, ids array<int>, mask binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(tokenizer)
        previous, position = object(), 0
        for batch in batches:
            conv, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            contents = form.encode(batch.column("text").to_pylist())
            heads = {r: form.role(r) for r in set(roles)}
            parts, positions = [], []
            for c, role, content in zip(conv, roles, contents):
                position = position + 1 if c == previous else 0
                previous = c
                positions.append(position)
                parts.append([form.turn, *heads[role], *content, form.end])
            lengths = np.array([len(p) for p in parts])
            ends = np.cumsum(lengths)
            # +1 where a loss segment begins, -1 behind its end: the running sum is the mask.
            step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
            loss = np.array([r == LOSS_ROLE for r in roles], bool)
            begin = ends - 1 - np.array([len(c) for c in contents], np.int64)
            np.add.at(step, begin[loss], 1)
            np.add.at(step, ends[loss] - 1, -1)
            mask = np.cumsum(step)[:-1].astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "role")),
                    pa.array(positions, pa.int64()),
                    pa.array(parts, pa.list_(pa.int32())),
                    pa.array([mask[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary()),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return rows.mapInArrow(build, schema)


def turn_digests(segments: DataFrame, tokenizer: str) -> DataFrame:
    """Read formatted segments back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests run over the turns in order, so a conversation of any length is read in one pass and never held whole.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = segments.select("conv_id", "position", "ids", "mask")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(tokenizer)
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, size = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 6
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            done.clear()
            return out

        for batch in batches:
            masks = batch.column("mask").to_pylist()
            ids = batch.column("ids")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or conv != state[0]:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, size, loss = form.read(ids[i].values.to_numpy(), np.frombuffer(masks[i], np.uint8))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += size
            yield batch_of()
        close()
        yield batch_of()

    return ordered.mapInArrow(digest, schema)


def conversation_digests(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Format ``conversations``, write the segments, and read their digests back from what was written."""
    written = materialise(format_turns(conversations, tokenizer), "chat")
    return turn_digests(written, tokenizer)
