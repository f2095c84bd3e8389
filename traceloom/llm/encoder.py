"""Token ids of many texts with a public tokenizer file, for tokenizers that drop white space."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa

from traceloom.llm.common import Words, raw_bytes, slices

#: Distinct words kept per Python worker; at this size the store starts anew. A bound of memory, not of the words.
KEPT_WORDS = 300_000
_encoders: dict[str, WordEncoder] = {}

# Lower-case letters below U+0250 that normalisation leaves alone: runs of them reach the model unchanged.
_LETTERS = "".join(
    c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c and unicodedata.normalize("NFC", c) == c
)
_PLAIN = re.compile(rf"[{_LETTERS}]+")


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file; it lives as long as the Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class WordEncoder:
    """Encodes whole texts exactly as the tokenizer does, calling it once for each distinct word.

    Right for tokenizers that lower-case, split at white space and between letters and punctuation, and drop white
    space, so that the ids of a text are those of its words one after another (checked when it starts). ASCII white
    space is split at here; any other is left to the tokenizer. Runs of lower-case Latin letters go straight to the
    tokenizer's model, which is what the tokenizer does with them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.comma, self.stop = self._ids(",")[0], self._ids(".")[0]
        parts = ["ab", "c,d", "e.", "über!?", "ñó|", "x***"]
        if self._ids(" Ab\t" + "\n".join(parts[1:])) != [i for p in parts for i in self._ids(p)] or any(
            self._word(p) != self._ids(p) for p in parts
        ):
            raise ValueError("this tokenizer's ids depend on white space or case")
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin, self.length = array("I"), array("q"), array("q")

    def _word(self, text: str) -> list[int]:
        if text.isascii() and text.isalpha() and text.islower():
            return [t.id for t in self.model.tokenize(text)]
        if _PLAIN.fullmatch(text):
            return [t.id for t in self.model.tokenize(text.translate(self.spelled))]
        return self._ids(text)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Lower-casing could turn other text into a special token, so it is left out where one may stand.
        words = Words(texts, lower=b"<|" not in raw_bytes(texts)[0].tobytes())
        # A comma or full stop after a letter is a word of its own.
        last, before = words.bytes[words.ends - 1], words.bytes[words.ends - 2]
        closed = (words.ends - words.starts > 1) & (before > 96) & (before < 123)
        mark = np.where(closed & (last == 44), 1, np.where(closed & (last == 46), 2, 0))
        closed = mark > 0
        ends = words.ends - closed
        codes, uniques = pd.factorize(words.hash(ends))
        keys = uniques.tolist()
        if len(self.known) > KEPT_WORDS:
            self._reset()
        known = self.known
        index = [known.get(k, -1) for k in keys]
        missing = [i for i, x in enumerate(index) if x < 0]
        if missing:
            first = np.empty(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            begins, stops = words.starts[first[missing]].tolist(), ends[first[missing]].tolist()
            data = words.bytes.tobytes()
            for i, a, b in zip(missing, begins, stops):
                ids = self._word(data[a:b].decode("utf-8", "replace"))
                index[i] = known[keys[i]] = len(self.begin)
                self.begin.append(len(self.flat))
                self.length.append(len(ids))
                self.flat.extend(ids)
        at = np.array(index, np.int64)[codes]
        lengths = np.frombuffer(self.length, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        stops = np.cumsum(lengths + closed)
        total = int(stops[-1]) if len(stops) else 0
        ids = np.zeros(total, np.uint32)
        if total and len(self.flat):
            filled = np.ones(total, bool)
            filled[stops[closed] - 1] = False
            begins = np.frombuffer(self.begin, np.int64)[at]
            shift = np.repeat(begins - np.cumsum(lengths) + lengths, lengths)
            ids[filled] = np.frombuffer(self.flat, np.uint32)[shift + np.arange(len(shift))]
        ids[stops[closed] - 1] = np.array([0, self.comma, self.stop], np.uint32)[mark[closed]]
        return ids, np.append(0, stops)[words.at]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text (null: of an empty text), ``end_id`` after each if given."""
        out: list[np.ndarray] = []
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for _, part in slices(texts):
            ids, bounds = self._encode(part)
            out.extend(np.concatenate((ids[a:b], tail)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return out
