"""SentencePiece encoding and decoding of merge-type (BPE) models by a table of each prefix's last token.

Merges of such a model go by score, then from the left. Hence tokens are the encoding of their text exactly if each adjacent
pair is the encoding of its own text, and each prefix of a text has one last token: the token ending there, as the
automaton of all pieces reports, that is compatible with the last token of the prefix before it. One pass fills the
table; going back from the end recovers the ids. Time grows with the length of a text, for any text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import prepare

SPACE = "▁"
LETTER = "[A-Za-z\u00c0-\u024f]"
ENDS = "\n\t"
MARKS = ",.;:!?)]}'\"*-|&%$#@/_"
#: Distinct units and pairs of tokens that a Python worker remembers: those met since it last held that many, and of units
#: also those of the time before. A bound of memory only.
KEPT_UNITS = 350_000
KEPT_PAIRS = 500_000
#: Units longer than this are encoded each time: remembering them would take memory without being of use again.
KEPT_LENGTH = 64


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with a BPE model file that takes texts as they are."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(len(model))]
        self.special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(model))]
        self.ids = {p: i for i, p in enumerate(self.names) if not self.special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(model.is_byte(i) for i in self.bytes)
        self.unknown = model.unk_id()
        self.value = {i: b for b, i in enumerate(self.bytes)} if self.fallback else {}
        self.surface = [p.replace(SPACE, " ").encode() for p in self.names]
        for i in range(len(model)):
            if model.is_control(i):
                self.surface[i] = b""
            elif model.is_unknown(i):
                self.surface[i] = model.decode([i]).encode()
        self.decimal = [str(i) for i in range(len(model))]
        self.edges: dict[str, tuple[tuple, tuple] | None] = {}
        #: For each piece, whether it is compatible with each token met before it.
        self.fits: dict[str, dict[str, bool]] = {piece: {} for piece in self.ids}
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (piece, len(piece), self.fits[piece]))
        self.automaton.make_automaton()
        # No merge crosses two characters that no piece has side by side, so texts are encoded in units that end there: before
        # spaces, around line ends, and between a letter and a mark after it.
        sides = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        apart = not any(b == SPACE and a != SPACE for a, b in sides)
        alone = re.escape("".join(c for c in ENDS if not any(c in pair for pair in sides)))
        after = re.escape("".join(c for c in MARKS if not any(b == c and re.match(LETTER, a) for a, b in sides)))
        close = f"{SPACE}*+{LETTER}++(?=[{SPACE}{alone}{after}]|$)"
        self.unit = re.compile(f"{close}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]+" if apart and alone else "(?s).+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        probes = ["a  b\n\tc ", " x ", f"{SPACE}a {SPACE}", "é ﬁ ½ 文字", "a\x00b<s></s><unk>", "hello hello  world's", "Ａ"]
        for text in probes:
            ids = model.encode(text, add_bos=False, add_eos=False)
            if self.encode(text) != ids or self.decode(ids) != model.decode(ids):
                raise ValueError("not a merge-type model that takes texts as they are")

    def _edges(self, piece: str) -> tuple[tuple, tuple] | None:
        """(score, symbol) at the left and the right end after each merge; None if it does not encode to itself."""
        symbols = list(piece)
        left, right = [(0.0, symbols[0])], [(0.0, symbols[-1])]
        while len(symbols) > 1:
            pairs = [a + b for a, b in zip(symbols, symbols[1:])]
            best = max((self.score[p] for p in pairs if p in self.score), default=None)
            if best is None:
                return None
            k = next(i for i, p in enumerate(pairs) if self.score.get(p) == best)
            symbols[k : k + 2] = [pairs[k]]
            left.append((best, symbols[0]))
            right.append((best, symbols[-1]))
        return tuple(left), tuple(right)

    def _compatible(self, a: str, b: str) -> bool:
        """Whether the text of two tokens encodes to just these: no merge across the border ever comes first."""
        for piece in (a, b):
            if piece in self.ids and piece not in self.edges:
                self.edges[piece] = self._edges(piece)
        if not self.edges[b]:  # a piece that does not encode to itself is never a token
            return False
        if a not in self.ids:  # the begin, or a character without a piece
            return True
        ends, starts = self.edges[a][1], self.edges[b][0]
        i = j = 0
        while True:
            across = self.score.get(ends[i][1] + starts[j][1])
            in_a = ends[i + 1][0] if i + 1 < len(ends) else None
            in_b = starts[j + 1][0] if j + 1 < len(starts) else None
            # Of equal scores the leftmost goes first: inside a, then across, then inside b.
            if in_a is not None and (across is None or in_a >= across) and (in_b is None or in_a >= in_b):
                i += 1
            elif across is not None and (in_b is None or across >= in_b):
                return False
            elif in_b is not None:
                j += 1
            else:
                return True

    def _pieces(self, text: str) -> list[str]:
        """The encoding of a text in pieces; a character without a piece stands for itself and merges with nothing."""
        last: list[str] = [""] * (len(text) + 1)
        if self.pairs > KEPT_PAIRS:
            self.pairs = 0
            for known in self.fits.values():
                known.clear()
        filled = 0
        for end, (piece, size, known) in self.automaton.iter(text):
            if filled > end:
                continue
            while filled < end:  # characters that end no piece
                filled += 1
                last[filled] = text[filled - 1]
            before = last[end + 1 - size]
            fits = known.get(before)
            if fits is None:
                fits = known[before] = self._compatible(before, piece)
                self.pairs += 1
            if fits:
                filled = end + 1
                last[filled] = piece
        while filled < len(text):
            filled += 1
            last[filled] = text[filled - 1]
        out = []
        at = len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        ids = array("I")
        for piece in self._pieces(unit):
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.fallback:
                ids.extend(self.bytes[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encoded(text)).cast("I").tolist()

    def encoded(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers."""
        if not text:
            return b""
        units = self.unit.findall(SPACE + text.replace(" ", SPACE))
        out = list(map(self.known.get, units))
        if None not in out:
            return b"".join(out)
        for at, ids in enumerate(out):
            if ids is not None:
                continue
            unit = units[at]
            ids = self.known.get(unit) or self.older.get(unit)
            if ids is None:
                ids = self._unit(unit)
            if len(unit) <= KEPT_LENGTH:
                if len(self.known) >= KEPT_UNITS:
                    self.older, self.known = self.known, {}
                self.known[unit] = ids
            out[at] = ids
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 come out as U+FFFD each, as in the library."""
        value, surface = self.value, self.surface
        out: list[bytes] = []
        begun = False
        k, n = 0, len(ids)
        while k < n and not begun:  # the first visible piece loses one leading space, the one that encoding adds
            piece = surface[ids[k]]
            if ids[k] in value:
                begun = True
                continue
            if not self.special[ids[k]] and piece.startswith(b" "):
                begun, piece = True, piece[1:]
            begun = begun or bool(piece)
            out.append(piece)
            k += 1
        rest = ids[k:]
        if value.keys().isdisjoint(rest):
            out.extend(map(surface.__getitem__, rest))
            return b"".join(out).decode()
        run = bytearray()
        for i in rest:
            if i in value:
                run.append(value[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            out.append(surface[i])
        out.append(_utf8(bytes(run)))
        return b"".join(out).decode()


def _utf8(run: bytes) -> bytes:
    """A run of byte tokens with every byte that belongs to no character replaced."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            part = run[at : at + size]
            try:
                part.decode()
            except UnicodeDecodeError:
                continue
            out.append(part)
            break
        else:
            size = 1
            out.append("�".encode())
        at += size
    return b"".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file; it lives as long as the Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each row; null is no ids."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    for a, b in zip(ends, ends[1:]):
        yield values[a:b].tolist()


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of each row of ``docs`` (doc_id, text): its token ids, without begin and end.

    A null or empty text has no ids. A null or repeated doc_id stays as it is: each row is encoded for itself. Other columns
    are ignored, an empty table gives none. Rows are not shuffled; a task holds one Arrow batch of texts.
    """
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            parts = [own.encoded(t.as_py() or "") for t in batch.column("text")]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = pa.array(np.frombuffer(b"".join(parts), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of each row of ``encoded`` (doc_id, ids); null ids are none, and no ids give an empty text."""
    prepare(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [own.decode(ids) for ids in id_lists(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: its ids, and the text that they decode to."""
    prepare(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for ids in id_lists(batch.column("ids")):
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                text_digest.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode_pieces(docs, model).mapInArrow(digest, schema)
