"""SentencePiece encoding and decoding with byte offsets.

The text is normalised here, by longest-prefix matches in the model's compiled character map, and
every byte of the normalised text remembers the source byte it came from. The pieces of the
normalised text come from the library's merges; a running sum of their lengths, sent back through
that alignment, gives the bytes of the original text under each piece.

No piece of such a vocabulary goes on behind the start of a word, so words are merged independently,
each distinct word once per task and memory limit. Vocabularies with other pieces are encoded text
by text. Rows never leave their partition, and nothing is shuffled.

Edge cases: a NULL text is an empty one, with no pieces; columns that bear the name of an output
column are replaced; an empty table gives an empty result.
"""

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

MARK = "▁"
MARK_BYTES = MARK.encode()
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
CHUNK_CHARS = 2_000_000
CACHE_CHARS = 6_000_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol buffer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie of source strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.targets = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest source string that starts at ``at``, and its length."""
        units, found = self.units, None

        def step(node: int) -> int:
            return node ^ ((units[node] >> 10) << ((units[node] & 512) >> 6))

        node = step(0)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            leaf = units[node] >> 8 & 1
            node = step(node)
            if leaf:
                found = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        return self.targets[found[0] : self.targets.index(b"\0", found[0])], found[1]


class Normalizer:
    """Text -> (normalised bytes, source byte of each of them and of the end)."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = MARK_BYTES if escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int32)
        if self.map.units or self.squeeze:
            return self.by_prefix(data)
        # Nothing is mapped or dropped: only spaces change their length.
        head = self.space if self.dummy_prefix else b""
        width = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1)
        source = np.repeat(np.arange(len(data), dtype=np.int32), width)
        source = np.concatenate([np.zeros(len(head), np.int32), source, np.array([len(data)], np.int32)])
        return head + data.replace(b" ", self.space), source

    def text(self, data: bytes) -> str:
        """The normalised text alone."""
        if data and not (self.map.units or self.squeeze):
            return ((self.space if self.dummy_prefix else b"") + data.replace(b" ", self.space)).decode()
        return self(data)[0].decode()

    def by_prefix(self, data: bytes) -> tuple[bytes, np.ndarray]:
        pieces, at = [], 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map.units else None
            if found is None:
                size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = (data[at : at + size], size)
            pieces.append((found[0], at))
            at += found[1]
        end = len(data)
        if self.squeeze:
            while pieces and pieces[0][0] == b" ":
                pieces.pop(0)
            if not pieces:
                return b"", np.array([end], np.int32)
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += self.space
            source += [pieces[0][1]] * len(self.space)
        after_space = self.squeeze
        for piece, begin in pieces:
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", self.space)
                out += shown
                source += [begin] * len(shown)
                after_space = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(self.space):
                end = source[len(out) - len(self.space)]
                del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), np.array([*source, end], np.int32)


class Encoder:
    """A model with its normaliser taken apart from its merges."""

    def __init__(self, model: bytes):
        pieces, blob = [], b""
        dummy_prefix = squeeze = escape = True
        for number, value in fields(model):
            if number == 1:
                piece = {1: b"", 3: 1} | dict(fields(value))
                pieces.append((piece[1].decode(), piece[3]))
            elif number == 3:
                spec = {2: blob, 3: dummy_prefix, 4: squeeze, 5: escape} | dict(fields(value))
                blob, dummy_prefix, squeeze, escape = spec[2], bool(spec[3]), bool(spec[4]), bool(spec[5])
        if not any(kind == 6 for _, kind in pieces):
            raise ValueError("offsets need a model with byte fallback")
        self.normalizer = Normalizer(blob, dummy_prefix, squeeze, escape)
        self.full = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Fields that come later win: an empty map, no prefix, no squeezing, no escapes.
        self.core = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        # Types: 1 normal, 4 user-defined, 6 a byte.
        self.width = np.array([1 if kind == 6 else len(piece.encode()) for piece, kind in pieces], np.int64)
        self.by_word = all(MARK not in piece.lstrip(MARK) for piece, kind in pieces) and not any(k == 4 for _, k in pieces)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.counts, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def words(self, text: str) -> list[str]:
        if not self.by_word:
            return [text] if text else []
        if MARK + MARK not in text and text.startswith(MARK) and not text.endswith(MARK):
            return [MARK + w for w in text[1:].split(MARK)]
        return WORD.findall(text)

    def merged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all normalised texts in a row, and where each text's ids end."""
        if self.chars > CACHE_CHARS:
            self.forget()
        codes, bounds, known = [], [0], len(self.codes)
        put = self.codes.setdefault
        for text in texts:
            codes += [put(w, len(self.codes)) for w in self.words(text)]
            bounds.append(len(codes))
        new = list(islice(self.codes, known, None))
        found = self.core.encode(new, num_threads=1) if new else []
        self.chars += sum(map(len, new))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        self.counts = np.concatenate([self.counts, np.fromiter(map(len, found), np.int64, len(found))])
        code = np.array(codes, np.int64)
        count = self.counts[code]
        upto = np.concatenate([[0], np.cumsum(count)])
        first = np.cumsum(self.counts)[code] - count
        return self.flat[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])], upto[bounds]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.merged([self.normalizer.text(t.encode()) for t in texts])
        return np.split(ids, ends[1:-1])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids, and the first and the end byte of the source under each piece."""
        normal = [self.normalizer(t.encode()) for t in texts]
        ids, ends = self.merged([data.decode() for data, _ in normal])
        out = []
        for own, (_, source) in zip(np.split(ids, ends[1:-1]), normal):
            at = source[np.concatenate([[0], np.cumsum(self.width[own])])]
            out.append((own, at[:-1], at[1:]))
        return out


OUTPUT = (
    StructType()
    .add("ids", ArrayType(IntegerType(), False))
    .add("begins", ArrayType(IntegerType(), False))
    .add("ends", ArrayType(IntegerType(), False))
    .add("decoded", StringType())
)


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32))


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the byte spans ``begins`` and ``ends`` of the pieces, and the ``decoded`` text.

    ``model_path`` is read on the driver and travels with the tasks.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kept = [f for f in docs.schema.fields if f.name not in OUTPUT.names]
    text_at = docs.columns.index(text_col)
    keep_at = [k for k, f in enumerate(docs.schema.fields) if f.name not in OUTPUT.names]
    names = [f.name for f in kept] + OUTPUT.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            begin, chars, texts = 0, 0, []
            for row, value in enumerate(batch.column(text_at)):
                texts.append(value.as_py() or "")
                chars += len(texts[-1])
                if chars < CHUNK_CHARS and row + 1 < batch.num_rows:
                    continue
                found = encoder.encode(texts)
                decoded = encoder.full.decode([ids.tolist() for ids, _, _ in found], num_threads=1)
                part = batch.slice(begin, row + 1 - begin)
                added = [lists([f[k] for f in found]) for k in range(3)] + [pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep_at] + added, names=names)
                begin, chars, texts = row + 1, 0, []

    return docs.mapInArrow(run, StructType(kept + OUTPUT.fields))


def default_model() -> str:
    """The public vocabulary file that is installed beside the library."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("piece_bpe_32k.model"))
