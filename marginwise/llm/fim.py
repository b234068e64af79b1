"""Fill-in-middle transformation with memoised chunks.

A text's tokens are words with the white space before them, and white space at its end. A rolling
hash cuts the text's UTF-8 bytes into chunks where its upper bits are zero, so equal passages of different texts
give equal chunks. A task remembers a summary per chunk, found by its bytes, not by its hash alone:
runs of non-space, and whether the chunk begins and ends inside one. Adding these up, less one
where two chunks share a run, counts the text's tokens and tells the chunk that holds a cut; only
there is the text searched.

Rows never leave their partition and nothing is shuffled: a lost executor costs its tasks. What a
task remembers is bounded by CACHE_BYTES.

Defined results. A NULL text is an empty one: no tokens, form plain. A NULL id hashes like an empty
string. Repeated rows give repeated results; equal texts with other ids are cut elsewhere. Texts of any length are
taken whole. Of the input only the id and text columns are read, so other columns don't clash, and an empty table gives
an empty result.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from marginwise.llm.text import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = re.compile(b"<[PSM]>")
RUN = re.compile(rb"[^\x20\x09-\x0D]+")
# A cut about every thousand bytes, within these bounds.
CUT_SHIFT, LEAST, MOST = 22, 256, 8192
CACHE_BYTES = 64 << 20
OUT_BYTES = 16 << 20


def _gear() -> np.ndarray:
    """A random number per byte value, always the same."""
    return np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = _gear()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks, the end of the text included, always between two characters."""
    size = len(data)
    if size <= LEAST:
        return [size] if size else []
    raw = np.frombuffer(data, np.uint8)
    # The hash of the last 32 bytes, older ones shifted further, from windows of 1, 2, 4, 8 and 16.
    rolled, width = GEAR[raw], 1
    while width < 32:
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = wider, 2 * width
    starts = (raw & 0xC0) != 0x80
    found = (np.flatnonzero((rolled[:-1] >> np.uint32(CUT_SHIFT) == 0) & starts[1:]) + 1).tolist()
    ends, last = [], 0
    while size - last > LEAST:
        k = bisect_left(found, last + LEAST)
        end = found[k] if k < len(found) else size
        if end > last + MOST:
            end = last + MOST
            while not starts[end]:
                end -= 1
        ends.append(end)
        last = end
    if last < size:
        ends.append(size)
    return ends


Summary = tuple[int, bool, bool]


class Chunks:
    """Summaries of chunks by their bytes: (runs, begins inside a run, ends inside one)."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[bytes, Summary] = {}
        self.held, self.limit, self.hits, self.asked = 0, limit, 0, 0

    def summary(self, chunk: bytes) -> Summary:
        self.asked += 1
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        runs = len(RUN.findall(chunk))
        found = (runs, RUN.match(chunk) is not None, RUN.match(chunk, len(chunk) - 1) is not None)
        if self.held > self.limit:
            self.known.clear()
            self.held = 0
        self.known[chunk] = found
        self.held += len(chunk) + 200
        return found


class Document:
    """A text as chunks: the number of its tokens, and where a token ends."""

    def __init__(self, data: bytes, chunks: Chunks):
        self.data, self.ends = data, chunk_ends(data)
        self.begins = [0, *self.ends[:-1]]
        self.summaries = [chunks.summary(data[b:e]) for b, e in zip(self.begins, self.ends)]
        # Runs that begin before each chunk's end.
        self.started, total, inside = [], 0, False
        for runs, begins_inside, ends_inside in self.summaries:
            total += runs - (inside and begins_inside)
            inside = ends_inside
            self.started.append(total)
        self.runs = total
        self.tokens = total + bool(data and not inside)

    def end_of(self, token: int) -> int:
        """The byte behind the first ``token`` tokens."""
        if token <= 0:
            return 0
        if token > self.runs:
            return len(self.data)
        k = bisect_left(self.started, token)
        before = self.started[k - 1] if k else 0
        joined = k > 0 and self.summaries[k - 1][2] and self.summaries[k][1]
        wanted = token - before + joined
        for number, found in enumerate(RUN.finditer(self.data, self.begins[k], self.ends[k]), 1):
            if number == wanted:
                break
        end = found.end()
        # A run that reaches the end of its chunk goes on as far as the next ones begin inside it.
        while end == self.ends[k] and k + 1 < len(self.ends) and self.summaries[k + 1][1]:
            k += 1
            end = RUN.match(self.data, self.begins[k], self.ends[k]).end()
        return end


def _draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of the seed and the id."""
    word = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(word, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80
) -> DataFrame:
    """(id, n_tokens, form, prefix_chars, middle_chars, output) of every row.

    Of 100 texts, ``rate`` are cut into prefix, middle and suffix at two tokens drawn by the id's hash, of
    these ``spm_rate`` with the suffix first. Others, empty texts and texts that hold a marker stay plain.
    """
    rows = docs.select(F.col(key).alias("id"), whole(F.col(text)).alias("text"), *_draws(F.col(key), seed))
    fields = StructType().add("id", rows.schema["id"].dataType).add("n_tokens", LongType()).add("form", StringType())
    fields = fields.add("prefix_chars", LongType()).add("middle_chars", LongType()).add("output", StringType())

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()]
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
            out, first, held = [], 0, 0
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                doc = Document(data, chunks)
                n = doc.tokens
                if not data or h3[i] % 100 >= rate or MARKERS.search(data):
                    out.append((n, "plain", None, None, data))
                else:
                    ends = sorted((int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)))
                    a, b = (doc.end_of(t) for t in ends)
                    prefix, middle, suffix = data[:a], data[a:b], data[b:]
                    spm = h4[i] % 100 < spm_rate
                    parts = (b"<S>", suffix, b"<P>", prefix) if spm else (b"<P>", prefix, b"<S>", suffix)
                    made = b"".join((*parts, b"<M>", middle))
                    out.append((n, "spm" if spm else "psm", len(prefix.decode()), len(middle.decode()), made))
                held += len(data)
                if held > OUT_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*out), kinds)]
                    columns[4] = columns[4].cast(pa.large_string()).cast(pa.string())
                    ids = batch.column("id").slice(first, len(out))
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=fields.names)
                    out, first, held = [], i + 1, 0

    return rows.mapInArrow(transform, fields)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No marker can lie across two parts, as each begins with
    the only ``<`` it has and the parts hold none."""
    parts = F.split(output, "<[PSM]>")
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
