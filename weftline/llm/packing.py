"""Packing by the dot-product heuristic of vector bin packing.

An example is a vector of demands: tokens, one segment, and loss-bearing tokens. A sequence is a bin
with a limit on each. Into the open bin goes, again and again, the example that fits and has the largest dot
product of its demands with what the bin has left, both as parts of the limits. When none fits,
documents (which may be cut freely) give a piece that fills the bin exactly; instruction
examples (which may not) close it.

Each task packs the rows of its own partition, in one pass and with a pool of bounded size, so nothing is
shuffled, and a lost task packs the same rows alike again. What is left at a partition's end goes into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Remembered, public_tokenizer

#: Limits of a sequence of instruction examples: tokens, segments, loss-bearing tokens. Documents have the first one only.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 64, 1536
#: The id that ends a document.
END_ID = 1
#: Examples that wait in a task's pool; more of them find better fits and cost more time.
POOL = 512
#: Distinct words whose ids a task remembers.
CACHED_WORDS = 250_000

TOKENIZER = "word_bpe_49k.json"



class WordEncoder:
    """ids of a text, as the tokenizers library gives them, through a cache of words.

    It holds for byte-level BPE tokenizers that drop white space, never let a token cross it, put text in lower case and NFC, and split a
    letter from the full stop or comma after it, as word_bpe_49k does: a text's ids are then those of its
    white-space separated words one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Remembered(self.word, CACHED_WORDS)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}  # byte-level alphabet
        self.marks = {mark: self.whole(mark) for mark in ".,"}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def stem(self, word: str) -> bytes:
        """A word or its part before a final full stop or comma. Latin letters only: their lower case and NFC
        are plain, and no rule of the pre-tokenizer cuts them, so the model is asked directly."""
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return self.whole(word)

    def word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters only, as most words are
            return self.stem(raw.lower().decode())
        if raw[-1:] in (b".", b",") and raw[:-1].isalpha():
            return self.stem(raw[:-1].lower().decode()) + self.marks[raw[-1:].decode()]
        word, last = raw.decode(), ""
        if word[-1] in ".," and word[-2:-1].isalpha() and word[-2] <= "\xff":
            word, last = word[:-1], word[-1]
        if word.isalpha() and max(word) <= "\xff":
            word = word.lower()
        return self.stem(word) + self.marks[last] if last else self.stem(word)

    def ids(self, text: bytes) -> bytes:
        """32-bit ids of a text in UTF-8. bytes.split() cuts at ASCII white space only."""
        return b"".join(map(self.words.__getitem__, text.split()))


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


@dataclass
class Piece:
    """Of one example: what its bin holds of it."""

    example: int
    start: int
    length: int
    bin: int
    offset: int


class Packer:
    """Bins for examples that arrive one by one. done() yields closed bins' pieces when the pool is full."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, pool: int = POOL, cut: bool = True):
        self.limits = np.array([tokens, segments, loss], float)
        self.room, self.segments, self.loss_room, self.pool, self.cut = tokens, segments, loss, pool, cut
        most = 2 * pool + tokens + 2
        self.size, self.loss = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.who: list[tuple[int, int]] = [(0, 0)] * most  # example, start
        self.n, self.bins, self.waiting = 0, 0, 0

    def add(self, example: int, size: int, loss: int | None = None) -> Iterator[Piece]:
        """loss is the loss-bearing part of size, all of it if not given; a cut needs it to be all."""
        start = 0
        if self.cut:
            most = min(self.room, self.loss_room)
            while size - start >= most:  # full bins
                yield Piece(example, start, most, self.bins, 0)
                self.bins, start = self.bins + 1, start + most
            loss = None
        elif size > self.room or (loss or 0) > self.loss_room:
            raise ValueError(f"an example of {size} tokens, {loss} with loss, is above the limits")
        if size > start:
            self.size[self.n], self.loss[self.n], self.who[self.n] = size - start, size - start if loss is None else loss, (example, start)
            self.waiting += size - start
            self.n += 1
        while self.n >= 2 * self.pool and self.waiting >= self.room:  # else the pool can't fill a bin
            yield from self.fill(self.limits)
        return

    def take(self, i: int, length: int, bin: int, offset: int) -> Piece:
        """A piece of pool entry i; what is left of it stays."""
        example, start = self.who[i]
        self.waiting -= length
        if length == self.size[i]:
            self.n -= 1
            self.size[i], self.loss[i], self.who[i] = self.size[self.n], self.loss[self.n], self.who[self.n]
        else:
            self.size[i], self.loss[i], self.who[i] = self.size[i] - length, self.loss[i] - length, (example, start + length)
        return Piece(example, start, length, bin, offset)

    def fill(self, limits: np.ndarray) -> Iterator[Piece]:
        """One bin from the pool."""
        room, segments, loss, offset, bin = int(limits[0]), int(limits[1]), int(limits[2]), 0, self.bins
        self.bins += 1
        while self.n and room > 0 and segments > 0:
            size, bearing = self.size[: self.n], self.loss[: self.n]
            score = size * (room / limits[0] ** 2) + bearing * (loss / max(1.0, limits[2]) ** 2) + segments / limits[1] ** 2
            score = np.where((size <= room) & (bearing <= loss), score, -1.0)
            best = int(score.argmax())
            if segments == 1 and self.cut and size[best] < min(room, loss) and (size.max() > size[best]):
                best, score[best] = int(size.argmax()), -1.0  # the last segment should fill the bin
            if score[best] < 0:
                if not self.cut:
                    break
                best = int(size.argmax())
                bears = length = min(room, loss, int(size[best]))
                if length <= 0:
                    break
            else:
                length, bears = int(size[best]), int(bearing[best])
            yield self.take(best, length, bin, offset)
            room, segments, loss, offset = room - length, segments - 1, loss - bears, offset + length

    def finish(self) -> Iterator[Piece]:
        """The rest: full bins, then, where cuts are free, bins of falling powers of two."""
        while self.n:
            left = int(self.size[: self.n].sum())
            most = min(self.room, self.loss_room)
            if not self.cut or left >= most or most & (most - 1):
                yield from self.fill(self.limits)
            else:
                yield from self.fill(np.array([1 << (left.bit_length() - 1), self.limits[1], self.limits[2]], float))


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, max_segments: int | None = None, max_loss: int | None = None, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ids (array of int) if with_ids.

    A document is its ids and end_id; null is the empty text, which is end_id alone. Every token bears
    loss; segments and loss-bearing tokens have no limit of their own if none is given. Repeated rows are packed each; documents longer than a sequence fill whole ones. An empty
    table gives no pieces. tokenizer is a file's path, the same on all machines.
    """
    kind = docs.schema[doc_id].dataType
    limits = tuple(max_tokens if x is None else x for x in (max_tokens, max_segments, max_loss))
    columns = [("doc_id", kind), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    columns += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField(*c) for c in columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, enc = to_arrow_schema(schema), encoder(tokenizer)
        end, first = array("I", [end_id]).tobytes(), TaskContext.get().partitionId() << 36
        packer = Packer(*limits)
        held: dict[int, list] = {}  # example -> id, its ids' bytes, ids not yet placed
        rows: list[tuple] = []

        def placed(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                own = held[p.example]
                raw = own[1][4 * p.start : 4 * (p.start + p.length)]
                row = (own[0], p.start, p.length, zlib.crc32(raw), len(own[1]) // 4, first + p.bin, p.offset)
                rows.append((*row, np.frombuffer(raw, np.uint32).astype(np.int32)) if with_ids else row)
                own[2] -= p.length
                if not own[2]:
                    del held[p.example]

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
            rows.clear()
            return made

        n = 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
                raw = enc.ids(t.as_py() or b"") + end
                held[n] = [i.as_py(), raw, len(raw) // 4]
                placed(packer.add(n, len(raw) // 4))
                n += 1
                if len(rows) >= 5000:
                    yield out()
        placed(packer.finish())
        if rows:
            yield out()

    return docs.select(doc_id, text).mapInArrow(pack, schema)


def conversation_sizes(turns: DataFrame, tokenizer: str, conversation: str = "conv_id", role: str = "role", text: str = "text", bearing: str = "assistant") -> DataFrame:
    """example_id, tokens, loss_tokens: of each conversation, its turns' ids with an end id each, and those of the
    turns of the role that bears loss. Null is the empty text; the null conversation is one."""
    kind = turns.schema[conversation].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            sizes = [len(enc.ids(t.as_py() or b"")) // 4 + 1 for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["example_id", "bears", "n"])

    bears = F.coalesce(F.col(role) == bearing, F.lit(False))
    counted = turns.select(conversation, bears.alias("bears"), text).mapInArrow(count, f"example_id {kind}, bears boolean, n long")
    return counted.groupBy("example_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss_tokens"))


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, example_id: str = "example_id", tokens: str = "tokens", loss: str = "loss_tokens") -> DataFrame:
    """Instruction examples, which are never cut: example_id, tokens, loss_tokens, sequence_id, offset.

    Counts that are null are 0; an example of no tokens gets no place and no row. One that
    is above a limit alone can't be placed whole: its sequence_id and offset are null.
    """
    schema = T.StructType([T.StructField("example_id", examples.schema[example_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("tokens", "loss_tokens", "sequence_id", "offset")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, first = to_arrow_schema(schema), TaskContext.get().partitionId() << 36
        packer, held, n, unplaced = Packer(max_tokens, max_segments, max_loss, cut=False), {}, 0, []

        def made(pieces: list[Piece]) -> pa.RecordBatch:
            rows = [(*held.pop(p.example), first + p.bin, p.offset) for p in pieces]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

        for b in batches:
            for i, size, bears in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (size or 0) > max_tokens or (bears or 0) > max_loss:
                    unplaced.append((i, size, bears or 0, None, None))
                    continue
                held[n] = (i, size or 0, bears or 0)
                if pieces := list(packer.add(n, size or 0, bears or 0)):
                    yield made(pieces)
                n += 1
            if unplaced:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*unplaced, strict=True), arrow.types, strict=True)], schema=arrow)
                unplaced.clear()
        if pieces := list(packer.finish()):
            yield made(pieces)

    return examples.select(example_id, tokens, loss).mapInArrow(pack, schema)
