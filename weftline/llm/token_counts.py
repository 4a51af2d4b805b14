"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each character of the text;
dynamic programming carries, for each end, the best score and the number of pieces on its path, and
nothing else: neither pieces nor paths are made.

Tie rules, as the tokenizers library's unigram model has them: scores are summed in double
precision from the left; of equal scores the piece that starts first, so the longest, wins; a
character that is no piece by itself may be taken as unknown at the lowest score less 10; unknown
characters in a row are one piece, or as many as they have bytes in UTF-8 if the vocabulary has bytes.

No public unigram model is at hand here. The vocabulary used is that of piece_bpe_32k, whose pieces
and scores are read as a unigram model's; the counts are then those of that unigram model, not of its BPE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import Remembered

VOCABULARY = "piece_bpe_32k.model"
#: What stands for a space, and before the text.
MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task remembers.
CACHED_WORDS = 500_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores, without control pieces and the unknown one, of a sentencepiece model; and
    whether all bytes are among them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in usable], sum(model.is_byte(i) for i in usable) == 256


class UnigramCounter:
    """Counts the pieces of texts. pieces: piece, score."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, score in pieces:
            self.automaton.add_word(p, (len(p), float(score)))
        self.automaton.make_automaton()
        self.unknown, self.bytes = min(s for _, s in pieces) - UNKNOWN_PENALTY, byte_fallback
        known = {p for p, _ in pieces}
        # A text can be cut before a mark that follows another character, if no piece has one inside;
        # and around line feeds, if no piece has one. Sums of whole numbers don't depend on the cuts.
        inside = any(MARK in p.lstrip(MARK) for p in known)
        whole = all(float(s).is_integer() for _, s in pieces)
        self.cut = whole and not inside and MARK in known and byte_fallback and not any("\n" in p for p in known)
        self.marked = Remembered(lambda w: self.count_piece(MARK + w), CACHED_WORDS)
        self.bare = Remembered(self.count_piece, CACHED_WORDS)

    def count_piece(self, text: str) -> int:
        """By one pass of the automaton. text has marks for spaces."""
        n = len(text)
        best, pieces, unknown_end = [0.0] + [0.0] * n, [0] * (n + 1), [False] * (n + 1)
        at = 0  # characters whose ends are settled

        def unknown(end: int, score: float | None, count: int) -> tuple[float, int, bool]:
            """The better of what ends here and the last character as unknown."""
            other = best[end - 1] + self.unknown
            if score is None or other > score:
                if self.bytes:
                    return other, pieces[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass")), True
                return other, pieces[end - 1] + (not unknown_end[end - 1]), True
            return score, count, False

        ends = self.automaton.iter(text)
        match = next(ends, None)
        for end in range(1, n + 1):
            score, count, single, is_unknown = None, 0, False, False
            while match is not None and match[0] == end - 1:
                length, own = match[1]
                candidate = own + best[end - length]
                if score is None or candidate > score:  # longest first
                    score, count = candidate, pieces[end - length] + 1
                single = single or length == 1
                match = next(ends, None)
            if not single:
                score, count, is_unknown = unknown(end, score, count)
            best[end], pieces[end], unknown_end[end] = score, count, is_unknown
            at = end
        return pieces[at]

    def count(self, text: str) -> int:
        """Of a raw text; the empty one has none."""
        if not text:
            return 0
        if not self.cut:
            return self.count_piece(MARK + text.replace(" ", MARK))
        total, first = 0, True
        lines = text.split("\n")
        total += (len(lines) - 1) * self.bare["\n"] if len(lines) > 1 else 0
        for line in lines:
            words = line.split(" ")
            if MARK in line or "" in words:  # marks of the text itself, or spaces in a row
                total += self.count_runs((MARK if first else "") + line.replace(" ", MARK))
            elif first:
                total += sum(map(self.marked.__getitem__, words))
            else:
                total += self.bare[words[0]] + sum(map(self.marked.__getitem__, words[1:]))
            first = False
        return total

    def count_runs(self, line: str) -> int:
        """Of a line, cut before each mark that follows another character."""
        total, at = 0, 0
        for i in range(1, len(line)):
            if line[i] == MARK and line[i - 1] != MARK:
                total, at = total + self.bare[line[at:i]], i
        return total + self.bare[line[at:]] if line else 0


COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """One for each worker process and file."""
    if path not in COUNTERS:
        COUNTERS[path] = UnigramCounter(*read_vocabulary(path))
    return COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens for every row of docs. Null is the empty text, which has no tokens.
    Repeated rows get a row each; an empty table gives none. One pass, no shuffle."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            sizes, tokens = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                sizes.append(len(t))
                tokens.append(c.count(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(doc_id, text).mapInArrow(count, schema)
