"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass of dynamic programming.

The automaton reads each character once; at every position the output links list the pieces that end there, longest
first, and relax the state of the position. For unigram models the state is the best score (Viterbi). For BPE models a
prefix has exactly one encoding, and the piece that ends it is the one whose pairing with the last piece before it is
what the merges give for the two together; so the same pass gives the merges' result without simulating them.

No piece continues past a word start, so text is cut there and distinct words are encoded once per worker.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import chunks, text_bytes

SPACE = "▁"  # the piece alphabet's sign for a space
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 450_000  # of each worker; encodings kept to save time, never for the result
CACHE_PAIRS = 300_000
NONE = -1


class Automaton:
    """Aho-Corasick over strings: ``step`` per state, and per state the ids of all patterns that end there, longest first."""

    def __init__(self, patterns: dict[str, int]):
        self.step: list[dict[str, int]] = [{}]
        own: list[int | None] = [None]
        for text, i in patterns.items():
            state = 0
            for c in text:
                nxt = self.step[state].get(c)
                if nxt is None:
                    nxt = self.step[state][c] = len(self.step)
                    self.step.append({})
                    own.append(None)
                state = nxt
            own[state] = i
        self.fail = [0] * len(self.step)
        self.ends: list[tuple[int, ...]] = [()] * len(self.step)
        queue = deque(self.step[0].values())
        for state in queue:
            self.ends[state] = (own[state],) if own[state] is not None else ()
        while queue:
            state = queue.popleft()
            for c, nxt in self.step[state].items():
                back = self.fail[state]
                while back and c not in self.step[back]:
                    back = self.fail[back]
                self.fail[nxt] = self.step[back].get(c, 0)
                self.ends[nxt] = ((own[nxt],) if own[nxt] is not None else ()) + self.ends[self.fail[nxt]]
                queue.append(nxt)

    def advance(self, state: int, c: str) -> int:
        step = self.step
        while True:
            nxt = step[state].get(c)
            if nxt is not None:
                return nxt
            if not state:
                return 0
            state = self.fail[state]


class _Learned(dict):
    """Words and their ids; a new word is encoded when it is first looked up."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._encode(word)
        return ids


class SentencePieces:
    """Pieces and scores of a model file. ``kind`` is "unigram" or "bpe"."""

    def __init__(self, path: str, kind: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        self.kind = kind
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.piece[i]: i for i in normal}
        self.length = [len(p) for p in self.piece]
        self.byte_id = {int(self.piece[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.floor = min((self.score[i] for i in normal), default=0.0) - UNKNOWN_PENALTY
        self.raw = [b"" if model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        for value, i in self.byte_id.items():
            self.raw[i] = bytes([value])
        self.raw[self.unknown] = " ⁇ ".encode()
        self._pairs: dict[tuple[int, int], bool] = {}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._cut = None if crossing else re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._by_line = self._cut is not None and not any("\n" in p for p in self.ids)
        self._spaced = _Learned(lambda w: self._bytes(SPACE + w))
        self._bare = _Learned(self._bytes)

    @cached_property
    def automaton(self) -> Automaton:
        """Over the pieces that an encoding can have; a decoder never builds it."""
        usable = self.ids
        if self.kind == "bpe":
            usable = {p: i for p, i in self.ids.items() if len(p) == 1 or self._merge(p) == [i]}
        return Automaton(usable)

    def _merge(self, text: str) -> list[int]:
        """The merges as they are defined: always the adjacent pair with the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joined = self.ids.get(parts[i] + parts[i + 1])
                if joined is not None and (best is None or self.score[joined] > best):
                    best, at = self.score[joined], i
            if at < 0:
                return [self.ids.get(p, NONE) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, left: int, right: int) -> bool:
        if len(self._pairs) > CACHE_PAIRS:
            self._pairs.clear()
        fits = self._pairs[left, right] = self._merge(self.piece[left] + self.piece[right]) == [left, right]
        return fits

    def _relax_bpe(self, text: str) -> list[int]:
        step, fail, ends, length = self.automaton.step, self.automaton.fail, self.automaton.ends, self.length
        pairs, last, state, i = self._pairs, [NONE], 0, 0
        for c in text:
            i += 1
            nxt = step[state].get(c)
            while nxt is None and state:
                state = fail[state]
                nxt = step[state].get(c)
            state = nxt or 0
            for piece in ends[state]:
                before = last[i - length[piece]]
                if before == NONE:
                    break
                fits = pairs.get((before, piece))
                if fits or (fits is None and self._may_follow(before, piece)):
                    break
            else:
                piece = NONE
            last.append(piece)
        return last

    def _relax_unigram(self, text: str) -> list[int]:
        last = [NONE] * (len(text) + 1)
        best = [0.0] + [float("-inf")] * len(text)
        state, advance, ends, length, score = 0, self.automaton.advance, self.automaton.ends, self.length, self.score
        for i, c in enumerate(text, 1):
            state = advance(state, c)
            best[i], single = best[i - 1] + self.floor, False
            for piece in reversed(ends[state]):  # shorter pieces first; only a strictly better one replaces
                size = length[piece]
                value = best[i - size] + score[piece]
                if value > best[i] or (size == 1 and not single):
                    best[i], last[i] = value, piece
                single = single or size == 1
        return last

    def encode_word(self, text: str) -> list[int]:
        last = self._relax_bpe(text) if self.kind == "bpe" else self._relax_unigram(text)
        out: list[int] = []
        i = len(text)
        while i:
            piece = last[i]
            if piece != NONE:
                out.append(piece)
                i -= self.length[piece]
            else:
                i -= 1
                if self.byte_id:
                    out += [self.byte_id[b] for b in reversed(text[i].encode())]
                elif not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
        return out[::-1]

    def _bytes(self, text: str) -> bytes:
        return array("i", self.encode_word(text)).tobytes() if text else b""

    def _segments(self, marked: str) -> bytes:
        """Ids of text whose spaces are marked, cut only where no piece can reach across."""
        out = []
        for w in self._cut.findall(marked) if self._cut else [marked]:
            out.append(self._bytes(w))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts."""
        if not self._by_line:
            return [self._segments(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts]
        spaced, bare = self._spaced, self._bare
        if len(spaced) + len(bare) > CACHE_WORDS:
            spaced.clear()
            bare.clear()
        newline = self._bytes("\n")
        get = spaced.__getitem__
        out = []
        for text in texts:
            parts = []
            for i, line in enumerate(text.split("\n")):
                if "  " in line or (not i and line[:1] == " "):
                    parts.append(self._segments((SPACE if not i else "") + line.replace(" ", SPACE)))
                elif not i:
                    parts.append(b"".join(map(get, line.split(" "))))
                else:
                    first, *words = line.split(" ")
                    parts.append(bare[first] + b"".join(map(get, words)))
            out.append(newline.join(parts) if text else b"")
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        text = raw.decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


@cache
def sentence_pieces(path: str, kind: str) -> SentencePieces:
    return SentencePieces(path, kind)


def encode(
    docs: DataFrame, model_path: str, kind: str = "bpe", column: str = "text", key: str = "doc_id", decoded: bool = False
) -> DataFrame:
    """``key, ids, n_ids`` per row: ids as binary, little-endian 32-bit. Null or empty text has no ids.

    Unknown characters fall back to byte pieces where the model has them, else to the unknown piece. ``decoded`` adds what
    the ids decode to as ``text``, in the same pass and worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentence_pieces(model_path, kind)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids = model.encode([t.decode("utf-8") for t in texts])
                n = pa.array([len(i) // 4 for i in ids], pa.int64())
                arrays = [part.column("key"), pa.array(ids, pa.binary()), n]
                if decoded:
                    arrays.append(pa.array([model.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["key", "ids", "n_ids", "text"][: len(arrays)])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    schema = "key long, ids binary, n_ids long" + ", text string" * decoded
    return out.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, model_path: str, kind: str = "bpe", key: str = "doc_id") -> DataFrame:
    """``key, ids, n_ids, text``: the text of each row's ids; null ids are empty. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentence_pieces(model_path, kind)
        for batch in batches:
            ids = text_bytes(batch.column("ids"))
            texts = pa.array([model.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["key", "ids", "n_ids", "text"])

    rows = encoded.select(F.col(key).alias("key"), "ids", "n_ids")
    return rows.mapInArrow(run, "key long, ids binary, n_ids long, text string").withColumnRenamed("key", key)
