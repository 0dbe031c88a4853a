"""Fast ids of a lower-casing BPE vocabulary with word ends: distinct words once, whole batches of words per call.

The vocabulary drops white space and never joins words, so a text's ids are its words' ids in order. A word of plain
Latin characters goes through the same merge ranks in one compiled call for many words; any other word (other scripts,
combining marks, added tokens) goes through the tokenizers library itself. Tests hold both against the library.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import regex

CACHE_WORDS = 150_000  # of each worker, to save time only
END = b"\x01"  # stands for the word end in the merge ranks; not a plain character


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec["added_tokens"]}
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        ids: dict[bytes, int] = {}
        for piece, i in sorted(spec["model"]["vocab"].items(), key=lambda kv: kv[1]):
            if piece not in added:
                ends = piece.endswith(suffix)
                raw = bytes(letters[c] for c in (piece[: -len(suffix)] if ends else piece))
                ids[raw + END if ends else raw] = i
        # single bytes, then a byte with its word end (one symbol in the vocabulary), then the merges in order
        ranked = dict.fromkeys(bytes([b]) for b in range(256))
        ranked |= dict.fromkeys(k for k in ids if len(k) == 2 and k[1:] == END)
        ranked |= dict.fromkeys(ids)
        self._ids = np.array([ids.get(k, 0) for k in ranked], dtype="<u4")
        self._ends = np.array([len(k) > 1 and k.endswith(END) for k in ranked])
        self._fast = tiktoken.Encoding(
            "words", pat_str=r"[^\x01]+\x01", mergeable_ranks={k: i for i, k in enumerate(ranked)}, special_tokens={}
        )
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._parts = regex.compile(split["pattern"]["Regex"])
        self._plain = re.compile(r"[!-~¡-¬®-įı-ɏ]+")
        self._library = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        fresh: dict[bytes, bytes] = {}
        plain, parts, counts = [], [], []
        for raw in new:
            word = raw.decode("utf-8")
            if self._plain.fullmatch(word) and "<|" not in word:
                own = self._parts.findall(word.lower())
                plain.append(raw)
                parts += own
                counts.append(len(own))
            else:
                found = self._library.encode(word, add_special_tokens=False).ids
                fresh[raw] = np.array(found, dtype="<u4").tobytes()
        if parts:
            codes = np.array(self._fast.encode_ordinary("\x01".join(parts) + "\x01"))
            data = self._ids[codes].tobytes()
            last = np.flatnonzero(self._ends[codes]) + 1
            begin = 0
            for raw, end in zip(plain, last[np.cumsum(counts) - 1].tolist(), strict=True):
                fresh[raw] = data[4 * begin : 4 * end]
                begin = end
        return fresh

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text, without special tokens."""
        split = [t.split() for t in texts]
        known = self._known.get
        found = [list(map(known, ws)) for ws in split]
        new = {w for ws, ids in zip(split, found, strict=True) if None in ids for w, i in zip(ws, ids, strict=True) if i is None}
        if not new:
            return [b"".join(ids) for ids in found]
        fresh = self._learn(new)
        if len(self._known) + len(fresh) > CACHE_WORDS:
            self._known.clear()
        self._known |= fresh
        return [
            b"".join([i if i is not None else fresh[w] for w, i in zip(ws, ids, strict=True)])
            for ws, ids in zip(split, found, strict=True)
        ]


@cache
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker process; its table of words is bounded and only saves time."""
    return WordBpe(path)
