"""Piece encoding, word BPE and packing against the tokenizer libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitebag.llm import sentencepieces
from sitebag.llm.packing import best_fit, pack, pack_documents, token_pieces
from sitebag.llm.tokenizer_files import tokenizer_file
from sitebag.llm.word_bpe import word_bpe

from .conftest import SCHEMA, prose

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
ODD = ["", " ", "\n", "  two  spaces ", "tab\there\n\nlines \n end", "é ß 日本語 😀 ﬁ", "don't I'LL we've 'S", "a" * 400, "0123456789" * 9,
       "x<|endoftext|>y <|startoftext|>", "\x01\x00 control", "Σας ΣΑΣ İ ŉ ǅ ª ½ Å", "thanonnd erouble, ingthes."]


def test_pieces_equal_the_library():
    ours, library = sentencepieces.sentence_pieces(PIECES, "bpe"), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*ODD, *(prose(i, 200) for i in range(20))]
    rng = random.Random(0)
    texts += ["".join(rng.choice("abcdeth  \n.,éß-") for _ in range(60)) for _ in range(200)]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(t), t
        assert ours.decode(ids) == t


def test_unigram_is_the_best_segmentation():
    model = sentencepieces.sentence_pieces(PIECES, "unigram")
    for word in ("▁hello", "▁cats", "▁abab"):
        best = {0: (0.0, ())}
        for end in range(1, len(word) + 1):
            options = [(best[i][0] + model.score[p], (*best[i][1], p)) for i in range(end) if (p := model.ids.get(word[i:end])) is not None]
            best[end] = max(options)
        got = model.encode_word(word)
        assert sum(model.score[p] for p in got) == pytest.approx(best[len(word)][0])


def test_encode_and_decode_tables(make, odd_texts, spark):
    docs = make(odd_texts).withColumn("ids", F.lit("clash"))
    rows = {r["doc_id"]: r for r in sentencepieces.decode(sentencepieces.encode(docs, PIECES), PIECES).collect()}
    assert [rows[i]["text"] for i in range(len(odd_texts))] == [t or "" for t in odd_texts]
    assert rows[0]["n_ids"] == 0
    assert {r["doc_id"]: r["text"] for r in sentencepieces.encode(docs, PIECES, decoded=True).collect()} == {i: r["text"] for i, r in rows.items()}
    assert sentencepieces.encode(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_word_ids_equal_the_library():
    library, texts = Tokenizer.from_file(WORDS), [*ODD, *(prose(i, 300) for i in range(20))]
    for t, ids in zip(texts, word_bpe(WORDS).encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pack_documents(make, odd_texts, spark):
    docs = make(odd_texts + odd_texts[:5]).withColumn("length", F.lit("clash"))
    library = Tokenizer.from_file(WORDS)
    rows = pack_documents(docs, WORDS, 256).collect()
    check_packed(rows, 256)
    for i, t in enumerate(odd_texts + odd_texts[:5]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[s : s + 256].tobytes()) for s in range(0, len(ids), 256)]
    assert pack_documents(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    kept = token_pieces(make(["two words"]), WORDS, 64, keep_ids=True).first()
    assert zlib.crc32(kept["ids"]) == kept["ids_crc32"]


def test_tree_of_parts(spark):
    rng = random.Random(3)
    sizes = [min(100, int(rng.paretovariate(0.8) * 6) + 1) for _ in range(3000)] + [51] * 40 + [100] * 20
    pieces = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sizes)], "doc_id long, piece int, length long")
    rows = pack(pieces, 100, part_items=100, fan_in=3).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(sizes)))
    used = check_packed(rows, 100)
    whole = len(best_fit(sorted(sizes, reverse=True), 100)[2])
    assert -(-sum(sizes) // 100) <= whole <= used <= 1.03 * whole + 1


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = best_fit([60, 70, 30, 40], 100)
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 70, 60] and fill == [100, 100]
