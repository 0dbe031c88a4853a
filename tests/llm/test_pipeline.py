"""The five stages on planted cases, each held against a plain reading of its rule."""

import random

import pytest

import corpus_pipeline
from sitebag.llm.tokenizer_files import tokenizer_file
from tokenizers import Tokenizer

from .conftest import SCHEMA, edited, prose

BAD = ["grottle", "snarkey", "vilmud"]
SECRET = "token = 'Zk3pQ9xV7bR2mW8tL4cY'"


def corpus():
    rng = random.Random(9)
    texts = [prose(2000 + i, rng.randrange(60, 140)) for i in range(60)]
    toxic = [0] * 60
    for i in range(100):  # toxic and clean labelled documents
        w = prose(4000 + i, 80).split(" ")
        toxic.append(i % 2)
        if toxic[-1]:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        texts.append(" ".join(w))
    first = len(texts)
    shared = prose(9999, 70)
    texts += [texts[0], edited(texts[1], 45), f"{prose(1, 90)} {shared} {prose(2, 50)}", f"{prose(3, 40)} {shared} {prose(4, 90)}"]
    texts += [f"{prose(5, 40)} {SECRET} {prose(6, 30)}", "", None, "very " * 3 + "short"]
    return texts, toxic, first, shared


@pytest.fixture(scope="module")
def planted(make, spark, tmp_path_factory):
    texts, toxic, first, shared = corpus()
    where = str(tmp_path_factory.mktemp("corpus"))
    make(texts).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, where).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        kept.append(docs)
    return where, texts, toxic, first, shared, kept


def test_stages(planted):
    where, texts, toxic, first, shared, kept = planted
    rows = [{r["doc_id"]: r for r in k.collect()} for k in kept[:-1]]
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:-1])
    gone = set(range(len(texts))) - set(rows[0])
    assert gone <= {i for i, t in enumerate(toxic) if t} and len(gone) >= 48
    assert set(rows[0]) - set(rows[1]) == {first, first + 1}
    assert shared in rows[2][first + 2]["text"] and shared not in rows[2][first + 3]["text"]
    assert set(rows[2]) == set(rows[1])
    assert "Zk3pQ9xV7bR2mW8tL4cY" not in rows[3][first + 4]["text"] and rows[3][first + 4]["text"].startswith(prose(5, 40))
    changed = {i for i in rows[3] if rows[3][i]["text"] != texts[i]}
    assert changed == {first + 3, first + 4}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows[3].values())


def test_packing_holds_every_token(planted):
    _, texts, _, _, _, kept = planted
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    length = {}
    for r in kept[-1].collect():
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    for r in kept[-2].collect():
        assert length.pop(r["doc_id"]) == len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert not length


def test_run_equals_the_stages(planted, spark):
    where, *_, kept = planted
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, where).collect())
    assert got == sorted(tuple(r[c] for c in columns) for r in kept[-1].collect())


def test_empty_and_repeated_rows(spark, make, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    same = make([prose(1, 60)] * 3 + ["", "", None], [5, 5, None, 8, 8, None])
    rows = corpus_pipeline.drop_near_duplicates(spark, same, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 5), (False, 8), (True, 0), (True, 0)]
