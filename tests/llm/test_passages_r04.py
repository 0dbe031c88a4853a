"""Passages: matches that travel packed, chains of many pairs at once, staged tables that go."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from sitebag.llm import passages
from sitebag.llm.passages import K, WINDOW, chains, repeated_passages
from sitebag.llm.textbatch import windows, words
from sitebag.session import staged, unstaged

from .conftest import edited, prose


def test_batches_of_few_words_have_their_minimizers():
    for n in range(1, 40):
        text = " ".join(f"w{i}" for i in range(n)).encode()
        hashes, _ = windows(words([text]), K)
        want = {i + int(np.argmin(hashes[i : i + WINDOW])) for i in range(max(1, len(hashes) - WINDOW + 1))} if len(hashes) else set()
        h, doc, pos = passages._sorted_seeds([text], np.array([7]))
        assert pos.tolist() == sorted(want)
        assert h.view(np.uint64).tolist() == hashes[sorted(want)].tolist()
        assert set(doc.tolist()) <= {7}


def test_a_short_document_alone(make):
    assert repeated_passages(make([prose(5, 11)])).count() == 0


def test_chains_of_many_pairs_are_the_chains_of_each():
    rng = random.Random(11)
    for _ in range(60):
        pairs = []
        for _ in range(rng.randrange(1, 9)):
            w = rng.choice((5, 30, 300))
            pairs.append(sorted({(rng.randrange(w), rng.randrange(w)) for _ in range(rng.randrange(1, 80))}))
        pairs.append([(i, j) for i in range(30) for j in range(30)])
        p, q = (np.array([m[k] for c in pairs for m in c], dtype=np.int32) for k in (0, 1))
        begin = np.cumsum([0, *map(len, pairs)])[:-1]
        want = [tuple(m + b for m in c) for x, b in zip(pairs, begin.tolist(), strict=True) for c in chains([m[0] for m in x], [m[1] for m in x])]
        order, size = passages.crossed_chains(p, q, begin)
        assert sorted(tuple(x.tolist()) for x in np.split(order, np.cumsum(size)[:-1])) == sorted(want)


def test_matches_travel_packed():
    """A few rows a bucket, not one a match; every match of the first and the previous holder is in them."""
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(-(1 << 62), 1 << 62, 60)[rng.integers(0, 60, 4_000)])
    doc, pos = rng.integers(-5, 40, len(h)), rng.integers(0, 500, len(h)).astype(np.int32)
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    batch = pa.RecordBatch.from_arrays([pa.array(np.array([0])), pa.array(["x"])], ["doc_id", "text"])
    packed = list(passages._seed_blocks(lambda texts, ids: (h, doc, pos), 4)(iter([batch])))
    found = pa.Table.from_batches([b for b in packed if b.column("hash").null_count])
    assert found.num_rows <= 4
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))
    want = sorted(zip(*(x.tolist() for x in passages._matches(h[new], doc[new], pos[new])), strict=True))
    assert len(want) > 20 * found.num_rows
    for diagonals in (False, True):
        got = []
        for b in passages._by_bucket(found.sort_by("bucket").to_batches(max_chunksize=1)):
            rows = list(zip(*(x.tolist() for x in passages._unpacked(b, diagonals)), strict=True))
            assert rows == sorted(rows, key=lambda r: (*r[:2], r[3] - r[2], r[2]) if diagonals else r)
            got += rows
        assert sorted(got) == want
    firsts = pa.Table.from_batches([b for b in packed if not b.column("hash").null_count])
    assert firsts.num_rows <= 4
    sent = [passages._numbers(b.column("hash"), "<i8")[0] for b in firsts.to_batches()]
    assert set(np.concatenate(sent).tolist()) == set(h.tolist())


def test_staged_tables_nobody_reads_any_more_go(make, spark, tmp_path, monkeypatch):
    def folders(name):
        monkeypatch.setattr("sitebag.session.shared_dir", lambda _: str(tmp_path / name))
        return tmp_path / name

    folder = folders("one")
    table = staged(spark.range(5), "table")
    assert table.count() == 5
    unstaged(table)
    assert not list(folder.glob("table-*"))

    shared, fuzzy = prose(250, 70), prose(251, 120)
    texts = [f"{prose(210 + i, 100)} {shared} {prose(230 + i, 60)}" for i in range(3)]
    texts += [f"{prose(260, 40)} {fuzzy} {prose(261, 40)}", f"{prose(262, 80)} {edited(fuzzy, 23)}", *[f"{prose(300 + i, 30)} {edited(shared, 17 + i)}" for i in range(3)]]
    folder: Path = folders("two")
    rows = repeated_passages(make(texts)).collect()
    assert {1, 2, 4} <= {r["doc_id"] for r in rows}
    assert list(folder.glob("passages-*"))
    left = {x.name.rsplit("-", 1)[0] for x in folder.iterdir()}
    assert not left & {"seeds", "chains", "codes", "grams", "open_rows", "places"}
