"""Jaccard join, components, passages: against brute force and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from sitebag.llm import jaccard
from sitebag.llm.graph import components
from sitebag.llm.jaccard import jaccard_components
from sitebag.llm.passages import align, chains, collinear_chains, repeated_passages, without_passages
from sitebag.llm.textbatch import shingle_sets, words

from .conftest import SCHEMA, edited, prose


def brute_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in low.replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, percent=75):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {k: min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i, k in enumerate(ids)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    label = {}
    for a, b in edges:
        for n in (a, b):
            label.setdefault(n, n)
    for a, b in edges:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {n: new if x == old else x for n, x in label.items()}
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lonely = {n for n in label if n not in got}
    assert all(label[n] == n for n in lonely)
    smallest = {}
    for n, x in label.items():
        smallest[x] = min(smallest.get(x, n), n)
    assert got == {n: smallest[label[n]] for n in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("texts", ["mixed", "odd", "group"])
def test_jaccard(make, odd_texts, texts):
    if texts == "odd":
        texts = odd_texts
    elif texts == "mixed":
        base = [prose(i, 60 + 10 * i) for i in range(12)]
        texts = base + [edited(t, k) for t, k in zip(base, [4, 9, 15, 19, 25, 30, 36, 40, 45, 50, 60, 70], strict=True)]
        texts += [t.upper() for t in base[:3]] + [prose(1, 4), prose(1, 4), "a b c", "A  b\tc"]
    else:  # one base and many different near copies: wide columns, links only through each other
        base = prose(77, 120).split(" ")
        rng = random.Random(8)
        texts = []
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
            texts.append(" ".join(w))
    ids = [7 * i + 3 for i in range(len(texts))]
    sets = brute_sets(texts)
    rows = jaccard_components(make(texts, ids).withColumn("component_id", F.lit("clash")), sketch_bits=12).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {k: len(s) for k, s in zip(ids, sets, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(ids, sets)


def test_columns_meet_whatever_the_batches():
    """A wide column whose kept rows are far larger than its first usable one, in every split into two or three batches."""
    import pyarrow as pa

    from sitebag.llm.jaccard import THIN, _meet_in_columns

    names = ["hash", "set_id", "n", "hot"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    signed = [100, 130, 165, 190] + [-200] * (THIN + 12) + [210, -215, 230]
    rows = [(1, 900, 5)] + [(2, i, n) for i, n in enumerate(signed)] + [(2, 700, 400), (2, 701, 500), (3, 902, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array([*c], k) for c, k in zip((*zip(*rows, strict=True), [False] * len(rows)), kinds, strict=True)], names)

    def connected(parts):
        label = {r[1]: r[1] for r in rows}
        for out in _meet_in_columns(75)(iter(parts)):
            for r in out.to_pylist():
                a, b = label[r["a"]], label[r["b"]]
                label = {k: a if v == b else v for k, v in label.items()}
        groups = {}
        for k, v in label.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    whole = connected([batch])
    assert [0, 1, 2, 3] == [i for i in whole[0] if i < 4] and THIN + 16 in whole[0]
    for i in range(1, batch.num_rows):
        assert connected([batch.slice(0, i), batch.slice(i)]) == whole
        for j in range(i, batch.num_rows, 9):
            assert connected([batch.slice(0, i), batch.slice(i, j - i), batch.slice(j)]) == whole


@pytest.mark.parametrize("block", [1, 7])
def test_large_components_are_cut_by_size(make, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    base = prose(7, 400).split(" ")
    texts = [" ".join(base[:n]) for n in range(60, 400, 17)] + [prose(90 + i, 100) for i in range(5)] + [" ".join(base[:77])] * 3
    rows = jaccard_components(make(texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(range(len(texts)), brute_sets(texts))


def test_jaccard_edges(spark, make):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    same = prose(5, 50)
    rows = jaccard_components(make([same, same, same, None], [9, 9, None, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 9), (9, 9), (9, 9)]


def test_shingles_are_whole():
    text = prose(9, 3000)
    got = shingle_sets(words([text.encode(), b"", b"a b c d e", b"A b C d e"]))
    assert [len(s) for s in got] == [len(brute_sets([text])[0]), 0, 1, 1]
    assert (got[2] == got[3]).all()


def best_chain(pos, other, k=6, gap=0.2):
    best = [float(k)] * len(pos)
    for i in range(len(pos)):
        for j in range(i):
            if pos[j] < pos[i] and other[j] < other[i]:
                best[i] = max(best[i], best[j] + k - gap * (pos[i] - pos[j] + other[i] - other[j]))
    return max(best)


def test_chains_reach_the_best_score():
    rng = random.Random(2)
    for _ in range(200):
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 25))})
        pos, other = [p for p, _ in pairs], [q for _, q in pairs]
        found = chains(pos, other)
        assert sorted(i for c in found for i in c) == list(range(len(pos)))
        c = found[0]
        score = 6 * len(c) - 0.2 * sum(pos[b] - pos[a] + other[b] - other[a] for a, b in zip(c, c[1:], strict=False))
        assert abs(score - best_chain(pos, other)) < 1e-9
        assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:], strict=False))


def test_collinear_chains_are_the_chains():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        pairs = []
        for _ in range(rng.randrange(1, 6)):
            p, q, pp, qq = 0, rng.randrange(50), [], []
            for _ in range(rng.randrange(1, 12)):
                d = rng.choice([1, 2, 5, 12, 14, 15, 16, 40, 90])
                p, q = p + d, q + (d if rng.random() < 0.7 else rng.choice([1, 3, 14, 60]))
                pp.append(p)
                qq.append(q)
            pairs.append((pp, qq))
        begin = np.cumsum([0] + [len(a) for a, _ in pairs])[:-1]
        want = [[m + b for m in c] for (pp, qq), b in zip(pairs, begin.tolist(), strict=True) for c in chains(pp, qq)]
        p, q = (np.array(sum((x[i] for x in pairs), [])) for i in (0, 1))
        b, e = collinear_chains(p, q, begin)
        assert sorted(want) == [list(range(x, y)) for x, y in zip(b.tolist(), e.tolist(), strict=True)]


def test_one_diagonal_at_once_equals_one_by_one():
    import numpy as np
    import pyarrow as pa

    from sitebag.llm.passages import MATCH, _align_rows, _laid_along, _passages

    rng, rows, want = np.random.default_rng(4), [], []
    for i in range(60):
        a = rng.integers(1, 50, 180).astype("<u4")
        b = np.concatenate([rng.integers(1, 50, rng.integers(0, 40)), a[20:150], rng.integers(1, 50, 30)]).astype("<u4")
        b[rng.integers(0, len(b), rng.integers(0, 40))] = 99
        shift = len(b) - 160 - 20
        p0, q0 = int(rng.integers(0, 9)), int(rng.integers(0, 9))
        x = [60 + p0, 90 + p0]
        y = [60 + shift + q0, 90 + shift + (i % 5 == 0) + q0]
        j, same = _laid_along(a, b, [v - p0 for v in x], [v - q0 for v in y])
        want += [(i, 100 + i, s + p0, e + p0, int(j[s]) + q0, int(j[e - 1]) + 1 + q0, n) for s, e, n in _passages(same, 50, 80)]
        rows.append((i, 100 + i, x, y, p0, q0, a.tobytes(), b.tobytes()))
    names = ["doc_id", "other_id", "anchors", "other_anchors", "begin", "other_begin", "codes", "other_codes"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    parts = [batch.slice(0, 7), batch.slice(7, 31), batch.slice(38)]
    got = [tuple(r.values()) for b in _align_rows(50, 80)(iter(parts)) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_texts_of_one_doc_id(make):
    shared = prose(70, 80)
    texts = [f"{prose(71, 20)} {shared}", prose(72, 90), f"{prose(73, 30)} {shared} {prose(74, 9)}", f"{prose(73, 30)} {shared} {prose(74, 9)}", prose(75, 200)]
    docs = make(texts, [1, 2, 3, 3, 3]).selectExpr("*", "1 as _doc", "2 as _spans", "3 as _bounds", "4 as _id", "5 as _row", "6 as _least", "7 as part")
    found = repeated_passages(docs)
    rows = without_passages(docs, found).collect()
    assert [c for c in rows[0].asDict()] == docs.columns and all(r["_doc"] == 1 and r["_row"] == 5 for r in rows)
    kept = sorted(r["text"] for r in rows if r["doc_id"] == 3)
    if found.count():  # the repeated text has the smaller hash
        assert len(kept) == 3 and texts[4] in kept and sum(shared in t for t in kept) == 0
    else:
        assert kept == sorted(texts[2:])
    assert {r["text"] for r in rows if r["doc_id"] in (1, 2)} == set(texts[:2])


def test_align_finds_a_shifted_passage():
    import numpy as np

    body = list(range(100, 180))
    a = np.array([1, 2, 3, *body[:40], 999, *body[40:], 5, 6], dtype=np.uint32)
    b = np.array([7, *body, 8, 9], dtype=np.uint32)
    s, e, t, u, n = align(a, b, [10, 60], [8, 57])
    assert (s, e, t, u, n) == (3, 84, 1, 81, 80)


def test_passages(make, odd_texts, spark):
    shared, fuzzy = prose(50, 70), prose(51, 90)
    texts = [f"{prose(10 + i, 100)} {shared} {prose(30 + i, 60)}" for i in range(4)]
    texts += [f"{prose(60, 40)} {fuzzy} {prose(61, 40)}", f"{prose(62, 80)} {edited(fuzzy, 23)}", prose(63, 300), prose(64, 300), *odd_texts[:4]]
    docs = make(texts)
    found = repeated_passages(docs)
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 5}
    assert all(r["other_id"] < r["doc_id"] for r in rows)
    for r in rows:
        own = texts[r["doc_id"]].split(" ")[r["start_word"] : r["end_word"]]
        assert 50 <= len(own) and r["equal_words"] >= 0.8 * len(own)
    exact = [r for r in rows if r["doc_id"] == 2]
    assert exact and all(shared in " ".join(texts[2].split(" ")[r["start_word"] : r["end_word"]]) and r["end_word"] - r["start_word"] <= 73 for r in exact)
    cut = {r["doc_id"]: r for r in without_passages(docs, found).collect()}
    assert shared not in cut[2]["text"] and 0 <= 160 - len(cut[2]["text"].split(" ")) <= 3 and cut[2]["n_chars"] == len(cut[2]["text"])
    assert cut[0]["text"] == texts[0] and cut[6]["text"] == texts[6] and cut[8]["text"] is None
    assert len(cut) == len(texts)
    whole = make([shared, shared, prose(70, 90)])
    assert sorted(r["doc_id"] for r in without_passages(whole, repeated_passages(whole)).collect()) == [0, 2]
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeated_passages(make([shared, shared], [4, 4])).count() == 0


def test_passages_of_one_chain_are_all_reported(make):
    """Unequal words between repeats split a passage; runs that fail the share of equal words are split, not dropped."""
    halves = [prose(80, 200), prose(81, 200)]
    seven = [prose(90 + i, 200) for i in range(7)]
    texts = [f"{halves[0]} {prose(82, 80)} {halves[1]}", f"{halves[0]} {prose(83, 80)} {halves[1]}"]
    texts += [" ".join(f"{part} {prose(1000 * k + i, 60)}" for i, part in enumerate(seven)) for k in (1, 2)]
    covered = {1: set(), 3: set()}
    for r in repeated_passages(make(texts)).collect():
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        assert r["equal_words"] >= 0.8 * (r["end_word"] - r["start_word"])
    assert {*range(200), *range(280, 480)} <= covered[1]
    assert {i for k in range(7) for i in range(260 * k, 260 * k + 200)} <= covered[3]


def test_every_copy_of_a_passage_is_reported(make):
    """Copies after the first, and passages after a stray phrase of theirs in either document; edited copies too."""
    shared, phrase = prose(100, 70), " ".join(prose(100, 70).split(" ")[20:45])
    texts = [f"{prose(101, 90)} {shared}", f"{shared} {prose(102, 60)} {edited(shared, 30)} {prose(103, 60)} {shared}"]
    other = prose(110, 120)
    stray = " ".join(f"{' '.join(other.split(' ')[i : i + 30])} {prose(111 + i, 20)}" for i in (0, 30, 60, 90))
    texts += [f"{stray} {other}", f"{prose(120, 30)} {other}", f"{phrase} {prose(121, 30)} {phrase} {prose(122, 40)} {shared}"]
    covered = {i: set() for i in range(5)}
    for r in repeated_passages(make(texts)).collect():
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert {*range(70), *range(130, 198), *range(260, 330)} <= covered[1]
    assert set(range(30, 150)) <= covered[3]
    assert set(range(120, 190)) <= covered[4]


def test_places_meet_across_batches():
    import numpy as np
    import pyarrow as pa

    from sitebag.llm.passages import _meet_blocks

    rng = random.Random(7)
    rows = sorted({(rng.randrange(4), rng.randrange(6), rng.randrange(9)) for _ in range(120)})
    want = set()
    for h, d, p in rows:
        docs = sorted({x[1] for x in rows if x[0] == h and x[1] < d})
        want |= {(d, e, p, q) for e in {*docs[:1], *docs[-1:]} for g, f, q in rows if (g, f) == (h, e)}
    for size in (1, 3, 10, 200):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows[i : i + size], strict=True)], ["hash", "doc_id", "pos"])
            for i in range(0, len(rows), size)
        ]
        found = [tuple(r.values()) for b in _meet_blocks(iter(batches)) for r in b.to_pylist()]
        assert set(found) == want


def test_a_passage_whose_parts_have_other_first_holders_is_reported(make):
    """Documents with parts of a passage stand first and just before each that holds all of it."""
    for seed in (200, 210, 220):
        passage = prose(seed, 70)
        w = passage.split(" ")
        texts = []
        for i, own in enumerate([w[:40], w[30:], w, w[:40], w[30:], w]):
            texts.append(f"{prose(seed + 300 + i, 40)} {' '.join(own)} {prose(seed + 400 + i, 40)}")
        rows = repeated_passages(make(texts)).collect()
        own = [r for r in rows if r["doc_id"] == 5]
        assert set(range(40, 110)) <= {i for r in own for i in range(r["start_word"], r["end_word"])}
        for r in rows:
            a, b = texts[r["doc_id"]].split(" "), texts[r["other_id"]].split(" ")
            assert r["other_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
            if r["equal_words"] == r["end_word"] - r["start_word"]:
                assert a[r["start_word"] : r["end_word"]] == b[r["other_start"] : r["other_end"]]


def nearly_equal_with_one_source(seed, change):
    """Documents with parts of a passage stand first and just before the one that holds all of it, changed here and there."""
    w = prose(seed, 72).split(" ")
    parts = [w[:26], w[22:50], w[46:]]
    own = [*parts, w, *parts, change(list(w))]
    return [f"{prose(seed + 300 + i, 40)} {' '.join(x)} {prose(seed + 400 + i, 40)}" for i, x in enumerate(own)]


def replaced(w):
    for i in (11, 33, 57):
        w[i] = f"other{i}"
    return w


def test_a_nearly_equal_passage_meets_every_holder(make):
    changes = {"replaced": replaced, "longer": lambda w: [*w[:36], "more", *w[36:]], "shorter": lambda w: [*w[:20], "swapped", *w[21:35], *w[37:]]}
    for name, change in changes.items():
        for seed in (500, 510, 520):
            texts = nearly_equal_with_one_source(seed, change)
            rows = [r for r in repeated_passages(make(texts)).collect() if r["doc_id"] == 7]
            n = len(change(prose(seed, 72).split(" ")))
            covered = {i - 40 for r in rows for i in range(r["start_word"], r["end_word"])}
            assert set(range(2, n - 2)) <= covered, (name, seed, sorted(covered))
            for r in rows:
                assert r["other_id"] == 3 and r["equal_words"] >= 0.8 * (r["end_word"] - r["start_word"]) >= 40


def test_places_of_a_seed_in_blocks_meet(make, monkeypatch):
    """Frequent seeds are cut into blocks; no pair of blocks is left out."""
    from sitebag.llm import passages

    monkeypatch.setattr(passages, "BLOCK_PLACES", 2)
    texts = nearly_equal_with_one_source(530, replaced)
    w = prose(530, 72).split(" ")
    more = [f"{prose(900 + i, 40)} {' '.join(w[a : a + 28])} {prose(950 + i, 40)}" for i, a in enumerate((0, 22, 44, 10, 34))]
    texts = [*texts[:4], *more, *texts[4:]]
    rows = [r for r in repeated_passages(make(texts)).collect() if r["doc_id"] == len(texts) - 1]
    assert set(range(42, 110)) <= {i for r in rows for i in range(r["start_word"], r["end_word"])} and {r["other_id"] for r in rows} == {3}


def test_a_nearly_equal_passage_among_many_places(make):
    """A seed stands more often in both documents than all its places meet in the first pass."""
    w = prose(600, 60).split(" ")
    phrase = " ".join(w[20:40])
    one = " ".join(f"{prose(700 + i, 12)} {phrase}" for i in range(30))
    two = " ".join(f"{prose(800 + i, 12)} {phrase}" for i in range(30))
    v = list(w)
    v[8] = v[50] = "other"
    texts = [f"{prose(601, 9)} {phrase} {prose(602, 40)}", f"{one} {' '.join(w)} {prose(603, 20)}", f"{prose(604, 20)} {' '.join(v)} {two}"]
    rows = [r for r in repeated_passages(make(texts)).collect() if r["doc_id"] == 2]
    assert set(range(22, 78)) <= {i for r in rows for i in range(r["start_word"], r["end_word"])}


def places_of_one_seed(n, m, fragment, changed, seed=3):
    """Open places and earlier ones of a seed amid a fragment of a common text, some of them with words changed in it."""
    import numpy as np

    from sitebag.llm.passages import MARGIN, SIDE, K

    rng = np.random.default_rng(seed)
    common = rng.integers(2, 1 << 16, SIDE)
    rows = rng.integers(2, 1 << 16, (n + m, SIDE))
    for r in range(n + m):
        left = rng.integers(0, fragment - K)
        low, high = max(0, MARGIN - left), min(SIDE, MARGIN - left + fragment)
        rows[r, low:high] = common[low:high]
        if r % 100 < changed:
            for t in rng.integers(0, SIDE, 3):
                if not MARGIN <= t < MARGIN + K:
                    rows[r, t] = 2 + r % 60_000
    return rows[:n].astype("<u2"), rows[n:].astype("<u2")


def test_pairs_with_one_common_run_are_not_compared_one_by_one():
    import numpy as np

    from sitebag.llm.passages import MARGIN, RUN, SIDE, K, _runs_apart

    def told(a, b):
        n, m = len(a), len(b)
        zero = np.zeros(n, dtype=np.int64)
        i, j, dense = _runs_apart(a, b, zero, np.zeros(m, dtype=np.int64), zero, zero + m, np.ones((n, SIDE), dtype=bool))
        return set(zip(i.tolist(), j.tolist(), strict=True)), set(dense.tolist())

    assert told(*places_of_one_seed(1500, 1500, 35, 0)) == (set(), set())
    a, b = places_of_one_seed(60, 300, 60, 8)
    listed, dense = told(a, b)
    assert listed
    for i in range(len(a)):
        for j in range(len(b)):
            same = a[i] == b[j]
            right = int(np.argmin(np.append(same[MARGIN + K :], False))) + MARGIN + K
            left = MARGIN - int(np.argmin(np.append(same[:MARGIN][::-1], False)))
            apart = any(same[t : t + RUN].all() for t in range(SIDE + 1 - RUN) if t + RUN <= left or t >= right)
            assert ((i, j) in listed) == (apart and i not in dense)


def test_large_groups_give_the_matches_of_all_pairs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from sitebag.llm import passages

    a, b = places_of_one_seed(400, 400, 80, 10)
    n, m = len(a), len(b)
    doc = np.concatenate([np.arange(n) + 200, np.arange(m)])
    free = np.random.default_rng(5).random((n, passages.SIDE)) < 0.3
    for i in range(n):  # the exact pass covers equal stretches of 50 words before
        for same in a[i] == b[: i + 200]:
            edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
            for s, e in edge[edge.searchsorted(49, side="right") - 1 :][:2].reshape(1, 2):
                free[i, s:e] &= e - s < 50
    free = np.packbits(free, axis=1)
    columns = [pa.array(np.full(n + m, 7)), pa.array(doc), pa.array(np.full(n + m, 50, dtype=np.int32))]
    columns += [pa.array([x.tobytes() for x in (*a, *b)], pa.binary()), pa.array([[]] * (n + m), pa.list_(pa.int32()))]
    columns += [pa.array([*(x.tobytes() for x in free), *[None] * m], pa.binary()), *[pa.array(np.zeros(n + m, dtype=np.int32))] * 2]
    batch = pa.RecordBatch.from_arrays(columns, [*passages._PLACE_NAMES, "i", "j"])

    def found():
        return [r for x in passages._meet_all(50, 80)(iter([batch])) for r in x.to_pylist()]

    some = found()
    every = lambda a, b, *_: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.arange(len(a)))
    monkeypatch.setattr(passages, "_runs_apart", every)
    assert some and some == found()
