import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sitebag.llm import simhash, spark_help

from .conftest import SCHEMA, edited, prose


def plain_fingerprint(text):
    out, words = [], []
    for c in text or "":
        if c == " " or 9 <= ord(c) <= 13:
            words.append("")
        else:
            words = words or [""]
            words[-1] += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words = [w for w in words if w]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    for bit in reversed(range(64)):
        out.append("1" if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes) else "0")
    return int("".join(out), 2)


def plain_components(prints, ids):
    """Smallest id reachable over all pairs within three bits."""
    best = list(ids)
    changed = True
    while changed:
        changed = False
        for i, j in combinations(range(len(ids)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                known = [b for b in (best[i], best[j]) if b is not None]
                low = min(known, default=None)
                if best[i] != low or best[j] != low:
                    best[i] = best[j] = low
                    changed = True
    return best


def held(df, texts, ids):
    prints = [plain_fingerprint(t) for t in texts]
    want = sorted((f"{p:016x}", -1 if i is None else i, -1 if c is None else c) for p, i, c in zip(prints, ids, plain_components(prints, ids), strict=True))
    got = sorted((r["fingerprint"], *(-1 if r[c] is None else r[c] for c in ("doc_id", "component_id"))) for r in df.collect())
    assert got == want


def test_fingerprints(odd_texts):
    for t in [*odd_texts, "A b", "A B c", "x\x0by\x0cz\x1fq w", "É é a b c", "a b c d e"]:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_long_texts_are_read_whole(monkeypatch):
    text = prose(5, 900).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_HASHES", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("distance, blocks", [(3, 6), (3, 4), (0, 1), (5, 9)])
def test_masks_miss_no_pair(distance, blocks):
    rng = random.Random(distance)
    found = [m % (1 << 64) for m in simhash.masks(distance, blocks)]
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), distance))
        assert any(not flips & m for m in found)
    with pytest.raises(ValueError):
        simhash.masks(3, 3)


def test_spanning_links_connect_what_is_close():
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(40)} | {rng.getrandbits(64) for _ in range(50)})
    a, b = simhash.spanning_links(np.array(prints, dtype=np.uint64))
    assert all((prints[i] ^ prints[j]).bit_count() <= 3 for i, j in zip(a.tolist(), b.tolist(), strict=True))
    label = list(range(len(prints)))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert label[i] != label[j]  # a forest
        label = [label[i] if x == label[j] else x for x in label]
    want = plain_components(prints, list(range(len(prints))))
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i, j in combinations(range(len(prints)), 2))


def corpus(odd_texts):
    texts = [prose(100 + i, 40 + i) for i in range(20)]
    texts += [edited(t, 35) for t in texts[:10]] + [edited(edited(t, 35), 31) for t in texts[:10]] + [texts[0].upper(), texts[1] + "\n"]
    return texts + odd_texts + ["same words here"] * 30


@pytest.mark.parametrize("rows", [4096, 5])
def test_components(make, odd_texts, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(spark_help, "HOT_ROWS", 4)
    monkeypatch.setattr(simhash, "SMALL_GROUP", 3)
    texts = corpus(odd_texts)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    held(simhash.simhash_components(make(texts, ids)), texts, ids)


def test_chain_of_close_fingerprints(spark, monkeypatch):
    """A long chain whose ends differ in many bits, and one hot value: all ends up in one class each."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    rng = random.Random(8)
    chain, far = [0x0123456789ABCDEF], [rng.getrandbits(64) for _ in range(40)]
    for k in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 3)))
    prints = sorted(set(chain + far))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    label = {p: p for p in signed}
    for a, b in simhash.near_links(df).collect():
        label = {p: label[a] if x == label[b] else x for p, x in label.items()}
    want = plain_components(prints, list(range(len(prints))))
    for i, j in combinations(range(len(prints)), 2):
        assert (label[signed[i]] == label[signed[j]]) == (want[i] == want[j])


def test_edges(spark, make):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    texts, ids = ["a b c d"] * 3 + [None, "", "z"], [7, 7, None, None, None, None]
    held(simhash.simhash_components(make(texts, ids)), texts, ids)
    clash = make([prose(1, 30), prose(1, 30)]).selectExpr("*", "1 as print", "2 as mask", "3 as component_id", "4 as fingerprint", "5 as salt")
    assert [r["component_id"] for r in simhash.simhash_components(clash).collect()] == [0, 0]
