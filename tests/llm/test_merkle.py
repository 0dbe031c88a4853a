import hashlib
import zlib

import numpy as np
import pytest

from sitebag.llm import merkle
from sitebag.llm.queries import ORACLES, op11_merkle_manifest

from .conftest import SCHEMA


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([sha("".join(d[i : i + 3])) for i in range(0, len(d), 3)])
    return levels


def plain_rows(docs):
    """The contract's rows, from rows (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in docs:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf, _ in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            digest, proof = plain_leaf((*r[:4], text)), ""
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    left, right = "".join(run[: at % 3]), "".join(run[at % 3 + 1 :])
                    digest, proof, at = sha(left + digest + right), proof + left + right, at // 3
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, sha(proof), digest, digest == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def corpus():
    rows = []
    for source, n in [("a", 1), ("b", 2), ("B", 3), (None, 4), ("", 10), ("é", 27), ("z" * 40, 28), ("hot", 130)]:
        rows += [(len(rows) * 7 % 1000 + len(rows), source, "en" if k % 3 else None, k if k % 4 else None, f"line {k}\nnext\n" * (k % 3)) for k in range(n)]
    rows += [(None, "a", None, None, None), (5, "a", "x", 1, "same"), (5, "a", "x", 1, "same"), (5, "a", "x", 1, "other\n"), (9, None, None, 0, "日本\n😀")]
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 200])
def test_positions_are_the_order_of_completion(n):
    log, counts = [], [n]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // 3))
    for leaf in range(n):
        log.append((0, leaf))
        for h in range(1, len(counts)):
            if (leaf + 1) % 3**h == 0 or leaf == n - 1:
                log.append((h, leaf // 3**h))
    for place, (h, i) in enumerate(log):
        assert merkle.position(h, np.array([i]), n).tolist() == [place]
    assert len(log) == sum(counts)


@pytest.mark.parametrize("span", [1, 2, 7])
def test_proofs(spark, span):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA)
    from sitebag.llm.queries import _without_breaks

    manifest = merkle.build_manifest(docs, _without_breaks(), span=span)
    want = plain_rows(rows)
    assert got_rows(merkle.proofs(manifest)) == want
    assert {True, False} == {r[-1] for r in want}
    log = merkle.append_log(manifest).collect()
    by_source = {}
    for r in log:
        by_source.setdefault((r["is_top"], r["source"]), []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in by_source.values())
    assert len(by_source[False, "hot"]) == 130 + 44 + 15 + 5 + 2 + 1


def test_unchanged_rows_verify(spark):
    docs = spark.createDataFrame([(i, f"t\n{i}", "en", "one", 3) for i in range(50)], SCHEMA)
    clash = docs.selectExpr("*", "1 as tree", "2 as chunk", "'x' as digest", "3 as idx", "'y' as path", "4 as one")
    rows = merkle.proofs(merkle.build_manifest(clash)).collect()
    assert len(rows) == 50 and all(r["verified"] and r["root"] == r["subroot"] for r in rows)


def test_empty_and_single(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op11_merkle_manifest(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(1, None, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/s/documents.parquet")
    assert got_rows(op11_merkle_manifest(spark, f"{tmp_path}/s")) == plain_rows([(1, None, None, None, None)])


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, f"a\nb{i}", "en", None if i % 9 == 0 else f"s{i % 4}", i) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(ORACLES["op11_merkle_manifest"])
    at = [[d[0] for d in cur.description].index(c) for c in COLUMNS]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)
    assert got_rows(op11_merkle_manifest(spark, str(tmp_path))) == want == plain_rows([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
