import random
from collections import Counter
from itertools import permutations

import pytest

from sitebag.llm import filter_audit as audit
from sitebag.llm.queries import ORACLES, op12_filter_audit

from .conftest import SCHEMA, prose

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int"


def plain_words(text):
    out = [""]
    for c in text:
        if c == " " or 9 <= ord(c) <= 13:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def plain_report(rows, labels):
    """The contract read literally: rows (doc_id, text, source), labels {doc_id: (quality, toxic)}."""
    fails = []
    for doc, text, source in rows:
        t = text or ""
        words = plain_words(t)
        found = set()
        if len(words) < 50:
            found.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            found.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            found.add("C")
        if any(c in "#$%&*|" for c in t):
            found.add("D")
        if doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in rows):
            found.add("E")
        fails.append((source or "", found, *labels.get(doc, (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            everyone = left
            for step, name in enumerate(order, 1):
                removed = [f for f in left if name in f[1]]
                after = [f for f in left if name not in f[1]]
                redundant = sum(name in f[1] for f in everyone) - len(removed)
                unique = sum(f[1] == {name} for f in everyone)
                out[part, "".join(order), step] = [len(after), len(removed), redundant, unique, sum(f[2] == 1 for f in removed), sum(f[3] == 1 for f in removed)]
                shapley[name] += len(removed)
                left = after
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def got_report(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in rows}
    assert len(out) == len(rows)
    return out


def corpus():
    rng = random.Random(4)
    texts = [prose(i, rng.randrange(30, 90)) for i in range(25)]
    texts += ["Loud WORDS here " * 20, prose(3, 60) + " #", "same " * 80, None, "", "É" * 30 + " A", " a\x0bb\x1fc " * 30, prose(7, 60).upper()]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(160)]
    rng.shuffle(rows)
    rows += [rows[0], (rows[1][0], rows[1][1], "c"), (None, texts[0], "a"), (None, texts[0], None), (None, None, "b")]
    labels = {i: (rng.randrange(2), rng.randrange(2)) for i in range(0, 160, 2)}
    return rows, labels


def written(spark, where, rows, files):
    for k in range(files):
        part = [(d, t, "en", s, None) for d, t, s in rows[k::files]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/documents.parquet")


@pytest.mark.parametrize("files", [1, 6])
def test_report(spark, tmp_path, files):
    rows, labels = corpus()
    written(spark, str(tmp_path), rows, files)
    given = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(0, 0, 0), (None, 1, 1), (1000, 1, 1)], LABELS)
    want = plain_report(rows, labels)
    assert got_report(audit.audit_filters(spark, f"{tmp_path}/documents.parquet", given, batches=files)) == want
    assert len(want) == 600 * len({s or "" for *_, s in rows})


def test_retractions_do_not_depend_on_arrival(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30) or None, rng.choice("ab"), rng.choice([b"x", b"y"]), 3) for _ in range(60)]
    kinds = {i: rng.randrange(4) for i in range(20)}
    labels = spark.createDataFrame(list(kinds.items()), "doc_id long, kind int")
    least = {k: min(r[0] for r in rows if r[0] and r[2] == k) for k in (b"x", b"y")}
    want = Counter()
    for i, part, key, mask in rows:
        kind = kinds.get(i, 0)
        for n, weight in enumerate((1, kind & 1, kind >> 1)):
            want[part, mask if i in (None, least[key]) else mask | audit.COPY, n] += weight
    for _ in range(2):
        rng.shuffle(rows)
        state, total = spark.createDataFrame([], audit.STATE), Counter()
        for at in range(0, 60, 20):
            arrived = spark.createDataFrame(rows[at : at + 20], "doc_id long, part string, key binary, mask int")
            after = audit.merged(state, audit.combined(arrived, labels))
            for r in audit.changes(after).collect():
                total.update({(r["part"], r["mask"], n): r[c] for n, c in enumerate(("rows", "good", "toxic"))})
            kept = after.where("first").groupBy("key", "part", "mask", "kind").agg({"least": "min", "at_least": "sum"})
            state = spark.createDataFrame(kept.toDF(*audit.STATE.replace(",", "").split()[::2]).collect(), audit.STATE)
        assert {k: n for k, n in total.items() if n} == {k: n for k, n in want.items() if n}


def test_query_and_its_sql(spark, tmp_path):
    import duckdb

    rows, labels = corpus()
    rows = [r for r in rows if r[0] is not None]
    written(spark, str(tmp_path), rows, 3)
    spark.createDataFrame([(k, *v) for k, v in labels.items()], LABELS).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(ORACLES["op12_filter_audit"])
    names = [d[0] for d in cur.description]
    sql = {tuple(r[names.index(c)] for c in ("part", "filter_order", "step")): [r[names.index(c)] for c in COLUMNS] for r in cur.fetchall()}
    assert got_report(op12_filter_audit(spark, str(tmp_path))) == sql == plain_report(rows, labels)


def test_empty_table_and_other_columns(spark, tmp_path):
    none = spark.createDataFrame([], LABELS)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e.parquet")
    assert audit.audit_filters(spark, f"{tmp_path}/e.parquet", none).count() == 0
    clash = spark.createDataFrame([(1, "x", None, None, 1)], SCHEMA).selectExpr("*", "1 as part", "2 as mask", "3 as kind", "4 as key", "5 as least")
    clash.write.parquet(f"{tmp_path}/c.parquet")
    assert got_report(audit.audit_filters(spark, f"{tmp_path}/c.parquet", none)) == plain_report([(1, "x", None)], {})


def test_table_of_one_file(spark, tmp_path):
    rows, labels = corpus()
    written(spark, str(tmp_path), rows, 1)
    one = next(tmp_path.glob("documents.parquet/part-*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one/documents.parquet").write_bytes(one.read_bytes())
    spark.createDataFrame([(k, *v) for k, v in labels.items()], LABELS).write.parquet(f"{tmp_path}/one/labels.parquet")
    assert got_report(op12_filter_audit(spark, f"{tmp_path}/one")) == plain_report(rows, labels)
