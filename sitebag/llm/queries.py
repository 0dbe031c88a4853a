"""Registered queries of the package: thin callers of the operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, merkle, pii, quality_fm, quality_rules, secret_scan, sentencepieces, toxicity
from .fingerprints import bounded_runs, digests, entropy_ranks, likeness, to_string
from .jaccard import jaccard_components
from .neighbours import dealt_descending
from .packing import pack_documents
from .passages import repeated_passages
from .simhash import simhash_components
from .spark_help import read
from .tokenizer_files import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and CRC-32 of its ids, SHA-256 of the decoded text."""
    path = tokenizer_file("piece_bpe_32k.model")
    back = sentencepieces.encode(read(spark, sf_dir, "documents"), path, "bpe", decoded=True)
    return back.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def _edit_probe(ranks: np.ndarray):
    """Map over rows in descending order with part tails: fingerprints of each text and of its edited text."""

    def consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                if last and last[0] == row[0] and not last[1]:
                    yield last, row
                last = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bounded_runs(consecutive(batches), lambda r: len(r[0][3] or "")):
            texts = [r[0][3] or "" for r in rows]
            nexts = [r[1][3] or "" for r in rows]
            edited = []
            for text, after in zip(texts, nexts, strict=True):
                cut = len(text) // 3
                edited.append(text[: len(text) - cut] + after[:cut])
            follow = [a for a, b in zip(nexts, [*texts[1:], None], strict=True) if a != b]
            found = digests([t.encode() for t in (*texts, *edited, *follow)], ranks)
            n = len(rows)
            own, changed, extra = found[:n], found[n : 2 * n], iter(found[2 * n :])
            ahead = [own[i + 1] if i + 1 < n and nexts[i] == texts[i + 1] else next(extra) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0][2] for r in rows], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([to_string(c) for c in own]),
                    pa.array([to_string(c) for c in changed]),
                    pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, ahead, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt_descending(docs).mapInArrow(_edit_probe(entropy_ranks(docs)), schema)


@query(
    "op3_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in generate_series(1, len(ws) - 4)]) END AS s FROM w),
    item AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    pair AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_, any_value(a.n) AS nx, any_value(b.n) AS ny
      FROM item a JOIN item b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
    link AS (SELECT x, y FROM pair WHERE 100 * both_ >= 75 * (nx + ny - both_)),
    edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
    reach AS (SELECT x AS doc_id, x AS r FROM edge UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x),
    least_ AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
    SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.r, s.doc_id) AS component_id
    FROM sets s LEFT JOIN least_ l ON s.doc_id = l.doc_id""",
)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each toxicity category of every document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, read(spark, sf_dir, "labels")))


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts per kind of the base spans, their SHA-256, and all spans as text."""

    def text(column: str):
        parts = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", parts)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = read(spark, sf_dir, "documents")
    return _digest(pii.find_pii(docs, pii.train(docs)), pii.KINDS)


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality_fm.score_quality(docs, quality_fm.train_quality(docs, read(spark, sf_dir, "labels")))


@query("op8_secret_scans")
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = read(spark, sf_dir, "documents")
    return _digest(secret_scan.find_secrets(docs, secret_scan.thresholds(docs)), secret_scan.KINDS)


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has too, equal or nearly."""
    return repeated_passages(read(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rules and the n-gram model's verdict on every document."""
    docs = read(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train_rules(docs, read(spark, sf_dir, "labels")))


@query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the smallest doc_id that links of at most three bits reach."""
    return simhash_components(read(spark, sf_dir, "documents"))


@query(
    "op11_merkle_manifest",
    r"""
    WITH RECURSIVE step AS (
      SELECT n, n AS c, 0 AS k FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), 255)) AS n)
      UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
    crc AS (SELECT n, c FROM step WHERE k = 8),
    digit AS (
      SELECT doc_id, 4294967295 AS c, CAST(doc_id AS VARCHAR) AS s FROM documents
      UNION ALL SELECT d.doc_id, xor(d.c // 256, crc.c), substr(d.s, 2) FROM digit d JOIN crc ON crc.n = xor(d.c % 256, ascii(d.s)) WHERE d.s <> ''),
    even AS (SELECT DISTINCT doc_id FROM digit WHERE s = '' AND c % 2 = 1),
    field AS (
      SELECT doc_id, source, concat(
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
        text, CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
    leaf AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS probe FROM field),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
      FROM leaf),
    up AS (
      SELECT coalesce('s' || source, 'n') AS tree, 0 AS h, i, n, leaf AS d FROM placed
      UNION ALL SELECT tree, h + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, h, i // 3),
    sub AS (SELECT tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
    upper_ AS (
      SELECT 0 AS h, i, n, d FROM sub
      UNION ALL SELECT h + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM upper_ WHERE n > 1 GROUP BY h, i // 3),
    node AS (SELECT tree, h, i, n, d FROM up WHERE n > 1 UNION ALL SELECT NULL, h, i, n, d FROM upper_ WHERE n > 1),
    sibling AS (
      SELECT tree, h, i, n,
        coalesce(string_agg(d, '') OVER (PARTITION BY tree, h, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') OVER (PARTITION BY tree, h, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
      FROM node),
    low AS (
      SELECT doc_id, leaf, coalesce('s' || source, 'n') AS tree, 0 AS h, i, n, probe AS d, '' AS proof FROM placed
      UNION ALL SELECT w.doc_id, w.leaf, w.tree, w.h + 1, w.i // 3, (w.n + 2) // 3, sha256(s.l || w.d || s.r), w.proof || s.l || s.r
      FROM low w JOIN sibling s ON s.tree = w.tree AND s.h = w.h AND s.i = w.i WHERE w.n > 1),
    high AS (
      SELECT w.doc_id, w.leaf, s.d AS subroot, 0 AS h, s.i, s.n, w.d, w.proof FROM low w JOIN sub s ON s.tree = w.tree WHERE w.n = 1
      UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.h + 1, w.i // 3, (w.n + 2) // 3, sha256(s.l || w.d || s.r), w.proof || s.l || s.r
      FROM high w JOIN sibling s ON s.tree IS NULL AND s.h = w.h AND s.i = w.i WHERE w.n > 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
    FROM high, (SELECT d AS root FROM upper_ WHERE n = 1) WHERE n = 1""",
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded with a text whose line feeds are gone where the CRC-32 of doc_id is even."""
    return merkle.proofs(merkle.build_manifest(read(spark, sf_dir, "documents"), changed=_without_breaks()))


def _without_breaks():
    is_even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(is_even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@query(
    "op12_filter_audit",
    r"""
    WITH w AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 50 AS a, 100 * list_unique(ws) < 65 * len(ws) AS b,
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
        coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (
      SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS o FROM x x1, x x2, x x3, x x4, x x5
      WHERE len(list_distinct([x1.x, x2.x, x3.x, x4.x, x5.x])) = 5),
    s AS (SELECT o, step, substr(o, step, 1) AS own FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (
      SELECT part, o, step, own, n, good, toxic, (a::INT + b::INT + c::INT + d::INT + e::INT) AS fails,
        CASE own WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS mine,
        least(CASE WHEN a THEN strpos(o, 'A') ELSE 9 END, CASE WHEN b THEN strpos(o, 'B') ELSE 9 END, CASE WHEN c THEN strpos(o, 'C') ELSE 9 END,
          CASE WHEN d THEN strpos(o, 'D') ELSE 9 END, CASE WHEN e THEN strpos(o, 'E') ELSE 9 END) AS gone
      FROM m, s),
    g AS (
      SELECT part, o AS filter_order, CAST(step AS INT) AS step, own, CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN mine AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN mine AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM r GROUP BY ALL)
    SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g""",
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters under all orders, per source: kept, removed, redundant, lost and Shapley counts."""
    return filter_audit.audit_filters(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))
