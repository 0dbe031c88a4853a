"""Views that give the general tables the shape the operators work on.

Each view is one SQL text for Spark and for the checking engine. ``{name}`` stands for an input table or another
view; ``@G@`` is the flag that makes the checker's ``regexp_replace`` replace all matches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

LETTERS = "'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'"

VIEWS = {
    # per-read calls: prob NULL = uncalled, on a 0.1 grid
    "v_calls": """
        SELECT l_orderkey*10 + l_linenumber AS read_id, concat('c', CAST(l_partkey % 5 AS STRING)) AS contig, l_partkey AS pos,
          CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
          CASE WHEN l_returnflag <> 'N' THEN round(l_discount*100)/10e0 END AS prob FROM {lineitem}""",
    "v_gold": """
        SELECT concat('c', CAST(p_partkey % 5 AS STRING)) AS contig, p_partkey AS pos,
          CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name AS name, p_size AS support
        FROM {part} WHERE p_type = 'PROMO'""",
    "v_scored": """
        SELECT l_orderkey*10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
          least(1e0, floor(l_extendedprice/100)/1000e0) AS score, l_linestatus AS source,
          concat('r', CAST(l_suppkey % 10 AS STRING)) AS run_id, p_type AS motif
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "v_samples": """
        SELECT o_orderkey AS sample_id, CASE o_orderstatus WHEN 'F' THEN '25' WHEN 'O' THEN '50' ELSE '75' END AS ratio_label,
          CASE o_orderstatus WHEN 'F' THEN 25e-2 WHEN 'O' THEN 5e-1 ELSE 75e-2 END AS ratio, o_orderpriority AS run_id,
          c_mktsegment AS motif, concat('c', CAST(c_nationkey AS STRING)) AS contig,
          concat('c', CAST(c_nationkey AS STRING), ':', CAST(o_custkey % 40 AS STRING)) AS site_key,
          6e0 + (o_orderkey % 120)/10e0 AS mean_qscore, 8e-1 + (o_orderkey % 20)/100e0 AS mapping_coverage,
          CASE o_custkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'positive' ELSE 'unlabeled' END AS class,
          floor(o_totalprice/60)/10000e0 AS prob, CAST(o_orderkey % 97 AS INT) AS ref_len
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "v_labels": """
        SELECT d.doc_id, l.quality AS y, least(1e0, d.n_chars/20000e0) AS score, d.lang AS motif, d.source
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    # every document is a read: its letters mapped to bases, whole text
    "v_seq": f"""
        SELECT doc_id AS read_id, translate(regexp_replace(lower(text), '[^a-z]', ''@G@), {LETTERS}) AS seq, lang, source
        FROM {{documents}}""",
    # every page is a reference contig
    "v_contigs": f"""
        SELECT concat('p', CAST(page_id AS STRING)) AS contig,
          translate(regexp_replace(lower(html), '[^a-z]', ''@G@), {LETTERS}) AS ref_seq FROM {{pages}}""",
    # an alignment per read: clip, match, insertion, match, deletion, match
    "v_aligned": """
        SELECT read_id, seq, length(seq) AS n, CAST(read_id % 5 AS INT) AS clip, CAST(floor(length(seq)/3) AS INT) AS third,
          concat('p', CAST(read_id % (SELECT count(*) FROM {pages}) AS STRING)) AS contig, (read_id * 7) % 500 AS pos0,
          CAST(CASE WHEN length(seq) < 24 OR read_id % 17 = 3 THEN 4 WHEN read_id % 13 = 5 THEN 256
                    WHEN read_id % 11 = 7 THEN 2048 ELSE 0 END + CASE WHEN read_id % 2 = 1 THEN 16 ELSE 0 END AS INT) AS flag,
          CAST(read_id % 61 AS INT) AS mapq, CAST(read_id % 9 AS INT) AS nm, CAST(read_id % 19 AS INT) AS dx,
          CASE WHEN length(seq) >= 24 THEN concat(CASE WHEN read_id % 5 > 0 THEN concat(CAST(read_id % 5 AS STRING), 'S') ELSE '' END,
            CAST(CAST(floor(length(seq)/3) AS INT) AS STRING), 'M1I', CAST(CAST(floor(length(seq)/3) AS INT) AS STRING), 'M2D',
            CAST(CAST(length(seq) - read_id % 5 - 2*floor(length(seq)/3) - 1 AS INT) AS STRING), 'M') ELSE '*' END AS cigar
        FROM {v_seq}""",
    # reference sites: orders spread over contigs
    "v_sites": """
        SELECT o_orderkey AS site_id, concat('p', CAST(o_custkey % (SELECT count(*) FROM {pages}) AS STRING)) AS contig,
          CAST(floor(o_totalprice) AS BIGINT) % 2000 AS pos, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS strand
        FROM {orders}""",
    # two call sets: user and assistant text of each exchange of a conversation; system turns have no partner
    "v_side_a": f"""
        SELECT concat(CAST(conv_id AS STRING), ':', CAST(CAST(floor(turn/2) AS BIGINT) AS STRING)) AS read_id,
          translate(regexp_replace(lower(text), '[^a-z]', ''@G@), {LETTERS}) AS seq, length(text)/10e0 AS quality, turn
        FROM {{conversations}} WHERE role = 'user'""",
    "v_side_b": f"""
        SELECT concat(CAST(conv_id AS STRING), ':', CAST(CAST(floor(turn/2) AS BIGINT) AS STRING)) AS read_id,
          translate(regexp_replace(lower(text), '[^a-z]', ''@G@), {LETTERS}) AS seq, length(text)/20e0 AS quality, turn
        FROM {{conversations}} WHERE role <> 'user'""",
    # the same reads with one letter dropped from every ACG: the distance is the difference in length, all of the copy matches
    "v_side_c": "SELECT read_id, replace(seq, 'ACG', 'AG') AS seq, quality/2e0 AS quality FROM {v_side_a}",
    # the same reads called otherwise: every ACG has an N in place of its C; every second read (by length) also lost the T of GTA,
    # the others gained two N in every TTT. N equals nothing, so the best alignment's totals are the numbers of these changes
    "v_side_d": """
        SELECT read_id, CASE WHEN length(seq) % 2 = 0 THEN replace(replace(seq, 'ACG', 'ANG'), 'GTA', 'GA')
          ELSE replace(replace(seq, 'ACG', 'ANG'), 'TTT', 'TNNTT') END AS seq, quality/2e0 AS quality FROM {v_side_a}""",
    "v_signal": """
        SELECT user_id AS read_id, event_id, ts, value, event_type AS tag FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("@G@", "")
    parts = {n: load(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    return spark.sql(text, **parts)


def fasta(get, spark: SparkSession) -> str:
    """The contigs as wrapped FASTA text; its path."""
    path = stage_path(spark, "fasta")
    wrapped = F.regexp_replace("ref_seq", "(.{60})", "$1\n")
    get("v_contigs").select(F.concat(F.lit(">"), F.col("contig"), F.lit(" made from a page\n"), wrapped)).write.text(path)
    return path


def _needs(name: str, seen: list[str]) -> None:
    for n in _NAME.findall(VIEWS.get(name, "")):
        if n in VIEWS:
            _needs(n, seen)
    if name in VIEWS and name not in seen:
        seen.append(name)


def sql(body: str) -> str:
    """Checker SQL: ``body`` preceded by the views it names."""
    seen: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            _needs(name, seen)
    if not seen:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({_NAME.sub(r'\1', VIEWS[n]).replace('@G@', ", 'g'")})" for n in seen)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
