"""Delimited inputs: manifests, trusted sites, result trees, epoch histories; and report output."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _first_line(spark: SparkSession, path: str, skip: str = r"^\s*(#|$)") -> str:
    """First line that is neither blank nor a comment: reads one row, not the file."""
    rows = spark.read.text(path).where(~F.col("value").rlike(skip)).take(1)
    if not rows:
        raise ValueError(f"no data in {path}")
    return rows[0]["value"]


def _delimiter(line: str) -> str:
    return "\t" if line.count("\t") >= line.count(",") else ","


def _read_ordered(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Header table of strings plus ``_order``, which follows the order of lines in the file."""
    reader = spark.read.option("header", True).option("sep", _delimiter(header)).option("comment", "#")
    df = reader.csv(path)
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_order"),
    )


def _pick(columns: Sequence[str], names: Sequence[str], norm=lambda s: s.strip().lower()) -> list[str]:
    """Columns that carry one of ``names``, in the order of ``names``."""
    lookup = {norm(c): c for c in columns}
    return [lookup[norm(n)] for n in names if norm(n) in lookup]


def split_ids(c: Column) -> Column:
    """Ids separated by commas or semicolons; blanks are dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def read_manifest(
    spark: SparkSession,
    path: str,
    aliases: Mapping[str, Sequence[str]],
    key: str,
    list_cols: Sequence[str] = (),
    defaults: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Tab- or comma-separated manifest with ``#`` rows and alternative header names.

    ``aliases`` maps each output column to the accepted headers; the first non-blank value wins, then the default.
    A key given twice keeps its last row. An empty manifest, or one without a required column, is an error.
    """
    raw = _read_ordered(spark, path, _first_line(spark, path))
    headers = [c for c in raw.columns if c != "_order"]
    defaults = defaults or {}
    cols = []
    for name, options in aliases.items():
        found = [F.trim(F.col(f"`{c}`")) for c in _pick(headers, options)]
        if not found and name in required:
            raise ValueError(f"{path}: none of the columns {list(options)} is present")
        values = [F.when(v != "", v) for v in found]
        value = F.coalesce(*values, F.lit(defaults.get(name)).cast("string"))
        cols.append((split_ids(value) if name in list_cols else value).alias(name))
    rows = raw.select(*cols, "_order").where(F.col(key).isNotNull())
    if rows.isEmpty():
        raise ValueError(f"no rows in manifest {path}")
    return _last_wins(rows, [key])


def _last_wins(rows: DataFrame, key: Sequence[str], order: str = "_order") -> DataFrame:
    rest = [c for c in rows.columns if c not in (*key, order)]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return out.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


# Accepted headers of site tables, in order of preference.
CONTIG_NAMES = ["chrom", "chr", "chromosome"]
POSITION_NAMES = ["position", "pos", "site", "genomicposition"]
START_NAMES = ["start", "chromstart"]
SUPPORT_NAMES = [
    "techniquenum",
    "conditionnum",
    "support",
    "score",
    "ratio",
    "modratio",
    "modificationratio",
]
NAME_NAMES = ["id", "siteid", "name"]


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def _number(c: Column) -> Column:
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def _is_int(text: str) -> bool:
    return re.fullmatch(r"[+-]?\d+", text.strip()) is not None


def read_sites(spark: SparkSession, path: str, fmt: str = "auto", ignore_strand: bool = False) -> DataFrame:
    """Trusted sites (contig, pos, strand, end, name, support) from BED (0-based) or a header table (1-based ``pos``).

    Strands other than + and - become ``.``. A site listed twice keeps its last line.
    """
    first = _first_line(spark, path, r"^\s*(#|track |browser |$)")
    if fmt == "auto":
        fields = re.split(r"\s+", first.strip())
        fmt = "bed" if len(fields) >= 3 and _is_int(fields[1]) and _is_int(fields[2]) else "table"
    if fmt == "bed":
        rows = _bed(spark, path)
    elif fmt == "table":
        rows = _site_table(spark, path, first)
    else:
        raise ValueError(f"unknown site format {fmt!r}")
    strand = F.lit(".") if ignore_strand else F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.lit("."))
    return _last_wins(rows.withColumn("strand", strand), ["contig", "pos", "strand"])


def _bed(spark: SparkSession, path: str) -> DataFrame:
    text = F.trim("value")
    lines = spark.read.text(path).select(
        F.split(text, r"\s+").alias("f"),
        F.struct(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_order"),
        (text.rlike(r"^(#|track |browser )") | (text == "")).alias("_skip"),
    )
    f = F.col("f")
    short = F.size(f) < 3
    pos, end = F.get(f, 1).cast("bigint"), F.get(f, 2).cast("bigint")
    name = F.coalesce(F.get(f, 3), F.concat(F.get(f, 0), F.lit(":"), pos, F.lit("-"), end))
    whole = F.when(short, F.raise_error(F.concat(F.lit("BED line with fewer than 3 columns: "), F.concat_ws(" ", f))).cast("boolean"))
    return lines.where(~F.col("_skip")).where(F.coalesce(whole, F.lit(True))).select(
        F.get(f, 0).alias("contig"), pos.alias("pos"), F.get(f, 5).alias("strand"), end.alias("end"), name.alias("name"),
        _number(F.get(f, 4)).alias("support"), "_order",
    )


def _site_table(spark: SparkSession, path: str, header: str) -> DataFrame:
    raw = _read_ordered(spark, path, header)
    headers = [c for c in raw.columns if c != "_order"]

    def column(names: Sequence[str]) -> Column | None:
        found = _pick(headers, names, _plain)
        return F.trim(F.col(f"`{found[0]}`")) if found else None

    contig, at, start = column(CONTIG_NAMES), column(POSITION_NAMES), column(START_NAMES)
    if contig is None or (at is None and start is None):
        raise ValueError(f"{path}: no contig or no position column")
    pos = at.cast("double").cast("bigint") - 1 if at is not None else start.cast("double").cast("bigint")
    strand, name, support = column(["strand"]), column(NAME_NAMES), column(SUPPORT_NAMES)
    rows = raw.select(
        contig.alias("contig"), pos.alias("pos"), (F.lit(".") if strand is None else strand).alias("strand"),
        (F.lit(None).cast("string") if name is None else F.when(name != "", name)).alias("name"),
        (F.lit(None).cast("double") if support is None else _number(support)).alias("support"), "_order",
    ).where(F.coalesce(F.col("contig"), F.lit("")) != "")
    rows = rows.withColumn("end", F.col("pos") + 1)
    shown = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(F.lit("."))
    made_up = F.concat(F.col("contig"), F.lit(":"), F.col("pos"), F.lit("-"), F.col("end"), F.lit(":"), shown)
    return rows.withColumn("name", F.coalesce("name", made_up))


def _file_path() -> Column:
    """Path of the source file with URI escapes undone."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def read_result_tree(
    spark: SparkSession,
    glob: str,
    path_pattern: str,
    names: Sequence[str],
    required: Sequence[str] = (),
    sep: str = "\t",
    schema: str | None = None,
    strip_prefixes: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All delimited files below a glob as one scan, with columns taken from each file's path.

    ``path_pattern`` is a regular expression whose groups fill ``names``; files that do not match are skipped.
    ``strip_prefixes`` removes the first matching prefix from a path column.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("ignoreMissingFiles", True)
    df = (reader.schema(schema) if schema else reader).csv(glob)
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"{glob}: missing columns {lost}")
    path = _file_path()
    out = df.select("*", *[F.regexp_extract(path, path_pattern, i + 1).alias(n) for i, n in enumerate(names)], path.alias("source_path"))
    out = out.where(F.col("source_path").rlike(path_pattern))
    for name, prefixes in (strip_prefixes or {}).items():
        out = out.withColumn(name, F.regexp_replace(name, "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")", ""))
    return out


def read_history(
    spark: SparkSession, glob: str, run_pattern: str, numeric: Sequence[str], sep: str = ","
) -> DataFrame:
    """Epoch logs of many runs as one scan: listed columns coerced to numbers (NULL where not), run from the path."""
    df = spark.read.option("header", True).option("sep", sep).csv(glob)
    path = _file_path()
    return df.select(
        *[F.col(c) for c in df.columns if c not in numeric],
        *[(F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in numeric],
        F.regexp_extract(path, run_pattern, 1).alias("run"),
    )


def write_report(df: DataFrame, path: str, fmt: str = "tsv", columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """TSV with header or JSON lines; ``columns`` selects and orders, anything else is left out."""
    out = df.select(*columns) if columns else df
    if fmt == "tsv":
        out.write.mode(mode).option("sep", "\t").option("header", True).csv(path)
    elif fmt == "json":
        out.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
