"""Label, ratio and class functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ordering import search_sorted

# Global label ids and the status vocabulary of run manifests.
CANONICAL = {"A": 0, "C": 1, "G": 2, "T": 3}
MODIFIED = 4
IGNORE = -100
STATUS_ALIASES = {
    "mod": "modified",
    "m6a": "modified",
    "full_mod": "modified",
    "unm": "unmodified",
    "canonical": "unmodified",
    "ivt": "unmodified",
    "unmod": "unmodified",
    "test": "mixed",
}
STATUSES = ("modified", "unmodified", "mixed")


def normalize_ratio(c: Column) -> Column:
    """Percentages above 1 become fractions; anything outside [0, 1] afterwards fails the query."""
    ratio = F.when(c > 1, c / 100.0).otherwise(c.cast("double"))
    return F.when(
        ratio.isNull() | ((ratio >= 0.0) & (ratio <= 1.0)), ratio
    ).otherwise(F.raise_error(F.concat(F.lit("ratio outside [0, 1]: "), c.cast("string"))))


def digitize(c: Column, edges: Sequence[float]) -> Column:
    """Number of ascending ``edges`` <= value; missing values count as -1."""
    value = F.coalesce(F.nanvl(c.cast("double"), F.lit(-1.0)), F.lit(-1.0))
    if not edges:
        return F.lit(0)
    return search_sorted(F.array(*[F.lit(float(e)) for e in edges]), value, len(edges))


def label_targets(ref: Column, mode: str = "full-mod", non_a: str = "ignore", ignore: int = IGNORE) -> Column:
    """Target array for a token array: A by ``mode``, other bases ignored or given their canonical label."""
    if mode not in ("full-mod", "canonical", "llp-candidate"):
        raise ValueError(f"unknown mode {mode!r}")
    if non_a not in ("ignore", "canonical", "zero"):
        raise ValueError(f"unknown non-A policy {non_a!r}")
    a_label = MODIFIED if mode == "full-mod" else CANONICAL["A"]

    def target(token: Column) -> Column:
        out = F.when(token == 1, F.lit(a_label))
        if non_a != "ignore":
            out = out.when((token >= 2) & (token <= 4), token.cast("int") - 1)
        return out.otherwise(F.lit(ignore)).cast("smallint")

    return F.transform(ref, target)


def sample_class(target: Column, length: Column | None = None) -> Column:
    """positive / negative / mixed / unlabeled from the presence of modified and canonical-A labels."""
    used = target if length is None else F.slice(target, F.lit(1), length.cast("int"))
    pos = F.exists(used, lambda x: x == MODIFIED)
    neg = F.exists(used, lambda x: x == CANONICAL["A"])
    return (
        F.when(pos & neg, F.lit("mixed"))
        .when(pos, F.lit("positive"))
        .when(neg, F.lit("negative"))
        .otherwise(F.lit("unlabeled"))
    )


def normalize_status(status: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(status)), "-", "_")
    aliases = F.create_map(*[F.lit(x) for kv in STATUS_ALIASES.items() for x in kv])
    name = F.coalesce(aliases[text], text)
    return F.when(name.isin(*STATUSES), name).otherwise(
        F.raise_error(F.concat(F.lit("unsupported status: "), F.coalesce(status, F.lit("NULL"))))
    )


def resolve_label(status: Column, oligo: Column, modified_ids: Column) -> Column:
    """Label of a matched pattern in a run; NULL for a mixed run that lists no modified ids."""
    return (
        F.when(status == "modified", F.lit(MODIFIED))
        .when(status == "unmodified", F.lit(CANONICAL["A"]))
        .when(F.array_contains(modified_ids, oligo), F.lit(MODIFIED))
        .when(F.size(modified_ids) > 0, F.lit(CANONICAL["A"]))
    )


def positive_prob(pred: Column, conf: Column, positive: str = "m6A") -> Column:
    """Probability of the positive class from a predicted label and its confidence."""
    c = F.least(F.greatest(conf.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.when(pred.rlike(f"(?i){positive}"), c).otherwise(F.lit(1.0) - c)


def binary_label(label: Column, canonical: str = "canonical", positive: str = "m6A") -> Column:
    """0 for labels matching ``canonical`` (tested first), 1 for ``positive``, else NULL."""
    return F.when(label.rlike(f"(?i){canonical}"), F.lit(0)).when(label.rlike(f"(?i){positive}"), F.lit(1))


def ratio_label(fraction: Column) -> Column:
    """Percent text without needless decimals: 0.5 -> ``50``, 0.125 -> ``12.5``."""
    pct = fraction * 100.0
    whole = F.bround(pct)
    return F.when(F.abs(pct - whole) < 1e-6, whole.cast("bigint").cast("string")).otherwise(pct.cast("string"))
