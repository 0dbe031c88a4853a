"""Merkle manifest of a table: one tree per source over its rows, one tree over the sources' roots, proofs for every row.

Every tree is kept as a postorder append log: nodes stand in the order in which they are completed when leaves are appended
one after the other. Node ``i`` of height ``h`` ends with leaf ``e = min((i + 1) * fan**h, n) - 1``; before that leaf stand ``e``
leaves and ``sum(e // fan**j)`` inner nodes, so the node's position is ``e + sum(e // fan**j) + h`` (:func:`position`). Siblings
are addressed by that closed form; the log holds no pointers.

Aligned builders write it: a builder takes ``fan**SPAN`` consecutive nodes of one height, whose subtrees depend on nothing
else, and appends its inner nodes in completion order. Their tops are the nodes of the next pass, so a source that holds a
third of all rows occupies as many builders as it has spans, and the passes are logarithmic. Proofs go the other way: a
span's path from its top to the root is found once, and each node of the span only adds the siblings inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordering import ordered_prefix
from .spark_help import partitions, staged

FAN = 3
SPAN = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "top"


def node_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(n: int, height: int, fan: int = FAN) -> int:
    """Nodes of a tree of ``n`` leaves at a height."""
    return -(-n // fan**height)


def position(height: int, index: np.ndarray, n: int, fan: int = FAN) -> np.ndarray:
    """Place in the append log of the nodes ``index`` of a height, in a tree of ``n`` leaves."""
    last = np.minimum((np.asarray(index, dtype=np.int64) + 1) * fan**height, n) - 1
    out, share = last + height, last // fan
    while share.any():
        out, share = out + share, share // fan
    return out


def field_bytes(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field_bytes(c) for c in columns]), 256)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one (tree, chunk) from rows sorted by them; only the open one is held."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
        begin = 0
        for i, k in enumerate(keys):
            if k != key:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, begin = [], k, i
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


LOG = "tree string, chunk long, n long, height int, idx long, pos long, digest string, rest long"


def _grow(base: int, fan: int, span: int):
    """Map over sorted spans of nodes of height ``base``: the nodes above them, leaves too, in completion order.

    ``rest`` is set for a span's top alone: how many nodes its height has in the whole tree, 1 for a root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            tree, chunk, n = (group.column(c)[0].as_py() for c in ("tree", "chunk", "n"))
            index, digests, height = group.column("idx").to_numpy(), group.column("digest").to_pylist(), base
            found = [] if base else [(height, index, digests)]
            while width(n, height, fan) > 1 and height < base + span:
                digests = [node_hash(*digests[i : i + fan]) for i in range(0, len(digests), fan)]
                index, height = index[::fan] // fan, height + 1
                found.append((height, index, digests))
            place = np.concatenate([position(h, i, n, fan) for h, i, _ in found])
            heights = np.concatenate([np.full(len(i), h, dtype=np.int32) for h, i, _ in found])
            rest = [None] * (len(place) - 1) + [width(n, height, fan)]
            order = np.argsort(place)
            table = pa.table(
                {
                    "tree": pa.array([tree] * len(place), pa.string()),
                    "chunk": pa.array(np.full(len(place), chunk)),
                    "n": pa.array(np.full(len(place), n)),
                    "height": pa.array(heights),
                    "idx": pa.array(np.concatenate([i for _, i, _ in found])),
                    "pos": pa.array(place),
                    "digest": pa.array([d for _, _, ds in found for d in ds], pa.string()),
                    "rest": pa.array(rest, pa.int64()),
                }
            )
            yield from table.take(pa.array(order)).combine_chunks().to_batches()

    return run


@dataclass
class Forest:
    """Append logs of many trees, one table for each pass of builders, and the root of each tree."""

    logs: list[DataFrame]
    roots: DataFrame
    fan: int
    span: int


def grow(nodes: DataFrame, fan: int = FAN, span: int = SPAN) -> Forest:
    """Trees over ``tree, idx, n, digest``: leaf ``idx`` of ``n`` of each tree. ``roots`` has ``tree, pass, digest``."""
    logs: list[DataFrame] = []
    while True:
        rows = nodes.select("tree", F.floor(F.col("idx") / fan**span).cast("long").alias("chunk"), "idx", "n", "digest")
        rows = rows.repartition(partitions(nodes.sparkSession), "tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")
        logs.append(staged(rows.mapInArrow(_grow(len(logs) * span, fan, span), LOG), "log"))
        nodes = logs[-1].where("rest > 1")
        if nodes.isEmpty():
            break
    done = [log.where("rest = 1").select("tree", F.lit(i).alias("pass"), "digest") for i, log in enumerate(logs)]
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return Forest(logs, staged(roots, "roots"), fan, span)


ABOVE, NODE, ASKED = 0, 1, 2


def _extract(base: int, fan: int, span: int, finish):
    """Map over sorted spans of (what lies above the span, its log, the nodes asked for): ``finish`` of each node's path.

    A path lists the runs from the node to the root: for each the node's place in it, and the siblings' digests.
    """

    def paths(n: int, log: dict[int, str], index: np.ndarray, above: list) -> list[list]:
        """Paths of the nodes ``index`` of height ``base``, found from the top of the span downwards."""
        levels, height = [np.unique(index)], base
        while width(n, height, fan) > 1 and height < base + span:
            levels.append(np.unique(levels[-1] // fan))
            height += 1
        known = {int(i): above for i in levels[-1]}
        for nodes in reversed(levels[:-1]):
            height -= 1
            count, below = width(n, height, fan), {}
            for run in np.unique(nodes // fan).tolist():
                members = np.arange(run * fan, min((run + 1) * fan, count))
                digests = [log[p] for p in position(height, members, n, fan).tolist()]
                for slot, i in enumerate(members.tolist()):
                    below[i] = [(slot, digests[:slot] + digests[slot + 1 :]), *known[run]]
            known = below
        return [known[i] for i in index.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            kind = group.column("kind").to_numpy()
            asked = group.filter(pa.array(kind == ASKED))
            if not asked.num_rows:
                continue
            nodes = group.filter(pa.array(kind == NODE))
            log = dict(zip(nodes.column("pos").to_pylist(), nodes.column("digest").to_pylist(), strict=True))
            head = group.filter(pa.array(kind == ABOVE))
            path, subroot, root = (head.column(c)[0].as_py() for c in ("path", "subroot", "root"))
            n = asked.column("n")[0].as_py()
            found = paths(n, log, asked.column("idx").to_numpy(), _parsed(path))
            yield from finish(asked, found, subroot, root)

    return run


def _written(path: list) -> str:
    return ";".join(f"{slot}:{','.join(siblings)}" for slot, siblings in path)


def _parsed(text: str) -> list:
    parts = [p.split(":") for p in text.split(";")] if text else []
    return [(int(slot), siblings.split(",") if siblings else []) for slot, siblings in parts]


def fold(digest: str, path: list) -> str:
    """The root that a node's digest and its siblings give."""
    for slot, siblings in path:
        digest = node_hash(*siblings[:slot], digest, *siblings[slot:])
    return digest


def _as_subroot(asked: pa.Table, found: list, subroot: None, root: str) -> Iterator[pa.RecordBatch]:
    """Leaves of the top tree are roots of sources."""
    for batch in _as_above(asked, found, subroot, root):
        yield batch.set_column(3, "subroot", asked.column("digest").combine_chunks())


def _as_above(asked: pa.Table, found: list, subroot: str | None, root: str) -> Iterator[pa.RecordBatch]:
    table = pa.table(
        {
            "tree": asked.column("name"),
            "chunk": asked.column("to"),
            "path": pa.array([_written(p) for p in found], pa.string()),
            "subroot": pa.array([subroot] * len(found), pa.string()),
            "root": pa.array([root] * len(found), pa.string()),
        }
    )
    yield from table.combine_chunks().to_batches()


def _as_proof(asked: pa.Table, found: list, subroot: str, root: str) -> Iterator[pa.RecordBatch]:
    proofs = [node_hash(*(d for _, siblings in path for d in siblings)) for path in found]
    folded = [fold(probe, path) for probe, path in zip(asked.column("probe").to_pylist(), found, strict=True)]
    table = pa.table(
        {
            "doc_id": asked.column("doc_id"),
            "leaf": asked.column("digest"),
            "subroot": pa.array([subroot] * len(found), pa.string()),
            "root": pa.array([root] * len(found), pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )
    yield from table.combine_chunks().to_batches()


PATHS = "tree string, chunk long, path string, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_UNION = {
    "tree": "string", "chunk": "long", "kind": "int", "idx": "long", "n": "long", "pos": "long", "digest": "string", "path": "string",
    "subroot": "string", "root": "string", "name": "string", "to": "long", "doc_id": "long", "probe": "string",
}


def _rows(df: DataFrame, kind: int, **columns: Column | str) -> DataFrame:
    """``df`` in the shape that all parts of a span share."""
    given = {"kind": F.lit(kind)} | columns
    return df.select(*[F.lit(given.get(c)).cast(t).alias(c) if given.get(c) is None else _column(given[c]).cast(t).alias(c) for c, t in _UNION.items()])


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _span_of(forest: Forest, index: str = "idx") -> Column:
    return F.floor(F.col(index) / forest.fan**forest.span).cast("long")


def _find(forest: Forest, above: DataFrame, asked: DataFrame, finish, schema: str) -> DataFrame:
    """Paths of the leaves ``asked`` (rows of :func:`_rows`); ``above`` has ``tree, pass, path, subroot, root`` for each root."""
    lower, parts = None, partitions(above.sparkSession)
    for i in reversed(range(len(forest.logs))):
        here = _rows(above.where(F.col("pass") == i), ABOVE, tree="tree", chunk=F.lit(0), path="path", subroot="subroot", root="root")
        if lower is not None:
            here = here.unionByName(_rows(lower, ABOVE, tree="tree", chunk="chunk", path="path", subroot="subroot", root="root"))
        log = _rows(forest.logs[i], NODE, tree="tree", chunk="chunk", pos="pos", digest="digest")
        wanted = asked
        if i:
            base = forest.logs[i - 1].where("rest > 1")
            span = _span_of(forest)
            log = log.unionByName(_rows(base, NODE, tree="tree", chunk=span, pos="pos", digest="digest"))
            wanted = _rows(base, ASKED, tree="tree", chunk=span, idx="idx", n="n", digest="digest", name="tree", to="idx")
        rows = here.unionByName(log).unionByName(wanted)
        rows = rows.repartition(parts, "tree", "chunk").sortWithinPartitions("tree", "chunk", "kind")
        mine, given = (_as_above, PATHS) if i else (finish, schema)
        lower = rows.mapInArrow(_extract(i * forest.span, forest.fan, forest.span, mine), given)
        if i:
            lower = staged(lower, "paths")
    return lower


@dataclass
class Manifest:
    """``leaves`` (tree, idx, n, doc_id, digest, probe), the sources' trees and the tree over their roots."""

    leaves: DataFrame
    sources: Forest
    subroots: DataFrame
    top: Forest


def build_manifest(docs: DataFrame, changed: Column | None = None, fan: int = FAN, span: int = SPAN) -> Manifest:
    """Trees over all rows of ``docs`` (``doc_id, source, lang, n_chars, text``; other columns are ignored).

    A leaf hashes the five fields with their lengths, so null and empty differ. In a source leaves ascend by doc_id, null
    first, rows of one doc_id by their hash; sources ascend bytewise, null first. ``changed`` (default: the text itself) is the
    text whose leaf ``probe`` is later folded along the row's path.

    Repeated rows are leaves of their own. No rows give empty logs. A lone leaf is its source's root, a lone source's
    root the root of all.
    """
    fields = [F.col(c) for c in FIELDS]
    probe = leaf_hash(*fields[:-1], F.col("text") if changed is None else changed)
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*fields).alias("digest"), probe.alias("probe"))
    rows = staged(rows.withColumn("one", F.lit(1).cast("long")), "leaves")
    order = [F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("digest")]
    ranked = ordered_prefix(rows, order, ["one"], ["tree"])
    leaves = staged(ranked.select("tree", F.col("one_before").alias("idx"), F.col("one_total").alias("n"), "doc_id", "digest", "probe"), "ranked")
    sources = grow(leaves, fan, span)
    roots = sources.roots.withColumn("one", F.lit(1).cast("long"))
    ranked = ordered_prefix(roots, [F.col("tree")], ["one"])
    subroots = ranked.select(F.lit(TOP).alias("tree"), F.col("one_before").alias("idx"), F.col("one_total").alias("n"), "digest", F.col("tree").alias("name"), "pass")
    subroots = staged(subroots, "subroots")
    return Manifest(leaves, sources, subroots, grow(subroots, fan, span))


def append_log(manifest: Manifest) -> DataFrame:
    """The stored manifest: ``source, position, height, idx, digest``; ``is_top`` marks the tree over the sources' roots."""
    def log(forest: Forest, top: bool) -> DataFrame:
        out = None
        for part in forest.logs:
            part = part.select(F.when(F.lit(not top) & F.col("tree").startswith("s"), F.substring("tree", 2, 1 << 30)).alias("source"),
                               F.lit(top).alias("is_top"), F.col("pos").alias("position"), "height", "idx", "digest")
            out = part if out is None else out.unionByName(part)
        return out

    return log(manifest.sources, False).unionByName(log(manifest.top, True))


def proofs(manifest: Manifest) -> DataFrame:
    """Per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``proof_sha256`` hashes the siblings on the way to the root, level by level, left to right. ``folded_root`` is what
    the row's ``probe`` and those siblings give; ``verified`` says whether that is the root.
    """
    top = manifest.top
    root = top.roots.select("tree", "pass", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    asked = _rows(manifest.subroots, ASKED, tree="tree", chunk=_span_of(top), idx="idx", n="n", digest="digest", name="name", to=F.lit(0))
    above = staged(_find(top, root, asked, _as_subroot, PATHS), "above")
    above = above.join(manifest.subroots.select(F.col("name").alias("tree"), "pass"), "tree")
    asked = _rows(manifest.leaves, ASKED, tree="tree", chunk=_span_of(manifest.sources), idx="idx", n="n", digest="digest", doc_id="doc_id", probe="probe")
    return _find(manifest.sources, above, asked, _as_proof, PROOFS)
