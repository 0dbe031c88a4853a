"""Personal data: pattern matches, and a skip-chain conditional random field that adds what the patterns miss.

Nodes of the field are the words with a digit or an at sign. Neighbouring nodes are joined as in a chain; words with the same
letters and digits, and words of one shape, are joined with their next occurrence however far away, so evidence from one
place reaches the others. Pattern matches are observed labels; loopy message passing gives the other nodes' probabilities.

Node weights and the potentials of the three kinds of edges are trained together by pseudo-likelihood on a bounded sample of
documents that the patterns label. So that a pattern's own cue (a plus sign, dots) does not explain everything, every second document with
a match mentions it once more without the cue, labelled alike, and the others mention another number of that length, labelled
none: only the edges tell the two apart.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS = 6_000
FEATURE_BITS = 12
ROUNDS = 8
DAMPING = 0.3
ADD_AT = 0.9
KNOWN = 30.0  # log weight of an observed label against the others
STEPS, RATE, PAIR_RATE = 400, 0.3, 2.0  # potentials are few and move faster than the weights
NEAR = 2  # words between neighbours of the chain at most

# The patterns of the contract. Where an attempt that fails would be tried again further on, the start is tied to the
# beginning of the run of characters (an earlier start matches whenever a later one does), so time stays linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, kind (place in KINDS), end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            if begin < at:
                yield begin, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and non-overlapping per kind; those that fail their check are dropped."""
    found: list[Span] = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        own = _digits(m[0])
        if 12 <= len(own) <= 19 and luhn(own):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[Span], names: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'#$%&*<>|"


@dataclass
class Nodes:
    """Candidate words of a run of documents and the edges between them."""

    doc: list[int]
    start: list[int]
    end: list[int]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    equal: list[tuple[int, int]] = field(default_factory=list)
    key: list[str] = field(default_factory=list)


KEY_DIGITS = 6


def _key(word: str) -> str:
    """What equal tokens share: letters and digits of a word with enough digits, else the word."""
    return re.sub(r"[^0-9A-Za-z@]", "", word) if sum("0" <= c <= "9" for c in word) >= KEY_DIGITS else word


def _shape(word: str) -> str:
    return "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word)


def _feature_ids(word: str, before: str, after: str) -> list[int]:
    shape = _shape(word)
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = shape.count("9")
    names = [
        f"s{short}", f"n{min(digits, 20)}", f"l{min(len(word) // 2, 12)}", f"d{min(word.count('.'), 4)}",
        f"f{shape[:1]}", f"e{shape[-1:]}", f"b{re.sub(r'(.)\1+', r'\1', _shape(before))[:6]}",
        f"a{re.sub(r'(.)\1+', r'\1', _shape(after))[:6]}", f"m{'@' in word}{'-' in word}{'(' in word}{'+' in word}",
        f"p{short}{min(digits, 20)}",
    ]
    return [zlib.crc32(n.encode()) & ((1 << FEATURE_BITS) - 1) for n in names]


def nodes(texts: list[str]) -> Nodes:
    out = Nodes([], [], [], [], [], [])
    for d, text in enumerate(texts):
        last_equal: dict[str, int] = {}
        last_shape: dict[str, int] = {}
        before, position, previous, pending = "", -10, -1, None
        for w, m in enumerate(_WORD.finditer(text)):
            word = m[0]
            if pending is not None:
                out.features[pending[0]] = _feature_ids(pending[1], pending[2], word)
                pending = None
            if "@" in word or any("0" <= c <= "9" for c in word):
                core = word.strip(_EDGE) or word
                begin = m.start() + word.index(core)
                i = len(out.doc)
                out.doc.append(d)
                out.start.append(begin)
                out.end.append(begin + len(core))
                out.features.append(_feature_ids(core, before, ""))
                pending = (i, core, before)
                if w - position <= NEAR:
                    out.chain.append((previous, i))
                key = _key(core)
                out.key.append(key)
                if key in last_equal:
                    out.equal.append((last_equal[key], i))
                else:
                    shape = _shape(core)
                    if shape in last_shape and len(core) > 3:
                        out.skip.append((last_shape[shape], i))
                    last_shape[shape] = i
                last_equal[key] = i
                position, previous = w, i
            before = word
    return out


@dataclass
class SkipChain:
    weights: np.ndarray  # feature, label
    chain: np.ndarray  # log potential of label pairs of neighbours
    skip: np.ndarray
    equal: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS),) * 2))

    def marginals(self, n: Nodes, observed: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of each node after ``ROUNDS`` rounds of damped sum-product messages along all edges.

        ``observed`` has the known label of a node, 0 where none is.
        """
        if not n.doc:
            return np.zeros((0, len(LABELS)))
        unary = self.weights[np.array(n.features)].sum(axis=1)
        if observed is not None:
            known = np.flatnonzero(observed)
            unary[known] = -KNOWN
            unary[known, observed[known]] = KNOWN
        edges = np.array(n.chain + n.skip + n.equal, dtype=np.int64).reshape(-1, 2)
        if len(edges):
            kinds = ((self.chain, n.chain), (self.skip, n.skip), (self.equal, n.equal))
            pair = np.concatenate([np.repeat(potential[None], len(own), 0) for potential, own in kinds])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            message = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                out = belief[source] - message[back]
                new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
                new -= new.max(axis=1, keepdims=True)
                message = DAMPING * message + (1 - DAMPING) * new
            np.add.at(unary, target, message)
        unary -= unary.max(axis=1, keepdims=True)
        p = np.exp(unary)
        return p / p.sum(axis=1, keepdims=True)


def _labels(n: Nodes, spans: list[list[Span]]) -> np.ndarray:
    out = np.zeros(len(n.doc), dtype=np.int64)
    for i, (d, s, e) in enumerate(zip(n.doc, n.start, n.end, strict=True)):
        for a, k, b in spans[d]:
            if a < e and s < b:
                out[i] = k + 1
                break
    return out


def with_mentions(texts: list[str]) -> list[str]:
    """Training texts: of those with a number as a match every second mentions its digits again, the others mention other digits."""
    out, turn = [], 0
    for text in texts:
        spans = [(s, e) for s, k, e in base_spans(text) if KINDS[k] != "email"]
        if spans:
            own = _digits(text[spans[0][0] : spans[0][1]])
            other = own[::-1] if own[::-1] != own else str((int(own[0]) + 1) % 10) + own[1:]
            word = text.split(None, 1)[0]
            text = f"{text}\n{word} {own if turn % 2 == 0 else other}"
            turn += 1
        out.append(text)
    return out


def _spread(n: Nodes, y: np.ndarray) -> np.ndarray:
    """Labels, and those of matched nodes for the nodes of their document with the same key."""
    known = {(d, k): label for d, k, label in zip(n.doc, n.key, y.tolist(), strict=True) if label}
    return np.array([label or known.get((d, k), 0) for d, k, label in zip(n.doc, n.key, y.tolist(), strict=True)], dtype=np.int64)


def fit(texts: list[str]) -> SkipChain:
    """Node weights and edge potentials by pseudo-likelihood: each node's label given its features and its neighbours' labels."""
    size, width = 1 << FEATURE_BITS, len(LABELS)
    model = SkipChain(np.zeros((size, width)), np.zeros((width, width)), np.zeros((width, width)))
    texts = with_mentions(texts)
    n = nodes(texts)
    if not n.doc:
        model.weights[:, 0] = 0.1
        return model
    y = _spread(n, _labels(n, [base_spans(t) for t in texts]))
    x = np.array(n.features)
    groups = [(p, np.array(e, dtype=np.int64).reshape(-1, 2)) for p, e in ((model.chain, n.chain), (model.skip, n.skip), (model.equal, n.equal))]
    seen = np.full(model.weights.shape, 1e-6)
    seen_pairs = [np.full((width, width), 1e-6) for _ in groups]
    for _ in range(STEPS):
        z = model.weights[x].sum(axis=1)
        for potential, e in groups:
            np.add.at(z, e[:, 0], potential.T[y[e[:, 1]]])
            np.add.at(z, e[:, 1], potential[y[e[:, 0]]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        for (potential, e), squares in zip(groups, seen_pairs, strict=True):
            grad = 1e-5 * potential
            np.add.at(grad.T, y[e[:, 1]], p[e[:, 0]])
            np.add.at(grad, y[e[:, 0]], p[e[:, 1]])
            squares += grad**2
            potential -= PAIR_RATE * grad / np.sqrt(squares)
        grad = 1e-5 * model.weights
        for j in range(x.shape[1]):
            np.add.at(grad, x[:, j], p)
        seen += grad**2
        model.weights -= RATE * grad / np.sqrt(seen)
    return model


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> SkipChain:
    """The field from at most ``rows`` documents (smallest hash of id and text), in one task; no documents, no labels."""
    order = F.xxhash64("doc_id", "text")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = sample.select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(rows).select("h").distinct()
    chosen = sample.withColumn("h", order).join(F.broadcast(ids), "h")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "doc_id"]).head(rows)
        return pd.DataFrame({"model": [pickle.dumps(fit([t or "" for t in part["text"]]))]})

    found = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])


def added_spans(texts: list[str], base: list[list[Span]], model: SkipChain) -> list[list[Span]]:
    """Words the field labels with probability ``ADD_AT`` or more and no base match touches; adjacent ones are one span."""
    out: list[list[Span]] = [[] for _ in texts]
    n = nodes(texts)
    p = model.marginals(n, _labels(n, base))
    best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=np.int64)
    for i in np.flatnonzero((best > 0) & (p.max(axis=1, initial=0) >= ADD_AT)).tolist():
        d, s, e, k = n.doc[i], n.start[i], n.end[i], int(best[i]) - 1
        if any(a < e and s < b for a, _, b in base[d]):
            continue
        if out[d] and out[d][-1][1] == k and out[d][-1][2] + 1 == s:
            out[d][-1] = (out[d][-1][0], k, e)
        else:
            out[d].append((s, k, e))
    return out


def find_pii(docs: DataFrame, model: SkipChain) -> DataFrame:
    """``doc_id, spans, base`` per row: arrays of ``(kind, start, end)`` in code points, ends exclusive, in order.

    ``base`` holds the pattern matches, ``spans`` these and what the field adds. Null and empty text: empty arrays.
    Repeated rows are read each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = re.compile(rb"[0-9@]")
        for batch in batches:
            for part, raw in chunks(batch):
                at = [i for i, t in enumerate(raw) if digit.search(t)]
                texts = [raw[i].decode("utf-8") for i in at]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, shared.value)
                all_base: list[list[dict]] = [[] for _ in raw]
                all_spans: list[list[dict]] = [[] for _ in raw]
                for i, own, extra in zip(at, base, more, strict=True):
                    all_base[i], all_spans[i] = named(own), named(own + extra)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(all_spans, kind), pa.array(all_base, kind)], ["doc_id", "spans", "base"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"doc_id long, spans {span}, base {span}")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
