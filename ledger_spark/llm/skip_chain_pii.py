"""Personal data: patterns, and a skip-chain conditional random field that carries their labels through a document.

Patterns give the base spans.  The field labels the tokens with a digit or an at sign (any other token is clamped to "none", so
it adds nothing); neighbours are joined by chain potentials, and all repetitions of a token in the document, however distant, by
skip potentials to one hub node, so any two are two hops apart.  So are similar tokens: numbers with the same last seven digits,
addresses with the same local part or domain, and tokens of one digit shape that agree in the first or the second half of
their digits, as any two do that differ in one digit.  A token has a few keys, so edges grow with the tokens.  Tokens of base spans have the label of their span.  The other
members of a hub share their own potentials: they count as one, however many they are.  Loopy message passing until nothing moves
then makes labels consistent: the last part of a phone number that comes back alone, however often, is labelled by the number it
came from.  Tokens labelled with certainty outside the base spans are spans too.

Weights are fitted to the base spans of `SAMPLE` different texts at most, picked by hash among those with such tokens.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean, least_texts

SAMPLE = 1500
SLOTS = 1 << 12
SURE = 0.95
#: Messages have settled when none moves by more; they are damped from the pass `UNDAMPED` on.
SETTLED = 1e-4
UNDAMPED = 20
JOINTS = ("repeated", "last seven digits", "local part", "domain", "shape and first half", "shape and second half")
#: The kinds of JOINTS of which a member that the patterns miss is an example for the weights.
EXAMPLES = (0, 1, 2, 4, 5)
KINDS = ("email", "ip", "card", "phone")
_PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_NEEDS = ("@", ".", None, "+")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[^0-9a-z+]+|[^0-9a-z]+$")
_NOT_ALNUM = re.compile(r"[^0-9a-z]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _valid(kind: int, match: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in match.split("."))
    if kind == 2:
        digits = re.sub("[ -]", "", match)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= sum(c.isdigit() for c in match) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _MARK.search(text):
        return []
    return [(kind, m.start(), m.end()) for kind, (pattern, need) in enumerate(zip(_PATTERNS, _NEEDS))
            if need is None or need in text for m in pattern.finditer(text) if _valid(kind, m.group())]


@dataclass
class Graph:
    """The marked tokens of a document: places, feature slots, chain edges, and hubs of tokens as (kind of JOINTS, members)."""
    places: list[tuple[int, int]]
    slots: list[list[int]]
    chain: np.ndarray
    hubs: list[tuple[int, list[int]]]


def joint_keys(raw: str) -> list[tuple[int, str]]:
    """(kind of JOINTS, key): tokens of a document with a common key share a hub."""
    low = _EDGES.sub("", raw.lower())
    core, digits = _NOT_ALNUM.sub("", low), re.sub("[^0-9]", "", low)
    keys = [(0, core)] if len(core) >= 4 else []
    local, at, domain = low.rpartition("@")
    if at:
        return keys + [(kind, part) for kind, part in ((2, local), (3, domain)) if len(part) >= 4]
    if re.search("[a-z]", low):
        return keys + ([(2, low), (3, low)] if len(low) >= 4 else [])
    if len(digits) >= 7:
        keys.append((1, digits[-7:]))
    if len(digits) >= 7:
        shape, half = re.sub("[0-9]", "9", low), len(digits) // 2
        keys += [(4, f"{shape} {digits[:half]}"), (5, f"{shape} {digits[half:]}")]
    return keys


def graph(text: str) -> Graph:
    places, slots, chain = [], [], []
    members: dict[tuple[int, str], list[int]] = {}
    before, was = "", False
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    for i, (start, end) in enumerate(tokens):
        raw = text[start:end]
        marked = bool(_MARK.search(raw))
        if marked:
            short = raw if len(raw) <= 64 else raw[:32] + raw[-32:]
            shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", short)))
            after = text[slice(*tokens[i + 1])][:32].lower() if i + 1 < len(tokens) else ""
            names = ("bias", f"shape {shape}", f"runs {re.sub('9+', '9', shape)}", f"first {raw[0]}", f"last {raw[-1]}", f"size {min(len(raw), 40)}",
                     f"digits {min(sum(c.isdigit() for c in raw), 40)}", f"dots {min(raw.count('.'), 5)}", f"at {'@' in raw}", f"plus {'+' in raw}",
                     f"before {before[:32].lower()}", f"after {re.sub('[0-9]', '9', after)}")
            slots.append([zlib.crc32(n.encode("utf-8", "replace")) % SLOTS for n in names])
            if was:
                chain.append((len(places) - 1, len(places)))
            for key in joint_keys(raw):
                members.setdefault(key, []).append(len(places))
            places.append((start, end))
        before, was = re.sub("[0-9]", "9", raw), marked
    hubs = {(kind, tuple(own)): None for (kind, _), own in members.items() if len(own) > 1}
    return Graph(places, slots, np.array(chain, int).reshape(-1, 2), [(kind, list(own)) for kind, own in hubs])


def token_labels(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """1 + kind of a base span that each token overlaps, else 0."""
    out, spans, j = [], sorted((s, e, k) for k, s, e in spans), 0
    for start, end in places:
        while j < len(spans) and spans[j][1] <= start:
            j += 1
        out.append(spans[j][2] + 1 if j < len(spans) and spans[j][0] < end else 0)
    return out


@dataclass
class Model:
    weights: np.ndarray  # SLOTS x labels
    chain: np.ndarray  # log potentials, labels x labels
    skip: np.ndarray  # the same of each kind of JOINTS
    hub: np.ndarray  # log shares of the labels of hubs of each kind


def train(texts: list[str]) -> Model:
    """Weights by regression on the base spans, potentials from how labels go together along chain edges and in hubs."""
    labels = len(KINDS) + 1
    slots, gold, along, within = [], [], [], [[] for _ in JOINTS]
    for text in texts:
        g = graph(text)
        own = token_labels(g.places, base_spans(text))
        heads = [next((own[i] for i in members if own[i]), 0) for _, members in g.hubs]
        for head, (kind, members) in zip(heads, g.hubs):
            for i in members if kind in EXAMPLES else ():  # a repetition or likeness that the patterns miss is an example, not a counterexample
                own[i] = own[i] or head
        slots += g.slots
        gold += own
        along += [(own[a], own[b]) for a, b in g.chain]
        for head, (kind, members) in zip(heads, g.hubs):
            within[kind] += [(head, own[i]) for i in members]
    weights = np.zeros((SLOTS, labels))
    if slots:
        at, target = np.array(slots), np.eye(labels)[gold]
        past = np.full_like(weights, 1e-8)
        for _ in range(80):
            scores = weights[at].sum(1)
            odds = np.exp(scores - scores.max(1, keepdims=True))
            wrong = target - odds / odds.sum(1, keepdims=True)
            slope = np.stack([np.bincount(at.ravel(), np.repeat(wrong[:, k], at.shape[1]), SLOTS) for k in range(labels)], 1) / len(at) - 1e-5 * weights
            past += slope * slope
            weights += 0.2 * slope / np.sqrt(past)

    def potential(seen: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        joint = np.full((labels, labels), 0.1) + 0.9 * np.eye(labels)
        for a, b in seen:
            joint[a, b] += 1
            joint[b, a] += 1
        joint /= joint.sum()
        side = joint.sum(1)
        return np.clip(np.log(joint / side[:, None] / side[None, :]), -4, 4), np.log(side)

    skip, hub = zip(*map(potential, within))
    return Model(weights, potential(along)[0], np.stack(skip), np.stack(hub))


def marginals(model: Model, g: Graph, given: list[int] | None = None) -> np.ndarray:
    """Each token's distribution over labels once loopy message passing has settled; labels `given` (not 0) are certain."""
    labels = model.weights.shape[1]
    if not g.places:
        return np.zeros((0, labels))
    size = len(g.places)
    known = np.array(given if given is not None else [0] * size)
    unary = np.zeros((size + len(g.hubs), labels))
    unary[:size] = model.weights[np.array(g.slots)].sum(1)
    unary[:size][known > 0] = -700.0
    unary[np.flatnonzero(known), known[known > 0]] = 0.0
    unary[size:] = model.hub[[kind for kind, _ in g.hubs]]
    unary -= unary.max(1, keepdims=True)
    chain, spokes, kinds, share = g.chain, [], [], []
    for hub, (kind, members) in enumerate(g.hubs):
        free = max(1, sum(known[i] == 0 for i in members))
        spokes += [(i, size + hub) for i in members]
        kinds += [kind] * len(members)
        share += [1.0 if known[i] else 1.0 / free for i in members]
    edges = np.concatenate([chain, np.array(spokes, int).reshape(-1, 2)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.exp(np.concatenate([np.stack([model.chain] * len(chain)) if len(chain) else np.zeros((0, labels, labels)), model.skip[kinds]]))
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    # What a token tells its hub is weighed by its share of the hub's free members.
    weight = np.concatenate([np.ones(len(chain)), share, np.ones(len(edges))])[:, None]
    told = np.full((2 * len(edges), labels), -np.log(labels))

    def belief() -> np.ndarray:
        logs = unary.copy()
        np.add.at(logs, target, told)
        return logs

    # A label reaches the end of the longest path within so many passes; settling comes long before, as a rule.
    for turn in range(2 * len(unary) + 100 if len(edges) else 0):
        inward = belief()[source] - told[back]
        inward = np.exp(inward - inward.max(1, keepdims=True))
        sent = np.einsum("ea,eab->eb", inward, table)
        fresh = weight * np.log(sent / sent.sum(1, keepdims=True) + 1e-300)
        if turn >= UNDAMPED:
            fresh = (fresh + told) / 2
        moved = np.abs(fresh - told).max()
        told = fresh
        if moved < SETTLED:
            break
    out = belief()[:size]
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def extra_spans(model: Model, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds: tokens with a certain label that overlap no base span, without the punctuation around them."""
    if not _MARK.search(text):
        return []
    g = graph(text)
    given = token_labels(g.places, base)
    out = []
    for (start, end), label, p in zip(g.places, given, marginals(model, g, given)):
        if not label and p[1:].max() >= SURE:
            while start < end and not text[start].isalnum() and text[start] != "+":
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if start < end:
                out.append((int(p[1:].argmax()), start, end))
    return out


def learned(docs: DataFrame) -> Model:
    """A model of at most `SAMPLE` different texts with marked tokens, those of the least hashes; whole texts are used."""
    return train([text for _, text in least_texts(docs.where(F.col("text").rlike("[0-9@]")).select(F.lit("").alias("of"), "text"), SAMPLE)])


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def found(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of `docs` (doc_id, text; others are ignored).

    Null and empty texts have no spans.  Counts and hash are of the base spans, `spans` has the added ones too; positions are code points.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(KINDS))])
                hashes.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(base + extra_spans(shared.value, text or "", base)))
            each = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(each[:, i]) for i in range(len(KINDS))], pa.array(hashes, pa.string()),
                                              pa.array(spans, pa.string())],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lean(run), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return found(docs, learned(docs))
