"""Language identification by a linear-chain conditional random field over words.

Each word of letters is labelled with a language.  Its emission is the sum of learned weights of its byte
n-grams (two to four bytes, the word's edges included, so that they also are its affixes) and of the word itself
(lexicon); learned transitions join neighbours.  Forward-backward gives each word's distribution over the
languages, and a document's score for a language is the mean over its words.

Training takes whole texts of labelled documents, `PER_LANGUAGE` of each language and `PER_LANGUAGE_BYTES` at most, picked by hash;
fragments of them are strung together with changes of language, so that the transitions learn switching.
The model is a fixed number of weights per language and goes to the tasks as one broadcast of some megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import U64, lean, least_texts, release, row_slices, span_hashes, text_buffer

PER_LANGUAGE, PER_LANGUAGE_BYTES = 150, 1 << 20
#: Bytes of text worked on at a time; numbers per word take about a hundred times as much.
AT_ONCE = 1 << 18
ROUNDS = 30
SLOTS = 1 << 17
SEQUENCE = 96
SEGMENT = 32
ORDERS = (2, 3, 4)
UNDECIDED = "und"
_EDGE = 0x20
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[0x20, *range(0x09, 0x0E)]] = _EDGE
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = _IS_LETTER[0x80:] = True


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # SLOTS x languages
    lexicon: np.ndarray  # SLOTS x languages
    moves: np.ndarray  # languages x languages, log weights


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows: first row, last row, folded bytes with an edge around each row, starts and ends of words with letters, words per row."""
    buffer, offsets = text_buffer(pc.utf8_lower(pc.fill_null(column, "")))
    for low, high in row_slices(offsets, AT_ONCE):
        own = offsets[low:high + 1] - offsets[low]
        part = np.insert(_FOLD[buffer[offsets[low]:offsets[high]]], own, _EDGE)
        inside = part != _EDGE
        jumps = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(jumps == 1), np.flatnonzero(jumps == -1)
        letters = np.concatenate([[0], np.cumsum(_IS_LETTER[part])])
        real = letters[end] > letters[start]
        start, end = start[real], end[real]
        yield low, high, part, start, end, np.diff(np.searchsorted(start, own + np.arange(len(own))))


def _gram_slots(part: np.ndarray, n: int) -> np.ndarray:
    """The weight slot of the n-gram that starts at each byte."""
    code = np.zeros(max(0, len(part) - n + 1), np.uint32)
    for k in range(n):
        code = (code << np.uint32(8)) | part[k:len(part) - n + 1 + k]
    code = code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
    return (code ^ (code >> np.uint32(15))) & np.uint32(SLOTS - 1)


def _lexicon_slots(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (span_hashes(part, start, end) & U64(SLOTS - 1)).astype(np.int64)


def _bounds(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n-gram of each word and the one after its last; an edge on both sides belongs to the word."""
    return start - 1, np.maximum(start - 1, end - n + 2)


def emissions(model: Model, part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = model.lexicon[_lexicon_slots(part, start, end)].astype(np.float64)
    for n in ORDERS:
        slots = _gram_slots(part, n)
        first, last = _bounds(start, end, n)
        for k in range(len(model.languages)):
            sums = np.zeros(len(slots) + 1)
            np.cumsum(model.grams[:, k][slots], out=sums[1:], dtype=np.float64)
            out[:, k] += sums[last] - sums[first]
    return out


def posteriors(emit: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward-backward: each word's distribution.  `counts` are the words of each row; rows are chains of their own.

    Chains are cut into segments.  The product of a segment's step matrices carries messages across it, so
    segments of all rows are worked on side by side and a long row takes no more steps than a short one.
    """
    states = len(moves)
    pieces = -(-counts // SEGMENT)
    total = int(pieces.sum())
    if total == 0:
        return np.zeros((0, states))
    step = np.exp(moves - moves.max())
    first = np.cumsum(pieces) - pieces
    word = np.arange(len(emit)) - np.repeat(np.cumsum(counts) - counts, counts)
    spot = np.repeat(first, counts) + word // SEGMENT, word % SEGMENT
    weight = np.ones((SEGMENT, total, states))
    there = np.zeros((SEGMENT, total, 1), bool)
    weight[spot[1], spot[0]] = np.exp(emit - emit.max(1, keepdims=True))
    there[spot[1], spot[0]] = True
    span = np.broadcast_to(np.eye(states), (total, states, states)).copy()
    for t in range(SEGMENT):
        after = (span.reshape(-1, states) @ step).reshape(span.shape) * weight[t][:, None, :]
        after /= after.sum((1, 2), keepdims=True)
        span = np.where(there[t][:, :, None], after, span)
    ahead, behind = np.full((total, states), 1 / states), np.full((total, states), 1.0)
    for j in range(1, int(pieces.max())):
        at = first[pieces > j] + j
        go = np.einsum("sk,skl->sl", ahead[at - 1], span[at - 1])
        ahead[at] = go / go.sum(1, keepdims=True)
    for j in range(int(pieces.max()) - 2, -1, -1):
        at = first[pieces > j + 1] + j
        go = np.einsum("skl,sl->sk", span[at + 1], behind[at + 1])
        behind[at] = go / go.sum(1, keepdims=True)
    forward = np.empty_like(weight)
    for t in range(SEGMENT):
        go = (ahead @ step) * weight[t]
        ahead = np.where(there[t], go / go.sum(1, keepdims=True), ahead)
        forward[t] = ahead
    for t in range(SEGMENT - 1, -1, -1):
        forward[t] *= behind
        go = (behind * weight[t]) @ step.T
        behind = np.where(there[t], go / go.sum(1, keepdims=True), behind)
    out = forward[spot[1], spot[0]]
    return out / out.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """Fit weights and transitions to labelled texts by gradient ascent on the chain's likelihood."""
    languages = sorted(set(labels))
    states = len(languages)
    rng = np.random.default_rng(seed)
    of = np.array([languages.index(x) for x in labels])
    gold, lexicon, gram_at, gram_of, at = [], [], [], [], 0
    for low, high, part, start, end, counts in words_of(pa.array(texts, pa.string())):
        gold.append(np.repeat(of[low:high], counts))
        lexicon.append(_lexicon_slots(part, start, end))
        for n in ORDERS:
            slots = _gram_slots(part, n)
            first, last = _bounds(start, end, n)
            size = last - first
            where = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            gram_at.append(slots[where])
            gram_of.append(np.repeat(np.arange(len(start)) + at, size))
        at += len(start)
    gold, lexicon = np.concatenate(gold), np.concatenate(lexicon)
    gram_at, gram_of = np.concatenate(gram_at).astype(np.int64), np.concatenate(gram_of)
    words = len(gold)
    # Fragments of 8 to 40 words; three of four stay with their language, the others land anywhere.
    cuts = np.unique(np.concatenate([[0], np.cumsum(rng.integers(8, 41, words // 8 + 1)), np.flatnonzero(np.diff(gold)) + 1]))
    cuts = cuts[cuts < words]
    key = np.where(rng.random(len(cuts)) < 0.75, gold[cuts] + 0.5 * rng.random(len(cuts)), rng.random(len(cuts)) * states)
    lengths = np.diff(np.append(cuts, words))
    order = np.concatenate([np.arange(c, c + n) for c, n in zip(cuts[np.argsort(key)], lengths[np.argsort(key)])])
    chains = np.full(-(-words // SEQUENCE), SEQUENCE)
    chains[-1] = words - SEQUENCE * (len(chains) - 1)
    inner = np.ones(words, bool)
    inner[np.cumsum(chains) - chains] = False
    model = Model(languages, np.zeros((SLOTS, states)), np.zeros((SLOTS, states)), np.zeros((states, states)))
    past = [np.full_like(x, 1e-8) for x in (model.grams, model.lexicon, model.moves)]
    target = np.eye(states)[gold]
    for _ in range(ROUNDS if states > 1 else 0):
        emit = model.lexicon[lexicon]
        for k in range(states):
            emit[:, k] += np.bincount(gram_of, model.grams[:, k][gram_at], words)
        chain = posteriors(emit[order], chains, model.moves)
        wrong = np.empty_like(target)
        wrong[order] = target[order] - chain
        joint = np.einsum("ni,nj->nij", chain[:-1][inner[1:]], np.exp(emit[order][1:][inner[1:]] - emit[order][1:][inner[1:]].max(1, keepdims=True)))
        joint *= np.exp(model.moves - model.moves.max())
        joint /= joint.sum((1, 2), keepdims=True)
        seen = target[order]
        slopes = [np.stack([np.bincount(gram_at, wrong[:, k][gram_of], SLOTS) for k in range(states)], 1),
                  np.stack([np.bincount(lexicon, wrong[:, k], SLOTS) for k in range(states)], 1),
                  seen[:-1][inner[1:]].T @ seen[1:][inner[1:]] - joint.sum(0)]
        for weights, slope, old in zip((model.grams, model.lexicon, model.moves), slopes, past):
            slope = slope / words - 1e-6 * weights
            old += slope * slope
            weights += 0.15 * slope / np.sqrt(old)
    return Model(languages, model.grams.astype(np.float32), model.lexicon.astype(np.float32), model.moves)


def learned(docs: DataFrame, usable: Column) -> Model | None:
    """A model of the `usable` rows of `docs` (doc_id, text, lang) with text and label; None if there are none."""
    pool = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by: dict[str, list] = {}
    for lang, text in least_texts(pool.select(F.col("lang").alias("of"), "text"), PER_LANGUAGE, PER_LANGUAGE_BYTES):
        by.setdefault(lang, []).append(text)
    rows = [(t, k) for k in sorted(by) for t in by[k] if _LETTER.search(t)]
    model = train([t for t, _ in rows], [k for _, k in rows]) if rows else None
    release()
    return model


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` (with a column text) and lang_pred, score, n_words behind its other columns.

    Null text, text without a letter, or no model: `und` with score 0.  Ties go to the first language by name.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "n_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column("text")
            size = len(text)
            words, sums = np.zeros(size, np.int64), np.zeros((size, max(1, len(model.languages) if model else 1)))
            for low, high, part, start, end, counts in words_of(text) if model else ():
                words[low:high] = counts
                chain = posteriors(emissions(model, part, start, end), counts, model.moves)
                has = counts > 0
                if has.any():
                    sums[low:high][has] = np.add.reduceat(chain, (np.cumsum(counts) - counts)[has])
            real = np.array([t.is_valid and bool(_LETTER.search(t.as_py())) for t in text], bool) & (words > 0)
            best = sums.argmax(1)
            names = [model.languages[b] if r else UNDECIDED for b, r in zip(best, real)]
            score = np.where(real, np.minimum(1.0, sums.max(1) / np.maximum(words, 1)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(words)],
                names=[*keep, "lang_pred", "score", "n_words"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema)
    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(lean(run), f"{kinds}, lang_pred string, score double, n_words long")


def held_out() -> Column:
    """Documents never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs, ~held_out())
    return labelled(docs.select("doc_id", "text", held_out().alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "n_words")
