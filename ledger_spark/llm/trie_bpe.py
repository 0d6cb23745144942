"""BPE encoding and decoding by a walk over the trie of a task's distinct words.

A tokenizer file's vocabulary and merges are read; texts are cut at its added tokens and split into words.  The last
token of a prefix's encoding is the one token that the prefix ends with and that may follow the last token of what stands before it.  So a
word's encoding needs nothing but the last tokens of its prefixes, and words that begin alike share them: the new words of a task, in order,
are the leaves of their trie from left to right, a stack holds the last tokens down to the current node, and going from word to
word takes it back to their common prefix and down again.  Each node of the trie is computed once.

Two tokens may follow each other if merging their bytes gives just these two.  Only what stands at the seam matters: the ends of
the left token and the beginnings of the right one come to be at known ranks, and they stay apart unless a pair across the
seam merges sooner.  An automaton of the tokens' bytes names the tokens that a prefix ends with.

Each Python worker keeps encoded words up to `HELD_BYTES`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark.llm.bpe_codec import byte_letters, splitter
from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean

HELD_BYTES = 48 << 20
WINDOW = 1 << 20
_PAIRS = 300_000
_NEVER = 1 << 62
#: A place where any text may be cut without changing its words: a blank between word characters.
_GAP = re.compile(r"\w(?= \w)")
_TRIES: dict[tuple[str, str], "TrieBpe"] = {}


class TrieBpe:
    """Of a byte-level BPE file: `tokens` (bytes by id), `seam` and `words`."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        model = file["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(to_byte[c] for c in token)
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("unk_token") or any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in file.get("added_tokens", ())):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in ids.items() if t not in special}
        self.tokens |= {i: t.encode() for t, i in special.items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = splitter(pattern)
        self.byte_ids = [ids[c] for c in byte_letters()]
        self.ranks: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = ids[left], ids[right], ids[left + right]
            if whole in parts or any(parts.get(p, (0, 0, -1))[2] >= rank for p in (a, b)):
                raise ValueError(f"{path}: a token has two merges, or one that comes before its parts")
            self.ranks[a, b] = rank
            parts[whole] = a, b, rank
        # For each token, smallest first: what it begins and ends with as it grows, and at which rank each comes to be.
        self.heads: dict[int, tuple[list[int], list[int]]] = {i: ([i], [-1]) for i in self.byte_ids}
        self.tails = {i: ([i], [-1]) for i in self.byte_ids}
        whole_tokens = set(self.byte_ids)
        for token, (a, b, rank) in parts.items():
            self.heads[token] = [*self.heads[a][0], token], [*self.heads[a][1], rank]
            self.tails[token] = [*self.tails[b][0], token], [*self.tails[b][1], rank]
            if a in whole_tokens and b in whole_tokens and self.seam(a, b, rank):
                whole_tokens.add(token)
        self._automaton({i: self.tokens[i] for i in whole_tokens})
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def seam(self, left: int, right: int, below: int = _NEVER) -> bool:
        """Whether two tokens stay apart when their bytes are merged together, by the merges of rank less than `below`."""
        ends, end_ranks = self.tails[left]
        starts, start_ranks = self.heads[right]
        i = j = 0
        while True:
            end_next = end_ranks[i + 1] if i + 1 < len(ends) else _NEVER
            start_next = start_ranks[j + 1] if j + 1 < len(starts) else _NEVER
            across = self.ranks.get((ends[i], starts[j]), _NEVER)
            # Of equal pairs the left one merges first.
            if across < below and across < end_next and across <= start_next:
                return False
            if end_next == start_next == _NEVER:
                return True
            if end_next <= start_next:
                i += 1
            else:
                j += 1

    def _automaton(self, tokens: dict[int, bytes]) -> None:
        """States by what has been read: `goto` on a byte, `fail` to the longest shorter state, `ends` to the
        longest token that is read there, as (token, its length, the state of the next shorter one)."""
        goto: dict[int, int] = {}
        own: list[int] = [-1]
        depth = [0]
        for token, data in tokens.items():
            at = 0
            for b in data:
                key = at << 8 | b
                to = goto.get(key)
                if to is None:
                    to = goto[key] = len(own)
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            own[at] = token
        fail = [0] * len(own)
        ends: list[tuple[int, int, int] | None] = [None] * len(own)
        for key in sorted(goto, key=lambda k: depth[k >> 8]):
            at, b, to = key >> 8, key & 255, goto[key]
            if at:
                back = fail[at]
                while back and (back << 8 | b) not in goto:
                    back = fail[back]
                fail[to] = goto.get(back << 8 | b, 0)
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            shorter = fail[state]
            ends[state] = (own[state], depth[state], shorter) if own[state] >= 0 else ends[shorter]
        self.goto, self.fail, self.ends = goto, fail, ends

    def words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word and its ids, as little-endian unsigned 32-bit integers, in the order of their bytes."""
        goto, fail, ends, pairs = self.goto, self.fail, self.ends, self.pairs
        states, last, size = [0], [-1], [0]  # by depth: the automaton's state, the last token and its length
        before = b""
        for data, word in sorted((w.encode(), w) for w in words):
            most, depth = min(len(before), len(data)), 0
            while depth < most and before[depth] == data[depth]:
                depth += 1
            del states[depth + 1:], last[depth + 1:], size[depth + 1:]
            state = states[depth]
            for at in range(depth, len(data)):
                b = data[at]
                to = goto.get(state << 8 | b)
                while to is None:
                    state = fail[state]
                    to = goto.get(state << 8 | b)
                state = to
                found = ends[state]
                while True:
                    token, length, shorter = found
                    start = at + 1 - length
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= _PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.seam(last[start], token)
                    if fits:
                        break
                    found = ends[shorter]
                states.append(state)
                last.append(token)
                size.append(length)
            before, at, ids = data, len(data), []
            while at:
                ids.append(last[at])
                at -= size[at]
            yield word, np.array(ids[::-1], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        if self.held > HELD_BYTES:
            self.forget()
        for word, ids in self.words([p for p in pieces if p not in self.known]):
            self.known[word] = ids
            self.held += 4 * len(word) + len(ids) + 150

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def parts(self, text: str) -> Iterator[str | bytes]:
        """The text in pieces of bounded length where it can be cut; ids stand for added tokens."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from _windows(text, at, mark.start())
            yield self.special[mark.group()]
            at = mark.end()
        yield from _windows(text, at, len(text))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        """(row, ids) of the pieces of each text in order, one at least; null texts are empty."""
        held: list[tuple[int, str | bytes]] = []
        room = 0
        for row, text in enumerate(texts):
            held.append((row, b""))
            for part in self.parts(text or ""):
                held.append((row, part))
                room += len(part)
                if room >= WINDOW:
                    yield from self._encoded(held)
                    held, room = [], 0
        yield from self._encoded(held)

    def _encoded(self, parts: list[tuple[int, str | bytes]]) -> Iterator[tuple[int, bytes]]:
        split = [(row, part if isinstance(part, bytes) else self.split(part)) for row, part in parts]
        self.learn({p for _, pieces in split if isinstance(pieces, list) for p in pieces})
        get = self.known.__getitem__
        for row, pieces in split:
            yield row, pieces if isinstance(pieces, bytes) else b"".join(map(get, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _windows(text: str, at: int, to: int) -> Iterator[str]:
    while to - at > WINDOW:
        gap = _GAP.search(text, at + WINDOW, to)
        if not gap:
            break
        yield text[at:gap.end()]
        at = gap.end()
    if at < to:
        yield text[at:to]


def trie_bpe(path: str, pattern: str) -> TrieBpe:
    """The worker's own; it holds one at a time."""
    if (path, pattern) not in _TRIES:
        _TRIES.clear()
        _TRIES[path, pattern] = TrieBpe(path, pattern)
    return _TRIES[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) per row of `docs` (doc_id, text; others are ignored): the ids as the tokenizers library gives them with
    add_special_tokens=False.  Null and empty texts have none; a repeated row comes as often as it came.  `path` must be readable on every executor."""
    def ids(own: TrieBpe, texts: list[str | None]) -> list[pa.Array]:
        out: list[list[bytes]] = [[] for _ in texts]
        for row, some in own.encode(texts):
            out[row].append(some)
        joined = [b"".join(x) for x in out]
        ends = np.append(0, np.cumsum([len(x) // 4 for x in joined])).astype(np.int32)
        return [pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(joined), np.int32))]

    return _mapped(docs, path, pattern, ids, "ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) per row of `rows` (doc_id, ids): the text as the library's decode with skip_special_tokens=False; null ids
    give the empty text, bytes that are no UTF-8 the replacement character."""
    def texts(own: TrieBpe, lists: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array([b"".join(own.tokens[i] for i in ids or ()).decode("utf-8", "replace") for ids in lists], pa.string())]

    return _mapped(rows.select("doc_id", "ids"), path, pattern, texts, "text string", "ids")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of `docs` (doc_id, text; others are ignored).

    Null and empty texts have no tokens and the hashes of nothing.  A long text is encoded, decoded and hashed piece by piece, so
    its ids are never held whole; one unbroken word is.
    """
    def sums(own: TrieBpe, texts: list[str | None]) -> list[pa.Array]:
        counts = [0] * len(texts)
        of_ids = [hashlib.sha256() for _ in texts]
        of_text = [hashlib.sha256() for _ in texts]
        for row, ids in own.encode(texts):
            counts[row] += len(ids) // 4
            of_ids[row].update(ids)
            of_text[row].update(own.decode(ids))
        return [pa.array(counts, pa.int64()), *[pa.array([x.hexdigest() for x in xs], pa.string()) for xs in (of_ids, of_text)]]

    return _mapped(docs, path, pattern, sums, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(rows: DataFrame, path: str, pattern: str, per: Callable[[TrieBpe, list], list[pa.Array]], schema: str,
            column: str = "text") -> DataFrame:
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie_bpe(path, pattern)
        names = ["doc_id", *[c.split()[0] for c in schema.split(", ")]]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *per(own, batch.column(1).to_pylist())], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col(column)).mapInArrow(lean(run), f"doc_id {kind}, {schema}")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
