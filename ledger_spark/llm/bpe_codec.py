"""Byte-level BPE encoding and decoding by rank files.

A text is split by the pattern of the ranks; a piece that is a token itself is that token, any other starts as its
bytes and the neighbouring pair of lowest rank, leftmost first, is merged until no pair has a rank.  A segment tree over
a piece's byte positions holds, for each node, the least of rank and position below it, so the next pair is at its
root, and a merge changes three leaves: the pair, the one before it, and the byte that it swallowed.  Trees of
pieces of like length are rows of one array and merge side by side.

Each task keeps what it has encoded in a table of bounded size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean

REMEMBERED = 300_000
_NONE = np.int64(1 << 62)
_CODECS: dict[tuple[str, str], "Codec"] = {}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""All matches of `pattern` in a text, with \s as Unicode's White_Space, as the libraries for these ranks read it.

    Texts of ASCII alone go by an equal pattern of plain classes, others by one of the standard library's classes unless they
    hold a character on which these differ; both are faster.
    """
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]")
    word = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\w\s]|_)")
    wide = pattern
    for mark, full, uni, narrow in ((r"\p{L}", r"\p{L}", r"[^\W\d_]", "[A-Za-z]"), (r"\p{N}", r"\p{N}", r"\d", "[0-9]"),
                                    (r"\s", r"\p{White_Space}", r"\s", r"[\t-\r ]"), (r"\S", r"\P{White_Space}", r"\S", r"[^\t-\r ]")):
        wide, word, plain = wide.replace(mark, full), word.replace(mark, uni), plain.replace(mark, narrow)
    # The contractions as one alternative: only one of them can begin with each letter.
    word, plain = (x.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:[stmd]|re|ve|ll)|") for x in (word, plain))
    wide, word, plain = regex.compile(wide).findall, re.compile(word).findall, re.compile(plain).findall
    apart = _apart()
    # Most texts that are not ASCII are Latin-1, where a look for each of a few characters is faster than one at every character.
    few = [c.encode("latin-1") for c in apart if c < "\u0100"]

    def alike(text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return apart.isdisjoint(text)
        return not any(c in raw for c in few)

    def split(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return word(text) if alike(text) else wide(text)

    return split


@functools.cache
def _apart() -> frozenset[str]:
    r"""The characters that the two libraries put into different classes, such as digits that are not decimal."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return frozenset().union(*(set(regex.findall(full, every)) ^ set(re.findall(word, every)) for full, word in (
        (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\p{White_Space}", r"\s"))))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [others.get(b, chr(b)) for b in range(256)]


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {str(r): t for t, r in self.ranks.items()}
        self.split = splitter(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() if len(t) > 1
                        for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pairs, self.merged = (np.array(x, np.int64) for x in zip(*merges))
        self.known: dict[str, str] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, none where they don't merge or either is missing (negative)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The token ids of pieces, by one array of segment trees."""
        leaves = 1 << max(1, max(map(len, pieces)) - 1).bit_length()
        size = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        part = np.full((size, leaves + 1), -1, np.int64)
        part[:, :leaves][np.arange(leaves) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, leaves + 2), (size, leaves + 1)).copy()
        after[np.arange(leaves + 1) >= (lengths - 1)[:, None]] = leaves
        before = np.broadcast_to(np.arange(-1, leaves), (size, leaves + 1)).copy()
        tree = np.full((size, 2 * leaves), _NONE, np.int64)
        rank = self._rank(part[:, :leaves], part[:, 1:])
        place = np.arange(leaves)
        tree[:, leaves:] = np.where(rank < _NONE, rank * leaves + place, _NONE)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            best = tree[row, 1]
            at = best % leaves
            gone = after[row, at]
            follow = after[row, gone]
            part[row, at] = best // leaves
            part[row, gone] = -1
            after[row, at] = follow
            before[row, follow] = at
            new = self._rank(part[row, at], part[row, follow])
            put(row, at, np.where(new < _NONE, new * leaves + at, _NONE))
            put(row, gone, np.full(len(row), _NONE))
            front = before[row, at]
            some = front >= 0
            if some.any():
                r, f = row[some], front[some]
                new = self._rank(part[r, f], part[r, at[some]])
                put(r, f, np.where(new < _NONE, new * leaves + f, _NONE))
            row = row[tree[row, 1] < _NONE]
        live = part[:, :leaves] >= 0
        return [x.tolist() for x in np.split(part[:, :leaves][live], np.cumsum(live.sum(1))[:-1])]

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces and remember them as their ids in decimal, joined by commas."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = str(whole)
            else:
                by.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for power, group in by.items():
            step = max(1, (1 << 20) >> power)
            for i in range(0, len(group), step):
                some = group[i:i + step]
                for (piece, _), ids in zip(some, self.merge([raw for _, raw in some])):
                    self.known[piece] = ",".join(map(str, ids))

    def encode(self, texts: list[str | None]) -> Iterator[str]:
        """The ids of each text in decimal, joined by commas; null and empty texts have none."""
        texts = [t or "" for t in texts]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 21):
                size += len(texts[to])
                to += 1
            if len(self.known) > REMEMBERED:
                self.known = {}
            split = [self.split(t) for t in texts[at:to]]
            new = {p for pieces in split for p in pieces} - self.known.keys()
            if new:
                self.learn(new)
            get = self.known.__getitem__
            for pieces in split:
                yield ",".join(map(get, pieces))
            at = to

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(","))) if ids else b""


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256) per row of `docs` (doc_id, text; others are ignored).

    The hashes are of the decimal ids joined by commas and of the bytes decoded from them.  Null and empty texts
    have no tokens and the hashes of nothing.  `path` must be readable on every executor.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for ids in own.encode(batch.column(1).to_pylist()):
                sizes.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_bytes, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.known = {}  # a worker is used again by other stages

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_ranks())
