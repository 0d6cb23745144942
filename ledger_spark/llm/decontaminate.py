"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower case, runs of white space as one blank) may occur in a document with up to
k = rate x m edits.  It is split into k + 1 pieces, of which one then occurs unchanged.  An automaton finds all pieces
of a block of items in one pass over a text.  A hit is verified upwards: pieces form a binary tree in which a node
with budget k has children with budgets that sum to k - 1, so some hit's ancestors all match within theirs, and
a hit whose parent does not match is dropped after a few steps.  Distances are Myers' bit-parallel ones.

Items come in blocks of a bounded size; each block is broadcast and matched against all documents in turn.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean
from ledger_spark.session import empty_frame

EDIT_RATE = 0.1
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Node:
    """A range of an item that may have `budget` edits."""

    def __init__(self, item: str, start: int, end: int, budget: int, parent: Node | None) -> None:
        self.start, self.end, self.budget, self.parent = start, end, budget, parent
        self.masks: dict[str, int] = defaultdict(int)
        if budget:
            for i, c in enumerate(item[start:end]):
                self.masks[c] |= 1 << i
            self.masks = dict(self.masks)

    def pieces(self, item: str) -> Iterator[Node]:
        if not self.budget:
            yield self
            return
        left = (self.budget - 1) // 2
        middle = self.start + (self.end - self.start) * (left + 1) // (self.budget + 1)
        yield from Node(item, self.start, middle, left, self).pieces(item)
        yield from Node(item, middle, self.end, self.budget - 1 - left, self).pieces(item)


def nearest(masks: dict[str, int], size: int, text: str) -> int:
    """The least edit distance of a pattern (its masks and size) to any substring of `text`."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        hp = down | ~(d0 | up) & full
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
        hp = hp << 1 & full
        up = (hn << 1 | ~(d0 | hp)) & full
        down = hp & d0
    return best


class Matcher:
    """All pieces of a block of items [(item_id, text)]."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        leaves: dict[str, list[tuple[int, Node]]] = defaultdict(list)
        self.sizes: list[tuple[int, int, str]] = []
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            root = Node(text, 0, len(text), int(rate * len(text)), None)
            for leaf in root.pieces(text):
                leaves[text[leaf.start:leaf.end]].append((len(self.sizes), leaf))
            self.sizes.append((item_id, len(text), text))
        self.automaton = ahocorasick.Automaton()
        for piece, of in leaves.items():
            self.automaton.add_word(piece, (len(piece), of))
        if leaves:
            self.automaton.make_automaton()
        self.empty = not leaves

    def matches(self, text: str) -> dict[int, int]:
        """The items that occur within their budget, with the least distance found."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int, int]] = set()
        if self.empty:
            return found
        for last, (size, of) in self.automaton.iter(text):
            at = last - size + 1
            for index, leaf in of:
                if found.get(index) == 0:
                    continue
                node, distance = leaf, 0
                while node.parent is not None:
                    node = node.parent
                    low = at - (leaf.start - node.start) - node.budget
                    key = (index, id(node), low)
                    if key in tried:
                        distance = None
                        break
                    tried.add(key)
                    window = text[max(0, low):at + (node.end - leaf.start) + node.budget]
                    distance = nearest(node.masks, node.end - node.start, window)
                    if distance > node.budget:
                        distance = None
                        break
                if distance is not None and distance < found.get(index, distance + 1):
                    found[index] = distance
        out: dict[int, int] = {}
        for index, distance in found.items():
            item = self.sizes[index][0]
            out[item] = min(distance, out.get(item, distance))
        return out


def blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about `chars` characters, fetched one partition at a time."""
    held, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, distance) for each document and item that occurs in it within rate x length edits.

    Null or empty texts and items match nothing, items without id are left out; a repeated row of `docs` gives its
    matches again; items with equal text match alike.  No items or documents: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id long, distance long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    parts = []
    for block in blocks(items, chars):
        shared = spark.sparkContext.broadcast((block, rate))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(*shared.value)
            for frame in frames:
                rows = [(d, i, k) for d, t in zip(frame.doc_id, frame.text) for i, k in sorted(matcher.matches(normal(t)).items())]
                yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "item_id": [r[1] for r in rows],
                                    "distance": [r[2] for r in rows]}).astype({"item_id": "int64", "distance": "int64"})

        parts.append(texts.mapInPandas(lean(run), schema))
    return reduce(lambda a, b: a.union(b), parts) if parts else empty_frame(spark, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
