"""Token ids in Parquet: list columns, delta or dictionary encoding, controlled row groups, page indexes.

Documents are dealt into ranges of doc_id; a task encodes its range in order and writes one shard.  A row holds the document's ids
(an end id appended), their number, and how many ids of the shard come before it, so the global offset of a
document is its shard's plus its own.  Small pages and the page index that Spark's writer adds let a reader fetch the tokens of a few
documents, and the metadata columns are read without the ids.

The ids are those of the tokenizers library with add_special_tokens=False.  Texts are split by its
byte-level pattern; a piece is given to the library's model once and remembered in a table of bounded size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from ledger_spark.llm.bpe_codec import byte_letters, splitter
from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean
from ledger_spark.session import scratch_path

END = 0
REMEMBERED = 400_000
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",  # integers outside a dictionary are delta encoded
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
_FILES = "doc_id long, shard int, before long, n_tokens long, ids array<int>"
_ENCODERS: dict[tuple[str, str, bool], "Encoder"] = {}


def _open(ids: list[bytes | None]) -> list[int]:
    """The places of None."""
    places, k = [], -1
    try:
        while True:
            k = ids.index(None, k + 1)
            places.append(k)
    except ValueError:
        return places


class Encoder:
    """With `added` the text of an added token is its id, as in the library; without, as in the library with
    `encode_special_tokens` set, it is ordinary text."""

    def __init__(self, path: str, pattern: str, added: bool = False) -> None:
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        # The library cuts a text at its added tokens before anything else.
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} if added else {}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = {mark: struct.pack("<I", i) for mark, i in added.items()}
        self.split = splitter(pattern)
        letters = byte_letters()
        self.letters = np.array([ord(x) for x in letters], "<u2")
        self.known: dict[str, bytes] = dict(self.added)
        # Whether a token begins with a blank; no token holds one behind another character but blanks and line ends.
        names = tokenizer.get_vocab()
        self.blank = np.zeros(max(names.values()) + 1, bool)
        self.blank[[i for name, i in names.items() if name[0] == letters[32]]] = True
        # Whether a token is a line end alone: one that stays so between two pieces has kept them apart.
        self.line = np.zeros(len(self.blank), bool)
        self.line[[i for name, i in names.items() if name == letters[10]]] = True

    def pieces(self, text: str) -> list[str]:
        if not self.marks or not self.marks.search(text):
            return self.split(text)
        parts = self.marks.split(text)
        return [p for part in parts for p in ([part] if part in self.added else self.split(part))]

    def _ids(self, text: str) -> list[int]:
        """The library's model reads bytes as letters."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return [t.id for t in self.model.tokenize(self.letters[raw].tobytes().decode("utf-16-le"))]

    def _learn_rows(self, pieces: list[str], lead: str, leads: np.ndarray, skip: int) -> list[str]:
        """Learn `pieces` some hundred at a time, each behind `lead`: the first of its tokens is in `leads`, and `skip` of them are not its own.

        Returns those whose tokens could not be told apart.
        """
        apart: list[str] = []
        for i in range(0, len(pieces), 300):
            row = pieces[i:i + 300]
            ids = np.array(self._ids(lead + lead.join(row)), "<u4")
            at = np.append(np.flatnonzero(leads[ids]), len(ids))
            if len(at) == len(row) + 1:
                raw, ends = ids.tobytes(), (4 * at).tolist()
                self.known.update({p: raw[x + 4 * skip:y] for p, x, y in zip(row, ends, ends[1:])})
            else:
                apart += row
        return apart

    def learn(self, pieces: set[str]) -> None:
        # Pieces that a blank begins merge alike in a row and alone, so they go to the model together; so do others with line ends between them.
        blank, bare, alone = [], [], []
        for p in pieces:
            (blank if p[0] == " " and not p[-1].isspace() else bare if "\n" not in p and not p[-1].isspace() else alone).append(p)
        alone += self._learn_rows(blank, "", self.blank, 0)
        alone += self._learn_rows(bare, "\n", self.line, 1)
        for piece in alone:
            found = self._ids(piece)
            self.known[piece] = struct.pack(f"<{len(found)}I", *found)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        end = struct.pack("<I", END)
        texts = [t or "" for t in texts]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                size += len(texts[to])
                to += 1
            if len(self.known) > REMEMBERED:
                # Frequent pieces come early, so the older half is worth more.
                self.known = dict(islice(self.known.items(), REMEMBERED // 2))
            split = [self.pieces(t) for t in texts[at:to]]
            got = [list(map(self.known.get, pieces)) for pieces in split]
            open_at = [_open(ids) for ids in got]
            self.learn({pieces[k] for pieces, places in zip(split, open_at) for k in places})
            for pieces, ids, places in zip(split, got, open_at):
                for k in places:
                    ids[k] = self.known[pieces[k]]
                ids.append(end)
                yield b"".join(ids)
            at = to


def encoder(path: str, pattern: str, added: bool) -> Encoder:
    if (path, pattern, added) not in _ENCODERS:
        _ENCODERS[path, pattern, added] = Encoder(path, pattern, added)
    return _ENCODERS[path, pattern, added]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, pattern: str, added: bool = True) -> None:
    """Write the ids of `docs` (doc_id, text) below `folder`, in ascending order of doc_id, then text; nulls first.

    Null texts are empty and have the end id alone; repeated rows are written as often as they come.  `added`: see `Encoder`.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer, pattern, added)
        for batch in batches:
            ids = list(own.encode(batch.column(1).to_pylist()))
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), shard, np.int32)), pa.array(before + ends - sizes), pa.array(sizes), lists],
                names=["doc_id", "shard", "before", "n_tokens", "ids"])
            before += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(lean(run), _FILES).write.options(**WRITER).parquet(folder)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents: row groups and pages without them are skipped."""
    return spark.read.schema(_FILES).parquet(folder).where(F.col("doc_id").isin(doc_ids))


def read_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens) from the metadata columns alone."""
    rows = spark.read.schema(_FILES).parquet(folder).select("doc_id", "shard", "before", "n_tokens")
    return rows.join(_shard_starts(rows), "shard").select("doc_id", "shard", (F.col("first") + F.col("before")).alias("start"), "n_tokens")


def _shard_starts(rows: DataFrame) -> DataFrame:
    """(shard, first): the ids before each shard.  Shards are numbered by range; there is one row per written file."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("first"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every written document, from the files."""
    ship(spark)
    rows = spark.read.schema(_FILES).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sizes = np.diff(at)
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("before"), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "before", "n_tokens", "ids_crc32"])

    read = rows.select("doc_id", "shard", "before", "ids").mapInArrow(
        lean(run), "doc_id long, shard int, before long, n_tokens long, ids_crc32 long")
    return read.join(_shard_starts(rows), "shard").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.PATTERN)
    return read_digests(spark, folder)
