"""Codes of vectors by codebooks of their parts, trained in exact integers over flat blocks in Hilbert order.

Each component x becomes floor(1024 x) and a vector is cut into equal parts.  Of every part position all rows are put in the
order of a Hilbert curve over many tasks and cut into flat blocks, which store their least and greatest components (a
box) and their sum.  A round sends the codebooks to the blocks.  An entry that is farther from the nearest point of a box than some other entry
is from its farthest can be nearest to no row of the block; the others are its shortlist.  A block with one entry left is
added to it by its stored sum, in any other the rows are compared with the shortlist alone.  Tasks add up rows per
entry, entries meet by key, and the driver holds the codebooks only.

Distances are integers: in doubles and longs while the components are small enough for these to be exact, else in
Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import lean
from ledger_spark.session import written

PARTS, ENTRIES, ROUNDS, SCALE_BITS = 4, 256, 4, 10
#: Rows of a block, and bits of each component in the Hilbert order.  Neither changes a result.
BLOCK, CURVE_BITS = 64, 4
_MOST = (1 << 63) - 1
Books = list[np.ndarray]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), as longs where all fit."""
    x = np.asarray(x, np.float64)
    if not x.size or np.abs(x).max() < 2.0 ** 50:
        return np.floor(np.ldexp(x, SCALE_BITS)).astype(np.int64)
    exact = [math.floor(v * 1024) if abs(v) < 2.0 ** 50 else int(v) << SCALE_BITS for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _kind(*arrays: np.ndarray) -> type:
    """The cheapest number type in which squared distances between rows of these integers are exact."""
    peak = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    most = 4 * peak * peak * max(1, arrays[0].shape[-1])
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry."""
    kind = _kind(rows, entries)
    rows, entries = rows.astype(kind), entries.astype(kind)
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box (a row of `low` and `high`) the entries that may be nearest to a point in it."""
    kind = _kind(low, high, entries)
    low, high, entries = low.astype(kind)[:, None], high.astype(kind)[:, None], entries.astype(kind)[None]
    outside = np.maximum(np.maximum(low - entries, entries - high), low.dtype.type(0) if kind is not object else 0)
    across = np.maximum(np.abs(entries - low), np.abs(high - entries))
    return (outside * outside).sum(2) <= (across * across).sum(2).min(1)[:, None]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of `points` (integers of `bits` bits) on a Hilbert curve, as rows of bytes (Skilling's transform)."""
    axes = [a.copy() for a in points.T]
    if not axes:
        return np.zeros((len(points), 0), np.uint8)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i, axis in enumerate(axes):
            on = (axis >> bit) & 1 == 1
            swap = np.where(on, 0, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(on, below, swap)
            if i:
                axis ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    flat = [((axis ^ turn) >> bit) & 1 for bit in range(bits - 1, -1, -1) for axis in axes]
    return np.packbits(np.stack(flat, 1).astype(np.uint8), axis=1)


def _cuts(size: int, parts: int) -> list[tuple[int, int]]:
    width = -(-size // parts)
    return [(min(size, p * width), min(size, (p + 1) * width)) for p in range(parts)]


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector is there and finite, as floats or doubles."""
    inner = vectors.schema["embedding"].dataType.elementType
    to = "array<float>" if isinstance(inner, T.FloatType) else "array<double>"
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))  # NaN is greater than any
    return vectors.select("vec_id", label, F.col("embedding").cast(to).alias("embedding")).where(
        F.col("embedding").isNotNull() & F.forall("embedding", finite))


def _seeds(kept: DataFrame, entries: int) -> list:
    """The vectors of the smallest vec_ids, nulls last; of one id by their components."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding")
    return [r[0] for r in first.collect()]


def _blocks(kept: DataFrame, cuts: list[tuple[int, int]], low: list[float], high: list[float]) -> DataFrame:
    """Blocks of each part position in Hilbert order."""
    types = {f.name: f.dataType for f in kept.schema.fields}
    id_type, label_type, number = types["vec_id"], types["label"], types["embedding"].elementType
    spelled = id_type.simpleString(), label_type.simpleString(), number.simpleString()
    arrow_id, arrow_label, arrow_number = map(to_arrow_type, (id_type, label_type, number))
    room = 1 << CURVE_BITS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = [max(h - lo, 1e-300) for lo, h in zip(low, high)]
        for batch in batches:
            vectors = batch.column(3)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
            spot = np.clip((flat.astype(np.float64) / 2 - np.array(low) / 2) / (np.array(width) / 2) * room, 0, room - 1).astype(np.int64)
            for p, (a, b) in enumerate(cuts):
                keys = hilbert_keys(spot[:, a:b], CURVE_BITS)
                piece = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * (b - a),
                                                 pa.array(flat[:, a:b].ravel(), arrow_number))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), p, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), *batch.columns[:3], piece],
                    names=["part", "key", "row", "vec_id", "label", "piece"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            out = []
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for i in range(start, end, BLOCK):
                    some = batch.slice(i, min(BLOCK, end - i))
                    numbers = some.column(5).flatten()
                    rows = numbers.to_numpy(zero_copy_only=False).reshape(len(some), -1)
                    out.append((int(part[i]), some.column(2).to_pylist(), some.column(3).to_pylist(), some.column(4).to_pylist(), numbers,
                                rows.min(0), rows.max(0), [str(x) for x in whole(rows).astype(object).sum(0)]))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(arrow_id), pa.list_(arrow_label), *[pa.list_(arrow_number)] * 3,
                         pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["part", "rows", "vec_ids", "labels", "numbers", "low", "high", "total"])

    placed = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding").mapInArrow(
        lean(place), "part int, key binary, row long, vec_id {}, label {}, piece array<{}>".format(*spelled))
    # The row number spreads equal vectors over tasks.
    dealt = placed.repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row").select(
        "part", "key", "row", "vec_id", "label", "piece")
    return written(dealt.mapInArrow(lean(cut), "part int, rows array<long>, vec_ids array<{0}>, labels array<{1}>, numbers array<{2}>, "
                                               "low array<{2}>, high array<{2}>, total array<string>".format(*spelled)), "blocks")


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(part, boxes' least, boxes' greatest, blocks) for runs of blocks of one part."""
    part = batch.column("part").to_numpy()
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for i in range(start, end, 64):
            some = batch.slice(i, min(64, end - i))
            box = [whole(some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)) for c in ("low", "high")]
            yield int(part[i]), *box, some


def _rows(blocks: pa.RecordBatch, i: int, size: int) -> np.ndarray:
    return whole(blocks.column("numbers")[i].values.to_numpy(zero_copy_only=False).reshape(size, -1))


def _nearest(rows: np.ndarray, entries: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry of `which`, ties to the lower index, and its distance."""
    far = distances(rows, entries[which])
    best = far.argmin(1)
    return which[best], far[np.arange(len(rows)), best]


def _round(blocks: DataFrame, books: Books) -> Books:
    """The codebooks after one round."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[0] * len(b) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for p, low, high, some in _block_rows(batch):
                lists = shortlists(low, high, books[p])
                for i, size in enumerate(len(r) for r in some.column("rows")):
                    which = np.flatnonzero(lists[i])
                    if len(which) == 1:
                        entry = int(which[0])
                        counts[p][entry] += size
                        sums[p][entry] += np.array([int(x) for x in some.column("total")[i].as_py()], object)
                        continue
                    rows = _rows(some, i, size)
                    near, _ = _nearest(rows, books[p], which)
                    if rows.dtype != object and np.abs(rows).max(initial=0) > 1 << 50:
                        rows = rows.astype(object)
                    order = np.argsort(near, kind="stable")
                    at = np.flatnonzero(np.diff(near[order], prepend=-1))
                    added = np.add.reduceat(rows[order], at, axis=0) if rows.shape[1] else np.zeros((len(at), 0), object)
                    for entry, n, s in zip(near[order][at].tolist(), np.diff(np.append(at, size)).tolist(), added):
                        counts[p][entry] += n
                        sums[p][entry] += s
        out = [(p, e, n, [str(x) for x in sums[p][e]]) for p, of in enumerate(counts) for e, n in enumerate(of) if n]
        if out:
            yield _added_batch(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for p, e, n, s in zip(*(c.to_pylist() for c in batch.columns)):
                had = held.setdefault((p, e), [0, [0] * len(s)])
                had[0] += n
                had[1] = [x + int(y) for x, y in zip(had[1], s)]
        if held:
            yield _added_batch([(p, e, n, [str(x) for x in s]) for (p, e), (n, s) in held.items()])

    schema = "part int, entry int, n long, total array<string>"
    added = blocks.select("part", "rows", "numbers", "low", "high", "total").mapInArrow(lean(tally), schema).repartition(
        "part", "entry").mapInArrow(lean(meet), schema).collect()  # a row for each entry at most
    after = [b.astype(object) for b in books]
    for r in added:
        after[r.part][r.entry] = [int(x) // r.n for x in r.total]
    return [_compact(b) for b in after]


def _added_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "entry", "n", "total"])


def _compact(book: np.ndarray) -> np.ndarray:
    """Longs where all entries fit."""
    return book.astype(np.int64) if not book.size or max(map(abs, book.ravel().tolist())) < 1 << 62 else book


def _assigned(blocks: DataFrame, books: Books, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """(row, vec_id, label, code, error): the nearest entries of all parts."""
    arrow_id, arrow_label = to_arrow_type(id_type), to_arrow_type(label_type)
    most = _MOST // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, low, high, some in _block_rows(batch):
                lists = shortlists(low, high, books[p])
                codes, errors = [], []
                for i, size in enumerate(len(r) for r in some.column("rows")):
                    near, far = _nearest(_rows(some, i, size), books[p], np.flatnonzero(lists[i]))
                    codes += (near << 8 * (len(books) - 1 - p)).tolist()
                    errors += [min(int(x), most) for x in far]
                yield pa.RecordBatch.from_arrays(
                    [some.column("rows").flatten(), some.column("vec_ids").flatten().cast(arrow_id), some.column("labels").flatten().cast(arrow_label),
                     pa.array(codes, pa.int64()), pa.array(errors, pa.int64())], names=["row", "vec_id", "label", "code", "error"])

    parts = blocks.select("part", "rows", "vec_ids", "labels", "numbers", "low", "high").mapInArrow(
        lean(run), f"row long, vec_id {id_type.simpleString()}, label {label_type.simpleString()}, code long, error long")
    return parts.groupBy("row", "vec_id", "label").agg(F.sum("code").alias("code"), F.sum("error").alias("error"))


def codebooks_of(vectors: DataFrame) -> tuple[DataFrame | None, Books]:
    """The blocks and final codebooks of `vectors` (vec_id, embedding, label if it is there); None and [] if no vector is valid."""
    kept = _valid(vectors)
    seeds = _seeds(kept, ENTRIES)
    if not seeds:
        return None, []
    size = len(seeds[0])
    kept = kept.where(F.size("embedding") == size)
    if any(len(s) != size for s in seeds):
        seeds = _seeds(kept, ENTRIES)
    cuts = _cuts(size, PARTS)
    start = whole(np.array(seeds, np.float64).reshape(len(seeds), size))
    points = np.array(seeds, np.float64).reshape(len(seeds), size)
    blocks = _blocks(kept, cuts, points.min(0).tolist(), points.max(0).tolist())
    books = [_compact(start[:, a:b].astype(object)) for a, b in cuts]
    for _ in range(ROUNDS):
        books = _round(blocks, books)
    return blocks, books


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per valid row of `vectors` (vec_id, embedding, label; others are ignored).

    Rows whose vector is null or holds null or non-finite components go, and so do those whose vector has another length than
    that of the smallest vec_id.  A length that 4 does not divide has shorter last parts.  Null vec_ids come after all
    others; rows of one vec_id are ordered by their components, and each repeated row is a row of its own.  `label_error` adds up the errors of
    equal labels, nulls together.  Errors beyond a long are given as about the greatest one.  With fewer than
    256 rows codebooks have as many entries; without valid rows there is no result row.
    """
    ship(vectors.sparkSession)
    blocks, books = codebooks_of(vectors)
    fields = {f.name: f.dataType for f in vectors.schema.fields}
    if blocks is None:
        return vectors.sparkSession.createDataFrame([], T.StructType([
            T.StructField("vec_id", fields["vec_id"]), *[T.StructField(n, t) for n, t in (
                ("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]]))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    rows = written(_assigned(blocks, books, fields["vec_id"], fields.get("label", T.IntegerType())), "codes")
    most = F.lit(_MOST).cast("decimal(38,0)")
    totals = rows.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(19,0)")), most).cast("long").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(k: int) -> str:
    return f"""near{k} as materialized (select r, p, x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) as n
  from parts join book{k} using (p) group by r, p, x),
book{k + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from book{k} b left join (
  select p, e, list(((s - ((s % n + n) % n)) // n)::bigint order by i) as c from (
    select p, n.e as e, i, sum(x[i])::hugeint as s, count(*) as n from near{k}, unnest(range(1, len(x) + 1)) t(i) group by all) group by p, e) m using (p, e))"""


SQL11 = f"""
with kept as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] as x from kept, range({PARTS}) t(p)),
book0 as materialized (select p, r - 1 as e, x as c from parts where r <= {ENTRIES}),
{', '.join(_round_sql(k) for k in range(ROUNDS))},
final as (select r, p, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) as n
  from parts join book{ROUNDS} using (p) group by r, p),
rows_ as (select r, string_agg(lpad(lower(to_hex(n.e::bigint)), 2, '0'), '' order by p) as code, sum(n.d)::bigint as error from final group by r),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join rows_ using (r), digest
"""
