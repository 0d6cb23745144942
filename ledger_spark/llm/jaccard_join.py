"""N-gram Jaccard self-join with a token-group matrix.

Documents are sets of hashed word shingles.  Equal sets form one class.  Classes that look alike (most of eight
smallest hashes agree) are compared with the class the group shares and, where they really link, become one group; the rest
are groups of their own.  Of each set a part is then kept, chosen by hash so that every set keeps the same
tokens, and large enough that two sets that link must share some of it: if a set of n tokens links with another,
at most d = n - ceil(t n) of its tokens are missing there.  The token-group matrix holds which groups' unions have
a token.  A set of which more than d kept tokens lie in no other group's union links with no other group and is
done: that is nearly all of them.  The others open the groups with which they share one of their d + 1 rarest
kept tokens, and the pairs found are compared on their whole sets.  Links between members of one group need no
search, as only connection is asked for.

Every bound is exact, so no link between different groups is lost.  A token in many sets is counted where it is
read; at most two rows of it per batch travel on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledger_spark.llm.graph import components
from ledger_spark.llm.shipping import ship
from ledger_spark.llm.texts import U64, lean, mix, release, shingle_sets
from ledger_spark.session import dropped, written

HASHES = 8
ALIKE = 4
#: Sizes from which fewer tokens are kept, and the share kept beyond 1 - t, which covers the chance spread at each size.
LEVELS = ((0, 1.0), (64, 0.35), (256, 0.10), (1024, 0.05))
BUCKET_TOKENS = 200_000
BATCH_TOKENS = 250_000
SKETCH_BITS = 24
#: The token-group matrix is made in so many passes over the kept tokens, of which only one's stand on disk in shuffle files.
SLICES = 4
_SALTS = [U64(x) for x in np.random.default_rng(11).integers(1, 1 << 62, 64) * 2 + 1]
_SETS = ("key long, doc_id long, n long, cid long, " + ", ".join(f"m{i} long" for i in range(HASHES))
         + ", subs array<struct<kept:int,need:int,tokens:array<bigint>>>")


def _level(n: int) -> int:
    return max(i for i, (least, _) in enumerate(LEVELS) if n >= least)


def _kept(tokens: np.ndarray, percent: int) -> list[dict]:
    """The kept parts of a set, one for each level that a set it could link with may have; `need` is d + 1."""
    n = len(tokens)
    if 100 * n < percent * (n + 1):  # too small to link with any set but an equal one
        return []
    missing = n - -(-percent * n // 100)
    parts = []
    for level in range(_level(-(-percent * n // 100)), _level(100 * n // percent) + 1):
        share = 1 - percent / 100 + LEVELS[level][1]
        part = tokens if share >= 1 else tokens[tokens < U64(int(share * (1 << 64)))]
        parts.append({"kept": len(part), "need": missing + 1, "tokens": mix(part ^ _SALTS[level]).view(np.int64)})
        if len(part) <= missing:  # too few to bind: such sets meet each other on all their tokens
            parts.append({"kept": n, "need": missing + 1, "tokens": mix(tokens ^ _SALTS[level + 32]).view(np.int64)})
    return parts


def _class_id(tokens: np.ndarray) -> int:
    sums = [int(mix(tokens ^ _SALTS[20 + i]).sum(dtype=U64)) for i in range(2)]
    return int(mix(np.array([sums[0] * 31 + sums[1] * 17 + len(tokens) * 7 & (1 << 64) - 1], U64)).view(np.int64)[0])


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, doc_id, n, cid, m0..m7, subs) of each row of `docs` (key, doc_id, text): set size, class, smallest hashes, kept parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tokens in shingle_sets(batch.column(2), words):
                if len(tokens):
                    low = [int((mix(tokens ^ _SALTS[i]) >> U64(1)).min()) for i in range(HASHES)]
                    rows.append((len(tokens), _class_id(tokens), *low, _kept(tokens, percent)))
                else:
                    rows.append((0, 0, *[None] * HASHES, []))
            columns = list(zip(*rows)) if rows else [[] for _ in range(HASHES + 3)]
            parts = [p for row in columns[-1] for p in row]
            tokens = pa.ListArray.from_arrays(
                np.cumsum([0, *[p["kept"] for p in parts]]).astype(np.int32),
                np.concatenate([np.zeros(0, np.int64), *[p["tokens"] for p in parts]]))
            parts = pa.StructArray.from_arrays(
                [pa.array([p["kept"] for p in parts], pa.int32()), pa.array([p["need"] for p in parts], pa.int32()),
                 tokens], names=["kept", "need", "tokens"])
            subs = pa.ListArray.from_arrays(np.cumsum([0, *map(len, columns[-1])]).astype(np.int32), parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns[:-1]], subs],
                names=["key", "doc_id", "n", "cid", *[f"m{i}" for i in range(HASHES)], "subs"])

    return docs.select("key", "doc_id", "text").mapInArrow(lean(run), _SETS)


def _slots(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).view(U64)) & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _in_sketch(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    slot = _slots(ids)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _sketch(ids: DataFrame) -> np.ndarray:
    """A bit map of a fixed size with the hash of each id set, made in few tasks and joined on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SKETCH_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << SKETCH_BITS - 3, np.uint8)
    for r in ids.coalesce(8).mapInArrow(lean(run), "bits binary").collect():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def _tokens_of(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, tokens): the whole sets of `classes` (cid, rep), read from the texts of their representatives.

    A sketch of the ids keeps most other texts out of the work and the shuffle; it is of a fixed size, and passes more as it
    fills.  Sifting and reading are one Python step: two of them in one stage would hold twice as many workers, which stay.
    """
    wanted = written(classes.select(F.col("rep").alias("key"), "cid"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(_sketch(wanted.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_sketch(bits.value, batch.column(0))))
            kept = [(k, _class_id(t), t.view(np.int64)) for k, t in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words))
                    if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()),
                                              pa.array([k[2] for k in kept], pa.list_(pa.int64()))],
                                             names=["key", "cid", "tokens"])

    passed = docs.select("key", "text").mapInArrow(lean(run), "key long, cid long, tokens array<bigint>")
    return passed.join(wanted, ["key", "cid"]).select("cid", "tokens")


def _wanted(docs: DataFrame, classes: DataFrame, cids: DataFrame, words: int) -> DataFrame:
    return written(_tokens_of(docs, classes.select("cid", "rep").join(cids, "cid"), words), "sets")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b: classes) whose whole sets (cid, tokens) link."""
    left = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(
        100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _alike(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class and the most central classes of its hash groups with which it agrees most often.

    The central class of a hash group is the one whose hashes are shared most: among edited copies of one text that is the
    least edited one, with which more copies link than with any other.
    """
    hashes = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(HASHES)])
    keyed = classes.select("cid", F.inline(hashes)).select("cid", "i", "m")
    sizes = keyed.groupBy("i", "m").agg(F.count("*").alias("size")).where("size > 1")
    grouped = written(keyed.join(sizes, ["i", "m"]), "hash-groups")
    score = grouped.groupBy("cid").agg(F.sum("size").alias("score"))
    firsts = grouped.join(score, "cid").groupBy("i", "m").agg(F.max(F.struct("score", "cid"))["cid"].alias("b"))
    agree = grouped.join(firsts, ["i", "m"]).where("cid <> b").groupBy("cid", "b").agg(F.count("*").alias("hits"))
    ends = [classes.select(F.col("cid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", *[f"m{i}" for i in range(HASHES)])])
            for x in "ab"]
    same = sum((F.col(f"a_m{i}") == F.col(f"b_m{i}")).cast("int") for i in range(HASHES))
    return agree.select(F.col("cid").alias("a"), "b").join(ends[0], "a").join(ends[1], "b").where(
        (same >= ALIKE) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))).select("a", "b")


def _matrix_rows(kept: DataFrame, buckets: int, part: int = 0, parts: int = 1, bits: Broadcast | None = None) -> DataFrame:
    """(id, many, token): the kept tokens that lie in the unions of two groups or more, of one of `parts` equal ranges of tokens.

    `id` is the group; one that has not `many` classes is named by its only one.  Batches of sets are cut into buckets of tokens and travel as byte
    strings; a token that two groups of a batch share is marked there and then, and two rows of it travel on.  With `bits`, rows of `kept` that
    are `loose` are left out if the sketch has their class, as these come again with their group.
    """
    names = ["bucket", "tokens", "groups", "flags"]

    def runs(tokens, groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end of the rows of each token, and whether two groups have it; rows are sorted by token and group."""
        at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        to = np.append(at[1:], len(tokens))
        return at, to, groups[at] != groups[to - 1]

    def cut(tokens, groups, flags) -> pa.RecordBatch:
        order = np.lexsort((groups, tokens))
        tokens, groups, flags = tokens[order], groups[order], flags[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = ~((flags[1:] & 1).astype(bool) & (tokens[1:] == tokens[:-1]) & (groups[1:] == groups[:-1]))
        tokens, groups, flags = tokens[fresh], groups[fresh], flags[fresh]
        at, to, shared = runs(tokens, groups)
        flags = flags | (np.repeat(shared, to - at).astype(np.uint8) << 2)
        # Marked rows only pass through, spread evenly; a copy of the first and the last of each marks the others' rows.
        witness = np.concatenate([at[shared], to[shared] - 1])
        own = (tokens.view(U64) % U64(buckets)).astype(np.int64)
        place = (mix(tokens.view(U64) ^ (groups.view(U64) * U64(0x9E3779B97F4A7C15))) % U64(buckets)).astype(np.int64)
        spot = np.concatenate([np.where(flags & 4, place, own), own[witness]])
        pick = np.concatenate([np.arange(len(tokens)), witness])
        kind = np.concatenate([flags, flags[witness] & 1 | 8])
        order = np.argsort(spot, kind="stable")
        pick, kind, spot = pick[order], kind[order], spot[order]
        edges = np.append(np.flatnonzero(np.diff(spot, prepend=-1)), len(spot))
        slices = list(zip(edges[:-1], edges[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(spot[edges[:-1]], pa.int64()), *[pa.array([x[i:j].tobytes() for i, j in slices], pa.binary())
                                                       for x in (tokens[pick], groups[pick], kind)]], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if bits is not None:
                loose = batch.column("loose").to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(~(loose & _in_sketch(bits.value, batch.column("g")))))
            tokens = batch.column("tokens")
            counts = np.diff(tokens.offsets.to_numpy())
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            many = batch.column("many").to_numpy(zero_copy_only=False).astype(np.uint8)
            here = (flat.view(U64) >> U64(32)) * U64(parts) >> U64(32) == part
            held.append([x[here] for x in (flat, np.repeat(batch.column("g").to_numpy(), counts), np.repeat(many, counts))])
            size += len(held[-1][0])
            if size >= BATCH_TOKENS:
                yield cut(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield cut(*map(np.concatenate, zip(*held)))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = (("tokens", np.int64), ("groups", np.int64), ("flags", np.uint8))
        tokens, groups, flags = (np.concatenate([np.frombuffer(b, t) for b in frame[c]]) for c, t in kinds)
        through = (flags & 4).astype(bool)
        out = [(groups[through], flags[through] & 1, tokens[through])]
        tokens, groups, flags = tokens[~through], groups[~through], flags[~through]
        order = np.lexsort((groups, tokens))
        tokens, groups, flags = tokens[order], groups[order], flags[order]
        if len(tokens):
            at, to, shared = runs(tokens, groups)
            shared = np.repeat(shared, to - at) & ((flags & 8) == 0)
            out.append((groups[shared], flags[shared] & 1, tokens[shared]))
        groups, many, tokens = map(np.concatenate, zip(*out))
        out = pd.DataFrame({"id": groups, "many": many.astype(bool), "token": tokens})
        release()
        return out

    dealt = kept.select("g", "many", "tokens", *["loose"] * (bits is not None)).mapInArrow(lean(deal), "bucket long, tokens binary, groups binary, flags binary")
    return dealt.groupBy("bucket").applyInPandas(meet, "id long, many boolean, token long")


def linked_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of `docs` (doc_id, text; other columns are ignored).

    Two rows link when 100 x shared >= percent x united distinct shingles of `words` words.  `component_id` is the
    smallest doc_id that links lead to.  Null or empty text: no shingles, its own component.  A row without doc_id
    links like any other, so links through it count; it takes no part in naming a component (null if none has an id).
    Repeated rows come back as often as they came.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    # Classes are fetched by a key of id and text that every row has; rows that share one by chance are told apart by class.
    docs = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(shingle_table(docs, words, percent), "shingles")
    classes = written(sets.where("n > 0").groupBy("cid").agg(
        F.min("key").alias("rep"), F.min("doc_id").alias("name"), F.count("*").alias("copies"), F.min("n").alias("n"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(HASHES)]),
        "classes")
    rows = written(sets.select("doc_id", "n", "cid"), "rows")
    alike = written(_alike(classes, percent), "alike")
    ends = alike.select(F.col("a").alias("cid")).union(alike.select("b")).distinct()
    whole = _wanted(docs, classes, ends, words)
    links = written(_verified(whole, alike, percent), "links")
    dropped(whole)
    groups = components(links)
    placed = _placed(classes, groups)
    found = _between(docs, sets, placed, classes, words, percent)
    labels = components(links.union(found))
    return _answer(rows, classes, labels)


def _placed(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(cid, key, n, g, many, loose): the group of each class and whether it has many; `loose`: a class of one row and a group of its own."""
    member = groups.select(F.col("node").alias("cid"), F.col("label").alias("g"))
    return written(classes.select("cid", F.col("rep").alias("key"), "n", "copies").join(member, "cid", "left").select(
        "cid", "key", "n", F.coalesce("g", "cid").alias("g"), F.col("g").isNotNull().alias("many"),
        (F.col("g").isNull() & (F.col("copies") == 1)).alias("loose")), "placed")


def _grouped(sets: DataFrame, placed: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The kept parts (cid, g, many, kept, need, tokens) of the classes that are not loose, one row of each, and a sketch of these classes.

    The others know their group without a join, so they need not travel; some pass the sketch and are joined all the same.
    """
    fixed = placed.where("not loose")
    bits = sets.sparkSession.sparkContext.broadcast(_sketch(fixed.select("cid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_sketch(bits.value, batch.column(0))))

    some = sets.where("size(subs) > 0").select("cid", "key", "subs")
    passed = some.mapInArrow(lean(run), some.schema)
    return written(passed.join(placed.drop("n"), ["cid", "key"]).select("cid", "g", "many", F.explode("subs").alias("sub")).select(
        "cid", "g", "many", "sub.*"), "kept"), bits


def _outside(kept: DataFrame, loose: DataFrame | None = None, bits: Broadcast | None = None) -> DataFrame:
    """(cid, token): the kept tokens of each set that the union of some other group has as well.

    `kept` (cid, g, many, kept, tokens) has a row for each class; or for those in the sketch `bits`, and `loose` (cid, kept, tokens) for all.
    """
    every = kept
    if loose is not None:
        every = loose.select(F.col("cid").alias("g"), F.lit(False).alias("many"), "kept", "tokens", F.lit(True).alias("loose")).union(
            kept.select("g", "many", "kept", "tokens", F.lit(False)))
    total = every.agg(F.sum("kept")).first()[0] or 0
    buckets = max(256, -(-total // (SLICES * BUCKET_TOKENS)))
    slices = [written(_matrix_rows(every, buckets, part, SLICES, bits), "matrix") for part in range(SLICES)]
    marked = functools.reduce(DataFrame.union, slices)
    inside = kept.where("many").select("cid", "g", F.explode("tokens").alias("token")).join(
        marked.where("many").select(F.col("id").alias("g"), "token").distinct(), ["g", "token"]).select("cid", "token")
    outside = written(marked.where("not many").select(F.col("id").alias("cid"), "token").union(inside), "outside")
    dropped(*slices)
    return outside


def _open(kept: DataFrame, outside: DataFrame) -> DataFrame:
    """(cid) of the sets that may link with another group: in some part fewer than `need` tokens are theirs alone."""
    slack = kept.groupBy("cid").agg(F.min(F.col("kept") - F.col("need")).alias("slack"))
    return outside.groupBy("cid").agg(F.count("*").alias("shared")).join(slack, "cid").where("shared > slack").select("cid")


def _between(docs: DataFrame, sets: DataFrame, placed: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of different groups, enough to connect all that such links connect.  `sets` is dropped."""
    kept, bits = _grouped(sets, placed)
    parts = sets.select("cid", F.explode("subs").alias("sub")).select("cid", "sub.*")
    outside = _outside(kept, parts, bits)
    may = written(_open(parts, outside), "open")
    dropped(kept, outside, sets)
    # The sets left over, now with all their tokens: the same bound is several times as tight.
    whole = _wanted(docs, classes, may, words)
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    full = written(whole.join(placed.select("cid", "n", "g", "many"), "cid").select(
        "cid", "g", "many", "n", F.col("n").alias("kept"), need.alias("need"), "tokens"), "kept")
    outside = _outside(full)
    # Joined first: then all is dealt by class, and the rows of open sets alone are made distinct where they are.
    rows = outside.join(_open(full, outside), "cid", "left_semi").join(full.select("cid", "g", "n", "need").distinct(), "cid")
    rows = written(rows.distinct(), "rows")
    dropped(full, outside)
    often = rows.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    one = W.partitionBy("cid")
    # Tokens in the order of how many sets have them; `left` counts those from a token on.
    placed_rows = rows.join(often, "token").withColumn("with", F.count("*").over(one)).withColumn(
        "rank", F.row_number().over(one.orderBy("often", "token")))
    prefix = written(placed_rows.where(F.col("rank") <= F.col("need") - F.col("n") + F.col("with")).select(
        "token", "cid", "g", "n", (F.col("with") - F.col("rank") + 1).alias("left"),
        ((F.col("n") - F.col("with")) / F.col("n")).alias("own")), "prefix")
    dropped(rows)
    central = prefix.groupBy("token").agg(F.min(F.struct("own", "cid", "g", "n", "left")).alias("c")).select("token", "c.*")
    near = _compatible(prefix, central, percent)
    first = written(near.select("a", "b").distinct(), "central")
    more = written(_verified(whole, first, percent), "links")
    joined = components(prefix.select(F.col("cid").alias("a"), F.col("g").alias("b")).distinct().union(more))
    prefix = written(prefix.drop("own").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select(
        "token", "cid", "n", "left", F.coalesce("label", "g").alias("g")), "prefix")
    pairs = written(_compatible(prefix, prefix, percent).where("a < b").select("a", "b").distinct(), "pairs")
    links = written(_verified(whole, pairs, percent).union(more), "links")
    dropped(whole)
    return links


def _compatible(prefix: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups with a common prefix token, from which on enough tokens may be common."""
    other = others.select("token", *[F.col(c).alias(f"{c}2") for c in ("cid", "g", "n", "left")])
    return prefix.join(other, "token").where(
        (F.col("g") != F.col("g2"))
        & ((100 + percent) * F.least("left", "left2") >= percent * (F.col("n") + F.col("n2")))).select(
        F.col("cid").alias("a"), F.col("cid2").alias("b"))


def _answer(sets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    member = classes.join(labels.withColumnRenamed("node", "cid"), "cid").select("cid", "name", "label")
    name = member.groupBy("label").agg(F.min("name").alias("component_id"))
    of = member.join(name, "label").select("cid", "component_id")
    named = classes.join(of, "cid", "left").select("cid", F.coalesce("component_id", "name").alias("component_id"))
    full = sets.where("n > 0").select("doc_id", "n", "cid").join(named, "cid")
    empty = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
