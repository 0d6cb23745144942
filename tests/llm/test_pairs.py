"""Set join, leak matching and nearest neighbours against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledger_spark.llm import blob_ledger, decontaminate, graph, jaccard_join, projection_forest
from ledger_spark.session import scratch_path, shared_dir, written

from .conftest import SF


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def linked(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_join_of_edited_copies(spark, k, percent, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(14):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 150, 400, 1100]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(text)
            for _ in range(rng.randrange(0, 1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == linked(rows, k, percent)


def test_join_query(spark, queries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries["op5_jaccard_join"](spark, SF).collect()}
    assert got == linked(rows, 4, 85)


def test_join_of_odd_rows(spark, odd, nothing):
    got = sorted(jaccard_join.linked_groups(odd).collect(), key=str)
    assert len(got) == odd.count()
    assert [r.component_id for r in got if r.doc_id in (4, 5)] == [4, 4, 4]
    assert [r.component_id for r in got if r.doc_id is None] == [4]
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (1, 2, 3))
    assert jaccard_join.linked_groups(nothing).count() == 0


def test_rows_without_id_carry_links(spark):
    words = [f"w{i}" for i in range(200)]
    edit = lambda k, n: " ".join(words[:k] + [f"e{k}x{i}" for i in range(n)] + words[k + n:])
    rows = [(1, edit(0, 0)), (None, edit(60, 9)), (2, " ".join(edit(60, 9).split()[:120] + [f"z{i}" for i in range(9)] + words[129:])),
            (None, "all by itself here and now for once"), (None, edit(60, 9))]
    sets = [shingles(t, 4) for _, t in rows[:3]]
    part = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert part(sets[0], sets[1]) and part(sets[1], sets[2]) and not part(sets[0], sets[2])
    got = jaccard_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(1, 1), (2, 1), (None, 1), (None, 1), (None, None)], key=str)


def test_join_keeps_only_tables_that_are_still_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = set(os.listdir(shared_dir(spark)))
    got = jaccard_join.linked_groups(docs)
    left = {n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before}
    assert got.count() == docs.count()
    assert not left & {"shingles", "kept", "matrix", "outside", "sets"} and {"rows", "classes"} <= left


def test_join_keeps_loose_classes_where_they_are_and_makes_the_matrix_in_passes(spark, monkeypatch):
    rng = random.Random(5)
    texts = [[rng.choice([f"w{i}" for i in range(500)]) for _ in range(30)] for _ in range(60)]
    near = [texts[0][:29] + ["x"], texts[1], texts[2][:15] + ["y"] + texts[2][16:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + near)]
    made = []

    def noted(df, name):
        table = written(df, name)
        made.append((name, table.collect() if name in ("kept", "matrix") else None))
        return table

    monkeypatch.setattr(jaccard_join, "written", noted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), 2, 70).collect()}
    assert got == linked(rows, 2, 70)
    # Only classes of several rows or of a group travel to learn it: those of texts 0 to 2 and their copies.
    first = next(t for name, t in made if name == "kept")
    assert 3 <= len({r.cid for r in first}) <= 8
    slices = [t for name, t in made if name == "matrix"]
    assert len(slices) == 2 * jaccard_join.SLICES
    for i, t in enumerate(slices):
        assert all(((r.token & (1 << 64) - 1) >> 32) * jaccard_join.SLICES >> 32 == i % jaccard_join.SLICES for r in t)


def test_join_reads_whole_sets_in_one_python_step(spark):
    texts = {1: "a b c d e f", 2: "x", 3: None, 4: "", 5: "a b c d e f g"}
    docs = spark.createDataFrame(list(texts.items()), "key long, text string")
    cids = {k: jaccard_join._class_id(t) for k, t in zip(texts, jaccard_join.shingle_sets(pa.array(texts.values(), pa.string()), 4)) if len(t)}
    # Class 1 is asked for by its own key and, as by a chance of keys, by that of another text.
    wanted = spark.createDataFrame([(1, cids[1]), (5, cids[1]), (2, cids[2]), (3, 7)], "rep long, cid long")
    got = jaccard_join._tokens_of(docs, wanted, 4)
    assert sorted((r.cid, len(r.tokens)) for r in got.collect()) == sorted([(cids[1], 3), (cids[2], 1)])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_empty_frames_need_no_python_workers(spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    docs = spark.range(2).selectExpr("id as doc_id", "'the cat sat on the mat' as text")
    for of, rows in ((items, 2), (items.where("false"), 0)):
        got = decontaminate.contaminated(docs, of)
        assert got.schema.simpleString() == "struct<doc_id:bigint,item_id:bigint,distance:bigint>" and got.count() == rows
        assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    table = blob_ledger._table(spark, scratch_path(spark, "none"), "blob string, place long")
    assert table.schema.simpleString() == "struct<blob:string,place:bigint>" and table.count() == 0
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (200, 201), (201, 202), (7, None)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_long_chains(spark, seed):
    rng = random.Random(seed)
    ids = [rng.randrange(1 << 62) for _ in range(1000)]
    low = sorted(ids)[:2]  # the two smallest ids at the two ends
    ids = [low[0], *[i for i in ids if i not in low], low[1]]
    hub = [(1 << 62, (1 << 62) + i) for i in range(1, 50)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(list(zip(ids, ids[1:])) + hub, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, low[0]), **dict.fromkeys([1 << 62, *[b for _, b in hub]], 1 << 62)}


def distance(a, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_against_brute_force():
    rng = random.Random(4)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([12, 35, 70])))) for i in range(25)]
    matcher = decontaminate.Matcher(items, 0.15)
    for _ in range(60):
        text = [rng.choice(letters) for _ in range(80)]
        item = list(rng.choice(items)[1])
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(item))
            item[at:at + rng.choice([0, 1, 1])] = rng.choice(["", "x", "ab"])
        text = decontaminate.normal("".join(text[:40] + item + text[40:]))
        want = {}
        for i, t in items:
            t = decontaminate.normal(t)
            d = distance(t, text)
            if t and d <= int(0.15 * len(t)):
                want[i] = d
        assert matcher.matches(text) == want


def test_leaks_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "The cat  sat on\nthe mat again"), (2, None), (3, ""), (None, "the cat"), (4, "the cat sat on the mat again")],
                                  "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontaminate.contaminated(odd, items).collect())
    assert got == sorted((d, i, 0) for d in (4, 4, 5, 0) for i in (1, 4))
    blocks = decontaminate.contaminated(odd, items, chars=1)
    assert sorted((r.doc_id or 0, r.item_id, r.distance) for r in blocks.collect()) == got
    assert decontaminate.contaminated(nothing, items).count() == decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_leak_query_finds_whole_passages(spark, queries):
    items = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(r.doc_id, i) for r in docs for i, t in items.items() if t in decontaminate.normal(r.text)}
    got = {(r.doc_id, r.item_id) for r in queries["op9_decontaminate"](spark, SF).collect()}
    assert want and want == {x for x in got if x in want} and all(
        distance(items[i], decontaminate.normal(next(r.text for r in docs if r.doc_id == d))) <= 0.1 * len(items[i]) for d, i in got)


def test_neighbours(spark, queries):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, points = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = queries["op3_projection_forest"](spark, SF).collect()
    hits = total = 0
    for q in (i for i in ids if i % 20 == 0):
        scores = points @ points[ids.index(q)]
        best = [ids[j] for j in np.lexsort((ids, -scores)) if ids[j] != q][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21)) and [r[2] for r in own] == sorted((r[2] for r in own), reverse=True)
        assert all(abs(s - scores[ids.index(v)]) < 1e-9 for _, v, s in own)
        hits, total = hits + len({v for _, v, _ in own} & set(best)), total + 20
    assert hits >= 0.9 * total


def test_neighbours_of_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [0.5, 0.5]),
                                                  (105, [1.0]), (106, []), (5, [1.0, 0.0]), (None, [1.0, 1.0])]
    vectors = projection_forest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = projection_forest.nearest(vectors, vectors.where("vec_id in (0, 104)"), k=20).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [*range(1, 21), *range(20)]
    few = projection_forest.nearest(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [1, 2]
    assert projection_forest.nearest(vectors.where("false"), vectors).count() == 0
