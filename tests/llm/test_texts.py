"""Operators on single texts against plain Python, public libraries, round trips and held-out labels."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from ledger_spark.llm import (blob_ledger, bpe_codec, kneser_ney, language_crf, skip_chain_pii, token_files, warc_bundles)
from ledger_spark.session import scratch_path

from .conftest import SF


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_warc_round_trip(spark, nothing):
    long = "x" * 100
    rows = [(3, "http://a/\r\n b", long), (1, "http://b/é", long), (2, None, None), (4, None, ""), (5, "u", "é" * 49), (6, "u", "é" * 49),
            (None, "n", long), (7, "u", "w" * 600_000), (8, "u", "w" * 600_000), (8, "u", "w" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    index = warc_bundles.written(warc_bundles.write_bundles(warc_bundles.deduplicated(pages), folder), "index")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc_bundles.read_bundles(index, folder).collect()), key=str)
    assert got == sorted([(0, 100, "revisit", 1), (1, 100, "response", None), (2, 0, "response", None), (3, 100, "revisit", 1), (4, 0, "response", None),
                          (5, 98, "response", None), (6, 98, "response", None), (7, 600_000, "response", None), (8, 600_000, "revisit", 7),
                          (8, 600_000, "revisit", 7)], key=str)
    assert [r.url for r in warc_bundles.lookup(index, folder, [3]).collect()] == ["http://a/%0D%0A%20b"]
    bundle = index.where("page_id = 7").first()
    store, _ = warc_bundles.storage(folder)
    with store.open_input_file(bundle.bundle) as file:
        frames = warc_bundles.read_footer(file)
        assert frames[bundle.frame][:2] == (bundle.frame_at, bundle.frame_size)
    empty = warc_bundles.written(warc_bundles.write_bundles(warc_bundles.deduplicated(pages.where("false")), folder), "index")
    assert warc_bundles.read_bundles(empty, folder).count() == 0


def test_language_held_out(spark, queries):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in queries["op2_language_crf"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_chain_posteriors_equal_enumeration():
    rng = np.random.default_rng(1)
    moves, counts = rng.normal(size=(3, 3)), np.array([5, 0, 70, 1])
    emit = rng.normal(size=(76, 3))
    got, at = language_crf.posteriors(emit, counts, moves), 0
    for n in counts:
        ahead, forward = np.full(3, 1 / 3), []
        for e in emit[at:at + n]:
            ahead = (ahead @ np.exp(moves)) * np.exp(e)
            ahead /= ahead.sum()
            forward.append(ahead)
        behind = np.ones(3)
        for i in range(n - 1, -1, -1):
            p = forward[i] * behind
            assert np.allclose(p / p.sum(), got[at + i])
            behind = np.exp(moves) @ (np.exp(emit[at + i]) * behind)
            behind /= behind.sum()
        at += n


def test_language_of_odd_rows(spark, odd, nothing):
    model = language_crf.learned(spark.read.parquet(f"{SF}/documents.parquet"), ~language_crf.held_out())
    got = language_crf.labelled(odd, model).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 6)) for r in got)
    assert got[0].cid == "c" and got[0].source == "x"
    assert language_crf.labelled(nothing, model).count() == 0
    assert language_crf.learned(nothing, ~language_crf.held_out()) is None
    assert {r.lang_pred for r in language_crf.labelled(odd, None).collect()} == {"und"}


ODD = ["", "a" * 5000, "   x\x1c\x1d y\x85z", "日本語テキスト" * 50, "   \n\n  a  ", "don't we'll I'm", "<|endoftext|>", "x\x00y"] + [
    "".join(random.Random(i).choices(" \t\n\r\xa0\x1c\x85 Aa0²😀é一'.", k=60)) for i in range(60)]


def test_codec_equals_the_library():
    own = bpe_codec.Codec(*bpe_codec.default_ranks())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, ids in zip(ODD, own.encode(ODD)):
        assert ids == ",".join(map(str, library.encode_ordinary(text))) and own.decode(ids) == text.encode()


def test_codec_of_odd_rows(spark, odd, nothing):
    path, pattern = bpe_codec.default_ranks()
    got = bpe_codec.encoded(odd, path, pattern).collect()
    assert len(got) == odd.count() and all(r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id in (1, 2))
    assert bpe_codec.encoded(nothing, path, pattern).count() == 0


def test_token_files(spark, queries, odd, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    for text, ids in zip(ODD, own.encode(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    start = 0
    got = {r.doc_id: r for r in queries["op8_token_files"](spark, SF).collect()}
    for doc_id, text in sorted(texts(spark).items()):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = scratch_path(spark, "tokens-test")
    token_files.write_tokens(odd, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = token_files.read_digests(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9] and rows[1].n_tokens == rows[2].n_tokens == 1
    assert {r.doc_id for r in token_files.read_documents(spark, folder, [4, 9]).collect()} == {4, 9}
    assert token_files.read_offsets(spark, folder).count() == 11
    folder = scratch_path(spark, "tokens-test")
    token_files.write_tokens(nothing, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert token_files.read_digests(spark, folder).count() == 0


def secrets(text):
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    found = [(m.start(), i, kind, m.end()) for i, (kind, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


SECRETS = ["secret:token = abcdefgh1", "PassWord='hunter22' é token=short", "AKIA" + "B" * 16 + " AKIAX", "😀 " + "0a" * 12 + "g" + "f" * 23,
           "token = \"" + "ab01" * 10 + "\" x", "api_key=a.b-c_d=/+ apikey : 'zzzzzz'", "\x01\x02token=abcdef\x01", "", None, "AKIA" * 9]


def test_ledger_against_plain_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS * 2)] + [(None, SECRETS[0]), (0, SECRETS[0])], "doc_id long, text string")
    ledger = scratch_path(spark, "ledger-test")
    rows = blob_ledger.spans(docs, ledger).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.found) == secrets((r.text or "").replace("\x01", "\x03").replace("\x02", "\x03"))
    scanned = spark.read.parquet(f"{ledger}/scanned")
    assert scanned.count() == len(set(map(lambda t: t or "", SECRETS)))
    blob_ledger.update(docs.union(spark.createDataFrame([(99, "token=another1")], docs.schema)), ledger)
    assert spark.read.parquet(f"{ledger}/scanned").count() == len(set(map(lambda t: t or "", SECRETS))) + 1
    blob_ledger.update(docs, ledger, version="base-2")
    assert spark.read.parquet(f"{ledger}/scanned").where("rules = 'base-2'").count() == len(set(map(lambda t: t or "", SECRETS)))


def test_ledger_query_runs_no_python(spark, queries):
    plan = queries["op6_blob_ledger"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def personal(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
                           r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True,
                    13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])) % 10 == 0,
                    9 <= len(digits) <= 15][k]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data(spark, queries):
    got = {r.doc_id: r for r in queries["op7_skip_chain_pii"](spark, SF).collect()}
    for doc_id, text in texts(spark).items():
        base = personal(text or "")
        assert got[doc_id].base_sha256 == hashlib.sha256(skip_chain_pii.spelled(base).encode()).hexdigest()
        assert set(filter(None, skip_chain_pii.spelled(base).split(","))) <= set(got[doc_id].spans.split(","))
    odd = ["4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5 999.1.1.1 0001.2.3.4", "+1 (017) 555-7713 call", "a@b a@b.c é x%@y-z.de.", "+" + "1" * 40]
    assert [skip_chain_pii.base_spans(t) for t in odd] == [personal(t) for t in odd]


def test_skip_edges_carry_labels():
    model = skip_chain_pii.train([f"call +1 (0{i % 90 + 10}) 555-{1000 + i} now and again 555-{1000 + i} or {i} apples" for i in range(200)])
    text = "call +1 (017) 555-7713 now. " + "nothing here " * 200 + "555-7713 again"
    assert ("phone" in [skip_chain_pii.KINDS[k] for k, _, _ in skip_chain_pii.extra_spans(model, text, skip_chain_pii.base_spans(text))])
    assert skip_chain_pii.extra_spans(model, "12 apples and 34 pears", []) == []


@pytest.mark.parametrize("times", [1, 8, 40, 300])
def test_skip_hubs_reach_every_repetition(times):
    model = skip_chain_pii.train([f"call +1 (0{i % 90 + 10}) 555-{1000 + i} now and again 555-{1000 + i} or {i} apples" for i in range(200)])
    text = "call +1 (017) 555-7713 now. " + "nothing here 555-7713 at all. " * times
    added = skip_chain_pii.extra_spans(model, text, skip_chain_pii.base_spans(text))
    assert [(k, text[s:e]) for k, s, e in added] == [(skip_chain_pii.KINDS.index("phone"), "555-7713")] * times


def test_similar_tokens_share_labels():
    def number(i):
        return str(2_000_000 + 7919 * i)[:7]

    train = [f"call +1 (0{i % 90 + 10}) {number(i)[:3]}-{number(i)[3:]} now or 1017{number(i)} later, {i} apples, no {9_000_000 + i}" for i in range(200)]
    train += [f"call +1 (017) 5{i:02}-8{i:03} now or 5{i:02}-8{i + 1:03} later, {i} apples" for i in range(10, 90)]
    train += [f"mail und.{i}@mail{i}.example.com or und.{i} at mail{i}.example.com now" for i in range(200)]
    model = skip_chain_pii.train(train)

    def added(text):
        return [text[s:e] for _, s, e in skip_chain_pii.extra_spans(model, text, skip_chain_pii.base_spans(text))]

    far = "nothing here " * 200
    assert added(f"call +1 (017) 555-7713 now {far} or 10175557713 later") == ["10175557713"]
    assert added(f"call +1 (017) 555-7713 now {far} or 555-7714 later") == ["555-7714"]
    assert added(f"mail und.77@mail3.example.com {far} or und.77 now") == ["und.77"]
    assert added(f"{far} no 9000001 and 34 pears") == []
    for a, b, kind in (("(555)-7713", "+1-017-555-7713", 1), ("jo.b@x1.org", "jo.b@y22.net", 2), ("ann1@mail3.org", "bob2@mail3.org", 3),
                       ("4111111111111111", "4111111111111112", 4), ("4111111111111111", "4211111111111111", 5)):
        assert kind in {k for k, _ in set(skip_chain_pii.joint_keys(a)) & set(skip_chain_pii.joint_keys(b))}


def test_skip_hubs_share_in_real_model(spark):
    model = skip_chain_pii.learned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for times in (1, 8, 40):
        text = "call +1 (017) 555-7713 now. " + "nothing here 555-7713 at all. " * times
        assert len(skip_chain_pii.extra_spans(model, text, skip_chain_pii.base_spans(text))) == times


def test_personal_data_of_odd_rows(spark, odd, nothing):
    model = skip_chain_pii.learned(odd)
    got = skip_chain_pii.found(odd, model).collect()
    assert len(got) == odd.count() and all(r.spans == "" for r in got if r.doc_id in (1, 2, 3))
    assert skip_chain_pii.found(nothing, skip_chain_pii.learned(nothing)).count() == 0


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([("abracadabra abra",), ("a bad cab",), (None,), ("",)], "text string")
    folder = scratch_path(spark, "model-test")
    kneser_ney.write_model(docs, folder, 3)
    for context in (b"\0\0", b"ab", b"zz", b"ra"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp(kneser_ney.log_probabilities(folder, keys, 3)).sum() - 1) < 1e-4


def test_quality_query(spark, queries):
    sf = "/root/testdata/sf0.01"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries["op10_kneser_ney"](spark, sf).collect()
    kept = [(good[r.doc_id], r.keep) for r in rows if r.doc_id in good]
    assert np.mean([k for q, k in kept if q == 1]) > 0.95 and np.mean([k for q, k in kept if q == 0]) < 0.3
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (1, 1, 0), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classified(odd, labels).collect()
    assert len(got) == odd.count() and all(r.perplexity is None and not r.keep for r in got if r.doc_id in (1, 2))
    assert not any(r.keep for r in kneser_ney.classified(odd, labels.where("false")).collect())
    assert kneser_ney.classified(nothing, labels).count() == 0


def test_pipeline_stages(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(
        spark.createDataFrame([(20, "the secret = abcdef123456 is here and that is all of it", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0
    changed = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert changed[20].text == "the [SECRET] is here and that is all of it" and changed[20].n_chars == len(changed[20].text)
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert 5 not in kept and kept.count(4) == 2


def test_samples_of_hot_ids(spark):
    from ledger_spark.llm.texts import least_texts
    rows = [("en", f"text {i}") for i in range(50)] + [("en", "hot")] * 300 + [("de", f"wort {i}") for i in range(3)] + [("de", "text 1")]
    got = least_texts(spark.createDataFrame(rows, "of string, text string").repartition(7), 10)
    want = {k: sorted({t for of, t in rows if of == k}) for k in ("de", "en")}
    assert len(got) == len(set(got)) == 14 and all(t in want[k] for k, t in got)
    assert got == least_texts(spark.createDataFrame(rows[::-1], "of string, text string"), 10)
    # All rows without id: no more than the sample comes to the driver, and its texts differ.
    docs = spark.createDataFrame([(None, f"call {i} now", "en") for i in range(4000)] + [(i, f"mail {i}@x.de", "de") for i in range(50)],
                                 "doc_id long, text string, lang string")
    seen = []
    train, learn = skip_chain_pii.train, language_crf.train
    try:
        skip_chain_pii.train = seen.append
        language_crf.train = lambda texts, languages: seen.append(list(zip(languages, texts)))
        skip_chain_pii.learned(docs)
        language_crf.learned(docs, ~language_crf.held_out())
    finally:
        skip_chain_pii.train, language_crf.train = train, learn
    assert len(seen[0]) == len(set(seen[0])) == skip_chain_pii.SAMPLE and any("@" in t for t in seen[0])
    assert sum(k == "en" for k, _ in seen[1]) == language_crf.PER_LANGUAGE and any(k == "de" for k, _ in seen[1])


def test_pipeline_against_brute_force(spark, tmp_path):
    from ledger_spark.llm import decontaminate
    from .test_pairs import linked
    words = "the of and to in is that for it with as was on be at by this from or have an they which one you were all her she there".split()
    rng = random.Random(5)
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(8)]
    item = "what is the name of that one river which all of them were at by this mill"
    texts = [(1, base[0]), (1, base[1]), (None, base[0]), (None, base[2]), (None, base[2]), (2, base[2] + " from"), (None, base[3]), (None, base[3]),
             (None, base[3] + " have"), (3, base[4]), (3, base[4] + " item " + item), (None, base[5] + " " + item), (4, base[6]), (4, base[6]),
             (5, base[6]), (5, base[7]), (7, base[7] + " all"), (7, base[7] + " her")]
    docs = [(i, t, "en", "s", len(t)) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    frame = spark.createDataFrame(docs, schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = sorted(set(texts), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    group = linked([(k, t) for k, (_, t) in enumerate(order)], 5, 80)

    def survivors(rows):  # of each group all rows of the smallest id and one text; a text without id once
        best = {}
        for r in rows:
            best.setdefault(group[order.index(r)][1], set()).add(r)
        out = []
        for members in best.values():
            least = min((r[0] is None, r[0] or 0) for r in members)
            out.append([r for r in members if (r[0] is None, r[0] or 0) == least])
        return out

    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, frame, str(tmp_path)).collect()]
    groups = survivors(texts)
    for candidates in groups:
        kept = [r for r in got if r in candidates]
        assert len(set(kept)) == 1 and len(kept) == (1 if kept[0][0] is None else texts.count(kept[0]))
    assert len(got) == sum(len([r for r in got if r in c]) for c in groups)
    clean = [(r.doc_id, r.text) for r in corpus_pipeline.leaks(spark, frame, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted(((i, t) for i, t in texts if decontaminate.normal(item) not in decontaminate.normal(t)), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [r for r in got if r in clean]
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in left)


@pytest.mark.parametrize("name", ["op1_warc_bundles", "op6_blob_ledger", "op11_vector_codes", "op13_conversation_repair"])
def test_against_sql(spark, queries, name):
    import duckdb
    import __spark_entry__ as entry
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    got = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in queries[name](spark, SF).collect())
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_query(spark, queries):
    got = queries["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
