"""Repeated word windows and benchmark leaks against brute force."""

import hashlib
import re

import duckdb
import numpy as np

from tidemark.llm import superkmers, winnowing

LOW = -(2 ** 63)


def plain_repeats(rows, window):
    order = sorted({(LOW if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            gone |= set(range(s, s + window)) if k in seen else set()
            seen.add(k)
        out[i, t] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_repeats_equal_brute_force(docs, corpus):
    want = plain_repeats(corpus, 20)
    got = superkmers.without_repeats(docs).collect()
    assert sorted((LOW if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(
        (LOW if i is None else i, *want[LOW if i is None else i, t or ""]) for i, t in corpus)


def test_small_slices_and_windows(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(superkmers, "SLICE_BYTES", 2000)
    want = plain_repeats(corpus, 5)
    got = superkmers.without_repeats(docs, window=5).collect()
    assert sorted((LOW if r.doc_id is None else r.doc_id, r.n_removed) for r in got) == sorted(
        (LOW if i is None else i, want[LOW if i is None else i, t or ""][1]) for i, t in corpus)


def test_equality_is_decided_on_words_when_hashes_collide():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    starts = np.array([0, 3, 6])
    first = superkmers.earlier_windows(ids, starts, np.zeros(3, np.uint64), np.arange(3), 3)
    assert first.tolist() == [0, 1, 0]


def test_super_k_mers_hold_every_sent_window_once():
    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(60)).encode() for i in range(3)]
    rows = list(superkmers.pack_batch(np.arange(3), np.zeros(3, np.int64), texts, 4, 20))
    parts = [[] for _ in range(superkmers.PARTS)]
    for _, _, _, data, strings in rows:
        if strings is not None:
            superkmers.deal(data, strings, parts)
    windows = [tuple(line.split()[k:k + 20]) for p in parts for _, text in p for line in text.splitlines() for k in range(len(line.split()) - 19)]
    want = {tuple(t.split()[k:k + 20]) for t in texts for k in range(len(t.split()) - 19)}
    assert len(windows) == len(set(windows)) and set(windows) == want


def test_empty_tables(spark, nothing):
    assert superkmers.without_repeats(nothing).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert winnowing.contamination(nothing, items).count() == 0


def check_leaks(spark, docs, items):
    got = winnowing.contamination(docs, items).drop("oid", "key").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", items.toPandas())
    want = con.sql(winnowing.ORACLE).df()[list(got.columns)]
    key = ["doc_id", "n_words", "n_hit", "items_sha256"]
    a, b = (x.fillna(-1).sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.doc_id.str.replace(".0", "").tolist() == b.doc_id.str.replace(".0", "").tolist()
    assert a.drop(columns="doc_id").equals(b.drop(columns="doc_id"))
    return got


def test_leaks_equal_sql(spark, docs, corpus):
    # a null id and a repeated row group differently in plain SQL, so they stay out here
    unique = docs.where("doc_id is not null and doc_id <> 3 and doc_id < 408")
    texts = dict(corpus)
    words = texts[301].split()
    rows = [(1, " ".join(words[30:55]).upper()), (2, " ".join(words[32:44]) + "!"), (10, "one"), (11, "two three"), (12, None), (13, ""),
            (14, texts[5]), (2, " ".join(texts[9].split()[:9])), (15, "dem dem dem dem")]
    got = check_leaks(spark, unique, spark.createDataFrame(rows, "item_id bigint, text string"))
    hit = got.set_index("doc_id")
    assert hit.contaminated[[301, 403, 404, 5, 9, 406]].all()
    assert not hit.contaminated[[400, 401, 402, 6]].any()
    assert hit.n_hit[406] == 300


def test_repeated_rows_and_null_ids_have_results(spark, docs, corpus):
    items = spark.createDataFrame([(1, corpus[3][1]), (2, corpus[7][1]), (None, corpus[8][1])], "item_id bigint, text string")
    got = [(r.doc_id, r.contaminated) for r in winnowing.contamination(docs, items).collect()]
    assert len(got) == len(corpus)
    assert got.count((3, True)) == 2 and (None, True) in got and (7, True) in got and (8, True) in got
    rows = {r.doc_id: (r.n_items, r.items_sha256 == hashlib.sha256(b'').hexdigest(), r.n_hit > 0) for r in winnowing.contamination(docs, items).collect()}
    assert rows[8] == (0, True, True) and rows[3] == (1, False, True)  # items without an id hit, but are not named


def test_no_items_no_leaks(spark, docs):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert winnowing.contamination(docs, items).where("contaminated or n_hit > 0").count() == 0
