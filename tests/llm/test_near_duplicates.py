"""SimHash, covering masks, components, spot signatures and near-copy groups against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, spotsigs, stages
from tidemark.llm.components import components

LOW = -(2 ** 63)


def union(n, links):
    parent = {x: x for x in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_and_groups_equal_brute_force(spark, docs, corpus):
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hex16()).collect()
    assert len(got) == len(corpus)
    want = [(LOW if i is None else i, plain_fingerprint(t)) for i, t in corpus]
    first = {}
    for i, fp in want:
        first[fp] = min(first.get(fp, i), i)
    links = [(a, b) for a, b in itertools.combinations(first, 2) if bin(a ^ b).count("1") <= 2]
    groups = union(first, links)
    smallest = {}
    for fp, c in groups.items():
        smallest[c] = min(smallest.get(c, first[fp]), first[fp])
    assert sorted((LOW if r.doc_id is None else r.doc_id, r.hex, r.component_id) for r in got) == sorted(
        (i, f"{fp:016x}", smallest[groups[fp]]) for i, fp in want)


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover_every_pair(radius):
    masks = [m & (2 ** 64 - 1) for m in simhash.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("radius", [2, 4])
def test_large_buckets_lose_no_component(spark, radius, monkeypatch):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    pairs = simhash.close_pairs(spark.createDataFrame([(f, [f]) for f in signed], "id bigint, fps array<bigint>"), 1, radius).collect()
    every = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= radius]
    assert union(signed, [(r.a, r.b) for r in pairs]) == union(signed, every)
    assert all(bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= radius for r in pairs)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert spotsigs.digest(nothing).count() == 0
    assert simhash.near_copies(nothing).count() == 0


def plain_sets(corpus):
    out = {}
    for i, t in corpus:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[LOW if i is None else i, t or ""] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def test_near_copies_stage_keeps_one_of_each_group(spark, docs, corpus):
    sets = plain_sets(corpus)
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = union(sets, links)
    kept = stages.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    rows = [(LOW if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()]
    assert len(rows) == len(set(rows)) == len(set(groups.values()))
    assert {groups[r] for r in rows} == set(groups.values())


def groups_of(spark, texts):
    """(groups that near_copies finds, groups by brute force), both as sets of sets of ids."""
    rows = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    first = {i: i for i in range(len(texts))} | {r.oid: r.first_oid for r in rows}
    sets = {i: s for (i, _), s in plain_sets(list(enumerate(texts))).items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return first, union(sets, links)


def test_near_copies_in_a_crowd_of_one_template(spark):
    rng = random.Random(3)

    def word():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))

    template, texts = [word() for _ in range(300)], []
    for _ in range(150):
        family = template[:]
        for slot in range(10, 300, 37):
            family[slot] = word()
        copy = family[:]
        copy[10] = word()
        texts += [" ".join(family), " ".join(copy)]
    got, want = groups_of(spark, texts)
    assert len(set(want.values())) == 150 and got == want


def test_near_copies_of_a_large_group_and_its_fringe(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 4)
    rng = random.Random(8)
    words = [str(rng.random()) for _ in range(120)]
    texts = [" ".join(words[:100 + k % 21]) + f" end{k}" for k in range(60)]
    texts += [" ".join(words[k:k + 60]) for k in range(0, 60, 3)] + [" " * k for k in range(20)]
    got, want = groups_of(spark, texts)
    assert got == want


def test_texts_of_one_template_that_are_not_alike_cost_no_pairs(spark):
    rng = random.Random(21)

    def word():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))

    template, texts = [word() for _ in range(200)], []
    for _ in range(2000):  # six slots of 200 words: 30 of 196 shingles are their own, similarity 0.73
        text = template[:]
        for slot in range(8, 200, 33):
            text[slot] = word()
        texts.append(" ".join(text))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:3])], "node bigint, text string")
    each = simhash.prefix_rows(rows, 5, 0.8).distinct().withColumn("lead", simhash.leads(F.col("size"), F.col("pos"), 0.8))
    crowded = each.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("lead").cast("int")).alias("l")).where("n > 1").collect()
    assert max(r.n for r in crowded) >= 2000 and sum(r.n * r.l for r in crowded) < 4 * len(texts)
    got = simhash.near_copies(spark.createDataFrame([(k, t) for k, t in enumerate(texts[:300] + [texts[5] + " x"])], "doc_id bigint, text string")).collect()
    assert [(r.oid, r.first_oid) for r in got] == [(300, 5)]


def test_parity_sketches_rule_out_only_pairs_below_the_similarity(spark):
    rng = random.Random(13)
    base = [f"{rng.getrandbits(40):x}" for _ in range(400)]
    texts = []
    for k in range(60):
        n = (20, 150, 400)[k % 3]
        words = base[:n]
        for at in rng.sample(range(n), rng.randint(0, n // 18)):
            words[at] = f"{rng.getrandbits(40):x}"
        texts.append(" ".join(words))
    texts += ["", "one", "one two"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:5])], "node bigint, text string")
    sketches = simhash.parity_sketches(rows, rows, 5)
    sizes = [len(s) for s in plain_sets(list(enumerate(texts))).values()]
    known = sketches.join(spark.createDataFrame(list(enumerate(sizes)), "node bigint, size int"), "node")
    other = known.select(*[F.col(c).alias(c + "2") for c in known.columns])
    may = simhash.may_be_alike(*(F.col(c) for c in ("size", "sketch", "size2", "sketch2")), 0.8)
    got = {(r.node, r.node2): r.may for r in known.join(other, F.col("node") < F.col("node2")).select("node", "node2", may.alias("may")).collect()}
    sets = list(plain_sets(list(enumerate(texts))).values())
    like = {p: len(sets[p[0]] & sets[p[1]]) / max(1, len(sets[p[0]] | sets[p[1]])) for p in got}
    assert len(got) == len(texts) * (len(texts) - 1) // 2
    assert all(got[p] for p in got if like[p] >= 0.8) and any(like[p] >= 0.8 for p in got)
    assert not any(got[p] for p in got if 0 < like[p] < 0.7 and min(sizes[i] for i in p) >= 100)


def test_different_texts_with_one_key_are_two_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "text_key", lambda text="text": F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"))
    texts = ["one two three four five six", "six five four three two one", "one two three four five six", "x", "y", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.oid, r.first_oid) for r in simhash.near_copies(docs).collect() if r.oid != r.first_oid}
    assert got == {(2, 0), (6, 5)}


def edited_texts():
    """Texts of 300 words, each with a copy that lacks few shingles and one that lacks many, yet is at 0.8 or more."""
    rng, texts = random.Random(17), []
    for _ in range(12):
        words = [f"{rng.getrandbits(40):x}" for _ in range(300)]
        texts += [" ".join(words), " ".join(words + ["end"]), " ".join(words[:255])]
    return texts


def test_near_copies_meet_by_fingerprint_first(spark, monkeypatch):
    texts = edited_texts()
    fps = [simhash.majority(simhash.each_hash(simhash.plain_words(t.encode()), 5).view("u1").reshape(-1, 8)) for t in texts]
    close = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin((fps[i] ^ fps[j]) & (2 ** 64 - 1)).count("1") <= 2}
    assert any(j - i == 1 and i % 3 == 0 for i, j in close) and len(close) < 2 * 12
    marks = simhash.signatures(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string"), 5)
    assert {r.node: r.fp for r in marks.collect()} == dict(enumerate(fps))
    assert {(r.a, r.b) for r in simhash.simhash_pairs(marks, 2).collect()} == close
    got, want = groups_of(spark, texts)
    assert got == want and len(set(want.values())) == 12          # the prefixes bring those further apart
    rows = simhash.prefix_rows
    monkeypatch.setattr(simhash, "prefix_rows", lambda *a: rows(*a).where("false"))
    found, _ = groups_of(spark, texts)
    assert found == union(range(len(texts)), close)               # and without them the fingerprints bring theirs


def test_texts_that_sketches_tell_apart_are_not_joined_with_pairs(spark, monkeypatch):
    rng, checked, alike = random.Random(19), [], simhash.alike
    shared = " ".join(f"{rng.getrandbits(40):x}" for _ in range(60))
    texts = [shared + " " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(140)) for _ in range(24)]
    texts += [t + " end" for t in texts[:2]]
    monkeypatch.setattr(simhash, "alike", lambda pairs, *a: checked.extend(pairs.collect()) or alike(pairs, *a))
    got, want = groups_of(spark, texts)
    assert got == want and sorted({(r.a, r.b) for r in checked}) == sorted(checked) and len(checked) == 2


def test_sketches_tell_long_texts_apart_too(spark, monkeypatch):
    rng, checked, alike = random.Random(23), [], simhash.alike
    shared = " ".join(f"{rng.getrandbits(40):x}" for _ in range(1500))
    texts = [shared + " " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(3000)) for _ in range(12)]
    texts += [t + " end" for t in texts[:2]]
    monkeypatch.setattr(simhash, "alike", lambda pairs, *a: checked.extend(pairs.collect()) or alike(pairs, *a))
    got, want = groups_of(spark, texts)
    assert got == want and sorted((r.a, r.b) for r in checked) == sorted({(r.a, r.b) for r in checked}) and len(checked) == 2


def test_fine_sketches_rule_out_only_pairs_below_the_similarity():
    rng = np.random.default_rng(29)
    for n in (1, 2, 5, 60, 511, 512, 513, 3000):
        for share in (0.0, 0.05, 0.1, 0.11, 0.2, 0.5):
            drawn = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, 3 * n))
            own = int(share * n)
            x, y = drawn[:n], np.unique(np.concatenate([drawn[own:n], drawn[n:n + rng.integers(0, own + 1)]]))
            common, apart = len(np.intersect1d(x, y)), simhash.bins_apart(simhash.fine_sketch(x), simhash.fine_sketch(y))
            assert apart <= len(x) + len(y) - 2 * common and apart == simhash.bins_apart(simhash.fine_sketch(y), simhash.fine_sketch(x))
            assert n < 60 or share < 0.5 or apart > (len(x) + len(y)) / 9


def test_pairs_of_large_buckets_are_named_once(spark):
    rng = random.Random(31)
    base, texts = [f"{rng.getrandbits(40):x}" for _ in range(300)], []
    for _ in range(40):
        words = base[:]
        for at in rng.sample(range(0, 300, 6), 4):
            words[at] = f"{rng.getrandbits(40):x}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    each = simhash.prefix_rows(rows, 5, 0.8).withColumn("lead", simhash.leads(F.col("size"), F.col("pos"), 0.8)).withColumn("c", F.col("node"))
    grouped = simhash.earlier_buckets(each).join(simhash.parity_sketches(rows, rows, 5), "node")
    found = simhash.first_meetings(grouped, 0.8).collect()
    wide = simhash.first_meetings(grouped.withColumn("before", F.array().cast("array<bigint>")), 0.8).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in wide} and len(wide) > 10 * len(set(wide))
    assert len(found) <= 3 * len(set(found))         # equal sizes meet from both sides


def test_filter_of_wanted_texts_keeps_them_and_few_others(spark, monkeypatch):
    rng = random.Random(37)
    ids = [rng.randint(-2 ** 63, 2 ** 63 - 1) for _ in range(4000)] + [0, -1, 1, 32767, 32768, 2 ** 63 - 1, -2 ** 63]
    rows = spark.createDataFrame([(i, "x") for i in ids], "node bigint, text string")
    wanted = spark.createDataFrame([(i,) for i in ids[::10] + ids[-7:]], "node bigint")
    for bits, most in ((simhash.FILTER, 420), (1 << 15, 600)):
        monkeypatch.setattr(simhash, "FILTER", bits)
        got = {r.node for r in simhash.perhaps_of(rows, wanted).collect()}
        assert {*ids[::10], *ids[-7:]} <= got and len(got) <= most
    assert simhash.perhaps_of(rows, wanted.where("false")).count() == 0


def test_near_copies_with_words_added_or_cut_and_short_ones(spark):
    rng = random.Random(5)

    def words(n):
        return [f"{rng.getrandbits(40):x}" for _ in range(n)]

    texts = []
    for n in (15, 20, 25, 40, 60, 100, 200, 400, 1000):
        for _ in range(8):
            w = words(n)
            texts += [" ".join(w), " ".join(w + words(n * 19 // 100)), " ".join(words(n * 19 // 100) + w), " ".join(w[:n - n * 15 // 100])]
    texts += [f"{t} x" for t in ("one", "one two three four five six seven eight", "a b c d e f g h i j k l m n o")] + [
        "one x", "one two three four five six seven eight x y", "a b c d e f g h i j k l m n o x z"]
    got, want = groups_of(spark, texts)
    assert got == want


def test_edited_texts_and_likeness(spark, docs, corpus):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in spotsigs.digest(docs).collect()}
    order = sorted({(LOW if i is None else i, t or "") for i, t in corpus}, key=lambda r: -r[0])
    assert len({i for i, _ in order}) == len(order)
    for k, (i, t) in enumerate(order):
        nxt, m = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[:len(t) - m] + nxt[:m]
        r = got[None if i == LOW else i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        sets = [{f[j:j + 8] for j in range(0, len(f), 8)} for f in (r.fingerprint, r.edited_fingerprint)]
        assert r.near_edited == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0)
    by_text = {}
    for i, t in corpus:
        for (d, _, _), r in got.items():
            if d == i:
                by_text.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_spots_are_anchors_with_chains(spark):
    row = spark.createDataFrame([("The House of red Bricks stands, and a dog",), (None,)], "text string").select(spotsigs.spots("text").alias("s")).collect()
    assert [s.strip() for s in row[0].s] == ["the house", "of red bricks stands", "a dog"]
    assert row[1].s == []


def test_every_content_word_lies_in_a_signature(spark):
    texts = ["белый дом стоит на высокой горе у моря где живут люди", "белый дом стоит совсем в другом месте и там пусто"]
    docs = spark.createDataFrame([(i, texts[i % 2] + f" {i}") for i in range(6)], "doc_id bigint, text string")
    row = docs.orderBy("doc_id").select(spotsigs.spots("text").alias("s")).first()
    assert " ".join(row.s).split() == (texts[0] + " 0").split()
    anchors = spotsigs.corpus_anchors(docs)
    assert {"белый", "моря", "пусто"} <= set(anchors)
    sigs = docs.orderBy("doc_id").select(spotsigs.signature_set("text").alias("s")).collect()
    assert sigs[0].s != sigs[1].s and len(set(sigs[0].s) & set(sigs[1].s)) == 1
    assert spotsigs.corpus_anchors(docs.limit(0)) == sorted(set(spotsigs.ANCHORS))


def test_matches_equal_brute_force(spark, docs):
    queries = docs.where("doc_id % 50 = 0")
    got = {(r.query_id, r.set_id): r.near for r in spotsigs.matches(queries, docs, 0.3).collect()}
    from pyspark.sql import functions as F
    sets = {r.i: set(r.s) for r in docs.select(spotsigs.order_id().alias("i"), spotsigs.signature_set(F.col("text")).alias("s")).collect()}
    least = {}
    for i, s in sets.items():
        least[frozenset(s)] = min(least.get(frozenset(s), i), i)
    want = {(q, i): len(sets[q] & s) / len(sets[q] | s) for q in (0, 100, 200, 300, 400) for s, i in least.items()
            if sets[q] and s and len(sets[q] & s) >= 0.3 * len(sets[q] | s)}
    assert got == pytest.approx(want)
