"""Line dedup, source divergence and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, divergence, linededup

LOW = -(2 ** 63)
BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# line dedup ------------------------------------------------------------------------------------------

def plain_lines(rows):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(BLANK))
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(BLANK)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def line_rows(df):
    return sorted((LOW if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, sha(r.kept)) for r in df.collect())


@pytest.fixture(scope="module")
def line_corpus():
    rng = random.Random(2)
    pool = [f"Line number {k} of a pool {'é' * (k % 3)}" for k in range(60)] + ["short", "", "exactly 10", "only nine", "ÉCOLE ÉCOLE", "école école"]
    dress = (lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: f"\x0b{x}\x0c")
    rows = [(i, "\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1]), (5, rows[5][1]), (6, rows[9][1]), (103, "\n".join(pool * 300)), (104, "x" * 30_000)]
    return rows


def test_lines_equal_brute_force(spark, line_corpus):
    rows = [(i, t, "clash", 1) for i, t in line_corpus]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, n_dropped int").repartition(3)
    want = plain_lines([(LOW if i is None else i, t) for i, t in line_corpus])
    assert line_rows(linededup.deduplicated(docs)) == want


def test_hot_lines_take_the_other_way_with_the_same_result(spark, line_corpus, monkeypatch):
    monkeypatch.setattr(linededup, "SAMPLED", 1)
    monkeypatch.setattr(linededup, "AT_LEAST", 5)
    docs = spark.createDataFrame(line_corpus, "doc_id bigint, text string").repartition(3)
    assert line_rows(linededup.deduplicated(docs)) == plain_lines([(LOW if i is None else i, t) for i, t in line_corpus])


def test_bitmaps_hold_the_lines_that_go(spark, nothing):
    text = "\n".join(f"a line of the text {k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, "its own line\n" + text)], "doc_id bigint, text string")
    row, = linededup.drop_bitmaps(docs).collect()
    assert (row.oid, row.n_dropped, [w.word for w in row.words]) == (2, 200, [0, 1, 2, 3])
    assert [w.bits & (2 ** 64 - 1) for w in row.words] == [2 ** 64 - 2, 2 ** 64 - 1, 2 ** 64 - 1, 2 ** 9 - 1]
    assert linededup.deduplicated(nothing).count() == linededup.drop_bitmaps(nothing).count() == 0


# source divergence -----------------------------------------------------------------------------------

def plain_audit(rows, least, top):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in df[lang].items() if d >= least]
        sources = sorted(s for g, s in groups if g == lang)
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        every, whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}, sum(total.values())

        def p(count, size):
            return 1 + 10 ** 9 * (count + 5) // (size + 5 * len(kept))

        for s in sources:
            found = [("pair", o, sum(abs(p(n[lang, s][t], total[s]) - p(n[lang, o][t], total[o])) for t in kept)) for o in sources if o != s]
            own = [("term", t, p(n[lang, s][t], total[s]) - p(every[t], whole)) for t in kept if n[lang, s][t]]
            for part in (found, [x for x in own if x[2] > 0]):
                part = sorted(part, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, kind, item, value, r) for r, (kind, item, value) in enumerate(part, 1) if kind == "pair" or r <= top]
    return sorted(out)


def source_rows(seed=5, sources=9):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mi", "É", "été", "中") for b in ("", "na", "RU", "so", "tu", "vexi", "zo")]
    rows = []
    for k in range(300):
        lang = rng.choice(("en", "en", "de", None, ""))
        some = rng.sample(words, 20)
        rows.append((" ".join(rng.choices(some, k=rng.randint(0, 60))) + "7,x!", lang, rng.choice([f"s{i}" for i in range(sources)] + [None])))
    rows += [(None, "en", "quiet"), ("", "fr", "alone"), (" 12 ", "it", "a"), ("rare words", "it", "b"), ("ka " * 5000, "en", "s1"), ("Ka kA ka", "en", "é")]
    return rows + rows[:3]


@pytest.mark.parametrize("tile", [divergence.TILE, 3])
def test_divergence_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = source_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, 10, 7).collect())) == plain_audit(rows, 10, 7)


def test_counters_are_sent_on_and_empty_tables_have_no_rows(spark, nothing):
    rows = source_rows(6, 3)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    assert sorted(map(tuple, divergence.audit(docs, 30, 50, held=50).collect())) == plain_audit(rows, 30, 50)
    assert divergence.audit(nothing).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    rows = [(c, t, k) for c in (0, 7, 10 ** 12, 10 ** 15 + 1) for t in (0, 10 ** 12, 3 * 10 ** 15) for k in (1, 999, 10 ** 9)]
    got = spark.createDataFrame(rows, "c bigint, t bigint, k bigint").select("c", "t", "k", divergence.share("c", "t", "k").alias("p")).collect()
    assert all(r.p == 1 + 10 ** 9 * (r.c + 5) // (r.t + 5 * r.k) for r in got if r.c <= r.t)


def test_words_of_bits_equal_sums_term_by_term():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (6, 64))
    counts[5] = 0
    p = counts * 100 + np.arange(6)[:, None]
    group, shares, bits = [], [], []
    for g in range(6):
        for c in range(1, 4):
            if (counts[g] == c).any():
                group.append(g), shares.append(c * 100 + g), bits.append(sum(1 << i for i in range(64) if counts[g, i] == c))
    total = np.zeros((6, 6), np.int64)
    divergence.add_word(total, np.arange(6), np.array(group), np.array(shares), np.array(bits, np.uint64))
    seen = (counts > 0).any(axis=0)
    assert (total == np.abs(p[:, None, seen] - p[None, :, seen]).sum(axis=2)).all()


# conversation repair ---------------------------------------------------------------------------------

def plain_repair(turns):
    """(cost, audit) by all edits from each state of the grammar; the least of (cost, audit)."""
    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(turns) and state in ("", "a") else []
        nxt = "a" if state == "u" else "u"
        if inserted < 3:  # more empty turns in a row are never cheapest
            c, a = best(i, nxt, inserted + 1)
            ways.append((c + 5, "I" + a))
        if i < len(turns):
            t = turns[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a))
            if t != "#":
                late = 5 if t.isupper() else 0
                for to in [nxt] + ["s"] * (state == "" and t.lower() == "s"):
                    keep = t.lower() == to
                    c, a = best(i + 1, to, 0)
                    ways.append((c + late + (0 if keep else 1), ("K" if keep else "R") + a))
        return min(ways, default=(10 ** 6, ""))

    return best(0, "", 0)


def test_short_repairs_equal_brute_force():
    for n in range(5):
        for turns in itertools.product("suaxUA#", repeat=n):
            turns = "".join(turns)
            assert conversations.repaired(turns) == plain_repair(turns), turns


@pytest.mark.parametrize("whole,block", [(16, 8), (3, 3), (0, 1), (2, 5)])
def test_long_repairs_in_blocks_equal_brute_force(monkeypatch, whole, block):
    monkeypatch.setattr(conversations, "WHOLE", whole)
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    for k in range(120):
        letters = rng.choice(("suaSUAx#", "uuuuA", "uauauauS#", "sxUA"))
        turns = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert conversations.repaired(turns) == plain_repair(turns), turns


def plain_conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv]
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        by[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, letters = set(), Counter(), ""
        for _, role, text in turns:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            i = role[:1] if role[:1] and role[:1] in "sua" else "x"
            letters += "#" if fault in ("blank", "duplicate") else i.upper() if fault else i
        known = sorted({t for t, _, _ in turns if t is not None})
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = plain_repair(letters)
        fixed, rest = [], iter(turns)
        for e in audit:
            _, role, text = next(rest) if e != "I" else (None, "", "")
            if e == "D":
                continue
            state = fixed[-1][0][:1] if fixed else ""
            fixed.append((role if e == "K" else "assistant" if state == "u" else "user", text))
        out.append((conv, known[-1] - known[0] + 1 - len(known) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal,
                    cost, audit, sha("\n".join(f"{r}:{t}" for r, t in fixed))))
    return sorted(out, key=str)


def conversation_rows():
    rng = random.Random(12)
    texts = ["How so?", "Like this.", "Oh!", "unfinished", " \t ", "", None, "Yes. ", "no stop \n", "Ça va?", "a. b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "System"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, turn * rng.choice((1, 1, 1, 2)) if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."))
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t % 57}.") for t in range(130)] + [(None, t, "user", "Hi.") for t in range(4)]
    return rows + rows[:20] + [(501, None, None, None), (502, 3, "user", "x" * 40_000)]


@pytest.mark.parametrize("held", [conversations.HELD, 20])
def test_conversations_equal_brute_force(spark, held):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, cost int").repartition(4)
    got = [tuple(r) for r in conversations.audits(conversations.damaged(df), held).collect()]
    assert sorted(got, key=str) == plain_conversations(rows)


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.audits(conversations.damaged(empty)).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "Hi.", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    assert tuple(conversations.audits(gone).first()) == (7, 0, 0, 0, 0, 0, 0, "", sha(""))
