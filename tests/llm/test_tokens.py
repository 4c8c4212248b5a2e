"""Token counts, word-table encoding and packing against the tokenizer library."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, pretokens, transducer, wordtable

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=3000):
    rng = random.Random(3)
    letters = "ab'strevldmE l  \n\t x1²!?é中　\x85\x1c​՘Ᲊ<|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["<|endoftext|>", "a<|endoftext|> b", "", " " * 700]


def test_pieces_equal_the_library(library):
    texts = odd_texts()
    pieces, counts = pretokens.split_pieces(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert pieces[at:at + n] == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]
        at += n


def test_chunk_maps_compose_to_one_run():
    kinds = np.random.default_rng(1).integers(0, 12, 5000).astype(np.uint8)
    follow, began = pretokens.machine()
    state, told = 0, []
    for k in [*kinds, pretokens.STOP]:
        told.append(began[k * 16 + state])
        state = follow[k * 16 + state]
    want = np.array(told[1:])
    want[kinds == pretokens.STOP] = True
    assert (pretokens.piece_starts(kinds) == want).all()


def test_counts_equal_the_library(library):
    texts = odd_texts() + ["x" * 4000, "ab" * 3000]
    assert transducer.token_counts(texts, PATH).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_fit_equals_plain_merging():
    machine = transducer.counter(PATH)
    rng = random.Random(5)
    tokens = sorted(machine.whole)
    short = [t for t in tokens if len(t) < 4]
    for a, b in [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)] + [(rng.choice(short), rng.choice(short)) for _ in range(3000)]:
        assert machine.joins(a, b) == (machine.vocabulary.merge(a + b) != [a, b])


def test_full_caches_start_anew(monkeypatch):
    machine = transducer.PieceCounter(PATH)
    texts = odd_texts(300)
    pieces, _ = pretokens.split_pieces(texts)
    want = machine.of(pieces).tolist()
    monkeypatch.setattr(transducer, "CACHED_STEPS", 20)
    monkeypatch.setattr(transducer, "CACHED_PIECES", 5)
    small = transducer.PieceCounter(PATH)
    assert [int(small.of([p])[0]) for p in pieces] == want


def test_count_table(docs, corpus, library):
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.counted(docs, PATH).collect()]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in corpus]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_word_table_round_trip(docs, corpus, library):
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in wordtable.encoded(docs, PATH).collect()]
    want = [(i, ids := library.encode(t or "", add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for i, t in corpus]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_around_special_tokens():
    words, counts = wordtable.words_of(["a<|endoftext|><|endoftext|> b", "plain text", ""], {"<|endoftext|>": 7})
    assert words == ["a", "<|endoftext|>", "<|endoftext|>", " b", "plain", " text"] and counts.tolist() == [4, 2, 0]


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(9)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 120))]
        rows = packing.best_fit_decreasing(sizes, 50)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        room = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in room if r >= sizes[i]]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 50) - sizes[i])
        assert sorted(50 - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packed_rows_give_back_every_text(spark, docs, corpus, tmp_path):
    packing.write(packing.packed(docs, PATH, length=64), str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).collect()
    ids, places = packing.matrices(rows, 64)
    assert ids.shape == places.shape == (len(rows), 64)
    parts = {}
    for r, line, place in zip(rows, ids, places):
        assert r.n_tokens == r.cu_seqlens[-1] <= 64 and not line[r.n_tokens:].any()
        for a, b, d, at in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets):
            assert place[a:b].tolist() == list(range(b - a))
            parts.setdefault((d, at), []).append(line[a:b])
    codec = packing.encoding(PATH)
    for i, t in corpus:
        copies = sum(1 for j, u in corpus if (j, u) == (i, t))
        mine = sorted((at, p[0]) for (d, at), p in parts.items() if d == i and len(p) == copies)
        assert codec.decode(np.concatenate([p for _, p in mine]).tolist() if mine else []) == (t or "")
    assert len({r.row_id for r in rows}) == len(rows)


def test_empty_table(nothing):
    assert transducer.counted(nothing, PATH).count() == wordtable.encoded(nothing, PATH).count() == packing.packed(nothing, PATH).count() == 0


def test_large_vocabularies_and_rows_take_wider_numbers(spark, docs, corpus, monkeypatch):
    assert [packing.number_type(n) for n in (50_000, 65_535, 65_536, 200_000)] == ["<u2", "<u2", "<u4", "<u4"]
    batch = packing.pack_texts([1, 2], ["one two three", "four"], PATH, 70_000, 0)
    ids, places = packing.matrices(batch.to_pylist(), 70_000)
    assert ids.dtype == np.dtype("<u4") and ids.shape == (1, 70_000) and places[0, :3].tolist() == [0, 1, 2]
