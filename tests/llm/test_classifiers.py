"""Quality, language and secrets: accuracy on rows kept out of training, and the edge cases."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import grams, language, quality, secret_scan
from tidemark.llm.tables import held_out

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (9999, 0)], "doc_id bigint, quality int")
    return docs, labels, {i: q for i, _, q in rows}


def test_quality_on_held_out_rows(graded):
    docs, labels, truth = graded
    rows = quality.scores(docs, labels).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 600 and len(out) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert {r.doc_id for r in quality.kept(docs, labels).collect()} == {r.doc_id for r in rows if r.predicted}


def test_quality_edge_cases(docs, corpus, graded, nothing):
    rows = quality.scores(docs, graded[1]).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    empty = graded[1].limit(0)
    assert {r.score for r in quality.scores(docs, empty).collect()} == {0.5}
    assert quality.scores(nothing, empty).count() == 0
    assert quality.kept(docs, graded[1]).columns == docs.columns


def test_training_never_sees_held_out_labels(graded):
    docs, labels, _ = graded
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_folded_score_equals_the_long_way():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.3)
    texts = ["The the cat sat", "", "x" * 9, "a b", "é ß中"]
    for z, (f, c) in zip(quality.logits(texts, model), quality.counted(texts)):
        assert z == pytest.approx((model.weights[f] * c).sum() / c.sum() + 0.3)


def test_long_texts_in_pieces_count_all_words(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = quality.counted([text])[0]
    monkeypatch.setattr(grams, "SLICE", 500)
    parts = quality.counted([text])[0]
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_on_held_out_rows(spark):
    rng = random.Random(2)
    kinds = {"aa": "ba na do ri", "bb": "ster ung heit zu", "cc": "çe éa ou ieux"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k].split(), k=3)) for _ in range(25)), k) for i in range(450) for k in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", "bb"), (902, "banado", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.languages(docs, per_language=60).collect()}
    truth = {i: k for i, _, k in rows}
    out = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(out) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.98 * len(out)
    assert (got[900].lang_pred, got[901].lang_pred, got[900].score) == ("und", "und", 0.0)
    assert got[902].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(docs, corpus, nothing):
    rows = language.languages(docs).collect()
    assert len(rows) == len(corpus) and {r.lang_pred for r in rows} == {"en", "und"}
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(nothing).count() == 0


def test_document_frequency_covers_all_rows(docs, corpus, monkeypatch):
    found, n = language.document_frequency(docs)
    assert n == len(corpus) and found.max() <= n
    want = np.zeros(1 << language.BITS, int)
    for _, t in corpus:
        want[language.counted([t or ""])[0][0]] += 1
    assert (found == want).all()


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(z)])
    assert language.temperature(z * 4, labels) == pytest.approx(4, rel=0.15)


@pytest.fixture(scope="module")
def leaky(spark):
    rng = random.Random(6)

    def hexes(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    rows = [(i, f'{prose(rng, 20)} token = "{hexes(40)}" {prose(rng, 5)}' if i % 2 else
             f"{prose(rng, 20)} order {rng.randrange(10 ** 15, 10 ** 16)} {prose(rng, 5)}", "a/test.py") for i in range(200)]
    return spark.createDataFrame([*rows, (500, None, None), (501, "", "x")], "doc_id bigint, text string, source string")


def test_secrets_are_found_and_masked(leaky):
    for r in secret_scan.scan(leaky, PATH).collect():
        assert len(r.secrets) == (r.doc_id % 2 if r.doc_id < 500 else 0)
        if r.secrets:
            assert '"[SECRET]"' in r.redacted and r.secrets[0].end - r.secrets[0].start == 40
    rows = {r.doc_id: r.redacted for r in secret_scan.scan(leaky, PATH).collect()}
    assert rows[500] is None and rows[501] == ""
    assert {r.doc_id: r.text for r in secret_scan.masked(leaky, PATH).collect()} == rows


HEX = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
FORMS = [f"API_KEY={HEX}", f"export DB_TOKEN=ghp_{HEX}", f"see https://a.example/x?user=7&access_token={HEX}&page=2", f"Authorization: Bearer {HEX}",
         f'curl -H "Authorization: Bearer {HEX}"', 'password = "Tr0ub4dor&3x9"', "PASSWORD=hunter2", 'passwd: "correcthorse"', f"SECRET_KEY={HEX}",
         f"/srv/ghp_{HEX}", f'{{"client_secret": "{HEX}"}}', f"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.{HEX}", f"bearer {HEX}"]


def test_secrets_in_env_files_urls_headers_and_short_values(spark, leaky):
    rows = spark.createDataFrame([(1000 + i, f"banado\n{t}\ncidole", "x") for i, t in enumerate(FORMS)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan(leaky.unionByName(rows), PATH).where("doc_id >= 1000").collect()}
    for i, t in enumerate(FORMS):
        red = got[1000 + i].redacted
        assert red.count("[SECRET]") == 1 and not any(x in red for x in (HEX, "Tr0ub", "3x9", "hunter2", "correct", "eyJ")), t
    assert got[1000].redacted == "banado\nAPI_KEY=[SECRET]\ncidole" and "?user=7&access_token=[SECRET]&page=2" in got[1002].redacted
    assert got[1005].redacted == 'banado\npassword = "[SECRET]"\ncidole'


def test_secret_contexts_in_doubt_have_no_label():
    for text, want in ((f"key {HEX}", None), (f"author: {HEX}", None), (f"order {HEX}", False), (f"task-sk-{HEX}", True), (f"disk-{HEX}", False),
                       ("token: banana", None), ("password=${PASSWORD}", []), (f"name={HEX}==", False)):
        spans = list(secret_scan.candidates(text))
        assert [secret_scan.certain(text, a, b) for a, b in spans] == ([want] if want != [] else []), text


def test_coverage_reads_the_whole_run():
    words = frozenset({"house"})
    head, tail = (secret_scan.features(r, 0, len(r), "", words) for r in ("x1" * 128, "x1" * 128 + "house" * 60))
    assert 0 in head and any(v == pytest.approx(300 / 556) for v in tail)


def test_labelled_findings_decide(spark, leaky):
    spans = leaky.select("doc_id", F.explode_outer(F.array(F.lit(1))).alias("one"), "text").where("doc_id < 400").collect()
    rows = [(r.doc_id, a, b, int(r.doc_id % 2 == 0)) for r in spans for a, b in secret_scan.candidates(r.text)]
    findings = spark.createDataFrame([*rows, (None, 0, 5, 1), (1, 5, 3, 1)], "doc_id bigint, start int, end int, is_secret int")
    got = {r.doc_id: len(r.secrets) for r in secret_scan.scan(leaky, PATH, findings).where("doc_id < 400").collect()}
    assert sum(n == int(i % 2 == 0) for i, n in got.items()) >= 0.98 * len(got)


def test_secret_edge_cases(docs, corpus, nothing):
    rows = secret_scan.scan(docs, PATH).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    assert secret_scan.scan(nothing, PATH).count() == 0
    assert secret_scan.masked(docs, PATH).columns == docs.columns


def test_forest_separates_a_simple_rule():
    rng = np.random.default_rng(0)
    x = rng.random((500, 6))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(int)
    forest = secret_scan.fit_forest(x[:400], y[:400])
    assert ((forest.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert secret_scan.fit_forest(x, np.ones(500)).predict(x[:2]).tolist() == [1, 1]
