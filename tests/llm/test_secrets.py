"""Spans and votes of the secret scan against plain versions, and its recall on each form of secret."""

import random
import re
import string

import numpy as np
import pytest

from tests.llm.conftest import prose
from tidemark.llm import secret_scan as sc

ALNUM = string.ascii_letters + string.digits


def value(rng, n, letters=ALNUM):
    return "".join(rng.choices(letters, k=n))


def pem(rng, kind="RSA ", newline="\n"):
    body = newline.join(value(rng, 64, ALNUM + "+/") for _ in range(6))
    return f"-----BEGIN {kind}PRIVATE KEY-----{newline}{body}{newline}-----END {kind}PRIVATE KEY-----", body


def forms(rng):
    """(name, text of the finding, the part that must be masked) of one finding of each form."""
    yield from ((n, f(v), v) for n, f, v in (
        ("assigned", 'token = "{}"'.format, value(rng, 40, "0123456789abcdef")),
        ("environment", "export API_KEY={}".format, value(rng, 32)),
        ("header", "Authorization: Bearer {}".format, "a1" + value(rng, 40)),
        ("query", "https://host/x?access_token={}&page=2".format, "b2" + value(rng, 24)),
        ("issued", "see ghp_{} there".format, value(rng, 36)),
        ("cloud", "id AKIA{} used".format, value(rng, 16, string.ascii_uppercase + string.digits)),
        ("short", 'password: "{}"'.format, value(rng, 6) + "&3!"),
        ("link", "postgres://admin:{}@db:5432/x".format, value(rng, 10)),
        ("link without user", "redis://:{}@cache/0".format, value(rng, 12)),
        ("web token", "eyJhbGciOiJIUzI1NiJ9.{}".format, "eyJz" + value(rng, 30) + "." + value(rng, 43))))
    for name, kind, newline in (("key block", "RSA ", "\n"), ("plain key block", "", "\r\n"), ("escaped key block", "EC ", "\\n")):
        text, body = pem(rng, kind, newline)
        yield name, text, body


def clean(rng):
    yield f"https://host/{value(rng, 10)}/page-{rng.randint(1, 99)}?id={rng.randint(1, 10 ** 6)}"
    yield f"src/lib/{prose(rng, 1)}/module_{rng.randint(1, 9)}.py and https://user@host/x"
    yield f"-----BEGIN CERTIFICATE-----\n{value(rng, 64)}\n{value(rng, 64)}\n-----END CERTIFICATE-----"
    yield f"released 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:00:00, commit {value(rng, 40, '0123456789abcdef')}"


@pytest.fixture(scope="module")
def findings():
    rng = random.Random(9)
    return [(name, f"{prose(rng, 12)} {text}\n{prose(rng, 12)}", secret) for _ in range(25) for name, text, secret in forms(rng)]


def test_each_form_is_found(spark, findings, tmp_path_factory):
    import public_tokenizers
    rng = random.Random(10)
    rows = [(i, t) for i, (_, t, _) in enumerate(findings)] + [(1000 + i, f"{prose(rng, 9)} {t} {prose(rng, 9)}") for k in range(60) for i, t in [(4 * k + j, c) for j, c in enumerate(clean(rng))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in sc.scan(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    found = {}
    for i, (name, _, secret) in enumerate(findings):
        lines = [x for x in re.split(r"\s+|\\n", secret) if x]
        found.setdefault(name, []).append(not any(x in got[i].redacted for x in lines))
    assert {n: np.mean(f) for n, f in found.items() if np.mean(f) < 0.9} == {}
    flagged = [i for i, r in got.items() if i >= 1000 and r.secrets]
    assert len(flagged) <= 0.1 * 240


def plain_candidates(text):
    """All patterns on all texts, then overlaps joined by positions."""
    hit = set()
    edges = set()
    for p in (sc.NAMED, sc.BORNE, sc.WEB_TOKEN, sc.LINK, sc.PEM):
        for m in p.finditer(text):
            g = "quoted" if "quoted" in p.groupindex and m.group("quoted") is not None else "bare"
            edges.add(m.span(g))
    for m in re.finditer(r"[A-Za-z0-9+/_=\-]+", text):
        a, b = m.span()
        if b - a < 16:
            continue
        cut = max((k + 1 for k in range(a, b - 1) if text[k] == "=" and text[k + 1] != "="), default=a)
        run = text[cut:b]
        changes = sum(x.islower() != y.islower() for x, y in zip(run, run[1:]))
        if len(run) >= 16 and (re.search("[0-9]", run) or changes > 3):
            edges.add((cut, b))
    spans = sorted(edges)
    for a, b in spans:
        hit |= set(range(a, b))
    starts = sorted({a for a, b in spans if a - 1 not in hit or all(not (x <= a - 1 < y and a < y) for x, y in spans)})
    return [(a, max(y for x, y in spans if a <= x and all(k in hit for k in range(a, x + 1)) and not any(a < s <= x for s in starts))) for a in starts]


def test_spans_equal_all_patterns_on_all_texts(findings):
    rng = random.Random(3)
    texts = [t for _, t, _ in findings] + [c for _ in range(20) for c in clean(rng)]
    texts += ["", " ", "pa\u017f\u017fword = hunter22", "api_\u212aey: abcdefg1", "TOKEN=TOKEN=abcd==", "key" * 40, "PASSWORD='a b c d'", "x" * 50_000, "-----BEGIN PRIVATE KEY-----"]
    alphabet = ["token", "=", '"', "secret:", " ", "A1", "bearer ", "://", "u:", "@", "eyJ", ".", "\n", "aB" * 9, "-----BEGIN PRIVATE KEY-----", "password "]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(400)]
    for t in texts:
        assert list(sc.candidates(t)) == plain_candidates(t), t[:200]


def test_votes_equal_a_walk_through_each_tree():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 8)).astype(float)
    forest = sc.fit_forest(x, (x[:, 0] + x[:, 3] > 6).astype(int))

    def vote(row):
        total = 0.0
        for feature, limit, left, right, share in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] if row[feature[node]] <= limit[node] else right[node]
            total += share[node]
        return total / len(forest.trees)

    assert forest.predict(x) == pytest.approx([vote(r) for r in x])
    assert ((forest.predict(x) > 0.5) == (x[:, 0] + x[:, 3] > 6)).mean() > 0.95
