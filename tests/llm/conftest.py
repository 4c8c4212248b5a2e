import random

import pytest

SYLLABLES = "an be ci do ed fi ga he in jo ka li mo ne or pa qui re sta tu".split()


def prose(rng, n):
    """Made-up words with common anchors between them."""
    return " ".join(rng.choice(("the", "of", "and", "in")) if rng.random() < 0.25 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))
                    for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): ordinary texts, copies, edited copies, nulls, blanks, a null id, a repeated row, a very long text."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    shared = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(5)]                                        # exact copies
    rows += [(200 + i, texts[i].replace(" the ", " of ", 1) + " end") for i in range(5)]   # edited copies
    rows += [(300 + i, prose(rng, 20) + " " + shared + " " + prose(rng, 20)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One, two; three!"), (None, texts[7]), (3, texts[3]),
             (405, "é中文 ß ﬁ <|endoftext|> don't  x\n\n y"), (406, "dem " * 300), (407, prose(rng, 15_000)), (408, "x" * 20_000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns, some of which bear names that operators use inside."""
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}/test.txt", None, k, "fp", 0.5, "x") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, fp string, score double, "
                                       "redacted string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
