import random

import pytest

ODD = ["", " ", "a  b", "\n \n x ", "日本語 テスト 😀", "<|endoftext|> <s> ▁x", "don't \t we'll  　 y", "x" * 3000, "la la la " * 200, None]
SCHEMA = "doc_id long, text string, lang string, source string, row_number string"


def corpus(n=120, seed=3):
    r = random.Random(seed)
    syllables = {"en": ["the", "of", "ing", "er", "tion", "and"], "fr": ["é", "eau", "que", "le", "ai", "ou"]}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "fr"])
        words = ["".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(r.randint(1, 160))]
        rows.append((i, " ".join(words), lang, r.choice(["s0", "s0", "s1", None]), "extra"))
    rows += [(n + i, t, None, None, "extra") for i, t in enumerate(ODD)]
    rows += [(n + 50, rows[0][1], "en", "s0", "x"), (n + 50, rows[0][1], "en", "s0", "x"), (None, rows[1][1], "en", "s1", "x")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
