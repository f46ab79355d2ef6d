import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, size string, gone int, vector string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 20)}\n{shared}\n{prose(rng, 30)}" for _ in range(5)]
    near = prose(rng, 200).split(" ")
    for k in range(8):
        copy = list(near)
        copy[20 * k + 3] = f"changed{k}"
        texts.append(" ".join(copy))
    texts += ["", "   \n\t", None, "one", "One", "two words", prose(rng, 20000), "é ß 漢字\u00a0x \x00 y", "abc" * 400, "\n".join(["the same line of text again and again, yes"] * 12)]
    texts += [texts[0], texts[0]]
    out = [(k, t, rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", "s2", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[3], (None, texts[5], "en", "src1", 3), (None, None, None, None, None)]
    return [(*r, 7, "big", 1, "v") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    from semblance.llm.common import Scratch

    return Scratch(spark, "test")
