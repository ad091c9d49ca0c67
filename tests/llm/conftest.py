import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, node long, kept int, words string, id string, label string"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Small documents with nulls, blanks, copies, near copies, repeated lines, licences and a long text."""
    rng = random.Random(seed)
    vocab = {"en": "the of and house river Is under mit license walking cc by nc".split(), "de": "der die und ein Haus Fluß nicht wandern überall schön".split()}
    line = "This very line stands in many of the documents here, as boilerplate does."
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(vocab[lang]) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 90))]
        text = " ".join(words)
        if rng.random() < 0.3:
            text += rng.choice(["\n", "\t\n "]) + line.upper() + "  \n" + text[:50]
        if rng.random() < 0.15:
            text += " Under the MIT License, Apache License: version 2.0. CC-BY-NC"
        rows.append((i * 7 % 1000, text, lang))
    base = rows[3][1] + " " + " ".join(f"word{k}" for k in range(150))
    rows += [(2000 + k, base + f" extra{k}" * (k > 1), "en") for k in range(5)]
    rows += [(3000, None, "en"), (3001, "", None), (3002, " \t\n ", "en"), (3003, "12 34", "de"), (3004, "日本語 テキスト 😀", None), (3005, "\n\n", "en")]
    rows += [(3006, "the  mit\tlicense", "en"), (3007, "the mit license", "en"), (3008, "long " * 30_000 + "tail", "en"), (3009, "x" * 5000, "en")]
    rows += [(rows[0][0], rows[0][1], rows[0][2])]
    return [(i, t, g, "src", len(t) if t is not None else None, "h", 1, 0, "w", "i", "l") for i, t, g in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique(rows):
    """The rows without the repeated one."""
    return list(dict.fromkeys(rows))
