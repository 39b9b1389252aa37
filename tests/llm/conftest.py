import random

import pytest

SYL = "an er is to re in th ou he ti es on ar".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Random texts, with copies and near copies of some."""
    rng = random.Random(11)
    out = ["\n".join(words(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    for k in range(0, 20, 2):
        out.append(out[k])
        w = out[k + 1].split(" ")
        if len(w) > 20:
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"word{k % 997}" for k in range(40000))
    rows = [
        (1, "a b c\nd e f", "x"), (1, "a b c\nd e f", "x"), (1, "other text of the same id", "x"), (None, "no id here at all", None), (None, "no id here at all", None),
        (2, None, "x"), (3, "", "x"), (4, "   \n\t\n ", None), (5, long, "y"), (6, long + " end", "y"), (7, "A B C\nD E F", ""), (8, "\0 nul \0 chars", "x"), (None, None, None),
    ]
    return spark.createDataFrame(
        [(i, t, "en", s, len(t) if t else None, 1, 2, 3, "z", 4) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, __h int, node int, count int, TEXT string, `first.id` int",
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
