import random

import pytest

WORDS = "the of and to in a is that it for on with as are this be by was from or at an not harbor lantern meadow quiet river stone window bright copper garden".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS) if rng.random() < 0.7 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9)))
        out.append(w + (".\n" if i % 23 == 22 else "." if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    return [prose(rng, rng.randint(30, 200)) for _ in range(60)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words array<string>, fp long"


def frame(spark, texts, first=0):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", None if t is None else len(t), 0.5, ["x"], 1) for i, t in enumerate(texts)], DOCS).repartition(3)
