import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "y", "let"]) + str(rng.randrange(3)) * (rng.random() < 0.05) for _ in range(n))


def edited(text: str, every: int) -> str:
    return " ".join(f"x{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, ids=None):
        rows = rows_of(texts)
        if ids is not None:
            rows = [(k, *r[1:]) for k, r in zip(ids, rows, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, non-Latin and very long texts."""
    long = prose(1, 4000)
    return [None, "", " \n\t ", "one", prose(2, 80), prose(2, 80), "日本語 のテキスト é ß 😀", "a" * 5000, long, edited(long, 40), prose(3, 4)]
