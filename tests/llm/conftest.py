import random

import pytest

WORDS = "alpha bravo carbon delta echo forest garden harbor island jungle kernel lemon marble nickel orange pepper quartz river silver timber uncle velvet window yellow zebra ocean planet rocket saddle turtle".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) if r.random() < 0.2 else r.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n int, id string, ids string, token string, kept string, component_id string, x string, place string"


def rows(texts) -> list[tuple]:
    """Rows of documents with columns that clash with working names."""
    return [(i, t, "en", "s", None if t is None else len(t), 1, 2, "a", "b", "c", "d", "e", "f", "g") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, a null id, and clashing columns."""
    long = "\n".join(prose(k, 60) for k in range(500))
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, prose(1, 40)), (4, prose(2, 40)), (4, prose(2, 40)), (5, prose(2, 40)), (6, long), (7, "x" * 50_000), (8, "\n".join([prose(9, 30)] * 3)), (-9, "Ünïcödé 日本語 🎉 " + prose(4, 25))]
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def write(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_dir(odd, tmp_path_factory):
    return write(odd.coalesce(2), tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="session")
def none_dir(none, tmp_path_factory):
    return write(none, tmp_path_factory.mktemp("none"))
