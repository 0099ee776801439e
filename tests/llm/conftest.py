import random

import pytest

#: Columns that a table may have beside its own, named like what operators make inside.
CLASHING = "n_words long, size long, score double, fp long, text_hash long, shard int, bucket int, place string, pool string, block int, train int, base string, start long, n long, target double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
SMALL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    words = ["the", "river", "stone", "of", "under", "light", "walks", "slow", "green", "house", "and", "winter", "über", "señal", "after", "bread", "cold", "morning"]
    out = []
    for i in range(n):
        w = r.choice(words) + r.choice(["", "", "s", "ing", str(r.choice("abcdef"))])
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def rows(r: random.Random, n: int = 60) -> list[tuple]:
    """Ordinary texts, copies, near copies, repeated rows, nulls in every column, empty, blank and long texts."""
    out = []
    for i in range(n):
        out.append((i, prose(r, r.randint(15, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), 5))
    out += [(100 + i, out[i][1], "en", "a", 1) for i in range(8)]  # copies
    out += [(120 + i, out[i][1] + " again", "en", "hot", 1) for i in range(8)]  # near copies
    out += [(200, None, "en", "a", None), (201, "", None, None, 0), (202, " \n\t ", "en", "a", 3), (None, prose(r, 40), "en", "b", 9), (203, prose(r, 20_000), "en", "a", 1)]
    out += [out[3], out[3], (204, "one", "en", "a", 3), (205, "ONE", "en", "a", 3)]
    return out


@pytest.fixture(scope="session")
def plain_rows():
    return rows(random.Random(1))


@pytest.fixture(scope="session")
def documents(spark, plain_rows):
    extra = tuple([7] + [7, 0.5, 7, 7, 7, 7, "x", "x", 7, 1, "x", 7, 7, 0.5])
    return spark.createDataFrame([r + extra for r in plain_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SMALL)
