import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {x for x in wins if wins.count(x) > 1} if len(wins) < 3000 else set()
    hit = {i + k for i, x in enumerate(wins) if x in often for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    texts = ["a b c d e f g h " * 3, "x y\nx y\n\n \nx y", None, "", "ä# <b> &| z", "one two three four five six seven eight nine one two three four five six seven eight", " ".join("abcdefgh") + " q " + " ".join("abcdefgh") + " q",
             "\x0b\x0ca\tb\r\nc", "a b c d e f g h i " * 40]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_base_of_all_rows(documents, plain_rows):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.base_failed) for r in quality.verdicts(documents).collect()), key=str)
    want = []
    for d, t, *_ in plain_rows:
        n, c, s, u, h = base(t)
        want.append((d, n, c, s, u, n < 20 or 100 * h > 30 * n))
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want, key=str)]
    short = {x[0] for x in want if x[1] < 3000}
    assert [x for x in got if x[0] in short] == [x for x in sorted(want, key=str) if x[0] in short]


def brute(x, subset, steps, floor):
    centre, k = np.array([np.sort(c)[(len(c) - 1) // 2] for c in x.T], float), np.diag(1 / floor)
    for _ in range(steps):
        d = (((x - centre) @ k.T) ** 2).sum(1)
        bins = np.floor(64 * np.log2(d + 1e-9)).astype(int)
        near = x[bins <= np.sort(bins)[int(np.ceil(subset * len(x))) - 1]]
        centre = near.mean(0)
        k = np.linalg.inv(np.linalg.cholesky(np.cov(near.T, bias=True) + np.diag(floor**2)))
    return (((x - centre) @ k.T) ** 2).sum(1)


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("w" * int(k) for k in rng.integers(1, 9, rng.integers(25, 80))) + "." * int(rng.integers(0, 4)) for _ in range(300)]
    texts += [" ".join("$$$$$&&&&" for _ in range(30)) for _ in range(5)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    ok = quality.counts(df).where("not base_failed").select("doc_id", *quality.vector()).orderBy("doc_id").collect()
    x = np.array([r[1:] for r in ok], float)
    want = brute(x, quality.SUBSET, quality.STEPS, np.array([quality.SCALE * s for s in quality.STATISTICS.values()]))
    factor = quality.SUBSET / quality.chi2_cdf(quality.chi2_at(1 - quality.SUBSET, quality.P), quality.P + 2)
    got = {r.doc_id: r.d2 for r in quality.verdicts(df).collect() if r.d2 is not None}
    assert set(got) == {r.doc_id for r in ok}
    np.testing.assert_allclose([got[r.doc_id] for r in ok], want / factor, rtol=1e-6)


def test_rejects_symbols_keeps_prose(spark, plain_rows):
    junk = [(1000 + i, " ".join(f"stone{k}$$$$ &&&&{i}" for k in range(40)), "en", "a", 1) for i in range(5)]
    good = [r for r in plain_rows if r[1] and 20 <= len(r[1].split()) < 1000] * 4
    df = spark.createDataFrame([(r[0], r[1], "en", "a", 1) for r in good] + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality.verdicts(df).collect()}
    assert not any(kept[r[0]] for r in junk)
    fine = {r[0] for r in good if base(r[1])[4] * 100 <= 30 * base(r[1])[0]}
    assert all(kept[d] for d in fine)
    left = quality.keep_good(df.withColumn("lang2", F.lit(1)))
    assert left.columns == [*df.columns, "lang2"]
    assert {r.doc_id for r in left.select("doc_id").collect()} == {d for d, k in kept.items() if k}


def test_rare_pairs_are_judged_by_their_language_then_by_all(spark, plain_rows):
    good = [r[1] for r in plain_rows if r[1] and 20 <= len(r[1].split()) < 1000 and base(r[1])[4] == 0]
    junk = " ".join(f"stone{k}$$$$ &&&&{k}" for k in range(40))
    rows = [(i, good[i % len(good)], "en", "large") for i in range(400)]
    rare = [("en", "rare"), ("xx", "large"), (None, None), ("en", None)]
    rows += [(1000 + i, junk, *p) for i, p in enumerate(rare)] + [(2000 + i, good[i], *p) for i, p in enumerate(rare)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert not any(got[1000 + i].base_failed or got[1000 + i].kept for i in range(4))
    assert all(got[2000 + i].kept and got[2000 + i].d2 is not None for i in range(4)) and all(got[i].kept for i in range(400))
    x = np.array([r[1:] for r in quality.counts(df).where("lang = 'en'").select("doc_id", *quality.vector()).orderBy("doc_id").collect()], float)
    factor = quality.SUBSET / quality.chi2_cdf(quality.chi2_at(1 - quality.SUBSET, quality.P), quality.P + 2)
    want = brute(x, quality.SUBSET, quality.STEPS, np.array([quality.SCALE * s for s in quality.STATISTICS.values()])) / factor
    ids = sorted(r[0] for r in rows if r[2] == "en")
    np.testing.assert_allclose([got[d].d2 for d in (1000, 1003, 2000, 2003)], [want[ids.index(d)] for d in (1000, 1003, 2000, 2003)], rtol=1e-6)


def test_empty(empty):
    assert quality.verdicts(empty).count() == 0


@pytest.mark.parametrize(("x", "k", "p"), [(6.6257, 5, 0.75), (11.0705, 5, 0.95), (3.8415, 1, 0.95)])
def test_chi_square(x, k, p):
    assert abs(quality.chi2_cdf(x, k) - p) < 1e-4
    assert abs(quality.chi2_at(1 - p, k) - x) < 1e-3
