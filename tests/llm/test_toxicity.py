import random
import zlib

import numpy as np
import pytest

from marginalia.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, plain_rows):
    r = random.Random(4)
    rows, labels = [], []
    bad = ["idiot", "moron", "pathetic", "worthless"]
    for i in range(360):
        text = r.choice(plain_rows[:60])[1]
        toxic = i % 3 == 0
        if toxic:
            w = text.split()
            for b in r.sample(bad, 2):
                w.insert(r.randint(0, len(w)), b)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    disguised = {"an 1d10t here": 1, "you m0r0n you": 1, "so p a t h e t i c now": 1, "iiiidiooot that": 1, "w0rthl3ss and 1d!ot": 1, "river stone 2nd light 3rd": 0, "a b c d e": 0, "coool": 0}
    rows += [(1000 + i, t) for i, t in enumerate(disguised)]
    rows += [(2000, None), (2001, ""), (5, rows[5][1]), (None, "idiot moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    return docs, marks, disguised, dict(labels)


def test_held_out_accuracy(corpus):
    docs, marks, _, labels = corpus
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_disguised_words(corpus):
    docs, marks, disguised, _ = corpus
    model = toxicity.fit(docs, marks)
    assert {"idiot", "moron", "pathetic", "worthless"} <= set(model.lexicon)
    trie = toxicity.trie_of(model.lexicon)
    for text, bad in disguised.items():
        found, _, spans = model.hits(text, trie, {})
        assert bool(found) == bool(bad), text
        assert all(text[a:b] for a, b, _ in spans)
    assert model.channel.restore("1d10t") == "idiot" and model.channel.restore("m.o.r.o.n") == "moron"


def test_substitutes_anywhere_in_a_run(corpus):
    docs, marks, *_ = corpus
    model = toxicity.fit(docs, marks)
    trie = toxicity.trie_of(model.lexicon)
    for text, word in {"an idi0t here": "idiot", "you mor0n": "moron", "p4thetic and w0rthles$ now": "worthless"}.items():
        found, _, spans = model.hits(text, trie, {})
        assert found.get(model.lexicon.index(word)) == 1 and any(x == word for *_, x in spans), text
    assert model.hits("idiot! (moron", trie, {})[0] == model.hits("idiot moron", trie, {})[0] and not model.hits("idiot! (moron", trie, {})[2]
    assert 3000 <= len(model.channel.restore("a1" * 3000)) <= 6000  # the whole run


def test_letter_counts(spark):
    got = {r.code: r.n for r in toxicity.letter_counts(spark.createDataFrame([("Aba", 1), (None, 2), ("", 3)], "text string, x int")).collect()}
    assert got == {(1 * 27 + 2) * 27 + 1: 1}


def test_no_labels(spark, corpus, empty):
    docs, marks, *_ = corpus
    none = marks.where("false")
    assert toxicity.toxicity(docs.limit(3), none).count() == 3
    assert toxicity.toxicity(empty, none).count() == 0
    model = toxicity.character_model(np.zeros(27**3), [])
    np.testing.assert_allclose(np.exp(model).sum(-1), 1)


def brute_reading(channel, span):
    """The best score over every way to read, leave out or break at each character."""
    best = (-1e300, "")

    def go(i, a, b, last, score, text):
        nonlocal best
        if i == len(span):
            total = score + channel.logp[a, b, 0]
            if total > best[0]:
                best = (total, text.strip())
            return
        c = span[i]
        readings, skip, gap = channel.options(c, last)
        following = last if gap else c
        for r, cost in readings:
            go(i + 1, b, ord(r) - 96, following, score + cost + channel.logp[a, b, ord(r) - 96], text + r)
        if skip is not None:
            go(i + 1, a, b, following, score + skip, text)
        if gap and b:
            go(i + 1, 0, 0, following, score + channel.logp[a, b, 0] + channel.split, text + " ")

    go(0, 0, 0, "", 0.0, "")
    return best[1]


def test_viterbi_against_all_readings(corpus):
    docs, marks, *_ = corpus
    channel = toxicity.fit(docs, marks).channel
    r = random.Random(6)
    spans = ["1d10t", "m o r 0 n", "sss111", "a-b.c*d", "w0rthl3", "y o u i d 1 o t"[:11]] + ["".join(r.choice("abdiorst013!$ .*") for _ in range(r.randint(1, 9))) for _ in range(150)]
    for span in spans:
        assert channel.restore(span) == brute_reading(channel, span), span


def test_words_beside_spaced_letters(corpus):
    docs, marks, *_ = corpus
    model = toxicity.fit(docs, marks)
    trie = toxicity.trie_of(model.lexicon)
    long = "idi" + "o" * 60 + "t"
    for text in ("such a i d i o t", "y o u i d i o t", long, "m.o.r.o.n", "w-o-r-t-h-l-e-s-s", "p a t h 3 t 1 c river"):
        found, _, spans = model.hits(text, trie, {})
        assert found.get(-1) and spans, text
    text = "so an 1d10t, and a m o r o n"
    plain, spans, places = model.restored(text, trie, {})
    assert plain == "so an idiot, and a moron" or plain == "so an idiot, and amoron"
    assert [plain[a:b] for a, b in places] == [x for *_, x in spans] and [text[a:b] for a, b, _ in spans][0] == "1d10t"


def test_linear_work(corpus):
    import time

    docs, marks, *_ = corpus
    model = toxicity.fit(docs, marks)
    trie = toxicity.trie_of(model.lexicon)
    for text in ("!" * 1_000_000, "+1" * 250_000, "a" * 1_000_000, "word " * 200_000, "a b " * 100_000, "1a " * 100_000, "aaa!" * 50_000):
        began = time.process_time()
        model.hits(text, trie, {})
        assert time.process_time() - began < (1 if text[0] == "!" else 20), text[:4]


def test_disguised_words_in_held_out_documents(spark, corpus):
    docs, marks, _, labels = corpus
    leet = str.maketrans("oiea", "0134")
    change = [lambda w: w.translate(leet), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: ".".join(w)]
    rows = []
    for k, r in enumerate(docs.where("doc_id < 360").collect()):
        text = r.text
        for w in ("idiot", "moron", "pathetic", "worthless"):
            text = " ".join(change[k % 4](w) if x == w else x for x in text.split(" "))
        rows.append((10_000 + r.doc_id, text, labels[r.doc_id]))
    model = toxicity.fit(docs, marks)
    trie, cache = toxicity.trie_of(model.lexicon), {}
    scored = [(mark, model.score(*model.hits(text, trie, cache)[:2]) >= 0.7) for _, text, mark in rows]
    caught = [p for mark, p in scored if mark]
    left = [not p for mark, p in scored if not mark]
    assert sum(caught) >= 0.9 * len(caught) and sum(left) >= 0.97 * len(left), (sum(caught), len(caught), sum(left), len(left))


def test_clashing_columns_ties_and_long_texts(spark, documents, plain_rows):
    marks = spark.createDataFrame([(i, i % 2, 9) for i in range(60)] + [(3, 1, 0), (3, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(documents, marks).collect()
    assert len(got) == len(plain_rows)
    same = {r.score for r in got if r.doc_id == 3}
    assert len(same) == 1 and all(0 <= r.score <= 1 for r in got)


def test_accents_and_beginnings():
    channel = toxicity.Channel(toxicity.character_model(np.zeros(27**3), ["réeux-", "bomente-", "idiot"]))
    model = toxicity.Model(["réeux-", "bomente-", "idiot"], np.zeros(3 + toxicity.EXTRA), channel)
    trie = toxicity.trie_of(model.lexicon)
    for text in ("r é e u x m e", "r3éuxme", "réeeeuxme", "b0m3nt3rr", "i.d.i.o.t"):
        assert model.hits(text, trie, {})[0].get(-1) or text == "r3éuxme", text
    assert [toxicity.code(c) for c in "aéñz1 中"] == [1, 5, 14, 26, 0, 0, 0]
    assert toxicity.disguised("第3章 ok réé3x") == [(0, 3), (7, 12)]
