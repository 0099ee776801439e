import collections
import math
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import ctw


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_tree(texts, depth):
    """Counts by (context, decision) and the weights, recursively."""
    counts = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        s = bytes([ctw.END] * depth) + lower(t).encode() + bytes([ctw.END])
        for p in range(depth, len(s)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[d, s[p - d : p], 1 << j | s[p] >> (8 - j)][s[p] >> (7 - j) & 1] += 1
    children = collections.defaultdict(list)
    for d, c, k in counts:
        if d:
            children[d - 1, c[1:], k].append((d, c, k))

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    own = {}

    def weighted(node):
        leaf = pe(*counts[node])
        if node[0] == depth:
            own[node] = 1.0
            return leaf
        split = sum(map(weighted, children[node]))
        own[node] = 1 / (1 + math.exp(min(700, split - leaf)))
        return max(leaf, split) + math.log1p(math.exp(-abs(leaf - split))) - math.log(2)

    for node in [n for n in list(counts) if n[0] == 0]:
        weighted(node)
    return counts, own


def brute_score(text, counts, own, depth):
    s = bytes([ctw.END] * depth) + lower(text).encode() + bytes([ctw.END])
    total = 0.0

    def one(d, p, k):
        node = (d, s[p - d : p], k)
        if node not in own:
            return 0.5
        a, b = counts[node]
        kt = (b + 0.5) / (a + b + 1)
        return kt if d == depth else own[node] * kt + (1 - own[node]) * one(d + 1, p, k)

    for p in range(depth, len(s)):
        for j in range(8):
            q = one(0, p, 1 << j | s[p] >> (8 - j))
            total += math.log10(q if s[p] >> (7 - j) & 1 else 1 - q)
    return total


@pytest.fixture(scope="module")
def small(plain_rows):
    return [r for r in plain_rows if r[0] != 203]


def test_against_brute_force(documents, small):
    got = collections.defaultdict(list)
    for r in ctw.lm_scores(documents.where("coalesce(doc_id, 0) <> 203"), depth=2).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(small)
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in small}
    train = [r[1] for r in small if not held[r[0]]]
    counts, own = brute_tree(train, 2)
    tokens = collections.Counter(w for t in train for w in [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None])
    n, v = sum(tokens.values()), len(tokens)
    for d, t, *_ in small:
        r = got[d].pop() if len(got[d]) > 1 else got[d][0]
        w = [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in tokens for x in w), n)
        assert abs(r.base_score - sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert abs(r.score - brute_score(t, counts, own, 2)) < 1e-6 * max(1, abs(r.score))


def test_blocks_give_the_same(documents):
    docs = documents.where("coalesce(doc_id, 0) <> 203")
    one = sorted((str(r.doc_id), round(r.score, 6), r.n_bytes) for r in ctw.lm_scores(docs, depth=3).collect())
    many = sorted((str(r.doc_id), round(r.score, 6), r.n_bytes) for r in ctw.lm_scores(docs, depth=3, block_nodes=2000).collect())
    assert one == many


def test_probabilities_sum_to_one(spark, documents):
    grams = ctw.gram_counts(documents.where("doc_id < 20"), 2)
    table = ctw.tree(grams, 2).toArrow()
    import pyarrow.compute as pc

    model = ctw.Model(lambda d: table.filter(pc.field("depth") == d), 2)
    for context in (b"th", b"\xff\xff", b"qq", b"e "):
        head = int.from_bytes(context, "big") << 8
        assert abs((10 ** model.bits(head + np.arange(256))).sum() - 1) < 1e-9


def test_beats_the_order_below(documents):
    docs = documents.where("coalesce(doc_id, 0) <> 203")
    held = [sum(r.score for r in ctw.lm_scores(docs, depth=d).where("held_out").collect()) for d in (0, 2)]
    assert held[1] > held[0]


def test_long_texts_in_pieces(documents, monkeypatch):
    docs = documents.where("doc_id = 203").select("text")
    whole = {r.gram: r.n for r in ctw.gram_counts(docs, 2).collect()}
    text = docs.first().text
    s = bytes([255, 255]) + lower(text).encode() + b"\xff"
    want = collections.Counter(int.from_bytes(s[i : i + 3], "big") for i in range(len(s) - 2))
    assert whole == want
    import pyarrow as pa

    monkeypatch.setattr(ctw, "PIECE", 1000)
    got = collections.Counter()
    for _, key in ctw.pieces(pa.array([text, None, "ab"]), 2):
        got.update(key.tolist())
    for t in ("", "ab"):
        s = bytes([255, 255]) + t.encode() + b"\xff"
        want.update(int.from_bytes(s[i : i + 3], "big") for i in range(len(s) - 2))
    assert got == want


def test_empty(empty):
    assert ctw.lm_scores(empty).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ctw.lm_scores(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert (r.held_out, r.train_tokens, r.n_known, r.n_tokens) == (True, 0, 0, 3)
    assert abs(r.base_score) < 1e-12 and abs(r.score + 5 * 8 * math.log10(2)) < 1e-9


def test_ids_of_any_kind(spark, plain_rows):
    rows = [("", "one two"), ("a\nb", "one two three"), (None, "two"), ("x", None), ("", ""), ("x", "one"), ("long", plain_rows[-5][1]), ("x", "one")]
    got = ctw.lm_scores(spark.createDataFrame(rows, "doc_id string, text string"), depth=2).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((d, len((t or "").split()) + 1) for d, t in rows)
    for r in got:
        assert r.held_out == (zlib.crc32((r.doc_id or "").encode()) % 7 == 2)


def test_long_document_end_to_end(documents, plain_rows):
    got = [r for r in ctw.lm_scores(documents, depth=2).collect() if r.doc_id == 203]
    text = next(t for d, t, *_ in plain_rows if d == 203)
    assert len(got) == 1 and (got[0].n_tokens, got[0].n_bytes) == (len(text.split()) + 1, len(text.encode()) + 1)


def test_buckets_and_salts_give_the_same(documents, tmp_path, monkeypatch):
    docs = documents.withColumn("train", documents["n_chars"].isNotNull())
    plain = sorted(map(str, ctw.unigram(docs, f"file://{tmp_path}/a").collect()))
    monkeypatch.setattr(ctw, "CHUNK_TOKENS", 500)
    for n, sizes in enumerate([{"bucket_words": 20}, {"bucket_words": 20, "group_entries": 100}, {"group_entries": 300}]):
        assert sorted(map(str, ctw.unigram(docs, f"file://{tmp_path}/b{n}", **sizes).collect())) == plain


def test_scores_do_not_depend_on_the_layout(documents):
    docs = documents.where("coalesce(doc_id, 0) <> 203")
    a, b = (sorted(((str(r.doc_id), r.base_score, round(r.score, 9)) for r in ctw.lm_scores(d, depth=2).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
