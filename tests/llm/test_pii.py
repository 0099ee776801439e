import random
import re

import pytest

from marginalia.llm import entries, pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for kind, rx in RULES.items():
        for m in re.finditer(rx, text or ""):
            n = len(re.sub("[^0-9]", "", m.group()))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= n <= 19 and luhn(m.group()), "phone": 9 <= n <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def noise(r):
    parts = ["a@b.co", "x.y@m-1.example.com.", "a@b", "a@b.c-d@e.f", "a@b.c_d@e.f", "é@x.y", "%%@a.b..c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.2.003", "1.2.3", "99999999999999999999.1.1.1",
             "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111111111111111", "4111  111111111111", "123456789012", "5500 0000 0000 0004", "+1 (555) 123-4567", "+1234", "+49 30 1234567 ", "++15551234567", "+1.5551234567-", "ü", "5", "-", " ", "\n", "中", "😀", "@", "."]
    return "".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randint(1, 14)))


def test_base_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i, noise(r)) for i in range(400)] + [(400, None), (401, ""), (402, "a" * 5000 + "@b.c " + "1" * 3000 + " 1." * 300)]
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.base] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


@pytest.mark.parametrize(("text", "want"), [
    ("please mail anna (at) mail7 (dot) com today", [("email", 12, 37)]), ("call 555-123-4567 now", [("phone", 5, 17)]), ("ssn 123-45-6789", [("ssn", 4, 15)]),
    ("the river 2019 stone 12 walks", []), ("order 123-45-6789", []), ("token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\"", []), ("build 1234567890123456 done", []),
])
def test_added(spark, text, want):
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.kind, s.start, s.end) for s in r.added] == want


def test_held_out_accuracy_of_the_trees(spark):
    model = pii.fit(spark)
    import pyspark.sql.functions as F

    made = pii.features("c")
    frame = spark.createDataFrame(pii.labelled_lines(500, seed=99), "text string, kind string, mark int")
    rows = frame.select("text", "kind", "mark", F.expr(f"explode(filter({pii.candidates()[1]}, x -> x.kind = kind)) as c")).select("mark", *[F.expr(s).alias(n) for n, s in made.items()])
    scored = rows.select("mark", F.expr(model.sql(list(made))).alias("p")).collect()
    assert sum((r.p >= 0.5) == bool(r.mark) for r in scored) > 0.9 * len(scored)
    sure = [r.mark for r in scored if r.p >= 0.9]
    assert sum(sure) >= 0.95 * len(sure) and len(sure) > 50


def test_rows_and_redaction(spark, documents, plain_rows, empty):
    assert pii.find(documents).count() == len(plain_rows) and pii.find(empty).count() == 0
    df = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 123-4567."), (2, "ü none"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()} == {1: "mail [EMAIL] or [PHONE].", 2: "ü none", 3: None}
    assert set(entries.queries()) >= {"op7_pii"}


def test_many_labels_and_spans(spark):
    """Patterns don't recurse, and work follows the length of a text."""
    rows = [(1, "a@b" + ".c" * 100_000), (2, "x@y.com " * 100_000), (3, "ab (at) cd" + ".ef" * 100_000), (4, "call 555-123-4567 now " * 10_000), (5, "12:" * 50_000), (6, "ab (at) " + "123-45-6789." * 10_000)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1].base] == [("email", 0, 200_003)] and not got[1].added
    assert [(s.start, s.end) for s in got[2].base] == [(8 * i, 8 * i + 7) for i in range(100_000)]
    assert [(s.start, s.end) for s in got[4].added] == [(22 * i + 5, 22 * i + 17) for i in range(10_000)]


@pytest.mark.parametrize(("text", "want"), [
    ("login from 2001:db8:0:1:1:1:1:1 ok", [(11, 31)]), ("ip 192[.]168[.]1[.]7 seen", [(3, 20)]), ("host fe80::1 up", [(5, 12)]), ("at 12:30:45 it", []), ("mac 00:1a:2b:3c:4d:5e", [])])
def test_added_addresses(spark, text, want):
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in r.added if s.kind == "ip"] == want and len(r.added) == len(want)


def test_added_spans_against_brute_force(spark):
    """What is added: proposals over their kind's threshold that no base span overlaps; those that overlap are one."""
    import pyspark.sql.functions as F

    r = random.Random(12)
    lines = [x[0] for x in pii.labelled_lines(400, seed=5)]
    texts = [r.choice(["; ", " ", ""]).join(r.sample(lines, 6)) + r.choice(["", " a@b.co", " 4111 1111 1111 1111"]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, limits = pii.calibrated(spark)
    made = pii.features("c")
    rows = df.select("doc_id", F.expr(f"explode({pii.candidates()[1]}) as c")).select("doc_id", "c.kind", "c.start", "c.end", *[F.expr(s).alias(f"f_{n}") for n, s in made.items()]).collect()
    p = model.predict(__import__("numpy").array([tuple(x)[4:] for x in rows]))
    want = {i: [] for i in range(len(texts))}
    base = {i: brute(t) for i, t in enumerate(texts)}
    for x, q in zip(rows, p, strict=True):
        if q >= limits[x.kind] and not any(a < x.end and x.start < b for _, a, b in base[x.doc_id]):
            want[x.doc_id].append((x.start, x.end, float(q), x.kind))
    merged = {}
    for i, found in want.items():
        out = []
        for a, b, q, k in sorted(found):
            if out and a < out[-1][1]:
                best = max((out[-1][2], out[-1][3]), (q, k), key=lambda z: z[0])
                out[-1] = (out[-1][0], max(b, out[-1][1]), *best)
            else:
                out.append((a, b, q, k))
        merged[i] = sorted((a, b, k) for a, b, _, k in out)
    got = {x.doc_id: sorted((s.start, s.end, s.kind) for s in x.added) for x in pii.find(df).collect()}
    assert got == merged and sum(map(len, merged.values())) > 200


def test_thresholds():
    import numpy as np

    assert pii._threshold(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 0, 1])) == 0.8
    assert pii._threshold(np.array([0.9, 0.9]), np.array([1, 0])) > 1 and pii._threshold(np.empty(0), np.empty(0)) > 1


def test_redaction_of_rows_that_share_an_id(spark):
    rows = [(1, "mail a@b.co now please", "x"), (1, "nothing to see here at all", "y"), (None, "a@b.co 😀 c@d.ef!", "z"), (None, "n" * 3000 + " a@b.co " + "m" * 3000, None)]
    got = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "mail [EMAIL] now please", "x"), (1, rows[1][1], "y"), (None, "[EMAIL] 😀 [EMAIL]!", "z"), (None, "n" * 3000 + " [EMAIL] " + "m" * 3000, None)], key=str)
