import json
import re
import uuid

import pytest
import yaml
from pyspark.sql import functions as F

from marginalia.operators import chunk, parse

FULL = """---
status: Doing
due: "2026-02-28"
project: Atlas
nested: {b: [1, 2], a: true}
---
# Top
intro #alpha text #beta/sub é#no
## Second ##
- [ ] call [[Other Note|alias]] #alpha
* [X] done [[Plain]] and ![[Embed#part]]
#\tTabbed
"""


def notes(spark, texts, dates="iso"):
    rows = [(i, f"dir/n{i}.md", t, float(i)) for i, t in enumerate(texts)]
    return parse.parse_notes(spark.createDataFrame(rows, "seq long, path string, text string, mtime double"), dates)


def test_all_features(spark):
    n = notes(spark, [FULL]).first()
    assert (n.title, n.tags, n.links) == ("n0", ["alpha", "beta/sub"], ["Other Note", "Plain", "Embed#part"])
    assert n.headings == ["Top", "Second ##", "Tabbed"]
    assert n.tasks == ["call [[Other Note|alias]] #alpha", "done [[Plain]] and ![[Embed#part]]"]
    assert json.loads(n.frontmatter) == yaml.safe_load(FULL.split("---\n")[1])
    assert n.derived_fields == {"due_date": "2026-02-28", "status": "doing", "project": "Atlas"}
    assert n.note_id == n.content_hash[:16] and n.error is None


@pytest.mark.parametrize(("text", "front", "body"), [
    ("---\nstatus: [invalid\n---\nbody\n", {}, "body\n"), ("---\n- a\n- b\n---\nbody", {}, "body"), ("---\n---\nbody", {}, "---\n---\nbody"), ("no front", {}, "no front"),
    ("---\na: 1\nno end", {}, "---\na: 1\nno end"), ("", {}, ""), ("---\na: 1\n---\n", {"a": 1}, ""), (" ---\na: 1\n---\nx", {}, " ---\na: 1\n---\nx"),
])
def test_frontmatter(spark, text, front, body):
    n = notes(spark, [text]).first()
    assert (json.loads(n.frontmatter), n.body) == (front, body)


def test_dates(spark):
    text = "---\ndue: 2026-02-28\ncreated: 2026-01-02 10:00:00\nproject:\ncontext: 3\n---\nx"
    loose, strict = notes(spark, [text]).first(), notes(spark, [text], "strict").first()
    assert loose.derived_fields == {"due_date": "2026-02-28", "created_date": "2026-01-02 10:00:00", "project": "None", "context": "3"}
    assert loose.error is None and "JSON" in strict.error


def test_headings_and_tasks_span_lines(spark):
    n = notes(spark, ["#\nfoo\n- [ ]\n- [x] b\n"]).first()
    assert n.headings == ["foo"] and n.tasks == ["- [x] b"]


def sections(body):
    out, heading, own = [], "root", []
    for line in [*body.splitlines(), None]:
        m = line is not None and re.match(r"(#{1,6})\s+(.*)$", line)
        if line is None or m:
            if "\n".join(own).strip():
                out.append((heading, "\n".join(own).strip()))
            own = []
            if m:
                heading = m.group(2).strip()
        else:
            own.append(line)
    return out


BODIES = ["", "\n \n", "a\nb\n# H\n\n# H2 \nc\n```\n# in fence\n```\n", "# only", "x\r\n## Ü  \ny\x85z", "#no\n####### seven\n###### six\nt"]


def test_sections(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i int, b string")
    got = [[tuple(s) for s in r[0]] for r in df.orderBy("i").select(chunk.sections(F.col("b"))).collect()]
    assert got == [sections(b) for b in BODIES]


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 5, 2), (220, 120, 20), (500, 120, 20), (7, 3, 3), (7, 3, 9), (5, 0, 0), (10, 5, 0), (1, 500, 80)])
def test_windows(spark, n, size, overlap):
    toks = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(toks,)], "t array<string>").select(chunk.token_windows(F.col("t"), size, overlap)).first()[0]
    want = [toks[i : i + size] for i in range(0, n, max(1, size - overlap))] if size else []
    assert got == want


def test_overlap_and_ids(spark):
    body = "# H1\n" + " ".join(f"word{i}" for i in range(250)) + "\n\n## H2\n" + " ".join(f"word{i}" for i in range(250, 500))
    rows = chunk.chunk_notes(notes(spark, [body]), 120, 20).orderBy("section", "nth").collect()
    assert [(r.heading_path, r.nth) for r in rows] == [("H1", 0), ("H1", 1), ("H1", 2), ("H2", 0), ("H2", 1), ("H2", 2)]
    assert rows[0].text.split()[-20:] == rows[1].text.split()[:20]
    for r in rows:
        assert r.chunk_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.note_id}:{r.heading_path}:{r.nth}:{r.text}"))


def test_long_notes_in_linear_work(spark):
    import time

    text = "\n".join(f"## h{i}\nline {i}" if i % 2 else f"line {i}" for i in range(100_000))
    began = time.time()
    s = notes(spark, [text]).select(chunk.sections(F.col("body")).alias("s")).first().s
    assert len(s) == 50_001 and s[1].heading == "h1" and s[1].text == "line 1\nline 2" and time.time() - began < 30
