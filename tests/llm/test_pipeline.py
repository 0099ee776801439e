import hashlib
import re

import corpus_pipeline
from tests.llm import test_decontam, test_mixing, test_quality, test_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(rows, block=16):
    """Each row as often as a reading of whole blocks from the front takes it."""
    totals = test_mixing.ordered(rows)
    target = test_mixing.water(totals)
    seats = max(1, round(sum(target.values()) / block))
    quota = test_mixing.sainte_lague([(s, target[s]) for s, _ in totals if target[s] > 0], seats)
    out = []
    for s, total in totals:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"0:{'' if r[0] is None else r[0]}".encode()).hexdigest(), size(r[1])))
        wanted, low = min(quota.get(s, 0) * block, 3 * total), 0
        full = wanted // total if total else 0
        for r in own:
            n = size(r[1])
            taken = full * n + max(0, min(n, wanted - full * total - low))
            low += n
            out += [r] * (round(taken / n) if n else 1)
    return out


def brute(rows, items):
    kept = []
    for r in rows:
        n, _, _, _, hit = test_quality.base(r[1])
        if n >= 20 and 100 * hit <= 30 * n:
            kept.append(r)
    groups = test_simhash.groups([r[0] for r in kept], [test_simhash.fingerprint(r[1]) for r in kept])
    one, seen = [], set()
    for r, (d, _, c) in zip(kept, groups, strict=True):
        if d == c and d not in seen:
            seen.add(d)
            one.append(r)
    clean = [r for r in one if not test_decontam.brute(r[1], items)[1]]
    return mixed(clean)


def test_run_against_brute_force(spark, tmp_path, plain_rows):
    items = [(1, " ".join(plain_rows[5][1].split()[2:14])), (2, "nothing like this stands in any of the texts here at all")]
    spark.createDataFrame(plain_rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(plain_rows, items)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 16) for r in want)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stages_on_nothing(spark, tmp_path, empty):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_other_columns_stay_and_nothing_is_left_behind(spark, tmp_path, documents, plain_rows):
    from pathlib import Path

    from marginalia import session

    spark.createDataFrame([(1, "nothing like this stands in any of the texts here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents.drop("n_chars").withColumnRenamed("pool", "c0").withColumnRenamed("bucket", "row")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    kept = docs.count()
    docs = documents.drop("n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folders = lambda: [p.name for p in Path(session.shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith(("pipeline-", "quality-"))]
    before = set(folders())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept > 0
    assert set(folders()) <= before  # but for the stages that were called alone
    session.sweep(spark)
    assert not session.made()
