import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import tokencount

HERE = os.path.exists(tokencount.VOCABULARY)


@pytest.mark.skipif(not HERE, reason="no vocabulary")
@pytest.mark.parametrize("block", [tokencount.BLOCK_TOKENS, 7, 64])
def test_counts(documents, plain_rows, block):
    enc = tokencount.encoder(tokencount.VOCABULARY)
    docs, want = documents, plain_rows
    if block < 64:
        docs, want = documents.where("coalesce(doc_id, 0) <> 203"), [r for r in plain_rows if r[0] != 203]
    got = [tuple(r) for r in tokencount.token_counts(docs, block_tokens=block).collect()]
    assert sorted(got, key=str) == sorted([(r[0], len(enc.encode_ordinary(r[1] or ""))) for r in want], key=str)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_scan_of_given_files(spark, tmp_path, block):
    r = np.random.default_rng(2)
    want = []
    for name in ("x.u16", "y.u16"):
        lengths = [0, 0, 9, *r.integers(0, 12, 20).tolist(), 0]
        ids = np.concatenate([np.append(r.integers(0, 100, n), 500) for n in lengths]).astype(np.uint16)
        ids.tofile(tmp_path / name)
        want += [(name, i, n) for i, n in enumerate(lengths)]
    pieces = tokencount.blocks(spark, str(tmp_path), ["x.u16", "y.u16"], block)
    got = [tuple(x) for x in tokencount.stitch(tokencount.separators(pieces, str(tmp_path), eod=500)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.skipif(not HERE, reason="no vocabulary")
def test_empty(empty):
    assert tokencount.token_counts(empty.select(F.col("doc_id"), "text")).count() == 0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_last_document_without_a_separator(spark, tmp_path, block):
    np.array([1, 2, 500, 3, 4, 5], np.uint16).tofile(tmp_path / "x.u16")
    np.array([1, 2], np.uint16).tofile(tmp_path / "y.u16")
    pieces = tokencount.blocks(spark, str(tmp_path), ["x.u16", "y.u16"], block)
    got = [tuple(x) for x in tokencount.stitch(tokencount.separators(pieces, str(tmp_path), eod=500)).collect()]
    assert sorted(got) == [("x.u16", 0, 2), ("x.u16", 1, 3), ("y.u16", 0, 2)]


def test_vocabularies_that_clash_are_refused(tmp_path):
    import base64

    path = tmp_path / "v.tiktoken"
    for ids, eod in (([0, 7], 7), ([0, 70_000], 7), ([0], 70_000)):
        path.write_text("".join(f"{base64.b64encode(bytes([65 + i])).decode()} {k}\n" for i, k in enumerate(ids)))
        with pytest.raises(ValueError, match="ids above"):
            tokencount.ranks(str(path), eod)
