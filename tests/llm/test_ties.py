"""Ties and damaged codes: the same row is kept whatever the order, undefined codes are errors, one id lies in many shards."""

import pytest
from pyspark.sql import functions as F

from lamella.llm import media, near_dedup, token_files
from lamella.llm.common import shared_path


def test_keep_one_of_equal_ids(spark):
    text = "some words that are here and there " * 9
    rows = [(1, text, s, n) for s, n in (("b", 2), ("a", 9), ("a", 3), ("a", 3), (None, 1))] + [(2, "other words " * 20, None, 5)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, tie int")
    for order in (F.col("tie").asc(), F.col("tie").desc()):
        got = near_dedup.keep_one(d.repartition(3, "tie").orderBy(order)).collect()
        assert sorted((r.doc_id, r.source, r.tie) for r in got) == [(1, "a", 3), (2, None, 5)]


def codes(*values):
    bits = "".join(f"{v:09b}" for v in values)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_undefined_lzw_codes():
    assert media.unpack_lzw(codes(256, 65, 258, 257), 9) == b"AAA"
    for bad in ((256, 65, 400, 257), (256, 259, 257), (256, 258, 257)):
        with pytest.raises(ValueError):
            media.unpack_lzw(codes(*bad), 9)


def test_one_id_in_many_shards(spark):
    rows = [(7, f"text {i} of one id") for i in range(400)] + [(None, f"text {i}") for i in range(100)] + [(8, "last")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    path = shared_path(spark, "ties")
    token_files.write_tokens(d, path)
    files = token_files.read_tokens(spark, path)
    assert files.where("doc_id = 7").select("shard").distinct().count() > 1
    sums = token_files.checksums(files).collect()
    assert len(sums) == 501
    spans = sorted((r.start, r.start + r.n_tokens, r.doc_id) for r in sums)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and [s[2] for s in spans] == [None] * 100 + [7] * 400 + [8]
