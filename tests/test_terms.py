"""Term automata against patterns, part tables with two writers, records that come once, and one write by outcome."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lamella.operators import analysis, catalog, rules, terms
from lamella.sources import writers
from lamella.streaming import ingest, ledger


def test_terms_equal_patterns(spark):
    rng = random.Random(1)
    bits = ["tem", "sem", "fib-sem", "er", " er ", "em", "volume em", "x", "9", "-", "_", "/", " ", ".", "é", "serial block face", "serial_block/face"]
    rows = [(i, None if i % 37 == 0 else "".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, t string")
    own = {"m": terms.words(catalog.MODALITY_TERMS), "e": terms.parts(catalog.EVIDENCE_TERMS), "none": terms.words([])}
    got = d.select("id", terms.found(F.col("t"), own).alias("x")).select("id", "x.*")
    want = d.select("id", F.coalesce(rules.term_hits(F.col("t"), catalog.MODALITY_TERMS), F.array()).alias("m"), F.coalesce(rules.substring_hits(F.col("t"), catalog.EVIDENCE_TERMS), F.array()).alias("e"))
    assert {r.id: (r.m, r.e) for r in got.collect()} == {r.id: (r.m, r.e) for r in want.collect()}
    assert got.where("size(none) > 0").count() == 0


def test_lists_of_a_file(spark, tmp_path):
    many = [f"term {i}" for i in range(10_000)]
    (tmp_path / "rules.json").write_text(json.dumps({"version": 3, "lists": {"many": {"terms": many}, "inside": {"terms": ["zz"], "match": "part"}}}))
    own = terms.load_lists(spark, str(tmp_path / "rules.json"))
    assert own == {"many": terms.words(many), "inside": terms.parts(["zz"])}
    assert terms.fingerprint(own) != terms.fingerprint(own | {"inside": terms.words(["zz"])})
    assert terms.hits("a term-17, term 9999 and term 99991 zzz", tuple(own.items())) == [["term 17", "term 9999"], ["zz"]]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        terms.load_lists(spark, str(tmp_path / "bad.json"))


def test_parts_are_parsed_once(spark, tmp_path):
    """Half-written data are not there; of two writers each part comes once; known parts aren't read again."""
    table, parsed = str(tmp_path / "t"), []
    offer = lambda *names: spark.createDataFrame([(n, i) for n in names for i in range(3)], "part string, v int")

    def parse(d):
        parsed.append(sorted(r.part for r in d.select("part").distinct().collect()))
        return d.where("v < 2")

    read = lambda: sorted((r.part, r.v) for r in ledger.read_parts(spark, table, "part string, v int").collect())
    assert read() == []

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ledger.add_parts(spark, table, offer("a"), parse, stop)
    assert read() == []
    assert ledger.add_parts(spark, table, offer("a", "b"), parse) == 2
    other = lambda: ledger.add_parts(spark, table, offer("c", "d"), parse)
    assert ledger.add_parts(spark, table, offer("b", "c", "e"), parse, other) == 1
    assert parsed == [["a"], ["a", "b"], ["c", "e"], ["c", "d"]]
    assert read() == [(p, v) for p in "abcde" for v in (0, 1)]
    assert ledger.add_parts(spark, table, offer("a", "e"), parse) == 0 and len(parsed) == 4
    assert not ledger.make_once(spark, f"{table}/manifests/00000001.json", "x")


def test_repeats_without_horizon(spark, tmp_path):
    """A repeat comes batches later, long after any watermark, and after a restart."""
    schema = "k int, v int"
    for half in range(2):
        for i in range(4):
            rows = [(k, 100 * half + 10 * i + (k or 0)) for k in (i, i, i + 1, 0, None)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = ingest.read_stream(spark, str(tmp_path / "in"), schema, files=1)
        ledger.keep_first(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], ["v"], fanout=3)
    got = ledger.first_records(spark, str(tmp_path / "out"), schema).collect()
    assert sorted((r.k is not None, r.k) for r in got) == sorted((k is not None, k) for k in (None, 0, 1, 2, 3, 4))
    assert ledger.first_records(spark, str(tmp_path / "none"), schema).count() == 0


def test_one_write_by_outcome(spark, tmp_path):
    d = spark.range(10).select("id", (F.col("id") % 3).alias("source"))
    error = F.when(F.col("id") > 7, "big").when(F.col("id") == 0, "zero")
    seen = {(r.source, r.error): r.n for r in writers.by_outcome(d, error, str(tmp_path / "o"), "source").collect()}
    assert seen == {(None, None): 7, ("2", "big"): 1, ("0", "big"): 1, ("0", "zero"): 1}
    schema = d.withColumn("error", error).schema
    assert writers.outcome(spark, str(tmp_path / "o"), "good", schema).count() == 7
    assert {(r.id, r.error) for r in writers.outcome(spark, str(tmp_path / "o"), "bad", schema).collect()} == {(8, "big"), (9, "big"), (0, "zero")}
    assert [r.n for r in writers.by_outcome(d, F.lit(None).cast("string"), str(tmp_path / "p")).collect()] == [10]


def test_numbers_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    schema = "k int, a double, s struct<f: float, l: array<array<double>>, m: map<string, struct<x: double>>, t: string>, _no: double"
    rows = [(1, nan, (inf, [[1.0, nan], [], [-inf]], {"u": (nan,), "_v": (nan,), "w": (1.0,)}, "nan"), nan), (2, 1.0, None, nan), (3, None, (1.0, None, None, None), 1.0)]
    got = {(r.k, r.path) for r in analysis.non_finite(spark.createDataFrame(rows, schema), "k").collect()}
    assert got == {(1, p) for p in ("a", "s.f", "s.l[0][1]", "s.l[2][0]", "s.m.u.x")}
