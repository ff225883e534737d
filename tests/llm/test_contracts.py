"""The contracted queries against plain Python over the same documents."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamella.llm import line_dedup, media, mixing, packing, quality, queries, token_counts, token_files
from lamella.llm.common import BLANKS, shared_path
from lamella.llm.tokens import BYTE_BPE, WORD_BPE

WORD = re.compile(r"[^ \t-\r]+")
FRESH = {p: Tokenizer.from_file(p) for p in (BYTE_BPE, WORD_BPE)}
LONG = "long. " * 30_000
TEXTS = ["", None, "one word", "a\n\nb  c\t d", "é ü ß Ω 漢字 \x1c \xa0 İ", LONG, "same line that is long enough\nother", "Same line that is LONG enough \nx", "  same line that is long enough", "same line that is long enough", "<|endoftext|> it's"]
ROWS = [(i, t, ("a", "b", None)[i % 3], i % 5) for i, t in enumerate(TEXTS)] + [(3, "a\n\nb  c\t d", "a", 1), (3, "a\n\nb  c\t d", "a", 1), (None, "no id here", "b", 0)]
SCHEMA = "doc_id long, text string, source string, h1 int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and a column whose name an operator uses."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def ids(path, text, end=None):
    found = FRESH[path].encode(text or "", add_special_tokens=False).ids
    return np.array(found + ([] if end is None else [end]), "<u4")


def test_packing(spark, sf):
    docs = texts(sf)
    pieces = queries.op1_packing(spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, own in by_doc.items():
        want, at = ids(BYTE_BPE, docs[doc_id], 0), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    full = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        full += at == 1024
    assert full >= len(by_sequence) - 1


def test_packing_neighbours(spark, odd, empty):
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
    assert packing.pack_along_curve(empty).count() == 0
    got = packing.pack_along_curve(odd, length=8).groupBy("doc_id").sum("length").collect()
    want = Counter()
    for r in ROWS:
        want[r[0]] += len(ids(BYTE_BPE, r[1], 0))
    assert dict(map(tuple, got)) == dict(want)


def test_mixing(spark, sf, odd, empty):
    out = queries.op3_mixing(spark, sf).toPandas()
    want = {k: len(WORD.findall(t or "")) for k, t in texts(sf).items()}
    assert dict(zip(out["doc_id"], out["size"])) == want
    assert (out["taken"] <= 3 * out["size"]).all()
    assert abs(out["taken"].sum() - out["size"].sum()) <= 20
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(odd).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_mixing_weights(spark):
    """Heavier documents are taken first more often."""
    docs = spark.range(4000).selectExpr("id as doc_id", "'w' as text", "if(id % 2 = 0, 'big', 'small') as source", "if(id % 4 < 2, 3.0D, 1.0D) as w")
    t = {r["source"]: r for r in mixing.source_targets(docs.selectExpr("source", "1L as size")).collect()}
    assert abs(t["big"]["target"] - 4000 / 3) < 1e-6 and abs(t["small"]["target"] - 8000 / 3) < 1e-6
    docs = docs.selectExpr("doc_id", "text", "w", "if(doc_id < 3000, 'a', 'b') as source")
    by = {r["heavy"]: r[1] for r in mixing.mix(docs, docs.selectExpr("doc_id", "w as weight")).where("doc_id < 3000 and taken > 0").groupBy((F.col("doc_id") % 4 < 2).alias("heavy")).count().collect()}
    assert by[True] > 1.2 * by[False]


def test_tiff(spark, sf, odd, empty):
    for got in (queries.op4_tiff(spark, sf).collect(),):
        docs = texts(sf)
        assert len(got) == len(docs)
        for r in got:
            raw = (docs[r.doc_id] or "").encode()
            payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    got = media.page_features(media.read_pages(media.stored_texts(odd))).collect()
    assert len(got) == len(ROWS)
    assert media.page_features(media.read_pages(media.stored_texts(empty))).count() == 0


@pytest.mark.parametrize("how", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
def test_tiff_round_trip(how):
    dealt = np.random.default_rng(3)
    for n, kind in ((64, 0), (64 * 700, 1), (64 * 5000, 2)):
        payload = (bytes(n), dealt.integers(0, 256, n, np.uint8).tobytes(), dealt.integers(97, 100, n, np.uint8).tobytes())[kind]
        for order in "<>":
            for predictor in (1, 2):
                for tile in (0, 32):
                    raw = media.write_tiff(payload, compression=how, predictor=predictor, tile=tile, order=order, rows_per_page=2000)
                    assert b"".join(p[-1] for p in media.pages(raw)) == payload


def test_tiff_forms():
    """Every form meets short and long texts alike."""
    for form in media.FORMS:
        for n in (64, 4096, 300_000):
            payload = (b"some text " * (n // 10 + 7))[: n // 64 * 64]
            assert b"".join(p[-1] for p in media.pages(media.write_tiff(payload, **form))) == payload
    met = {zlib.crc32(media.store_text("x" * n)[:0] + ("x" * n).encode() + bytes(-n % 64)) % 4 for n in range(1, 40)}
    assert met == {0, 1, 2, 3}


def tiff_header(**changed):
    """A file of one 64 x 2 page whose fields are changed as told."""
    raw = bytearray(media.write_tiff(bytes(128), compression=media.NONE))
    at = struct.unpack_from("<I", raw, 4)[0]
    for i in range(struct.unpack_from("<H", raw, at)[0]):
        tag = struct.unpack_from("<H", raw, at + 2 + 12 * i)[0]
        for name, value in changed.items():
            if getattr(media, name) == tag:
                struct.pack_into("<I", raw, at + 10 + 12 * i, value)
    return bytes(raw)


def test_tiff_bad(spark):
    bad = [b"II", None, b"II*\0\0\0\0\0", tiff_header(WIDTH=0), tiff_header(WIDTH=1 << 20, HEIGHT=1 << 20), tiff_header(ROWS_PER_STRIP=0), tiff_header(STRIP_OFFSETS=1 << 30), tiff_header(BITS=7), tiff_header(COMPRESSION=media.LZW, HEIGHT=1 << 30, ROWS_PER_STRIP=1 << 30)]
    bad += [media.write_tiff(bytes(range(256)) * 8, compression=media.NONE, tile=32).replace(struct.pack("<HHII", media.TILE_WIDTH, 4, 1, 32), struct.pack("<HHII", media.TILE_WIDTH, 4, 1, 0))]
    got = media.read_pages(spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "page int, media binary")).collect()
    assert len(got) == len(bad) and all(r.error and r.data is None for r in got)
    good = media.read_pages(spark.createDataFrame([(tiff_header(),)], "media binary")).collect()
    assert [r.data for r in good] == [bytes(128)]


def test_tiff_fuzzed():
    """Files with bytes changed, cut or doubled give pages or one of the errors that become a row, and little memory."""
    dealt = random.Random(6)
    whole = [media.write_tiff(dealt.randbytes(64 * 40), **form) for form in media.FORMS]
    for _ in range(3000):
        raw = bytearray(dealt.choice(whole))
        for _ in range(dealt.randrange(1, 5)):
            raw[dealt.choice([dealt.randrange(len(raw)), -dealt.randrange(1, 160), dealt.randrange(8)])] = dealt.choice([0, 255, dealt.randrange(256)])
        if dealt.random() < 0.2:
            del raw[dealt.randrange(len(raw)) :]
        try:
            assert sum(len(p[-1]) for p in media.pages(bytes(raw))) <= 4096 * len(raw) * 50
        except media.BROKEN:
            pass


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def test_quality(spark, sf, odd, empty):
    docs = texts(sf)
    got = queries.op6_quality(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), brute_repeats(words))
        assert r.base_failed == (len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    known = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(odd, known).where("kept = base_failed").count() == 0
    assert quality.judge(empty, known).count() == 0
    assert quality.keep_good(odd, known).columns == odd.columns


def test_quality_held_out(spark):
    """Labels of one half of the documents set the threshold; the other half is told apart."""
    where = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    judged = quality.judge(docs, known.where("crc32(cast(doc_id as string)) % 2 = 0"))
    rest = judged.join(known.where("crc32(cast(doc_id as string)) % 2 = 1"), "doc_id").where("n_words >= 20").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rest}
    assert n.get((1, False), 0) <= 0.03 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.2 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_token_counts(spark, sf, odd, empty):
    lengths = np.array([len(ids(BYTE_BPE, t)) for t in texts(sf).values()])
    got = queries.op7_token_counts(spark, sf).collect()
    assert {r.length: r.n_docs for r in got} == dict(Counter(lengths.tolist()))
    for r in got:
        assert (r.docs_from, r.tokens_from) == ((lengths >= r.length).sum(), lengths[lengths >= r.length].sum())
        assert r.tokens_if_cut == np.minimum(lengths, r.length).sum()
    limits = [1, 100, 1024, 10**6]
    asked = token_counts.at_limits(token_counts.suffix_sums(token_counts.length_counts(spark.read.parquet(f"{sf}/documents.parquet"))), limits).collect()
    assert {r.context_limit: r.tokens_if_cut for r in asked} == {x: np.minimum(lengths, x).sum() for x in limits}
    assert token_counts.suffix_sums(token_counts.length_counts(empty)).count() == 0
    assert token_counts.length_counts(odd).agg({"n_docs": "sum"}).first()[0] == len(ROWS)


def test_line_dedup(spark, sf, odd, empty):
    for frame in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd):
        docs = [(r.doc_id, r.text) for r in frame.collect()]
        low = lambda x: x if x is not None else -(10**18)
        key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANKS))
        holders = defaultdict(list)
        for d, t in docs:
            for k in {key(x) for x in (t or "").split("\n")}:
                holders[k].append(low(d))
        want = Counter()
        for d, t in docs:
            lines = (t or "").split("\n")
            left = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == low(d)]
            want[d, "\n".join(left), len(lines), len(lines) - len(left)] += 1
        got = line_dedup.dedup_lines(frame)
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    assert "h1" in line_dedup.dedup_lines(odd).columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_token_files(spark, sf, odd, empty):
    docs = texts(sf)
    got = sorted(queries.op9_token_files(spark, sf).collect())
    at = 0
    for r, doc_id in zip(got, sorted(docs), strict=True):
        want = ids(WORD_BPE, docs[doc_id], 2)
        assert tuple(r) == (doc_id, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    for frame, n in ((odd, len(ROWS)), (empty, 0)):
        path = shared_path(spark, "t")
        token_files.write_tokens(frame, path)
        assert token_files.checksums(token_files.read_tokens(spark, path)).count() == n
        assert token_files.read_lengths(spark, path).count() == n
    assert token_files.read_tokens(spark, path, 2, 5).count() == 0


@pytest.mark.parametrize("name", ["op3_mixing", "op8_line_dedup"])
def test_oracles(spark, name):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{where}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, where).toPandas()[list(want.columns)]
    order = lambda f: f.sort_values(list(f.columns)).reset_index(drop=True)
    assert order(want).astype(str).equals(order(got).astype(str))


def test_packing_follows_the_curve(spark, sf):
    """Documents come in the order of their curve keys, so neighbours in a sequence are neighbours on the curve."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = {r.doc_id: r.curve for r in packing.tokenized(docs).select("doc_id", "curve").collect()}
    pieces = sorted(packing.pack_along_curve(docs).select("sequence_id", "offset", "doc_id").collect())
    order = [key[r.doc_id] for r in pieces]
    assert order == sorted(order) and len(set(order)) > 20
    curve = packing.Curve(50_257)
    some = np.array([curve.vector(ids(BYTE_BPE, t)) for t in ("the cat sat on the mat " * 9, "the cat sat on the mat " * 8 + "once", "zahl und wort und satz " * 9)])
    placed = some @ curve.matrix / np.linalg.norm(some, axis=1, keepdims=True)
    assert np.abs(placed[0] - placed[1]).max() < np.abs(placed[0] - placed[2]).max()


def test_line_runs_reopened(spark, sf):
    """A later job takes up the runs of an earlier one: the same totals, and keys of earlier batches keep their keeper."""
    lines = line_dedup.line_keys(spark.read.parquet(f"{sf}/documents.parquet"), 20)
    parts = [lines.where(f"pmod(__id, 5) = {k}") for k in range(5)]
    once = line_dedup.LineRuns(spark)
    root = shared_path(spark, "runs")
    for k, part in enumerate(parts):
        once.add(part)
        runs = line_dedup.LineRuns.open(spark, root) if k else line_dedup.LineRuns(spark, root=root)
        runs.add(part)
    again = line_dedup.LineRuns.open(spark, root)
    assert again.version == 5 and [len(x) for x in again.levels] == [len(x) for x in once.levels]
    rows = lambda r: sorted(map(tuple, r.totals().collect()))
    assert rows(again) == rows(once)
    first = {}
    for k, part in enumerate(parts):
        for r in part.collect():
            have = first.setdefault((r.h1, r.h2), (k, r["__id"]))
            if have[0] == k:
                first[r.h1, r.h2] = (k, max(have[1], r["__id"]))
    assert {(h1, h2): keeper for h1, h2, _, keeper in rows(again)} == {x: v for x, (_, v) in first.items()}


def test_frequent_lines(spark):
    """Keys that are broadcast and keys that are joined give the same lines."""
    docs = spark.createDataFrame([(i, f"this line is in every document\nthis line is in some, number {i % 40}\nown line of number {i} alone") for i in range(300)], "doc_id long, text string")
    got = [sorted(map(tuple, line_dedup.dedup_lines(docs, frequent=f).collect())) for f in (1, 50, 10**9)]
    assert got[0] == got[1] == got[2] and sum(r[-1] for r in got[0]) == 299 + 260


def test_token_file_format(spark, sf):
    """What is written: dictionary or delta pages, page indexes, row groups within bounds; and a range reads its documents only."""
    path = shared_path(spark, "format")
    token_files.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path)
    seen, rows = set(), 0
    for file in Path(path.removeprefix("file://")).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 3 * token_files.FORMAT["parquet.block.size"]
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_offset_index and (column.has_column_index or column.path_in_schema.startswith("ids"))
                assert column.compression == "ZSTD"
                seen |= set(column.encodings)
        rows += meta.num_rows
    assert {"RLE_DICTIONARY"} <= seen and "PLAIN" not in seen - {"RLE", "RLE_DICTIONARY", "PLAIN", "DELTA_BINARY_PACKED"}
    docs = texts(sf)
    assert rows == len(docs)
    low, high = sorted(docs)[10], sorted(docs)[20]
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path, low, high).collect()}
    assert got == {d: ids(WORD_BPE, docs[d], 2).tolist() for d in sorted(docs)[10:21]}
    plan = token_files.read_tokens(spark, path, low, high)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(doc_id,{low})" in plan and f"LessThanOrEqual(doc_id,{high})" in plan
    assert "ids" not in token_files.read_lengths(spark, path)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


def test_quality_verdict(spark, sf):
    """`kept` by walking every tree of the forest for every document, one split at a time."""
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats, forest, cut = quality.fitted(docs, known)
    n = forest.subsample
    usual = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    want = {}
    for r in stats.collect():
        total = 0.0
        for feature, cuts, left, right, path in forest.trees:
            at = 0
            while left[at] != at:
                at = left[at] if r.stats[feature[at]] < cuts[at] else right[at]
            total += path[at]
        want[r.doc_id] = not r.base_failed and 2 ** (-total / len(forest.trees) / usual) < cut
    assert {r.doc_id: r.kept for r in queries.op6_quality(spark, sf).collect()} == want
    assert 0 < sum(want.values()) < len(want)

