"""Operators on small fixtures, against plain Python where a loop says it."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lamella.functions import numbers, text
from lamella.operators import analysis, catalog, facets, labels, levels, library, order, rules, spatial, splits, stats, tiles, vectors
from lamella.sources import readers, writers
from lamella.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    lit = F.lit
    r = one(
        spark,
        text.clean_fragment(lit("<p>A &amp; B&lt;c</p>\n <b>x</b>")),
        text.clean_doi(lit(" https://doi.org/10.1234/AbC ")),
        text.clean_doi(lit("nothing")),
        text.clean_pmid(lit("https://pubmed/12345/")),
        text.clean_pmcid(lit("pmc77")),
        text.abstract_from_index(lit('{"b": [1, 3], "a": [0], "c": [2]}')),
        text.year_of(lit("none"), lit("May 2019")),
        text.suffix_of(lit("a/b.TAR.GZ?x=1")),
        text.resolution_text(lit(3.14159)),
        text.polygon_area(F.array(lit(0.0), lit(4.0), lit(4.0), lit(0.0)), F.array(lit(0.0), lit(0.0), lit(3.0), lit(3.0))),
        text.modified_since("2024-01-01", lit(None).cast("string")),
        text.parse_int(lit(" 7.9 ")),
        text.parse_float(lit("x")),
    )
    assert list(r) == ["A & B x", "10.1234/abc", None, "12345", "PMC77", "a b c b", 2019, "tar.gz", "3.14 nm/px", 12.0, True, 7, None]
    r = one(spark, text.unique_ignoring_case(F.array(lit("Ab"), lit("c"), lit("aB"))), text.redact(lit("see /home/me/x and /tmp/y"), text.LOCAL_PATH))
    assert r[0] == ["Ab", "c"] and (r[1]["text"], r[1]["n"], r[1]["left"]) == ("see [redacted] and [redacted]", 2, 0)


def test_numbers(spark):
    r = one(spark, numbers.finite(F.lit(float("nan"))), numbers.finite(F.lit(float("inf"))), numbers.ratio(F.lit(1.0), F.lit(0)), numbers.quantize_probability(F.lit(0.5)), numbers.threshold_level(F.lit(0.5)), numbers.realised_threshold(F.lit(128)))
    assert list(r)[:5] == [None, None, None, 128, 128] and r[5] == pytest.approx(0.5)
    for level in range(1, 256):
        assert (math.floor(255 * ((level - 0.5) / 255) + 1)) in (level, level + 1)


RECORD = dict(source_name="x", title=None, modality=None, tissue_or_sample=None, evidence_text=None, file_formats=[], raw_metadata=None)
LAYER = json.dumps({"dataSource": {"dataLayers": [{"name": "em_raw", "category": "color"}]}})


@pytest.mark.parametrize(
    "fields, status, confidence",
    [
        (dict(evidence_text="FIB-SEM of mitochondria"), "eligible", 0.9),
        (dict(evidence_text="fib_sem stack"), "uncertain", 0.62),
        (dict(evidence_text="cryo-EM of a membrane"), "ineligible", 0.95),
        (dict(source_name="literature_pubmed", evidence_text="FIB-SEM cells"), "uncertain", 0.5),
        (dict(source_name="openorganelle", title="fib-sem"), "eligible", 0.95),
        (dict(source_name="webknossos", raw_metadata=LAYER), "uncertain", 0.65),
        (dict(source_name="webknossos", raw_metadata=LAYER, title="nuclei"), "eligible", 0.9),
        (dict(source_name="zenodo", title="weather data"), "ineligible", 0.9),
        (dict(title="sem picture"), "uncertain", 0.75),
        (dict(title="item"), "uncertain", 0.35),
        (dict(title="systematic"), "uncertain", 0.75 if "sem" in "systematic" else 0.35),
    ],
)
def test_classify(spark, fields, status, confidence):
    schema = "source_name string, title string, modality string, tissue_or_sample string, evidence_text string, file_formats array<string>, raw_metadata string"
    row = RECORD | fields
    v = catalog.classify(spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)).first()["verdict"]
    assert (v["status"], v["confidence"]) == (status, confidence)


def test_record_filter(spark):
    schema = "id int, status string, source_kind string, license string, tile_storage_dtype string, low_dynamic_range boolean, normalization_warning string, width int, height int, artifact_fraction double, tissue_score double, background_fraction double"
    good = ("accepted", "a", "cc0", "uint8", False, None, 600, 600, 0.1, 0.5, 0.1)
    change = lambda i, v: (*good[:i], v, *good[i + 1 :])
    rows = [good, change(0, "rejected"), change(0, None), change(1, "z"), change(2, "gpl"), change(2, " "), change(3, "uint16"), change(4, True), change(5, "x;low_dynamic_range"), change(6, 100), change(7, None), change(8, 0.9), change(9, 0.01), change(10, 0.99), change(10, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    f = rules.RecordFilter(source_kinds=("a",), licences=("cc0",), unlicensed=False, min_side=512, max_artifact=0.5, min_tissue=0.1, max_background=0.95)
    got = [r[0] for r in d.orderBy("id").select(f.reason()).collect()]
    assert got == [None, "status!=accepted", "status!=accepted", "source_kind_excluded", "license:gpl", "license:unlicensed", "dtype!=uint8", "low_dynamic_range", "warning:low_dynamic_range", "min_side<512", "min_side<512", "artifact_fraction>0.5", "tissue_score<0.1", "background_fraction>0.95", None]
    assert [r[0] for r in d.limit(1).select(rules.RecordFilter(dtype=None).reason()).collect()] == [None]


def test_catalog_rest(spark):
    d = spark.createDataFrame([("https://doi.org/10.6019/EMPIAR-1",), ("http://other",), (" ",), (None,)], "url string")
    assert [r[0] for r in d.select(catalog.repository_of(F.col("url"))).collect()] == ["EMPIAR", "Other", "Not yet deposited", "Not yet deposited"]
    r = one(spark, catalog.any_depth(F.lit('{"A": {"Sample-Type": "x", "b": [[{"c": {"d": {"e": {"sample type": ["y", {"q": 1}, 2]}}}}]]}, "sample_type": {"k": 0}, "Sample.Type ": "z"}'), ["sample_type"]), catalog.open_access(F.array().cast("array<string>")), catalog.open_access(F.array(F.lit("restricted"))))
    assert r[0] == ["x", "y", "2", "z"] and (r[1], r[2]) == (True, False)
    r = one(spark, catalog.data_links(F.array(F.lit("http://a/data"), F.lit("http://a/paper.pdf")), F.array(F.lit("http://a/data"))), catalog.relevance(F.lit("Volume EM of cells"), {"m": ["volume em"], "o": ["plants"]}, ["m"]))
    assert r[0] == ["http://a/data"] and r[1]["relevant"] and r[1]["terms"] == ["volume em"]


def test_saved_filters(spark):
    d = spark.createDataFrame([("p?kind=a%20b,zz&x=1",), ("p",)], "url string")
    assert [r["labels"] for r in facets.saved_filters(d, "url", "kind", ["a b", "c"]).collect()] == [["a b"], []]
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = one(spark, facets.query_string({"k": a("a b"), "e": a()}), facets.toggle_parent(a("c1", "o"), F.lit("p"), a("c1", "c2")), facets.toggle_parent(a("p"), F.lit("p"), a("c1")))
    assert (r[0], r[1], r[2]) == ("k=a+b", ["o", "p"], [])


def test_window_starts(spark):
    for n, tile, stride in itertools.product((0, 5, 10, 23, 30), (4, 10), (3, 10)):
        r = one(spark, *[tiles.starts(F.lit(n), F.lit(tile), F.lit(stride), e) for e in ("floor", "flush")], tiles.window_count(F.lit(n), F.lit(tile), F.lit(stride)))
        grid = list(range(0, n - tile + 1, stride)) if n >= tile else []
        assert r[0] == grid and r[1] == grid + ([n - tile] if grid and grid[-1] < n - tile else []) and r[2] == len(r[1])


def test_shifts(spark):
    d = spark.createDataFrame([(1, 0, 0, 20, 20)], "id int, x int, y int, w int, h int")
    assert {(r.cx, r.cy) for r in tiles.shifted(d, [-4, 0, 4], "w", "h", 10).collect()} == {(0, 0), (0, 4), (4, 0), (4, 4)}


def brute_shift(cands, tile, most):
    kept = {}
    for key in sorted({c[0] for c in cands}):
        for _, cx, cy, s in sorted((c for c in cands if c[0] == key), key=lambda c: -c[3]):
            if all(max(0, tile - abs(cx - x)) * max(0, tile - abs(cy - y)) <= most * tile * tile for x, y in kept.values()):
                kept[key] = (cx, cy)
                break
    return kept


def test_choose_shift(spark):
    rng = random.Random(3)
    cands = [(k, (k % 4) * 8 + dx, (k // 4) * 8 + dy, rng.random()) for k in range(12) for dx in (0, 3, 6) for dy in (0, 3)]
    d = spark.createDataFrame(cands, "k int, cx int, cy int, s double")
    got = {r.k: (r.cx, r.cy) for r in spatial.choose_shift(d, "k", [F.desc("s")], 10).collect()}
    assert got == brute_shift(cands, 10, 0.4)


def test_greedy(spark):
    rng = random.Random(5)
    boxes = [(i, x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(1, 30), y + rng.randrange(1, 30), rng.randrange(20)) for i in range(150)]
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(min(b[3], k[3]) <= max(b[1], k[1]) or min(b[4], k[4]) <= max(b[2], k[2]) for k in kept):
            kept.append(b)
    d = spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long, s int")
    assert sorted(r.id for r in spatial.greedy(d, "s").collect()) == sorted(k[0] for k in kept)


def test_nearest_far(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 5.0)], "point_id long, x double, y double")
    b = spark.createDataFrame([(7, 3.0, 4.0), (8, -1.0, 900.0)], "point_id long, x double, y double")
    got = {r.point_id: (r.near_id, r.distance) for r in spatial.nearest(a, b).collect()}
    assert got[1] == (7, 5.0) and got[2][0] == 7
    assert spatial.nearest(a, b.limit(0)).count() == 0


def test_runs(spark):
    px = [(0, 0), (1, 0), (3, 0), (2, 1), (5, 5)]
    d = spark.createDataFrame([(1, x, y, 2.0) for x, y in px], "image int, x long, y long, v double")
    assert sorted((r.y, r.x0, r.x1) for r in spatial.runs_of(d, ["image"]).collect()) == [(0, 0, 1), (0, 3, 3), (1, 2, 2), (5, 5, 5)]
    assert sorted(r.area for r in spatial.detect(d, ["image"], 1.0).collect()) == [1, 4]
    assert sorted(r.area for r in spatial.detect(d, ["image"], 1.0, diagonal=False).collect()) == [1, 1, 1, 2]
    r = spatial.run_area(spark.createDataFrame([(1, 0, 0, 5), (1, 0, 3, 8), (1, 1, 0, 0)], "image int, y int, x0 int, x1 int"), ["image"]).first()
    assert r.area == 10


def test_band(spark):
    d = spark.createDataFrame([(1, x, y) for x in range(7) for y in range(7)], "image int, x int, y int")
    got = {(r.x, r.y) for r in labels.band(d, ["image"], 2).collect()}
    want = {(x, y) for x in range(7) for y in range(7) if min(x, y, 6 - x, 6 - y) < 2}
    assert got == want
    assert labels.set_iou(d, d.where("x < 6"), ["image"]).first()["iou"] == pytest.approx(6 / 7)


def test_matching(spark):
    rng = random.Random(6)
    pairs = [(1, p, g, rng.randrange(1, 100) / 100) for p in range(1, 8) for g in range(1, 8) if rng.random() < 0.6]
    want, used = [], set()
    for _, p, g, iou in sorted(pairs, key=lambda r: (-r[3], r[1], r[2])):
        if iou >= 0.2 and ("p", p) not in used and ("g", g) not in used:
            want.append((p, g))
            used |= {("p", p), ("g", g)}
    d = spark.createDataFrame(pairs, "crop int, p int, g int, iou double")
    assert sorted((r.p, r.g) for r in labels.mutual_best(d, ["crop"], 0.2).collect()) == sorted(want)
    conf = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "crop int, p int, score double")
    hits = spark.createDataFrame([(1, 1, 1, 0.9), (1, 3, 2, 0.6)], "crop int, p int, g int, iou double")
    ap = labels.average_precision(hits, conf, spark.createDataFrame([(1, 2)], "crop int, n_true int"), ["crop"], [0.5]).first()["ap"]
    assert ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_confusion_policies(spark):
    d = spark.createDataFrame([(1, False, False)], "crop int, p boolean, g boolean")
    values = [labels.confusion(d, ["crop"], F.col("p"), F.col("g"), how).collect() for how in ("one", "null", "drop")]
    assert values[0][0]["dice"] == 1.0 and values[1][0]["dice"] is None and values[2] == []


def test_splits(spark):
    d = spark.createDataFrame([("a;b|a; ",), (None,)], "o string")
    assert [r[0] for r in d.select(splits.organelle_set(F.col("o"))).collect()] == [["a", "b"], []]
    base = spark.createDataFrame([("n_x_1", "d"), ("n_2", "d")], "name string, ds string")
    defaults, over = spark.createDataFrame([("d", 4.0)], "ds string, nm double"), spark.createDataFrame([(0, "x_", 9.0), (1, "n_", None)], "ord int, contains string, nm double")
    assert {r["name"]: r["nm"] for r in splits.defaults_with_overrides(base, "name", defaults, over, "ds", ["nm"]).collect()} == {"n_x_1": 9.0, "n_2": 4.0}
    z = splits.planes(spark.createDataFrame([(10,)], "depth int"), "depth", F.lit(2.5), most=4).collect()
    assert [r.z for r in z] == [0, 3, 6, 9]
    box = one(spark, splits.expand_box(F.lit(2), F.lit(2), F.lit(6), F.lit(6), 0.5, 6, F.lit(7), F.lit(20)))[0]
    assert tuple(box) == (0, 0, 7, 8)
    b = splits.folds(spark.createDataFrame([("i", "r1"), ("i", "r2")], "img string, reg string"), "img", "reg").collect()
    assert len(b) == 4 and sum(r.role == "heldout" for r in b) == 2


def test_analysis(spark):
    px = spark.createDataFrame([(1, x, y, 1.0) for x in range(10) for y in range(4)], "o int, x int, y int, v double")
    m = analysis.measure_objects(px, ["o"], "v").first()
    assert (m.area, m.cx, m.cy, m.x1) == (40, 4.5, 1.5, 10) and m.major == pytest.approx(4 * math.sqrt(100 / 12)) and m.eccentricity == pytest.approx(math.sqrt(1 - 0.16))
    s = analysis.shape(spark.createDataFrame([(100.0, 30.0, 5.0, 0.0, 10.0), (100.0, None, 5.0, 4.0, None)], "area double, perimeter double, major double, minor double, nm double"), "nm").collect()
    assert s[0]["circularity"] is None and s[0]["refused"] and s[0]["aspect"] is None and s[1]["area_um2"] is None and s[1]["circularity"] is None
    w = analysis.group_warnings(spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["b"])], "grp string, run int, warnings array<string>"), "grp", "run")
    assert {r.warning: r.runs for r in w.collect()} == {"a": [1], "b": [1, 2]}
    assert analysis.circular_columns(["area_um2", "dice"], ["area"]) == ["area_um2"]
    assert [r.path for r in analysis.non_finite(spark.createDataFrame([(1, float("nan"), 2.0)], "k int, a double, b double"), "k").collect()] == ["a"]


def test_null_is_balanced(spark):
    """Uniform points are enriched nowhere: the null's own mean is about 1, and draws fill their runs evenly."""
    runs = spark.createDataFrame([(1, "tissue", y, 0, 99) for y in range(100)] + [(1, "in", y, 0, 49) for y in range(100)], "image int, label string, y int, x0 int, x1 int")
    points = spark.createDataFrame([(1, i, float(i % 100), float(i // 100)) for i in range(0, 10_000, 13)], "image int, point_id int, x double, y double")
    areas = analysis.compartment_areas(runs, "image", "tissue").where("label <> 'cytoplasm'").select("image", "label", "fraction")
    got = {r.label: r for r in analysis.randomness(points, runs, areas, "image", "tissue", 12, "s").collect()}
    assert got["in"]["null_mean"] == pytest.approx(1, abs=0.05) and got["tissue"]["z"] is None and 0 < got["in"]["p"] <= 1


def test_library(spark):
    a = spark.createDataFrame([(1, "My Scan_01.tif"), (2, "other"), (3, "none")], "asset_id int, name string")
    f = spark.createDataFrame([("x/my-scan 01.TIF",), ("y/Other.png",), ("z/other.png",)], "path string")
    assert {r.asset_id: r.path for r in library.match_names(a, f).collect()} == {1: "x/my-scan 01.TIF", 2: "y/Other.png", 3: None}
    old = spark.createDataFrame([(1, "r1", "unlabelled"), (2, "r1", "confirmed"), (3, "r2", "unlabelled")], "id int, region string, label_state string")
    new = spark.createDataFrame([(9, "r1", "unlabelled")], "id int, region string, label_state string")
    assert sorted(r.id for r in library.replace_candidates(old, new, ["region"]).collect()) == [2, 3, 9]


def test_order(spark):
    d = spark.range(500).withColumn("w", F.col("id") % 7)
    placed = order.numbered(d, "s", "id").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(500)) and [r.digest for r in placed] == sorted(r.digest for r in placed)
    small, large = order.draw_order(d, "id", "q", 10).collect(), order.draw_order(d, "id", "q", 20).collect()
    assert [r.id for r in small] == [r.id for r in large][:10]


def test_bootstrap_bounds(spark):
    d = spark.createDataFrame([(c, i, float(i % 5)) for c in "ab" for i in range(50)], "cell string, i int, v double")
    got = [r.macro for r in stats.bootstrap_macro(d, "cell", "i", "v", 30, "s").collect()]
    assert len(got) == 30 and all(1.2 < x < 2.8 for x in got) and len(set(got)) > 5


def test_near_pairs(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.0, 1.0])], "id int, v array<double>")
    assert [(r.a, r.b) for r in vectors.near_pairs(d, "id", "v", 0.1).collect()] == [(1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "m.csv").write_text("﻿source_id,nm,organ\ns1, 4.0 ,liver\ns2,x,\ns1,5,\n,1,z\n", encoding="utf-8")
    assert {r.source_id: (r.nm, r.organ) for r in readers.keyed_metadata(spark, str(tmp_path / "m.csv"), ["nm"]).collect()} == {"s1": (5.0, None), "s2": (None, None)}
    (tmp_path / "side/x").mkdir(parents=True)
    (tmp_path / "side/x/1.json").write_text('{"status": "accepted",\n "tile_id": "t"}')
    (tmp_path / "side/2.json").write_text("{broken")
    assert [r.tile_id for r in readers.sidecars(spark, str(tmp_path / "side"), "status string, tile_id string").collect()] == ["t"]
    lines = spark.createDataFrame([(1, "x,y"), (2, "1, 2"), (3, "nan,1"), (4, "a,b"), (5, "")], "ord int, line string")
    good, bad = readers.points_csv(lines)
    assert [(r.x, r.y) for r in good.collect()] == [(1.0, 2.0)] and {r.ord: r.why for r in bad.collect()} == {3: "not finite", 4: "not a number"}
    (tmp_path / "r.xml").write_text("<OAI-PMH><ListRecords><record><header status='deleted'><identifier>o:1</identifier></header></record><record><header><identifier>o:2</identifier></header><metadata><dc><title>T</title></dc></metadata></record><resumptionToken>tok</resumptionToken></ListRecords></OAI-PMH>")
    got = {r.record_id: (r.deleted, r.title) for r in readers.oai(spark, str(tmp_path / "r.xml")).collect()}
    assert got == {"o:1": (True, None), "o:2": (False, "T")}
    page = readers.oai_pages(spark, str(tmp_path / "r.xml")).first()
    assert (page.token, page.error) == ("tok", None)


def test_payloads(spark):
    d = spark.createDataFrame([(json.dumps({"id": 5, "title": "T", "doi": "10.6084/m9.x", "files": [{"name": "a.TIF", "download_url": "u"}], "tags": ["em"]}),), (json.dumps({"title": "no id"}),)], "value string")
    good, bad = readers.normalise(d, "figshare")
    r = good.first()
    assert (r.source_record_id, r.dataset_doi, r.file_formats, r.download_or_manifest_urls) == ("5", "10.6084/m9.x", ["tif"], ["u"]) and bad.count() == 1
    e = spark.createDataFrame([(json.dumps({"EMPIAR-1": {"title": "X", "imagesets": [{"name": "n", "data_format": "MRC", "num_images_or_tilt_series": 3}, {"num_images_or_tilt_series": 4}]}}),)], "value string")
    r = readers.normalise(e, "empiar")[0].first()
    assert (r.source_record_id, r.dimensions_or_image_count, r.file_formats) == ("EMPIAR-1", "7", ["mrc"])
    for source in readers.payload_columns():
        assert readers.normalise(d, source)[0].columns == list(readers.CANDIDATE)


def test_sinks(spark, tmp_path):
    d = spark.range(10).withColumn("b", F.lit("x"))
    assert writers.json_lines(d, str(tmp_path / "j")) == 10
    assert writers.good_and_bad(d, F.when(F.col("id") > 7, "big"), str(tmp_path / "g"), str(tmp_path / "b")) == {"good": 8, "bad": 2}
    m = writers.bundle({"objects": d.limit(0), "all": d}, str(tmp_path / "out"))
    assert {r.name: r.n for r in m.collect()} == {"objects": 0, "all": 10}
    writers.sharded(d.withColumn("shard", F.col("id") % 3), str(tmp_path / "s"), ["id"])
    assert spark.read.parquet(str(tmp_path / "s")).select("shard").distinct().count() == 3


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "t": "2024-01-01 00:00:00"}\n{"k": "a", "t": "2024-01-01 00:01:00"}\n')
    run = lambda: ingest.run_once(ingest.unique(ingest.read_stream(spark, str(src), "k string, t timestamp"), ["k"], "t", "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    (src / "2.json").write_text('{"k": "a", "t": "2024-01-01 00:02:00"}\n{"k": "b", "t": "2024-01-01 00:03:00"}\n')
    run()
    assert sorted(r.k for r in spark.read.schema("k string, t timestamp").parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    built = []
    make = lambda: (built.append(1), spark.range(3))[1]
    for _ in range(2):
        assert ingest.cached(spark, make, str(tmp_path / "cache"), {"v": "1"}).count() == 3
    assert built == [1]


def test_extract(spark, tmp_path):
    (tmp_path / "derived").mkdir()
    for name, body in {
        "datasets.csv": "dataset_id,name\nd1,One\nd2,Two\nd3,Three\n", "dataset_urls.csv": "dataset_id,source_url,dataset_doi,experiment_doi\nd1,http://x,,\n", "asset_meta.csv": "asset_id,dataset_id,width\na1,d1,5\na2,d2,6\na3,d9,7\n",
        "asset_tiles.csv": "asset_id,accepted_tiles\na1,4\n", "asset_tag_long.csv": "asset_id,group,name\na1,organ,liver\na3,organ,x\n", "derived/asset_tidy.csv": "asset_id,dim\na1,3D\n", "derived/asset_inplane_resolution_nm.csv": ",inplane_nm\na1,4.5\n",
    }.items():
        (tmp_path / name).write_text(body)
    e = readers.extract(spark, str(tmp_path), ["d3"])
    assert sorted(r.dataset_id for r in e["datasets"].collect()) == ["d1", "d2"]
    assert {r.asset_id: (r.inplane_nm, r.accepted_tiles, r.dim) for r in e["assets"].collect()} == {"a1": (4.5, 4, "3D"), "a2": (None, 0, None)}
    assert e["tags"].collect() == [Row(asset_id="a1", grp="organ", name="liver")]


def test_cosine_of_all_queries(spark):
    """Every query is answered, however many there are."""
    rng = random.Random(3)
    v = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    got = vectors.cosine_topk(d, d, "id", "v", 2).collect()
    assert sorted((r["query"], r["rank"]) for r in got) == [(i, k) for i in range(1500) for k in (1, 2)]
    u = [[x / math.sqrt(sum(y * y for y in w)) for x in w] for w in v]
    cosine = {(r["query"], r["rank"]): r["cosine"] for r in got}
    for i in range(0, 1500, 50):
        best = sorted((sum(map(math.prod, zip(u[i], w))) for j, w in enumerate(u) if j != i), reverse=True)[:2]
        assert [cosine[i, 1], cosine[i, 2]] == pytest.approx(best, abs=1e-8)


def test_components_of_long_shapes(spark):
    """A U of 90 rows whose lower end label is at the far arm is one component, as is a path; a node linked with itself is one too."""
    px = [(1, 0, y, 1.0) for y in range(90)] + [(1, 4, y, 1.0) for y in range(1, 90)] + [(1, x, 89, 1.0) for x in (1, 2, 3)]
    runs = spatial.run_components(spark.createDataFrame(px, "image long, x long, y long, v double"), ["image"]).collect()
    assert {tuple(r.label) for r in runs} == {(1, 0, 0)}
    path = [(i, i + 1) for i in range(400)] + [(1000, 1000), (2001, 2000)]
    got = {r.node: r.root for r in spatial.label_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(401), 0) | {1000: 1000, 2000: 2000, 2001: 2000}


def test_greedy_of_a_long_chain(spark):
    """Boxes that each overlap the next, with falling scores: every other one is chosen, however long the chain."""
    d = spark.createDataFrame([(i, 10 * i, 0, 10 * i + 15, 5, 1000.0 - i) for i in range(140)], "id long, x0 long, y0 long, x1 long, y1 long, s double")
    assert sorted(r.id for r in spatial.greedy(d, "s").collect()) == list(range(0, 140, 2))


def test_long_chains(spark):
    """Rounds go on to the end: 200 boxes in a row, each over the next, with falling scores, and a chain of 60 matches."""
    boxes = spark.createDataFrame([(i, 6.0 * i, 0.0, 6.0 * i + 10, 5.0, 1000.0 - i) for i in range(200)], "id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted(r.id for r in spatial.greedy(boxes, "score").collect()) == list(range(0, 200, 2))
    steps = [(1, i, i, 0.49 - i / 1000) for i in range(60)] + [(1, i, i + 1, 0.4895 - i / 1000) for i in range(60)]
    pairs = spark.createDataFrame(steps, "k int, p int, g int, iou double")
    got = {(r.p, r.g) for r in labels.mutual_best(pairs, ["k"], 0.1).collect()}
    done_p, done_g, want = set(), set(), set()
    for _, p, g, _ in sorted(steps, key=lambda r: (-r[3], r[1], r[2])):
        if p not in done_p and g not in done_g:
            want.add((p, g))
            done_p.add(p)
            done_g.add(g)
    assert got == want


def test_union_area(spark):
    rng = random.Random(4)
    rows = [(k, x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for k in range(12) for x, y in [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 9))]]
    got = {r.k: r.area for r in levels.union_area(spark.createDataFrame(rows, "k int, x0 int, y0 int, x1 int, y1 int"), "k").collect()}
    assert got == {k: len({(x, y) for r in rows if r[0] == k for x in range(r[1], r[3]) for y in range(r[2], r[4])}) for k in {r[0] for r in rows}}
    box = lambda *r: spark.createDataFrame(list(r), "id int, x0 double, y0 double, x1 double, y1 double")
    halves = box((1, 0.0, 0.0, 4.0, 10.0), (2, 6.0, 0.0, 10.0, 10.0), (3, 0.0, 0.0, 4.0, 5.0))
    assert [tuple(r) for r in spatial.covered(box((9, 0.0, 0.0, 10.0, 10.0)), halves).collect()] == [(9, "delete")]
    assert [tuple(r) for r in spatial.covered(box((9, 0.0, 0.0, 10.0, 10.0)), halves.where("id <> 2")).collect()] == [(9, "trim")]


def test_compartments_inside_tissue(spark):
    """Labels are cut to the tissue, overlaps count once, and shares of no tissue are 0."""
    runs = [(1, "tissue", 0, 0, 9), (1, "nucleus", 0, 5, 14), (1, "nucleus", 0, 8, 12), (1, "spot", 0, 0, 6), (2, "nucleus", 0, 0, 4)]
    got = {(r.image, r.label): (r.area, r.fraction) for r in analysis.compartment_areas(spark.createDataFrame(runs, "image int, label string, y int, x0 int, x1 int"), "image", "tissue").collect()}
    assert got == {(1, "tissue"): (10, 1.0), (1, "nucleus"): (5, 0.5), (1, "spot"): (7, 0.7), (1, "cytoplasm"): (5, 0.5), (2, "nucleus"): (0, 0.0), (2, "cytoplasm"): (0, 0.0)}


def test_far_neighbours(spark):
    """Neighbours are found whatever the distance; points whose group has none in b are left out."""
    schema = "point_id int, image string, x double, y double"
    a = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 0.0, 0.0), (3, "c", 5.0, 5.0)], schema)
    b = spark.createDataFrame([(7, "a", 3e6, 4e6), (8, "b", 1.0, 0.0), (9, "b", 0.0, 2.0)], schema)
    got = {r.point_id: (r.near_id, r.distance) for r in spatial.nearest(a, b, within=("image",)).collect()}
    assert got == {1: (7, 5e6), 2: (8, 1.0)}


def test_distances_of_bare_sides(spark):
    mask = lambda *r: spark.createDataFrame(list(r), "image int, x int, y int")
    sizes = spark.createDataFrame([(1, 3, 4), (2, 3, 4), (3, 3, 4)], "image int, width int, height int")
    pred, truth = mask((1, 0, 0), (2, 0, 0)), mask((1, 0, 2))
    assert {r.image: r.hd95 for r in labels.hd95(pred, truth, sizes, "image").collect()} == {1: 2.0, 2: 5.0, 3: 0.0}
    assert {r.image: r.f1 for r in labels.boundary_f1(pred, truth, sizes, "image", 1.0).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_chosen_shifts(spark, sf):
    """Tile by tile in order, the best window that covers no earlier one by more than the limit."""
    from lamella.plans import measures, registry
    from lamella.plans.binding import Tables

    nominal = [r.asDict() for r in measures.nominal(Tables(spark, sf)).collect()]
    want, taken = {}, []
    for t in sorted(nominal, key=lambda t: t["tile"]):
        options = {(max(0, min(t["x"] + dx, t["width"] - 64)), max(0, min(t["y"] + dy, t["height"] - 64))) for dx in (-16, 0, 16) for dy in (-16, 0, 16)}
        rank = lambda o: (-((o[0] * 31 + o[1] * 17) % 101), abs(o[0] - t["x"]) + abs(o[1] - t["y"]), o[1], o[0])  # noqa: E731, B023
        for o in sorted(options, key=rank):
            if all(max(0, 64 - abs(o[0] - p[0])) * max(0, 64 - abs(o[1] - p[1])) / 4096 <= 0.4 for p in taken):
                want[t["tile"]] = o
                taken.append(o)
                break
    assert {r.tile: (r.cx, r.cy) for r in registry.QUERIES["chosen_shifts"](spark, sf).collect()} == want


def test_group_query(spark):
    runs = spark.createDataFrame([("success", "s1", "a", 1, 2.0), ("success", "s1", "a", 1, 4.0), ("success", "s2", "a", 2, 9.0), ("failed", "s1", "a", 3, 99.0), ("success", "s1", None, 4, 5.0)], "status string, segmentation string, grp string, image int, v double")
    shown = lambda df: {r.grp: (r["mean"], r.n) for r in df.collect()}
    assert shown(analysis.group_query(runs, "v")) == {"a": (6.0, 2), "": (5.0, 1)}
    assert shown(analysis.group_query(runs, "v", F.lit("s1"), "a")) == {"a": (3.0, 1)}
    assert shown(analysis.group_query(runs, "v", group="")) == {"": (5.0, 1)}


def test_points_required(spark):
    lines = lambda *r: readers.points_csv(spark.createDataFrame(list(enumerate(r, 1)), "ord int, line string"))
    readers.require_points(*lines("x,y", "1,2", "inf,3"))
    readers.require_points(*lines("x,y"))
    with pytest.raises(ValueError, match="line 3"):
        readers.require_points(*lines("x,y", "1,2", "a,3"))
    with pytest.raises(ValueError, match="no line"):
        readers.require_points(*lines("inf,1", "nan,2"))


def test_unreadable_sidecars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.json").write_text('{"status": "accepted", "id": "1"}')
    (tmp_path / "a" / "bad.json").write_text('{"status": ')
    assert [r.id for r in readers.sidecars(spark, str(tmp_path), "status string, id string").collect()] == ["1"]
    assert [r.path.rsplit("/", 1)[1] for r in readers.unreadable(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_same_bytes_usable(spark):
    d = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, "b", False)], "id int, content string, ok boolean")
    assert [(r.keeper, r.n) for r in catalog.same_bytes(d, "content", "id", "id", F.col("ok")).collect()] == [(2, 2)]


def test_versions_in_runs(spark, tmp_path):
    """Ten batches, three runs a level: every key has its newest version, also after a second call."""
    schema = "k int, v int"
    assert ingest.live_runs(10, 3) == [(2, 0), (0, 9)] and ingest.live_runs(8, 3) == [(1, 0), (1, 1), (0, 6), (0, 7)] and ingest.live_runs(0, 3) == []
    want = {}
    for half in range(2):
        for i in range(5):
            rows = [(k, 10 * (5 * half + i) + k) for k in range(i, i + 4)]
            want |= dict(rows)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = ingest.read_stream(spark, str(tmp_path / "in"), schema, files=1)
        ingest.keep_versions(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["k"], ["v"], fanout=3)
        assert {r.k: r.v for r in ingest.kept_versions(spark, str(tmp_path / "out"), stream.schema, ["k"], ["v"], fanout=3).collect()} == want
    assert (tmp_path / "out" / "level=2").exists()

