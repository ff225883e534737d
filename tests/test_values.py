"""Values of operators that no query shows: payloads, records, manifests, predicates, known answers."""

import json
import math

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lamella.functions import text
from lamella.operators import analysis, catalog, library, spatial, splits, tiles, vectors
from lamella.plans import registry
from lamella.sources import readers, writers


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


PAYLOADS = {
    "figshare": (
        {"id": 12, "title": "A set", "url_public_html": "https://figshare.com/12", "doi": "https://doi.org/10.6084/M9.X", "resource_doi": "10.1000/p", "license": {"name": "CC BY"}, "description": "<p>Cells</p>", "tags": ["tem"], "files": [{"name": "a.TIF", "download_url": "https://f/1"}, {"name": "b.zip", "download_url": "https://f/2"}]},
        {"source_record_id": "12", "title": "A set", "landing_url": "https://figshare.com/12", "dataset_doi": "10.6084/m9.x", "publication_doi": "10.1000/p", "license": "CC BY", "download_or_manifest_urls": ["https://f/1", "https://f/2"], "file_formats": ["tif", "zip"]},
    ),
    "mendeley": (
        {"id": "m1", "attributes": {"doi": "10.17632/ab.1", "url": "https://data.mendeley.com/1", "titles": [{"title": "Mito"}], "descriptions": [{"description": "FIB-SEM"}], "rightsList": [{"rights": "CC0"}], "formats": ["zip"]}},
        {"source_record_id": "m1", "title": "Mito", "landing_url": "https://data.mendeley.com/1", "dataset_doi": "10.17632/ab.1", "license": "CC0", "file_formats": ["zip"]},
    ),
    "datacite": (
        {"id": "10.5000/x", "attributes": {"doi": "10.5000/x", "url": "https://x", "titles": [{"title": "T"}], "descriptions": [{"description": "D"}], "rightsList": [{"rights": "CC BY 4.0"}]}},
        {"source_record_id": "10.5000/x", "title": "T", "landing_url": "https://x", "dataset_doi": "10.5000/x", "license": "CC BY 4.0"},
    ),
    "dataverse": (
        {"global_id": "doi:10.7910/DVN/E", "name": "Volumes", "url": "https://doi.org/10.7910/DVN/E", "description": "About"},
        {"source_record_id": "doi:10.7910/DVN/E", "title": "Volumes", "landing_url": "https://doi.org/10.7910/DVN/E", "dataset_doi": "10.7910/dvn/e"},
    ),
    "webknossos": ({"name": "n1", "displayName": "Shown", "description": "Brain", "dataSource": {"dataLayers": [{"name": "color", "boundingBox": {"width": 5}}, {"name": "seg"}]}}, {"source_record_id": "n1", "title": "Shown", "dimensions_or_image_count": '{"width":5}'}),
    "bossdb": (
        {"id": "p1", "attributes": {"Title": "Worm", "DOI": "10.60533/b", "PublicationDOI": "https://doi.org/10.1000/PUB", "Species": ["C. elegans", "x"], "BossDBURI": "bossdb://p/e", "Description": "D", "Keywords": ["k"]}},
        {"source_record_id": "p1", "title": "Worm", "dataset_doi": "10.60533/b", "publication_doi": "10.1000/pub", "organism": "C. elegans; x", "download_or_manifest_urls": ["bossdb://p/e"]},
    ),
    "openorganelle": (
        {"name": "o1", "metadata": {"title": "Organ", "doi": "10.25378/j", "imaging": {"technique": "FIB-SEM"}, "sample": {"organism": "Mouse", "description": "Liver"}}},
        {"source_record_id": "o1", "title": "Organ", "dataset_doi": "10.25378/j", "modality": "FIB-SEM", "organism": "Mouse", "tissue_or_sample": "Liver"},
    ),
    "literature_openalex": ({"id": "W1", "display_name": "Paper", "doi": "https://doi.org/10.1000/Q", "primary_location": {"landing_page_url": "https://l"}}, {"source_record_id": "W1", "title": "Paper", "publication_doi": "10.1000/q", "landing_url": "https://l"}),
    "literature_crossref": ({"DOI": "10.1000/C", "title": ["Cross"], "URL": "https://c", "abstract": "<p>A</p>"}, {"source_record_id": "10.1000/C", "title": "Cross", "publication_doi": "10.1000/c", "landing_url": "https://c"}),
    "literature_europepmc": ({"id": "77", "title": "Euro", "doi": "10.1000/e", "abstractText": "t"}, {"source_record_id": "77", "title": "Euro", "publication_doi": "10.1000/e"}),
    "literature_pubmed": ({"uid": "88", "title": "Pub", "elocationid": "doi: 10.1000/z", "source": "J"}, {"source_record_id": "88", "title": "Pub", "publication_doi": "10.1000/z"}),
    "empiar": (
        {"EMPIAR-1": {"title": "Entry", "imagesets": [{"name": "s", "category": "micrographs", "details": "d", "data_format": "TIFF", "num_images_or_tilt_series": 3}, {"data_format": "MRC", "num_images_or_tilt_series": 4}]}},
        {"source_record_id": "EMPIAR-1", "title": "Entry", "landing_url": "https://www.ebi.ac.uk/empiar/EMPIAR-1", "dimensions_or_image_count": "7", "file_formats": ["mrc", "tiff"]},
    ),
}


@pytest.mark.parametrize("source", sorted(PAYLOADS))
def test_payloads(spark, source):
    """Every field of the payload, and null for those that it doesn't have; a payload without an id is an error."""
    payload, want = PAYLOADS[source]
    frame = spark.createDataFrame([(json.dumps(payload, separators=(",", ":")),), ("{}",)], "value string")
    good, bad = readers.normalise(frame, source)
    got = good.collect()
    assert len(got) == 1 and bad.count() == (0 if source == "empiar" else 1)
    shown = {k: v for k, v in got[0].asDict().items() if k not in ("raw_metadata", "evidence_text") and v is not None}
    assert shown == {"source_name": source} | want
    assert got[0].raw_metadata == json.dumps(payload, separators=(",", ":"))


def test_projects(spark):
    d = spark.createDataFrame([(1, "true", None), (2, " No ", "live"), (3, None, "Private"), (4, "0", None), (5, None, "Public "), (6, "yes", " ")], "id int, p string, s string")
    assert [r.id for r in d.where(catalog.public_project(F.col("p"), F.col("s"))).orderBy("id").collect()] == [1, 5, 6]
    looks = lambda s: one(spark, catalog.project_methods(F.lit(s)))
    assert looks("A FIBSEM and EM volume") == "FIB-SEM" and looks("cryo light") is None and looks("some EM") == "EM" and looks("automatic tape x SEM") == "ATUM-SEM ; SEM"
    keep = lambda s: one(spark, catalog.harvested_relevance(F.lit(s)))
    assert keep("sbem data") and keep("tem of a cell") and not keep("tem of steel") and keep("sem volume") and not keep("sem of a cel") and keep("vem of axon") and not keep("")
    assert one(spark, catalog.harvested_relevance(F.lit(None).cast("string"))) is False


def test_deposits(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p]) if kv else F.lit(None).cast("map<string,string>")
    none = F.lit(None).cast("array<map<string,string>>")
    licence = lambda *a: one(spark, text.licence_text(*a))
    assert licence(m(title="CC BY", id="cc", url="https://l"), none, F.lit("open")) == "CC BY (https://l)"
    assert licence(m(id="cc", url=""), none, F.lit("open")) == "cc" and licence(m(url="https://l"), none, F.lit("open")) == "https://l"
    assert licence(m(), F.array(m(rights=""), m(rights_identifier="cc0", rights_uri="u"), m(rights="x")), F.lit("open")) == "cc0 (u)"
    assert licence(m(), F.array(m(rights="", rights_uri="u")), F.lit("open")) == "open" and licence(m(), none, F.lit("")) is None
    size = lambda n, b: one(spark, text.size_summary(F.lit(n), F.lit(b).cast("long")))
    assert (size(2, 50), size(2, None), size(0, 50), size(0, 0)) == ("2 files; 50 bytes total", "2 files", "50 bytes total", None)
    names = F.array(*map(F.lit, ["a/X.ome.TIFF", "b.tar.gz", "c", ".hidden", "d.zip"]))
    assert one(spark, text.deposit_formats(names, F.array(F.lit("image/tiff"), F.lit("")))) == ["GZ", "OME.TIFF", "ZIP", "image/tiff"]


def test_duplicate_keys(spark):
    keys = catalog.duplicate_keys(F.lit(" 10.1/A "), F.lit(""), F.lit("S"), F.lit("R1"))
    assert one(spark, keys) == ["dataset_doi:10.1/a", "source_record:s:r1"]


def test_archive_is_parsed_once(spark, tmp_path):
    """Half of the archive, then all of it: each file is parsed once, and the first file's record of an id counts."""
    resource = '<resource><identifier>{}</identifier><titles><title>{}</title></titles><publicationYear>2020</publicationYear><resourceType resourceTypeGeneral="Dataset">x</resourceType></resource>'
    (tmp_path / "in").mkdir()
    for name, rows in {"a.xml": [("1", "one"), ("2", "two")], "b.xml": [("2", "again"), ("3", "three")], "c.xml": []}.items():
        (tmp_path / "in" / name).write_text("<all>" + "".join(resource.format(*r) for r in rows) + "</all>")
    files = readers.archive_files(spark, str(tmp_path / "in"))
    table = str(tmp_path / "t")
    assert sorted(r.record_id for r in readers.archive_records(spark, files.where("part like '%a.xml'"), table).collect()) == ["1", "2"]
    (tmp_path / "in" / "a.xml").write_text("<all>not again</all>")
    got = {r.record_id: (r.title, r.year, r.kind) for r in readers.archive_records(spark, files, table).collect()}
    assert got == {"1": ("one", 2020, "Dataset"), "2": ("two", 2020, "Dataset"), "3": ("three", 2020, "Dataset")}


def test_manifests_and_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,5\n")
    (tmp_path / "b.csv").write_text("id,y\n2,7\n")
    got = readers.union_manifests(spark, {"first": str(tmp_path / "a.csv"), "more": str(tmp_path / "b.csv")}).orderBy("id").collect()
    assert [(r.id, r.x, r.y, r.pool) for r in got] == [("1", "5", None, "first"), ("2", None, "7", "more")]
    (tmp_path / "derived").mkdir()
    for name, body in {
        "dataset_urls.csv": "dataset_id,source_url,dataset_doi,experiment_doi\n", "datasets.csv": "dataset_id,name\nd,D\n", "derived/asset_inplane_resolution_nm.csv": "asset_id,inplane_nm\n", "asset_tiles.csv": "asset_id,accepted_tiles\n",
        "asset_meta.csv": "asset_id,dataset_id\na,d\n", "derived/asset_tidy.csv": "asset_id,dim\n", "asset_tag_long.csv": "asset_id,group,name\na,organ,Liver\na,organ,liver\na,organ,Junk\na,_x,Junk\n",
    }.items():
        (tmp_path / name).write_text(body)
    words = spark.createDataFrame([("organ", "Liver", "liver"), ("organ", "Junk", None), ("_x", "Junk", None)], "grp string, name string, instead string")
    assert sorted((r.grp, r.name) for r in readers.extract(spark, str(tmp_path), [], vocabulary=words)["tags"].collect()) == [("_x", "Junk"), ("organ", "liver")]


def test_choice_limits(spark):
    rows = [(i, 10 * i, 0, 10 * i + 5, 5, i / 10) for i in range(10)] + [(20, 0, 0, 100, 5, 0.95)]
    d = spark.createDataFrame(rows, "id int, x0 int, y0 int, x1 int, y1 int, s double")
    ids = lambda **kv: sorted(r.id for r in spatial.greedy(d, "s", **kv).collect())
    assert ids() == [20] and ids(floor=0.96) == []
    low = d.where("id < 20")
    assert sorted(r.id for r in spatial.greedy(low, "s", floor=0.45, candidates=4).collect()) == [6, 7, 8, 9]
    assert sorted(r.id for r in spatial.greedy(low, "s", most=3).collect()) == [7, 8, 9]


def test_windows_in_scope(spark):
    d = spark.createDataFrame([(1, v, x, 0) for x, v in enumerate([0, 1, 1, 2, 7])], "w int, value int, x int, y int")
    got = {(r.value, r["name"], r.in_scope, r.area) for r in splits.window_summary(d, ["w"], {1: "mito", 2: "er"}, [1]).collect()}
    assert got == {(1, "mito", True, 2), (2, "er", False, 1), (7, "value_7", False, 1)}


def test_predicate_of_a_manifest(spark):
    records = spark.createDataFrame([(1, "a", "good"), (2, "b", "bad"), (3, "c", "good")], "id int, name string, kind string")
    files = spark.createDataFrame([("x/a",), ("y/b",)], "path string")
    got = tiles.resolve_paths(records, files, "id", F.array(F.concat(F.lit("y/"), "name"), F.concat(F.lit("x/"), "name")), (F.col("kind") == "good") & (F.length("name") == 1))
    assert {r.id: r.path for r in got.collect()} == {1: "x/a", 3: None}


def test_points_and_pixels(spark):
    d = spark.createDataFrame([(0.4, 3.0), (-0.6, 1.0), (9.6, 1.0), (float("nan"), 1.0), (None, 1.0)], "x double, y double")
    assert [r.v for r in d.select(analysis.out_of_image(F.col("x"), F.col("y"), F.lit(10), F.lit(10)).alias("v")).collect()] == [False, True, True, True, True]
    sized = analysis.pixel_size(spark.createDataFrame([(5.0, 5.0), (0.0, None), (4.0, None)], "nm double, run_nm double")).collect()
    assert [(r.usable_nm, r.produced_without, r.calibrated_after) for r in sized] == [(5.0, False, False), (None, True, False), (4.0, True, True)]
    assert [one(spark, c) for c in splits.scale_box([F.lit(0.5), F.lit(1.5), F.lit(2.4), F.lit(7.0)], F.lit(1.0))] == [0, 2, 2, 7]


def test_names_and_live_objects(spark):
    assert [one(spark, splits.canonical(F.lit(x), {"mitos": "mito"})) for x in (" Mitos ", "ER", None)] == ["mito", "er", None]
    schema = "id int, label_state string, refined boolean, superseded_at string, source_model string, version int"
    d = spark.createDataFrame([(1, "unlabelled", None, None, "m", 2), (2, "unlabelled", True, None, "m", 2), (3, "unlabelled", None, "t", "m", 2), (4, "confirmed", None, None, "m", 2), (5, "unlabelled", None, None, "n", 2), (6, "unlabelled", None, None, "m", 1)], schema)
    assert [r.id for r in library.live_objects(d, "m", F.lit(2)).collect()] == [1]
    assert one(spark, library.blockers({"a": F.lit(True), "b": F.lit(False), "c": F.lit(None).cast("boolean")})) == ["a", "c"]


def test_prefilter(spark):
    ok = lambda kind, rights, said: one(spark, catalog.prefilter(F.lit(kind), rights, F.lit(said), ["fib-sem"], ["tem"], ["cell"]))
    cc, shut = F.array(F.lit("CC-BY")), F.array(F.lit("closed"))
    assert ok("Dataset", cc, "a FIB-SEM set") and ok("image", F.lit(None).cast("array<string>"), "TEM of cells") and not ok("Dataset", cc, "TEM of steel") and not ok("Dataset", shut, "fib-sem") and not ok("Text", cc, "fib-sem")


def test_folders_and_scores(spark, tmp_path):
    paths = [(f"/r/{run}/tiles/source_id={s}/p.png",) for run, s in (("r2", "a"), ("r1", "a"), ("r1", "b"))] + [("/r/other.png",)]
    assert {r.source_id: r.runs for r in readers.source_runs(spark.createDataFrame(paths, "path string")).collect()} == {"a": ["r1", "r2"], "b": ["r1"]}
    writers.projected(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "p"), ["b", "missing"])
    assert spark.read.parquet(str(tmp_path / "p")).collect() == [Row(b=2)]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "run.json").write_text('{"arm": "x"}')
    (tmp_path / "run" / "results.json").write_text('{"splits": {"test": {"dice": 0.5}, "val": {"dice": 0.7}}}')
    assert sorted((r.arm, r.split, r.metrics["dice"]) for r in readers.run_results(spark, str(tmp_path)).collect()) == [("x", "test", 0.5), ("x", "val", 0.7)]
    for name, body in {"s1.csv": "m,a\nx,1\n", "s2.csv": "m,b\ny,2\n"}.items():
        (tmp_path / name).write_text(body)
    assert sorted((r.m, r.a, r.b) for r in readers.union_scores(spark, [str(tmp_path / "s1.csv"), str(tmp_path / "s2.csv")]).collect()) == [("x", "1", None), ("y", None, "2")]


def test_vectors_with_known_answers(spark):
    """A cloud along one direction has it as its first component; two classes apart are told, and a plane is regressed."""
    v = [(i, [3.0 * a, 4.0 * a, b], "x" if a > 0 else "y", 2.0 * a + 1) for i, (a, b) in enumerate((a / 10, (-1) ** a * 0.01) for a in range(-30, 31) if a)]
    d = spark.createDataFrame(v, "id int, v array<double>, label string, y double")
    for r in vectors.principal(d, "id", "v", 1).collect():
        assert abs(r.components[0]) == pytest.approx(5 * abs(v[r.id][1][0] / 3), abs=1e-6)
    told = vectors.probe(d.withColumn("n", (F.col("label") == "x").cast("int")), "id", "v", "n").collect()
    assert len(told) == 3 and all(r.score > 0.9 for r in told)
    plane = vectors.probe(d, "id", "v", "y", regression=True).collect()
    assert all(0.5 < r.score <= 1 and not math.isnan(r.score) for r in plane)


@pytest.mark.parametrize("page", ["x = &quot", "a &quot;b&quot; &copy", "&amp &ampquot; &amp;quot; &am", "A &amp;lt;b&amp;gt; &middot; &middo", "&ltfoo; <b>&lt;i&gt;</b> &nbsp", "&amp"])
def test_cut_entities(spark, tmp_path, page):
    """Pages that end inside an entity, beside the query's SQL."""
    spark.createDataFrame([(1, f"<p>{page}")], "page_id int, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in registry.QUERIES["html_clean"](spark, str(tmp_path)).collect()] == con.execute(registry.ORACLES["html_clean"]).fetchall()
