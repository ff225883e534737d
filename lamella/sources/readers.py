"""Sources: JSON lines, CSV forms, sidecars, XML records, repository payloads, score tables and run folders."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import clean_doi, clean_fragment, evidence_text, formats_of, year_of
from lamella.streaming.ledger import add_parts, read_parts

CANDIDATE = {
    "source_name": "string", "source_record_id": "string", "title": "string", "landing_url": "string", "publication_doi": "string", "dataset_doi": "string", "modality": "string", "organism": "string",
    "tissue_or_sample": "string", "dimensions_or_image_count": "string", "license": "string", "evidence_text": "string", "download_or_manifest_urls": "array<string>", "publication_dois": "array<string>", "file_formats": "array<string>", "raw_metadata": "string",
}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bad line fails the job; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def header_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with any width of field, quotes doubled, line breaks inside quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("maxCharsPerColumn", -1).option("escape", '"').csv(path)


def keyed_metadata(spark: SparkSession, path: str, numeric: list[str], key: str = "source_id") -> DataFrame:
    """Metadata by key: byte-order mark tolerated, blanks null, numbers where they can be read, the last row of a key wins."""
    d = header_csv(spark, path)
    d = d.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in d.columns})
    if key not in d.columns:
        raise ValueError(f"{path} has no column {key}")
    others = [c for c in d.columns if c != key]
    clean = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in (key, *others)]
    d = d.select(*clean, F.monotonically_increasing_id().alias("__n")).where(F.col(key).isNotNull())
    d = d.groupBy(key).agg(F.max_by(F.struct(*others), "__n").alias("s")).select(key, "s.*")
    return d.withColumns({c: F.coalesce(F.col(c).try_cast("double").cast("string"), F.col(c)) if c not in numeric else F.col(c).try_cast("double") for c in others if c in numeric})


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Accepted records of JSON files below a folder; unreadable files are rows without status and fall out."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("status = 'accepted'")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """path of each file below a folder that isn't JSON: the notice that sidecars() passes over."""
    read = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return read.where(F.try_parse_json("value").isNull()).select("path")


def source_runs(files: DataFrame) -> DataFrame:
    """source_id, runs from paths of the form .../<run>/tiles/source_id=<id>/... (column path)."""
    d = files.select(F.regexp_extract("path", r"([^/]+)/tiles/source_id=([^/]+)", 1).alias("run"), F.regexp_extract("path", r"/tiles/source_id=([^/]+)", 1).alias("source_id")).where("source_id <> ''")
    return d.groupBy("source_id").agg(F.sort_array(F.collect_set("run")).alias("runs"))


def points_csv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good points and rejected lines of a table of lines (ord, line): header optional, two numbers a line, finite ones only."""
    parts = F.split("line", r"\s*,\s*")
    d = lines.where(F.trim("line") != "").select("ord", "line", parts[0].try_cast("double").alias("x"), F.get(parts, 1).try_cast("double").alias("y"))
    header = (F.col("ord") == 1) & F.col("x").isNull() & F.col("y").isNull()
    d = d.where(~header)
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    why = F.when(F.col("x").isNull() | F.col("y").isNull(), "not a number").otherwise("not finite")
    return d.where(good).select("ord", "x", "y"), d.where(~good).select("ord", "line", why.alias("why"))


def require_points(good: DataFrame, bad: DataFrame) -> None:
    """Raises if a line is not a number, naming the first, or if there are lines and no good one."""
    wrong = bad.where("why = 'not a number'").orderBy("ord").first()
    if wrong:
        raise ValueError(f"line {wrong['ord']} is not a point: {wrong['line']!r}")
    if good.isEmpty() and not bad.isEmpty():
        raise ValueError("no line has finite coordinates")


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)


#: DataCite resources and OAI-PMH records, as far as the catalogue reads them.
DATACITE = "identifier string, titles struct<title:array<string>>, publicationYear string, resourceType struct<_VALUE:string,_resourceTypeGeneral:string>, rightsList struct<rights:array<string>>, descriptions struct<description:array<string>>, subjects struct<subject:array<string>>"
OAI = "header struct<_status:string,identifier:string,datestamp:string,setSpec:array<string>>, metadata struct<dc:struct<title:array<string>,description:array<string>,identifier:array<string>,type:array<string>,date:array<string>>>"


def datacite(spark: SparkSession, path: str | list[str], by_file: bool = False) -> DataFrame:
    d = xml_records(spark, path, "resource", DATACITE)
    first = lambda c: F.get(c, 0)
    d = d.select(F.col("identifier").alias("record_id"), first(F.col("titles.title")).alias("title"), year_of(F.col("publicationYear")).alias("year"), F.col("resourceType._resourceTypeGeneral").alias("kind"), F.col("rightsList.rights").alias("rights"), evidence_text(F.array_join("descriptions.description", " "), F.array_join("subjects.subject", " ")).alias("text"), *([F.col("_metadata.file_path").alias("part")] if by_file else []))
    return d.where("record_id is not null") if by_file else d.where("record_id is not null").dropDuplicates(["record_id"])


def oai(spark: SparkSession, path: str) -> DataFrame:
    """Records of saved OAI-PMH pages with a deleted flag; a page without records gives none."""
    d = xml_records(spark, path, "record", OAI)
    dc = "metadata.dc"
    return d.select(F.col("header.identifier").alias("record_id"), F.col("header.datestamp").alias("modified"), (F.coalesce(F.col("header._status"), F.lit("")) == "deleted").alias("deleted"), F.get(F.col(f"{dc}.title"), 0).alias("title"), clean_fragment(F.array_join(F.col(f"{dc}.description"), " ")).alias("text"), F.col(f"{dc}.identifier").alias("links"))


def oai_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, token, error of saved OAI-PMH pages: the resumption token, and an error code other than noRecordsMatch."""
    d = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    code = F.nullif(F.regexp_extract("value", r'<error[^>]*code="([^"]+)"', 1), F.lit(""))
    return d.select("path", F.nullif(F.regexp_extract("value", r"<resumptionToken[^>]*>([^<]*)<", 1), F.lit("")).alias("token"), F.when(code != "noRecordsMatch", code).alias("error"))


def candidates(df: DataFrame, source: str, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Candidate rows of one source by a map of columns, and the rows without an id as errors."""
    got = {"source_name": F.lit(source), **columns}
    d = df.select(*[got.get(c, F.lit(None)).cast(t).alias(c) for c, t in CANDIDATE.items()])
    bad = F.col("source_record_id").isNull() | (F.trim("source_record_id") == "")
    return d.where(~bad), d.where(bad).select("source_name", F.lit("no record id").alias("error"), "raw_metadata")


def _json(*path: str) -> Column:
    return F.coalesce(*[F.get_json_object("value", f"$.{p}") for p in path])


def _list(path: str, item: str | None = None) -> Column:
    raw = F.get_json_object("value", f"$.{path}")
    if item is None:
        return F.from_json(raw, "array<string>")
    return F.transform(F.from_json(raw, "array<map<string,string>>"), lambda m: m[item])


def payload_columns() -> dict[str, dict[str, Column]]:
    """The column maps of the repositories, over a table with one JSON payload a row (value)."""
    doi = lambda *p: clean_doi(_json(*p))
    raw = {"raw_metadata": F.col("value")}
    return {
        "figshare": {"source_record_id": _json("id"), "title": _json("title"), "landing_url": _json("figshare_url", "url_public_html"), "dataset_doi": doi("doi"), "publication_doi": doi("resource_doi"), "license": _json("license.name"), "evidence_text": evidence_text(_json("title"), _json("description"), F.array_join(_list("tags"), " ")), "download_or_manifest_urls": _list("files", "download_url"), "file_formats": formats_of(_list("files", "name")), **raw},
        "mendeley": {"source_record_id": _json("id", "attributes.doi"), "title": _json("attributes.titles[0].title"), "landing_url": _json("attributes.url"), "dataset_doi": doi("attributes.doi"), "license": _json("attributes.rightsList[0].rights"), "evidence_text": evidence_text(_json("attributes.titles[0].title"), _json("attributes.descriptions[0].description")), "file_formats": _list("attributes.formats"), **raw},
        "datacite": {"source_record_id": _json("id"), "title": _json("attributes.titles[0].title"), "dataset_doi": doi("attributes.doi"), "landing_url": _json("attributes.url"), "license": _json("attributes.rightsList[0].rights"), "evidence_text": evidence_text(_json("attributes.titles[0].title"), _json("attributes.descriptions[0].description")), **raw},
        "dataverse": {"source_record_id": _json("global_id"), "title": _json("name"), "landing_url": _json("url"), "dataset_doi": doi("global_id"), "evidence_text": evidence_text(_json("name"), _json("description")), **raw},
        "webknossos": {"source_record_id": _json("id", "name"), "title": _json("displayName", "name"), "evidence_text": evidence_text(_json("description"), F.array_join(_list("dataSource.dataLayers", "name"), " ")), "dimensions_or_image_count": _json("dataSource.dataLayers[0].boundingBox"), **raw},
        "bossdb": {"source_record_id": _json("id", "attributes.ID"), "title": _json("attributes.Title", "attributes.Name"), "publication_doi": doi("attributes.PublicationDOI"), "dataset_doi": doi("attributes.DOI"), "organism": F.array_join(_list("attributes.Species"), "; "), "download_or_manifest_urls": F.array_compact(F.array(_json("attributes.BossDBURI"))), "evidence_text": evidence_text(_json("attributes.Description"), F.array_join(_list("attributes.Keywords"), " ")), **raw},
        "openorganelle": {"source_record_id": _json("name", "dataset_name", "id"), "title": _json("metadata.title", "description", "name"), "dataset_doi": doi("metadata.doi", "doi"), "modality": _json("metadata.imaging.technique", "imaging_technique"), "organism": _json("metadata.sample.organism", "organism"), "tissue_or_sample": _json("metadata.sample.description", "sample"), "evidence_text": evidence_text(_json("metadata.title"), _json("metadata.sample.description")), **raw},
        "literature_openalex": {"source_record_id": _json("id"), "title": _json("title", "display_name"), "publication_doi": doi("doi"), "landing_url": _json("primary_location.landing_page_url"), "evidence_text": evidence_text(_json("title")), **raw},
        "literature_crossref": {"source_record_id": _json("DOI"), "title": _json("title[0]"), "publication_doi": doi("DOI"), "landing_url": _json("URL"), "evidence_text": evidence_text(_json("title[0]"), _json("abstract")), **raw},
        "literature_europepmc": {"source_record_id": _json("id"), "title": _json("title"), "publication_doi": doi("doi"), "evidence_text": evidence_text(_json("title"), _json("abstractText")), **raw},
        "literature_pubmed": {"source_record_id": _json("uid", "pmid"), "title": _json("title"), "publication_doi": doi("elocationid", "doi"), "evidence_text": evidence_text(_json("title"), _json("source")), **raw},
    }


def empiar_entries(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accession-keyed entries: one candidate an accession."""
    entry = "map<string,struct<title:string,imagesets:array<struct<category:string,data_format:string,details:string,name:string,num_images_or_tilt_series:int>>>>"
    d = payloads.select(F.explode(F.from_json("value", entry)).alias("accession", "e"), "value")
    sets = F.col("e.imagesets")
    return candidates(d, "empiar", {
        "source_record_id": F.col("accession"), "title": F.col("e.title"), "landing_url": F.concat(F.lit("https://www.ebi.ac.uk/empiar/"), "accession"), "evidence_text": evidence_text(F.col("e.title"), F.array_join(F.transform(sets, lambda s: F.concat_ws(" ", s["name"], s["category"], s["details"])), " ")),
        "dimensions_or_image_count": F.aggregate(sets, F.lit(0), lambda a, s: a + F.coalesce(s["num_images_or_tilt_series"], F.lit(0))).cast("string"), "file_formats": F.array_sort(F.array_distinct(F.array_compact(F.transform(sets, lambda s: F.lower(s["data_format"]))))), "raw_metadata": F.col("value"),
    })


def normalise(payloads: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    return empiar_entries(payloads) if source == "empiar" else candidates(payloads, source, payload_columns()[source])


def union_scores(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Score CSVs with the union of their columns."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [header_csv(spark, p) for p in paths])


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """folder, arm, split and metrics of runs: a marker and a result file in the same folder, one row a split."""
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root).withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1))
    marks, results = read("run.json", "arm string"), read("results.json", "splits map<string,map<string,double>>")
    return marks.join(results, "folder").select("folder", "arm", F.explode("splits").alias("split", "metrics"))


def union_manifests(spark: SparkSession, paths: dict[str, str], form: str = "csv") -> DataFrame:
    """Manifests of any form that Spark reads, by the name of their pool (column pool), with the union of their columns."""
    read = lambda p: header_csv(spark, p) if form == "csv" else spark.read.format(form).load(p)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(p).withColumn("pool", F.lit(name)) for name, p in paths.items()])


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """part: the files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("part"))


def archive_records(spark: SparkSession, files: DataFrame, table: str) -> DataFrame:
    """The DataCite records of an archive's files (column part, a path), parsed once a file into a part table and read from there;
    of one id the record of the first file counts."""
    schema = "record_id string, title string, year int, kind string, rights array<string>, text string, part string"

    def parse(new: DataFrame) -> DataFrame:
        paths = [r.part for r in new.select("part").distinct().collect()]  # names of files
        return datacite(spark, paths, True).select(*[c.split()[0] for c in schema.split(", ")])

    add_parts(spark, table, files, parse)
    d = read_parts(spark, table, schema)
    one = d.groupBy("record_id").agg(F.min_by(F.struct(*[c for c in d.columns if c != "record_id"]), F.struct("part", "title", "text")).alias("r"))
    return one.select("record_id", "r.*")


def extract(spark: SparkSession, root: str, exclude: list[str], links: DataFrame | None = None, vocabulary: DataFrame | None = None) -> dict[str, DataFrame]:
    """The directory extract as data sets, assets and long tags: side tables joined, named data sets and orphans left out.

    links (dataset_id, source_url, dataset_doi, experiment_doi) come before the extract's own where they have a value.
    vocabulary (grp, name, instead): tags that are renamed, or dropped where `instead` is null; groups that begin with _ are passed over.
    """
    read = lambda name: header_csv(spark, f"{root}/{name}")
    urls = read("dataset_urls.csv").select("dataset_id", "source_url", "dataset_doi", "experiment_doi")
    if links is not None:
        over = links.select("dataset_id", *[F.nullif(F.trim(c), F.lit("")).alias(f"__{c}") for c in urls.columns[1:]])
        urls = urls.join(over, "dataset_id", "full").select("dataset_id", *[F.coalesce(f"__{c}", c).alias(c) for c in urls.columns[1:]])
    datasets = read("datasets.csv").where(~F.col("dataset_id").isin(*exclude) if exclude else F.lit(True)).join(urls, "dataset_id", "left")
    nm = read("derived/asset_inplane_resolution_nm.csv")
    nm = nm.select(F.col(f"`{nm.columns[0]}`").alias("asset_id"), F.col("inplane_nm").try_cast("double").alias("inplane_nm"))
    tiles = read("asset_tiles.csv").select("asset_id", F.col("accepted_tiles").try_cast("int").alias("accepted_tiles"))
    assets = read("asset_meta.csv").join(datasets.select("dataset_id"), "dataset_id", "left_semi").join(nm, "asset_id", "left").join(tiles, "asset_id", "left").join(read("derived/asset_tidy.csv").select("asset_id", "dim"), "asset_id", "left")
    assets = assets.withColumn("accepted_tiles", F.coalesce("accepted_tiles", F.lit(0)))
    tags = read("asset_tag_long.csv").withColumnsRenamed({"group": "grp"}).join(assets.select("asset_id"), "asset_id", "left_semi")
    if vocabulary is not None:
        v = vocabulary.where(~F.startswith("grp", F.lit("_"))).select("grp", "name", "instead", F.lit(True).alias("__said"))
        tags = tags.join(v, ["grp", "name"], "left").where("__said is null or instead is not null")
        tags = tags.withColumn("name", F.coalesce("instead", "name")).drop("instead", "__said").distinct()
    return {"datasets": datasets, "assets": assets, "tags": tags}
