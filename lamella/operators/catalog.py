"""Catalogue records: eligibility by an ordered cascade, routing, relevance, first records and duplicate keys."""

from __future__ import annotations

import re
from json import loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.text import blank_to_null, normalize_text, unique_ignoring_case
from lamella.operators import terms
from lamella.operators.rules import first_match, substring_hits, term_hits
from lamella.operators.spatial import label_components

# Fixed values of the catalogue: modality terms, evidence terms, exclusion patterns, display names, reference terms.
MODALITY_TERMS = [
    "sbf-sem", "sbf sem", "sbfsem", "sbem", "serial block face", "serial block-face", "serial block face sem", "serial block-face sem", "fib-sem", "fib sem", "fibsem",
    "array tomography sem", "atum-sem", "atum sem", "atum", "at-sem", "at sem", "multibeam sem", "multi-beam sem", "msem", "sstem", "ss-tem", "serial section tem", "serial-section tem",
    "tem", "transmission electron microscopy", "electron tomography", "immunoelectron tomography", "resin-section et", "volume em", "volume electron microscopy", "vem", "cellular em", "cem1.5m", "cem500k",
]
EVIDENCE_TERMS = [
    "intracellular", "ultrastructure", "ultrastructural", "organelle", "organelles", "mitochond", "nucleus", "nuclei", "nuclear envelope", "nuclear pore", "endoplasmic reticulum", " er ", "golgi", "lysosome",
    "vesicle", "annulate lamellae", "cell membrane", "plasma membrane", "cytoplasm", "whole cell", "epithelium", "epithelial", "cellular", "tissue", "pancreas", "pancreatic", "hela", "mcf7", "mcf-7", "label map", "segmentation",
]
EXCLUSIONS = [
    (r"\bcryo[- ]?et\b", "cryo-ET is excluded by project scope"),
    (r"\bcryo[- ]?electron tomo(?:graphy|grams?|graphic)\b", "cryo-ET is excluded by project scope"),
    (r"\bcryo[- ]?em\b", "structural cryo-EM is excluded"),
    (r"single particle", "single-particle structural EM is excluded"),
    (r"protein structure", "structural EM is excluded"),
    (r"\bsem[- /]?(edx|eds)\b", "SEM-EDX/EDS is excluded"),
    (r"\b(edx|eds)\b", "elemental/particle analysis is excluded"),
    (r"surface[- ]only sem", "surface-only SEM is excluded"),
    (r"surface sem", "surface SEM is excluded without internal ultrastructure evidence"),
    (r"topographic sem", "topographic SEM is excluded"),
    (r"\b(nanoparticle|nanoparticles|scaffold|scaffolds|hydrogel|hydrogels|implant|implants|alloy|alloys|polymer|polymers|catalyst|catalysts)\b", "materials/device EM is excluded"),
    (r"\b(iodp expedition|international ocean discovery program|integrated ocean drilling program|joides resolution)\b", "geological/ocean-drilling EM is excluded"),
]
DISPLAY = {
    "array tomography sem": "array tomography SEM", "atum": "ATUM", "atum sem": "ATUM-SEM", "atum-sem": "ATUM-SEM", "multi-beam sem": "multibeam SEM", "multibeam sem": "multibeam SEM", "sbem": "SBEM", "sbf sem": "SBF-SEM", "sbf-sem": "SBF-SEM", "sbfsem": "SBF-SEM",
    "serial block face": "serial block-face SEM", "serial block-face": "serial block-face SEM", "serial block face sem": "serial block-face SEM", "serial block-face sem": "serial block-face SEM", "vem": "vEM", "volume electron microscopy": "volume electron microscopy",
    "cem1.5m": "cellular EM patch dataset", "cem500k": "cellular EM patch dataset", "cellular em": "cellular EM patch dataset",
}
REFERENCE_TERMS = ["electron microscopy", "electron micrograph", "electron microscope", "em", "tem", "sem", "fibsem", "fib-sem", "sbf-sem", "sbfsem", "sbem", "serial block face", "serial section", "ultrastructure"]
SEM_CONTEXT = ["fib", "sbf", "sbem", "serial block", "atum", "volume", "multibeam"]

LAYERS = "struct<dataSource:struct<dataLayers:array<struct<name:string,category:string>>>>"


def has_em_layer(raw_json: Column) -> Column:
    """A colour layer whose name says that it is an electron image."""
    layers = F.from_json(raw_json, LAYERS)["dataSource"]["dataLayers"]
    return F.coalesce(F.exists(layers, lambda x: (F.lower(x["category"]) == "color") & F.lower(x["name"]).rlike(r"(?<![a-z0-9])em(?![a-z0-9])|electron")), F.lit(False))


def display_modality(modality: Column, hit: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])[hit]
    return F.coalesce(blank_to_null(modality), named, F.when(hit.rlike("tem|sem"), F.upper(hit)).otherwise(hit))


def verdict(status: str, confidence: float, modality: Column | None, evidence: Column | str | None, reason: Column | str | None, review: bool) -> Column:
    text = lambda x: (F.lit(x) if not isinstance(x, Column) else x).cast("string")
    return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), text(modality).alias("modality"), text(evidence).alias("evidence"), text(reason).alias("reason"), F.lit(review).alias("review"))


def classify(df: DataFrame, modality_terms: list[str] = MODALITY_TERMS, evidence_terms: list[str] = EVIDENCE_TERMS, exclusions: list[tuple[str, str]] = EXCLUSIONS, reference_terms: list[str] = REFERENCE_TERMS) -> DataFrame:
    """Adds `verdict` to candidate records: one cascade, the first branch that holds decides.

    df has source_name, title, modality, tissue_or_sample, evidence_text, file_formats (list) and raw_metadata (JSON text).
    """
    c = F.col
    text = normalize_text(c("title"), c("modality"), c("tissue_or_sample"), c("evidence_text"), F.array_join("file_formats", " "), c("raw_metadata"))
    df = df.withColumn("__text", text).withColumn("__about", normalize_text(c("modality"), c("evidence_text"), c("title")))
    df = df.withColumn("__told", terms.found(c("__about"), {"hits": terms.words(modality_terms)}))
    df = df.withColumn("__said", terms.found(c("__text"), {"evidence": terms.parts(evidence_terms), "reference": terms.words(reference_terms), "context": terms.parts(SEM_CONTEXT)}))
    df = df.withColumn("__hits", c("__told.hits")).withColumn("__evidence", c("__said.evidence"))
    df = df.withColumn("__excluded", first_match(c("__text"), exclusions)).withColumn("__layer", (c("source_name") == "webknossos") & has_em_layer(c("raw_metadata")))
    hit, seen = F.try_element_at("__hits", F.lit(1)), F.try_element_at("__evidence", F.lit(1))
    some_hit, some_seen = F.size("__hits") > 0, F.size("__evidence") > 0
    referenced = some_hit | (F.size("__said.reference") > 0)
    shown = display_modality(c("modality"), hit)
    sem_only = (F.instr("__text", "sem") > 0) & (F.size("__said.context") == 0)
    out = (
        F.when(c("__excluded").isNotNull(), verdict("ineligible", 0.95, None, None, c("__excluded"), False))
        .when(c("source_name").startswith("literature_"), verdict("uncertain", 0.5, None, None, "lead: public data links and evidence are still to be read", True))
        .when((c("source_name") == "openorganelle") & some_hit, verdict("eligible", 0.95, shown, F.concat(F.lit("public EM layer: "), hit), None, False))
        .when(c("__layer") & some_seen, verdict("eligible", 0.9, F.lit("volume EM"), F.concat(F.lit("public EM layers, "), seen), None, False))
        .when(c("__layer"), verdict("uncertain", 0.65, F.lit("volume EM"), "public EM layers, cellular context incomplete", None, True))
        .when((c("source_name") == "zenodo") & ~referenced, verdict("ineligible", 0.9, None, None, "no electron microscopy reference", False))
        .when(some_hit & some_seen, verdict("eligible", 0.9, shown, F.concat(hit, F.lit(", "), seen), None, False))
        .when(some_hit, verdict("uncertain", 0.62, shown, F.concat(hit, F.lit(", cellular evidence incomplete")), None, True))
        .when(sem_only, verdict("uncertain", 0.75, None, None, "SEM without cross-sectional evidence", True))
        .otherwise(verdict("uncertain", 0.35, None, None, "no qualifying modality", True))
    )
    return df.withColumn("verdict", out).drop("__text", "__about", "__told", "__said", "__hits", "__evidence", "__excluded", "__layer")


def route(status: Column, review: Column) -> Column:
    return F.when(review | (status == "uncertain"), "review").otherwise(status)


def route_counts(df: DataFrame, key: str = "route") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))



def contract_checks() -> dict[str, Column]:
    c = F.col
    return {
        "status": c("status").isin("eligible", "ineligible", "uncertain"),
        "confidence": (c("confidence") >= 0) & (c("confidence") <= 1),
        "evidence": (c("status") != "eligible") | (F.length(F.trim("evidence")) > 0),
        "modality": (c("status") != "eligible") | (F.length(F.trim("modality")) > 0),
        "reason": (c("status") != "ineligible") | (F.length(F.trim("reason")) > 0),
        "review": (c("status") != "uncertain") | c("review"),
    }


def open_access(rights: Column) -> Column:
    """No statement of rights, or one that is open."""
    return (F.coalesce(F.size(rights), F.lit(0)) <= 0) | F.exists(rights, lambda r: F.lower(r).rlike(r"open|cc[- ]|creative commons|public domain"))


def prefilter(kind: Column, rights: Column, text: Column, strong: list[str], weak: list[str], context: list[str]) -> Column:
    """Data sets with open access and a strong term, or a weak term with its context."""
    low = F.lower(text)
    has = lambda terms: F.size(term_hits(low, terms)) > 0
    return F.coalesce(F.lower(kind).isin("dataset", "image", "collection"), F.lit(False)) & open_access(rights) & (has(strong) | (has(weak) & (F.size(substring_hits(low, context)) > 0)))


def relevance(text: Column, categories: dict[str, list[str]], relevant: list[str]) -> Column:
    """struct(terms, relevant): configured terms found, and whether one is of a relevant category."""
    low = F.lower(text)
    return F.struct(term_hits(low, [t for v in categories.values() for t in v]).alias("terms"), (F.size(term_hits(low, [t for k in relevant for t in categories[k]])) > 0).alias("relevant"))


def data_link(url: Column, text: Column) -> Column:
    """A link that hints at data and isn't a PDF."""
    both = F.lower(F.concat_ws(" ", url, text))
    return both.rlike(r"data|dataset|repository|supplement|zenodo|figshare|dryad|empiar|archive|download|raw image") & ~F.lower(url).rlike(r"\.pdf($|\?)")


def data_links(*lists: Column, most: int = 25) -> Column:
    """Links of several lists in order, each once, the unlikely ones dropped."""
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])))
    return F.slice(F.filter(every, lambda u: data_link(u, F.lit(""))), 1, most)


def public_project(public: Column, status: Column) -> Column:
    """Not said to be private: neither `public` (false, no, 0) nor a status other than live or public."""
    closed = F.lower(F.trim(public.cast("string"))).isin("false", "no", "0")
    said = F.lower(F.trim(status))
    return ~F.coalesce(closed, F.lit(False)) & (F.coalesce(said, F.lit("")).isin("", "live", "public"))


#: Electron imaging by pattern in a project's text, all that match in this order.
PROJECT_METHODS = [
    ("ATUM-SEM", r"\bATUM[-_ ]?SEM\b|automatic tape.*\bSEM\b"), ("FIB-SEM", r"\bFIB[-_ ]?SEM\b|focused ion beam"), ("SBF-SEM", r"\bSBF[-_ ]?SEM\b|\bSBEM\b|serial block[- ]face"), ("AT-SEM", r"\bAT[-_ ]?SEM\b|array tomography.*\bSEM\b"),
    ("ssTEM", r"\bss[-_ ]?TEM\b|serial section transmission electron|serial-section TEM"), ("TEM", r"\bTEM\b|transmission electron microscopy"), ("SEM", r"\bSEM\b|scanning electron microscopy"), ("EM", r"\bEM\b|electron microscopy"),
]


def project_methods(text: Column) -> Column:
    """The methods that a project's text tells, joined by ' ; '; plain EM only where nothing else is told. Null: it doesn't look like electron microscopy."""
    told = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in PROJECT_METHODS]))
    return F.nullif(F.array_join(F.when(F.size(told) > 1, F.array_remove(told, "EM")).otherwise(told), " ; "), F.lit(""))


#: Patterns that tell electron microscopy by themselves, and words beside which TEM and SEM do.
STRONG_PATTERNS = [
    r"\belectron microscopy\b", r"\belectron micrographs?\b", r"\belectron microscope\b", r"\btransmission electron\b", r"\bscanning electron\b", r"\bvolume electron microscopy\b", r"\bvolume em\b", r"\bfocused ion beam\b",
    r"\bfib[- ]?sem\b", r"\bsbf[- ]?sem\b", r"\bsbem\b", r"\bserial block[- ]face\b", r"\bserial section(?:ing)?\b", r"\barray tomography\b", r"\bultrastructure\b",
]
TEM_BESIDE = ["ultrastructure", "mitochond", "organelle", "intracellular", "cellular", "cell", "tissue", "membrane", "neuron", "axon", "synapse"]
SEM_BESIDE = ["fib", "sbf", "sbem", "serial block", "volume", "ultrastructure", "intracellular", "cellular", "tissue"]


def harvested_relevance(text: Column) -> Column:
    """Whether a harvested record's text (normalised) tells electron microscopy of cells."""
    beside = lambda words: text.rlike("|".join(words))
    told = text.rlike("|".join(STRONG_PATTERNS)) | (text.rlike(r"\btem\b") & beside(TEM_BESIDE)) | (text.rlike(r"\bsem\b") & beside(SEM_BESIDE)) | (text.rlike(r"\bvem\b") & beside(TEM_BESIDE + SEM_BESIDE))
    return F.coalesce(told, F.lit(False))


def duplicate_keys(dataset_doi: Column, landing_url: Column, source: Column, record: Column) -> Column:
    """The keys by which two records are the same: DOI, link, and the source's own id, each with its kind."""
    key = lambda kind, v: F.when(v != "", F.concat(F.lit(f"{kind}:"), F.lower(F.trim(v))))
    own = F.concat(F.coalesce(source, F.lit("")), F.lit(":"), F.coalesce(record, F.lit("")))
    return F.array_compact(F.array(key("dataset_doi", dataset_doi), key("landing_url", landing_url), key("source_record", own)))


def same_records(df: DataFrame, record: str) -> DataFrame:
    """record, root: the least record of those that share a key, directly or through others. df: record, and the columns of duplicate_keys()."""
    keys = duplicate_keys(F.col("dataset_doi"), F.col("landing_url"), F.col("source_name"), F.col("source_record_id"))
    k = df.select(F.col(record).alias("a"), F.explode(keys).alias("k")).distinct()
    heads = k.groupBy("k").agg(F.min("a").alias("b"))
    return label_components(k.join(heads, "k").select("a", "b")).select(F.col("node").alias(record), "root")


def first_records(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key in ingest order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def same_bytes(df: DataFrame, content: str, created: str, key: str, usable: Column | None = None) -> DataFrame:
    """digest, keeper, n: the oldest usable row of each content."""
    df = df if usable is None else df.where(usable)
    return df.groupBy(F.sha2(content, 256).alias("digest")).agg(F.min_by(key, F.struct(created, key)).alias("keeper"), F.count("*").alias("n"))


def any_depth(json: Column, keys: list[str]) -> Column:
    """Values of keys in a JSON text at any depth, in objects and lists, in the order of the text; lists give their plain items.

    Keys are compared in lower case with runs of other characters as one underscore. Depth has no bound, so this is a
    function of Arrow batches; a text that isn't JSON has none.
    """
    wanted = frozenset(keys)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: named_values(text, wanted), na_action="ignore")

    return found(json)


def named_values(text: str, wanted: frozenset[str]) -> list[str]:
    try:
        todo: list[tuple[str | None, object]] = [(None, loads(text))]
    except ValueError:
        return []
    out: list[str] = []
    while todo:
        key, value = todo.pop()
        if key is not None and re.sub("[^a-z0-9]+", "_", key.strip().lower()).strip("_") in wanted:
            out += [str(v) for v in (value if isinstance(value, list) else [value]) if v is not None and not isinstance(v, dict | list)]
        inner = list(value.items()) if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []
        todo += reversed(inner)
    return out


#: Imaging methods by pattern, all that match in this order; words for volume methods; words that say too little.
METHODS = [
    (r"\bsbf[- ]?sem\b|serial block[- ]face", "SBF-SEM"), (r"\bfib[- ]?sem\b|focused ion beam", "FIB-SEM"), (r"\batum[- ]?sem\b", "ATUM-SEM"), (r"\bat[- ]?sem\b|array tomography sem", "AT-SEM"),
    (r"\bss[- ]?tem\b|serial section tem|serial-section tem", "ssTEM"), (r"transmission electron microscopy|\btem\b", "TEM"), (r"electron tomography|resin-section et", "electron tomography"),
]
VOLUME_METHOD = r"volume electron microscopy|\bvolume em\b|\bvem\b"
GENERAL_METHODS = ["em", "electron microscopy", "volume em", "volume electron microscopy"]
#: Organisms by pattern, the first that matches.
ORGANISMS = [
    (r"\bhomo sapiens\b|\bhuman\b|\bhela\b", "Human"), (r"\bmus musculus\b|\bmouse\b|\bmurine\b", "Mouse"), (r"\brattus norvegicus\b|\brat\b", "Rat"), (r"\bdanio rerio\b|\bzebrafish\b", "Zebrafish"),
    (r"\barabidopsis thaliana\b|\barabidopsis\b", "Arabidopsis thaliana"), (r"\bdrosophila melanogaster\b|\bdrosophila\b", "Drosophila melanogaster"), (r"\bcaenorhabditis elegans\b|\bc\.?\s*elegans\b", "C. elegans"),
    (r"\bsaccharomyces cerevisiae\b|\byeast\b", "Saccharomyces cerevisiae"), (r"\bplasmodium berghei\b|\bp\.?\s*berghei\b", "Plasmodium berghei"),
]
#: Samples by pattern before organs, the organs with what may follow them, and samples after organs.
SAMPLES = [
    (r"\bhela\s+cell\s+pellet\b", "HeLa cell pellet"), (r"\bhela\s+cells?\b|\bhela\b", "HeLa cell"), (r"(?s)jugular vein.*carotid artery|carotid artery.*jugular vein", "jugular vein or carotid artery"), (r"\bookinetes?\b", "ookinete"),
    (r"\bbrown adipose tissue\b", "brown adipose tissue"), (r"\badipose tissue\b", "adipose tissue"), (r"\bcochlear hair cells?\b", "cochlear hair cell"),
]
ORGANS = ["liver", "brain", "retina", "kidney", "breast", "tongue", "intestine", "cochlea", "heart", "lung", "muscle", "spleen", "pancreas", "skin", "root", "leaf"]
ORGAN_ENDS = ["tissue sample", "tissue", "cells", "cell", "sample"]
OWNERS = "human|mouse|murine|rat|zebrafish|arabidopsis"
CELLS = [(r"\bhepatocytes?\b", "hepatocyte"), (r"\bcholangiocytes?\b", "cholangiocyte"), (r"\bendothelial cells?\b", "endothelial cell"), (r"\bneurons?\b", "neuron")]


#: Named values that say nothing, and samples that say too little.
UNKNOWN = ["unknown", "not known", "not specified", "n/a", "na", "none", "null", "/"]
VAGUE_SAMPLES = ["cell", "cells", "tissue", "sample", "specimen", "volume", "raw images", "benchmark data"]


def cleaned(value: Column) -> Column:
    """A named value without runs of blanks, or blanks, semicolons and commas at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(value, r"\s+", " "), "^[ ;,]+|[ ;,]+$", ""), F.lit(""))


def known(value: Column) -> Column:
    """A cleaned value, null where it says that the value isn't known."""
    return F.when(~F.lower(F.trim(cleaned(value))).isin(*UNKNOWN), cleaned(value))


def first_known(values: Column) -> Column:
    """The first of a list of named values that tells something."""
    return F.get(F.filter(F.transform(values, known), lambda v: v.isNotNull()), F.lit(0))


def methods_of(direct: Column, text: Column) -> Column:
    """A named method and those that the text tells, each once, joined by ' ; '; general words only count where nothing else is told."""
    low = F.lower(text)
    told = F.array_compact(F.array(known(direct), *[F.when(low.rlike(p), F.lit(v)) for p, v in METHODS]))
    special = F.filter(told, lambda m: ~F.lower(m).isin(*GENERAL_METHODS))
    volume = F.exists(told, lambda m: F.lower(m).isin("volume em", "volume electron microscopy")) | F.coalesce(low.rlike(VOLUME_METHOD), F.lit(False))
    chosen = F.when(F.size(special) > 0, special).when(volume, F.array(F.lit("volume EM"))).otherwise(told)
    return F.nullif(F.array_join(unique_ignoring_case(chosen), " ; "), F.lit(""))


def organism_of(direct: Column, text: Column) -> Column:
    """The organism that a named value tells, else that value itself, else the one that the text tells. "Unknown" and the like are no values."""
    return F.coalesce(first_match(F.lower(known(direct)), ORGANISMS), known(direct), first_match(F.lower(text), ORGANISMS))


def sample_of(direct: Column, text: Column) -> Column:
    """A named sample unless it is vague, else the one that the text tells: by name, by an organ and what follows it, by an owner's organ, by a kind of cell."""
    low = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[_/-]+", " "), r"\s+", " ")))
    organs = "|".join(ORGANS)
    ended = [F.concat(F.nullif(F.regexp_extract(low, rf"\b(?:{OWNERS})?\s*({organs})\s+{end}\b", 1), F.lit("")), F.lit(f" {end}")) for end in ORGAN_ENDS]
    owned = F.nullif(F.regexp_extract(low, rf"\b(?:{OWNERS})\s+({organs})\b", 1), F.lit(""))
    named = F.when(~F.lower(known(direct)).isin(*VAGUE_SAMPLES), known(direct))
    return F.coalesce(named, first_match(low, SAMPLES), *ended, F.when(owned == "retina", owned).otherwise(F.concat(owned, F.lit(" tissue"))), first_match(low, CELLS))


#: Repositories by link, in order.
REPOSITORIES = [
    (r"(?i)doi\.org/10\.6019/empiar", "EMPIAR"), (r"(?i)doi\.org/10\.6019/s-biad", "BioImage Archive"), (r"(?i)doi\.org/10\.17867/", "BioImage Archive"), (r"(?i)ebi\.ac\.uk/(biostudies|bioimage)", "BioImage Archive"), (r"(?i)ebi\.ac\.uk/empiar", "EMPIAR"),
    (r"(?i)doi\.org/10\.5281/|(?:^|//)(?:www\.)?zenodo\.org", "Zenodo"), (r"(?i)doi\.org/10\.25378/|openorganelle\.janelia\.org", "OpenOrganelle"), (r"(?i)doi\.org/10\.60533/|bossdb\.org", "BossDB"), (r"(?i)webknossos\.org", "WEBKNOSSOS"),
    (r"(?i)doi\.org/10\.5061/|datadryad\.org", "Dryad"), (r"(?i)doi\.org/10\.6084/|figshare\.com", "figshare"), (r"(?i)idr\.openmicroscopy\.org", "IDR"), (r"(?i)doi\.org/10\.17632/|data\.mendeley\.com", "Mendeley Data"), (r"(?i)doi\.org/10\.57760/|scidb\.cn", "Science Data Bank"),
    (r"(?i)open\.quiltdata\.com", "Quilt"), (r"(?i)doi\.org/10\.26275/", "SPARC"), (r"(?i)doi\.org/10\.(25740|5258|6075)/", "Institutional repository"), (r"(?i)epfl\.ch", "Institutional repository"),
]


def repository_of(url: Column, rules: list[tuple[str, str]] = REPOSITORIES) -> Column:
    return F.when(blank_to_null(url).isNull(), "Not yet deposited").otherwise(first_match(url, rules, "Other"))


def reference_url(dataset_doi: Column, source_url: Column, experiment_doi: Column) -> Column:
    """The data set's DOI, else its own link, else its parent's DOI."""
    doi = lambda x: F.concat(F.lit("https://doi.org/"), blank_to_null(x))
    return F.coalesce(doi(dataset_doi), blank_to_null(source_url), doi(experiment_doi))


#: In-plane resolution bands, the last open.
RESOLUTION_BANDS = [("< 1 nm/px", 1.0), ("1 – 4 nm/px", 4.0), ("4 – 8 nm/px", 8.0), ("8 – 32 nm/px", 32.0), ("≥ 32 nm/px", None)]


def is_3d(tags: Column, resolution: Column, depth: Column) -> Column:
    tagged = F.coalesce(F.exists(tags, lambda t: F.upper(F.trim(t)) == "3D"), F.lit(False))
    axes = F.regexp_count(F.coalesce(resolution, F.lit("")), F.lit(r"(?i)(\d+(?:\.\d+)?)\s*nm"))
    return tagged | (axes >= 3) | F.coalesce(depth > 1, F.lit(False))
