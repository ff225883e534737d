"""Queries of the catalogue: triage, repositories, cleaning, scans, first records, filter reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import text as tx
from lamella.operators import catalog, rules
from lamella.plans.binding import Book, Tables

BOOK = Book()
TERMS, EVIDENCE = ["the", "und", "les-queux", "para"], [" is ", " der ", " une ", " con ", "license"]
EXCLUDED = [(r"\bstupid\b", "excluded: insult"), (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "excluded: number"), (r"[#*%]{3}", "excluded: symbols")]


def _hit(t: str) -> str:
    return f"regexp_matches(b, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"


@BOOK.add(f"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS b FROM documents),
h AS (SELECT doc_id, b, list_filter([{', '.join(f"CASE WHEN {_hit(t)} OR regexp_matches(regexp_replace(b, '[-_/]+', ' ', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in TERMS)}], lambda x: x IS NOT NULL) AS hits,
  list_filter([{', '.join(f"CASE WHEN contains(b, '{t}') THEN '{t.strip()}' END" for t in EVIDENCE)}], lambda x: x IS NOT NULL) AS seen,
  CASE WHEN regexp_matches(b, '\\bstupid\\b') THEN 'excluded: insult' WHEN regexp_matches(b, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') THEN 'excluded: number' WHEN regexp_matches(b, '[#*%]{{3}}') THEN 'excluded: symbols' END AS reason FROM n)
SELECT doc_id, CASE WHEN reason IS NOT NULL THEN 'ineligible' WHEN len(hits) > 0 AND len(seen) > 0 THEN 'eligible' ELSE 'uncertain' END AS status,
  CASE WHEN reason IS NOT NULL THEN 0.95 WHEN len(hits) > 0 AND len(seen) > 0 THEN 0.9 WHEN len(hits) > 0 THEN 0.62 WHEN contains(b, 'sem') AND NOT regexp_matches(b, 'fib|sbf|sbem|serial block|atum|volume|multibeam') THEN 0.75 ELSE 0.35 END::DOUBLE AS confidence,
  CASE WHEN reason IS NULL AND len(hits) > 0 THEN hits[1] END AS modality, reason, reason IS NULL AND NOT (len(hits) > 0 AND len(seen) > 0) AS review FROM h""")
def triage_documents(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    d = t.documents.select("doc_id", F.col("source").alias("source_name"), none.alias("title"), none.alias("modality"), none.alias("tissue_or_sample"), F.col("text").alias("evidence_text"), F.array().cast("array<string>").alias("file_formats"), none.alias("raw_metadata"))
    return catalog.classify(d, TERMS, EVIDENCE, EXCLUDED).select("doc_id", "verdict.status", "verdict.confidence", "verdict.modality", F.when(F.col("verdict.status") == "ineligible", F.col("verdict.reason")).alias("reason"), "verdict.review")


@BOOK.add("""WITH s AS (SELECT CASE WHEN quality = 0 THEN 'ineligible' WHEN toxic = 1 THEN 'uncertain' ELSE 'eligible' END AS st, toxic = 1 AS rv FROM labels)
SELECT CASE WHEN rv OR st = 'uncertain' THEN 'review' ELSE st END AS route, count(*) AS n FROM s GROUP BY 1""")
def route_labels(t: Tables) -> DataFrame:
    status = F.when(F.col("quality") == 0, "ineligible").when(F.col("toxic") == 1, "uncertain").otherwise("eligible")
    return catalog.route_counts(t.labels.withColumn("route", catalog.route(status, F.col("toxic") == 1)))


HOSTS = [(r"(?i)//blog\.", "blog"), (r"(?i)//m\.", "mobile"), (r"(?i)\.org(/|$)", "org"), (r"(?i)\.net(/|$)", "net")]


@BOOK.add("""SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN 'Not yet deposited' WHEN regexp_matches(url, '(?i)//blog\\.') THEN 'blog' WHEN regexp_matches(url, '(?i)//m\\.') THEN 'mobile'
  WHEN regexp_matches(url, '(?i)\\.org(/|$)') THEN 'org' WHEN regexp_matches(url, '(?i)\\.net(/|$)') THEN 'net' ELSE 'Other' END AS repository, coalesce('https://doi.org/' || nullif(trim(CASE WHEN page_id % 3 = 0 THEN '10.1/' || page_id ELSE ' ' END), ''), nullif(trim(url), '')) AS link FROM pages""")
def repository_rules(t: Tables) -> DataFrame:
    doi = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.1/"), "page_id")).otherwise(" ")
    return t.pages.select("page_id", catalog.repository_of(F.col("url"), HOSTS).alias("repository"), catalog.reference_url(doi, F.col("url"), F.lit(None).cast("string")).alias("link"))


#: The entities that pages have, the ampersand last so that nothing is unescaped twice; unescaped before tags are stripped.
_CLEAN = "html"
for _k, _v in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&middot;": "·", "&copy;": "©"}.items():
    _CLEAN = f"replace({_CLEAN}, '{_k}', '{_v}')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '&amp;?', '&', 'g'), '<[^>]+>', ' ', 'g')"


@BOOK.add(f"SELECT page_id, nullif(left(trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')), 4000), '') AS evidence FROM pages")
def html_clean(t: Tables) -> DataFrame:
    """Pages may be cut inside an entity, which then stays as it is."""
    return t.pages.select("page_id", tx.evidence_text(F.col("html"), closed=True).alias("evidence"))


_SCAN = "SELECT {k} AS id, '{n}' AS origin, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS found FROM {n}"


@BOOK.add(" UNION ALL ".join(_SCAN.format(k=k, n=n, kind=kind, p=p.replace("'", "''")) for k, n in (("doc_id", "documents"), ("conv_id", "conversations")) for kind, p in rules.FORBIDDEN.items()))
def pii_scan(t: Tables) -> DataFrame:
    a = rules.scan(t.documents, "doc_id", "text", rules.FORBIDDEN).select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), "kind", "found")
    b = rules.scan(t.conversations.withColumn("row", F.struct("conv_id", "turn")), "row", "text", rules.FORBIDDEN).select(F.col("row.conv_id").alias("id"), F.lit("conversations").alias("origin"), "kind", "found")
    return a.unionByName(b)


@BOOK.add(f"SELECT doc_id, md5(regexp_replace(text, '{rules.FORBIDDEN['email']}', '[redacted]', 'g')) AS digest, len(regexp_extract_all(text, '{rules.FORBIDDEN['email']}')) AS n, 0 AS n_left FROM documents")
def redact_emails(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", tx.redact(F.col("text"), rules.FORBIDDEN["email"]).alias("r"))
    return d.select("doc_id", F.md5("r.text").alias("digest"), F.col("r.n").alias("n"), F.col("r.left").alias("n_left"))


@BOOK.add("""SELECT r AS rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(user_id < 100, false) THEN 'user' END, CASE WHEN NOT coalesce(value BETWEEN 0 AND 100, false) THEN 'value' END,
  CASE WHEN NOT (event_type <> 'error' OR value > 50) THEN 'error' END], lambda x: x IS NOT NULL)) AS r FROM events) GROUP BY 1""")
def contract_report(t: Tables) -> DataFrame:
    checks = {"user": F.col("user_id") < 100, "value": F.col("value").between(0, 100), "error": (F.col("event_type") != "error") | (F.col("value") > 50)}
    return t.events.select(F.explode(rules.violations(checks)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@BOOK.add("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_records(t: Tables) -> DataFrame:
    return catalog.first_records(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@BOOK.add("SELECT sha256(text) AS digest, min(doc_id) AS keeper, count(*) AS n FROM documents GROUP BY 1")
def same_bytes(t: Tables) -> DataFrame:
    return catalog.same_bytes(t.documents, "text", "doc_id", "doc_id")


_REASON = """CASE WHEN coalesce(quality, 2) NOT IN (1, 2) THEN 'status!=accepted|unknown' WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'source_kind_excluded'
  WHEN lang NOT IN ('en', 'de') THEN 'license:' || lang WHEN n_chars < 300 THEN 'min_side<300' WHEN n_chars / 10000.0 > 0.9 THEN 'background_fraction>0.9' END"""


@BOOK.add(f"WITH r AS (SELECT {_REASON} AS reason FROM documents LEFT JOIN labels USING (doc_id)) SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM r")
def tile_filter_reasons(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    d = d.withColumns({"status": F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("unknown"), "source_kind": F.col("source"), "license": F.col("lang"), "width": F.col("n_chars"), "height": F.col("n_chars") * 2, "background_fraction": F.col("n_chars") / 10000.0})
    f = rules.RecordFilter(statuses=("accepted", "unknown"), source_kinds=tuple(f"src{i}" for i in range(10)), licences=("en", "de"), dtype=None, dynamic_range=False, warnings=(), min_side=300, max_background=0.9)
    return rules.reason_counts(d.withColumn("reason", f.reason()), "reason")


@BOOK.add("""SELECT doc_id, p AS published FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN 'spa' ELSE lang END AS p, source FROM documents) WHERE p <> 'fr' AND source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 0)""")
def gated_vocabulary(t: Tables) -> DataFrame:
    spark = t.spark
    allowed = t.documents.where("doc_id % 7 = 0").select("source").distinct()
    ok, _ = rules.gate(t.documents, allowed, ["source"])
    over = spark.createDataFrame([("lang", "es", "spa", False), ("lang", "fr", None, True)], "grp string, original string, replacement string, dropped boolean")
    d = rules.override_values(ok.select("doc_id", F.lit("lang").alias("grp"), F.col("lang").alias("name")), over)
    return d.select("doc_id", F.col("name").alias("published"))


@BOOK.add("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def gate_failures(t: Tables) -> DataFrame:
    return rules.gate(t.documents, t.documents.where("doc_id % 50 = 0").select("source").distinct(), ["source"])[1]


@BOOK.add("""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::INTEGER AS page, nullif(regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([a-z0-9]{1,8})$', 1), '') AS suffix,
  sha1('v1:' || page_id || ':' || url) AS content_id FROM pages""")
def page_identity(t: Tables) -> DataFrame:
    q = F.regexp_extract("url", r"[?&]page=([0-9]+)", 1)
    return t.pages.select("page_id", F.nullif(q, F.lit("")).cast("int").alias("page"), tx.suffix_of(F.col("url")).alias("suffix"), tx.stable_id("v1", F.col("page_id").cast("string"), F.col("url")).alias("content_id"))


@BOOK.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') >= '2024-01-15' AS recent FROM events WHERE contains(lower(event_type), 'c')")
def modified_since(t: Tables) -> DataFrame:
    d = t.events.where(tx.matches_query(F.col("event_type"), "c"))
    return d.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), tx.modified_since("2024-01-15", F.date_format("ts", "yyyy-MM-dd")).alias("recent"))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
