"""Queries of state: versions, memberships, checks, warnings, and streams against their batch answers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import analysis, library
from lamella.plans.binding import Book, Tables
from lamella.streaming import ingest, ledger

BOOK = Book()


@BOOK.add("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def versions(t: Tables) -> DataFrame:
    return library.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@BOOK.add("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS superseded_at FROM events")
def superseded(t: Tables) -> DataFrame:
    return library.superseded(t.events.withColumn("at", F.col("event_id")), ["user_id"], "event_id", "at").select("event_id", "user_id", "superseded_at")


@BOOK.add("""WITH m AS (SELECT c_custkey AS item, c_nationkey AS dataset FROM customer), ch AS (SELECT c_custkey AS item, (c_nationkey + 1) % 25 AS dataset FROM customer WHERE c_custkey % 5 = 0)
SELECT item, dataset FROM m WHERE item NOT IN (SELECT item FROM ch) UNION SELECT item, dataset FROM ch""")
def membership_replace(t: Tables) -> DataFrame:
    m = t.customer.select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("long").alias("dataset"))
    changes = m.where("item % 5 = 0").withColumn("dataset", (F.col("dataset") + 1) % 25)
    return library.assign_membership(m, changes, replace=True)


@BOOK.add("""WITH m AS (SELECT c_custkey AS item, c_nationkey AS dataset FROM customer), mv AS (SELECT c_custkey AS item, c_custkey % 5 AS experiment FROM customer WHERE c_custkey % 2 = 0), h AS (SELECT n_nationkey AS dataset, n_regionkey AS experiment FROM nation)
SELECT m.item, m.dataset FROM m LEFT JOIN mv ON m.item = mv.item LEFT JOIN h ON m.dataset = h.dataset WHERE mv.item IS NULL OR h.experiment = mv.experiment""")
def membership_experiment(t: Tables) -> DataFrame:
    m = t.customer.select(F.col("c_custkey").alias("item"), F.col("c_nationkey").cast("long").alias("dataset"))
    moves = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item"), (F.col("c_custkey") % 5).alias("experiment"))
    homes = t.nation.select(F.col("n_nationkey").cast("long").alias("dataset"), F.col("n_regionkey").cast("long").alias("experiment"))
    return library.set_experiment(m, moves, homes)


@BOOK.add("SELECT c_custkey AS item FROM customer WHERE c_acctbal > 0 AND (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_custkey % 11 = 0)")
def resolve_scope(t: Tables) -> DataFrame:
    sets = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("dataset"))
    members = t.customer.select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("dataset"))
    return library.resolve_scope(sets, members.where("item % 11 = 0").select("item"), members, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("item")))


@BOOK.add("""SELECT n_nationkey AS dataset, count(*) FILTER (WHERE c_acctbal > 0) AS n_active, count(c_custkey) AS n_all FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 3 > 0 GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*) FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 0""")
def grouped_counts(t: Tables) -> DataFrame:
    members = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("dataset"))
    active = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("item"))
    return library.grouped_counts(t.nation.select(F.col("n_nationkey").alias("dataset")), members, active)


@BOOK.add("""SELECT l_shipmode AS k, yes, no, unsure, own_yes, CASE WHEN yes > 0 THEN own_yes / yes END::DOUBLE AS self_confirmed FROM (SELECT l_suppkey % 20 AS l_shipmode, count(*) FILTER (WHERE l_returnflag = 'A') AS yes, count(*) FILTER (WHERE l_returnflag = 'R') AS no, count(*) FILTER (WHERE l_returnflag = 'N') AS unsure, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS own_yes FROM lineitem GROUP BY 1)""")
def spot_checks(t: Tables) -> DataFrame:
    answer = F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no").otherwise("unsure")
    return library.answers(t.lineitem.select((F.col("l_suppkey") % 20).alias("k"), answer.alias("answer"), (F.col("l_linestatus") == "F").alias("own")), ["k"])


@BOOK.add("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) AS n FROM events GROUP BY 1")
def annotation_counts(t: Tables) -> DataFrame:
    return library.annotation_counts(t.events.withColumnRenamed("event_type", "kind"), "user_id", ["click", "error"])


@BOOK.add("""SELECT c_mktsegment AS grp, string_agg(c, '|' ORDER BY o) AS caveats FROM (SELECT c_mktsegment, unnest([CASE WHEN count(DISTINCT c_nationkey) < count(*) THEN 'repeated images' END, CASE WHEN bool_or(c_name IS NULL) THEN 'no label' END,
  CASE WHEN bool_or(c_acctbal > 0) AND NOT bool_and(c_acctbal > 0) THEN 'mixed calibration' END, CASE WHEN count(DISTINCT c_custkey % 2) > 1 THEN 'mixed scale' END]) AS c, unnest([1, 2, 3, 4]) AS o FROM customer GROUP BY 1) WHERE c IS NOT NULL GROUP BY 1""")
def group_caveats(t: Tables) -> DataFrame:
    d = t.customer.select(F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("image"), F.col("c_name").alias("label"), (F.col("c_acctbal") > 0).alias("calibrated"), (F.col("c_custkey") % 2).alias("nm"))
    return analysis.group_caveats(d, "grp").withColumn("caveats", F.array_join("caveats", "|"))


@BOOK.add("SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_tally(t: Tables) -> DataFrame:
    return analysis.tally(t.lineitem, "l_discount")


def _stream(t: Tables) -> DataFrame:
    """The events table as a file stream."""
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(t: Tables) -> str:
    """A new folder in the shared one; on a local master without one (tests), in a temporary one."""
    sc = t.spark.sparkContext
    root = t.spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root}/streams/{uuid.uuid4().hex}"


@BOOK.add("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_dedupe(t: Tables) -> DataFrame:
    where = _folder(t)
    unique = ingest.unique(_stream(t), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type", F.lit(True).alias("seen"))
    ingest.run_once(unique, f"{where}/out", f"{where}/checkpoint")
    return t.spark.read.schema("user_id long, event_type string, seen boolean").parquet(f"{where}/out")


@BOOK.add("SELECT date_trunc('day', ts) AS start, event_type AS route, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY ALL")
def stream_windows(t: Tables) -> DataFrame:
    """Windows that the watermark has closed; the last, open day is left out."""
    where = _folder(t)
    counts = ingest.route_windows(_stream(t), "ts", "0 seconds", "1 day", F.col("event_type"))
    ingest.run_once(counts, f"{where}/out", f"{where}/checkpoint")
    return t.spark.read.schema("start timestamp, route string, n long").parquet(f"{where}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "route", "n")


@BOOK.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_versions(t: Tables) -> DataFrame:
    where = _folder(t)
    stream = _stream(t).select("user_id", "event_id", "event_type")
    ingest.keep_versions(stream, f"{where}/table", f"{where}/checkpoint", ["user_id"], ["event_id"])
    return ingest.kept_versions(t.spark, f"{where}/table", stream.schema, ["user_id"], ["event_id"])


@BOOK.add("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_first(t: Tables) -> DataFrame:
    """The first event of each user and kind, however late a repeat comes."""
    where = _folder(t)
    ledger.keep_first(_stream(t).select("user_id", "event_type", "event_id"), f"{where}/table", f"{where}/checkpoint", ["user_id", "event_type"], ["event_id"])
    return ledger.first_records(t.spark, f"{where}/table", "user_id long, event_type string, event_id long")


@BOOK.add("SELECT event_type AS part, event_id, value FROM events")
def part_table(t: Tables) -> DataFrame:
    """Events by kind as parts of a table: offered twice, parsed once."""
    where = _folder(t)
    d = t.events.select(F.col("event_type").alias("part"), "event_id", "value")
    for offered in (d.where("part < 'm'"), d):
        ledger.add_parts(t.spark, where, offered, lambda new: new)
    return ledger.read_parts(t.spark, where, "part string, event_id long, value double")


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
