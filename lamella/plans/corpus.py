"""Queries of tile corpora and splits: caps, orders, shards, enrichment, coverage, windows, quotas, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import order, splits, tiles
from lamella.plans.binding import Book, Tables

BOOK = Book()


@BOOK.add("""WITH e AS (SELECT *, min(user_id) OVER w AS ux, max(user_id) OVER w AS vx, min(value) OVER w AS uy, max(value) OVER w AS vy FROM events WINDOW w AS (PARTITION BY event_type)),
b AS (SELECT *, (least(9, coalesce(floor((value - uy) / nullif(vy - uy, 0) * 10), 0)) * 10 + least(9, coalesce(floor((user_id - ux)::DOUBLE / nullif(vx - ux, 0) * 10), 0)))::BIGINT AS bin FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type, bin ORDER BY value DESC, event_id) AS turn, sha1('s:' || event_type || ':' || bin) AS d FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY turn, d) AS place FROM t) SELECT event_id, event_type, bin, turn, place FROM p WHERE place <= 200""")
def spatial_cap(t: Tables) -> DataFrame:
    d = tiles.spatial_cap(t.events, "event_type", "event_id", "user_id", "value", [F.desc("value")], 200, "s")
    return d.select("event_id", "event_type", "bin", "turn", "place")


@BOOK.add("""SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY sha1('b:' || doc_id), doc_id) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY source) AS share, sha1('b:' || source) AS source_digest FROM documents""")
def balanced_order(t: Tables) -> DataFrame:
    return order.balanced(t.documents.select("doc_id", "source"), "source", "b", "doc_id").select("doc_id", "source", F.col("share"), "source_digest")


@BOOK.add("SELECT doc_id, row_number() OVER (ORDER BY sha1('x:' || doc_id), doc_id) - 1 AS place, (row_number() OVER (ORDER BY sha1('x:' || doc_id), doc_id) - 1) // 64 AS shard FROM documents")
def shards(t: Tables) -> DataFrame:
    return order.shards(order.numbered(t.documents.select("doc_id"), "x", "doc_id"), 64).select("doc_id", "place", "shard")


@BOOK.add("""WITH s AS (SELECT source, (row_number() OVER (ORDER BY sha1('x:' || doc_id), doc_id) - 1) // 64 AS shard FROM documents), c AS (SELECT shard, source, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT NULL, source, count(*) FROM s GROUP BY source)
SELECT shard, sum(n)::BIGINT AS rows, count(*) AS sources, max(n) AS most, arg_max(source, (n, source)) AS largest FROM c GROUP BY shard""")
def shard_counts(t: Tables) -> DataFrame:
    return tiles.shard_counts(order.shards(order.numbered(t.documents.select("doc_id", "source"), "x", "doc_id"), 64), "source")


@BOOK.add("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS lead FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, lead LIMIT 100")
def round_robin(t: Tables) -> DataFrame:
    return order.round_robin(t.documents.select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source", "turn")


@BOOK.add("SELECT doc_id FROM documents ORDER BY sha1('r:' || doc_id), doc_id LIMIT 100")
def hash_sample(t: Tables) -> DataFrame:
    return order.hash_sample(t.documents.select("doc_id"), "doc_id", "r", 100).select("doc_id")


@BOOK.add("SELECT c_custkey, sha256(c_custkey || ':q') AS draw FROM customer ORDER BY draw, c_custkey LIMIT 60")
def draw_order(t: Tables) -> DataFrame:
    return order.draw_order(t.customer, "c_custkey", "q", 60).select("c_custkey", "draw")


@BOOK.add("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, c_mktsegment) AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def metadata_join_keep(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("segment"))
    return tiles.enrich(o, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "k", ["segment"]).select("o_orderkey", "segment")


@BOOK.add("SELECT doc_id, coalesce(quality, CASE WHEN doc_id % 3 = 0 THEN 9 END) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def metadata_join_overwrite(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 9).alias("quality"))
    return tiles.enrich(d, t.labels.select("doc_id", "quality"), "doc_id", ["quality"], overwrite=True).select("doc_id", "quality")


@BOOK.add("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def require_match(t: Tables) -> DataFrame:
    return tiles.unmatched(t.documents, t.labels, "doc_id")


@BOOK.add("""WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT field, valid, total - valid AS missing, round(100 * valid / total, 6)::DOUBLE AS percent FROM (SELECT count(*) AS total, unnest(['quality', 'lang', 'toxic']) AS field,
  unnest([count(quality), count(nullif(trim(lang), '')), count(toxic)]) AS valid FROM d)""")
def coverage(t: Tables) -> DataFrame:
    return tiles.coverage(t.documents.join(t.labels, "doc_id", "left"), ["quality", "lang", "toxic"]).withColumn("percent", F.round("percent", 6))


@BOOK.add("SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def crosstab(t: Tables) -> DataFrame:
    return tiles.crosstab(t.documents.join(t.labels, "doc_id", "left"), "lang", "quality")


@BOOK.add("""WITH v AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r FROM orders WHERE o_totalprice > 0), s AS (SELECT count(*) AS n, round(avg(ln(v)), 6) AS log_mean, round(stddev_pop(ln(v)), 6) AS log_sd FROM v), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS q)
SELECT q, v AS at, n, log_mean, log_sd FROM q CROSS JOIN s JOIN v ON r = round_even(q * (n - 1), 0)""")
def log_stats(t: Tables) -> DataFrame:
    return tiles.log_stats(t.orders, "o_totalprice", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]).withColumns({c: F.round(c, 6) for c in ("log_mean", "log_sd")})


@BOOK.add("""WITH k AS (SELECT DISTINCT doc_id::VARCHAR AS k FROM documents), a6 AS (SELECT substr(md5(k), 1, 6) AS p, sha256(string_agg(k, chr(10) ORDER BY k)) AS d, count(*) AS c FROM k GROUP BY 1), a4 AS (SELECT substr(p, 1, 4) AS p, sha256(string_agg(d, chr(10) ORDER BY a6.p)) AS d, sum(c) AS c FROM a6 GROUP BY substr(a6.p, 1, 4)), a2 AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(d, chr(10) ORDER BY a4.p)) AS d, sum(c) AS c FROM a4 GROUP BY substr(a4.p, 1, 2)) SELECT sha256(string_agg(d, chr(10) ORDER BY p)) AS fingerprint, sum(c)::BIGINT AS n FROM a2""")
def fingerprint(t: Tables) -> DataFrame:
    return tiles.fingerprint(t.documents, "doc_id")


@BOOK.add("""WITH p AS (SELECT p_partkey, p_size * 10 + 20 AS w, trunc(p_retailprice)::BIGINT % 200 + 10 AS h FROM part), g AS (SELECT p_partkey, w, h, unnest(list_distinct(CASE WHEN h < 64 THEN [] ELSE list_concat(range(0, h - 64 + 1, 48), CASE WHEN (h - 64) % 48 > 0 THEN [h - 64] ELSE [] END) END)) AS y FROM p)
SELECT p_partkey, unnest(list_distinct(CASE WHEN w < 64 THEN [] ELSE list_concat(range(0, w - 64 + 1, 48), CASE WHEN (w - 64) % 48 > 0 THEN [w - 64] ELSE [] END) END)) AS x, y FROM g""")
def window_grid(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", (F.col("p_size") * 10 + 20).cast("long").alias("w"), (F.col("p_retailprice").cast("long") % 200 + 10).alias("h"))
    return tiles.windows(d, "w", "h", 64, 48).select("p_partkey", "x", "y")


@BOOK.add("""WITH d AS (SELECT doc_id, source || '/' || lang AS grp, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS h FROM documents)
SELECT doc_id, grp, CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY h, doc_id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY grp)) THEN 'val' ELSE 'train' END AS split FROM d""")
def split_by_count(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.concat_ws("/", "source", "lang").alias("grp"))
    return splits.by_count(d, ["grp"], "doc_id", 0.2).select("doc_id", "grp", "split")


@BOOK.add("""WITH d AS (SELECT doc_id, n_chars, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS h FROM documents)
SELECT doc_id, CASE WHEN coalesce(sum(n_chars) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2::DOUBLE * sum(n_chars) OVER () THEN 'val' ELSE 'train' END AS split FROM d""")
def split_by_budget(t: Tables) -> DataFrame:
    return splits.by_budget(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 0.2).select("doc_id", "split")


@BOOK.add("SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 AND doc_id // 10 NOT IN (SELECT doc_id // 10 FROM documents WHERE doc_id % 10 = 3 AND lang = 'en')")
def leak_guard(t: Tables) -> DataFrame:
    d = t.documents.withColumn("image", F.floor(F.col("doc_id") / 10))
    return splits.leak_guard(d.where("doc_id % 10 <> 3"), d.where("doc_id % 10 = 3 and lang = 'en'"), ["image"]).select("doc_id")


@BOOK.add("""WITH s AS (SELECT source, count(*) AS supply FROM documents GROUP BY 1), c AS (SELECT source, count(*) AS current FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1),
q AS (SELECT coalesce(s.source, c.source) AS source, coalesce(supply, 0) AS supply, coalesce(current, 0) AS current FROM s FULL JOIN c ON s.source = c.source), z AS (SELECT *, greatest(0, least(supply, 20 - current)) AS quota FROM q),
r AS (SELECT sum(current + quota) AS rest FROM z WHERE source <> 'src0') SELECT source, supply, current, CASE WHEN source = 'src0' THEN greatest(0, least(supply, floor(rest * 0.15::DOUBLE / (1 - 0.15::DOUBLE)) - current)) ELSE quota END::BIGINT AS quota FROM z CROSS JOIN r""")
def quotas(t: Tables) -> DataFrame:
    d = t.documents.groupBy("source").agg(F.count("*").alias("supply"))
    c = t.documents.join(t.labels.where("quality = 0"), "doc_id").groupBy("source").agg(F.count("*").alias("current"))
    return splits.solve_share(splits.quota(d, c, "source", F.lit(20)), "source", "src0", 0.15).select("source", "supply", "current", "quota")


@BOOK.add("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha1('d:' || doc_id), doc_id) <= least(15, count(*) OVER (PARTITION BY source) // 2)")
def quota_sample(t: Tables) -> DataFrame:
    q = t.documents.groupBy("source").agg(F.least(F.lit(15), F.floor(F.count("*") / 2)).alias("quota"))
    return splits.draw(t.documents.select("doc_id", "source"), q, "source", "doc_id", "d").select("doc_id", "source")


@BOOK.add("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha1('f:' || doc_id), doc_id) <= greatest(1, round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY source), 0))")
def stratified_subset(t: Tables) -> DataFrame:
    return splits.stratified(t.documents.select("doc_id", "source"), "source", "doc_id", 0.1, "f").select("doc_id", "source")


@BOOK.add("""SELECT doc_id, CASE WHEN n >= 20 AND r <= greatest(1, round_even(0.15::DOUBLE * n, 0)) THEN 'heldout_image' ELSE 'train' END AS split FROM (SELECT doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents)""")
def held_out_band(t: Tables) -> DataFrame:
    return splits.held_out_band(t.documents.select("doc_id", "source", "n_chars"), "source", ["n_chars", "doc_id"]).select("doc_id", "split")


@BOOK.add("""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), m AS (SELECT max(n) AS m FROM d) SELECT doc_id, lang, unnest(range(0, ((m - 1 - i) // n) + 1)) AS draw FROM d CROSS JOIN m""")
def oversample(t: Tables) -> DataFrame:
    return splits.oversample(t.documents.select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "draw")


@BOOK.add("SELECT lang, count(*) AS n, max(count(*)) OVER () / count(*)::DOUBLE AS ratio FROM documents GROUP BY lang")
def imbalance(t: Tables) -> DataFrame:
    return splits.imbalance(t.documents, "lang")


@BOOK.add("""WITH u AS (SELECT DISTINCT source AS unit FROM documents), f AS (SELECT unit AS held, row_number() OVER (ORDER BY unit) - 1 AS fold FROM u) SELECT doc_id, fold, CASE WHEN source = held THEN 'heldout' ELSE 'train' END AS role FROM documents CROSS JOIN f""")
def fold_plan(t: Tables) -> DataFrame:
    return splits.folds(t.documents.select("doc_id", "source", "lang"), "source", "lang").select("doc_id", "fold", "role")


@BOOK.add("SELECT lang, source, count(*) AS n, grouping_id(lang, source)::BIGINT AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source))")
def pivot_counts(t: Tables) -> DataFrame:
    return splits.pivot_counts(t.documents, "lang", "source")


@BOOK.add("SELECT split, source, count(*) AS rows, sum(n_chars)::BIGINT AS weight, count(*) FILTER (WHERE quality = 0) AS empty FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2")
def build_report(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train"))
    return splits.build_report(d, "split", "source", "n_chars", "quality")


@BOOK.add("""SELECT floor(user_id / 16)::BIGINT AS cx, floor(y / 4)::BIGINT AS cy, event_type, count(*) FILTER (WHERE value > 1) AS valid, count(*) FILTER (WHERE value > 1 AND value > 20) AS foreground FROM (SELECT *, extract(hour FROM ts) AS y FROM events) GROUP BY ALL HAVING valid >= 5 AND foreground >= 2""")
def grid_supply(t: Tables) -> DataFrame:
    d = t.events.select("event_type", F.col("user_id").alias("x"), F.hour("ts").alias("y"), "value")
    px = d.select("event_type", "x", F.col("y").alias("y0"), "value")
    out = splits.supply(px.withColumn("y", F.col("y0") * 4), ["event_type"], 16, F.col("value") > 1, F.col("value") > 20, 5, 2)
    return out.select("cx", "cy", "event_type", "valid", "foreground")


@BOOK.add("""SELECT target, code, n, share FROM (SELECT p_type AS target, l_returnflag AS code, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY p_type) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE share >= 0.01""")
def code_legend(t: Tables) -> DataFrame:
    a = t.part.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("target"))
    return splits.legend(a, t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("code")), ["k"]).select("target", "code", "n", "share")


@BOOK.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'test' WHEN c_mktsegment = 'BUILDING' THEN 'val' ELSE 'train' END AS split FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' OR o_totalprice >= 50000""")
def rule_splits(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rules = t.spark.createDataFrame([("BUILDING", "val")], "c_mktsegment string, split string")
    d = splits.held_out_by_rule(d, rules, "c_mktsegment").withColumn("split", F.when(F.col("o_orderstatus") == "O", "test").otherwise(F.col("split")))
    return splits.keep_for_training(d.withColumn("fg_px", F.col("o_totalprice")), 50000).select("o_orderkey", "split")


@BOOK.add("""WITH d AS (SELECT event_type, user_id, percentile_disc(0) WITHIN GROUP (ORDER BY value) AS z, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi, count(value) AS n FROM events GROUP BY 1, 2) SELECT event_type, user_id, n, round(lo, 6) AS lo, round(hi, 6) AS hi, n < 10 AS thin, hi - lo < 50 AS low_range FROM d""")
def normalisation(t: Tables) -> DataFrame:
    d = tiles.percentile_range(t.events, ["event_type", "user_id"], "value", support=10, span=50.0)
    return d.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@BOOK.add("SELECT l_orderkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.01), 6) AS p01, round(quantile_cont(l_quantity, 0.99), 6) AS p99 FROM lineitem GROUP BY 1")
def tile_stats(t: Tables) -> DataFrame:
    return tiles.tile_stats(t.lineitem, ["l_orderkey"], "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "sd", "p01", "p99")})


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
