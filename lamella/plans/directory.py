"""Queries of the published directory: facets, trees, contextual counts, inventory, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import text as tx
from lamella.operators import catalog, facets, rules, tiles
from lamella.operators.order import best_per_group
from lamella.plans.binding import Book, Tables

BOOK = Book()
SIZES = [("small", 10.0), ("medium", 30.0), ("large", None)]


def parts(t: Tables) -> DataFrame:
    return t.part.withColumns({"band": rules.bands(F.col("p_size"), SIZES, "Unknown"), "words": F.split("p_name", " ")})


P_SQL = "p AS (SELECT *, CASE WHEN p_size IS NULL THEN 'Unknown' WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, string_split(p_name, ' ') AS words FROM part)"


@BOOK.add("SELECT p_brand AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lower(p_brand), p_brand) - 1 AS idx FROM part GROUP BY p_brand")
def facet_dictionary(t: Tables) -> DataFrame:
    return facets.dictionary(t.part, "p_brand")


@BOOK.add(f"WITH {P_SQL} SELECT band AS label, count(*) AS n FROM p GROUP BY 1")
def facets_flat(t: Tables) -> DataFrame:
    return facets.flat(parts(t), "band")


@BOOK.add(f"WITH {P_SQL}, q AS (SELECT p_partkey, p_type AS parent, words FROM p) SELECT parent, NULL AS child, count(*) AS n FROM q GROUP BY 1 UNION ALL SELECT parent, child, count(*) FROM (SELECT DISTINCT p_partkey, parent, unnest(words) AS child FROM q) GROUP BY 1, 2")
def facets_tree(t: Tables) -> DataFrame:
    return facets.tree(parts(t), "p_partkey", F.array("p_type"), F.col("words"))


@BOOK.add(f"""WITH {P_SQL}, k AS (SELECT parent, child, n FROM (SELECT p_type AS parent, unnest(words) AS child, count(*) AS n FROM p GROUP BY 1, 2)), c AS (SELECT parent, string_agg(child || '=' || n, ',' ORDER BY n DESC, child) AS children FROM k GROUP BY 1)
SELECT p_type AS parent, count(*) AS n, any_value(children) AS children FROM p JOIN c ON p_type = parent GROUP BY 1""")
def facets_nested(t: Tables) -> DataFrame:
    d = facets.nested(facets.tree(parts(t), "p_partkey", F.array("p_type"), F.col("words")))
    return d.withColumn("children", F.array_join(F.transform("children", lambda c: F.concat_ws("=", c["label"], c["n"].cast("string"))), ","))


SELECTION = facets.Selection({"p_type": ["PROMO", "SMALL"], "words": ["ring", "bolt"], "band": ["large"]}, "r")


@BOOK.add(f"""WITH {P_SQL}, f AS (SELECT *, contains(lower(p_name), 'r') AS q, p_type IN ('PROMO', 'SMALL') AS a, list_has_any(words, ['ring', 'bolt']) AS b, band = 'large' AS c FROM p)
SELECT 'p_type' AS facet, p_type AS label, count(*) AS n FROM f WHERE q AND b AND c GROUP BY 2 UNION ALL SELECT 'band', band, count(*) FROM f WHERE q AND a AND b GROUP BY 2
UNION ALL SELECT 'words', w, count(*) FROM (SELECT DISTINCT p_partkey, unnest(words) AS w FROM f WHERE q AND a AND c) GROUP BY 2""")
def facets_contextual(t: Tables) -> DataFrame:
    return facets.contextual_counts(parts(t), SELECTION, ["p_type", "words", "band"], F.col("p_name"))


@BOOK.add(f"WITH {P_SQL} SELECT p_partkey, p_name FROM p WHERE contains(lower(p_name), 'r') AND p_type IN ('PROMO', 'SMALL') AND list_has_any(words, ['ring', 'bolt']) AND band = 'large'")
def facet_selection(t: Tables) -> DataFrame:
    return facets.select(parts(t), SELECTION, ["p_type", "words", "band"], F.col("p_name")).select("p_partkey", "p_name")


@BOOK.add("""SELECT c_custkey, c_name, coalesce(n, 0) AS n_assets, coalesce(n3, 0) AS n_3d, coalesce(n, 0) - coalesce(n3, 0) AS n_2d FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n3 FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def dataset_inventory(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return facets.inventory(t.customer.select("c_custkey", "c_name"), orders, "c_custkey", F.col("o_orderstatus") == "O")


@BOOK.add("SELECT (SELECT count(*) FROM orders) AS assets, (SELECT count(DISTINCT o_custkey) FROM orders) AS datasets, sha256((SELECT count(*) FROM orders) || ':' || (SELECT count(DISTINCT o_custkey) FROM orders)) AS export_id")
def corpus_counts(t: Tables) -> DataFrame:
    d = t.orders.agg(F.count("*").alias("assets"), F.countDistinct("o_custkey").alias("datasets"))
    return d.withColumn("export_id", F.sha2(F.concat_ws(":", "assets", "datasets"), 256))


@BOOK.add("""WITH d AS (SELECT w AS label, row_number() OVER (ORDER BY count(*) DESC, lower(w), w) - 1 AS idx FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w),
c AS (SELECT p_partkey, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS codes, count(*) AS k FROM (SELECT DISTINCT p_partkey, idx FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) JOIN d ON w = label) GROUP BY 1)
SELECT p_partkey, codes, coalesce(sum(k) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""")
def encoded_values(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    return facets.encode(words, "p_partkey", "w", facets.dictionary(words, "w")).withColumn("codes", F.array_join(F.col("codes").cast("array<string>"), ","))


@BOOK.add("""SELECT * FROM (SELECT 'orphan orders' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'negative balance', count(*) FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'discount range', count(*) FROM lineitem WHERE l_discount > 0.09) WHERE n > 0""")
def structure_failures(t: Tables) -> DataFrame:
    return facets.structure_failures({
        "orphan orders": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "negative balance": t.customer.where("c_acctbal < 0"),
        "line without order": t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "discount range": t.lineitem.where("l_discount > 0.09"),
    })


@BOOK.add("""SELECT p_partkey, CASE WHEN p_size < 1 THEN '< 1 nm/px' WHEN p_size < 4 THEN '1 – 4 nm/px' WHEN p_size < 8 THEN '4 – 8 nm/px' WHEN p_size < 32 THEN '8 – 32 nm/px' ELSE '≥ 32 nm/px' END AS band,
  p_type = 'PROMO' OR p_size > 40 AS is_3d, CASE WHEN p_size > 40 THEN (p_partkey + 1) || '×' || p_size || '×' || (p_size - 39) ELSE (p_partkey + 1) || '×' || p_size END AS dims FROM part""")
def resolution_bands(t: Tables) -> DataFrame:
    tags = F.array(F.when(F.col("p_type") == "PROMO", " 3d ").otherwise("Mixed"))
    depth = F.col("p_size") - 39
    return t.part.select("p_partkey", rules.bands(F.col("p_size").cast("double"), catalog.RESOLUTION_BANDS, "Unknown").alias("band"), catalog.is_3d(tags, F.col("p_name"), depth).alias("is_3d"), tx.dimensions_text(F.col("p_partkey") + 1, F.col("p_size"), depth).alias("dims"))


@BOOK.add("SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 2")
def best_k(t: Tables) -> DataFrame:
    return best_per_group(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.desc("l_quantity"), F.asc("l_linenumber")], 2).select("l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@BOOK.add("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) AS heroes FROM r WHERE k <= 4 GROUP BY 1""")
def hero_k(t: Tables) -> DataFrame:
    d = best_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 4)
    return d.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))).alias("h")).select("o_custkey", F.array_join(F.transform("h", lambda x: x["o_orderkey"].cast("string")), ",").alias("heroes"))


@BOOK.add("SELECT o_custkey, count(*) AS matched FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 0 ORDER BY matched DESC, o_custkey LIMIT 50")
def dataset_ranking(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 100000).alias("matched")).where("matched > 0").orderBy(F.desc("matched"), "o_custkey").limit(50)


@BOOK.add("""WITH s AS (SELECT source, lang, source || lang AS k, count(*) AS n FROM documents GROUP BY ALL), f AS (SELECT 'all' AS facet, 'all' AS label, source, count(*) AS t FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, source, count(*) FROM documents GROUP BY lang, source)
SELECT facet, label, sum(t)::BIGINT AS tiles, count(*) AS sources, min(t) AS least, max(t) AS most, count(*) FILTER (WHERE t >= 30) AS at_cap FROM f GROUP BY 1, 2""")
def composition(t: Tables) -> DataFrame:
    return tiles.composition(t.documents, "source", 30, ["lang"])


@BOOK.add("WITH d AS (SELECT p_brand AS label, row_number() OVER (ORDER BY count(*) DESC, lower(p_brand), p_brand) AS i FROM part GROUP BY 1) SELECT string_agg(label, ',' ORDER BY i) AS labels, sha256(string_agg(label, chr(10) ORDER BY i)) AS digest FROM d")
def vocabulary_spec(t: Tables) -> DataFrame:
    return facets.vocabulary_spec(t.part, "p_brand").withColumn("labels", F.array_join("labels", ","))


@BOOK.add("SELECT DISTINCT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 48 EXCEPT SELECT 'Brand#2'")
def unauthorised_values(t: Tables) -> DataFrame:
    return facets.unauthorised(t.part.select("p_brand"), t.part.where("p_size > 48").select("p_brand"), t.spark.createDataFrame([("Brand#2",)], "p_brand string"))


@BOOK.add("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def shared_sources(t: Tables) -> DataFrame:
    pick = lambda s: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return pick("O").intersect(pick("F"))


QUERIES, ORACLES = BOOK.queries, BOOK.oracles
