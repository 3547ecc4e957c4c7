"""Queries over names, catalogs and sets: search, joins, ranking, consensus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import search
from ..sources import catalog
from .carriers import read
from .registry import query


@query("F2_masked_find", "SELECT p_partkey, list_filter(range(0, length(p_name) - 2), lambda i: p_name[i + 1] = p_name[1] AND substr(p_name, i + 3, 1) = 'r') AS places FROM (SELECT p_partkey, 'p' || p_name AS p_name FROM part)")
def f2(spark, d):
    data = F.concat(F.lit("p"), F.col("p_name")).cast("binary")
    return read(spark, d, "part").select("p_partkey", F.transform(search.find_masked(data, "70 ?? 72"), lambda x: x.cast("long")).alias("places"))


@query("F4_wildcard_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_type) LIKE '%steel%' OR lower(p_brand) LIKE 'brand#_2'")
def f4(spark, d):
    return read(spark, d, "part").where(search.wildcard(F.col("p_type"), "STEEL") | search.wildcard(F.col("p_brand"), "brand#?2")).select("p_partkey", "p_name")


@query("F5_scored_search", "SELECT * FROM (SELECT p_partkey, CASE WHEN lower(p_name) = 'part 1' THEN 100 WHEN starts_with(lower(p_name), 'part') THEN 70 WHEN contains(lower(p_name), 'part') THEN 50 ELSE 0 END + CASE WHEN contains(lower(p_type), 'part') THEN 30 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'part') THEN 20 ELSE 0 END AS score FROM part) ORDER BY score DESC, p_partkey LIMIT 100")
def f5(spark, d):
    score = search.match_score(F.col("p_name"), F.col("p_type"), F.col("p_brand"), "part")
    return read(spark, d, "part").select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(100)


@query("F6_fuzzy_rank", "WITH r AS (SELECT p_partkey, lower(p_type) AS s FROM part), k AS (SELECT p_partkey, CASE WHEN s = 'st' THEN 1000 WHEN starts_with(s, 'st') THEN 800 WHEN regexp_matches(s, '\\bst') THEN 600 WHEN contains(s, 'st') THEN 400 WHEN regexp_matches(s, 's.*t') THEN 100 END AS a, CASE WHEN s = 'e' THEN 1000 WHEN starts_with(s, 'e') THEN 800 WHEN regexp_matches(s, '\\be') THEN 600 WHEN contains(s, 'e') THEN 400 END AS b FROM r) SELECT p_partkey, least(a, b) AS rank FROM k WHERE a IS NOT NULL AND b IS NOT NULL")
def f6(spark, d):
    return read(spark, d, "part").select("p_partkey", search.fuzzy_rank(F.col("p_type"), "st e").alias("rank")).where("rank is not null")


@query("F8_find_map", "SELECT p_name, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY p_name")
def f8(spark, d):
    return read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))


@query("F9_unique_resolve", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_size) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolved FROM part")
def f9(spark, d):
    n = F.count("*").over(Window.partitionBy("p_brand", "p_size"))
    return read(spark, d, "part").select("p_partkey", F.when(n == 1, "unique").otherwise("ambiguous").alias("resolved"))


TREE = "tree AS (SELECT c_custkey, r_name || '/' || n_name || '/' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def tree(spark, d):
    named = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = read(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"))


WANTED = ["BUILDING", "AMERICA/NATION_1/BUILDING", "europe/nation_3/machinery", "Nowhere", "AMERICA/NATION_1/building"]


@query("F10_folder_resolve", f"""WITH {TREE}, folders AS (SELECT DISTINCT path FROM tree), w AS (SELECT unnest({WANTED}) AS wanted),
    hits AS (SELECT wanted, path, lower(path) = lower(wanted) AS whole FROM w JOIN folders ON lower(path) = lower(wanted) OR lower(split_part(path, '/', -1)) = lower(wanted)),
    n AS (SELECT wanted, count(*) FILTER (whole) AS full, count(*) AS every, min(path) FILTER (whole) AS exact, min(path) AS any FROM hits GROUP BY wanted)
    SELECT wanted, CASE WHEN n.full = 1 THEN exact WHEN every = 1 THEN n.any END AS path, CASE WHEN n.wanted IS NULL THEN 'missing' WHEN n.full = 1 OR every = 1 THEN 'found' ELSE 'ambiguous' END AS status FROM w LEFT JOIN n USING (wanted)""")
def f10(spark, d):
    return search.resolve_folder(tree(spark, d).select("path").distinct(), spark.createDataFrame([(w,) for w in WANTED], "wanted string"))


@query("F21_tree_filter", f"""WITH {TREE}, t AS (SELECT path, max(c_custkey) AS last, bool_or(c_custkey % 4 = 0) AS changed, bool_or(c_custkey % 9 = 0) AS starred FROM tree GROUP BY path),
    hits AS (SELECT path FROM t WHERE (contains(lower(path), 'tion1') OR contains(regexp_replace(lower(path), '[ /_.-]', '', 'g'), 'tion1')) AND changed AND starred AND last >= 100)
    SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path, max(CAST(k = 3 AS INTEGER)) = 1 AS hit FROM hits, range(1, 4) r(k) GROUP BY 1""")
def f21(spark, d):
    nodes = tree(spark, d).groupBy("path").agg(F.max("c_custkey").alias("last"), F.bool_or(F.col("c_custkey") % 4 == 0).alias("changed"), F.bool_or(F.col("c_custkey") % 9 == 0).alias("starred"))
    return search.tree_filter(nodes, "tion1", F.col("changed") & F.col("starred") & (F.col("last") >= 100))


@query("F11_purpose", "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%brass%' THEN 'fuel' WHEN lower(p_type) LIKE 'small%' THEN 'air' WHEN lower(p_type) LIKE '%steel' THEN 'spark' ELSE 'unknown' END AS purpose FROM part")
def f11(spark, d):
    rules = [("*brass*", "fuel"), ("small*", "air"), ("*steel", "spark")]
    return read(spark, d, "part").select("p_partkey", search.first_rule(F.col("p_type"), rules, "unknown").alias("purpose"))


@query("F12_unit_bounds", "SELECT p_partkey, p_retailprice FROM part WHERE (contains(lower(p_type), 'steel') AND NOT p_retailprice BETWEEN 950 AND 1500) OR (contains(lower(p_type), 'copper') AND NOT p_retailprice BETWEEN 900 AND 1800)")
def f12(spark, d):
    bounds = F.broadcast(spark.createDataFrame([("steel", 950.0, 1500.0), ("copper", 900.0, 1800.0)], "unit string, low double, high double"))
    found = read(spark, d, "part").join(bounds, F.contains(F.lower("p_type"), F.col("unit")) & ~F.col("p_retailprice").between(F.col("low"), F.col("high")))
    return found.select("p_partkey", "p_retailprice").distinct()


@query("F13_family_detection", r"SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'PLATED STEEL([^0-9A-Za-z]|$)') THEN 'plated' WHEN regexp_matches(p_type, 'STEEL([^0-9A-Za-z]|$)') THEN 'steel' WHEN regexp_matches(p_type, 'COPPER([^0-9A-Za-z]|$)') THEN 'copper' WHEN p_size > 25 THEN 'large' ELSE 'small' END AS family, regexp_matches(p_type, '(PLATED STEEL|STEEL)([^0-9A-Za-z]|$)') AS sure FROM part")
def f13(spark, d):
    patterns = [("COPPER", "copper", 60), ("STEEL", "steel", 80), ("PLATED STEEL", "plated", 95), ("STEE", "never", 99)]
    found = search.family(F.col("p_type"), patterns, F.when(F.col("p_size") > 25, "large").otherwise("small"))
    return read(spark, d, "part").select("p_partkey", found["family"].alias("family"), found["sure"].alias("sure"))


@query("F16_dictionary_search", "SELECT DISTINCT p_brand, p_type FROM part WHERE contains(lower(p_brand || ' ' || p_type), '1') ORDER BY p_brand, p_type LIMIT 50")
def f16(spark, d):
    return read(spark, d, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_brand", "p_type")), F.lit("1"))).select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type").limit(50)


@query("F17_code_filter", "WITH syn(prefix, text) AS (VALUES ('Brand#1', 'intake'), ('Brand#2', 'exhaust')) SELECT p_partkey, text FROM part JOIN syn ON starts_with(p_brand, prefix) WHERE contains(text || p_name, 'ex')")
def f17(spark, d):
    synonyms = F.broadcast(spark.createDataFrame([("Brand#1", "intake"), ("Brand#2", "exhaust")], "prefix string, text string"))
    return read(spark, d, "part").join(synonyms, F.startswith("p_brand", "prefix")).where(F.contains(F.concat("text", "p_name"), F.lit("ex"))).select("p_partkey", "text")


@query("F20_any_column", "SELECT count(*) FILTER (contains(lower(concat_ws(' ', s_name, CAST(s_nationkey AS VARCHAR))), '1')) AS shown, count(*) AS total FROM supplier")
def f20(spark, d):
    return read(spark, d, "supplier").agg(F.count_if(F.contains(F.lower(F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string"))), F.lit("1"))).alias("shown"), F.count("*").alias("total"))


@query("J4_enrichment", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def j4(spark, d):
    parts = read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_brand")


@query("J10_inverted_index", "WITH needle AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1) SELECT l_suppkey, count(DISTINCT l_partkey) AS shared FROM lineitem JOIN needle USING (l_partkey) WHERE l_suppkey <> 1 GROUP BY l_suppkey ORDER BY shared DESC, l_suppkey LIMIT 6000")
def j10(spark, d):
    return search.best_by_shared(read(spark, d, "lineitem", "l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", F.col("l_suppkey") == 1)


@query("J11_key_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (7, 11, 13)")
def j11(spark, d):
    return read(spark, d, "orders").where(F.col("o_custkey").isin(7, 11, 13)).select("o_orderkey", "o_totalprice")


@query("J13_unknown_files", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13(spark, d):
    return read(spark, d, "customer", "c_custkey").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("J14_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j14(spark, d):
    known = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(known, "l_orderkey", "left_anti")


SETS = "sets AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS item FROM lineitem), size AS (SELECT k, count(*) AS n FROM sets GROUP BY k), shared AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM sets a JOIN sets b ON a.item = b.item AND a.k < b.k GROUP BY 1, 2)"


@query("J16_set_overlap", f"WITH {SETS} SELECT a, b, round(m / (x.n + y.n - m), 6) AS jaccard FROM shared JOIN size x ON x.k = a JOIN size y ON y.k = b WHERE m / (x.n + y.n - m) >= 0.16")
def j16(spark, d):
    sets = read(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item"))
    return search.overlap_pairs(sets, "k", "item", 0.16).withColumn("jaccard", F.round("jaccard", 6))


@query("J17_group_members", "SELECT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def j17(spark, d):
    groups = read(spark, d, "nation").where("n_regionkey = 2")
    return groups.join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey")


@query("J18_related", "SELECT * FROM (SELECT b.p_partkey, concat_ws('; ', CASE WHEN b.p_brand = a.p_brand THEN 'brand' END, CASE WHEN b.p_type = a.p_type THEN 'type' END, CASE WHEN b.p_size = a.p_size THEN 'size' END, CASE WHEN split_part(b.p_name, ' ', 1) = split_part(a.p_name, ' ', 1) THEN 'name' END, CASE WHEN abs(b.p_retailprice - a.p_retailprice) <= 5 THEN 'price' END) AS reason FROM part a JOIN part b ON a.p_partkey = 10 AND b.p_partkey <> 10) WHERE reason <> '' ORDER BY length(reason) DESC, p_partkey LIMIT 30")
def j18(spark, d):
    parts = read(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_name", "p_retailprice")
    one = F.broadcast(parts.where("p_partkey = 10").toDF("k", "brand", "type", "size", "name", "price"))  # one key
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    tests = {"brand": F.col("p_brand") == F.col("brand"), "type": F.col("p_type") == F.col("type"), "size": F.col("p_size") == F.col("size"), "name": word("p_name") == word("name"), "price": F.abs(F.col("p_retailprice") - F.col("price")) <= 5}
    found = parts.join(one, F.col("p_partkey") != F.col("k")).select("p_partkey", F.concat_ws("; ", *(F.when(t, F.lit(n)) for n, t in tests.items())).alias("reason"))
    return found.where("reason <> ''").orderBy(F.desc(F.length("reason")), "p_partkey").limit(30)


@query("J19_coalesced_rows", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (o_orderstatus = 'O') AS open, max(o_totalprice) FILTER (o_orderstatus = 'P') AS part FROM orders GROUP BY o_custkey")
def j19(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(*(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(n) for s, n in (("F", "done"), ("O", "open"), ("P", "part"))))


@query("J20_alias_join", "WITH alias(name, family, priority) AS (VALUES ('click', 'input', 2), ('click', 'pointer', 1), ('view', 'display', 1)) SELECT event_id, (SELECT arg_min(family, priority) FROM alias WHERE name = event_type) AS family FROM events")
def j20(spark, d):
    aliases = spark.createDataFrame([("click", "input", 2), ("click", "pointer", 1), ("view", "display", 1)], "event_type string, family string, priority int")
    best = F.broadcast(aliases.groupBy("event_type").agg(F.min_by("family", "priority").alias("family")))
    return read(spark, d, "events", "event_id", "event_type").join(best, "event_type", "left").select("event_id", "family")


@query("A17_dominant_base", "WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY l_orderkey) AS share FROM v) SELECT l_orderkey, l_returnflag, round(share, 6) AS share FROM t WHERE share >= 0.9")
def a17(spark, d):
    return search.dominant(read(spark, d, "lineitem", "l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag").withColumn("share", F.round("share", 6))


@query("A18_digests", "SELECT p_partkey, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, CAST(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ord(p_name[i]))) % 65536 AS BIGINT) AS total FROM part")
def a18(spark, d):
    b = F.col("p_name").cast("binary")
    return read(spark, d, "part").select("p_partkey", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"), codec.byte_sum(b).alias("total"))


@query("A20_dictionary_values", "SELECT DISTINCT p_type FROM part ORDER BY p_type")
def a20(spark, d):
    return read(spark, d, "part", "p_type").distinct().orderBy(F.lower("p_type"), "p_type")


@query("A21_cluster_consensus", "SELECT l_partkey, count(DISTINCT l_suppkey) AS members, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 20")
def a21(spark, d):
    return read(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("members"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")).where("members >= 20")


@query("A22_keyword_label", "WITH w AS (SELECT p_brand, unnest(string_split(lower(p_type), ' ')) AS word FROM part), c AS (SELECT p_brand, word, count(*) AS n FROM w GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, word) AS k FROM c) SELECT p_brand, word AS label, n FROM k WHERE k = 1")
def a22(spark, d):
    words = read(spark, d, "part").select("p_brand", F.explode(F.split(F.lower("p_type"), " ")).alias("word")).groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    return search.first_of(words, ["p_brand"], [F.desc("n"), "word"]).select("p_brand", F.col("word").alias("label"), "n")


@query("A24_precision_recall", "WITH found AS (SELECT p_partkey FROM part WHERE p_size < 20), expected AS (SELECT p_partkey FROM part WHERE p_retailprice < 1200) SELECT round(count(e.p_partkey) / (SELECT count(*) FROM found), 6) AS \"precision\", round(count(e.p_partkey) / (SELECT count(*) FROM expected), 6) AS recall FROM found f LEFT JOIN expected e ON f.p_partkey = e.p_partkey")
def a24(spark, d):
    marked = read(spark, d, "part").select((F.col("p_size") < 20).alias("found"), (F.col("p_retailprice") < 1200).alias("expected"))
    both = F.count_if(F.col("found") & F.col("expected"))
    return marked.agg(F.round(both / F.count_if("found"), 6).alias("precision"), F.round(both / F.count_if("expected"), 6).alias("recall"))


@query("O1_best_versions", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_totalprice >= 1000) SELECT o_custkey, o_orderkey, o_totalprice FROM k WHERE k = 1 ORDER BY o_totalprice DESC, o_custkey LIMIT 50")
def o1(spark, d):
    best = search.first_of(read(spark, d, "orders").where("o_totalprice >= 1000"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
    return best.select("o_custkey", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_custkey").limit(50)


@query("O7_code_order", "SELECT p_partkey, nullif(p_size % 5, 0) AS code FROM part ORDER BY code IS NULL, code, p_partkey LIMIT 200")
def o7(spark, d):
    code = F.nullif(F.col("p_size") % 5, F.lit(0))
    return read(spark, d, "part").select("p_partkey", code.alias("code")).orderBy(F.col("code").isNull(), "code", "p_partkey").limit(200)


@query("O8_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100 LIMIT 50")
def o8(spark, d):
    return read(spark, d, "orders", "o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@query("O11_recent_entries", "SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS k, o_orderdate AS t FROM orders UNION ALL SELECT 'ship', l_orderkey, l_shipdate FROM lineitem) ORDER BY t DESC, kind, k LIMIT 40")
def o11(spark, d):
    a = read(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))
    b = read(spark, d, "lineitem").select(F.lit("ship"), "l_orderkey", "l_shipdate")
    return a.unionAll(b).orderBy(F.desc("t"), "kind", "k").limit(40)


@query("O13_recent_projects", "SELECT c_custkey, max(o_orderdate) AS changed FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY changed DESC, c_custkey LIMIT 12")
def o13(spark, d):
    return read(spark, d, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("changed")).orderBy(F.desc("changed"), "c_custkey").limit(12)


@query("U1_address_union", "SELECT l_partkey AS address FROM lineitem WHERE l_suppkey = 1 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 2")
def u1(spark, d):
    lines = read(spark, d, "lineitem", "l_partkey", "l_suppkey")
    return lines.where("l_suppkey = 1").select(F.col("l_partkey").alias("address")).union(lines.where("l_suppkey = 2").select("l_partkey")).distinct()


@query("U2_intersection", "SELECT count(*) AS shared FROM (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)")
def u2(spark, d):
    lines = read(spark, d, "lineitem", "l_partkey", "l_suppkey")
    return lines.where("l_suppkey = 1").select("l_partkey").intersect(lines.where("l_suppkey = 2").select("l_partkey")).agg(F.count("*").alias("shared"))


@query("U3_first_of_duplicates", "SELECT min(p_partkey) AS p_partkey, p_brand, p_size FROM part GROUP BY p_brand, p_size")
def u3(spark, d):
    return search.first_of(read(spark, d, "part"), ["p_brand", "p_size"], ["p_partkey"]).select("p_partkey", "p_brand", "p_size")


@query("U7_delete_maps", "SELECT p_partkey FROM part WHERE NOT (p_partkey IN (1, 2, 3) OR lower(p_type) LIKE '%brass%' OR p_brand = 'Brand#11')")
def u7(spark, d):
    gone = F.col("p_partkey").isin(1, 2, 3) | search.wildcard(F.col("p_type"), "*brass*") | (F.col("p_brand") == "Brand#11")
    return read(spark, d, "part").where(~gone).select("p_partkey")


@query("M2_sketch_similarity")
def m2(spark, d):
    items = read(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item")).distinct()
    sizes = items.groupBy("k").agg(F.count("*").alias("size"))
    return search.sketch_similarity(search.sketch(items, "k", "item"), sizes, "k")


@query("M13_consensus", "WITH g AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sigma FROM lineitem GROUP BY l_partkey), s AS (SELECT *, n / 30 AS cover, sigma / mean AS spread FROM g) SELECT l_partkey, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, CASE WHEN n <= 1 THEN 'Heretic' WHEN cover >= 0.95 AND spread <= 0.02 THEN 'Unanimous' WHEN cover >= 0.5 AND spread <= 0.2 THEN 'StrongConsensus' ELSE 'Majority' END AS tag, round(least(1.0, cover) * greatest(0.0, 1 - spread), 6) AS strength FROM s")
def m13(spark, d):
    found = search.consensus(read(spark, d, "lineitem", "l_partkey", "l_quantity"), "l_partkey", "l_quantity", 30)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "sigma", "strength")})


CATALOG = {"id": ["entry", "S_SUPPKEY"], "label": ["s_name", "title"], "place": ["town", "city"], "worth": ["s_acctbal"]}


@query("S13_catalog_projection", "SELECT s_suppkey AS id, s_name AS label, CAST(NULL AS VARCHAR) AS place, s_acctbal AS worth FROM supplier WHERE s_suppkey BETWEEN 5 AND 60")
def s13(spark, d):
    supplier = read(spark, d, "supplier")
    if not catalog.is_catalog(supplier, CATALOG, ("id", "label")):
        raise ValueError("not a catalog")
    return catalog.project(supplier, CATALOG, 5, 60, "id")


@query("S13_catalog_point", "SELECT s_suppkey AS id, s_name AS label, CAST(NULL AS VARCHAR) AS place, s_acctbal AS worth FROM supplier WHERE s_suppkey = 17")
def s13_point(spark, d):
    return catalog.project(read(spark, d, "supplier"), CATALOG, 17, 17, "id")


@query(
    "S14_incremental_sync",
    """WITH l AS (SELECT c_custkey AS source, c_custkey % 3 = 0 AS same, c_custkey % 5 <> 0 AS readable, c_custkey % 7 <> 0 AS listed FROM customer),
    e AS (SELECT o_custkey AS source, o_orderkey AS entry, o_orderstatus = 'F' AS old FROM orders)
    SELECT e.source, entry, old FROM e LEFT JOIN l USING (source) WHERE old = NOT coalesce(listed AND readable AND NOT same, false)""",
)
def s14(spark, d):
    key = F.col("c_custkey")
    sources = read(spark, d, "customer", "c_custkey").select(key.alias("source"), (key * 10).alias("mtime"), F.lit(7).cast("long").alias("size"))
    listed = sources.where(F.col("source") % 7 != 0).select("source", F.when(F.col("source") % 3 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"), "size", (F.col("source") % 5 != 0).alias("readable"))
    orders = read(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("entry"), (F.col("o_orderstatus") == "F").alias("old"))
    return catalog.synchronised(orders.where("old"), sources, listed, orders.where("not old"))


@query("O10_verdict_order", "SELECT l_partkey, round(avg(CAST(l_returnflag = 'R' AS DOUBLE)), 6) AS strength, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY avg(CAST(l_returnflag = 'R' AS DOUBLE)) DESC, n DESC, l_partkey LIMIT 100")
def o10(spark, d):
    verdicts = read(spark, d, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("strength"), F.count("*").alias("n"))
    return verdicts.orderBy(F.desc("strength"), F.desc("n"), "l_partkey").limit(100).withColumn("strength", F.round("strength", 6))


@query("O12_shown_and_total", "WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05), t AS (SELECT count(*) AS total FROM d) SELECT l_orderkey, l_linenumber, total FROM d, t ORDER BY l_orderkey, l_linenumber LIMIT 500")
def o12(spark, d):
    found = read(spark, d, "lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber")
    total = found.agg(F.count("*").alias("total")).scalar()
    return found.orderBy("l_orderkey", "l_linenumber").limit(500).select("l_orderkey", "l_linenumber", total.alias("total"))


@query("U4_first_by_address", "SELECT p_size, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_size")
def u4(spark, d):
    return read(spark, d, "part").groupBy("p_size").agg(F.min_by("p_name", "p_partkey").alias("p_name"))


@query("U5_exclude_self", "SELECT s_suppkey FROM supplier WHERE s_suppkey <> 7")
def u5(spark, d):
    return read(spark, d, "supplier", "s_suppkey").where("s_suppkey <> 7")


@query("J15_near_pairs", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON b.o_orderkey > a.o_orderkey AND b.o_orderkey <= a.o_orderkey + 8 AND a.o_orderpriority = b.o_orderpriority")
def j15(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_orderpriority")
    width = 8  # a pair within the width lies in one bucket or in two that follow each other
    left = o.select(F.col("o_orderkey").alias("a"), F.col("o_orderpriority").alias("p"), F.explode(F.array(F.floor(F.col("o_orderkey") / width), F.floor(F.col("o_orderkey") / width) + 1)).alias("k"))
    right = o.select(F.col("o_orderkey").alias("b"), F.col("o_orderpriority").alias("p"), F.floor(F.col("o_orderkey") / width).alias("k"))
    return left.join(right, ["k", "p"]).where((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + width)).select("a", "b")


@query("F3_masked_replace", "SELECT p_partkey, replace(p_name, 'ar', 'AR') AS replaced FROM part")
def f3(spark, d):
    from ..operators.greedy import replace_masked

    new = replace_masked(F.col("p_name").cast("binary"), "61 72", "41 52")
    return read(spark, d, "part").select("p_partkey", new.cast("string").alias("replaced"))


@query("O4_overlap_suppression")
def o4(spark, d):
    from ..operators.greedy import suppress_overlaps

    spans = read(spark, d, "part").select("p_brand", (F.col("p_partkey") % 500).alias("begin"), (F.col("p_partkey") % 500 + F.col("p_size")).alias("end"), F.col("p_retailprice").alias("score"))
    return suppress_overlaps(spans, "p_brand")


@query("M11_seed_clusters")
def m11(spark, d):
    from ..operators.greedy import seed_clusters

    sets = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_set(F.col("c_custkey") % 5)).alias("items"))
    return seed_clusters(sets, "c_nationkey", "c_mktsegment", "items")
