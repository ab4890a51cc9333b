"""Queries that go through stores: fact files, compacted graphs, consumers of snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnwork.plans import views as V
from cairnwork.plans.base import query
from cairnwork.plans.storage import shared_folder
from cairnwork.sources import fact_files, files, graph_store, ignore, reports
from cairnwork.streaming import consumers

GRAPH = f"WITH RECURSIVE {V.EDGES_SQL}, {V.NODES_SQL}"


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("sk_05_fact_files", GRAPH + """, u AS (SELECT 'o:' || o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'references' ELSE 'calls' END AS kind, o_orderpriority AS expression FROM orders)
SELECT 'N' AS record, key, NULL AS target, kind, path, name, qualified_name, NULL AS expression FROM nodes UNION ALL SELECT DISTINCT 'E', src, dst, relation, NULL, NULL, NULL, NULL FROM edges
UNION ALL SELECT 'U', key, NULL, kind, NULL, NULL, NULL, expression FROM u""")
def sk_05(spark, d):
    """Nodes, edges and gaps written as fact files, in two commits, and read back."""
    path = folder(spark, "facts")
    nodes = V.nodes(spark, d).withColumn("record", F.lit("N"))
    edges = V.edges(spark, d).distinct().select(F.lit("E").alias("record"), F.col("src").alias("key"), F.col("dst").alias("target"), F.col("relation").alias("kind"))
    gaps = V.unresolved(spark, d).select(F.lit("U").alias("record"), F.col("source").alias("key"), F.col("relation").alias("kind"), "expression", "reason")
    fact_files.write_facts(nodes, path)
    fact_files.write_facts(edges.unionByName(gaps, allowMissingColumns=True), path)
    return fact_files.read_facts(spark, path, 1 << 20).select("record", "key", "target", "kind", "path", "name", "qualified_name", "expression")


@query("gr_25_compacted", GRAPH + """, e AS (SELECT DISTINCT src, dst, relation FROM edges), gone AS (SELECT * FROM e WHERE src LIKE 'o:%7' AND relation = 'calls'),
back AS (SELECT * FROM gone WHERE dst LIKE '%3'), new AS (SELECT 'c:' || c_custkey AS src, 'c:' || (c_custkey + 1) AS dst, 'possible-calls' AS relation FROM customer WHERE c_custkey % 10 = 0)
SELECT * FROM e WHERE (src, dst, relation) NOT IN (SELECT (src, dst, relation) FROM gone) UNION ALL SELECT * FROM back UNION ALL SELECT * FROM new""")
def gr_25_compacted(spark, d):
    """A base, a delta that removes edges, one that brings some back and adds others; compacted, then read."""
    root = folder(spark, "graph")
    edges = V.edges(spark, d)
    graph_store.create(edges, root)
    gone = edges.distinct().filter("src LIKE 'o:%7' AND relation = 'calls'")
    graph_store.append(gone.withColumn("added", F.lit(False)), root)
    c = F.col("c_custkey")
    new = V.table(spark, d, "customer").filter(c % 10 == 0).select(F.concat(F.lit("c:"), c.cast("string")).alias("src"), F.concat(F.lit("c:"), (c + 1).cast("string")).alias("dst"), F.lit("possible-calls").alias("relation"))
    graph_store.append(gone.filter("dst LIKE '%3'").unionByName(new).withColumn("added", F.lit(True)), root)
    graph_store.compact(spark, root)
    return graph_store.edges(spark, root)


@query("st_05_consumers", """WITH v AS (SELECT event_type, user_id, user_id % 3 + 1 AS number FROM events)
SELECT 'kinds' AS consumer, n.number, v.event_type AS label, count(*) AS n FROM v JOIN (VALUES (1), (2), (3)) n(number) ON v.number <= n.number GROUP BY ALL
UNION ALL SELECT 'users', n.number, 'users', count(DISTINCT user_id) FROM v JOIN (VALUES (1), (2), (3)) n(number) ON v.number <= n.number GROUP BY n.number""")
def st_05(spark, d):
    """Three versions of the events, each handed to two consumers; a second watch and a replay find nothing to do."""
    root, out, state = (folder(spark, name) for name in ("versions", "consumed", "progress"))
    events = V.table(spark, d, "events").select("event_type", "user_id")

    def kinds(version, number):
        rows = version.groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        rows.select(F.lit("kinds").alias("consumer"), F.lit(number).alias("number"), "label", "n").write.mode("append").parquet(out)

    def users(version, number):
        rows = version.agg(F.countDistinct("user_id").alias("n"))
        rows.select(F.lit("users").alias("consumer"), F.lit(number).alias("number"), F.lit("users").alias("label"), "n").write.mode("append").parquet(out)

    both, checkpoint = {"kinds": kinds, "users": users}, folder(spark, "watched")
    for number in (1, 2, 3):
        files.publish(events.filter(F.col("user_id") % 3 + 1 <= number), root, number - 1)
        if number != 2:
            consumers.watch(spark, root, state, both, checkpoint)
    consumers.hand_out(spark, root, state, both, [1, 2, 3])
    return spark.read.parquet(out)


SUMMARY_SQL = "SELECT c_mktsegment AS segment, count(*) AS orders, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"


@query("sk_07_report", f"""WITH s AS ({SUMMARY_SQL})
SELECT 'csv' AS form, segment, orders, total, NULL AS line FROM s UNION ALL SELECT 'json', segment, orders, total, NULL FROM s
UNION ALL SELECT 'markdown', NULL, NULL, NULL, '| ' || segment || ' | ' || orders || ' | ' || total || ' |' FROM s
UNION ALL SELECT 'markdown', NULL, NULL, NULL, unnest(['# Orders by segment', '', '| segment | orders | total |', '|-|-|-|'])""")
def sk_07(spark, d):
    """A summary written in all three forms and read back."""
    joined = V.table(spark, d, "customer").join(V.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    rows = joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice")).cast("long").alias("total"))
    path = folder(spark, "report")
    reports.report(rows, ["segment"], "Orders by segment", path)
    schema = "segment string, orders long, total long"
    forms = [spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("form", F.lit("csv")), spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json"))]
    lines = spark.read.text(f"{path}/markdown").select(F.lit("markdown").alias("form"), F.col("value").alias("line"))
    return forms[0].unionByName(forms[1]).unionByName(lines, allowMissingColumns=True)


@query("sk_02_saved", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def sk_02(spark, d):
    """Orders saved twice as canonical lines; the current save is read."""
    root, rows = folder(spark, "saved"), V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    reports.save(rows.limit(0), ["o_orderkey"], root)
    reports.save(rows, ["o_orderkey"], root)
    return reports.saved(spark, root).select(F.from_json("line", rows.schema).alias("r")).select("r.*")


@query("sc_02_ignored", """SELECT doc_id, source = 'src1' AND lang = 'fr' OR lang = 'de' OR CAST(doc_id AS VARCHAR) LIKE '%7' AND CAST(doc_id AS VARCHAR) NOT LIKE '%17' AS ignored
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def sc_02(spark, d):
    """Paths of documents under the rules of one control file at the root and one in each source's folder."""
    docs = V.table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    root = spark.range(1).select(F.lit(".gitignore").alias("path"), F.lit("# numbers\n*7.txt\n!*17.txt\n/src1/fr/\n").alias("text"))
    inner = docs.select(F.concat("source", F.lit("/.gitignore")).alias("path"), F.lit("de/\n").alias("text")).distinct()
    found = ignore.rules(root.unionByName(inner))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", ignore.ignored(path, found).alias("ignored"))


@query("sc_15_versions", "SELECT 1 AS number, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, o_orderkey, o_orderstatus FROM orders")
def sc_15(spark, d):
    """Two versions of the orders behind one pointer: the first by its number, the second as the current one."""
    root, rows = folder(spark, "versions"), V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    files.publish(rows.filter("o_orderkey % 2 = 0"), root, 0)
    files.publish(rows, root, 1)
    both = files.current(spark, root, 1).withColumn("number", F.lit(1)).unionByName(files.current(spark, root).withColumn("number", F.lit(files.pointer(spark, root))))
    return both.select("number", "o_orderkey", "o_orderstatus")


@query("sk_01_sharded", "SELECT doc_id, n_chars FROM documents")
def sk_01(spark, d):
    """Documents in shards; then all of them changed, and the shards written anew in two halves, each leaving the other alone."""
    root, rows = folder(spark, "shards"), V.table(spark, d, "documents").select("doc_id", "n_chars")
    files.publish_shards(rows.withColumn("n_chars", F.col("n_chars") + 1), "doc_id", root, 8)
    files.publish_shards(rows, "doc_id", root, 8, [0, 1, 2, 3])
    files.publish_shards(rows, "doc_id", root, 8, [4, 5, 6, 7])
    return spark.read.parquet(root).select("doc_id", "n_chars")


@query("sk_03_exported", GRAPH + " SELECT kind, key, name, path FROM nodes")
def sk_03(spark, d):
    """Nodes as JSON lines, a folder for each kind, read back."""
    path = folder(spark, "lines")
    files.export_lines(V.nodes(spark, d).select("kind", "key", "name", "path"), "kind", ["key"], path)
    return spark.read.schema("key string, name string, path string, kind string").json(path).select("kind", "key", "name", "path")
