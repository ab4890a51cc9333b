"""Tokens against the four rules applied one after another, and signals that share a frequent token."""

import random

from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import signals


def test_run_tokens(spark):
    r = random.Random(2)
    runs = ["".join(r.choice("abÖSßT1٢ǅ") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    parts = T.run_parts(F.col("run"))
    plain = F.transform(F.when(F.size(parts) > 1, F.concat(F.array("run"), parts)).otherwise(F.array("run")), F.lower)
    rows = spark.createDataFrame([(x,) for x in runs], "run string").select("run", T.run_tokens(F.col("run")).alias("got"), plain.alias("want")).collect()
    assert all(x["got"] == x["want"] for x in rows)


def test_files_meet_values_by_the_rarest_token(spark):
    """No stage may pair every file with every query for a token that all of them have."""
    n = 600
    files = spark.createDataFrame([(i, f"src/en/{i}.txt", "part go the src" if i % 2 else "x") for i in range(n)], "doc_id long, path string, text string")
    queries = spark.createDataFrame([(q, f"open src/en/{q}.txt and src/part_{q}.go") for q in range(n)], "query_id long, text string")
    found = signals.exact_search(files, signals.signals(queries))
    assert sorted(map(tuple, found.select("query_id", "doc_id", "score").collect())) == [(i, i, 76.0) for i in range(n)]

    def joined(node):  # rows out of all joins of the executed plan
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return joined(node.executedPlan())
        if "QueryStage" in name:
            return joined(node.plan())
        metrics = node.metrics()
        own = metrics.apply("numOutputRows").value() if "Join" in name and metrics.contains("numOutputRows") else 0
        return own + sum(joined(node.children().apply(i)) for i in range(node.children().size()))

    done = found
    done.collect()
    assert joined(done._jdf.queryExecution().executedPlan()) < n * n / 4
