"""Composite discovery: lanes of search, anchors, impact, grounding of answers, rendered neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.operators import ranking, retrieval, signals
from cairnwork.plans.storage import cut

#: How far candidates go beyond the limit, by breadth; how many results of a lane are shown in full.
MULTIPLIER = {"balanced": 8, "narrow": 4}
PREVIEWED = 2


def path_class(path: Column) -> Column:
    """What a path says it is: test, document, contract, else file."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    rule = F.when(p.contains("/test") | p.contains("_test.") | p.contains("/spec") | p.contains(".spec."), "test")
    rule = rule.when(p.endswith(".md") | p.contains("/docs/"), "document")
    return rule.when(p.contains("contract") | p.contains("schema") | p.contains("config") | p.contains("route"), "contract").otherwise("file")


def trace_test_path(path: Column) -> Column:
    p = F.lower(F.regexp_replace(F.trim(path), r"\\", "/"))
    return reduce(lambda a, b: a | b, [p.contains(x) for x in ("/test/", "/tests/", "_test.", "_tests.", "/spec/", "_spec.")])


def chunk_scores(chunks: DataFrame, content: DataFrame | None, queries: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of chunks (chunk_id, path, text): for each term of a query 8 if the file's name has it,
    else 4 if the path has it, 4 if the first line has it, and the content's BM25; 12 for the whole phrase of several terms.

    The content's BM25 is given as scores, content (query_id, chunk_id, score), or as gains (chunk_id, term, gain), which
    are summed with the others where they are; queries: (query_id, text), a stated set. The phrase is only looked for in
    chunks that have its longest inner word run. It counts as a term, with a space before it, which no token has; chunks
    of a query that have nothing but its phrase are none.
    """
    terms = queries.select("query_id", F.explode(retrieval.query_terms(F.col("text"))).alias("term"))
    asked = terms.select("term").distinct()
    base, path, lead = T.token_set(T.base_name(F.col("path"))), T.token_set(F.col("path")), T.token_set(F.substring_index("text", "\n", 1))
    fields = chunks.select("chunk_id", base.alias("base"), path.alias("whole"), lead.alias("lead")).select("chunk_id", "base", "whole", "lead", F.explode(F.array_distinct(F.concat("whole", "lead"))).alias("term"))
    gain = F.when(F.array_contains("base", F.col("term")), 8.0).when(F.array_contains("whole", F.col("term")), 4.0).otherwise(0.0) + F.when(F.array_contains("lead", F.col("term")), 4.0).otherwise(0.0)
    rows = fields.join(asked, "term", "left_semi").select("chunk_id", "term", gain.alias("gain"))
    if gains is not None:
        rows = rows.unionByName(gains)
    phrase = F.lower(F.trim("text"))
    phrases = queries.filter((F.size(retrieval.query_terms(F.col("text"))) > 1) & (F.octet_length(phrase) > 2)).select("query_id", F.concat(F.lit(" "), phrase).alias("term"))
    low = chunks.select(F.col("chunk_id").alias("doc_id"), F.lit(None).cast("string").alias("path"), F.lower("text").alias("text"))
    said = retrieval.containing(low, phrases.select(F.col("term").alias("signal_id"), F.expr("substring(term, 2)").alias("value"), F.lit(12.0).alias("weight")).distinct())
    rows = rows.unionByName(said.select(F.col("doc_id").alias("chunk_id"), F.col("signal_id").alias("term"), F.col("score").alias("gain")))
    is_phrase = F.col("term").startswith(" ")
    if content is not None:  # a score stands as the gain of a term that its query alone has
        own = F.concat(F.lit("="), F.col("query_id").cast("string")).alias("term")
        rows = rows.unionByName(content.select("chunk_id", own, F.col("score").alias("gain")))
        terms = terms.unionByName(queries.select("query_id", own))
    return retrieval.summed(rows, terms.unionByName(phrases), chunks.count(), "chunk_id", ~is_phrase)


def search(chunks: DataFrame, nodes: DataFrame, queries: DataFrame, limit: int = 10, breadth: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """(results, coverage) of queries (query_id, text), a stated set, over chunks (chunk_id, path, text) and nodes.

    Lanes: exact (signals), source (chunk scores, without what the exact lane shows), symbol (scores of nodes). Each
    lane has its own order; documents and documentation paths are left out; at most two of a path come before all
    others. Results: (query_id, lane, key, path, score, rank); coverage: (query_id, lane, available, returned,
    previewed, deferred, suppressed).
    """
    most = min(200, max(limit * MULTIPLIER[breadth], limit))
    source = chunks.filter(path_class(F.col("path")) != "document")
    found = signals.exact_search(source.select(F.col("chunk_id").alias("doc_id"), "path", "text"), signals.signals(queries), most).withColumnRenamed("doc_id", "key")
    # each lane is read several times below; cut to its most results a query it is small
    exact = cut(found.join(source.select(F.col("chunk_id").alias("key"), "path"), "key").withColumn("kind", F.lit("chunk")))
    terms = queries.select("query_id", F.explode(retrieval.query_terms(F.col("text"))).alias("term"))
    gains = retrieval.bm25_gains(source.select("chunk_id", "text"), source.count(), terms, "chunk_id")
    scored = chunk_scores(source, None, queries, gains).withColumn("score", F.round("score", 6))
    # paths, which settle ties, are only looked up for what no `most` results of its query are above
    near = scored.withColumn("place", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("place") <= most).drop("place")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "path", "chunk_id"))
    lexical = cut(near.join(source.select("chunk_id", "path"), "chunk_id").withColumn("rank", best).filter(F.col("rank") <= most).select("query_id", F.col("chunk_id").alias("key"), "path", "score", "rank", F.lit("chunk").alias("kind")))
    named = ranking.symbol_matches(nodes.filter(path_class(F.col("path")) != "document"), queries)
    once = F.row_number().over(W.partitionBy("query_id", F.lower("kind"), "low_qualified", "low_name", "low_path").orderBy(F.desc("score"), "key"))
    named = named.withColumn("n", once).filter("n = 1")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "path", "qualified_name", "key"))
    symbols = cut(named.withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", "key", "path", "score", "rank", "kind"))

    def shown(lane: DataFrame) -> DataFrame:
        kept = ranking.diverse(lane.select("query_id", "key", "path", "kind", "rank"), limit)
        return kept.join(lane.select("query_id", "key", "path", "score"), ["query_id", "key"])

    first = shown(exact.select("query_id", "key", "path", "score", "rank", "kind"))
    open_ = lexical.join(first.select("query_id", "key"), ["query_id", "key"], "left_anti")
    lanes = {"exact": (exact, first, exact), "source": (open_, shown(open_), lexical), "symbol": (symbols, shown(symbols), symbols)}
    results = reduce(DataFrame.unionByName, [kept.select("query_id", F.lit(name).alias("lane"), "key", "path", "score", "rank") for name, (_, kept, _) in lanes.items()])
    count = lambda df, n: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(n))
    rows = []
    for name, (available, kept, whole) in lanes.items():
        row = queries.select("query_id").join(count(available, "available"), "query_id", "left").join(count(kept, "returned"), "query_id", "left").join(count(whole, "whole"), "query_id", "left").fillna(0)
        rows.append(row.select("query_id", F.lit(name).alias("lane"), "available", "returned", F.least("returned", F.lit(PREVIEWED)).cast("long").alias("previewed"), (F.col("available") - F.col("returned")).alias("deferred"), (F.col("whole") - F.col("available")).alias("suppressed")))
    return results, reduce(DataFrame.unionByName, rows)


#: What relations are worth in a trace, words of change and of behaviour.
RELATION_SCORES = {
    120: "calls-endpoint handled-by publishes consumes", 105: "calls invokes dispatches routes-to sends receives", 95: "creates deletes removes updates mutates writes reads",
    80: "overrides implements extends", 55: "references reads-config", 20: "imports", 8: "contains defines",
}
CHANGES = "apply buffer clear create delete despawn insert mutate remove spawn sync tombstone update write".split()
BEHAVIOURS = "consume dispatch handle packet process publish receive send".split()


def relation_score(relation: Column) -> Column:
    r = F.regexp_replace(F.lower(F.trim(relation)), "^possible-", "")
    rule = F.when(F.lit(False), 0)
    for score, names in RELATION_SCORES.items():
        rule = rule.when(r.isin(names.split()), score)
    return rule.otherwise(45)


def trace_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"), lambda x: F.octet_length(x) >= 3))


def text_score(value: Column, terms: Column) -> Column:
    """18 for each term in the value, 10 for each word of change, 4 for each of behaviour."""
    fixed = reduce(lambda a, b: a + b, [F.when(value.contains(w), n).otherwise(0) for ws, n in ((CHANGES, 10), (BEHAVIOURS, 4)) for w in ws])
    return F.size(F.filter(terms, lambda t: F.contains(value, t))) * 18 + fixed


def impact_scores(dependents: DataFrame, terms: Column, tests: bool | Column = False) -> DataFrame:
    """dependents (name, qualified_name, path, kind, relation, depth) with score: near ones, strong relations, words of the query, no tests, definite."""
    value = F.lower(F.concat_ws(" ", "name", "qualified_name", "path", "kind", "relation"))
    p = F.lower(F.trim("path"))
    place = F.when(p.startswith("@builtin/") | p.startswith("@stdlib/"), -140).when(p.startswith("@external/"), -50).otherwise(0)
    wanted = tests if isinstance(tests, Column) else F.lit(tests)
    test = F.when(trace_test_path(F.col("path")) & ~wanted, -120).otherwise(12)
    sure = F.when(F.lower("relation").startswith("possible-"), -24).otherwise(12)
    score = 180 - (F.greatest("depth", F.lit(1)) - 1) * 28 + relation_score(F.col("relation")) * 0.7 + text_score(value, terms) + place + test + sure
    return dependents.withColumn("score", F.round(score.cast("double"), 6))


def anchors(nodes: DataFrame, limit: int) -> DataFrame:
    """(key, place): nodes to begin with: connectors, then declarations, tests, documents, others; by path and key."""
    p = F.lower("path")
    rule = F.when(F.col("kind").isin(ranking.CONNECTORS), 0).when(p.contains("test") | p.contains("spec"), 2).when(p.endswith(".md") | p.contains("doc"), 3)
    rule = rule.when(F.col("kind").isin("class", "interface", "trait", "module", "function", "method"), 1).otherwise(4)
    first = nodes.filter(ranking.local(F.col("kind"), F.col("path"))).withColumn("priority", rule).orderBy("priority", "path", "key").limit(limit)
    return first.select("key", F.row_number().over(W.orderBy("priority", "path", "key")).cast("long").alias("place"))


def anchored(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(anchor, key) of asked (anchor): the node of that id, else all of that qualified name, name or path."""
    by = lambda column: nodes.select(F.trim(column).alias("anchor"), "key")
    exact = asked.join(by("key"), "anchor")
    others = asked.join(exact.select("anchor"), "anchor", "left_anti")
    return exact.unionByName(others.join(by("qualified_name").unionByName(by("name")).unionByName(by("path")).distinct(), "anchor"))


def declarations(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(range_id, key, place) of ranges (range_id, path, a, b): the nodes (key, kind, path, start_line, end_line) of just that range, else all that touch it.

    Callables and types come first, values last; then the narrower, then by key.
    """
    just = ranges.join(nodes.withColumns({"a": F.col("start_line"), "b": F.col("end_line")}), ["path", "a", "b"])
    # ranges without a node of their own, by far the fewer; only these meet all nodes of their path
    just = just.filter("start_line <= b AND end_line >= a")
    rest = ranges.join(just.select("range_id").distinct(), "range_id", "left_anti")
    touched = rest.join(nodes, "path").filter((F.col("start_line") <= F.col("b")) & (F.col("end_line") >= F.col("a")))
    columns = ["range_id", "key", "kind", "start_line", "end_line"]
    met = just.select(*columns).unionByName(touched.select(*columns))
    low = F.lower(F.trim("kind"))
    kind = F.when(low.isin("function", "method", "constructor", "class", "type", "interface", "trait", "struct", "enum"), 0)
    kind = kind.when(low.isin("module", "package", "namespace", "file"), 1).when(low.isin("field", "property", "parameter", "local", "variable"), 3).otherwise(2)
    place = F.row_number().over(W.partitionBy("range_id").orderBy(kind, F.col("end_line") - F.col("start_line"), "key"))
    return met.select("range_id", "key", place.cast("long").alias("place"))


CITATION = r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+):([0-9]+)(?:-([0-9]+))?"


def grounded(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """(answer_id, citation, grounded) of answers (answer_id, text): path:line or path:from-to that files (path, n_lines) have."""
    cited = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CITATION), 0))).alias("citation"))
    part = lambda i: F.regexp_extract("citation", CITATION, i)
    cited = cited.select("answer_id", "citation", part(1).alias("path"), part(2).cast("int").alias("a"), F.when(part(3) != "", part(3).cast("int")).otherwise(part(2).cast("int")).alias("b"))
    good = F.coalesce((F.col("a") >= 1) & (F.col("a") <= F.col("b")) & (F.col("b") <= F.col("n_lines")), F.lit(False))
    return cited.join(lines, "path", "left").select("answer_id", "citation", good.alias("grounded"))


#: Kinds that have no meaning of their own for vectors.
INELIGIBLE = "repository directory field variable parameter import export constant test".split()


def eligible(nodes: DataFrame) -> DataFrame:
    name = F.lower("name")
    return nodes.filter(~F.col("kind").isin(INELIGIBLE) & ~F.col("path").startswith("@") & ~(name.startswith("closure@") | name.startswith("<lambda@") | name.startswith("lambda@")))


def rendered_terms(value: Column) -> Column:
    """A name as words: cut before an upper-case letter after a lower-case one or a number, and before the last of upper-case ones."""
    cut = F.regexp_replace(F.regexp_replace(value, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(cut), r"[^\p{L}\p{N}]+", " "))


def neighbourhoods(nodes: DataFrame, edges: DataFrame, most: int = 12, most_bytes: int = 6000) -> DataFrame:
    """(key, text): each eligible node with its names, and up to `most` neighbours either way, in order, with how many are left out."""
    own = eligible(nodes)
    names = nodes.select(F.col("key").alias("other"), "name")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "relation", "name").alias("s")))), lambda x: x["s"]), "; ")

    def side(way: str, key: str, other: str) -> DataFrame:
        """(key, line) of one way: edges are dealt by their key once, where they are made distinct, counted and placed."""
        e = edges.select(F.col(key).alias("key"), "relation", F.col(other).alias("other")).repartition("key").distinct()
        at = W.partitionBy("key")
        ranked = e.withColumns({"place": F.row_number().over(at.orderBy("relation", "other")), "whole": F.count(F.lit(1)).over(at)}).filter(F.col("place") <= most)
        shown = ranked.join(names, "other").groupBy("key").agg(line.alias("line"), F.max("whole").alias("whole"))
        return shown.select("key", F.when(F.col("whole") > most, F.concat("line", F.lit("; omitted "), (F.col("whole") - most).cast("string"))).otherwise(F.col("line")).alias(way))

    out, into = side("out", "src", "dst"), side("in", "dst", "src")
    rows = own.join(out, "key", "left").join(into, "key", "left")
    text = F.concat_ws("\n", F.concat_ws(" ", "kind", "name", rendered_terms(F.col("name"))), F.concat_ws(" ", F.lit("path"), "path"), F.concat(F.lit("out "), F.col("out")), F.concat(F.lit("in "), F.col("in")))
    return rows.select("key", F.substring(text, 1, most_bytes).alias("text"))


def sync_decision(existing: bool, base: DataFrame, now: DataFrame, edges: DataFrame, edges_now: DataFrame) -> str:
    """existing (nothing changed), overlay (the same nodes, other edges), else rebuild. base, now: (key); edges: (src, dst, relation)."""
    if not existing:
        return "rebuild"
    def differ(a: DataFrame, b: DataFrame) -> bool:
        """Both ways at once; nulls are equal."""
        both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
        return not both.groupBy(*a.columns).agg(F.bit_or("side").alias("sides")).filter("sides <> 3").isEmpty()

    if differ(base.select("key"), now.select("key")):
        return "rebuild"
    key = ["src", "dst", "relation"]
    return "overlay" if differ(edges.select(*key), edges_now.select(*key)) else "existing"


def redacted(records: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON line a record, the content of the columns replaced by its length and digest."""
    hidden = {c: F.struct(F.octet_length(c).alias("bytes"), F.sha2(c, 256).alias("sha256")) for c in columns}
    return records.select(F.to_json(F.struct(*[hidden.get(c, F.col(c)).alias(c) for c in records.columns])).alias("value"))


def stale(held: DataFrame, now: DataFrame) -> DataFrame:
    """(key, why) of vectors (key, identity, dims, text_hash) that no longer stand for now's rows: missing, identity, dims, text, gone."""
    a = held.select("key", F.struct("identity", "dims", "text_hash").alias("h"))
    both = a.join(now.select("key", F.struct("identity", "dims", "text_hash").alias("w")), "key", "full_outer")
    why = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "gone")
    for c, name in (("identity", "identity"), ("dims", "dims"), ("text_hash", "text")):
        why = why.when(F.col("h")[c] != F.col("w")[c], name)
    return both.select("key", why.alias("why")).filter("why IS NOT NULL")


#: How many suggestions an orientation makes at most, one of search aside.
SUGGESTED = 6


def oriented(found: DataFrame, asked: DataFrame, nodes: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """(query, lane, rank, anchor, kind, reason): where to begin, for each query of asked (query, text; an empty text for none).

    found (query, key, place): what a query's symbols are, or the anchors of a repository where nothing is asked; its first
    `limit` are looked at. Lanes: symbol (documentation left out), source (the first files by path, with what they are),
    suggestion (inspect and trace for symbols, inspect for files, then search where nothing was asked).
    """
    of_query = W.partitionBy("query")
    looked = found.withColumn("nth", F.row_number().over(of_query.orderBy("place", "key"))).filter(F.col("nth") <= limit)
    named = looked.join(nodes.select("key", "kind", "path"), "key").filter(path_class(F.col("path")) != "document")
    symbols = named.select("query", F.lit("symbol").alias("lane"), F.row_number().over(of_query.orderBy("nth")).cast("long").alias("rank"), F.col("key").alias("anchor"), "kind", F.lit("symbol or contract").alias("reason"))
    first = files.filter(F.coalesce(F.col("text"), F.lit("")) != "").filter(path_class(F.col("path")) != "document").orderBy("path").limit(limit)  # a short list
    first = first.select(F.row_number().over(W.orderBy("path")).cast("long").alias("rank"), F.col("path").alias("anchor"), path_class(F.col("path")).alias("kind"))
    sources = asked.select("query").crossJoin(F.broadcast(first)).select("query", F.lit("source").alias("lane"), "rank", "anchor", "kind", F.lit("file of the snapshot").alias("reason"))
    most = min(SUGGESTED, limit)
    whole = lambda modes: F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).alias("kind"), F.lit(r).alias("reason")) for i, (m, r) in enumerate(modes))))
    inspect, trace = ("inspect", "inspect the evidence of this anchor"), ("trace", "expand bounded structural paths")
    of_symbols = symbols.filter(F.col("rank") <= -(-most // 2)).select("query", F.lit(0).alias("lane"), "rank", "anchor", whole([inspect, trace]).alias("s"))
    some = of_symbols.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    of_sources = sources.join(some, "query", "left").filter(F.col("rank") <= most - F.coalesce("n", F.lit(0))).select("query", F.lit(1).alias("lane"), "rank", "anchor", whole([inspect]).alias("s"))
    search = asked.filter("text = ''").select("query", F.lit(2).alias("lane"), F.lit(1).cast("long").alias("rank"), F.lit("").alias("anchor"), whole([("search", "search for a symbol, contract, behaviour or literal")]).alias("s"))
    told = of_symbols.unionByName(of_sources).unionByName(search)
    place = F.row_number().over(of_query.orderBy("lane", "rank", "s.i")).cast("long")
    suggestions = told.select("query", F.lit("suggestion").alias("lane"), place.alias("rank"), "anchor", "s.kind", "s.reason")
    return symbols.unionByName(sources).unionByName(suggestions)
