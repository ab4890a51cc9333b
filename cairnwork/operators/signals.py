"""Exact signals of a query (phrases, errors, versions, keys, paths, identifiers) and the search for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import text as T
from cairnwork.plans.storage import cut

#: The forms of signals, extensions that make a dotted name a file, what is stripped around a word.
VERSION = r"^(?:v|V|go)?[0-9]+(?:\.[0-9]+)+(?:[-+][A-Za-z0-9.-]+)?$"
ERROR = r"^(?:[0-9]{3}|0[xX][0-9A-Fa-f]+|(?:ERR|ERROR)[-_0-9A-Z]+|E(?:[0-9_][A-Za-z0-9_-]*|[A-Z][A-Z0-9_]+))$"
KEY_PART = r"^[A-Za-z_][A-Za-z0-9_-]*$"
QUOTED = "\"([^\"]*)\"|'([^']*)'|`([^`]*)`"
EXTENSIONS = "c cc cpp css go h hpp html java js json md mod py rs sum toml ts txt xml yaml yml".split()
AROUND = "()[]{}<>,;.!?"


def config_key(c: Column) -> Column:
    """Two or more dotted parts, all names, the last no extension of files."""
    parts = F.split(c, r"\.")
    return ~c.rlike(r"[/\\]") & (F.size(parts) >= 2) & ~F.lower(F.element_at(parts, -1)).isin(EXTENSIONS) & F.forall(parts, lambda x: x.rlike(KEY_PART))


def is_path(c: Column) -> Column:
    return c.rlike(r"[/\\]") | c.rlike(r"^[\s\S]+\.[A-Za-z_][A-Za-z0-9_-]*$")


def identifier(c: Column) -> Column:
    return c.rlike(KEY_PART) & (c.contains("_") | c.rlike("^.+[A-Z]"))


def signals(queries: DataFrame) -> DataFrame:
    """(query_id, ordinal, value, kind, label, weight) of queries (query_id, text), one row a value and kind, the first kept."""
    one = lambda value, kind, weight, label=None: F.struct(value.alias("value"), F.lit(kind).alias("kind"), (label if label is not None else value).alias("label"), F.lit(float(weight)).alias("weight"))
    quoted = F.filter(F.transform(F.regexp_extract_all("text", F.lit(QUOTED), 0), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2))), lambda x: x != "")
    words = F.split(F.regexp_replace("text", QUOTED, " "), r"\s+")
    words = F.filter(F.transform(words, lambda x: F.btrim(x, F.lit(AROUND))), lambda x: x != "")
    none = F.filter(F.array(one(F.lit(""), "", 0)), lambda x: F.lit(False))

    def keys(c: Column) -> Column:
        """A key and, at 79, its last part; nothing if it is none."""
        last = F.substring_index(c, ".", -1)
        return F.when(config_key(c), F.array(one(c, "configuration key", 80), one(last, "configuration key", 79, c))).otherwise(none)

    def of_word(w: Column) -> Column:
        before, stem = F.substring_index(w, "=", 1), F.substring_index(w, ":", 1)
        rule = F.when(F.instr(w, "=") > 1, keys(F.regexp_replace(before, "^--", "")))
        rule = rule.when((F.instr(w, ":") > 1) & config_key(stem), keys(stem))
        rule = rule.when(w.rlike(VERSION), F.array(one(w, "version string", 85))).when(w.rlike(ERROR), F.array(one(w, "error code", 90)))
        rule = rule.when(config_key(w), keys(w))
        for kind, holds in (("path", w.rlike(r"[/\\]")), ("filename", is_path(w))):
            rule = rule.when(holds, F.array(one(w, kind, 75)))
        return rule.when(identifier(w), F.array(one(w, "identifier", 70))).otherwise(none)

    found = F.concat(F.transform(quoted, lambda x: one(x, "quoted phrase", 100)), F.flatten(F.transform(words, of_word)))
    rows = queries.select("query_id", F.posexplode(found).alias("ordinal", "s")).select("query_id", "ordinal", "s.*")
    first = F.row_number().over(W.partitionBy("query_id", "value", "kind").orderBy("ordinal"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def exact_search(files: DataFrame, asked: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): files (doc_id, path, text) with a hit of the signals of a query, best first.

    A signal's weight, plus one, counts for a hit in the path, its weight for one in the text; phrases, paths and file
    names match anywhere, others as whole words. Candidates of a query are files with all tokens of one of its
    signals, or all files if one of them has no token. asked: signals() rows, a stated query set, broadcast by size.

    Files meet a value, once for all its queries, by the value's rarest token; its other tokens are looked up for these
    files alone.
    """
    asked = cut(asked)
    tokens = F.array_distinct(T.tokens(F.col("value")))
    values = asked.select("value").distinct().select("value", tokens.alias("tokens"))
    keyed = values.select("value", F.explode("tokens").alias("term"))
    whole = files.select("doc_id", F.explode(F.array_distinct(F.concat(*(T.tokens(F.col(c)) for c in ("text", "path"))))).alias("term"))
    terms = cut(whole.join(keyed.select("term").distinct(), "term", "left_semi"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = keyed.join(counts, "term", "left").groupBy("value").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    first = terms.join(rare, "term").join(values, "value").select("doc_id", "value", "tokens", "term")
    more = first.select("doc_id", "value", F.explode(F.array_remove("tokens", F.col("term"))).alias("term"), (F.size("tokens") - 1).alias("needed"))
    rest = more.join(terms, ["doc_id", "term"]).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).filter("n = needed")
    met = first.filter(F.size("tokens") == 1).select("doc_id", "value").unionByName(rest.select("doc_id", "value"))
    open_ = asked.filter(F.size(T.tokens(F.col("value"))) == 0).select("query_id").distinct()
    some = met.join(asked.select("query_id", "value").distinct(), "value").select("query_id", "doc_id").distinct().join(open_, "query_id", "left_anti")
    pairs = some.unionByName(files.select("doc_id").crossJoin(F.broadcast(open_)).select("query_id", "doc_id"))
    rows = pairs.join(asked, "query_id").join(files, "doc_id")
    value = F.col("value")
    inside = F.when(F.col("kind").isin("quoted phrase", "path", "filename"), F.contains(F.col("text"), value)).otherwise(T.contains_word(F.col("text"), value))
    score = F.when(F.contains(F.col("path"), value), F.col("weight") + 1).otherwise(0.0) + F.when(inside, F.col("weight")).otherwise(0.0)
    scored = rows.groupBy("query_id", "doc_id", "path").agg(F.sum(score).alias("score")).filter("score > 0")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "path", "doc_id"))
    ranked = scored.withColumn("rank", rank.cast("long")).drop("path")
    return ranked.filter(F.col("rank") <= k) if k else ranked
