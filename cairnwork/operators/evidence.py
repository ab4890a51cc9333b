"""What is made of results: a narrow budget across lanes, excerpts, source of handles, and what the evidence is good for."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.operators.discovery import path_class

#: The order in which lanes take turns.
LANES = ("exact", "symbol", "source")


def narrow_budget(rows: DataFrame, limit: int) -> DataFrame:
    """(query, lane, nth, handle, verdict, pick): what is looked at until `limit` results of a query are kept.

    rows (query, lane, nth, handle, path, label, start_line, end_line): each lane's candidates in order, of bounded number.
    Lanes take turns, each giving its next candidate that repeats none that is kept: not the same handle, nor in the same
    path the same lines, nor (overlapping or without lines) the same label. verdict is kept (with its place) or suppressed.
    """
    kind = dict(rows.dtypes)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        queues = [group[group.lane == lane].sort_values("nth").to_dict("records")[::-1] for lane in LANES]
        kept, out, by_handle, by_path = 0, [], set(), {}

        def repeats(c: dict) -> bool:
            if c["handle"] in by_handle:
                return True
            for other in by_path.get(c["path"], ()):
                if pd.isna(c["start_line"]) or pd.isna(other["start_line"]):
                    if c["label"] and c["label"] == other["label"]:
                        return True
                elif c["start_line"] <= other["end_line"] and other["start_line"] <= c["end_line"]:
                    same = (c["start_line"], c["end_line"]) == (other["start_line"], other["end_line"])
                    if same or c["label"] and c["label"] == other["label"]:
                        return True
            return False

        while kept < limit and any(queues):
            for queue in queues:
                while queue and kept < limit:
                    c = queue.pop()
                    if repeats(c):
                        out.append((c["query"], c["lane"], c["nth"], c["handle"], "suppressed", None))
                        continue
                    kept += 1
                    by_handle.add(c["handle"])
                    if c["path"]:
                        by_path.setdefault(c["path"], []).append(c)
                    out.append((c["query"], c["lane"], c["nth"], c["handle"], "kept", kept))
                    break
        return pd.DataFrame(out, columns=["query", "lane", "nth", "handle", "verdict", "pick"]).astype({"pick": "Int64"})

    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    read = rows.select("query", "lane", "nth", "handle", plain("path").alias("path"), plain("label").alias("label"), "start_line", "end_line")
    return read.groupBy("query").applyInPandas(choose, f"query {kind['query']}, lane string, nth {kind['nth']}, handle {kind['handle']}, verdict string, pick long")


SPACE_BEFORE, SPACE_AFTER = r"(?U)^\s+", r"(?U)\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE_BEFORE, ""), SPACE_AFTER, "")


def compact(text: Column, most: int = 700, ends: str = "\n.!?; }", with_end: bool = True) -> Column:
    """A text of more than `most` bytes cut at the last of `ends` in its second half, if there is one, with an ellipsis."""
    whole = trimmed(F.regexp_replace(text, "\r\n", "\n"))
    data = F.encode(whole, "UTF-8")
    inside = lambda n: F.substring(F.hex(F.substring(data, n + 1, 1)), 1, 1).isin("8", "9", "A", "B")  # noqa: E731  the byte after n goes on with a character
    size = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    head = trimmed(F.substring(data, F.lit(1), size).cast("string"))
    klass = "".join("\\" + c if c in ".?}" else c for c in ends)
    to_end = F.regexp_extract(head, f"(?s)^(.*)([{klass}])", 1)
    fits = (F.length(F.regexp_extract(head, f"(?s)^(.*)([{klass}])", 2)) > 0) & (F.octet_length(to_end) >= most // 2)
    cut = trimmed(F.regexp_extract(head, f"(?s)^(.*[{klass}])", 1) if with_end else to_end)
    return F.when(F.octet_length(whole) <= most, whole).otherwise(F.concat(F.when(fits, cut).otherwise(head), F.lit("…")))


def inspected(asked: DataFrame, chunks: DataFrame, adjacent: int) -> DataFrame:
    """(request, path, start_line, end_line, problem, source) of asked (request, path, start_line, end_line) with `adjacent` lines about.

    chunks (path, chunk_id, start_line, end_line, text) are a snapshot's. Where chunks overlap the later one tells a line;
    a line that is spread over chunks of one line each is put together. A start of 0 or less is the first line, an end
    before the start is the start. problem: no such path, or lines outside it. Only chunks near the lines are read.
    """
    bounds = chunks.groupBy("path").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"))
    a = asked.join(bounds, "path", "left")
    start = F.when(F.col("start_line") <= 0, F.col("first")).otherwise(F.col("start_line"))
    a = a.withColumn("s", start).withColumn("e", F.greatest("s", "end_line"))
    problem = F.when(F.col("first").isNull(), "no such path").when((F.col("s") < F.col("first")) | (F.col("e") > F.col("last")), "outside")
    a = a.withColumns({"problem": problem, "lo": F.greatest("first", F.col("s") - adjacent), "hi": F.least("last", F.col("e") + adjacent)})
    good = a.filter("problem IS NULL").select("request", "path", "lo", "hi")
    near = good.join(chunks.withColumnsRenamed({"start_line": "c0", "end_line": "c1"}), "path").filter((F.col("c0") <= F.col("hi")) & (F.col("c1") >= F.col("lo")))
    parts = near.select("request", "lo", "hi", "c0", "c1", "chunk_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("i", "part"))
    told = parts.withColumn("line", F.col("c0") + F.col("i")).filter("line <= c1 AND line BETWEEN lo AND hi")
    held = F.array_sort(F.collect_list(F.struct("c0", "chunk_id", (F.col("c0") == F.col("c1")).alias("alone"), "part")))
    no = F.lit(None).cast("string")
    text = F.aggregate(held, no, lambda t, p: F.when(p["alone"] & t.isNotNull(), F.concat(t, p["part"])).otherwise(p["part"]))
    lines = told.groupBy("request", "line").agg(text.alias("text"))
    source = lines.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("source"))
    return a.join(source, "request", "left").select("request", "path", F.when(F.col("problem").isNull(), F.col("lo")).alias("start_line"), F.when(F.col("problem").isNull(), F.col("hi")).alias("end_line"), "problem", "source")


#: What evidence may show; kinds that show it; places and extensions that show a boundary.
DIMENSIONS = ("owner", "control_flow", "public_boundary", "tests")
OWNERS = "function method constructor handler type struct class interface enum".split()
RUNS = "function method constructor handler".split()
BOUNDARIES = "interface http-endpoint route command config schema contract".split()
DIRECT = "exact source lexical".split()
HEADERS = (".h", ".hpp", ".proto")
#: Status, next action and reason, by mode and case.
ASSESSMENTS = {
    ("orient", "none"): ("insufficient", "use-direct-search-or-specific-query", "orientation returned no concrete repository anchors"),
    ("orient", "some"): ("discovery-ready", "search-specific-behavior", "repository anchors are available; continue with a concrete query"),
    ("search", "none"): ("insufficient", "use-direct-search-or-balanced-search", "search returned no concrete evidence"),
    ("search", "narrow core"): ("ready-for-targeted-inspection", "inspect-selected-handles", "narrow discovery found owner and control-flow anchors; inspect only missing task dimensions"),
    ("search", "narrow"): ("partial", "inspect-best-anchor-or-switch-balanced", "narrow discovery found evidence but did not establish both owner and control-flow anchors"),
    ("search", "some"): ("discovery-ready", "inspect-or-expand-selected-handle", "balanced discovery returned ranked evidence; select a handle before expanding"),
    ("inspect", "none"): ("insufficient", "inspect-valid-handle", "inspection returned no exact evidence"),
    ("inspect", "all"): ("ready-to-synthesize", "synthesize", "inspection covers owner, control flow, public boundary, and tests"),
    ("inspect", "core"): ("partial", "inspect-missing-dimensions", "core implementation is grounded; inspect only the listed missing dimensions if the task requires them"),
    ("inspect", "some"): ("partial", "inspect-owning-implementation", "exact evidence is available but the owning implementation is not yet grounded"),
    ("expand", "none"): ("insufficient", "inspect-anchor-or-refine-query", "structural expansion returned no evidence"),
    ("expand", "gaps"): ("partial", "resolve-named-structural-gap", "bounded structural evidence is available, but unresolved relationships remain"),
    ("expand", "some"): ("ready-to-synthesize", "synthesize", "bounded structural evidence is available without unresolved relationships"),
}


def assessed(requests: DataFrame, items: DataFrame, expansions: DataFrame) -> DataFrame:
    """What the evidence of each request (request, mode, breadth) shows, lacks, and what to do next.

    items (request, provider, kind, name, qualified_name, path, excerpt, inspected): results, or what an inspection held,
    whose excerpt is its source; expansions (request, found, unresolved): counts of paths, dependents and gaps. One row a
    request with a mode of search, orient, inspect, trace or impact: evidence_items, distinct_paths, observed, missing,
    status, next_action, reason.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kind, provider, path = F.lower(text("kind")), text("provider"), F.lower(F.regexp_replace(text("path"), r"\\", "/"))
    named = F.concat(text("qualified_name"), text("name")) != ""
    direct, said = provider.isin(*DIRECT), text("excerpt") != ""
    of_path = F.when(path != "", path_class(path))
    outward = reduce(lambda a, b: a | b, [path.contains("/include/"), path.startswith("include/"), path.contains("/public/"), path.contains("api"), *(path.endswith(x) for x in HEADERS)])
    shows = {
        "owner": named & ~kind.isin("file", "document") | kind.isin(*OWNERS) | direct & (path != ""),
        "control_flow": direct | said | kind.isin(*RUNS),
        "public_boundary": kind.isin(*BOUNDARIES) | (path != "") & ((of_path == "contract") | outward),
        "tests": F.coalesce(of_path == "test", F.lit(False)),
    }
    seen = items.groupBy("request").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct(F.when(path != "", path)).alias("distinct_paths"), *(F.max(c).alias(d) for d, c in shows.items()),
    )
    a = requests.join(seen, "request", "left").join(expansions, "request", "left").fillna(0, ["n_items", "distinct_paths", "found", "unresolved"]).fillna(False, list(DIMENSIONS))
    group = F.when(F.col("mode").isin("trace", "impact"), "expand").otherwise(F.col("mode"))
    n = F.col("n_items") + F.col("found")
    core, whole = F.col("owner") & F.col("control_flow"), reduce(lambda x, y: x & y, map(F.col, DIMENSIONS))
    case = F.when(n == 0, "none").when(group == "search", F.when(F.col("breadth") == "narrow", F.when(core, "narrow core").otherwise("narrow")))
    case = case.when(group == "inspect", F.when(whole, "all").when(core, "core")).when(group == "expand", F.when(F.col("unresolved") > 0, "gaps"))
    a = a.withColumns({"case": F.coalesce(case, F.lit("some")), "group": group, "evidence_items": n.cast("long")})
    listed = lambda yes: F.array_compact(F.array(*(F.when(F.col(d) == yes, d) for d in DIMENSIONS)))
    told = requests.sparkSession.createDataFrame([(*k, *v) for k, v in ASSESSMENTS.items()], "group string, case string, status string, next_action string, reason string")
    return a.withColumns({"observed": listed(True), "missing": listed(False)}).join(F.broadcast(told), ["group", "case"]).select(
        "request", "evidence_items", "distinct_paths", "observed", "missing", "status", "next_action", "reason",
    )
