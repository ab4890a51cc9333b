"""Markdown sections, line-window chunks, and links from text to code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import text as T

HEADING = r"^[ \t]*(#{1,6}) ([^\n]*?)\r?(?:\n|\z)"
#: Before a line that is a heading with a title.
BEFORE_HEADING = r"(?d)(?m)(?=^[ \t]*#{1,6} [^\n]*[^\s#])"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def section_texts(files: DataFrame) -> DataFrame:
    """files without text, and ordinal (from 0), text of each section, no row being shuffled."""
    others = [c for c in files.columns if c != "text"]
    return files.select(*others, F.posexplode(F.split("text", BEFORE_HEADING)).alias("ordinal", "text"))


def sections(files: DataFrame) -> DataFrame:
    """(path, ordinal, section_id, heading, heading_path, start_byte, end_byte, start_line, end_line) of files (path, text).

    Text goes by in the scan; only a few numbers and the title of each section are shuffled, by path. The depth of a
    heading is its level, but one more than the depth before it at most: so depth(i) = i + min(0, least of level(j) - j
    up to i), a running minimum. Its path has, for each lesser depth, the last title of that depth.
    """
    parts = section_texts(files.select("path", "text"))
    level, title = F.length(F.regexp_extract("text", HEADING, 1)), _trimmed(F.regexp_replace(_trimmed(F.regexp_extract("text", HEADING, 2)), r"#+\z", ""))
    is_heading = F.col("text").rlike("(?d)^" + BEFORE_HEADING.removeprefix("(?d)(?m)"))
    narrow = parts.select(
        "path", "ordinal", F.when(is_heading, level).alias("level"), F.when(is_heading, title).alias("title"), F.octet_length("text").cast("long").alias("size"),
        (F.length("text") - F.length(F.translate("text", "\n", ""))).cast("long").alias("ends"), F.col("text").endswith("\n").alias("ended"),
    )
    before = W.partitionBy("path").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("path").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    placed = narrow.withColumns({
        "start_byte": F.coalesce(F.sum("size").over(before), F.lit(0)), "start_line": F.coalesce(F.sum("ends").over(before), F.lit(0)) + 1,
        "number": F.count("level").over(so_far), "sections": F.max("ordinal").over(W.partitionBy("path")),
    })
    depth = F.col("number") + F.least(F.lit(0), F.min(F.col("level") - F.col("number")).over(so_far))
    placed = placed.withColumn("depth", F.when(F.col("level").isNotNull(), depth))
    titles = {f"t{k}": F.last(F.when(F.col("depth") == k, F.col("title")), ignorenulls=True).over(so_far) for k in range(1, 7)}
    placed = placed.withColumns(titles).withColumn("heading_path", F.slice(F.array(*titles), F.lit(1), F.coalesce("depth", F.lit(0)).cast("int")))
    key = F.array_join("heading_path", "\x1f")
    nth = F.row_number().over(W.partitionBy("path", "key").orderBy("ordinal"))
    named = placed.withColumn("key", key).withColumn("nth", nth)
    plain = F.when(F.col("sections") == 0, "document").otherwise("preamble")
    identity = F.when(F.col("level").isNull(), F.concat_ws("\x00", "path", plain)).otherwise(F.concat_ws("\x00", "path", "key", F.col("nth").cast("string")))
    last = F.col("start_line") + F.col("ends") - F.when(F.col("ended"), 1).otherwise(0)
    return named.select(
        "path", "ordinal", F.substring(F.sha2(identity, 256), 1, 16).alias("section_id"), F.coalesce("title", F.lit("")).alias("heading"), "heading_path",
        "start_byte", (F.col("start_byte") + F.col("size")).alias("end_byte"), "start_line", F.greatest("start_line", last).alias("end_line"),
    )


def bytes_over_four(text: str) -> int:
    """A stand-in for a tokenizer's count: a quarter of the bytes, rounded up."""
    return -(-len(text.encode()) // 4)


CHUNKS = "path string, start_line int, end_line int, token_count int, part int, semantic_kind string, semantic_name string, chunk_id string, text string"
WINDOW_LINES, BREAK_AFTER, MOST_TOKENS = 48, 8, 1536


def windows(lines: list[str], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most 48 lines, cut after the last blank line in one if that is more than 8 lines in; blank ends trimmed."""
    blank = [not x.strip() for x in lines[start:end]]
    at = start
    while at < end:
        to = min(at + WINDOW_LINES, end)
        if at + WINDOW_LINES <= end:
            last = next((i + 1 for i in range(to - 1, at - 1, -1) if blank[i - start]), -1)
            to = last if last > at + BREAK_AFTER else to
        yield at, to
        at = to


def chunks_of(path: str, text: str, count: Callable[[str], int], spans: list[tuple[int, int, str, str]], pieces: Callable[[str], list[str]]) -> Iterator[tuple]:
    """Rows of CHUNKS for one file; spans: (first line, last line, kind, name), canonical and in order."""
    import hashlib

    body = text.replace("\r\n", "\n")
    body = body[:-1] if body.endswith("\n") else body
    if not body.strip():
        return
    lines = body.split("\n")

    def row(a: int, b: int, shown: str, part: int, kind: str, name: str) -> tuple:
        identity = f"{path}\0{a}\0{b}\0{shown}" + (f"\0token-part:{part}" if part >= 0 else "")
        return path, a, b, count(shown), part, kind, name, hashlib.sha256(identity.encode()).hexdigest()[:32], shown

    def fitted(a: int, b: int, kind: str, name: str) -> Iterator[tuple]:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            while a < b and not lines[a].strip():
                a += 1
            while b > a and not lines[b - 1].strip():
                b -= 1
            if a >= b:
                continue
            shown = "\n".join(lines[a:b])
            if count(shown) <= MOST_TOKENS:
                yield row(a + 1, b, shown, -1, kind, name)
                continue
            if b - a == 1:
                for i, piece in enumerate(pieces(shown)):
                    yield row(a + 1, a + 1, piece, i, kind, name)
                continue
            low, high, cut = a + 1, b - 1, a
            while low <= high:  # the most lines that fit
                middle = (low + high) // 2
                if count("\n".join(lines[a:middle])) <= MOST_TOKENS:
                    cut, low = middle, middle + 1
                else:
                    high = middle - 1
            if cut == a:
                for i, piece in enumerate(pieces(lines[a])):
                    yield row(a + 1, a + 1, piece, i, kind, name)
                todo.append((a + 1, b))
            else:
                todo += [(cut, b), (a, cut)]

    at = 0
    for first, last, kind, name in spans:
        for a, b in windows(lines, at, first - 1):
            yield from fitted(a, b, "", "")
        yield from fitted(first - 1, last, kind, name)
        at = last
    for a, b in windows(lines, at, len(lines)):
        yield from fitted(a, b, "", "")


def four_byte_pieces(text: str) -> list[str]:
    """Cuts of a line for bytes_over_four: MOST_TOKENS characters each, so never more tokens than that."""
    return [text[i : i + MOST_TOKENS] for i in range(0, len(text), MOST_TOKENS)]


def chunks(files: DataFrame, count: Callable[[str], int] = bytes_over_four, pieces: Callable[[str], list[str]] = four_byte_pieces) -> DataFrame:
    """CHUNKS of files (path, text), or (path, text, spans) with spans an array of (start_line, end_line, kind, name).

    Each window begins where the one before was cut, so a file is read in order by one Python loop; files are
    independent, nothing is shuffled, and a null text has no chunk. count and pieces are the tokenizer: how many
    tokens a text has, and its cuts of MOST_TOKENS tokens.
    """
    spans = "spans" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CHUNKS.split(", "))])
        for batch in batches:
            for r in batch.to_pylist():
                own = [(s["start_line"], s["end_line"], s["kind"], s["name"]) for s in (r.get("spans") or [])]
                rows = list(chunks_of(r["path"], r["text"] or "", count, own, pieces))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "text", *(["spans"] if spans else [])).mapInArrow(run, CHUNKS)


#: Which of two spans of one range is kept, by kind.
SPAN_PRIORITY = {"test": 7, "method": 6, "function": 5, "type": 4, "constant": 3, "variable": 2, "import": 1}


def span_priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, n in SPAN_PRIORITY.items() for x in (F.lit(k), F.lit(n))]), F.lower(kind)), F.lit(0))


def canonical_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, start_line, end_line, kind, name): spans clamped to their files, one a range, leaves alone, overlaps resolved.

    spans: (path, start_line, end_line, kind, name); lines: (path, n_lines). A span that holds another one is left out:
    the next span in order of start (longest first) tells. Overlapping leaves are settled in order, the narrower one
    (then of higher kind, then by name) replacing the last kept.
    """
    rows = spans.select("path", "start_line", "end_line", F.trim("kind").alias("kind"), F.trim("name").alias("name")).join(lines, "path")
    rows = rows.filter("start_line > 0 AND start_line <= n_lines")
    rows = rows.withColumn("end_line", F.least(F.greatest("start_line", "end_line"), F.col("n_lines")).cast("int")).withColumn("priority", span_priority(F.col("kind")))
    best = F.row_number().over(W.partitionBy("path", "start_line", "end_line").orderBy(F.desc("priority"), "name", "kind"))
    rows = rows.withColumn("n", best).filter("n = 1")
    # a range that holds another one ends at or after the least end of those that start at or after it (one of them narrower)
    later = W.partitionBy("path").orderBy("start_line", F.desc("end_line")).rowsBetween(1, W.unboundedFollowing)
    leaves = rows.withColumn("inner", F.min("end_line").over(later)).filter("inner IS NULL OR inner > end_line")
    listed = leaves.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", (-F.col("priority")).alias("rank"), "name", "kind"))).alias("s"))
    width = lambda x: x["end_line"] - x["start_line"]
    better = lambda x, y: (width(x) < width(y)) | ((width(x) == width(y)) & (F.struct(x["rank"], x["name"], x["kind"]) < F.struct(y["rank"], y["name"], y["kind"])))
    kept = F.aggregate("s", F.filter("s", lambda x: F.lit(False)), lambda held, x: F.when(
        (F.size(held) == 0) | (x["start_line"] > F.try_element_at(held, F.lit(-1))["end_line"]), F.concat(held, F.array(x)),
    ).when(better(x, F.try_element_at(held, F.lit(-1))), F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(x))).otherwise(held))
    return listed.select("path", F.explode(kept).alias("x")).select("path", "x.start_line", "x.end_line", "x.kind", "x.name")


#: What declares a symbol, a configuration key, a literal; what refers to one.
DECLARATION = r"(?m)(?:^|[^A-Za-z0-9_])(?:func|type|class|struct|enum|interface|message|service|const|var)\s+([A-Za-z_][A-Za-z0-9_]*)"
CONFIG_KEY = r"(?m)^\s*[\"']?([A-Za-z_][A-Za-z0-9_.-]*)[\"']?\s*[:=]"
LITERAL = r"[\"']([A-Za-z][A-Za-z0-9_.-]{2,}|/[A-Za-z0-9_./?=&{}${}:-]+)[\"']"
REFERENCE = r"(?:[A-Za-z0-9_!.@-]+/)+[A-Za-z0-9_!.@-]+|/[A-Za-z0-9_./?=&{}$:-]+|[A-Za-z_][A-Za-z0-9_.-]{2,}"
MOST_LINKS, PER_REFERENCE, CONTRACT_USES, SYMBOL_USES = 32, 4, 4, 8


def catalogue(files: DataFrame) -> DataFrame:
    """(kind, value, path), distinct: declared symbols, configuration keys, literals of code files (path, text)."""
    found = [
        files.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("value"), "path")
        for kind, pattern in (("symbol", DECLARATION), ("config-contract", CONFIG_KEY), ("contract", LITERAL))
    ]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).filter(F.octet_length("value") >= 3)
    kind = F.when((F.col("kind") == "contract") & F.col("value").startswith("/"), "endpoint").otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).distinct()


def references(text: Column) -> Column:
    """Distinct references of a text, with their forms without closing punctuation and without a query."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), 0))
    trimmed = F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:)\]}]+\z", ""))
    bare = F.transform(F.filter(found, lambda x: x.startswith("/") & (F.instr(x, "?") > 1)), lambda x: F.substring_index(x, "?", 1))
    return F.array_distinct(F.filter(F.concat(found, trimmed, bare), lambda x: x != ""))


def code_links(texts: DataFrame, code: DataFrame, paths: DataFrame, key: list[str]) -> DataFrame:
    """(*key, kind, value, source_path, place): what each text (*key, text) refers to, at most 32 links, paths first.

    code: catalogue rows; paths: (path). A reference is exact. Names that too many files have (more than 4 of a
    contract, 8 of a symbol) are left out; of the others the first 4 of a kind by path count, so each value's entries
    are narrowed before the join and a common word can't blow it up.
    """
    by_value = W.partitionBy("value", "kind")
    few = code.withColumns({"uses": F.count(F.lit(1)).over(by_value), "n": F.row_number().over(by_value.orderBy("path"))})
    few = few.filter(~((F.col("kind") == "contract") & (F.col("uses") > CONTRACT_USES)) & ~((F.col("kind") == "symbol") & (F.col("uses") > SYMBOL_USES)) & (F.col("n") <= PER_REFERENCE))
    entries = few.select(F.lit(1).alias("group"), "kind", "value", F.col("path").alias("source_path"))
    entries = entries.unionByName(paths.select(F.lit(0).alias("group"), F.lit("path").alias("kind"), F.col("path").alias("value"), F.col("path").alias("source_path")).distinct())
    asked = texts.select(*key, F.explode(references(F.col("text"))).alias("value"))
    links = asked.join(entries, "value").dropDuplicates([*key, "kind", "value", "source_path"])
    place = F.row_number().over(W.partitionBy(*key).orderBy("group", "value", "kind", "source_path"))
    return links.withColumn("place", place).filter(F.col("place") <= MOST_LINKS).select(*key, "kind", "value", "source_path", "place")


def file_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.size(T.lines(F.col("text"))).alias("n_lines"))
