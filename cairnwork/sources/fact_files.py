"""Fact files of tab-separated lines as a data source of Spark: `spark.read.format("fact-lines")`, `df.write.format("fact-lines")`.

A folder holds files of records N (node), E (edge) and U (unresolved reference), a line each, below a line with the version.
Tasks write files of their own; a commit, which is one file more that names them, makes them part of the folder. What failed
attempts leave behind is in no commit, so no reader sees it. Readers take the files of the commits in byte ranges of `split`
bytes; a folder without commits is read as it is, so files made elsewhere can be imported.

Options: path, split. Modes: append, overwrite (the commit says that what came before is gone).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The first line, the fields of each record, the span that ends it, what stands for nothing, and escapes.
HEADER = "version\t4"
FIELDS = {
    "N": ("key", "identity?", "kind", "path", "name", "qualified_name", "content?"), "E": ("key", "target", "kind"),
    "U": ("key", "kind", "reason", "expression", "namespace?", "candidate?"),
}
SPAN = ("span_path", "start_line", "start_column", "end_line", "end_column")
NOTHING = "-"
ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\0": "\\0"}

NUMBERS = SPAN[1:]
COLUMNS = ("record", "key", "target", "kind", "identity", "path", "name", "qualified_name", "content", "reason", "expression", "namespace", "candidate", *SPAN)
SCHEMA = ", ".join(f"{c} {'int' if c in NUMBERS else 'string'}" for c in COLUMNS)
COMMITS = "_commits"
SPLIT = 64 << 20
#: Bytes read at once, whose records make one record batch a kind.
BLOCK = 1 << 20


class BadLine(ValueError):
    """A line that is no record, with its place."""


def escaped(value: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in value)


def unescaped(value: str) -> str:
    if "\\" not in value:
        return value
    plain, out, after = {v[1]: k for k, v in ESCAPES.items()}, [], False
    for c in value:
        if after:
            out.append(plain[c])
        elif c != "\\":
            out.append(c)
        after = not after and c == "\\"
    if after:
        raise KeyError("\\")
    return "".join(out)


def encoded(row: Row) -> str:
    """A row's line. An optional field that is null, or no span, stands as nothing."""
    try:
        names = FIELDS[row["record"]]
    except KeyError:
        raise BadLine(f"no record is called {row['record']!r}") from None
    values = [row[n.rstrip("?")] for n in names]
    lacking = [n for n, v in zip(names, values, strict=True) if v is None and not n.endswith("?")]
    span = [row[c] for c in SPAN]
    if lacking or len({v is None for v in span}) > 1:
        raise BadLine(f"a record {row['record']} lacks {lacking or 'a part of its span'}")
    return "\t".join([row["record"], *(NOTHING if v is None else escaped(str(v)) for v in [*values, *span])])


def decoded(line: str, place: str) -> tuple:
    fields = line.split("\t")
    names = FIELDS.get(fields[0])
    if names is None or len(fields) != 1 + len(names) + len(SPAN):
        raise BadLine(f"{place}: no record of this form")
    out = dict.fromkeys(COLUMNS)
    out["record"] = fields[0]
    try:
        for name, value in zip(names, fields[1:], strict=False):
            out[name.rstrip("?")] = None if name.endswith("?") and value == NOTHING else unescaped(value)
        span = fields[1 + len(names) :]
        if any(v != NOTHING for v in span):
            out[SPAN[0]] = unescaped(span[0])
            out.update((c, int(v)) for c, v in zip(NUMBERS, span[1:], strict=True))
    except (KeyError, ValueError):
        raise BadLine(f"{place}: a bad escape or number") from None
    return tuple(out.values())


def _cut_last(data: bytes) -> tuple[bytes | None, bytes]:
    """The whole lines of data, without the last line end, and what begins after it."""
    end = data.rfind(b"\n")
    return (None, data) if end < 0 else (data[:end], data[end + 1 :])


def batches(lines: bytes, place: str) -> Iterator:
    """Record batches of lines of records, by record kind. What no column operation reads is decoded by itself: escapes, bad lines."""
    import pyarrow as pa
    import pyarrow.compute as pc

    schema = pa.schema([(c, pa.int32() if c in NUMBERS else pa.string()) for c in COLUMNS])
    every = pa.array(lines.decode().split("\n"), pa.string())
    hard = pc.match_substring(every, "\\")
    for record, names in FIELDS.items():
        mine = every.filter(pc.and_not(pc.starts_with(every, f"{record}\t"), hard))
        if not len(mine):
            continue
        n = 1 + len(names) + len(SPAN)
        fields = pc.split_pattern(mine, "\t")
        if not pc.all(pc.equal(pc.list_value_length(fields), n)).as_py():
            raise BadLine(f"{place}: no record of this form")
        flat = fields.flatten()
        at = lambda i: flat.take(pa.array(range(i, len(flat), n), pa.int64()))  # noqa: B023, E731
        nothing = pa.scalar(None, pa.string())
        held = {"record": at(0)}
        for i, name in enumerate(names, 1):
            held[name.rstrip("?")] = pc.if_else(pc.equal(at(i), NOTHING), nothing, at(i)) if name.endswith("?") else at(i)
        span = [at(i) for i in range(n - len(SPAN), n)]
        none = pc.equal(span[0], NOTHING)
        for other in span[1:]:
            none = pc.and_(none, pc.equal(other, NOTHING))
        held[SPAN[0]] = pc.if_else(none, nothing, span[0])
        try:
            held.update((c, pc.cast(pc.if_else(none, nothing, v), pa.int32())) for c, v in zip(NUMBERS, span[1:], strict=True))
        except pa.ArrowInvalid:
            raise BadLine(f"{place}: a bad escape or number") from None
        yield pa.RecordBatch.from_arrays([held.get(f.name, pa.nulls(len(mine), f.type)) for f in schema], schema=schema)
    known = pc.starts_with(every, "N\t")
    for record in list(FIELDS)[1:]:
        known = pc.or_(known, pc.starts_with(every, f"{record}\t"))
    others = every.filter(pc.or_(hard, pc.invert(known))).to_pylist()
    if others:
        rows = [decoded(line, place) for line in others]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def placed(lines: bytes, path: str, start: int) -> Iterator:
    """Their batches; if a line is bad, the error says at which byte of the file."""
    try:
        yield from batches(lines, path)
    except BadLine:
        for line in lines.split(b"\n"):
            decoded(line.decode(), f"{path} at byte {start}")
            start += len(line) + 1
        raise


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _names(fs, folder: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    return sorted(f.path for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.type == FileType.File)


def committed(fs, base: str) -> list[str]:
    """The files of a folder's commits, or all of its files if there are no commits."""
    commits = _names(fs, f"{base}/{COMMITS}")
    if not commits:
        return [p for p in _names(fs, base) if not p.rsplit("/", 1)[-1].startswith(("_", "."))]
    files: list[str] = []
    for path in commits:
        with fs.open_input_stream(path) as f:
            commit = json.loads(f.read())
        files = ([] if commit["replaces"] else files) + [f"{base}/{name}" for name in commit["files"]]
    return files


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        fs, base = filesystem(self.path)
        out = []
        for info in fs.get_file_info(committed(fs, base)):
            out += [Range(info.path, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator:
        """The lines that begin in the range, a record batch a block; the one that a range begins within is that of the range before."""
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            size = f.size()
            at = partition.start
            if at == 0:
                if f.read_at(len(HEADER) + 1, 0).decode(errors="replace") not in (HEADER, f"{HEADER}\n"):
                    raise BadLine(f"{partition.path}: another header")
                at = len(HEADER) + 1
                began = True
            else:
                began = f.read_at(1, at - 1) == b"\n"
            rest = b""
            while at < size and (at - len(rest) < partition.end or rest):
                block = f.read_at(BLOCK, at)
                place, data = at - len(rest), rest + block
                at += len(block)
                if not began:  # up to the first line end is another range's
                    cut = data.find(b"\n") + 1
                    if not cut:
                        rest = data
                        if place >= partition.end:
                            return
                        continue
                    place, data, began = place + cut, data[cut:], True
                if place >= partition.end:
                    return
                # the last line that begins in the range ends at the first line end from its last byte on
                last = data.find(b"\n", max(partition.end - place - 1, 0))
                whole, rest, done = (data[:last], b"", True) if last >= 0 else (*_cut_last(data), False)
                if whole is not None:
                    yield from placed(whole, partition.path, place)
                if done:
                    return
            if rest and began and size - len(rest) < partition.end:
                yield from placed(rest, partition.path, size - len(rest))


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    lines: int


def encoded_batch(batch) -> bytes:
    """A record batch's lines, in its order. What column operations can't write is encoded by itself: rows that lack something, texts to be escaped."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = {c: pc.cast(batch.column(c), pa.string()) for c in batch.schema.names}
    empty = pa.nulls(len(batch), pa.string())
    lines = empty
    span = [text[c] for c in SPAN]
    fit = pc.equal(*(pc.is_null(c) for c in span[:2]))
    for c in span[2:]:
        fit = pc.and_(fit, pc.equal(pc.is_null(span[0]), pc.is_null(c)))
    for record, names in FIELDS.items():
        values = [text[n.rstrip("?")] for n in names]
        mine = pc.and_(fit, pc.fill_null(pc.equal(text["record"], record), False))
        for v, n in zip(values, names, strict=True):
            if not n.endswith("?"):
                mine = pc.and_(mine, pc.is_valid(v))
        line = pc.binary_join_element_wise(record, *(pc.fill_null(v, NOTHING) for v in (*values, *span)), "\t")
        plain = pc.equal(pc.count_substring(line, "\t"), len(values) + len(span))
        plain = pc.and_not(plain, pc.match_substring_regex(line, r"[\\\n\r\x00]"))
        lines = pc.if_else(pc.and_(mine, plain), line, lines)
    out = lines.to_pylist()
    hard = pc.indices_nonzero(pc.is_null(lines))
    for i, row in zip(hard.to_pylist(), batch.take(hard).to_pylist(), strict=True):  # few as a rule
        out[i] = encoded(row)
    return ("\n".join(out) + "\n").encode()


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        """A file of this attempt alone, with a name that no other attempt has, of record batches; rows by themselves are taken too."""
        fs, base = filesystem(self.path)
        name, out, lines = f"facts-{uuid.uuid4().hex}.tsv", None, 0
        try:
            for part in rows:
                n = 1 if isinstance(part, Row) else len(part)
                if not n:
                    continue
                data = f"{encoded(part)}\n".encode() if isinstance(part, Row) else encoded_batch(part)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(f"{HEADER}\n".encode())
                out.write(data)
                lines += n
        finally:
            if out is not None:
                out.close()
        return Written(name if lines else None, lines)

    def commit(self, messages: list[Written | None]) -> None:
        """One more commit, which names the files of the attempts that succeeded; moved into place once it is whole."""
        fs, base = filesystem(self.path)
        fs.create_dir(f"{base}/{COMMITS}", recursive=True)
        done = [m for m in messages if m is not None and m.name]
        commit = {"replaces": self.overwrite, "files": [m.name for m in done], "lines": sum(m.lines for m in done)}
        draft = f"{base}/_draft-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(commit).encode())
        fs.move(draft, f"{base}/{COMMITS}/{len(_names(fs, f'{base}/{COMMITS}')):08d}-{uuid.uuid4().hex}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{base}/{m.name}")


class FactLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fact-lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write_facts(facts: DataFrame, path: str, mode: str = "append") -> None:
    """facts, with what they lack of COLUMNS as nulls, each file in the canonical order: nodes, edges, gaps, by their fields."""
    from pyspark.sql import functions as F

    spark = facts.sparkSession
    spark.dataSource.register(FactLines)
    place = F.when(F.col("record") == "N", 0).when(F.col("record") == "E", 1).otherwise(2)
    whole = facts.select(*((F.col(c) if c in facts.columns else F.lit(None)).cast("int" if c in NUMBERS else "string").alias(c) for c in COLUMNS))
    order = [place, *(c for c in COLUMNS if c != "record")]
    whole.repartitionByRange(*order).sortWithinPartitions(*order).write.format("fact-lines").option("path", path).mode(mode).save()


def read_facts(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(FactLines)
    return spark.read.format("fact-lines").option("path", path).option("split", split).load()
