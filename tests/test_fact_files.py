"""Fact files: round trips, ranges, commits, failed attempts, bad lines."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairnwork.sources import fact_files as ff

ROWS = [
    ("N", "k1", None, "function", None, "a.go", "na\tme", "q\\n", "c1", None, None, None, None, "a.go", 1, 2, 3, 4),
    ("N", "k2", None, "file", "id\n\r\0", "ü/é.go", "", "\\", None, None, None, None, None, None, None, None, None, None),
    ("E", "k1", "k2", "calls", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("U", "k1", None, "calls", None, None, None, None, None, "external", "x.y()", None, "y", "a.go", 9, 0, 9, 7),
]


def rows(df):
    return sorted((tuple(r) for r in df.select(*ff.COLUMNS).collect()), key=str)


@pytest.fixture
def facts(spark):
    return spark.createDataFrame(ROWS, ff.SCHEMA)


def test_round_trip_in_ranges_of_any_size(spark, facts, tmp_path):
    many = facts.unionByName(spark.range(300).select(F.lit("E").alias("record"), F.concat(F.lit("n"), "id").alias("key"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("target"), F.lit("calls").alias("kind")), allowMissingColumns=True)
    ff.write_facts(many, str(tmp_path / "x"))
    for split in (7, 64, 1000, 1 << 20):
        assert rows(ff.read_facts(spark, str(tmp_path / "x"), split)) == rows(many)


def test_files_hold_the_canonical_order(spark, facts, tmp_path):
    ff.write_facts(facts.coalesce(1), str(tmp_path / "x"))
    names = ff.committed(*ff.filesystem(str(tmp_path / "x")))
    lines = [x for n in names for x in open(n, newline="").read().removesuffix("\n").split("\n")[1:]]
    assert [x[0] for x in lines] == ["N", "N", "E", "U"]
    assert lines[2] == "E\tk1\tk2\tcalls\t-\t-\t-\t-\t-" and "na\\tme" in lines[0] and "id\\n\\r\\0" in lines[1]


def test_append_and_overwrite(spark, facts, tmp_path):
    path = str(tmp_path / "x")
    ff.write_facts(facts, path)
    ff.write_facts(facts.filter("record = 'E'"), path)
    assert len(rows(ff.read_facts(spark, path))) == 5
    ff.write_facts(facts.filter("record = 'U'"), path, mode="overwrite")
    assert rows(ff.read_facts(spark, path)) == [ROWS[3]]
    ff.write_facts(facts.limit(0), path)
    assert rows(ff.read_facts(spark, path)) == [ROWS[3]]


def test_what_failed_attempts_leave_is_not_read(spark, facts, tmp_path):
    path = str(tmp_path / "x")
    ff.write_facts(facts, path)
    bad = spark.range(4, numPartitions=2).select(F.when(F.col("id") < 3, "E").otherwise("?").alias("record"), F.lit("a").alias("key"), F.lit("b").alias("target"), F.lit("calls").alias("kind"))
    with pytest.raises(Exception, match="no record is called"):
        ff.write_facts(bad, path)
    assert rows(ff.read_facts(spark, path)) == rows(facts)
    writer = ff.Writer(path, False)  # an attempt that is repeated: its first file is in no commit
    edge = spark.createDataFrame([ROWS[2]], ff.SCHEMA).collect()
    lost, kept = writer.write(iter(edge)), writer.write(iter(edge))
    assert {lost.name, kept.name} <= set(os.listdir(path))
    writer.commit([kept, None])
    assert len(rows(ff.read_facts(spark, path))) == 5
    gone = writer.write(iter(edge))
    writer.abort([gone, None])
    assert gone.name not in os.listdir(path)


def test_files_from_elsewhere_and_bad_lines(spark, tmp_path):
    folder = tmp_path / "y"
    folder.mkdir()
    (folder / "one.tsv").write_text("version\t4\nE\ta\tb\tcalls\t-\t-\t-\t-\t-")
    assert [r.target for r in ff.read_facts(spark, str(folder)).collect()] == ["b"]
    for text, said in (("version\t9\n", "another header"), ("version\t4\nX\ta\n", "at byte 10"), ("version\t4\nE\ta\tb\tc\t-\t-\t1\t-\t-\n", "bad escape or number"), ("version\t4\nE\ta\\q\tb\tc\t-\t-\t-\t-\t-\n", "bad escape")):
        (folder / "one.tsv").write_text(text)
        with pytest.raises(Exception, match=said):
            ff.read_facts(spark, str(folder)).collect()
    assert ff.read_facts(spark, str(tmp_path / "none")).count() == 0


def test_records_are_read_in_batches(tmp_path):
    """A block gives a record batch a kind, not a row at a time; blocks and ranges that cut lines lose and repeat none."""
    lines = [ff.encoded(Row(**dict(zip(ff.COLUMNS, r, strict=True)))) for r in ROWS * 40]
    (tmp_path / "a.tsv").write_text("\n".join([ff.HEADER, *lines]), newline="")
    whole = list(ff.Reader(str(tmp_path), 1 << 20).read(ff.Range(str(tmp_path / "a.tsv"), 0, 1 << 20)))
    assert len(whole) == 4 and sum(b.num_rows for b in whole) == 160  # N, E, U and those with escapes
    expected = sorted(ROWS * 40, key=str)
    block = ff.BLOCK
    try:
        for ff.BLOCK in (5, 64, 1000):
            for split in (3, 50, 777):
                reader = ff.Reader(str(tmp_path), split)
                got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
                assert sorted(got, key=str) == expected
    finally:
        ff.BLOCK = block
