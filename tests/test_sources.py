"""CSV by byte ranges against the one-task reader."""

import random

import pytest

from commentlake.sources.comments import read_comments
from commentlake.sources.csv_records import read_csv, read_records


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


def test_records_cut_by_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    pieces = ["a", " ", "\n", '"', ",", "é😀", "\r\n", "word", "\n\n"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows[50] = (50, "long\n" * 500)  # a record over several ranges
    rows[51] = (51, '"\n"' * 40)
    with open(tmp_path / "a.csv", "w", newline="") as f:
        f.write("id,text,username\n" + "".join(f"{i},{quoted(t)},u{i}\n" for i, t in rows))
    records, _ = read_records(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20 and records.count() == 401
    got = {int(r["id"]): (r["text"], r["username"]) for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == {i: (t or None, f"u{i}") for i, t in rows}
    plain = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    assert sorted(plain.collect(), key=str) == sorted(read_csv(spark, str(tmp_path)).collect(), key=str)


def test_columns_go_by_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,username\n1,"x, y",u1\n\n2,,u2\n')
    (tmp_path / "b.csv").write_text('﻿id,username,text,extra\r\n3,u3,"two\r\nlines",e\r\n4,u4\r\n')
    (tmp_path / "c.csv").write_text("")
    got = {r["id"]: (r["text"], r["username"], r["extra"]) for r in read_csv(spark, str(tmp_path)).collect()}
    assert got == {"1": ("x, y", "u1", None), "2": (None, "u2", None), "3": ("two\r\nlines", "u3", "e"), "4": (None, "u4", None)}
    typed = {r["id"]: r["text"] for r in read_comments(spark, str(tmp_path)).collect()}
    assert typed == {1: "x, y", 2: None, 3: "two\r\nlines", 4: None}
    with pytest.raises(ValueError, match="missing required"):
        read_comments(spark, str(tmp_path), required=("label",))
