"""CSV whose quoted fields may span lines, read by many tasks per file.

A line break belongs to a field if an odd number of quotes stands before it in the file. A first pass counts the quotes of every
byte range; sums over the ranges before it tell whether a range begins inside a field. A second pass then cuts the lines
of each range into records. The few pieces of records that cross ranges are put together by their place in the file.
"""

import pyarrow as pa
from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from commentlake.operators.scale import join_checked
from commentlake.session import materialize

MAX_HEADERS = 1000
RECORD, TAIL, PIECE = 0, 1, 2
SPLIT = ["_file", "_block"]


def _lines(spark, path):
    """Physical lines with their file, the first byte of their range, their number of quotes and a number that grows along a range."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes")) \
        .withColumn("_seq", F.monotonically_increasing_id())


def _cut(batches):
    """Lines of ranges, in file order, to records; the pieces of a record that crosses ranges are marked."""
    names = ["_file", "_block", "_seq", "_kind", "value"]
    key, inside, held, kind, first = None, False, [], RECORD, 0
    rows = []

    def close(last):
        if held:
            done = kind if kind == PIECE else TAIL if last and inside else RECORD
            rows.append((*key, first, done, "\n".join(held)))
            held.clear()

    def batch_of(some):
        columns = list(zip(*some))
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())], names=names)
    for batch in batches:
        odd = batch.column("_quotes").to_numpy() % 2 == 1
        for file, block, seq, value, turns, begins in zip(
                *[batch.column(c).to_pylist() for c in ("_file", "_block", "_seq", "value")], odd.tolist(), batch.column("_inside").to_pylist()):
            if (file, block) != key:
                close(True)
                key, inside = (file, block), begins
                kind = PIECE if begins else RECORD
            elif not inside:
                close(False)
                kind = RECORD
            if not held:
                first = seq
            held.append(value)
            inside ^= turns
        if len(rows) >= 4096:
            yield batch_of(rows)
            rows = []
    if key is not None:
        close(True)
    for lo in range(0, len(rows), 4096):
        yield batch_of(rows[lo:lo + 4096])


def read_records(spark, path):
    """(_file, _seq, value): one row per record of the CSV files, header included; and the files' first lines as (_file, _first,
    _header), where _first is the header's _seq."""
    lines = _lines(spark, path)
    top = F.col("_block") == 0
    ranges = lines.groupBy(*SPLIT).agg(
        F.sum("_quotes").alias("q"), F.max(F.col("_quotes") % 2).alias("odd"),
        F.min(F.when(top, F.struct("_seq", "value"))).alias("h"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(ranges.withColumn("_inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1))
    headers = ranges.where(top).select("_file", F.col("h._seq").alias("_first"), F.col("h.value").alias("_header"))
    if ranges.where("odd = 1").isEmpty():  # no field spans lines: every line is a record
        return lines.select("_file", "_seq", "value"), headers
    marked = join_checked(lines, ranges.select(*SPLIT, "_inside"), SPLIT, "inner")
    pieces = marked.select("_file", "_block", "_seq", "value", "_quotes", "_inside").mapInArrow(
        _cut, "_file string, _block long, _seq long, _kind int, value string")
    # What crosses ranges: the open end of one, whole middles, and the beginning of the range where it closes.
    order = Window.partitionBy("_file").orderBy("_block", F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    crossing = pieces.where(F.col("_kind") != RECORD).withColumn(
        "_start", F.last(F.when(F.col("_kind") == TAIL, F.col("_block")), ignorenulls=True).over(order))
    joined = crossing.groupBy("_file", "_start").agg(F.array_sort(F.collect_list(F.struct("_block", "value"))).alias("_p")).select(
        "_file", F.lit(-1).cast("long").alias("_seq"), F.array_join(F.transform("_p", lambda p: p["value"]), "\n").alias("value"))
    return pieces.where(F.col("_kind") == RECORD).select("_file", "_seq", "value").unionByName(joined), headers


def read_csv(spark, path):
    """All columns as strings, taken by each file's own header; a column that a file lacks is null there.

    Blank lines are skipped, a byte order mark is dropped, records may be short or long. Raises for no files, for a header that
    spans lines and for more than 1,000 different headers.
    """
    records, headers = read_records(spark, path)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    lines = [r[0] for r in headers.select("_header").distinct().limit(MAX_HEADERS + 1).collect()]
    if not lines or len(lines) > MAX_HEADERS:
        raise ValueError(f"{'no' if not lines else 'more than ' + str(MAX_HEADERS)} headers in {path}")
    if any(x.count('"') % 2 for x in lines):
        raise ValueError("a header spans lines")
    names = {line: _fields(spark, line, options) for line in lines}
    width = max(map(len, names.values()))
    columns = list(dict.fromkeys(c for n in names.values() for c in n))
    body = join_checked(records.where(F.trim("value") != ""), headers, "_file", "inner").where("_seq <> _first")
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    parsed = body.select("_header", F.from_csv(F.regexp_replace("value", "\r$", ""), schema.simpleString()[7:-1].replace(":", " "), options).alias("_r"))
    out = []
    for c in columns:
        places = [(line, n.index(c)) for line, n in names.items() if c in n]
        if len(lines) == 1:
            value = F.col(f"_r._{places[0][1]}")
        else:
            value = F.coalesce(*[F.when(F.col("_header") == line, F.col(f"_r._{i}")) for line, i in places])
        out.append(value.alias(c))
    return parsed.select(*out)


def _fields(spark, line, options):
    """The column names of a header line."""
    text = line.removeprefix("﻿").removesuffix("\r")
    schema = ", ".join(f"_{i} string" for i in range(text.count(",") + 1))
    row = spark.range(1).select(F.from_csv(F.lit(text), schema, options).alias("r")).first().r
    names = [v for v in row]
    while names and names[-1] is None:
        names.pop()
    return [n if n is not None else f"_c{i}" for i, n in enumerate(names)]
