"""Bottom-k fingerprints: the k least hashes of a text's shingles, mergeable, for resemblance, containment and counts."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from commentlake.llm.hashing import _BACKWARD, _BASE, _BYTE, _FORWARD, FOLD, SEGMENT, mix64, runs, text_buffer
from commentlake.session import materialize

K = 128
WIDTH = 9
_TABLE = _BYTE[FOLD]
MAX_BUCKETS = 100_000
LAST_ID = 2 ** 63 - 1
HASH_BITS = 31


def shingle_hashes(data, width=WIDTH):
    """Hash of every `width` consecutive bytes, A-Z lowered; the place of the hash is that of its first byte."""
    out = []
    for lo in range(0, max(0, len(data) - width + 1), SEGMENT - width):
        part = data[lo:lo + SEGMENT - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * _FORWARD[:len(part)], out=sums[1:])
        n = len(part) - width + 1
        if n > 0:
            out.append(mix64((sums[width:] - sums[:n]) * _BACKWARD[:n])[:SEGMENT - width])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _whole(data):
    """A text shorter than a shingle is one shingle; an empty one has none."""
    if len(data) == 0:
        return np.zeros(0, np.uint64)
    value = (_TABLE[data] * _FORWARD[:len(data)]).sum(dtype=np.uint64)
    return mix64(np.array([value + np.uint64(len(data)) * _BASE]))


def bottom(hashes, k=K):
    """The k least distinct hashes, sorted."""
    if len(hashes) > 4 * k:
        least = np.unique(np.partition(hashes, 2 * k)[:2 * k + 1])
        if len(least) >= k:
            return least[:k]
    return np.unique(hashes)[:k]


def sketch(text, k=K):
    data = np.frombuffer(text.encode(), np.uint8)
    return bottom(shingle_hashes(data) if len(data) >= WIDTH else _whole(data), k)


def to_text(least):
    return base64.b64encode(least.astype(">u8").tobytes()).decode()


def from_text(fingerprint):
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def merge(x, y, k=K):
    """The sketch of the union of the texts' shingles."""
    return bottom(np.concatenate((x, y)), k)


def resemblance(x, y, k=K):
    """Estimated intersection over union; exact when both sketches hold all shingles. Two empty texts are equal."""
    least = merge(x, y, k)
    if len(least) == 0:
        return 1.0
    return float(len(np.intersect1d(np.intersect1d(x, y, True), least, True)) / len(least))


def distinct_count(x, k=K):
    """Estimated number of distinct shingles; exact below k."""
    return float(len(x)) if len(x) < k else (k - 1) / ((int(x[k - 1]) + 1) / 2.0 ** 64)


def containment(x, y, k=K):
    """Estimated share of x's shingles that y has too."""
    if len(x) == 0:
        return 1.0
    union = distinct_count(merge(x, y, k), k)
    return min(1.0, resemblance(x, y, k) * union / distinct_count(x, k))


class _Row:
    """One text with its shingle hashes, code point starts and sketch."""

    __slots__ = ("doc_id", "data", "hashes", "points", "least", "chars")

    def __init__(self, doc_id, data, hashes, k):
        self.doc_id, self.data, self.hashes = doc_id, data, hashes
        starts = (data & 0xC0) != 0x80
        self.chars = int(np.count_nonzero(starts))
        self.points = None if self.chars == len(data) else np.flatnonzero(starts)
        self.least = bottom(hashes if len(data) >= WIDTH else _whole(data), k)

    def byte(self, chars):
        if chars >= self.chars:
            return len(self.data)
        return chars if self.points is None else int(self.points[chars])


def _edited(row, following, k):
    """Bytes and sketch of the row's text with its last half replaced by the beginning of the following text."""
    half = row.chars // 2
    a, b = row.byte(row.chars - half), following.byte(min(half, following.chars))
    data = np.concatenate((row.data[:a], following.data[:b]))
    if len(data) < WIDTH:
        return data, bottom(_whole(data), k)
    seam = shingle_hashes(data[max(0, a - WIDTH + 1):a + WIDTH - 1])
    own, other = row.hashes[:max(0, a - WIDTH + 1)], following.hashes[:max(0, b - WIDTH + 1)]
    return data, bottom(np.concatenate((own, seam, other)), k)


def _pair_batches(k):
    """Sorted rows (bucket, tail, doc_id, text) to a row per document that is not a tail."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(row, following):
        data, least = _edited(row, following, k)
        return (row.doc_id, row.chars, hashlib.sha256(data.tobytes()).hexdigest(), to_text(row.least), to_text(least),
                resemblance(row.least, least, k), resemblance(row.least, following.least, k))

    def flush(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 7, types)], names)

    def run(batches):
        first = pending = bucket = None
        for batch in batches:
            done = []
            buckets, tails, ids = (batch.column(i).to_pylist() for i in range(3))
            data, offsets = text_buffer(batch.column(3))
            for i, j in runs(offsets):
                hashes = shingle_hashes(data[offsets[i]:offsets[j]])
                for r in range(i, j):
                    lo, hi = offsets[r], offsets[r + 1]
                    own = hashes[lo - offsets[i]:max(lo, hi - WIDTH + 1) - offsets[i]]
                    row = _Row(ids[r], data[lo:hi], own, k)
                    if buckets[r] != bucket:
                        if pending is not None:
                            done.append(result(pending, first))
                        bucket, first, pending = buckets[r], row, None
                    if pending is not None:
                        done.append(result(pending, row))
                    pending = None if tails[r] else row
            yield flush(done)
        if pending is not None:
            yield flush([result(pending, first)])
    return run


def _ordered(docs, n):
    """Rows with `_b`, dealt so that ascending ids lie in ascending buckets, and a copy of each bucket's first row as the tail
    of the bucket before (of the last one for the first).

    An id that holds several buckets' share of the rows is several of the cut points; its rows are dealt over as many buckets by
    the hash of their text. The cut points, at most MAX_BUCKETS longs, are the only thing the driver sees.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)),
                             "_h": F.shiftrightunsigned(F.xxhash64("text"), 64 - HASH_BITS)})
    wanted = max(1, min(MAX_BUCKETS, max(parts, n // 20_000)))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = sorted(rows.agg(F.percentile_approx("_k", shares, 20 * wanted)).first()[0] or []) if shares else []
    if cuts:
        steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(cuts).bit_length()))])
        table = F.array(*[F.lit(int(c)).cast("long") for c in cuts])

        def cuts_that(lie):
            return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
                (at + s <= len(cuts)) & lie(F.get(table, at + s - 1)), at + s).otherwise(at))
        rows = rows.withColumns({"_to": cuts_that(lambda c: c <= F.col("_k")), "_from": cuts_that(lambda c: c < F.col("_k"))})
        own = F.shiftright(F.col("_h") * (F.col("_to") - F.col("_from")), HASH_BITS)  # among the buckets of the id
        bucket = F.when(F.col("_to") > F.col("_from"), F.col("_from") + 1 + own).otherwise(F.col("_to"))
    else:
        bucket = F.lit(0)
    rows = rows.select(bucket.cast("int").alias("_b"), "_k", "_h", "doc_id", "text")
    heads = materialize(rows.groupBy("_b").agg(F.min(F.struct("_k", "_h")).alias("_head")))
    before = F.lag("_b").over(Window.orderBy("_b"))
    last = heads.agg(F.max("_b")).scalar()
    heads = heads.select(F.col("_head._k").alias("_k"), F.col("_head._h").alias("_h"), F.coalesce(before, last).alias("_before"))
    rows = rows.join(F.broadcast(heads), ["_k", "_h"], "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("tail"))
    tail = F.struct(F.col("_before").alias("b"), F.lit(1).alias("tail"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, tail))))
    return rows.select(F.col("_at.b").alias("_b"), F.col("_at.tail").alias("_tail"), "_k", "_h", "doc_id", "text") \
        .repartition(max(parts, len(cuts) + 1), "_b").sortWithinPartitions("_b", "_tail", "_k", "_h", "text") \
        .select("_b", "_tail", "doc_id", "text")


def fingerprint_neighbours(docs, k=K):
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the beginning of the next document's text, by
    ascending doc_id, the first after the last. Shingles are WIDTH bytes with A-Z lowered; a shorter text is one shingle.

    Null texts are empty; an empty text has an empty fingerprint and is like another empty text only. A null doc_id counts as the
    largest long; equal ids are ordered by the hash of their text, then by the text; a single row is its own next one; no rows
    give no rows. Other columns are not read.

    Scale: texts are shuffled once, in ranges of ids; the rows of an often repeated id are dealt over several tasks by their text.
    Copies of one row, id and text, lie in one range.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _ordered(docs, docs.count()).mapInArrow(
        _pair_batches(k), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _sketch_rows(k):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            data, offsets = text_buffer(texts)
            out = []
            for i, j in runs(offsets):
                hashes = shingle_hashes(data[offsets[i]:offsets[j]])
                for r in range(i, j):
                    lo, hi = offsets[r] - offsets[i], offsets[r + 1] - offsets[i]
                    own = hashes[lo:max(lo, hi - WIDTH + 1)]
                    out.append(to_text(bottom(own if hi - lo >= WIDTH else _whole(data[offsets[r]:offsets[r + 1]]), k)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["part", "fingerprint"])
    return run


def _merge_rows(k, keys_at_once):
    """Merges the sketches of equal parts among the rows of a task; parts beyond `keys_at_once` are passed on as they are."""
    def flush(held):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([to_text(v) for v in held.values()], pa.string())], ["part", "fingerprint"])

    def run(batches):
        held = {}
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                other = from_text(text)
                if part not in held and len(held) >= keys_at_once:
                    yield flush(held)
                    held = {}
                held[part] = merge(held[part], other, k) if part in held else other
        if held:
            yield flush(held)
    return run


def part_sketches(docs, part, k=K, keys_at_once=10_000):
    """(part, fingerprint): one sketch per value of the column, merged in three steps so that a hot part is no hot task."""
    schema = "part string, fingerprint string"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(part).cast("string").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    once = rows.mapInArrow(_sketch_rows(k), schema).mapInArrow(_merge_rows(k, keys_at_once), schema)
    salted = once.withColumn("_salt", F.spark_partition_id() % 32).repartition(parts, "part", "_salt").drop("_salt")
    twice = salted.mapInArrow(_merge_rows(k, keys_at_once), schema)
    return twice.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_rows(k, 1), schema)
