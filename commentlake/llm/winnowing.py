"""Benchmark decontamination by winnowing: fingerprints meet, hits are extended, covered words are counted."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.hashing import ALNUM, grams, hash_words, runs, signed, text_buffer
from commentlake.llm.staging import fresh
from commentlake.session import materialize

SHORT = 1 << 20  # seed offset that keeps the hashes of short items apart


def _selected(g, starts, ends, window):
    """Places of the rightmost least hash of every `window` consecutive grams of one row."""
    if len(g) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    at = np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(1)
    inside = np.zeros(len(view), bool)
    for s, e in zip(starts, ends):
        inside[s:max(s, e)] = True
    return np.unique(at[inside])


def _anchors(words, at, gram, length, lengths, passes):
    """Anchors of rows whose words begin at `at`: (row, hash, gram length, place in the row, words around it).

    Rows of `length` words or more are winnowed with windows of length - gram + 1 grams; for every shorter length asked for,
    all grams of that many words are taken. `passes` tells which hashes are wanted.
    """
    window = length - gram + 1
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = []
    g = grams(words, gram)
    places = _selected(g, at[:-1], at[1:] - length + 1, window)
    places = places[passes(g[places])] if len(places) else places
    if len(places):
        row = row_of[places]
        where = places[:, None] + np.arange(gram - length, length)[None, :]
        inside = (where >= at[row][:, None]) & (where < at[row + 1][:, None])
        context = np.where(inside, words[np.clip(where, 0, len(words) - 1)], 0)
        out.append((row, g[places], gram, places - at[row], context))
    for n in lengths:
        s = grams(words, n, SHORT)
        if not len(s):
            continue
        places = np.flatnonzero((row_of[:len(s)] == row_of[n - 1:]) & passes(s))
        if len(places):
            row = row_of[places]
            context = words[places[:, None] + np.arange(n)[None, :]]
            out.append((row, s[places], -n, places - at[row], context))
    return out


ANCHORS = "array<struct<hash:long,size:int,place:int,around:array<long>>>"


def _as_lists(found, n):
    """Arrow list column with a row's anchors, for n rows."""
    if found:
        row = np.concatenate([f[0] for f in found])
        order = np.argsort(row, kind="stable")
        sizes = np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found])
        widths = np.concatenate([np.full(len(f[0]), f[4].shape[1], np.int64) for f in found])
        flat = np.concatenate([f[4].reshape(-1) for f in found])
        begin = np.concatenate(([0], np.cumsum(widths)[:-1]))[order]
        w = widths[order]
        ends = np.cumsum(w)
        take = np.repeat(begin - (ends - w), w) + np.arange(ends[-1])
        around = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(signed(flat[take])))
        hashes = np.concatenate([f[1] for f in found])[order]
        places = np.concatenate([f[3] for f in found])[order].astype(np.int32)
        counts = np.bincount(row, minlength=n)
        items = pa.StructArray.from_arrays([pa.array(signed(hashes)), pa.array(sizes[order]), pa.array(places), around],
                                           ["hash", "size", "place", "around"])
    else:
        counts = np.zeros(n, np.int64)
        items = pa.StructArray.from_arrays(
            [pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.int64()))],
            ["hash", "size", "place", "around"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), items)


def _anchor_batches(gram, length, lengths, bitmap):
    """Batches (key columns ..., text) to (key columns ..., n_words, anchors)."""
    def passes(h):
        if bitmap is None:
            return np.ones(len(h), bool)
        bits, shift = bitmap.value
        place = h >> np.uint64(shift)
        return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            n_words, at_row, found = [], 0, []
            for i, j in runs(offsets):
                words, at = hash_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ALNUM)
                n_words.append(np.diff(at))
                if len(words):
                    own = lengths if bitmap is not None else [n for n in range(1, length) if n in set(n_words[-1].tolist())]
                    for row, *rest in _anchors(words, at, gram, length, own, passes):
                        keep = np.ones(len(row), bool)
                        if bitmap is None and rest[1] < 0:  # an item is a window of its own only at its full length
                            keep = n_words[-1][row] == -rest[1]
                        if keep.any():
                            found.append((row[keep] + i, rest[0][keep], rest[1], rest[2][keep], rest[3][keep]))
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts.astype(np.int64)), _as_lists(found, batch.num_rows)],
                [*batch.schema.names[:-1], "n_words", "anchors"])
    return run


def _bitmap(spark, hashes, bits):
    """A bitmap of 2^bits places for the hashes; its size does not depend on the input. Sent to the tasks once."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = hashes.select(place.alias("_p")).distinct().select(
        F.shiftright("_p", 6).alias("w"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("b"))
    table = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["w"].to_numpy(np.int64)] = table["b"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast((out, 64 - bits))


def _reach(length, gram, doc, item):
    """Words that agree to the left and to the right of the gram, as far as a window of `length` words can go."""
    side = length - gram
    same = F.zip_with(doc, item, lambda a, b: (a == b) & (a != 0))

    def run(steps):
        expr = F.lit(len(steps))
        for k, i in reversed(list(enumerate(steps))):
            expr = F.when(~F.element_at("_same", i + 1), k).otherwise(expr)
        return expr
    return same, run(range(side - 1, -1, -1)), run(range(side + gram, 2 * side + gram))


def leaks(docs, benchmark, gram=5, length=10, filter_bits=24):
    """(doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated), a row per document.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lowered. A window is `length`
    consecutive words of an item, or a whole shorter item; `n_hit` counts the document words inside any occurrence of a
    window, `spans` holds the shared stretches (first word, end) and `item_ids` the sorted ids of the items, as strings.

    Method: every `gram`-word hash that is least among length - gram + 1 neighbours is a fingerprint, on both sides, so a
    shared run of `length` words always has one in common. Fingerprints of documents that no item can have are dropped
    by a bitmap of fixed size; the others are joined on the hash and extended word by word. Items shorter than `length` words
    are found by all grams of their own length, which is winnowing with a window of one.

    Null texts have no words. Items without words or with a null id match nothing; items that share an id are one item. Rows
    that repeat a doc_id are judged by their own text. No documents give no rows, no items give zero hits. Other columns are
    not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("item_id is not null")
    items = materialize(items.mapInArrow(_anchor_batches(gram, length, [], None), f"item_id string, n_words long, anchors {ANCHORS}")
                        .select("item_id", F.inline("anchors")))
    lengths = sorted(-r["size"] for r in items.where("size < 0").select("size").distinct().collect())
    bitmap = _bitmap(spark, items, filter_bits)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = materialize(rows.mapInArrow(_anchor_batches(gram, length, lengths, bitmap),
                                       f"doc_id long, text_key long, n_words long, anchors {ANCHORS}"))
    key = ["doc_id", "text_key"]
    hits = rows.where(F.size("anchors") > 0).dropDuplicates(key).select(*key, F.inline("anchors"))
    wanted = items.groupBy("hash", "size", F.col("around").alias("item_around")).agg(F.collect_set("item_id").alias("items"))
    same, left, right = _reach(length, gram, F.col("around"), F.col("item_around"))
    side = length - gram
    met = hits.join(wanted, ["hash", "size"]).withColumn("_same", same)
    core = F.forall(F.slice("_same", side + 1, gram), lambda x: x)
    long_hits = met.where("size > 0").where(core).withColumn("_l", left).withColumn("_r", right) \
        .where(F.col("_l") + F.col("_r") + gram >= length) \
        .select(*key, "items", (F.col("place") - F.col("_l")).alias("start"), (F.col("place") + gram + F.col("_r")).alias("end"))
    short_hits = met.where("size < 0").where(F.forall("_same", lambda x: x)) \
        .select(*key, "items", F.col("place").alias("start"), (F.col("place") - F.col("size")).alias("end"))
    found = long_hits.unionByName(short_hits)
    spans = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    names = found.select(*key, F.explode("items").alias("item")).groupBy(*key).agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"))
    spans = spans.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_t")
    names = names.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_t")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))
    out = rows.select(*key, "n_words").join(spans, on, "left").drop("_d", "_t").join(names, on, "left")
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"))

    def cover(acc, s):
        return F.struct((acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("hit"),
                        F.greatest(acc["to"], s["end"]).alias("to"))
    n_hit = F.coalesce(F.aggregate("spans", zero, cover)["hit"], F.lit(0)).cast("long")
    empty = F.expr("cast(array() as array<string>)")
    return out.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", empty).alias("item_ids"), "spans", (n_hit > 0).alias("contaminated"))


def clean_documents(docs, benchmark, **options):
    """The documents without a shared window, with all their columns; rows of one doc_id and text stay or go together."""
    d, t = fresh(docs, "_d", "_t")
    bad = leaks(docs, benchmark, **options).where("contaminated").select(
        F.col("doc_id").alias(d), F.col("text_key").alias(t)).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    return docs.join(bad, on, "left_anti")
