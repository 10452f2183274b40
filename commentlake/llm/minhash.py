"""Near-duplicate documents by min-max hashing: sketches propose pairs, full shingle sets confirm them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.components import components
from commentlake.llm.hashing import hash_words, mix64, runs, seeds, shingle_set, signed, text_buffer
from commentlake.llm.staging import fresh, staged
from commentlake.operators.scale import global_position

BLOCK = 4096  # members of a residual bucket compared with each other at a time
BINS = 1024  # places of the second sketch, four bits each, which tells near pairs from the threshold before texts are fetched
CHUNK = 4096  # shingles hashed at a time


def signatures(shingles, a, b):
    """Minimum and maximum of every hash function over the shingles: twice as many values as evaluations."""
    low = np.full(len(a), ~np.uint64(0))
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), CHUNK):
        values = shingles[at:at + CHUNK, None] * a + b
        values ^= values >> np.uint64(29)
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    return np.concatenate((low, high))


def _sketch_batches(shingle, bands, rows):
    """Arrow batches (doc_id, text) to (doc_id, n_shingles, set_lo, set_hi, bands)."""
    half = bands * rows // 2
    a, b = seeds(half, 11), seeds(half, 12)
    weights = seeds(rows, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            n = len(offsets) - 1
            size = np.zeros(n, np.int64)
            low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            keys = np.zeros((n, bands), np.uint64)
            for i, j in runs(offsets):
                words, at = hash_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for r in range(i, j):
                    s = shingle_set(words[at[r - i]:at[r - i + 1]], shingle)
                    size[r] = len(s)
                    if len(s):
                        low[r] = np.bitwise_xor.reduce(s * a[0]) ^ np.uint64(len(s))
                        high[r] = np.add.reduce((s ^ (s >> np.uint64(31))) * a[1])
                        keys[r] = (signatures(s, a, b).reshape(bands, rows) * weights).sum(1)
            keys = mix64(keys + np.arange(bands, dtype=np.uint64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(signed(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(signed(low)), pa.array(signed(high)), lists],
                ["doc_id", "n_shingles", "set_lo", "set_hi", "bands"])
    return run


def _sketches(docs, shingle, bands, rows):
    return docs.mapInArrow(
        _sketch_batches(shingle, bands, rows),
        "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>")


def _comparable(percent):
    """No pair of sets whose sizes differ by more can reach the threshold."""
    return F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")


def _confirm_batches(shingle, percent):
    def run(batches):
        for batch in batches:
            sets = []
            for column in (2, 3):
                data, offsets = text_buffer(batch.column(column))
                own = []
                for i, j in runs(offsets):
                    words, at = hash_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    own += [shingle_set(words[at[r]:at[r + 1]], shingle) for r in range(j - i)]
                sets.append(own)
            keep = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(*sets)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def texts_of(ids, docs, filter_bits=20):
    """(doc_id, text) of the wanted ids, each text once.

    A semi join with the hash places of the ids, at most 2^filter_bits rows whatever the input, keeps most other texts
    from being shuffled for the exact join.
    """
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(1 << filter_bits))
    wanted = F.broadcast(ids.select(place("doc_id").alias("_p")).distinct())
    texts = docs.select("doc_id", "text").where("doc_id is not null").join(wanted, place("doc_id") == F.col("_p"), "left_semi")
    texts = texts.join(ids, "doc_id", "left_semi")
    return texts.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")


def one_permutation(shingles):
    """Four bits per bin of the hash range, from the bin's least shingle; 0 where a bin is empty. Two bins share a byte."""
    out = np.zeros(BINS, np.uint8)
    place, first = np.unique(shingles // np.uint64((1 << 64) // BINS), return_index=True)
    out[place.astype(np.int64)] = (shingles[first] & np.uint64(0xFFFF)) % np.uint64(15) + np.uint64(1)
    return out[::2] << 4 | out[1::2]


def _second_sketch_batches(shingle):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for i, j in runs(offsets):
                words, at = hash_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                out += [one_permutation(shingle_set(words[at[r]:at[r + 1]], shingle)).tobytes() for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["rep", "sketch"])
    return run


def likeness(x, y):
    """Share of equal bins among those that either sketch fills, row by row. Its mean is the resemblance J, plus up to
    (1 - J) / 15 for values that are equal by chance; its standard error sqrt(J (1 - J) / BINS) at most."""
    same, filled = 0, 0
    for mask in (0xF0, 0x0F):
        u, v = x & mask, y & mask
        same, filled = same + ((u == v) & (u > 0)).sum(1), filled + ((u | v) > 0).sum(1)
    return same / np.maximum(filled, 1)


def confirm(pairs, docs, shingle, percent, filter_bits=20):
    """The pairs (a, b) whose full shingle sets reach the threshold; only texts that occur in a pair are shuffled."""
    texts = texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, filter_bits)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirm_batches(shingle, percent), "a long, b long").distinct()


def _residual_batches(bands, percent, least_common):
    """Pairs inside blocks of buckets: rows (key, left block, right block, side, id, component, size, band, bands, sketch)."""
    near = percent / 100
    least_like = near - 5 * (near * (1 - near) / BINS) ** 0.5

    def compare(t):
        side = t["side"]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        own, found = int(t["band"][0]), []
        for at in range(0, len(left), 64):
            rows = left[at:at + 64]
            same = t["bands"][rows][:, None, :] == t["bands"][right][None, :, :]
            ok = (same.argmax(2) == own) & (same.sum(2) >= least_common)
            ok &= t["component"][rows][:, None] != t["component"][right][None, :]
            ia, ib = t["id"][rows][:, None], t["id"][right][None, :]
            na, nb = t["size"][rows][:, None], t["size"][right][None, :]
            ok &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            ok &= (ia < ib) | (side[rows][:, None] == 0)
            x, y = np.nonzero(ok)
            x, y = rows[x], right[y]
            for k in range(0, len(x), 1024):
                u, v = x[k:k + 1024], y[k:k + 1024]
                like = likeness(t["sketch"][u], t["sketch"][v]) >= least_like
                found.append(np.stack((t["id"][u[like]], t["id"][v[like]]), 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def columns(batch):
        out = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)
               if n not in ("bands", "sketch")}
        lists = batch.column(batch.schema.get_field_index("bands"))
        out["bands"] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, bands)
        sketches = batch.column(batch.schema.get_field_index("sketch")).to_pylist()
        out["sketch"] = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BINS // 2)
        return out

    def emit(found):
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    def run(batches):
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = columns(batch)
            if kept is not None:
                t = {c: np.concatenate((kept[c], t[c])) for c in t}
            group = np.stack((t["key"], t["i"], t["j"]), 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            bounds = np.concatenate(([0], cuts))
            yield emit([compare({c: v[x:y] for c, v in t.items()}) for x, y in zip(bounds[:-1], bounds[1:])])
            kept = {c: v[bounds[-1]:] for c, v in t.items()}
        if kept is not None:
            yield emit([compare(kept)])
    return run


def _exploded(reps):
    return reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))


def candidate_stars(reps):
    """For every bucket with two sets or more, a pair of each member with the bucket's centre."""
    members = _exploded(reps)
    chosen = F.struct(F.xxhash64("rep", F.col("band") % 2).alias("h"), F.col("rep").alias("centre"), F.col("n_shingles").alias("n"))
    centres = members.groupBy("band", "key").agg(F.count("*").alias("m"), F.min(chosen).alias("c")).where("m > 1") \
        .select("band", "key", "m", "c.centre", F.col("c.n").alias("n_centre"))
    return members.join(centres, ["band", "key"])


def residual_pairs(members, reps, labels, docs, shingle, bands, percent, least_common):
    """Pairs of sets of different components that still share buckets; large buckets are compared block by block.

    Only pairs within five standard errors of the threshold by their second sketch are returned.
    """
    split = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component_id", "rep"))
    mixed = split.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x <> y").select("band", "key")
    rows = staged(split.join(mixed, ["band", "key"]).select("band", "key", "m", "rep", "component"))
    texts = texts_of(rows.select(F.col("rep").alias("doc_id")).distinct(), docs)
    sketched = texts.mapInArrow(_second_sketch_batches(shingle), "rep long, sketch binary")
    rows = rows.join(reps.select("rep", "n_shingles", "bands").join(sketched, "rep"), "rep") \
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        F.col("rep").alias("id"), "component", F.col("n_shingles").alias("size"), F.col("band").cast("int").alias("band"), "bands", "sketch")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_residual_batches(bands, percent, least_common), "a long, b long").distinct()


def near_duplicates(docs, shingle=3, percent=85, bands=32, rows=5, least_common=2):
    """(doc_id, n_shingles, component_id, kept), a row per document.

    Words are runs of non-blank bytes with A-Z lowered. Documents whose sets of `shingle`-word shingles have
    100 * intersection >= percent * union are linked; the class id is the least doc_id that can be reached.

    Method: bands * rows / 2 hash functions give twice as many sketch values, their minima and maxima. Equal sets are one
    class from the start. Every bucket proposes each member with one centre; after those links are confirmed on full sets,
    buckets whose members still lie in different components are compared in blocks by a second, finer sketch, so no bucket is
    capped, and pairs that are connected already or clearly apart are not emitted. A pair at the threshold shares no bucket with a chance of (1 - t^rows)^bands, and fewer
    than `least_common` buckets, which the second step asks for, with about 2e-7 at the defaults.

    A document without words is linked with nothing. Rows that share a doc_id are one document: any of their texts links it.
    A null doc_id keeps its row, with a null class, kept. No rows give no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    sketches = staged(_sketches(docs, shingle, bands, rows))
    same = ["set_lo", "set_hi", "n_shingles"]
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct(F.col("doc_id"), F.col("bands"))).alias("f")
    reps = staged(named.groupBy(*same).agg(first).select(*same, F.col("f.doc_id").alias("rep"), F.col("f.bands").alias("bands")))
    copies = named.select("doc_id", *same).join(reps.select("rep", *same), same).where("doc_id <> rep") \
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    members = staged(candidate_stars(reps))
    stars = members.where("rep <> centre").select(
        F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"),
        F.col("n_shingles").alias("n_a"), F.col("n_centre").alias("n_b")).where(_comparable(percent)).select("a", "b").distinct()
    stars = staged(stars)
    links = staged(confirm(stars, docs, shingle, percent))
    labels = components(links)
    rest = residual_pairs(members, reps, labels, docs, shingle, bands, percent, least_common).join(stars, ["a", "b"], "left_anti")
    more = confirm(staged(rest), docs, shingle, percent)

    labels = components(links.unionByName(more).unionByName(copies)).withColumnRenamed("id", "doc_id")
    known = sketches.where("doc_id is not null").select("doc_id", "n_shingles").join(labels, "doc_id", "left") \
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    unnamed = sketches.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs, **options):
    """The rows that stay, with all their columns: of each class of near duplicates those of the least doc_id.

    Rows that share a doc_id but not a text are compared each by its own text, so no text goes that resembles nothing; of rows
    equal in doc_id and text one stays. Rows without a doc_id stay.
    """
    h, number = fresh(docs, "_h", "_n")
    named = docs.where("doc_id is not null").withColumn(h, F.xxhash64("text"))
    several = named.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high")
    if several.isEmpty():
        numbered, key = named.drop(h), "doc_id"
    else:  # ids that count on along (doc_id, text) keep the order of the doc_ids
        places = global_position(named.select("doc_id", h).distinct(), ["doc_id", h], number)
        numbered, key = staged(named.dropDuplicates(["doc_id", h]).join(places, ["doc_id", h])), number
    kept = near_duplicates(numbered.select(F.col(key).alias("doc_id"), "text"), **options).where("kept").select(
        F.col("doc_id").alias(key)).distinct()
    stay = numbered.join(kept, key, "left_semi").dropDuplicates([key])
    return stay.select(*docs.columns).unionByName(docs.where("doc_id is null"))
