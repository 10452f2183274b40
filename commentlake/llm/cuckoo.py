"""Exact deduplication by a sharded cuckoo-filter index of live text digests, kept as a table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.staging import staged

SLOTS = 4
FIRST_BUCKETS = 1024
ROUNDS = 100
SHARD_DIGESTS = 100_000  # rows a shard, on average
HOT_DIGESTS = 50_000
HELD, INSERT, DELETE = 0, 1, 2
INDEX = ("shards int, shard int, buckets int, bucket int, slot int, tag int, digest binary, keep_id long, group_size long")
ENTRY = "shards int, shard int, kind int, buckets int, bucket int, slot int, digest binary, keep_id long, group_size long"


class Cuckoo:
    """A cuckoo filter of 16-bit tags, four to a bucket, over records that keep the whole digest for checks and resizing.

    A digest may stand in one of two buckets; the second follows from the first and the tag. All steps work on whole arrays.
    """

    def __init__(self, buckets=FIRST_BUCKETS):
        self.keys = np.zeros((0, 4), np.uint64)
        self.ids, self.known, self.sizes, self.live = (np.zeros(0, t) for t in (np.int64, bool, np.int64, bool))
        self.resized = 0
        self._clear(buckets)

    def _clear(self, buckets):
        self.buckets = buckets
        self.tags = np.zeros((buckets, SLOTS), np.uint16)
        self.records = np.full((buckets, SLOTS), -1, np.int64)

    @staticmethod
    def tag_of(keys):
        tag = keys[:, 2].astype(np.uint16)
        return np.where(tag == 0, np.uint16(1), tag)

    def first_bucket(self, keys):
        return (keys[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)

    def other_bucket(self, bucket, tags):
        jump = (tags.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return bucket ^ (jump & np.uint64(self.buckets - 1)).astype(np.int64)

    def find(self, keys):
        """Record of each digest, -1 where none: the tags say where to look, and a hit counts only if the stored digest is equal."""
        tags = self.tag_of(keys)
        one = self.first_bucket(keys)
        found = np.full(len(keys), -1, np.int64)
        for bucket in (one, self.other_bucket(one, tags)):
            for slot in range(SLOTS):
                hit = np.flatnonzero((found < 0) & (self.tags[bucket, slot] == tags))
                record = self.records[bucket[hit], slot]
                same = (self.keys[record] == keys[hit]).all(1)
                found[hit[same]] = record[same]
        return found

    def _place(self, records, bucket):
        """Puts what fits into free slots of the given buckets; returns the places in `records` that found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.searchsorted(b, b, "left")
        rank = np.arange(len(b)) - first
        free = np.argsort(self.tags[b] != 0, axis=1, kind="stable")
        fits = rank < (self.tags[b] == 0).sum(1)
        at, slot, record = b[fits], free[fits, rank[fits]], records[order][fits]
        self.tags[at, slot] = self.tag_of(self.keys[record])
        self.records[at, slot] = record
        return order[~fits]

    def _insert(self, records):
        """Enters records; False if some found no place within the rounds."""
        bucket = self.first_bucket(self.keys[records])
        for step in range(ROUNDS):
            rest = self._place(records, bucket)
            if not len(rest):
                return True
            records, bucket = records[rest], bucket[rest]
            if step:  # one record a bucket puts another one out, which goes on to its second bucket
                _, one = np.unique(bucket, return_index=True)
                at, slot = bucket[one], (step + records[one]) % SLOTS
                out = self.records[at, slot].copy()
                self.tags[at, slot] = self.tag_of(self.keys[records[one]])
                self.records[at, slot] = records[one]
                records[one] = out
            bucket = self.other_bucket(bucket, self.tag_of(self.keys[records]))
        return False

    def _enter(self, records):
        if self._insert(records):
            return
        everything = np.flatnonzero(self.live)
        while True:  # overflow: twice the buckets, filled again from the stored digests
            self._clear(self.buckets * 2)
            self.resized += 1
            if self._insert(everything):
                return

    def insert(self, keys, ids, known, sizes):
        """Adds digests (each once in the call); a known one gets the larger id and the sum of the sizes."""
        found = self.find(keys)
        old, r = found >= 0, found[found >= 0]
        later = known[old] & (~self.known[r] | (ids[old] > self.ids[r]))
        self.ids[r[later]], self.known[r[later]] = ids[old][later], True
        self.sizes[r] += sizes[old]
        new, n = ~old, len(self.keys)
        self.keys = np.concatenate((self.keys, keys[new]))
        self.ids, self.known = np.concatenate((self.ids, ids[new])), np.concatenate((self.known, known[new]))
        self.sizes = np.concatenate((self.sizes, sizes[new]))
        self.live = np.concatenate((self.live, np.ones(new.sum(), bool)))
        self._enter(np.arange(n, len(self.keys)))

    def delete(self, keys):
        """Takes out the digests that are held; others are ignored."""
        found = self.find(keys)
        gone = np.zeros(len(self.keys), bool)
        gone[found[found >= 0]] = True
        held = self.records >= 0
        held[held] = gone[self.records[held]]
        self.tags[held], self.records[held] = 0, -1
        self.live &= ~gone

    def load(self, keys, ids, known, sizes, bucket, slot, buckets):
        """Puts stored records back where they stood."""
        self.keys, self.ids, self.known, self.sizes = keys, ids, known, sizes
        self.live = np.ones(len(keys), bool)
        self._clear(buckets)
        self.tags[bucket, slot], self.records[bucket, slot] = self.tag_of(keys), np.arange(len(keys))


def _words(column):
    """The 32-byte digests of an Arrow column as rows of four integers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _table(batch):
    return {c: batch.column(i) for i, c in enumerate(batch.schema.names)}


def _ids(column):
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~column.is_null().to_numpy(zero_copy_only=False)


def _shard(words, shards):
    high = words[:, 0].astype(np.uint64) >> np.uint64(32)
    return ((high * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


def _combined(digests, ids, sizes):
    """Equal digests of a batch as one entry each: largest id, sum of sizes."""
    t = pa.table({"digest": digests, "id": ids, "size": sizes}).group_by("digest").aggregate([("id", "max"), ("size", "sum")])
    return t["digest"].combine_chunks(), t["id_max"].combine_chunks(), t["size_sum"].combine_chunks()


def _entries(shards, kind):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _table(batch)
            digest, ids, sizes = _combined(t["digest"], t["keep_id"], t["group_size"])
            n = len(digest)
            none = pa.nulls(n, pa.int32())
            yield pa.record_batch([
                pa.array(np.full(n, shards, np.int32)), pa.array(_shard(_words(digest), shards)), pa.array(np.full(n, kind, np.int32)),
                none, none, none, digest, ids, sizes.cast(pa.int64())],
                names=["shards", "shard", "kind", "buckets", "bucket", "slot", "digest", "keep_id", "group_size"])
    return run


def _rows_of(shards, shard, filter_):
    bucket, slot = np.nonzero(filter_.records >= 0)
    r = filter_.records[bucket, slot]
    for lo in range(0, len(r), 10_000):
        part, b, s = r[lo:lo + 10_000], bucket[lo:lo + 10_000], slot[lo:lo + 10_000]
        n, raw = len(part), np.ascontiguousarray(filter_.keys[part]).tobytes()
        ids = pa.array(filter_.ids[part], mask=~filter_.known[part])

        def same(v):
            return pa.array(np.full(n, v, np.int32))
        yield pa.record_batch([
            same(shards), same(shard), same(filter_.buckets), pa.array(b.astype(np.int32)), pa.array(s.astype(np.int32)),
            pa.array(filter_.tags[b, s].astype(np.int32)), pa.array([raw[32 * i:32 * i + 32] for i in range(n)], pa.binary()),
            ids, pa.array(filter_.sizes[part])],
            names=["shards", "shard", "buckets", "bucket", "slot", "tag", "digest", "keep_id", "group_size"])


def _apply(batches):
    """Runs the entries of one shard after the other (sorted by shard and kind) through its filter; yields the filters' rows."""
    now, shards, filter_, held = None, 0, None, []

    def begin():
        if held:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            ids, known = _ids(t.column("keep_id"))
            filter_.load(_words(t.column("digest")), ids, known, t.column("group_size").to_numpy().copy(),
                         t.column("bucket").to_numpy(), t.column("slot").to_numpy(), t.column("buckets")[0].as_py())
    for batch in batches:
        shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shard)]):
            if lo == hi:
                continue
            if shard[lo] != now:
                if now is not None:
                    begin()
                    yield from _rows_of(shards, now, filter_)
                now, shards, filter_ = int(shard[lo]), batch.column("shards")[int(lo)].as_py(), Cuckoo()
            part = batch.slice(lo, hi - lo)
            if kind[lo] == HELD:
                held.append(part)
                continue
            begin()
            t = _table(part)
            digest, ids, sizes = _combined(t["digest"], t["keep_id"], t["group_size"])
            if kind[lo] == INSERT:
                filter_.insert(_words(digest), *_ids(ids), sizes.to_numpy())
            else:
                filter_.delete(_words(digest))
    if now is not None:
        begin()
        yield from _rows_of(shards, now, filter_)


def digests(docs, id_col="doc_id", text="text"):
    """Id and SHA-256 of each whole text (null: empty)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(
        F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"))


def update(index, inserted=None, deleted=None):
    """The index after inserting and then deleting the digests of the given tables (see `digests`); None is the empty index.

    A digest inserted again keeps the larger id and counts one more. Deleting takes a digest out, whatever rows it stands for;
    deleting one that is not held changes nothing. Null ids count, and stand for a text only if it has no other.

    Scale: equal digests of a batch are one entry before they move, so a text held by a third of all rows costs its shard one
    entry per batch. A shard holds about 100,000 digests; with more rows there are more shards, filled again from stored digests.
    A task streams the entries of its shards through one filter at a time.
    """
    spark = next(t for t in (index, inserted, deleted) if t is not None).sparkSession
    rows = sum(t.count() for t in (index, inserted) if t is not None)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = index.agg(F.max("shards")).first()[0] if index is not None else None
    shards = max(least, -(-rows // SHARD_DIGESTS), before or 0)
    parts = []
    if index is not None:
        same = F.col("shards") == shards
        parts.append(index.where(same).select("shards", "shard", F.lit(HELD).alias("kind"), "buckets", "bucket", "slot", "digest",
                                              "keep_id", "group_size"))
        parts.append(index.where(~same).select("digest", "keep_id", "group_size").mapInArrow(_entries(shards, INSERT), ENTRY))
    for table, kind in ((inserted, INSERT), (deleted, DELETE)):
        if table is not None:
            one = table.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
            parts.append(one.mapInArrow(_entries(shards, kind), ENTRY))
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    return staged(entries.repartition(least, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_apply, INDEX))


def resolve(rows, index):
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of `rows` (see `digests`) whose digest the index holds.

    Scale: digests with more than a 50,000th of all counted rows are at most 50,000 and are sent to every task, so their rows do
    not meet in one; the others are joined by a shuffle of ids and digests.
    """
    total = index.agg(F.sum("group_size")).first()[0] or 0
    live = index.select("digest", "keep_id", "group_size")
    hot = F.col("group_size") > total // HOT_DIGESTS
    often = F.broadcast(live.where(hot))
    joined = rows.join(often, "digest").unionByName(
        rows.join(F.broadcast(live.where(hot).select("digest")), "digest", "left_anti").join(
            live.where(~hot), "digest"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs, id_col="doc_id", text="text"):
    """One row per document: the row that stays for its text (largest id), the size of its group, whether it is the one.

    A null text counts as an empty one; a null id is kept only where no other row has the text; rows that repeat an id and a text
    are all marked kept; no rows give no rows; other columns are not read. Ids are integers. Texts count as equal if their
    SHA-256 are.
    """
    rows = staged(digests(docs, id_col, text))
    return resolve(rows, update(None, rows))
