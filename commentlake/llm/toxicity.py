"""Toxicity by subword embeddings averaged into a linear softmax; embeddings and softmax are trained jointly in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.hashing import _BYTE, ALNUM, FOLD, mix64, seeds, text_buffer
from commentlake.llm.sampling import bounded_sample

BITS = 17
GRAMS = (3, 4, 5, 6, 8)
PIECE = 1 << 19
NEUTRAL = 100  # subwords of weight 0 that every average holds besides, so that a few words alone decide little
_WEIGHTS = seeds(max(GRAMS), 21)


def _pieces(data, offsets, limit=PIECE):
    """(row range, byte range) pieces of at most `limit` bytes; a longer row is cut, after a separator where there is one."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        if end > at:
            yield at, end, int(offsets[at]), int(offsets[end])
            at = end
            continue
        lo, hi = int(offsets[at]), int(offsets[at + 1])
        while hi - lo > limit:
            gaps = np.flatnonzero(~ALNUM[data[lo:lo + limit]])
            cut = lo + (int(gaps[-1]) if len(gaps) and gaps[-1] > 0 else limit)
            yield at, at + 1, lo, cut
            lo = cut
        yield at, at + 1, lo, hi
        at += 1


def subwords(data, starts):
    """(row, place) of every character n-gram of the words; a word is a run of letters, digits and non-ASCII bytes, lowered.

    `starts` are the places where rows begin. A blank stands for either end of a word, so that prefixes and suffixes differ
    from the same letters inside one.
    """
    folded = np.where(ALNUM[data], FOLD[data], 32).astype(np.uint8)
    text = np.append(np.insert(folded, starts, 32), np.uint8(32))
    row = np.append(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))) + 1), len(starts) - 1)
    blank = text == 32
    same = np.zeros(len(text), bool)
    same[1:] = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
    text, row, blank = text[~same], row[~same], blank[~same]
    gaps = np.concatenate(([0], np.cumsum(blank)))
    codes = _BYTE[text]
    rows, places = [], []
    h = np.zeros(len(text), np.uint64)
    width = 0
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            break
        h = h[:m].copy()
        while width < n:
            h += codes[width:width + m] * _WEIGHTS[width]
            width += 1
        inside = gaps[n - 1:n - 1 + m] - gaps[1:1 + m] == 0
        places.append((mix64(h[inside] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
        rows.append(row[:m][inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(places)


def _mean_weights(data, offsets, table):
    """Mean of table[subword] per row; 0 where a row has none."""
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for i, j, lo, hi in _pieces(data, offsets):
        starts = np.clip(offsets[i:j] - lo, 0, None)
        row, place = subwords(data[lo:hi], starts)
        total[i:j] += np.bincount(row, table[place], j - i)
        count[i:j] += np.bincount(row, minlength=j - i)
    return total / (count + NEUTRAL)


def train(texts, labels, dim=8, epochs=5, rate=2.0, gain=100.0, rare=1.0, seed=5):
    """(weight per subword, bias): embeddings (2^BITS x dim) and a two-class softmax, by Adagrad on cross entropy.

    A row's vector is `gain` times the mean of its subwords' vectors. The model is linear after training, so each subword's
    part of the logit difference is kept as one number. Classes are weighted to count alike. `rare` is the starting value of
    Adagrad's sums for the embeddings: the larger, the less a subword of few rows can move.
    """
    labels = np.asarray(labels, np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        prior = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior)))
    bags = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, place = subwords(data, np.zeros(1, np.int64))
        ids, counts = np.unique(place, return_counts=True)
        bags.append((ids, (gain * counts / (len(place) + NEUTRAL)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (1 << BITS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(1 << BITS, rare, np.float32), np.full_like(soft, 1e-3), np.full_like(bias, 1e-3)
    share = np.bincount(labels, minlength=2) / len(labels)
    importance = (0.5 / np.maximum(share, 1e-9))[labels].astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            batch = order[at:at + 32]
            ids = np.concatenate([bags[b][0] for b in batch])
            values = np.concatenate([bags[b][1] for b in batch])
            owner = np.repeat(np.arange(len(batch)), [len(bags[b][0]) for b in batch])
            hidden = np.stack([np.bincount(owner, values * vectors[ids, d], len(batch)) for d in range(dim)], 1).astype(np.float32)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(2, dtype=np.float32)[labels[batch]]) * importance[batch, None]
            g_soft, g_bias, g_hidden = hidden.T @ error, error.sum(0), error @ soft.T
            seen_s += g_soft ** 2
            seen_b += g_bias ** 2
            soft -= 0.1 * g_soft / np.sqrt(seen_s)
            bias -= 0.1 * g_bias / np.sqrt(seen_b)
            places, inverse = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(inverse, values * g_hidden[owner, d], len(places)) for d in range(dim)], 1).astype(np.float32)
            seen_v[places] += (g ** 2).mean(1)
            vectors[places] -= 0.1 * rate * g / np.sqrt(seen_v[places])[:, None]
    table = gain * (vectors @ (soft[:, 1] - soft[:, 0]))
    return table.astype(np.float32), float(bias[1] - bias[0])


def labelled_sample(docs, labels, label, rows_per_class, max_bytes, seed=17):
    """(doc_id, text, label) of at most `rows_per_class` rows of either class, chosen by a hash of the id.

    Rows with null id or label, and texts of more than `max_bytes` bytes, are not used for learning. An id with several labels
    has the largest, an id with several texts the least by hash. The ids are picked among the labels, so only the picked
    texts leave the tasks: 2 * rows_per_class rows, whose ids are broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = docs.select("doc_id", F.octet_length("text").alias("b")).where(F.col("b").isNull() | (F.col("b") <= max_bytes))
    known = known.join(sizes.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = bounded_sample(known.where("label = 0"), rows_per_class, order).unionByName(
        bounded_sample(known.where("label = 1"), rows_per_class, order))
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = short.join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("r")) \
        .select("doc_id", "r.text", "r.label")


def _train_batches(batches):
    """Arrow batches (doc_id, text, label) of the whole sample to one row with the model."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(1).to_pylist()
        labels += batch.column(2).to_pylist()
    table, bias = train(texts, labels)
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def fit(docs, labels, rows_per_class=1500, max_bytes=1 << 16):
    """The model (weight per subword, bias), learned from a bounded sample: see labelled_sample.

    The sample, 2 * rows_per_class texts of at most max_bytes bytes, is trained on in one task, which Spark runs again if its
    executor is lost; the driver gets the weights only.
    """
    sample = labelled_sample(docs, labels, "toxic", rows_per_class, max_bytes)
    fitted = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_train_batches, "weights binary, bias double")
    row = fitted.first()
    return train([], []) if row is None else (np.frombuffer(row["weights"], np.float32), row["bias"])


def score(docs, model):
    """(doc_id, score) for every document: the softmax of its whole text's average.

    Null and empty texts have no subwords and get the score of the bias alone. Long texts are averaged piece by piece. Rows
    are scored one by one, null and repeated ids too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table, bias = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            logit = np.clip(_mean_weights(data, offsets, table) + bias, -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs, labels, threshold=0.7, **options):
    """The documents scored below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    at = docs.columns.index("text")

    def run(batches):
        table, bias = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            logit = np.clip(_mean_weights(data, offsets, table) + bias, -30, 30)
            yield batch.filter(pa.array(1 / (1 + np.exp(-logit)) < threshold))
    return docs.mapInArrow(run, docs.schema)
