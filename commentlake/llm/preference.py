"""Quality scores by Bradley-Terry ranking: preference pairs, logistic loss on feature differences, a score quantile as cut.

Pairs, sums and quantile are taken over all labelled rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.hashing import NOT_SPACE, hash_words, runs, text_buffer
from commentlake.llm.staging import staged
from commentlake.operators.scale import running_before

FEATURES = ("log_bytes", "upper", "digit", "blank", "line", "punctuation", "symbol", "other", "word_length", "distinct_words",
            "top_repeat", "same_neighbour", "distinct_pairs", "exclaim", "pipe")
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "blank": (9, 32), "line": (10, 13), "punctuation": b".,;:'\"?()-",
    "symbol": b"#$%&*+/<=>@[]\\^_`{}~|", "other": range(128, 256), "exclaim": b"!", "pipe": b"|",
}


def features(data, offsets):
    """One row of FEATURES per text, from its bytes and words; all are finite for empty texts."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    at_name = {f: k for k, f in enumerate(FEATURES)}
    lookup = {name: np.isin(np.arange(256), np.frombuffer(bytes(values), np.uint8)) for name, values in _CLASSES.items()}
    for i, j in runs(offsets):
        part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        words, word_at = hash_words(part, at, NOT_SPACE)
        upper = lookup["upper"][part]
        for r in range(j - i):
            row, text, own = out[i + r], part[at[r]:at[r + 1]], words[word_at[r]:word_at[r + 1]]
            size = max(1, len(text))
            counts = np.bincount(text, minlength=256) if len(text) < 1 << 24 else sum(
                np.bincount(text[k:k + (1 << 24)], minlength=256) for k in range(0, len(text), 1 << 24))
            row[at_name["log_bytes"]] = np.log1p(len(text))
            for name, mask in lookup.items():
                row[at_name[name]] = counts[mask].sum() / size
            m = len(own)
            if m:
                row[at_name["word_length"]] = np.log(size / m)
                _, repeats = np.unique(own, return_counts=True)
                row[at_name["distinct_words"]] = np.log((len(repeats) + 1) / (m + 1))
                row[at_name["top_repeat"]] = repeats.max() / (m + 5)
            if m > 1:
                row[at_name["same_neighbour"]] = np.count_nonzero(own[1:] == own[:-1]) / (m + 5)
                pairs = own[1:] * np.uint64(3) + own[:-1]
                row[at_name["distinct_pairs"]] = np.log(len(np.unique(pairs)) / (m - 1))
    return out


def expand(x):
    """The features, and their squares, so that either extreme can be bad."""
    return np.concatenate((x, x * x), 1)


def _worth(x, model):
    centre, scale, w = model
    return expand(np.clip((x - centre) / scale, -8, 8)) @ w


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _feature_batches(batches):
    """Arrow batches (doc_id, text) to (doc_id, x), x being the features."""
    for batch in batches:
        x = features(*text_buffer(batch.column(1)))
        ends = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])


def labelled_features(docs, labels):
    """(doc_id, label, x) of every document with a label 0 or 1; an id with several labels has the largest, rows without an id have
    none. Only features leave the tasks, no texts."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", "text").mapInArrow(_feature_batches, "doc_id long, x array<double>").join(known, "doc_id") \
        .select("doc_id", "label", "x")


TURNS, PAIRS = 4, 60_000  # pairs of each row of the larger class, and at least how many pairs a small table has in all


def preference_pairs(rows, sizes, seed=9):
    """(good, bad): features of a row of label 1 and one of label 0.

    Both classes are numbered in the order of a hash of the id. In every turn each row of the larger class meets one of the smaller,
    taken round and round and shifted from turn to turn, so every row of both is in pairs and the pairs grow with the rows.
    """
    small = min(sizes, key=lambda k: (sizes[k], k))
    few, many = sizes[small], sizes[1 - small]
    turns = min(few, max(TURNS, -(-PAIRS // many)))
    placed = running_before(rows.withColumns({"_h": F.xxhash64("doc_id", F.lit(seed)), "_one": F.lit(1)}), ["label"],
                            ["_h", "doc_id", "x"], "_one", "place")
    met = F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: F.pmod(F.col("place") + t * (few // turns), F.lit(few)))
    left = placed.where(F.col("label") != small).select(F.col("x").alias("_many"), F.explode(met).alias("_p"))
    right = placed.where(F.col("label") == small).select(F.col("x").alias("_few"), F.col("place").alias("_p"))
    good, bad = ("_few", "_many") if small else ("_many", "_few")
    return left.join(right, "_p").select(F.col(good).alias("good"), F.col(bad).alias("bad"))


def fit_pairs(pairs, centre, scale, penalty=1e-3, steps=30):
    """The weights of the Bradley-Terry model: P(i beats j) = sigmoid(w . (x_i - x_j)).

    Newton steps minimise the logistic loss of all pairs with a ridge; a task sends its sums of gradient and Hessian only.
    """
    width = 2 * len(FEATURES)

    def sums(w):
        def run(batches):
            total = np.zeros((width + 2, width))
            for batch in batches:
                z = [expand(np.clip((_matrix(c) - centre) / scale, -8, 8)) for c in batch.columns]
                d = z[0] - z[1]
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                total[0] -= p @ d
                total[1, 0] += len(d)
                total[2:] += (d * (p * (1 - p))[:, None]).T @ d
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])
        found = pairs.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r["sums"], np.float64).reshape(width + 2, width) for r in found)
    w = np.zeros(width)
    for _ in range(steps):
        total = sums(w)
        n = total[1, 0]
        move = np.linalg.solve(total[2:] / n + penalty * np.eye(width), total[0] / n + penalty * w)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _scored(rows, model):
    """(label, s): the Bradley-Terry score of every row."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_worth(_matrix(batch.column(1)), model))], ["label", "s"])
    return rows.select("label", "x").mapInArrow(run, "label int, s double")


BINS = 1024


def threshold_of(scored, sizes, counts):
    """The exact quantile of all scores, each class weighted by its share among all labels, below which the share of label 0 lies.

    The scores are counted in BINS bins, then those of the bin that the quantile falls into, until a bin has one value.
    """
    share = {k: counts[k] / sum(counts.values()) for k in (0, 1)}
    weight = {k: share[k] / sizes[k] for k in (0, 1)}
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    below, mass = 0.0, 1.0
    while low < high and (high - low) / BINS > 0:
        place = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = scored.where(F.col("s").between(low, high)).groupBy(place.alias("b")).agg(
            F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"),
            F.min("s").alias("low"), F.max("s").alias("high")).orderBy("b").collect()
        for r in bins:
            mass = r["n0"] * weight[0] + r["n1"] * weight[1]
            if below + mass >= share[0] - 1e-12:
                break
            below += mass
        low, high = r["low"], r["high"]
    after = scored.where(F.col("s") > low).agg(F.min("s")).first()[0]
    inside = below + mass - share[0] > 0.5 * min(weight.values())  # rows of the same score lie on either side
    return low if after is None or inside else (low + after) / 2


def fit(docs, labels):
    """(model, threshold, slope) learned from every labelled document, in DataFrames; the driver gets sums and counts only.

    The threshold is the quantile of the labelled rows' scores, each class weighted by its share among all labels, below which the
    share of label 0 lies: as many rows fall below it as there are bad ones. Without rows of both classes every score is equal.
    """
    rows = staged(labelled_features(docs, labels))
    x = [F.get("x", k) for k in range(len(FEATURES))]
    held = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(held) < 2:
        return (np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES))), 0.0, 1.0
    sizes = {k: r["n"] for k, r in held.items()}
    stats = rows.agg(F.array(*[F.avg(c) for c in x]), F.array(*[F.stddev_pop(c) for c in x])).first()
    # Sums depend on the order of their parts in the last digits; the rounded figures do not.
    centre, scale = np.round(np.array(stats[0]), 9), np.round(np.array(stats[1]), 9) + 1e-6
    w = np.round(fit_pairs(staged(preference_pairs(rows, sizes)), centre, scale), 9)
    model = centre, scale, w
    scored = staged(_scored(rows, model))
    counts = {r["q"]: r["n"] for r in labels.where("quality in (0, 1)").groupBy(F.col("quality").cast("int").alias("q")).agg(
        F.count("*").alias("n")).collect()}
    spread = round(scored.agg(F.stddev_pop("s")).first()[0], 9)
    return model, threshold_of(scored, sizes, counts), float(4 / (spread + 1e-9))


def score(docs, fitted, cut=0.3):
    """(doc_id, score): a rising curve of the Bradley-Terry score that takes the value `cut` at the threshold.

    Null and empty texts are scored like any other, by their features; rows are scored one by one, null and repeated ids
    too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        model, threshold, slope = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            z = slope * (_worth(features(data, offsets), model) - threshold) + np.log(cut / (1 - cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs, labels, cut=0.3):
    """The documents at or above the threshold."""
    scored = score(docs, fit(docs, labels), cut).where(F.col("score") >= cut)
    return docs.join(scored.select("doc_id").distinct(), "doc_id", "left_semi")
