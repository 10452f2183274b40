"""Exact k-nearest-neighbour search and classification.

A two-level pivot index: about the square root of the number of training points are centres of cells, and the cells are grouped
around a few of the centres. Each cell keeps its size and radius, each group how far its cells reach. A query first searches
the cell it falls into, which bounds how far away its k-th neighbour can be; the triangle inequality then says which other cells can
hold a nearer point, and only there is it searched again. Cells are packed into shelves of bounded bytes. A query's vector is sent
once to a shelf, whatever the number of its cells that the query has to search, and shelves are searched in rounds that send about
the vectors of both sides once: what lies on disk is in proportion to the input also where few cells can be ruled out. A task
compares one shelf with a bounded piece of its queries and returns the k best per query, so pairs are never emitted.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F

from commentlake.operators.scale import join_by_weight
from commentlake.session import releasing, scratch_path, stored

DIGITS = 9
CELL_ROWS = 256  # a smaller table has fewer cells than the square root of its rows
MAX_CELLS, MAX_INDEX_BYTES = 4096, 32 << 20
BLOCK_BYTES = 32 << 20  # dense vectors of a shelf of training rows, and of a piece of its queries
ROUND_BYTES = 256 << 20  # a round sends at least this much, or what the vectors of both sides hold
CHUNK, SLICE = 256, 1024
EXACT = 1 << 16


def _distances(vectors, pivots):
    gap = (vectors ** 2).sum(1)[:, None] - 2.0 * vectors @ pivots.T + (pivots ** 2).sum(1)[None, :]
    return np.sqrt(np.maximum(gap, 0.0))


def _matrix(column, width):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class PivotIndex:
    """Centres, cells and groups of cells; bounded by the number of cells (at most 4,096 and 32 MB of centres)."""

    def __init__(self, centres):
        self.centres = centres
        self.tops = centres[:math.isqrt(len(centres) - 1) + 1]
        to_tops = _distances(centres, self.tops)
        self.group = to_tops.argmin(1)
        self.cells = [np.flatnonzero(self.group == g) for g in range(len(self.tops))]
        self.from_top = to_tops[np.arange(len(centres)), self.group]
        self.rows, self.radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)

    def measure(self, sizes):
        """Takes (cell, rows, radius) of the training points."""
        for cell, rows, radius in sizes:
            self.rows[cell], self.radius[cell] = rows, radius
        self.reach = np.array([(self.from_top[c] + self.radius[c]).max() for c in self.cells])
        return self

    def place(self, x):
        """A near cell of each vector (the nearest of its group's) and the distance to its centre."""
        top = _distances(x, self.tops).argmin(1)
        cell, gap = np.zeros(len(x), np.int32), np.zeros(len(x))
        for g in np.unique(top):
            rows = np.flatnonzero(top == g)
            d = _distances(x[rows], self.centres[self.cells[g]])
            at = d.argmin(1)
            cell[rows], gap[rows] = self.cells[g][at], d[np.arange(len(rows)), at]
        return cell, gap

    def within(self, x, bound, wanted):
        """(row, cell) of all wanted cells that can hold points as near as each row's bound."""
        to_tops = _distances(x, self.tops)
        found = []
        for g, cells in enumerate(self.cells):
            cells = cells[wanted[cells]]
            rows = np.flatnonzero(to_tops[:, g] - self.reach[g] <= bound)
            if len(rows) and len(cells):
                d = _distances(x[rows], self.centres[cells])
                r, c = np.nonzero(d - self.radius[cells] <= bound[rows, None])
                found.append((rows[r], cells[c]))
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        return tuple(np.concatenate(part) for part in zip(*found))

    def bound(self, x, keep):
        """A distance within which each row has `keep` points, from the cells' sizes and radii alone."""
        far = _distances(x, self.centres) + self.radius
        order = far.argsort(1)
        enough = self.rows[order].cumsum(1) >= keep
        at = enough.argmax(1)
        rows = np.arange(len(x))
        return np.where(enough.any(1), far[rows, order[rows, at]], np.inf)


class Shelves:
    """Cells packed into shelves of at most `room` training rows, neighbouring cells together. A cell with more takes several
    shelves of its own, over which its rows are dealt by the hash of their id."""

    def __init__(self, index, room):
        self.parts = np.maximum(1, -(-index.rows // room))
        self.first = np.zeros(len(index.rows), np.int64)
        self.number, open_, left = 0, 0, -1
        for cell in np.concatenate(index.cells):
            if self.parts[cell] > 1:
                self.first[cell], self.number = self.number, self.number + self.parts[cell]
                continue
            if index.rows[cell] > left:
                open_, left, self.number = self.number, room, self.number + 1
            self.first[cell], left = open_, left - index.rows[cell]
        self.number = int(self.number)

    def of(self, key):
        """The shelf of a row from the columns `cell` and `key`."""
        part = F.pmod(F.xxhash64(key), _looked_up(self.parts, F.col("cell")))
        return (_looked_up(self.first, F.col("cell")) + part).cast("int")


def _looked_up(values, at):
    return F.get(F.from_json(F.lit(str([int(v) for v in values])), "array<long>"), at)


def _loose(bound):
    """Room for the rounding of distances that are products."""
    return bound * (1.0 + 1e-6) + 1e-6


def _placed(df, index, width):
    def run(batches):
        for batch in batches:
            cell, gap = index.place(_matrix(batch.column("embedding"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])
    return df.mapInArrow(run, df.schema.simpleString()[7:-1] + ",cell:int,gap:double")


def _elsewhere(index, shelves, width, keep, low, high):
    """A function from Arrow batches of queries to (batch, row, shelf, cell, bound): the cells on shelves from low to below high
    that a query still has to search; the bound becomes a number where it was none."""
    wanted = (shelves.first < high) & (shelves.first + shelves.parts > low)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                x = _matrix(batch.column("embedding"), width)
                bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
                open_ = np.isnan(bound)
                if open_.any():
                    bound[open_] = index.bound(x[open_], keep)
                rows, cells = index.within(x, _loose(bound), wanted)
                n = shelves.parts[cells]
                part = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                rows, cells = np.repeat(rows, n), np.repeat(cells, n)
                shelf = shelves.first[cells] + part
                home, own = batch.column("home").to_numpy(), batch.column("cell").to_numpy()
                new = ((cells != own[rows]) | (shelf != home[rows])) & (shelf >= low) & (shelf < high)
                yield batch, rows[new], shelf[new], cells[new], bound
    return run


def _work(asked, index, shelves, width, keep):
    """Per shelf the number of queries that have to search it and of the pairs they compare at most."""
    found, number = _elsewhere(index, shelves, width, keep, 0, shelves.number), shelves.number
    rows = index.rows / shelves.parts

    def run(batches):
        n, pairs = np.zeros(number, np.int64), np.zeros(number)
        for _, row, shelf, cell, _ in found(batches):
            n += np.bincount(np.unique(row * number + shelf) % number, minlength=number)
            pairs += np.bincount(shelf, rows[cell], minlength=number)
        yield pa.record_batch([pa.array(np.arange(number)), pa.array(n), pa.array(pairs)], names=["shelf", "n", "pairs"])
    with releasing(asked.sparkSession):
        total = asked.mapInArrow(run, "shelf long, n long, pairs double").groupBy("shelf").agg(F.sum("n"), F.sum("pairs")).collect()
    n, pairs = np.zeros(number, np.int64), np.zeros(number)
    for shelf, asking, compared in total:
        n[shelf], pairs[shelf] = asking, compared
    return n, pairs


def _sent(asked, index, shelves, width, keep, low, high):
    """A row for each shelf from low to below high that a query has to search."""
    found, number = _elsewhere(index, shelves, width, keep, low, high), shelves.number

    def run(batches):
        for batch, row, shelf, _, bound in found(batches):
            pair = np.unique(row * number + shelf)
            for lo in range(0, len(pair), SLICE):
                rows, at = np.divmod(pair[lo:lo + SLICE], number)
                part = batch.take(pa.array(rows))
                yield pa.record_batch([*(part.column(c) for c in ("qid", "embedding", "cell", "gap", "home")),
                                       pa.array(at.astype(np.int32)), pa.array(bound[rows])],
                                      names=["qid", "embedding", "cell", "gap", "home", "shelf", "bound"])
    kind = asked.schema["qid"].dataType.simpleString()
    return asked.select("qid", "embedding", "cell", "gap", "home", "bound").mapInArrow(
        run, f"qid {kind}, embedding array<double>, cell int, gap double, home int, shelf int, bound double")


def _best_of_shelf(index, keep, width, schema, at_home):
    """The `keep` nearest rows of one shelf for each query of a piece: those of its own cell at home, those of the other cells
    within its bound elsewhere."""
    def run(asked, known):
        if not asked.num_rows or not known.num_rows:
            return schema.empty_table()
        known = known.take(pc.sort_indices(known, [("cell", "ascending"), ("gap", "ascending")]))
        q, t = _matrix(asked["embedding"], width), _matrix(known["embedding"], width)
        gap, shelf = known["gap"].to_numpy(), known["shelf"][0].as_py()
        cells, starts = np.unique(known["cell"].to_numpy(), return_index=True)
        ends = [*starts[1:], len(t)]
        own, is_home = asked["cell"].to_numpy(), asked["home"].to_numpy() == shelf
        bound = _loose(asked["bound"].to_numpy(zero_copy_only=False).astype(float))
        bound = np.where(np.isnan(bound), np.inf, bound)
        rank = pc.rank(known["id"].combine_chunks(), tiebreaker="first").to_numpy()
        rows, found, far = [], [], []
        order = np.lexsort((asked["gap"].to_numpy(), own))
        for lo in range(0, len(q), CHUNK):
            mine = order[lo:lo + CHUNK]
            to_centres = _distances(q[mine], index.centres[cells])
            near = [_nearest(q[mine[r]], t, starts[j], ends[j], gap, to_centres[r, j], bound[mine[r]], keep, r)
                    for j, r in ((j, np.flatnonzero(
                        own[mine] == cell if at_home else ((own[mine] != cell) | ~is_home[mine])
                        & (to_centres[:, j] - index.radius[cell] <= bound[mine]))) for j, cell in enumerate(cells)) if len(r)]
            near = [part for part in near if part]
            if not near:
                continue
            r, c, d = (np.concatenate(part) for part in zip(*near))
            first = np.lexsort((rank[c], d.round(DIGITS), r))
            r, c, d = r[first], c[first], d[first]
            best = (np.arange(len(r)) - np.searchsorted(r, r, "left") < keep) & (d <= bound[mine[r]])
            rows.append(mine[r[best]]), found.append(c[best]), far.append(d[best])
        if not rows:
            return schema.empty_table()
        at = pa.array(np.concatenate(found))
        return pa.table([asked["qid"].take(pa.array(np.concatenate(rows))), known["id"].take(at), pa.array(np.concatenate(far)),
                         known["label"].take(at)], schema=schema)
    return run


def _nearest(x, t, start, end, gap, centre, bound, keep, names):
    """(name of the query, row of t, distance): what can be among the `keep` nearest of one cell, the rows of t from start to end."""
    # A point is no nearer to a query than their distances to the centre differ.
    a = start + np.searchsorted(gap[start:end], (centre - bound).min() - 1e-6, "left")
    b = start + np.searchsorted(gap[start:end], (centre + bound).max() + 1e-6, "right")
    if a == b:
        return None
    y = t[a:b]
    rough = _distances(x, y) ** 2
    # The products lose digits: take everything near the k-th value, then measure exactly.
    slack = 1e-7 * (1.0 + (x ** 2).sum(1) + (y ** 2).sum(1).max())
    n = min(keep, b - a) - 1
    most = np.minimum(np.partition(rough, n, axis=1)[:, n], bound ** 2) + slack
    r, c = np.nonzero(rough <= most[:, None])
    d = [np.sqrt(((y[c[i:i + EXACT]] - x[r[i:i + EXACT]]) ** 2).sum(1)) for i in range(0, len(r), EXACT)]
    return (names[r], a + c, np.concatenate(d)) if d else None


def _search(asked, points, pieces, best_of, ddl):
    """(qid, neighbour, distance, label): the best of each shelf for each of the pieces that its queries are cut into."""
    number = _looked_up(pieces, F.col("shelf"))
    left = asked.withColumn("piece", F.pmod(F.xxhash64("qid"), number))
    # A training point goes only where queries are.
    right = points.where(number > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    # Both sides may come from one table: fresh column identities keep the cogroup from mixing them up.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["shelf", "piece"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of, ddl)


def _rounds(asking, room, shelves, index, most):
    """Stretches (low, high) of shelves whose queries and training rows, as often as they are sent, are `most` rows at most; a
    single shelf may exceed that."""
    held = np.zeros(shelves.number)
    np.add.at(held, shelves.first[shelves.parts == 1], index.rows[shelves.parts == 1])
    for cell in np.flatnonzero(shelves.parts > 1):
        held[shelves.first[cell]:shelves.first[cell] + shelves.parts[cell]] = index.rows[cell] / shelves.parts[cell]
    low, sent = 0, 0
    for s in range(shelves.number):
        rows = asking[s] + -(-asking[s] // room) * held[s]
        if sent and sent + rows > most:
            yield low, s
            low, sent = s, 0
        sent += rows
    if sent:
        yield low, shelves.number


def _arrow_schema(spark, ddl):
    return spark.createDataFrame([], ddl).toArrow().schema


def _digest(df):
    """Two hashes of the vector, which stand for it as a key."""
    return df.withColumns({"_h1": F.xxhash64("embedding"), "_h2": F.xxhash64(F.lit(1), "embedding")})


def _bounded(asked, best, keep):
    """The queries with the distance of the `keep`-th row found so far, null where there are fewer."""
    reached = best.groupBy("qid").agg(F.get(F.sort_array(F.collect_list("distance")), keep - 1).alias("bound"))
    return asked.join(reached, "qid", "left")


def _first(df, key, n):
    order = Window.partitionBy(key).orderBy(F.round("distance", DIGITS), "neighbour")
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def build_index(points, pivots=None):
    """A PivotIndex of `points` (id, embedding, label, _c: 1 for the first of equal vectors), the points with cell and gap, the width."""
    n, width = points.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("no training rows")
    wanted = pivots or max(1, min(math.isqrt(n), n // CELL_ROWS, MAX_CELLS, MAX_INDEX_BYTES // (8 * max(width, 1))))
    chosen = points.where("_c = 1").orderBy("_h1", "_h2").select("embedding").limit(wanted).collect()
    index = PivotIndex(np.array([r[0] for r in chosen], dtype=float).reshape(len(chosen), width))
    placed = stored(_placed(points.select("id", "embedding", "label"), index, width))
    sizes = placed.groupBy("cell").agg(F.count("*"), F.max("gap")).collect()
    return index.measure([tuple(r) for r in sizes]), placed, width


def knn_candidates(queries, train, k=5, exclude_same_id=False, pivots=None, block=None, work=None):
    """The k nearest training rows of every query row: (id, neighbour, distance, label).

    `queries` has id and embedding, `train` also label; vectors have one length, rows without one are left out. Equal distances
    are ordered by training id. With `exclude_same_id` a row is not its own neighbour. `pivots` is the number of cells, `block`
    the rows of a shelf and of a piece; without them the table's size and the vectors' bytes decide. A list given as `work` gets
    the number of pairs compared at most in each of the two searches.
    """
    keep = k + 1 if exclude_same_id else k
    queries = _digest(queries.select("id", F.col("embedding").cast("array<double>")).where("embedding is not null"))
    train = _digest(train.select("id", F.col("embedding").cast("array<double>"), "label").where("embedding is not null"))
    # Of equal training vectors only the first k by id can be among the k nearest; the others are dropped before the shuffle.
    copies = Window.partitionBy("_h1", "_h2").orderBy("id")
    points = stored(train.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= keep))
    index, points, width = build_index(points, pivots)
    room = block or max(CHUNK, BLOCK_BYTES // (8 * max(width, 1)))
    shelves = Shelves(index, room)
    points = points.withColumn("shelf", shelves.of("id"))
    same = queries.groupBy("_h1", "_h2").agg(F.min("id").alias("qid"), F.first("embedding").alias("embedding"), F.count("*").alias("n"))
    asked = stored(_placed(same, index, width).withColumn("home", shelves.of("qid")))
    ddl = (f"qid {asked.schema['qid'].dataType.simpleString()}, neighbour {points.schema['id'].dataType.simpleString()}, "
           f"distance double, label {points.schema['label'].dataType.simpleString()}")
    arrow = _arrow_schema(points.sparkSession, ddl)
    # First a query's own cell, or the part of it on the query's shelf, which bounds the distance of its k-th neighbour.
    asking = np.zeros(shelves.number, np.int64)
    for shelf, n in asked.groupBy("home").count().collect():
        asking[shelf] = n
    here = asked.select("qid", "embedding", "cell", "gap", "home", F.col("home").alias("shelf"), F.lit(None).cast("double").alias("bound"))
    path = scratch_path(points.sparkSession, "neighbours")
    best = stored(_search(here, points, -(-asking // room), _best_of_shelf(index, keep, width, arrow, True), ddl), path)
    # Then all other cells that can hold nearer points, in rounds of shelves. Each finds only what is within the bound so far.
    asking, pairs = _work(_bounded(asked, best, keep), index, shelves, width, keep)
    if work is not None:
        own = _looked_up(np.ceil(index.rows / shelves.parts), F.col("cell"))
        work += [asked.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0], float(pairs.sum())]
    most = max(asked.count() + int(index.rows.sum()), ROUND_BYTES // (8 * max(width, 1)))
    for low, high in _rounds(asking, room, shelves, index, most):
        now = np.where((np.arange(shelves.number) >= low) & (np.arange(shelves.number) < high), -(-asking // room), 0)
        there = _sent(_bounded(asked, best, keep), index, shelves, width, keep, low, high)
        best = stored(_search(there, points, now, _best_of_shelf(index, keep, width, arrow, False), ddl), path, "append")
    best = _first(best, "qid", keep)
    lists = asked.select("_h1", "_h2", "qid", "n").join(
        best.groupBy("qid").agg(F.collect_list(F.struct("neighbour", "distance", "label")).alias("best")), "qid")
    # Back from distinct query vectors to query rows.
    rows = join_by_weight(queries.select("id", "_h1", "_h2"), lists.drop("qid"), ["_h1", "_h2"], "n").select("id", F.inline("best"))
    return _first(rows.filter(F.col("id") != F.col("neighbour")), "id", k) if exclude_same_id else rows


def knn_classify(queries, train, k=5, exclude_same_id=False, shares=False, **limits):
    """Label by 1/distance votes of the k nearest rows; exact matches outvote everything else.

    Vote ties go to the smaller label. With `shares` the vote share per label is returned as a map.
    """
    near = knn_candidates(queries, train, k, exclude_same_id, **limits)
    exact = F.min("distance").over(Window.partitionBy("id")) == 0
    weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    votes = near.withColumn("_w", weight).groupBy("id", "label").agg(F.sum("_w").alias("votes"))
    won = votes.groupBy("id").agg(
        F.min_by("label", F.struct(-F.round("votes", DIGITS), F.col("label"))).alias("label"),
        F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("string"), "votes"))).alias("votes"))
    if not shares:
        return won.select("id", "label")
    total = F.aggregate(F.map_values("votes"), F.lit(0.0), lambda a, x: a + x)
    return won.withColumn("_t", total).select(
        "id", "label", F.transform_values("votes", lambda _, v: v / F.col("_t")).alias("shares"))
