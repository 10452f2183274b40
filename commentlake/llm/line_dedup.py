"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only."""

from functools import reduce
from operator import add

from pyspark.sql import Window, functions as F

from commentlake.llm.components import components
from commentlake.llm.staging import staged

ROUNDS = 4  # classes of lengths that are indexed one after the other, so the keys of all lines never lie on disk at once
BUCKET = 1024  # index entries of a bucket that each of its rows is held against; larger buckets are split further
COMMON = " eainotrshldcumf"  # one byte each; characters that are in no line leave the comparison to what follows
LONG = 640  # longer lines are left to the second look, which cuts equal ends off first


def _segment(length, i, parts):
    """Start (from 0) and length of segment i of a string cut into equal parts."""
    start = F.floor(length * i / F.lit(parts)).cast("int")
    return start, F.floor(length * (i + 1) / F.lit(parts)).cast("int") - start


def _places(threshold):
    """(length difference, segment, shift of the start) of every substring to probe.

    Segment i of a string that is `delta` shorter can only match, with i errors at most to its left and threshold - i to its
    right, at these shifts. Difference 0 and shift 0 is the string's own segment, its entry in the index.
    """
    for delta in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, delta - (threshold - i)), min(i, delta + threshold - i)
            yield from ((delta, i, shift) for shift in range(low, high + 1))


def _place_table(threshold):
    """The places as one constant: role (0 for index entries), length difference, segment and shift, in the order of `_places`.
    What depends on the line is then one small expression over the chosen place, not one expression a place: those together
    exceed what Spark compiles, and every plan that holds them takes the driver's memory."""
    return [F.struct(F.lit(0 if delta == 0 and shift == 0 else 1).alias("role"), F.lit(delta).alias("delta"), F.lit(i).alias("i"),
                     F.lit(shift).alias("shift")) for delta, i, shift in _places(threshold)]


def edit_distance(a, b, threshold):
    """Edit distance of two string columns in code points, or threshold + 1 if it is larger or one of them is null. Only a band of
    the matrix is computed: Spark's function says -1 beyond the threshold, which the remainder turns into threshold + 1."""
    return F.coalesce(F.pmod(F.levenshtein(a, b, threshold), F.lit(threshold + 2)), F.lit(threshold + 1))


def bag(line):
    """How often some common characters are in a line. An edit adds one character at most and takes one away."""
    return F.struct(*[(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))).alias(f"c{i}") for i, c in enumerate(COMMON)])


def trimmed_distance(a, b, threshold, times=4):
    """`edit_distance` of what is left when halves that both begin or end with are cut off, again and again: the distance stays as
    it is, and Spark takes time in the square of the length. One fold, since chained columns are put into each other."""
    def cut(s, _):
        half = F.floor(F.least(F.char_length(s["a"]), F.char_length(s["b"])) / 2).cast("int")
        low = F.substring(s["a"], F.lit(1), half) == F.substring(s["b"], F.lit(1), half)
        high = F.right(s["a"], half) == F.right(s["b"], half)
        return F.struct(*[F.when(low, F.substring(s[c], half + 1, F.char_length(s[c]))).when(
            high, F.substring(s[c], F.lit(1), F.char_length(s[c]) - half)).otherwise(s[c]).alias(c) for c in "ab"])
    return F.aggregate(F.array_repeat(F.lit(0), times), F.struct(a.alias("a"), b.alias("b")), cut,
                       lambda s: edit_distance(s["a"], s["b"], threshold))


def alike(a, b, bag_a, bag_b, threshold):
    """False only where two string columns are further apart than the threshold; true beyond it for some of over LONG characters.
    First come the bags, which an edit changes by two at most. Then, of twice as many pieces as would do, an edit spoils one at
    most, so all but `threshold` lie unchanged in the other string. The matrix is for the few that are left."""
    apart = reduce(add, [F.abs(bag_a[f"c{i}"] - bag_b[f"c{i}"]) for i in range(len(COMMON))])
    pieces = 2 * (threshold + 1)
    places = [_segment(F.char_length(a), i, pieces) for i in range(pieces)]
    whole = reduce(add, [F.contains(b, F.substring(a, start + 1, size)).cast("int") for start, size in places])
    near = (F.char_length(a) > LONG) | (edit_distance(a, b, threshold) <= threshold)
    return (apart <= 2 * threshold) & (whole >= pieces - threshold) & near


def _lines(docs, least):
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.char_length("line")
    long = n >= least
    return rows.withColumn("n", n).withColumns({
        "k1": F.when(long, F.xxhash64("line")), "k2": F.when(long, F.xxhash64(F.lit(7), F.col("line")))})


def _members(rows):
    """Rows (key, ...) of the keys that two rows or more have, an index entry among them, with the number `m` of its entries."""
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.count_if(F.col("role") == 0).alias("m")).where("c > 1 and m > 0")
    return rows.join(keys.drop("c"), "key")


def _meeting(index, asks):
    """Rows (key, ...) of the keys that an index entry and any other row have.

    Most keys are of one row only and go after one exchange: the asking rows are held against the keys of the index, and the
    index against the keys that were asked for or that it has twice.
    """
    asked = staged(asks.join(index.select("key").hint("shuffle_hash"), "key", "left_semi"))
    wanted = asked.select("key").distinct().withColumn("asked", F.lit(True))
    counted = index.withColumn("c", F.count("*").over(Window.partitionBy("key"))).join(wanted, "key", "left")
    return asked.unionByName(counted.where("c > 1 or asked").drop("c", "asked"))


def _pairs(left, right, threshold):
    """Pairs (a, b) of ids of both sides that share a key and are alike: texts are looked at where they meet, so what is written
    does not grow with the square of a bucket."""
    both = left.select("key", F.col("id").alias("x"), F.col("line").alias("line_x"), F.col("bag").alias("bag_x")).join(
        right.select("key", F.col("id").alias("y"), "entry", F.col("line").alias("line_y"), F.col("bag").alias("bag_y")), "key")
    once = F.when(F.col("entry"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
    both = both.where(once & alike(F.col("line_x"), F.col("line_y"), F.col("bag_x"), F.col("bag_y"), threshold))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rests(members, threshold):
    """Pairs of buckets whose index entries have at most `threshold` characters left. Rows with no more than that are all within
    the threshold of each other, so one link each will do; the few longer ones meet every index entry."""
    tight = F.char_length("line") - F.col("size") <= threshold
    entries = members.where("role = 0")
    lead = entries.groupBy("key").agg(F.min(F.struct("id", "line", "bag")).alias("lead")).select("key", "lead.*")
    return _pairs(lead, members.where(tight).withColumn("entry", F.lit(False)), threshold).unionByName(
        _pairs(entries, members.where(~tight).withColumn("entry", F.col("role") == 0), threshold))


def _split(hot, threshold):
    """The rows of large buckets under keys of one segment more: two rows that are within the threshold and share a segment
    are so without it, and must share a segment of what is left."""
    rest = hot.select("id", F.col("key").alias("above"), (F.col("base") - F.col("size")).alias("base0"),
                      F.concat(F.expr("substring(line, 1, start)"), F.expr("substring(line, start + size + 1)")).alias("line"))
    rest = rest.withColumn("n", F.char_length("line"))
    of_delta = F.array(*[F.array(*[p for p, place in zip(_place_table(threshold), _places(threshold)) if place[0] == d])
                         for d in range(threshold + 1)])
    rows = rest.select("id", "line", "above", "n", F.col("base0").alias("base"), F.inline(F.get(of_delta, F.col("n") - F.col("base0"))))
    start, size = _segment(F.col("base"), F.col("i"), threshold + 1)
    rows = rows.withColumns({"start": start + F.col("shift"), "size": size}).where(
        (F.col("base") >= threshold + 1) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    key = F.xxhash64("above", "i", "base", F.expr("substring(line, start + 1, size)"))
    return rows.select("id", "line", "role", "base", "start", "size", key.alias("key")).distinct().withColumn("bag", bag("line"))


def edit_links(lines, threshold):
    """Pairs (a, b) of ids whose lines may be within the threshold, and enough of them that all links between lines of a
    bucket are found; `lines` has id, line, its bag, and the rows of `_members`."""
    level, pairs = lines, None
    while True:  # each level takes a segment of one character at least from lines of threshold + 1 or more, so it ends
        few, hot = level.where(F.col("m") <= BUCKET), level.where(F.col("m") > BUCKET)
        met = _pairs(few.where("role = 0"), few.withColumn("entry", F.col("role") == 0), threshold)
        small = hot.where(F.col("base") - F.col("size") < threshold + 1)
        found = staged(met.unionByName(_rests(small, threshold)).distinct())
        pairs = found if pairs is None else pairs.unionByName(found)
        hot = hot.where(F.col("base") - F.col("size") >= threshold + 1)
        if hot.isEmpty():
            return pairs.distinct()
        level = staged(_members(_split(hot, threshold)))


def dedup_lines(docs, threshold=1, min_chars=10, short_copies=False):
    """(doc_id, line_no, n_chars, class_doc, class_line, kept): a row per line of every document.

    Lines are what newlines separate. Lines of `min_chars` code points or more are linked when their edit distance is at most
    `threshold`; a class is what links connect, named by its first line in the order of (doc_id, line_no), which is the one
    kept. Shorter lines, empty ones too, are layout: no class, kept; with `short_copies` only empty lines are, and shorter ones
    form classes of exact copies.

    Method: a line is cut into threshold + 1 segments, one of which a line within the threshold must contain unchanged, near
    the same place. Distinct lines meet at the hashes of (length, segment number, segment); lines that are up to `threshold`
    longer probe the places where the segment can lie, ROUNDS classes of lengths one after the other. Buckets of more than
    BUCKET index entries are split by a segment of what is left of the lines, again and again; in the others each row is held
    against all entries, by conditions of the join. What passes is verified on a band of the matrix.

    A null text has no lines; a null doc_id orders first; rows that repeat a doc_id repeat its lines, and copies of the kept
    line under one (doc_id, line_no) are all kept. No rows give no rows. Other columns are not read. min_chars must exceed
    2 * threshold + 1.
    """
    if min_chars < 2 * threshold + 2 or not 0 <= threshold <= 15:
        raise ValueError("min_chars must be at least 2 * threshold + 2, and threshold from 0 to 15")
    parts, width = threshold + 1, 2 * (threshold + 1)
    docs = docs.select("doc_id", "text")
    rows = _lines(docs, 1 if short_copies else min_chars)
    # Lengths are dealt to the rounds in stretches of `width`, so a line probes in its own round and, if it is one of the first
    # `threshold` lengths of its stretch (odd numbers), in the one before.
    early = (F.col("n") % width < threshold).cast("int")
    compared = F.when(F.col("n") >= min_chars, F.floor(F.col("n") / F.lit(width)) % ROUNDS * 2 + early).otherwise(-1).cast("int")
    distinct = staged(rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"),
        F.min(F.when(F.col("n") >= min_chars, F.col("line"))).alias("line")).withColumn("round", compared), "round")

    places = [(0 if delta == 0 and shift == 0 else 1, slot, delta, i, shift)
              for slot, (delta, i, shift) in enumerate(_places(threshold))]

    def keyed(role, turn):
        """Rows (k1, slot, key) of one role and one round; texts come later, to the few lines whose keys meet."""
        wanted = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(p[1:], ("slot", "delta", "i", "shift"))])
                           for p in places if p[0] == role])
        held = distinct.where(F.col("round").isin(2 * turn, 2 * turn + 1, *[(2 * turn + 3) % (2 * ROUNDS)] * role))
        raw = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary"))  # a place in it needs no search
        rows = held.select("k1", "n", "line", raw.alias("raw"), F.inline(wanted)).withColumn("base", F.col("n") - F.col("delta"))
        start, size = _segment(F.col("base"), F.col("i"), parts)
        start = start + F.col("shift")
        rows = rows.where((F.floor(F.col("base") / F.lit(width)) % ROUNDS == turn) & (F.col("base") >= min_chars)
                          & (start >= 0) & (start + size <= F.col("n")))
        part = F.coalesce(F.substring("raw", start + 1, size), F.substring("line", start + 1, size).cast("binary"))
        return rows.select("k1", F.col("slot").cast("short").alias("slot"), F.xxhash64("i", "base", part).alias("key"))
    found = [staged(_meeting(keyed(0, turn), keyed(1, turn))) for turn in range(ROUNDS)]
    met = reduce(lambda x, y: x.unionByName(y), found)
    own = [slot for role, slot, *_ in places if role == 0]
    sizes = met.groupBy("key").agg(F.count_if(F.col("slot").isin(own)).alias("m"))
    members = staged(met.join(sizes, "key"))

    ids = members.select("k1").distinct()
    place = F.shiftrightunsigned("k1", 44)
    wanted = F.broadcast(ids.select(place.alias("_p")).distinct())  # 2^20 rows at most, whatever the input
    texts = distinct.where(F.col("round") >= 0).select("k1", "k2", "line").join(wanted, place == F.col("_p"), "left_semi") \
        .join(ids, "k1", "left_semi")
    name = F.concat_ws(":", F.hex("k1"), F.hex("k2"))
    texts = staged(texts.withColumns({"id": name, "n": F.char_length("line"), "bag": bag("line")}))
    placed = members.select("k1", "key", "m", F.get(F.array(*_place_table(threshold)), F.col("slot").cast("int")).alias("p"))
    placed = placed.join(texts, "k1").select("id", "line", "bag", "key", "m", "p.*",
                                             (F.col("n") - F.col("p.delta")).cast("int").alias("base"))
    start, size = _segment(F.col("base"), F.col("i"), parts)
    lines = placed.select("id", "line", "bag", "role", "base", (start + F.col("shift")).cast("int").alias("start"),
                          size.cast("int").alias("size"), "key", "m")
    pairs = edit_links(lines, threshold)
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    links = pairs.join(left, "a").join(right, "b").where(
        trimmed_distance(F.col("line_a"), F.col("line_b"), threshold) <= threshold)

    classes = components(links.select("a", "b")).join(texts.select("id", "k1", "k2"), "id").select("component_id", "k1", "k2")
    # Read twice below: written once, the plan of the result holds neither the components nor this join, whatever their size.
    firsts = staged(classes.join(distinct.select("k1", "k2", "first"), ["k1", "k2"]).select("component_id", "k1", "k2", "first"))
    lead = firsts.groupBy("component_id").agg(F.min("first").alias("lead"))
    leads = firsts.join(lead, "component_id").select("k1", "k2", "lead")
    # A line without a copy or link is its own class, so only the others are looked up; layout is dealt by row and finds nothing.
    named = distinct.where("copies > 1").select("k1", "k2", "first").join(leads, ["k1", "k2"], "full").select(
        F.col("k1").alias("d1"), F.col("k2").alias("d2"), F.coalesce("lead", "first").alias("lead"))
    dealt = F.coalesce("k1", F.xxhash64("doc_id", "line_no"))
    judged = rows.select("doc_id", "line_no", "n", "k1", "k2", dealt.alias("d")).join(
        named.hint("shuffle_hash"), (F.col("d") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left")
    own = F.struct("doc_id", "line_no")
    judged = judged.withColumn("lead", F.when(F.col("k1").isNotNull(), F.coalesce("lead", own)))
    return judged.select(
        "doc_id", "line_no", F.col("n").alias("n_chars"), F.col("lead.doc_id").alias("class_doc"),
        F.col("lead.line_no").alias("class_line"),
        (F.col("k1").isNull() | (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("line_no") == F.col("lead.line_no"))))
        .alias("kept"))


def without_repeats(docs, **options):
    """(doc_id, text): the documents with their kept lines only, in order; a document without one has an empty text."""
    lines = dedup_lines(docs, **options).select("doc_id", "line_no", "kept")
    text = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    joined = text.join(lines.distinct(), ["doc_id", "line_no"])
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "line")))), lambda x: x["line"])
    return joined.groupBy("doc_id").agg(F.array_join(kept, "\n").alias("text"))
