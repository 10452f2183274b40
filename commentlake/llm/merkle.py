"""Merkle manifest of a table: a leaf per row, a tree of eights per group, a tree of eights over the groups, a proof per row.

The rows of a group are numbered first. Blocks of 4,096 consecutive nodes are then gathered as arrays: every eight elements of a
level's array are hashed to one of the next, and a node's siblings are the other elements of its run.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from commentlake.llm.staging import staged
from commentlake.operators.scale import join_checked

FAN = 8
DEPTH = 4  # levels climbed in one block
BLOCK = FAN ** DEPTH
STEPS = "array<struct<before:string,after:string>>"


def digest(*columns):
    """Hex SHA-256 of the columns, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return _h(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _h(*parts):
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(path, own):
    """The root that `own` and the siblings of `path` give."""
    return F.aggregate(path, own, lambda acc, s: _h(s["before"], acc, s["after"]))


def proof_digest(path):
    """Hex SHA-256 of all siblings of a path, level by level, left to right."""
    return _h(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def _numbered(rows, order):
    """Adds _mk_p, the place in the group from 0, and _mk_n, the size of the group.

    Rows are cut into ranges by (group, order), so a group may span any number of tasks; what is gathered is one count per
    range and group. Rows that are equal in every key are interchangeable and are cut by their place in the input.
    """
    keys = ["_mk_g", *order, "_mk_i"]
    ranged = rows.withColumn("_mk_i", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(ranged.drop("_mk_i").withColumn("_mk_s", F.monotonically_increasing_id()).withColumn(
        "_mk_part", F.shiftright("_mk_s", 33)))
    counts = placed.groupBy("_mk_part", "_mk_g").agg(F.count("*").alias("_mk_c"), F.min("_mk_s").alias("_mk_first"))
    group = Window.partitionBy("_mk_g")
    before = group.orderBy("_mk_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_mk_part", "_mk_g", F.sum("_mk_c").over(group).alias("_mk_n"), (
        F.coalesce(F.sum("_mk_c").over(before), F.lit(0)) - F.col("_mk_first")).alias("_mk_o"))
    out = join_checked(placed, offsets, ["_mk_part", "_mk_g"], "inner").withColumn("_mk_p", F.col("_mk_s") + F.col("_mk_o"))
    return out.drop("_mk_part", "_mk_s", "_mk_o")


def _blocks(nodes):
    """A row per block of 4,096 nodes of a group (_mk_g, _mk_b): its nodes in order as _mk_rows, and the digests of each level as
    _mk_a0 to _mk_a4, an array an eighth as long as the one before. Nothing larger than a block is ever gathered."""
    held = F.struct(*[F.col(f"`{c}`") for c in nodes.columns if c != "_mk_g"])
    out = nodes.groupBy("_mk_g", F.shiftright("_mk_p", 3 * DEPTH).alias("_mk_b")).agg(F.collect_list(held).alias("_mk_rows"))
    # Each array is a column that later ones use, so it is computed once a block.
    out = out.withColumn("_mk_rows", F.array_sort("_mk_rows", lambda x, y: F.signum(x["_mk_p"] - y["_mk_p"]).cast("int")))
    out = out.withColumn("_mk_n", F.get("_mk_rows", 0)["_mk_n"]).withColumn("_mk_a0", F.transform("_mk_rows", lambda r: r["_mk_d"]))
    for level in range(DEPTH):
        below = f"_mk_a{level}"
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        parents = F.transform(runs, lambda i: _h(F.array_join(F.slice(below, i * FAN + 1, FAN), "")))
        out = out.withColumn(f"_mk_a{level + 1}", F.when(_nodes(level) > 1, parents).otherwise(F.col(below)))
    return out


def _unfolded(blocks, names, *others):
    """The named columns of the nodes and `others` of their blocks, and _mk_path, each node's steps inside its block."""
    def step(level, i):
        place = F.shiftright(i, 3 * level)
        slot = place % FAN
        around = [(place - slot + 1, slot), (place + 2, FAN - 1 - slot)]
        sides = [F.array_join(F.slice(f"_mk_a{level}", at, many), "") for at, many in around]
        return F.when(_nodes(level) > 1, F.struct(sides[0].alias("before"), sides[1].alias("after")))

    def row(r, i):
        path = F.filter(F.array(*[step(level, i) for level in range(DEPTH)]), lambda s: s.isNotNull())
        return F.struct(*[r[c].alias(c) for c in names], path.alias("_mk_path"))
    return blocks.select("_mk_g", *others, F.inline(F.transform("_mk_rows", row)))


def _nodes(level):
    """Nodes of a whole group at a level."""
    return F.shiftright(F.col("_mk_n") + (FAN ** level - 1), 3 * level)


def _roots_of_blocks(nodes):
    return _blocks(nodes).select("_mk_g", F.col("_mk_b").alias("_mk_p"), _nodes(DEPTH).alias("_mk_n"),
                                 F.get(f"_mk_a{DEPTH}", 0).alias("_mk_d"))


def _paths(nodes, finish):
    """The nodes with their paths; `finish` turns one row per group (its root as _mk_d) into _mk_g, _mk_p, up (path) and further columns.

    The table of block roots is 4,096 times smaller than the one below it, and each is written once. Paths are handed down by
    joins on (group, block), one row a block on either side.
    """
    most = nodes.agg(F.max("_mk_n")).first()[0] or 0
    tables = [nodes]
    while most > 1 or len(tables) == 1:
        tables.append(staged(_roots_of_blocks(tables[-1])))
        most = -(-most // BLOCK)
    upper = finish(tables[-1])
    for level, below in enumerate(reversed(tables[:-1]), 1):
        extra = [c for c in upper.columns if c not in ("_mk_g", "_mk_p", "up")]
        joined = _blocks(below).join(upper.withColumnRenamed("_mk_p", "_mk_b"), ["_mk_g", "_mk_b"])
        kept = below.columns if level == len(tables) - 1 else ["_mk_g", "_mk_p"]
        upper = _unfolded(joined, [c for c in kept if c != "_mk_g"], "up", *extra).select(
            *kept, F.concat("_mk_path", "up").alias("up"), *extra)
        if level < len(tables) - 1:
            upper = staged(upper)
    return upper


def manifest(rows, leaf="leaf", group="lang", order=("doc_id",)):
    """All columns of `rows` plus subroot, root and path (steps of siblings before and after the own node, leaf first).

    `leaf` names the column of leaf digests. Leaves of a group ascend by `order` (nulls first, ties by leaf). While several nodes
    remain, every eight consecutive ones, the last run as few as remain, are hashed to one; a lone leaf is its group's root. The
    groups' roots, ordered by group (null first, then by UTF-8 bytes), give the root in the same way.

    No rows give no rows; null groups are one group; repeated rows are leaves of their own; columns named subroot, root or path
    or beginning with `_mk_` are replaced.

    Scale: only digests and the given columns move (no texts, if `rows` has none): once to be numbered, twice to blocks of 4,096.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("subroot", "root", "path") or c.lower().startswith("_mk_")])
    keyed = rows.withColumn("_mk_g", F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")))
    nodes = _numbered(staged(keyed), [*order, leaf]).withColumn("_mk_d", F.col(leaf))

    def over_groups(roots):
        named = roots.select(F.lit("").alias("_mk_g"), F.col("_mk_g").alias("_mk_name"), "_mk_d")
        top = _paths(_numbered(named, ["_mk_name"]), lambda one: one.select(
            "_mk_g", "_mk_p", F.array().cast(STEPS).alias("up"), F.col("_mk_d").alias("root")))
        return staged(top.select(F.col("_mk_name").alias("_mk_g"), F.lit(0).cast("long").alias("_mk_p"), "up",
                                 F.col("_mk_d").alias("subroot"), "root"))
    found = _paths(nodes, over_groups)
    return found.select(*rows.columns, "subroot", "root", F.col("up").alias("path"))


def lower_ascii(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaves(docs, changed=None, fields=("doc_id", "source", "lang", "n_chars", "text"), text="text"):
    """Id, lang, leaf and tampered: the leaf of the row with its text's A-Z lower-cased where `changed` holds, else null."""
    after = [lower_ascii(F.col(c)) if c == text else c for c in fields]
    tampered = F.when(changed, digest(*after)) if changed is not None else F.lit(None).cast("string")
    return docs.select("doc_id", "lang", digest(*fields).alias("leaf"), tampered.alias("tampered"))
