"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probability."""

from functools import reduce

from pyspark.sql import functions as F

from commentlake.llm.staging import fresh
from commentlake.session import materialize

TOLERANCE = 1e-9  # relative gap of a margin that counts as met
SWEEPS = 100  # at most


def tokens(text):
    """Words between ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_by_marks(text):
    """A coarse topic from the marks a text is set with; null texts are prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("%%%")), "marked") \
        .when(F.contains(text, F.lit("!! ")), "shout").otherwise("prose")


def _class(c):
    """Null is a class of its own, apart from every string."""
    return F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))


def _target(cells, dim, wanted):
    """(class, target share): a power of the observed share, or the shares given, made to sum to 1 over the classes present."""
    seen = cells.groupBy(dim).agg(F.sum("t").alias("n"))
    total = seen.agg(F.sum("n").cast("double")).scalar()
    if isinstance(wanted, (int, float)):
        raw = F.pow(F.col("n") / total, F.lit(float(wanted)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in ("-" if k is None else f"+{k}", float(v))])
        raw = F.coalesce(F.get(F.array(F.try_element_at(given, F.col(dim))), F.lit(0)), F.lit(0.0))
    shares = materialize(seen.where("n > 0").withColumn("raw", raw))
    whole = shares.agg(F.sum("raw")).scalar()
    return materialize(shares.select(dim, F.when(whole > 0, F.col("raw") / whole).otherwise(F.lit(0.0)).alias(f"{dim}_share")))


def rake(cells, targets, sweeps=SWEEPS, tolerance=TOLERANCE):
    """(cells with their raked weight `w`, gap): every sweep scales the weights to one margin after the other.

    `cells` has a column per dimension and the tokens `t`; `targets` maps each dimension to an exponent of its observed shares
    or to {class: share}. Shares are taken over the classes that occur; a class without a share gets weight 0.

    Sweeps go on until no margin was off by more than the tolerance, relative to its target, when its turn came. The gap is the
    most that one was off in the last sweep. Margins that contradict each other cannot be met (two dimensions that always go
    together, say): once the gap has not shrunk by a thousandth over three sweeps, or after `sweeps`, raking ends with
    a gap above the tolerance, and the last dimension's margin is met exactly.
    """
    total = F.lit(float(cells.agg(F.sum("t")).first()[0] or 0))
    shares = {dim: _target(cells, dim, wanted) for dim, wanted in targets.items()}
    held = reduce(lambda c, d: c.join(shares[d], d), targets, cells.withColumn("w", F.col("t").cast("double")))
    cells = materialize(held)
    gap, stalled = 0.0, 0
    for sweep in range(sweeps):
        cells = cells.withColumn("_off", F.lit(0.0))
        for dim in targets:
            margin = cells.groupBy(dim).agg(F.sum("w").alias("_m"))
            goal = F.col(f"{dim}_share") * total
            scale = F.when(F.col("_m") > 0, goal / F.col("_m")).otherwise(F.lit(0.0))
            off = F.when(goal > 0, F.abs(F.col("_m") / goal - 1)).otherwise(F.lit(0.0))
            cells = cells.join(margin, dim).withColumns({"w": F.col("w") * scale, "_off": F.greatest("_off", off)}).drop("_m")
        cells = materialize(cells)
        before, gap = gap, float(cells.agg(F.max("_off")).first()[0] or 0)
        stalled = stalled + 1 if sweep > 1 and gap > 0.999 * before else 0
        if gap <= tolerance or stalled == 3:
            break
    return cells.drop("_off", *[f"{d}_share" for d in targets]), gap


def mix(docs, targets, size="tokens", rate=1.0, seed="mix-1", sweeps=SWEEPS, id_col="doc_id", strict=False):
    """Every row with `weight` (what one of its tokens counts for), `probability`, `margin_gap` and `sampled`.

    Weights come from raking the cells of the dimensions in `targets`. `margin_gap` says by how much the targets are missed (see
    `rake`), the same for all rows: at most TOLERANCE unless they cannot be met; with `strict`, missed targets raise. The
    probability is rate * weight / largest weight, at most 1: at rate 1 it is the highest for which the expected margins are the
    targets. A row is sampled when a uniform number from md5(seed:id) lies below its probability, so rows of one id stay
    or go together.

    A null class is a class of its own; a null id hashes as an empty one; rows of size 0 or null take the weight of their cell;
    a cell without tokens has weight 0. No rows give no rows. Columns named weight, probability, margin_gap, sampled are
    replaced.

    Only one row per cell is kept for raking, and cells go by shuffles, so the number of sources is not limited.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("weight", "probability", "margin_gap", "sampled")])
    *names, per_token = fresh(docs, *[f"_mix_{i}" for i in range(len(targets))], "_mix_w")
    dims = dict(zip(names, targets.values()))
    keyed = docs.withColumns({name: _class(c) for name, c in zip(names, targets)})
    cells = materialize(keyed.groupBy(*dims).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("t")))
    raked, gap = rake(cells.where("t > 0"), dims, sweeps)
    if strict and gap > TOLERANCE:
        raise ValueError(f"the target weights cannot be met: a margin is off by a share of {gap:.3g}")
    raked = materialize(raked.select(*dims, (F.col("w") / F.col("t")).alias(per_token)))
    largest = F.lit(float(raked.agg(F.max(per_token)).first()[0] or 0))
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text_id)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    weight = F.coalesce(per_token, F.lit(0.0))
    chance = F.when(largest > 0, F.least(F.lit(1.0), F.lit(float(rate)) * weight / largest)).otherwise(F.lit(0.0))
    return keyed.join(raked, list(dims), "left").select(
        *docs.columns, weight.alias("weight"), chance.alias("probability"), F.lit(gap).alias("margin_gap"),
        (uniform < chance).alias("sampled"))
