"""Merkle manifest, whitening and the cuckoo index against plain code, with edge rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlake.llm import cuckoo, merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, _mk_g int, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, "p", 1, "k") for i, t, g, s, n in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(level):
    """Root and, per leaf, its steps, by plain lists."""
    steps = [[] for _ in level]
    under = [[i] for i in range(len(level))]
    while len(level) > 1:
        runs = [(level[k:k + 8], under[k:k + 8]) for k in range(0, len(level), 8)]
        for nodes, below in runs:
            for slot, leaves in enumerate(below):
                for i in leaves:
                    steps[i].append(("".join(nodes[:slot]), "".join(nodes[slot + 1:])))
        level, under = [h(*nodes) for nodes, _ in runs], [sum(below, []) for _, below in runs]
    return level[0], steps


def plain_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof)} of (doc_id, lang, leaf) rows."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in groups[g]]) for g in order}
    root, upper = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, upper):
        for (doc_id, _, leaf), path in zip(groups[g], trees[g][1]):
            out.append((doc_id, leaf, trees[g][0], root, h(*[b + a for b, a in path + up])))
    return sorted(out, key=str)


def test_manifest_against_plain_tree(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {i}", "big", "s", i) for i in range(4096 * 2 + 9)]  # a block and more in one group, three window levels up
    rows += [(i, "t", f"l{i % 11}", None, None) for i in range(20_000, 20_100)] + [(1, "é😀", "", "s", 0), (None, None, None, None, None)]
    rows += [(7, "Same", "eq", "s", 4)] * 3 + [(7, "other", "eq", "s", 4), (None, "n", "eq", "s", 4)]
    rng.shuffle(rows)
    leaves = merkle.leaves(docs_of(spark, rows), F.col("doc_id") % 2 == 0)
    found = merkle.manifest(leaves, "leaf", "lang").withColumn("proof", merkle.proof_digest(F.col("path"))).withColumn(
        "folded", merkle.fold(F.col("path"), F.coalesce("tampered", "leaf"))).collect()

    def leaf(i, t, g, s, n):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, g, n, t)])
    want = plain_manifest([(r[0], r[2], leaf(*r)) for r in rows])
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found), key=str) == want
    text = {r[0]: r[1] for r in rows}
    for r in found:
        if r.doc_id != 7:  # repeated ids have several texts
            touched = r.doc_id is not None and r.doc_id % 2 == 0 and text[r.doc_id] != text[r.doc_id].lower()
            assert (r.folded == r.root) == (not touched)


@pytest.mark.parametrize("n", [0, 1, 9])
def test_small_trees(spark, n):
    rows = spark.createDataFrame([(i, None, h(str(i)), "x") for i in range(n)], "doc_id long, lang string, leaf string, root string")
    found = merkle.manifest(rows, "leaf", "lang").collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root) for r in found), key=str) == [
        r[:4] for r in (plain_manifest([(i, None, h(str(i))) for i in range(n)]) if n else [])]


def test_long_and_empty_texts_in_leaves(spark):
    rows = [(1, "A" * 2_000_000, "x", "s", 1), (2, "", "x", "s", 1), (3, None, "x", "s", 1)]
    got = {r.doc_id: (r.leaf, r.tampered) for r in merkle.leaves(docs_of(spark, rows), F.lit(True)).collect()}
    assert got[1] == (h("1:1", "1:s", "1:x", "1:1", "2000000:" + "A" * 2_000_000), h("1:1", "1:s", "1:x", "1:1", "2000000:" + "a" * 2_000_000))
    assert got[2] == (h("1:2", "1:s", "1:x", "1:1", "0:"),) * 2 and got[3] == (h("1:3", "1:s", "1:x", "1:1", "-"),) * 2


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (7, 7), (24, 24), (24, 5), (64, 64)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -2, rank)
        scatter = a @ a.T
        factor, order = whitening.pivoted_cholesky(scatter)
        assert np.abs(factor @ factor.T - scatter[np.ix_(order, order)]).max() < 1e-13 * np.trace(scatter)
        assert factor.shape[1] <= rank and not np.triu(factor, 1).any()
        values, parts = whitening.principal(scatter)
        want, vectors = np.linalg.eigh(scatter)
        k = min(len(values), 4)
        assert np.allclose(values[:k], want[::-1][:k], rtol=1e-9, atol=0), (d, rank)
        assert np.abs(parts.T @ parts - np.eye(parts.shape[1])).max() < 1e-12
        assert np.abs(np.abs((parts[:, :k] * vectors[:, ::-1][:, :k]).sum(0)) - 1).max() < 1e-9
    assert whitening.principal(np.zeros((3, 3)))[0].size == 0


VECTORS = "vec_id long, embedding array<float>, x string, component int"


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * 0.3).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(data)] + [(1000 + i, data[0].tolist(), "x", 1) for i in range(50)]
    rows += [(2000, None, "x", 1), (2001, [1.0, None] + [0.0] * 4, "x", 1), (2002, [float("nan")] * 6, None, 1), (2003, [], "x", 1),
             (2004, [float("-inf")] + [0.0] * 5, "x", 1), (2005, [1.0, 2.0], "x", 1), (None, data[3].tolist(), "x", 1)]
    prepared = whitening.integers(spark.createDataFrame(rows, VECTORS))
    model = whitening.fit(prepared)
    found = whitening.whiten(prepared, model).collect()
    x = np.floor(data.astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = (x - s / n) @ vectors / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(1)
    assert len(found) == 4 * 351 and {r.n for r in found} == {n}
    trace = np.trace(centred.T @ centred / n)
    for r in found:
        at = 3 if r.vec_id is None else 0 if r.vec_id >= 1000 else r.vec_id
        k = r.component - 1
        assert r.deviation == deviation[at] and abs(abs(r.whitened) - abs(want[at, k])) < 1e-9
        assert abs(r.explained - values[k] / trace) < 1e-9 and r.identity_error < 1e-10
    signs = {(r.component, np.sign(r.whitened * want[r.vec_id, r.component - 1])) for r in found if r.vec_id is not None and r.vec_id < 300}
    assert len(signs) == 4


def test_whitening_of_little_and_large(spark):
    def run(rows):
        v = whitening.integers(spark.createDataFrame(rows, VECTORS))
        return whitening.whiten(v, whitening.fit(v)).collect()
    assert run([]) == [] and run([(1, [1.0, 2.0], "", 1)] * 3) == []
    line = run([(i, [float(i), 2.0 * i, 5.0], "", 1) for i in range(4)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    big = run([(1, [3e30, 0.0], "", 1), (2, [0.0, 1.0], "", 1)])
    assert [r.deviation for r in big] == [None, None]
    wide = run([(i, [float(i % 7) * 1e7, float(i) * 1e7], "", 1) for i in range(50)])
    x = [(int(i % 7) * 2560000000, i * 2560000000) for i in range(50)]
    s = [sum(v[k] for v in x) for k in (0, 1)]
    exact = [sum((50 * v[k] - s[k]) ** 2 for k in (0, 1)) for v in x]
    assert {r.vec_id: r.deviation for r in wide} == {i: v if v < 2 ** 63 else None for i, v in enumerate(exact)}


def keys_of(rng, n):
    return rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)


def test_filter_keeps_what_it_holds():
    rng = np.random.default_rng(5)
    f, keys = cuckoo.Cuckoo(4), keys_of(rng, 5000)
    keys[::50, 1:3] = keys[0, 1:3]  # same bucket and tag, other digest: only the stored digest tells them apart
    keys = keys[:4000]
    few = keys_of(rng, 200)
    few[:, 2] = 9  # one tag for all
    f.insert(few, np.arange(200), np.ones(200, bool), np.ones(200, np.int64))
    assert f.resized > 0 and (f.find(few) >= 0).all()
    plain = cuckoo.Cuckoo(4)
    other = keys_of(rng, 5000)
    for lo in range(0, 5000, 700):
        part = other[lo:lo + 700]
        plain.insert(part, np.arange(lo, lo + len(part)), np.ones(len(part), bool), np.ones(len(part), np.int64))
    assert plain.resized > 0 and (plain.ids[plain.find(other)] == np.arange(5000)).all()
    assert (plain.find(keys_of(rng, 5000)) < 0).all()
    plain.delete(other[::2])
    assert (plain.find(other[::2]) < 0).all() and (plain.find(other[1::2]) >= 0).all()
    plain.delete(other[::2])
    plain.insert(other[::2], np.arange(2500), np.zeros(2500, bool), np.ones(2500, np.int64))
    assert (plain.find(other) >= 0).all() and (plain.tags != 0).sum() == 5000


def test_exact_duplicates_of_edge_rows(spark):
    rows = [(1, "a", "", "", 0), (9, "a", "", "", 0), (9, "a", "", "", 0), (None, "a", "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0),
            (None, "only", "", "", 0), (4, "A", "", "", 0), (5, "a ", "", "", 0), (6, "x" * 3_000_000, "", "", 0), (-7, "x" * 3_000_000, "", "", 0)]
    rows += [(100 + i, "hot", "", "", 0) for i in range(30_000)]
    got = cuckoo.exact_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    plain = {}
    for i, t, *_ in rows:
        plain.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t for t in plain if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in plain[text] if i is not None]
        assert r.group_size == len(plain[text]) and r.keep_id == (max(ids) if ids else None) and r.kept == (r.doc_id == r.keep_id)
    assert cuckoo.exact_duplicates(docs_of(spark, [])).collect() == []


def test_index_takes_inserts_and_deletes(spark, monkeypatch):
    def d(ids_texts):
        return cuckoo.digests(spark.createDataFrame(ids_texts, "doc_id long, text string"))

    def held(index):
        return {r.digest: (r.keep_id, r.group_size) for r in index.collect()}
    one = d([(i, f"t{i % 300}") for i in range(600)])
    index = cuckoo.update(None, one)
    again = cuckoo.update(index, d([(1000, "t5"), (1, "t6"), (2000, "new")]), d([(0, "t7"), (0, "absent")]))
    want = {hashlib.sha256(f"t{k}".encode()).digest(): (k + 300, 2) for k in range(300) if k != 7}
    want[hashlib.sha256(b"t5").digest()], want[hashlib.sha256(b"t6").digest()] = (1000, 3), (306, 3)
    want[hashlib.sha256(b"new").digest()] = (2000, 1)
    assert {bytes(k): v for k, v in held(again).items()} == want
    assert cuckoo.resolve(d([(0, "t7"), (0, "t8")]), again).count() == 1
    monkeypatch.setattr(cuckoo, "SHARD_DIGESTS", 10)
    more = cuckoo.update(again, d([(3000, "t8")]))
    want[hashlib.sha256(b"t8").digest()] = (3000, 3)
    assert {bytes(k): v for k, v in held(more).items()} == want and more.select("shards").distinct().first()[0] > 8
    assert held(cuckoo.update(more, deleted=d([(0, f"t{k}") for k in range(300)]))) != {} and cuckoo.update(None, d([])).count() == 0


def test_manifest_climbs_without_windows(spark):
    """A window a level, each holding a block's rows with 14 digests more, took more memory than an executor has."""
    rows = spark.createDataFrame([(i, "en", h(str(i))) for i in range(20)], "doc_id long, lang string, leaf string")
    plan = merkle.manifest(rows, "leaf", "lang")._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "lead(" not in plan
