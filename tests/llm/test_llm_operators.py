"""The training-data operators: brute force, edge rows and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlake.llm import bottomk, line_dedup, minhash, mixing, preference, privacy, revisits, sharding, toxicity, winnowing
from commentlake.llm.oracles import llm_oracles
from commentlake.llm.queries import llm_queries

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _b int, shard string"
EDGES = [
    (1, "The quick brown fox jumps over it", "en", "a", 33, 1, "x"), (1, "The quick brown fox jumps over it", "en", "a", 33, 1, "x"),
    (2, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "x"), (None, "no id here at all", "de", None, 17, 2, "y"),
    (4, "word " * 30_000, "en", "b", 150_000, 3, None), (5, "😀é ab", "fr", "b", 5, 3, "z"), (6, "x" * 3_000_000, "en", "b", 1, 1, "x"),
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_matches_duckdb(spark, name):
    assert compare(spark, connect(SF), name, llm_queries()[name], llm_oracles()[name], SF) is None


def test_edge_rows_keep_their_rows(spark):
    docs, none = frame(spark), frame(spark, [])
    items = spark.createDataFrame([(7, "quick brown fox", 1), (8, None, 1), (None, "it", 1)], "item_id long, text string, doc_id int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    runs = {
        "near": lambda d: minhash.near_duplicates(d), "leaks": lambda d: winnowing.leaks(d, items),
        "prints": lambda d: bottomk.fingerprint_neighbours(d), "shards": lambda d: sharding.interleave(d, 3),
        "private": lambda d: privacy.find_private(d, privacy.fit(d)), "toxic": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "quality": lambda d: preference.score(d, preference.fit(d, labels)),
        "mix": lambda d: mixing.mix(d.withColumn("n", mixing.tokens(F.col("text"))), {"source": 0.5, "lang": 0.5}, size="n", sweeps=2),
    }
    for name, run in runs.items():
        assert len(run(docs).collect()) == len(EDGES), name
        assert run(none).collect() == [], name
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(docs).count() == len(EDGES) - 1
    hit = {r.doc_id: (r.n_hit, r.item_ids) for r in winnowing.leaks(docs, items).collect()}
    assert hit[1] == (3, ["7"]) and hit[2] == (0, []) and hit[4] == (0, [])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """The base patterns taken literally."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                  "card": 13 <= len(d) <= 19 and privacy.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (499) 555-6503",
              "+", "7", "é", " ", ".", "-", "%", "\n", "a@b.c@d.e", "00012.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert privacy.base_spans(text) == plain_spans(text), text


def test_field_carries_labels_to_repeats(spark):
    rows = [(i, f"call +1 (499) 555-{1000 + i} or mail a{i}@mail.example.com now", "en", "a", 1, 1, "x") for i in range(300)]
    rows.append((900, "call +1 (499) 555-6503 today. Later: 499555-6503 again, card 12", "en", "a", 1, 1, "x"))
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in privacy.find_private(docs, privacy.fit(docs)).collect()}
    assert [(s.kind, s.start, s.end) for s in found[900].base] == [(3, 5, 22)]
    text = rows[-1][1]
    assert [text[s.start:s.end] for s in found[900].added] == ["499555-6503"]
    assert not any(r.added for i, r in found.items() if i != 900)


def plain_marginals(g, model):
    """Label probabilities of a graph whose edges form no circle, by sums over all labels in both directions."""
    unary, chain, skip = model
    score = g.features @ unary
    left, right = {v for _, v in g.chain}, {u for u, _ in g.chain}
    for i, k in enumerate(g.fixed):
        score[i] += (0 if i in left else chain[0]) + (0 if i in right else chain[:, 0])
        if k >= 0:
            score[i] = [0 if label == k else -1e3 for label in range(privacy.LABELS)]
    near = {i: [] for i in range(len(score))}
    for pairs, table in ((g.chain, chain), (g.skip, skip)):
        for u, v in pairs:
            near[u].append((v, table.T))
            near[v].append((u, table))

    def inward(i, came_from):
        total = score[i].copy()
        for j, table in near[i]:
            if j != came_from:
                x = inward(j, i)[:, None] + table
                total += np.log(np.exp(x - x.max()).sum(0)) + x.max()
        return total
    p = np.array([inward(i, None) for i in range(len(score))])
    p = np.exp(p - p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_evidence_reaches_every_repeat():
    text = "call +14995556503 now " + "then 499555-6503 again " * 40
    g = privacy.Graph(text, privacy.base_spans(text))
    assert len(g.spans) == 41 and g.skip == [(i, i + 1) for i in range(40)]
    model = (np.zeros((privacy.N_FEATURES, privacy.LABELS)), np.zeros((privacy.LABELS,) * 2), 6 * np.eye(privacy.LABELS))
    expected = plain_marginals(g, model)
    short = privacy.Graph("mail a@b.de and a@b", [(0, 5, 11)])
    got, begin = privacy.marginals([short, g, privacy.Graph("", [])], model)
    assert np.abs(got[begin[1]:begin[2]] - expected).max() < 1e-3 and expected[-1].argmax() == 4
    assert np.array_equal(got[begin[1]:begin[2]], privacy.marginals([g], model)[0])


def test_repeats_in_any_form_are_joined():
    def skips(text):
        g = privacy.Graph(text, [])
        return [(g.spans[u][2], g.spans[v][2]) for u, v in g.skip]
    assert skips("code AB12 and then ab12, later") == [("AB12", "ab12,")]
    assert skips("room 12 or room 12 or 13") == [("12", "12")]
    assert ("1111", "4111111111111111") in skips("pay 4111 1111 1111 1111 or 4111111111111111 now")
    assert ("555-6503", "499555-6503") in skips("call (499) 555-6503 or 499555-6503 now")


def planted_texts(rng, n):
    """Texts with numbers that patterns match, the same numbers in forms that none matches (wanted), and numbers that are neither."""
    out = []
    for _ in range(n):
        area, line = rng.randint(200, 999), rng.randint(1000, 9999)
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(digits + c for c in "0123456789" if privacy.luhn(digits + c))
        fours = [card[i:i + 4] for i in range(0, 16, 4)]
        wrong = [*fours[:3], f"{int(fours[3]) // 10:03}{(int(fours[3][3]) + 1) % 10}"]
        parts = [(None, f"+1 (499) {area}-{line}"), (3, rng.choice([f"499{area}-{line}", f"499.{area}.{line}", f"499{area}{line}"])),
                 (None, " ".join(fours)), (2, "/".join(fours)), (None, rng.choice([" ".join(wrong), "-".join(wrong)])),
                 (None, f"300.{rng.randint(0, 255)}.1.{rng.randint(256, 999)}"), (None, str(rng.randint(10 ** 7, 10 ** 10))),
                 (None, str(rng.randint(1900, 2030))), (None, f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}")]
        text, want = "", set()
        for kind, part in parts:
            text += " ".join(rng.choice("or when the order of that part then came later".split()) for _ in range(rng.randint(1, 4))) + " "
            if kind is not None:
                want.add((kind, len(text), len(text) + len(part)))
            text += part + " "
        out.append((text, want))
    return out


def test_added_spans_have_precision_and_recall():
    rng = random.Random(3)
    model = privacy.train([text for text, _ in planted_texts(rng, 300)])
    right = added = wanted = 0
    for text, want in planted_texts(rng, 200):
        g = privacy.Graph(text, base := privacy.base_spans(text))
        got = set(privacy.added_spans(g, privacy.marginals([g], model)[0], base))
        right, added, wanted = right + len(got & want), added + len(got), wanted + len(want)
    assert right / added > 0.95 and right / wanted > 0.6, (right, added, wanted)
    broken = "or 4111 1111 1111 1112 or"
    g = privacy.Graph(broken, [])
    assert privacy.added_spans(g, privacy.marginals([g], model)[0], []) == []


def test_graphs_that_swing_settle_without_their_circles():
    rng = np.random.default_rng(0)
    text = " and ".join(["12 34 12 34 12 56 34", "34 78 56", "78 12 90 12"] * 3)
    g, calm = privacy.Graph(text, []), privacy.Graph("12 34", [])
    skip = rng.normal(size=(5, 5)) - 5 * np.eye(5)
    model = rng.normal(size=(privacy.N_FEATURES, 5)), 6 * rng.normal(size=(5, 5)), skip + skip.T
    got, begin = privacy.marginals([calm, g], model, patience=64)
    assert calm.settled and not g.settled
    tree = privacy.Graph(text, [])
    tree.skip = privacy._forest(tree)
    assert 0 < len(tree.skip) < len(g.skip)
    assert np.abs(got[begin[1]:] - plain_marginals(tree, model)).max() < 1e-3


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w), "en", "a", 1, 1, "x"))
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in (words_of(r[1]) for r in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(rows))}


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in bottomk.fingerprint_neighbours(docs).collect()}
    ids = sorted(rows)
    assert set(got) == set(ids)
    for i, doc_id in enumerate(ids):
        text, following = rows[doc_id], rows[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited, r = text[:len(text) - half] + following[:half], got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == bottomk.to_text(bottomk.sketch(text)) and r.edited_fingerprint == bottomk.to_text(bottomk.sketch(edited))
    x, y = bottomk.sketch(rows[ids[0]]), bottomk.sketch(rows[ids[1]])
    both = bottomk.part_sketches(docs.where(F.col("doc_id").isin(ids[:2])).withColumn("p", F.lit("p")), "p").first().fingerprint
    assert both == bottomk.to_text(bottomk.merge(x, y))
    n = len({rows[ids[0]].lower().encode()[i:i + 9] for i in range(len(rows[ids[0]].encode()) - 8)})
    assert abs(bottomk.distinct_count(x) / n - 1) < 0.4 and bottomk.containment(x, bottomk.merge(x, y)) > 0.9


def test_fingerprint_likeness_against_exact_resemblance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(rows)

    def exact(x, y):
        x, y = ({t[i:i + 9] for i in range(max(1, len(t) - 8))} if t else set() for t in (x.lower().encode(), y.lower().encode()))
        return len(x & y) / len(x | y) if x | y else 1.0
    gaps = []
    for r in bottomk.fingerprint_neighbours(docs).collect():
        text, following = rows[r.doc_id], rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        gaps += [abs(r.near_edited - exact(text, edited)), abs(r.near_next - exact(text, following))]
    assert max(gaps) < 0.25 and sum(gaps) / len(gaps) < 0.03


def test_fingerprints_of_hot_and_null_ids(spark):
    rows = [(7, f"text {i} of the same id " * (1 + i % 3)) for i in range(600)] + [(None, f"no id {i}") for i in range(300)]
    rows += [(i, f"document {i}") for i in range(8, 308)] + [(3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()
    order = sorted(order, key=lambda r: (r.doc_id is None, r.doc_id or 0, (r.h % 2 ** 64) >> 33, r.t))
    want = []
    for r, following in zip(order, order[1:] + order[:1]):
        half = len(r.t) // 2
        want.append((r.doc_id, hashlib.sha256((r.t[:len(r.t) - half] + following.t[:half]).encode()).hexdigest()))
    got = [(r.doc_id, r.edited_sha256) for r in bottomk.fingerprint_neighbours(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bottomk._ordered(docs, len(rows)).where("_tail = 0").groupBy("_b").count().agg(F.max("count")).first()[0] < 400


def test_mixture_meets_its_margins(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["p", "q", None]), rng.randint(1, 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    mixed = mixing.mix(docs, {"source": {"a": 0.8, "b": 0.2, "gone": 5.0}, "lang": {"p": 0.2, "q": 0.5, None: 0.3}}, size="n").toPandas()
    expected = mixed["n"] * mixed["probability"]
    share = expected.groupby(mixed["lang"].fillna("-")).sum() / expected.sum()
    assert abs(share["p"] - 0.2) < 1e-6 and abs(share["-"] - 0.3) < 1e-6
    assert mixed["probability"].max() == 1.0
    kept = mixed[mixed["sampled"]]
    assert abs(kept["n"].sum() / expected.sum() - 1) < 0.1


def test_raking_goes_on_until_the_margins_are_met(spark):
    slow = spark.createDataFrame([("+a", "+x", 1000), ("+a", "+y", 1), ("+b", "+x", 2), ("+b", "+y", 900)], "s string, l string, t long")
    goals = {"s": {"a": 0.3, "b": 0.7}, "l": {"x": 0.4, "y": 0.6}}
    cells, gap = mixing.rake(slow, goals)
    w = {(r.s, r.l): r.w for r in cells.collect()}
    total = sum(w.values())
    assert gap <= mixing.TOLERANCE and abs((w["+a", "+x"] + w["+a", "+y"]) / total - 0.3) < 1e-9
    assert abs((w["+a", "+x"] + w["+b", "+x"]) / total - 0.4) < 1e-9 and mixing.rake(slow, goals, sweeps=2)[1] > 1e-4
    apart = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 10)], "doc_id long, s string, l string, n long")
    against = {"s": {"a": 0.3, "b": 0.7}, "l": {"x": 0.6, "y": 0.4}}
    rows = mixing.mix(apart, against, size="n").collect()
    assert len(rows) == 2 and all(r.margin_gap > 0.1 for r in rows)
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.mix(apart, against, size="n", strict=True)


def test_edit_distance(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        a = [rng.choice("abé😀") for _ in range(rng.randint(0, 14))]
        b = [c for c in a if rng.random() > 0.1] + [rng.choice("ab")] * rng.randint(0, 2)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        got = line_dedup.edit_distance(F.col("a"), F.col("b"), t)
        assert df.where(~got.eqNullSafe(F.least(F.levenshtein("a", "b"), F.lit(t + 1)))).isEmpty()


def test_line_classes_with_split_buckets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        line = list("the common beginning of a line and its end")
        line[rng.randrange(len(line))] = rng.choice("xyz")
        rows.append((i, "".join(line), "en", "a", 1, 1, "x"))
    for threshold in (1, 2):
        got = {r.doc_id: r.class_doc for r in line_dedup.dedup_lines(frame(spark, rows), threshold).collect()}
        import numpy as np
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for i in range(len(rows)):
            for j in range(i):
                if sum(x != y for x, y in zip(rows[i][1], rows[j][1])) <= threshold:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        assert got == {i: find(i) for i in range(len(rows))}, np.unique(list(got.values()))


def test_split_buckets_are_compiled(spark):
    """Plans that exceed what Spark compiles ran interpreted, and their generated code took the driver's memory."""
    hot = spark.createDataFrame([(str(i), f"a line {i:03} and its common end", 29, 0, 7, 1) for i in range(20)],
                                "id string, line string, base int, start int, size int, key long")
    spark.conf.set("spark.sql.codegen.fallback", "false")  # an expression that is not compiled fails
    try:
        assert line_dedup._split(hot, 3).where("role = 0").groupBy("id").count().where("count = 4").count() == 20
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def line_query(spark, tmp_path, name, lines):
    """{doc_id: class_doc} of the registered query over documents of one line each."""
    frame(spark, [(i, line, "en", "a", 1, 1, "x") for i, line in enumerate(lines)]).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r.class_doc for r in llm_queries()[name](spark, str(tmp_path)).collect()}


def nearest_classes(lines, threshold, least):
    """{number: first number of the class} by plain edit distances."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
        return row[-1]
    low = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if low[i] != low[j] and (a == b or min(len(a), len(b)) >= least and distance(a, b) <= threshold):
                x, y = sorted((low[i], low[j]))
                low = [x if k == y else k for k in low]
    return dict(enumerate(low))


def test_lines_with_three_edits_are_linked(spark, tmp_path):
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 60))) for _ in range(25)]
    for line in lines[:25]:
        for edits in (1, 2, 3, 4):
            near = list(line)
            for _ in range(edits):
                at = rng.randrange(len(near))
                near[at:at + 1] = rng.choice([[], ["x"], [near[at], "y"]])
            lines.append("".join(near))
    lines += [f"line number {i:04} of a table" for i in range(0, 2000, 13)] + [f"line number {i} of a table" for i in range(70)]
    assert line_query(spark, tmp_path, "op10_segment_line_dedup", lines) == nearest_classes(lines, 3, 8)


def test_short_lines_have_classes_of_copies(spark, tmp_path):
    lines = ["ab", "ac", "ab", "", "", "x", "x", "seven 7", "seven 8", "seven 7", "eight 88", "eight 89", "字字", "字字", " "]
    got = line_query(spark, tmp_path, "op10_segment_line_dedup", lines)
    assert [got[i] for i in range(len(lines))] == [0, 1, 0, None, None, 5, 5, 7, 8, 7, 10, 10, 12, 12, 14]


def test_revisits(spark):
    rows = [(1, "http://www.Example.com:80/a/?utm_source=x#t", 10, 200, "d1", {"ETag": '"e1"', "Content-Type": "text/html", "Server": "s"}),
            (2, "https://example.com/a", 20, 304, None, {"etag": 'W/"e1"', "content-type": "x", "server": "new"}),
            (3, "https://example.com/a", 5, 304, None, {"etag": '"e1"'}), (4, "https://example.com/a", 30, 304, None, None),
            (5, "https://example.com/a", 40, 304, None, {"ETag": '"e2"'}), (6, None, 40, 304, None, {"ETag": '"e1"'})]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, digest string, headers map<string,string>")
    got = {r.record_id: r for r in revisits.resolve_revisits(df).collect()}
    assert {i: r.outcome for i, r in got.items()} == {2: "resolved", 3: "no response", 4: "no validator", 5: "changed", 6: "no response"}
    assert got[2].refers_to == 1 and got[2].digest == "d1"
    assert got[2].headers == {"etag": 'W/"e1"', "content-type": "text/html", "server": "new"}
    assert revisits.resolve_revisits(df.limit(0)).collect() == []


def auc(pairs):
    ranked = sorted(pairs)
    good = sum(y for _, y in ranked)
    return sum(i for i, (_, y) in enumerate(ranked) if y) / good / (len(ranked) - good) - (good - 1) / 2 / (len(ranked) - good)


@pytest.mark.parametrize("name, label, floor", [("op6_subword_toxicity", "toxic", 0.8), ("op8_pairwise_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = llm_queries()[name](spark, sf).collect()
    n = 3 if label == "toxic" else 5
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == (1 if n == 3 else 0)) for r in rows)
    assert auc([(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]) > floor


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    deduped = {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()}
    sets = {i: frozenset(tuple(w[k:k + min(5, len(w))]) for k in range(max(1, len(w) - 4))) if (w := words_of(r.text)) else frozenset()
            for i, r in before.items()}
    low = {i: i for i in before}
    changed = True
    while changed:
        changed = False
        for a in before:
            for b in before:
                c = len(sets[a] & sets[b])
                if low[b] < low[a] and c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    low[a], changed = low[b], True
    assert deduped == {i for i in before if low[i] == i}
    out = cp.run(spark, SF).collect()
    assert len({r.doc_id for r in out}) == len(out) > 0
    sizes = [sum(r.shard == s for r in out) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))


def plain_windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} if w else set())


def plain_draw(rows, exponents):
    """Ids sampled after raking (source, lang, topic) cells in plain Python."""
    def cell(r):
        t = r.text or ""
        topic = "table" if " | " in t else "marked" if "%%%" in t else "shout" if "!! " in t else "prose"
        return r.source, r.lang, topic
    tokens, at = {}, {}
    for r in rows:
        at[r.doc_id] = cell(r)
        tokens[cell(r)] = tokens.get(cell(r), 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    tokens = {c: t for c, t in tokens.items() if t}
    total, w = sum(tokens.values()), dict(tokens)

    def margin(table, d):
        out = {}
        for c, x in table.items():
            out[c[d]] = out.get(c[d], 0) + x
        return out
    shares = []
    for d, e in enumerate(exponents):
        raw = {k: (n / total) ** e for k, n in margin(tokens, d).items()}
        shares.append({k: x / sum(raw.values()) for k, x in raw.items()})
    for _ in range(mixing.SWEEPS):
        for d in range(len(exponents)):
            now = margin(w, d)
            w = {c: x * shares[d][c[d]] * total / now[c[d]] for c, x in w.items()}
    each = {c: w[c] / tokens[c] for c in w}
    top = max(each.values())
    return {i for i, c in at.items()
            if int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) < each.get(c, 0) / top}


def test_every_stage_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = set().union(*[plain_windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    kept = []
    for name, stage in cp.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.collect()}
        want = {r.doc_id for r in before}
        if name == "toxicity":
            want = {i for i in want if scores[i] < 0.7}
        elif name == "minhash_near_dedup":
            sets = {r.doc_id: frozenset(tuple(w[k:k + min(5, len(w))]) for k in range(max(1, len(w) - 4))) if (w := words_of(r.text))
                    else frozenset() for r in before}
            low, changed = {i: i for i in sets}, True
            while changed:
                changed = False
                for a in sets:
                    for b in sets:
                        c = len(sets[a] & sets[b])
                        if low[b] < low[a] and c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                            low[a], changed = low[b], True
            want = {i for i in low if low[i] == i}
        elif name == "benchmark_decontamination":
            want = {r.doc_id for r in before if not any(
                tuple(w[i:i + len(x)]) == x for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower())]
                for x in items for i in range(len(w) - len(x) + 1) if w[i] == x[0])}
        elif name == "mixing":
            want = plain_draw(before, (0.9, 0.9, 1.0))
        assert ids == want, name
        if name != "sharding":
            assert docs.columns == cp.COLUMNS
        kept.append(len(ids))
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[1] > kept[2] > 0


def test_texts_that_share_an_id_are_kept(spark):
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:39], "other"])
    rows = [(1, " ".join(words)), (1, "totally different words that resemble nothing at all in here"), (2, near), (2, near),
            (3, "totally different words that resemble nothing at all in here"), (None, near), (4, None), (4, "x"), (9, " ".join(words))]
    rows += [(7, f"a text of its own number {i} " + " ".join(f"t{i}x{k}" for k in range(12))) for i in range(60)]
    docs = frame(spark, [(i, t, "en", "a", 1, 1, "x") for i, t in rows])
    got = sorted(((r.doc_id, r.text) for r in minhash.keep_one(docs, shingle=5, percent=80, bands=40, rows=4).collect()), key=str)
    want = [(1, rows[0][1]), (1, rows[1][1]), (None, near), (4, None), (4, "x")] + [r for r in rows if r[0] == 7]
    assert got == sorted(want, key=str)


def test_columns_with_internal_names_pass_through(spark):
    docs = frame(spark).withColumns({c: F.lit("u") for c in ("_d", "_t", "_mix_0", "_MIX_W", "_h", "_n")})
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    clean = winnowing.clean_documents(docs, items).collect()
    assert len(clean) == len(EDGES) - 2 and all(r["_d"] == r["_t"] == "u" for r in clean)
    mixed = mixing.mix(docs.withColumn("n", mixing.tokens(F.col("text"))), {"source": 0.5}, size="n", sweeps=2).collect()
    assert len(mixed) == len(EDGES) and all(r["_mix_0"] == r["_MIX_W"] == "u" for r in mixed)
    assert all(r["_h"] == r["_n"] == "u" for r in minhash.keep_one(docs).collect())


def test_private_counts_are_by_kind(spark, tmp_path):
    """The digest columns of the query against the patterns taken literally; kinds stand at any place among the spans."""
    texts = ["mail a@b.cd and c@d.ef or g@h.ij", "1.2.3.4 4111 1111 1111 1111 +1 (499) 555-6503", "+1 (499) 555-6503 call 9.9.9.9, x@y.zz",
             "1.1.1.1 2.2.2.2 3.3.3.3 256.1.1.1", "none", "", None]
    rows = [(i, t, "en", "a", 1, 1, "x") for i, t in enumerate(texts)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in llm_queries()["op1_pii_skip_chain_crf"](spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        spans = plain_spans(text or "")
        listed = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        r = found[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)], text
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_quality_learns_from_every_labelled_row(spark):
    """All rows of both classes are in pairs, and the threshold is the quantile of all scores."""
    docs = frame(spark, [(i, f"w{i} " * (i % 7 + 1), "en", "a", 1, 1, "x") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i >= 240), 0) for i in range(290)], "doc_id long, quality int, toxic int")
    rows = preference.labelled_features(docs, labels)
    seen = preference.preference_pairs(rows, {0: 240, 1: 50})
    for name, label in (("good", 1), ("bad", 0)):
        assert {tuple(r[name]) for r in seen.collect()} == {tuple(r.x) for r in rows.where(F.col("label") == label).collect()}
    assert seen.count() >= preference.TURNS * 240
    rng = np.random.default_rng(2)
    s, y = rng.normal(size=20_000), np.arange(20_000) % 4 // 3
    for values in (s, np.round(s, 1), np.zeros(20_000)):
        scored = spark.createDataFrame(list(zip(y.tolist(), values.tolist())), "label int, s double")
        at = np.sort(values)[14_999:15_001]
        assert preference.threshold_of(scored, {0: 15_000, 1: 5_000}, {0: 15_000, 1: 5_000}) == at.mean()


def test_quality_uses_rows_beyond_a_sample(spark, monkeypatch):
    """Rows beyond 5,000 of a class move the threshold."""
    docs = frame(spark, [(i, "bad " * (1 + i % 5) if i % 8 else f"Good text number {i}, longer.", "en", "a", 1, 1, "x") for i in range(8000)])
    labels = spark.createDataFrame([(i, int(i % 8 == 0), 0) for i in range(8000)], "doc_id long, quality int, toxic int")
    learned = []
    scored = preference._scored

    def record(rows, model):
        learned.append(rows.count())
        return scored(rows, model)
    monkeypatch.setattr(preference, "_scored", record)
    found = preference.score(docs, preference.fit(docs, labels)).where("score >= 0.3").count()
    assert learned == [8000] and found == 1000


def linked_classes(spark, lines, threshold):
    """{number: first number of the class} by Spark's own distance of all pairs."""
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    near = df.join(df.toDF("j", "other"), F.col("i") < F.col("j")).where(F.levenshtein("line", "other") <= threshold)
    low = list(range(len(lines)))
    for i, j in near.select("i", "j").collect():
        x, y = sorted((low[i], low[j]))
        low = [x if k == y else k for k in low]
    return dict(enumerate(low))


def test_near_copies_are_not_multiplied(spark):
    """A large group of near copies was cut again and again, and came to many rows a line."""
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(80)]
    lines = []
    for _ in range(100):
        line = list(base)
        for _ in range(rng.randint(1, 3)):
            line.insert(rng.randrange(len(line)), "".join(rng.choice("klmn") for _ in range(rng.choice([1, 4]))))
        lines.append("".join(line))
    seen, real = [], line_dedup.staged
    line_dedup.staged = lambda df, *by: seen.append(real(df, *by)) or seen[-1]
    try:
        rows = frame(spark, [(i, line, "en", "a", 1, 1, "x") for i, line in enumerate(lines)])
        got = {r.doc_id: r.class_doc for r in line_dedup.dedup_lines(rows, 3, 8).collect()}
    finally:
        line_dedup.staged = real
    assert got == linked_classes(spark, lines, 3)
    assert max(x.count() for x in seen) <= 26 * len(lines)


def test_buckets_that_are_split_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET", 6)
    rng = random.Random(9)
    lines = [f"row {rng.randrange(20):02} of {rng.choice(['one', 'two', 'é'])}" for _ in range(16)]
    got = {r.doc_id: r.class_doc for r in line_dedup.dedup_lines(
        frame(spark, [(i, line, "en", "a", 1, 1, "x") for i, line in enumerate(lines)]), 1, 8).collect()}
    assert got == linked_classes(spark, lines, 1)


def test_cut_off_ends_keep_the_distance(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(400):
        a = [rng.choice("abé😀") for _ in range(rng.randint(0, 40))]
        b = [c for c in a if rng.random() > 0.05] + [rng.choice("ab")] * rng.randint(0, 2)
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", F.levenshtein("a", "b"))
    for t in (1, 3):
        assert df.where(line_dedup.trimmed_distance(F.col("a"), F.col("b"), t) != F.least("d", F.lit(t + 1))).isEmpty()
    alike = line_dedup.alike(F.col("a"), F.col("b"), line_dedup.bag(F.col("a")), line_dedup.bag(F.col("b")), 3)
    assert df.where("d <= 3").where(~alike).isEmpty() and not df.where(~alike).isEmpty()
