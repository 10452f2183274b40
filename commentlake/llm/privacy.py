"""Personal data: pattern matches, and a skip-chain conditional random field that carries their labels to other tokens."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from commentlake.llm.hashing import text_buffer
from commentlake.llm.sampling import bounded_sample

KINDS = ("email", "ip", "card", "phone")
_LOCAL = np.zeros(128, bool)
_LOCAL[[ord(c) for c in "._%+-"]] = True
_LOCAL[48:58] = _LOCAL[65:91] = _LOCAL[97:123] = True
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is tried from its first digit only: every start in it has the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_DIGITS_ONLY = re.compile(r"[^\w@]*+[0-9](?:[^\w@]|[0-9])*+")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_DIGIT[64] = True


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s):
    return "".join(c for c in s if "0" <= c <= "9")


def _byte_range(part):
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text):
    """Every @ is looked at once: the local part is the run before it, so long runs cost no second look."""
    free, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and (c := ord(text[lo - 1])) < 128 and _LOCAL[c]:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text):
    """(kind number, start, end) by kind and start; offsets in code points."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte_range, m.group().split(".")))]
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() < 60 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


LABELS = len(KINDS) + 1  # 0 is "no personal data"
N_FEATURES = 24
EDGE = "()[]{}<>\"'.,;:!?|*%$#&="


def _features(token, before, after):
    """What a token looks like, without asking whether a pattern matched there; the last four are those of its run."""
    core = token.strip(EDGE)
    d = _digits(core)
    n, parts = len(d), core.split(".")
    letters = sum(c.isalpha() for c in core)
    short = len(core) < 80
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[1] = "@" in core
    f[2] = short and "@" in core and "." in core.rpartition("@")[2] and bool(core.partition("@")[0])
    f[3] = short and len(parts) == 4 and all(p.isdigit() and p.isascii() and _byte_range(p) for p in parts)
    f[4] = core.startswith("+")
    f[5] = "-" in core
    f[6] = "(" in token
    f[7] = n == 0
    f[8] = 1 <= n <= 2
    f[9] = n == 3
    f[10] = 4 <= n <= 6
    f[11] = 7 <= n <= 12
    f[12] = 13 <= n <= 19
    f[13] = n >= 20
    f[14] = short and 13 <= n <= 19 and letters == 0 and luhn(d)
    f[15] = letters > 0
    f[16] = letters > 0 and n > 0
    f[17] = before.startswith("+")
    f[18] = bool(_MARK.search(before)) if len(before) < 80 else True
    f[19] = bool(_MARK.search(after)) if len(after) < 80 else True
    return f


def _run_features(words):
    """What a run of digit tokens looks like as one number."""
    d = "".join(map(_digits, words))
    long = 13 <= len(d) <= 19
    return [long and luhn(d), long and not luhn(d), words[0].startswith("+"), 9 <= len(d) <= 15]


def _similar_key(token):
    """Tokens with one key share a potential: a number by its last seven digits, anything else by its text without case."""
    core = token.strip(EDGE)
    d = "" if "@" in core else _digits(core)
    return d[-7:] if len(d) >= 7 else core.lower() or None


def _run_key(words):
    """The key of a value that is written as several tokens, as its digits in one token would have it; None for one token or
    where the digits are too few, or more than any kind has."""
    d = "".join(map(_digits, words))
    return d[-7:] if len(words) > 1 and 7 <= len(d) <= 19 else None


class Graph:
    """Active tokens of a text: their spans, features, base labels (-1: none), chain edges and skip edges.

    Tokens without a digit or an @ outside base spans are clamped to label 0, which cuts the chain there. A skip edge joins
    a token to the next one of the same key, however far away, and every token has its own key and the last one of a run of digit
    tokens that of the run too, so edges grow with the tokens only. `runs` lists the runs of digit tokens, of two or more.
    `strong` are the skip edges between numbers, whose key is seven digits. `settled` is False where `marginals` had to leave
    out skip edges.
    """

    __slots__ = ("spans", "features", "fixed", "chain", "skip", "runs", "strong", "settled")

    def __init__(self, text, base):
        self.spans, features, self.fixed, self.chain, self.skip, self.runs, self.settled = [], [], [], [], [], [], True
        marks, k = sorted((a, b, kind + 1) for kind, a, b in base), 0
        self.strong = set()
        last_of, previous, was_active, run = {}, "", False, []
        tokens = _TOKEN.finditer(text)
        current = next(tokens, None)
        while current is not None:
            following = next(tokens, None)
            word, a, b = current.group(), *current.span()
            while k < len(marks) and marks[k][1] <= a:
                k += 1
            kinds = [m[2] for m in marks[k:k + 4] if m[0] < b and m[1] > a]
            active = bool(kinds) or bool(_MARK.search(word))
            if active:
                node = len(self.spans)
                self.spans.append((a, b, word))
                features.append(_features(word, previous, following.group() if following else ""))
                self.fixed.append(kinds[0] if kinds else -1)
                if was_active:
                    self.chain.append((node - 1, node))
                self._repeat(last_of, _similar_key(word), node)
            if not (active and _DIGITS_ONLY.fullmatch(word)):
                self._close(last_of, run, features)
                run = []
            else:
                run.append(node)
            was_active, previous, current = active, word, following
        self._close(last_of, run, features)
        self.skip = list(dict.fromkeys(self.skip))
        self.features = np.array(features).reshape(-1, N_FEATURES)

    def _close(self, last_of, run, features):
        if len(run) > 1:
            words = [self.spans[i][2] for i in run]
            for i in run:
                features[i][-4:] = _run_features(words)
            self.runs.append(run)
            self._repeat(last_of, _run_key(words), run[-1])

    def _repeat(self, last_of, key, node):
        """Joins a token to the last one that had its key before."""
        if key is None:
            return
        last = last_of.get(key)
        if last is not None and last != node:
            edge = min(last, node), max(last, node)
            self.skip.append(edge)
            if len(key) == 7 and key.isdigit():
                self.strong.add(edge)
        last_of[key] = node


SKIP_PRIOR = 2.0


def _silver(g):
    """(labels, known) to learn from: base matches and what repeats a number of theirs. Tokens that repeat a shorter part of one
    are not known, as nothing says whether they are personal data."""
    fixed = np.array(g.fixed, np.int64)
    y, near = np.maximum(fixed, 0), fixed > 0
    for edges in (sorted(g.strong, key=max), sorted(g.strong, reverse=True)):
        for u, v in edges:
            y[u], y[v] = y[u] or y[v], y[v] or y[u]
    for run in g.runs:
        if (fixed[run] < 0).all():
            y[run] = y[run[-1]]
    near |= y > 0
    for edges in (sorted(g.skip, key=max), sorted(g.skip, reverse=True)):
        for u, v in edges:
            near[u] = near[v] = near[u] or near[v]
    return y, (y > 0) | ~near


def train(texts, steps=400, rate=0.1, penalty=1e-3, skip_penalty=1e-4):
    """(unary weights, chain potentials, skip potentials), by pseudo-likelihood: each token's label given its features and
    the labels of its neighbours, silver labels being the base matches and their repeats. The skip potentials are drawn to SKIP_PRIOR on the
    diagonal, which stands where too few texts repeat a token to learn them."""
    rows, labels = [], []
    for text in texts:
        base = base_spans(text)
        g = Graph(text, base)
        y, known = _silver(g)
        x = np.zeros((len(y), N_FEATURES + 3 * LABELS))
        x[:, :N_FEATURES] = g.features
        before, after = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        for u, v in g.chain:
            before[v], after[u] = y[u], y[v]
        x[np.arange(len(y)), N_FEATURES + before] = 1
        x[np.arange(len(y)), N_FEATURES + LABELS + after] = 1
        for u, v in g.skip:
            x[u, N_FEATURES + 2 * LABELS + y[v]] += 1
            x[v, N_FEATURES + 2 * LABELS + y[u]] += 1
        rows.append(x[known])
        labels.append(y[known])
    width = N_FEATURES + 3 * LABELS
    prior = np.zeros((width, LABELS))
    prior[N_FEATURES + 2 * LABELS:] = SKIP_PRIOR * np.eye(LABELS)
    pull = np.full((width, 1), penalty)
    pull[N_FEATURES + 2 * LABELS:] = skip_penalty
    w = prior.copy()
    if sum(map(len, rows)):
        x, y = np.concatenate(rows), np.concatenate(labels)
        once, counts = np.unique(np.column_stack((x, y)), axis=0, return_counts=True)
        x, target, share = once[:, :-1], np.eye(LABELS)[once[:, -1].astype(int)], counts[:, None] / counts.sum()
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ ((p - target) * share) + pull * (w - prior)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    chain = (w[N_FEATURES:N_FEATURES + LABELS] + w[N_FEATURES + LABELS:N_FEATURES + 2 * LABELS].T) / 2
    skip = w[N_FEATURES + 2 * LABELS:]
    return w[:N_FEATURES], chain, (skip + skip.T) / 2


def _forest(graph):
    """The graph's skip edges that close no circle with the chain and the ones before them."""
    root = list(range(len(graph.spans)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    kept = []
    for u, v in graph.chain:
        root[find(v)] = find(u)
    for u, v in graph.skip:
        a, b = find(u), find(v)
        if a != b:
            root[b] = a
            kept.append((u, v))
    return kept


def marginals(graphs, model, damping=0.3, tolerance=1e-5, patience=1280):
    """Label probabilities of all tokens of the graphs, by loopy sum-product; base tokens keep their label.

    A clamped neighbour has label 0, so the end of a run of active tokens gets the chain potential with label 0. Messages are
    passed until none of a graph changes by more than the tolerance, each graph for itself, so evidence reaches repeats
    at any distance and no graph depends on its batch. A graph that keeps swinging after as many rounds as it has tokens is
    damped more and more. If it has not settled after `patience` rounds more, skip edges that close a circle are left out and
    its messages start anew, now without damping: they settle in as many rounds as the longest path has edges, on the exact
    probabilities of what is left; its `settled` is False.
    """
    unary, chain, skip = model
    for g in graphs:
        g.settled = True
    sizes = [len(g.spans) for g in graphs]
    begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    n = int(begin[-1])
    if n == 0:
        return np.zeros((0, LABELS)), begin
    score = np.concatenate([g.features for g in graphs]) @ unary
    pairs = {"chain": [(u + s, v + s) for g, s in zip(graphs, begin) for u, v in g.chain],
             "skip": [(u + s, v + s) for g, s in zip(graphs, begin) for u, v in g.skip]}
    c = np.array(pairs["chain"], np.int64).reshape(-1, 2)
    s = np.array(pairs["skip"], np.int64).reshape(-1, 2)
    has_left, has_right = np.zeros(n, bool), np.zeros(n, bool)
    has_left[c[:, 1]] = has_right[c[:, 0]] = True
    score[~has_left] += chain[0]
    score[~has_right] += chain[:, 0]
    fixed = np.concatenate([np.array(g.fixed, np.int64) for g in graphs])
    known = fixed >= 0
    score[known] = -1e3
    score[known, fixed[known]] = 0
    source = np.concatenate((c[:, 0], c[:, 1], s[:, 0], s[:, 1]))
    target = np.concatenate((c[:, 1], c[:, 0], s[:, 1], s[:, 0]))
    tables = np.stack((chain, chain.T, skip, skip))
    kind = np.repeat(np.arange(4), (len(c), len(c), len(s), len(s)))
    m = len(source)
    back = np.concatenate((np.arange(len(c)) + len(c), np.arange(len(c)), np.arange(len(s)) + 2 * len(c) + len(s),
                           np.arange(len(s)) + 2 * len(c)))
    message = np.zeros((m, LABELS))
    owner = np.searchsorted(begin, source, "right") - 1
    length, live = np.array(sizes), np.arange(m)
    restless = np.zeros(len(sizes), bool)  # graphs whose circles were cut
    edge_of = np.concatenate((np.full(2 * len(c), -1), np.tile(np.arange(len(s)), 2)))

    def belief():
        total = score.copy()
        for k in range(LABELS):
            total[:, k] += np.bincount(target, message[:, k], n)
        return total
    t = 0
    while len(live):
        # Edges of settled graphs are left out, and so are their tokens.
        nodes, at = np.unique(np.concatenate((source[live], target[live])), return_inverse=True)
        begins, ends = at[:len(live)], at[len(live):]
        place = np.zeros(m, np.int64)
        place[live] = np.arange(len(live))
        opposite, held, own, local = place[back[live]], message[live], owner[live], score[nodes]
        tables_of, settled, given_up = tables[kind[live]], np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
        while not (settled.any() or given_up.any()):
            total = local.copy()
            for k in range(LABELS):
                total[:, k] += np.bincount(ends, held[:, k], len(nodes))
            z = (total[begins] - held[opposite])[:, :, None] + tables_of
            top = z.max(1, keepdims=True)
            new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = np.zeros(len(sizes))
            np.maximum.at(change, own, np.abs(new - held).max(1))
            late = np.where(restless, 0, np.maximum(0, t - 64 - length))
            keep = np.where(restless, 0.0, 1 - (1 - damping) * 0.5 ** (late // 64))
            held = held + (1 - keep[own])[:, None] * (new - held)
            t += 1
            settled[own] = change[own] <= tolerance
            given_up[own] = ~settled[own] & (late[own] >= patience)
        message[live] = held
        if given_up.any():
            restless |= given_up
            trees = np.zeros(len(s), bool)
            for i in np.flatnonzero(given_up):
                graphs[i].settled = False
                kept = set(_forest(graphs[i]))
                places = np.flatnonzero(owner[2 * len(c):2 * len(c) + len(s)] == i)
                trees[places] = [(u - begin[i], v - begin[i]) in kept for u, v in s[places]]
            cut = given_up[owner] & (edge_of >= 0) & ~np.append(trees, True)[edge_of]
            message[given_up[owner]] = 0
            live = live[~cut[live]]
        live = live[~settled[owner[live]]]
    z = belief()
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), begin


def added_spans(graph, p, base, least=0.9):
    """(kind number, start, end) of runs of neighbouring tokens that the field labels alike, without the marks around them and
    apart from every base span.

    Digit tokens in a row are one number in parts: those between base tokens are labelled as a whole, by the label that is
    likeliest for all of them, and count only if each of them is sure of it.
    """
    if not len(p):
        return []
    fixed = np.array(graph.fixed) >= 0
    label, sure = p.argmax(1), p.max(1) >= least
    for run in graph.runs:
        inside = np.array(run)
        cuts = np.flatnonzero(np.diff(fixed[inside])) + 1
        for piece in np.split(inside, cuts):
            if not fixed[piece[0]]:
                label[piece] = np.log(np.maximum(p[piece], 1e-300)).sum(0).argmax()
                sure[piece] = (p[piece, label[piece]] >= least).all()
    sure &= (label > 0) & ~fixed
    joined = set(graph.chain)
    out, at = [], 0
    while at < len(label):
        if not sure[at]:
            at += 1
            continue
        end = at
        while end + 1 < len(label) and sure[end + 1] and label[end + 1] == label[at] and (end, end + 1) in joined:
            end += 1
        first, last = graph.spans[at], graph.spans[end]
        a = first[0] + len(first[2]) - len(first[2].lstrip(EDGE.replace("(", "")))
        b = last[1] - (len(last[2]) - len(last[2].rstrip(EDGE)))
        if a < b and not any(x < b and y > a for _, x, y in base):
            out.append((int(label[at]) - 1, a, b))
        at = end + 1
    return out


SPANS = "array<struct<kind:int,start:int,end:int>>"


def _span_lists(rows):
    flat = [s for row in rows for s in row]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    columns = [pa.array([s[i] for s in flat], pa.int32()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["kind", "start", "end"]))


def find_private(docs, model, least=0.9):
    """(doc_id, base, added, settled): the pattern matches of every whole text, the spans that the field adds, and whether the
    field settled with all its edges (see `marginals`).

    Spans are structs of kind (place in KINDS), start and end in code points, sorted by kind and start. Base spans always
    stay, and added ones never overlap them. Null and empty texts have none; rows are handled one by one, null and repeated ids
    too; other columns are not read. A long text costs time and memory in proportion to its tokens with a digit or an @.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            marks = np.concatenate(([0], np.cumsum(_DIGIT[data])))
            hot = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
            base, added, settled = [()] * batch.num_rows, [()] * batch.num_rows, [True] * batch.num_rows
            graphs = []
            for r in hot:
                text = data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")
                base[r] = base_spans(text)
                graphs.append(Graph(text, base[r]))
            p, begin = marginals(graphs, shared.value)
            for r, g, lo, hi in zip(hot, graphs, begin[:-1], begin[1:]):
                added[r], settled[r] = sorted(added_spans(g, p[lo:hi], base[r], least)), g.settled
            yield pa.RecordBatch.from_arrays([batch.column(0), _span_lists(base), _span_lists(added), pa.array(settled, pa.bool_())],
                                             ["doc_id", "base", "added", "settled"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {SPANS}, added {SPANS}, settled boolean")


def _train_batches(batches):
    """Arrow batches (id, text) of the whole sample to one row with the potentials."""
    texts = [t for batch in batches for t in batch.column(1).to_pylist()]
    if texts:
        parts = [pa.array([x.tobytes()], pa.binary()) for x in train(texts)]
        yield pa.RecordBatch.from_arrays(parts, ["unary", "chain", "skip"])


def fit(docs, max_rows=2000, max_bytes=1 << 16, seed=31):
    """The field's potentials, learned in one task from at most `max_rows` texts of at most `max_bytes` bytes that hold a digit or
    an @, chosen by a hash of id and text. Spark runs the task again if its executor is lost; the driver gets the potentials only.
    """
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).where(F.col("text").rlike("[0-9@]"))
    sample = bounded_sample(texts, max_rows, F.xxhash64("doc_id", "text", F.lit(seed)))
    row = sample.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(
        _train_batches, "unary binary, chain binary, skip binary").first()
    return train([]) if row is None else tuple(np.frombuffer(x, np.float64).reshape(-1, LABELS) for x in row)


def span_text(spans):
    """"kind:start:end" of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs, model):
    """(doc_id, text) with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text):
        base = base_spans(text)
        g = Graph(text, base)
        spans = sorted((a, b, k) for k, a, b in base + added_spans(g, marginals([g], shared.value)[0], base))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            texts = [t if t is None else clean(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
