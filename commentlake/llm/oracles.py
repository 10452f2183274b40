"""SQL twins of the operators that SQL can express."""

from commentlake.llm.queries import MIX_TARGETS
from commentlake.llm.revisits import KEPT_HEADERS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links
          UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

SHARDS = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))),
crc AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(text))),
           lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT text FROM documents WHERE text <> ''), tab),
d AS (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size, coalesce(text_crc32, 0) AS text_crc32,
         md5('shard-1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents LEFT JOIN crc USING (text)),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 + 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS f FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, source, h, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 16 // n)::INT AS shard,
       p - ceil((p * 16 // n) * n / 16.0::DOUBLE)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""


def mixture(sweeps=40):
    """Raking as a chain of queries, one per margin; more sweeps than the margins take to be met to nine digits change nothing."""
    dims = list(MIX_TARGETS)
    parts = ["""d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '%%%') THEN 'marked'
              WHEN contains(text, '!! ') THEN 'shout' ELSE 'prose' END AS topic FROM documents)""",
             "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS t, sum(tokens)::DOUBLE AS w FROM d "
             "GROUP BY ALL HAVING sum(tokens) > 0)"]
    for dim, power in MIX_TARGETS.items():
        parts.append(f"raw_{dim} AS (SELECT {dim}, pow(sum(t) / (SELECT sum(t) FROM c0), {power}) AS r FROM c0 GROUP BY {dim})")
        parts.append(f"goal_{dim} AS MATERIALIZED (SELECT {dim}, r / (SELECT sum(r) FROM raw_{dim}) AS share FROM raw_{dim})")
    for i, dim in enumerate(dims * sweeps):
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, t, w * share * (SELECT sum(t) FROM c0) "
            f"/ sum(w) OVER (PARTITION BY c.{dim}) AS w FROM c{i} c JOIN goal_{dim} g ON c.{dim} IS NOT DISTINCT FROM g.{dim})")
    last = f"c{len(dims) * sweeps}"
    parts.append(f"x AS (SELECT source, lang, topic, w / t AS weight, w / t / max(w / t) OVER () AS p FROM {last})")
    for dim in dims:
        parts.append(f"gap_{dim} AS (SELECT max(abs(m / share / (SELECT sum(t) FROM c0) - 1)) AS gap FROM "
                     f"(SELECT {dim}, sum(w) AS m FROM {last} GROUP BY {dim}) c JOIN goal_{dim} g ON c.{dim} IS NOT DISTINCT FROM g.{dim})")
    gap = ", ".join(f"(SELECT gap FROM gap_{dim})" for dim in dims)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(p, 0), 6) AS probability,
       round(coalesce(greatest({gap}), 0), 6) AS margin_gap,
       ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496 < coalesce(p, 0) AS sampled
FROM d LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.lang IS NOT DISTINCT FROM x.lang AND d.topic = x.topic
"""


_NEWS = [("etag", "etag"), ("last-modified", "last_modified"), ("cache-control", "cache_control"), ("server", "server")]


def _merged():
    """All header names in order; those that a 304 may change come from the revisit where it has them."""
    full = {"content-length": "f_length", "content-type": "'text/html'", "etag": "f_etag", "last-modified": "f_stamp", "server": "'one'"}
    news = dict(_NEWS)
    lines = []
    for name in sorted(set(full) | set(news)):
        value = full.get(name, "NULL")
        if name in news and name not in KEPT_HEADERS:
            value = f"coalesce({news[name]}, {value})"
        lines.append(f"'{name}: ' || {value}")
    return f"concat_ws('|', {', '.join(lines)})"


REVISITS = f"""
WITH r AS (
  SELECT page_id * 4 + k AS record_id, k,
         CASE WHEN k % 2 = 0 THEN url WHEN contains(url, '?') THEN url || '&utm_medium=feed' ELSE url || '?utm_medium=feed' END AS url,
         1700000000 + (page_id % 1000) * 3600 + k * 86400 - CASE WHEN k = 1 AND page_id % 7 = 0 THEN 172800 ELSE 0 END AS ts,
         CASE WHEN k = 0 OR (k = 3 AND page_id % 3 = 0) THEN 200 ELSE 304 END AS status,
         md5(CASE WHEN k = 3 AND page_id % 3 = 0 THEN html || 'v2' ELSE html END) AS digest, length(html)::VARCHAR AS size,
         '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || (page_id % 365)::VARCHAR AS stamp, page_id
  FROM pages, range(4) t(k)),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM r),
c AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'),
                      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM bare),
u AS (
  SELECT *, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '(^www[.])|(:(80|443)$)', '')
            || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical,
         CASE WHEN k = 1 THEN tag WHEN k = 3 THEN 'W/' || tag WHEN page_id % 5 = 0 THEN '"other"' END AS etag,
         CASE WHEN k = 2 AND page_id % 11 <> 0 THEN stamp END AS last_modified,
         'max-age=' || (page_id % 60)::VARCHAR AS cache_control, CASE WHEN k = 1 THEN 'two' END AS server,
         CASE WHEN status = 200 THEN {{'id': record_id, 'digest': digest, 'length': size,
              'etag': CASE WHEN k = 3 THEN '"v2"' ELSE tag END, 'stamp': stamp}} END AS own
  FROM c),
s AS (
  SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts, record_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM u),
o AS (
  SELECT *, f.id AS f_id, f.digest AS f_digest, f.length AS f_length, f.etag AS f_etag, f.stamp AS f_stamp,
         CASE WHEN f IS NULL THEN 'no response' WHEN etag IS NULL AND last_modified IS NULL THEN 'no validator'
              WHEN etag IS NOT NULL AND regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved'
              WHEN etag IS NULL AND last_modified = f.stamp THEN 'resolved' ELSE 'changed' END AS outcome
  FROM s WHERE status = 304)
SELECT record_id, canonical AS canonical_url, ts, outcome, CASE WHEN outcome = 'resolved' THEN f_id END AS refers_to,
       CASE WHEN outcome = 'resolved' THEN f_digest END AS digest, CASE WHEN outcome = 'resolved' THEN {_merged()} END AS headers
FROM o
"""

LEAKS = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM w, sizes WHERE len(w) >= n),
hit AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.s = win.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def lines(threshold=3, least=8):
    """Lines that share a segment near the same place, held against each other by edit distance. DuckDB's distance counts bytes, so
    letters outside ASCII stand as control characters first; there is room for 26 of them."""
    parts = threshold + 1
    free = ", ".join(str(c) for c in (*range(1, 9), *range(14, 32)))

    def segment(n, shift=""):
        return f"substr(line, {n} * i // {parts} + 1{shift}, {n} * (i + 1) // {parts} - {n} * i // {parts}) AS s"
    return f"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
letters AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS given FROM (
  SELECT DISTINCT unnest(string_split(regexp_replace(line, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM l) WHERE c <> ''),
f AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS first FROM l WHERE line <> '' GROUP BY line),
long AS (SELECT line, n, translate(line, given, list_aggregate(list_transform([{free}][:length(given)], lambda c: chr(c)), 'string_agg', ''))
  AS bytes FROM f, letters WHERE n >= {least}),
held AS (SELECT line, bytes, n, i, {segment("n")} FROM long, range({parts}) r(i)),
asked AS (SELECT line, bytes, n - d AS n, i, {segment("(n - d)", " + k")}
  FROM long, range({parts}) r(i), range({parts}) e(d), range(-{threshold}, {parts}) g(k) WHERE n - d >= {least} AND (n - d) * i // {parts} + k >= 0),
pairs AS (SELECT DISTINCT x.line AS a, y.line AS b, x.bytes AS p, y.bytes AS q FROM held x JOIN asked y ON x.n = y.n AND x.i = y.i AND x.s = y.s
  WHERE x.line <> y.line),
half AS (SELECT a, b FROM pairs WHERE levenshtein(p, q) <= {threshold}),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT a AS line, b AS other FROM links UNION SELECT r.line, k.b FROM reach r JOIN links k ON k.a = r.other),
low AS (SELECT r.line, min(f.first) AS m FROM reach r JOIN f ON f.line = r.other GROUP BY r.line),
c AS (SELECT f.line, least(f.first, coalesce(m, f.first)) AS lead FROM f LEFT JOIN low USING (line))
SELECT doc_id, line_no::INT AS line_no, length(l.line)::INT AS n_chars, lead[1] AS class_doc, lead[2]::INT AS class_line,
       lead IS NULL OR (doc_id = lead[1] AND line_no = lead[2]) AS kept
FROM l LEFT JOIN c USING (line)
"""


CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i)))"""


def merkle(group_levels=7, top_levels=3):
    """A tree as one query per level: 8^7 rows a language and 8^3 languages at most."""
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = " || ".join(field(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in fields)
    parts = [CRC_TABLE, f"""leaf AS (
  SELECT doc_id, lang, coalesce('+' || lang, '') AS g, sha256({" || ".join(map(field, fields))}) AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(doc_id::VARCHAR))),
                lambda i: ('0x' || substr(hex(encode(doc_id::VARCHAR)), 2 * i + 1, 2))::BIGINT)),
                lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 3 = 0 THEN sha256({lowered}) END AS tampered
  FROM documents, tab)""",
             "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, "
             "count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM leaf)"]

    def tree(name, levels):
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (
  SELECT g, p // 8 AS p, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d
  FROM {name}{k} GROUP BY g, p // 8)""")
            parts.append(f"""{name}s{k} AS (
  SELECT g, p, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY g, p // 8 ORDER BY p))""")
    tree("a", group_levels)
    parts.append(f"t0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, d FROM a{group_levels})")
    tree("t", top_levels)
    parts.append("f0 AS (SELECT doc_id, leaf, a0.g, a0.p, t0.p AS q, t0.d AS subroot, coalesce(tampered, leaf) AS f, '' AS proof "
                 "FROM a0 JOIN t0 ON t0.name = a0.g)")
    steps = [(f"as{k}", f"s.g = f.g AND s.p = f.p // {8 ** k}") for k in range(group_levels)] + [
        (f"ts{k}", f"s.p = f.q // {8 ** k}") for k in range(top_levels)]
    for i, (step, on) in enumerate(steps):
        parts.append(f"""f{i + 1} AS (
  SELECT f.* EXCLUDE (f, proof), CASE WHEN s.p IS NULL THEN f.f ELSE sha256(b || f.f || a) END AS f,
         proof || coalesce(b || a, '') AS proof FROM f{i} f LEFT JOIN {step} s ON {on})""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified
FROM f{len(steps)}, t{top_levels} t"""


EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def llm_oracles():
    return {
        "op2_minmax_near_dedup": NEAR_DEDUP,
        "op3_raked_mixture": mixture(),
        "op5_stratified_shards": SHARDS,
        "op7_revisit_resolution": REVISITS,
        "op9_winnowing_decontamination": LEAKS,
        "op10_segment_line_dedup": lines(),
        "op11_merkle_manifest": merkle(),
        "op13_cuckoo_exact_dedup": EXACT,
    }
