"""DuckDB SQL for the training-data queries that SQL can express."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
SIGN_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
least AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM win JOIN least USING (k) WHERE first_id < doc_id),
gone AS (SELECT doc_id, list(i) AS g, count(*) AS n FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, coalesce({SIGN_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {SIGN_WORDS} AS w FROM benchmark),
pat AS (SELECT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, win.n, s, item_id FROM win JOIN pat ON win.k = pat.k AND win.n = pat.n),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(reach.y)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""

#: crc32 of each byte's remainder, by the polynomial; a text's bytes are read from its hex form.
IMPORTANCE = rf"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b)),
d AS MATERIALIZED (SELECT doc_id, coalesce({SIGN_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce({SIGN_WORDS}, []) AS w FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY ALL),
byte AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
known AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295)) % 10000 AS bucket FROM byte, crc),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN known USING (f) GROUP BY bucket),
gain AS (SELECT k.bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS g
  FROM (SELECT DISTINCT bucket FROM known) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM df JOIN known USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) >= 20 AS able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weight USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE able)
SELECT scored.*EXCLUDE (able), CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

TOP_LENGTHS, REPEAT_LENGTHS = {2: 20, 3: 18, 4: 16}, {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}


def _runs(n: int) -> str:
    return f"SELECT doc_id, {n} AS n, unnest(range(1, len(w) - {n - 2})) AS s, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS k FROM d WHERE len(w) >= {n}"


REPETITION = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, coalesce({WORDS}, []) AS w FROM documents),
word AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, length(unnest(w)) AS c FROM d),
win AS MATERIALIZED (SELECT doc_id, n, s, hash(k) AS h, k, count(*) OVER (PARTITION BY doc_id, n, k) AS often, row_number() OVER (PARTITION BY doc_id, n, k ORDER BY s) AS nth FROM ({" UNION ALL ".join(_runs(n) for n in (*TOP_LENGTHS, *REPEAT_LENGTHS))})),
twice AS (SELECT doc_id, count(DISTINCT i) AS x FROM (SELECT doc_id, unnest(range(s, s + 5)) AS i FROM win WHERE n = 5 AND often > 1) GROUP BY doc_id),
again AS (SELECT doc_id, n, sum(c) AS x FROM (SELECT DISTINCT doc_id, n, unnest(range(s, s + n)) AS i FROM win WHERE nth > 1 AND n >= 5) JOIN word USING (doc_id, i) GROUP BY doc_id, n),
top AS (SELECT doc_id, n, max(often * (length(k) - n + 1)) AS x FROM win WHERE often > 2 AND n < 5 GROUP BY doc_id, n),
line AS (SELECT doc_id, l, len(regexp_extract_all(l, '[^ 	-
]+')) AS words, length(regexp_replace(l, '[ 	-
]+', '', 'g')) AS c, row_number() OVER (PARTITION BY doc_id, l ORDER BY p) AS nth FROM (SELECT doc_id, unnest(range(0, len(x))) AS p, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d))),
lines AS (SELECT doc_id, count(*) AS n, sum(c) AS c FROM line WHERE words > 0 AND nth > 1 GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(twice.x, 0)::BIGINT AS n_repeat_words, coalesce(lines.c, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce((SELECT x FROM again a WHERE a.doc_id = d.doc_id AND a.n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in REPEAT_LENGTHS)},
  {", ".join(f"coalesce((SELECT x FROM top a WHERE a.doc_id = d.doc_id AND a.n = {n}), 0)::BIGINT AS top_chars_{n}" for n in TOP_LENGTHS)}
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN twice USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= 20 * word_chars AND {" AND ".join([f"100 * dup_chars_{n} <= {p} * word_chars" for n, p in REPEAT_LENGTHS.items()] + [f"100 * top_chars_{n} <= {p} * word_chars" for n, p in TOP_LENGTHS.items()])} AS kept FROM judged
"""

#: Levels of a tree that the SQL has: up to 16**5 leaves a source.
LEVELS = 5


def _tree(name: str, nodes: str) -> str:
    """CTEs of a tree over `nodes` (grp, n, pos, node): name_r{level} has its runs, name_top (grp, node) its roots."""
    parts, now, lone = [], nodes, [f"SELECT grp, node FROM {nodes} WHERE n = 1"]
    for level in range(LEVELS):
        parts.append(f"{name}_r{level} AS MATERIALIZED (SELECT grp, n, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS nodes FROM {now} WHERE n > 1 GROUP BY ALL)")
        parts.append(f"{name}_n{level} AS MATERIALIZED (SELECT grp, (n + 15) // 16 AS n, run AS pos, sha256(nodes) AS node FROM {name}_r{level})")
        now = f"{name}_n{level}"
        lone.append(f"SELECT grp, node FROM {now} WHERE n = 1")
    return ", ".join([*parts, f"{name}_top AS MATERIALIZED ({' UNION ALL '.join(lone)})"])


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}, '-')"


def _steps(name: str, rows: str, pos: str, grp: str) -> str:
    """CTEs that fold rows up a tree level by level: proof grows, folded is digested again; name_up has the end."""
    parts, now = [], rows
    for level in range(LEVELS):
        at = f"((a.{pos} // {16**level}) % 16)"
        left, right = f"substr(nodes, 1, 64 * {at})", f"substr(nodes, 64 * {at} + 65)"
        parts.append(f"""{name}_s{level} AS MATERIALIZED (SELECT a.* EXCLUDE (proof, folded), proof || coalesce({left} || {right}, '') AS proof, CASE WHEN nodes IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded FROM {now} a LEFT JOIN {name}_r{level} r ON r.grp = a.{grp} AND r.run = a.{pos} // {16 ** (level + 1)})""")
        now = f"{name}_s{level}"
    return ", ".join(parts)


_FIELDS = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
MERKLE = rf"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b)),
hit AS (SELECT doc_id, xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295)) % 5 = 0 AS tampered FROM documents, crc),
told AS MATERIALIZED (SELECT doc_id, source, sha256({_FIELDS} || {_field("text")}) AS leaf, sha256({_FIELDS} || {_field("changed")}) AS claimed
  FROM (SELECT documents.*, CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents JOIN hit USING (doc_id))),
leaves AS MATERIALIZED (SELECT doc_id, leaf AS node, claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM told),
{_tree("a", "leaves")},
roots AS MATERIALIZED (SELECT 0 AS grp, count(*) OVER () AS n, grp AS pos, node FROM a_top),
{_tree("b", "roots")},
start AS (SELECT doc_id, leaves.node AS leaf, leaves.grp, pos, 0 AS one, a_top.node AS subroot, b_top.node AS root, '' AS proof, claimed AS folded FROM leaves JOIN a_top USING (grp), b_top),
{_steps("a", "start", "pos", "grp")},
{_steps("b", f"a_s{LEVELS - 1}", "grp", "one")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM b_s{LEVELS - 1}
"""

ORACLES = {
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op8_benchmark_decontamination": DECONTAMINATION,
    "op9_ngram_jaccard_join": JACCARD,
    "op11_importance_resampling": IMPORTANCE,
    "op12_quality_rules": REPETITION,
    "op13_merkle_manifest": MERKLE,
}
