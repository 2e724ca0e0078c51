"""The registered queries of this subpackage, and the same as SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, license_scan, main_text, merkle, minhash, quality_lines, sanitize, secret_scan, sharding, spelling, substring_dedup, url_trust
from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_byte_shards(spark, sf_dir):
    out = sharding.shard_documents(load(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.token_digests(load(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark, sf_dir):
    out = minhash.near_duplicates(load(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLES["op4_minhash_near_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN n u ON u.doc_id = c.a JOIN n v ON v.doc_id = c.b WHERE 100 * c.k >= 75 * (u.n + v.n - c.k)),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""


@query
def op3_debruijn_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"))


ORACLES["op3_debruijn_dedup"] = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS low FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (win) WHERE low < doc_id),
k AS (
  SELECT w.doc_id, w.p, w.x FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w) w
  LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = w.p WHERE c.p IS NULL),
s AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM k GROUP BY 1)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(s.n, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)
"""


@query
def op5_line_frequency_rules(spark, sf_dir):
    return quality_lines.judge(load(spark, sf_dir, "documents")).drop("host", "mark", "lost_lines")


ORACLES["op5_line_frequency_rules"] = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g) WHERE k > 1) GROUP BY 1),
l AS MATERIALIZED (
  SELECT doc_id, source, line, regexp_replace(translate(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm,
    len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
b AS MATERIALIZED (SELECT doc_id, len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS failed FROM w LEFT JOIN r USING (doc_id)),
f AS (
  SELECT source, norm, min(doc_id) FILTER (NOT failed) AS first_doc FROM l JOIN b USING (doc_id) JOIN (SELECT source, count(DISTINCT doc_id) AS k FROM d GROUP BY 1) h USING (source)
  GROUP BY source, norm, k HAVING count(DISTINCT doc_id) > 20 AND (count(DISTINCT doc_id) * 100 > k OR count(DISTINCT doc_id) > 1000)),
x AS (SELECT l.doc_id, sum(l.n) AS n FROM l JOIN f ON f.source = l.source AND f.norm = l.norm AND f.first_doc IS DISTINCT FROM l.doc_id GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
c AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_lost_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_lost_words > 0 AND (n_words - n_lost_words < 50 OR 100 * n_lost_words > 50 * n_words)) AS kept
FROM c
"""


@query
def op10_minhash_containment(spark, sf_dir):
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLES["op10_minhash_containment"] = """
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS MATERIALIZED (SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY 1)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_item, count(*) AS n_shared
FROM s i JOIN s d ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY 1, 2, 3 HAVING 100 * count(*) >= 75 * n.n
"""

#: Host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op6_link_trust(spark, sf_dir):
    return url_trust.judge(load(spark, sf_dir, "pages"), URL_RULES)


def _trust_sql(rounds: int) -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for h, p, v in longest) + " END"
    steps = "".join(f""",
m{k + 1} AS MATERIALIZED (SELECT way, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
  SELECT m.way, w.dst AS host, (m.mass * {url_trust.FOLLOW}) // (100 * w.degree) AS mass FROM m{k} m JOIN ways w ON w.way = m.way AND w.src = m.host
  UNION ALL SELECT way, host, (mass * {100 - url_trust.FOLLOW}) // 100 FROM m0) GROUP BY 1, 2)""" for k in range(rounds))
    return rf"""
WITH u AS MATERIALIZED (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS MATERIALIZED (SELECT page_id, html, host, path, {case(0)} AS rule, {case(1)} AS said FROM u),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]*)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM r),
h AS (SELECT DISTINCT string_split(host, '.') AS p FROM r),
t AS (SELECT array_to_string(p[i:], '.') AS a, array_to_string(p[i + 1:], '.') AS b FROM (SELECT p, unnest(range(1, len(p) - 1)) AS i FROM h)),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM l UNION ALL SELECT a, b FROM t UNION ALL SELECT b, a FROM t) WHERE src <> '' AND dst <> '' AND src <> dst),
both_ways AS (SELECT 'trust' AS way, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e),
ways AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY way, src) AS degree FROM both_ways),
s AS (SELECT CASE WHEN said = 'allow' THEN 'trust' ELSE 'distrust' END AS way, host, count(*) AS n FROM r WHERE said IS NOT NULL AND host <> '' GROUP BY 1, 2),
m0 AS MATERIALIZED (SELECT way, host, CAST(({url_trust.MASS} // sum(n) OVER (PARTITION BY way)) * n AS BIGINT) AS mass FROM s){steps},
f AS (SELECT host, coalesce(sum(mass) FILTER (way = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (way = 'distrust'), 0) AS distrust FROM m{rounds} GROUP BY 1)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) // 100 * {url_trust.RATIO} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM r LEFT JOIN f ON f.host = r.host
"""


ORACLES["op6_link_trust"] = _trust_sql(url_trust.ROUNDS)


@query
def op8_disclosure_pii(spark, sf_dir):
    out = sanitize.personal_data(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k, _, _ in sanitize.KINDS], F.sha2(sanitize.span_list(F.col("base")), 256).alias("base_sha256"),
                      sanitize.span_list(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


@query
def op1_license_paragraphs(spark, sf_dir):
    return license_scan.scan(load(spark, sf_dir, "documents"))


@query
def op2_secret_forest(spark, sf_dir):
    out = secret_scan.scan(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("found", 256).alias("found_sha256"), "score", "is_secret")


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.proofs(load(spark, sf_dir, "documents"))


_TREE = """
  SELECT {g} AS g, 0 AS level, {pos} AS pos, {node} AS node, {n} AS n FROM {rows}
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2, n"""
_PATH = """
  SELECT l.g, l.pos, coalesce(string_agg(s.node, '' ORDER BY l.level), '') AS proof,
    list(CASE WHEN s.node IS NULL THEN 'N' WHEN s.pos < l.up THEN 'L' || s.node ELSE 'R' || s.node END ORDER BY l.level) AS steps
  FROM (SELECT a.g, a.pos, v.level, a.pos >> v.level AS up FROM (SELECT g, pos FROM {name} WHERE level = 0) a
        JOIN (SELECT DISTINCT g, level FROM {name} WHERE n > 1) v ON v.g = a.g) l
  LEFT JOIN {name} s ON s.g = l.g AND s.level = l.level AND s.pos = xor(l.up, 1) GROUP BY 1, 2"""

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE spelled AS (
  SELECT doc_id, lang, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS v,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
hashed AS MATERIALIZED (
  SELECT doc_id, lang, sha256(array_to_string(v, '')) AS leaf, sha256(v[1] || v[2] || v[3] || CASE WHEN crc % 7 = 0 THEN more ELSE v[4] END || v[5]) AS claimed FROM spelled),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
tree AS ({_TREE.format(g="g", pos="pos", node="leaf", n="n", rows="placed", name="tree")}),
subroots AS MATERIALIZED (SELECT g, node, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS ({_TREE.format(g="0", pos="g", node="node", n="n", rows="subroots", name="top")}),
own AS ({_PATH.format(name="tree")}),
over_ AS ({_PATH.format(name="top")}),
whole AS (
  SELECT p.doc_id, p.leaf, s.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(coalesce(a.proof, '') || coalesce(b.proof, '')) AS proof_sha256,
    list_reduce(list_concat([p.claimed], coalesce(a.steps, []), coalesce(b.steps, [])), lambda x, y:
      CASE y[1] WHEN 'L' THEN sha256(y[2:] || x) WHEN 'R' THEN sha256(x || y[2:]) ELSE sha256(x) END) AS folded_root
  FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN own a ON a.g = p.g AND a.pos = p.pos LEFT JOIN over_ b ON b.pos = p.g)
SELECT *, folded_root = root AS verified FROM whole
"""


@query
def op12_line_blocks(spark, sf_dir):
    return main_text.extract(load(spark, sf_dir, "pages"))


# The tables' pages mark their article, and its texts have no references but these.
ORACLES["op12_line_blocks"] = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS lines FROM a),
c AS (SELECT page_id, url, list_transform(lines, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS lines FROM b),
d AS (
  SELECT page_id, url, list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM c)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, length(array_to_string(lines, chr(10))) AS n_chars FROM d
"""


@query
def op11_fm_spelling(spark, sf_dir):
    return spelling.spelling_variants(load(spark, sf_dir, "documents"))


# A checksum of n bytes is the exclusive or of one table value for each byte and its distance from the end (and, for the starting value, of 255 with the first four bytes).
ORACLES["op11_fm_spelling"] = r"""
WITH RECURSIVE base AS MATERIALIZED (
  SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM (SELECT unnest(range(256)) AS b)),
crc AS (SELECT 0 AS far, b, v FROM base UNION ALL SELECT far + 1, c.b, xor(base.v, c.v >> 8) FROM crc c JOIN base ON base.b = c.v & 255 WHERE far < 80),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS MATERIALIZED (
  SELECT row_number() OVER () AS i, doc_id, run, k, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS bytes
  FROM (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY 1, 2)),
p AS (SELECT i, len(bytes) // 2 AS n, unnest(range(len(bytes) // 2)) AS q, bytes FROM k),
h AS (SELECT i, xor(bit_xor(crc.v), 4294967295) AS h FROM p JOIN crc ON crc.far = n - 1 - q AND crc.b = xor(CAST('0x' || bytes[2 * q + 1:2 * q + 2] AS BIGINT), CASE WHEN q < 4 THEN 255 ELSE 0 END) GROUP BY 1),
w AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM k JOIN h USING (i))
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
o AS MATERIALIZED (SELECT word, i, word[1:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT DISTINCT u, v FROM (
    SELECT x.word AS u, y.word AS v FROM o x JOIN o y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
    UNION ALL SELECT o.word, w.word FROM o JOIN w ON w.word = o.a || o.b
    UNION ALL SELECT w.word, o.word FROM o JOIN w ON w.word = o.a || o.b)),
m AS (SELECT u, count(*) AS n_near, max(w.n) AS most FROM near JOIN w ON w.word = v GROUP BY 1),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.most >= 5 * w.n THEN m.most END AS form_n,
    CASE WHEN m.most >= 5 * w.n THEN (SELECT decode(min(encode(v))) FROM near JOIN w x ON x.word = v WHERE u = w.word AND x.n = m.most) END AS form
  FROM w LEFT JOIN m ON m.u = w.word),
t AS (SELECT word, word AS reached FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.reached AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f e ON e.word = t.reached AND e.form IS NULL
"""
