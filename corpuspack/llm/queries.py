"""The registered queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuspack.llm import decontam, host_rules, line_dedup, main_text, manifest, near_dup, pii, prefix_counts, secret_scan, site_quality, source_mix, token_align, token_file
from corpuspack.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Words and lines by regular expressions, three-word windows as joined texts, the beta prior's
# moments over the hosts.
_OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM windows SEMI JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) t USING (r, g)),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(l.n, 0) AS n_lines FROM d LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)),
f AS (SELECT *, 100 * n_symbols > 5 * word_chars AS s1, 100 * n_symbols > 2 * word_chars AS s2,
    100 * n_dup_lines > 50 * n_lines AS l1, 100 * n_dup_lines > 30 * n_lines AS l2,
    100 * n_repeat_words > 50 * n_words AS p1, 100 * n_repeat_words > 30 * n_words AS p2 FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (s2) AS s, count(*) FILTER (l2) AS l, count(*) FILTER (p2) AS p
    FROM f GROUP BY source),
u AS (UNPIVOT h ON s, l, p INTO NAME rule VALUE k),
prior AS (SELECT rule, sum(k) / sum(n) AS mean, greatest(sum(k) / sum(n) * (1 - sum(k) / sum(n)), 1e-6) AS spread,
    coalesce(var_samp(k / n), 0) AS var, avg(1 / n) AS noise FROM u GROUP BY rule),
fit AS (SELECT rule, mean, greatest(spread / greatest(var - spread * noise, spread / 1e4) - 1, 1) AS k0 FROM prior),
post AS (SELECT source, rule, n, mean, k0, (k + mean * k0) / (n + k0) AS rate FROM u JOIN fit USING (rule)),
bad AS (SELECT source, rule, rate >= 0.5 OR (mean > 0 AND rate - 2 * sqrt(rate * (1 - rate) / (n + k0 + 1)) >= 1.5 * mean) AS b FROM post),
suspect AS (SELECT source, bool_or(rule = 's' AND b) AS s, bool_or(rule = 'l' AND b) AS l, bool_or(rule = 'p' AND b) AS p
    FROM bad GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR p1 AS base_failed,
    NOT (n_words < 50 OR p1 OR s1 OR l1 OR (s2 AND suspect.s) OR (l2 AND suspect.l) OR (p2 AND suspect.p)) AS kept
FROM f JOIN suspect ON f.source IS NOT DISTINCT FROM suspect.source"""


@query("op1_host_rules", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("n_lines")


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


@query("op3_source_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


# Every pair of documents that shares a shingle, and what is reachable by the pairs that are
# similar enough.
_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = doc_id"""


@query("op4_near_dup", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_token_file")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file(table(spark, sf_dir, "documents"))


@query("op6_decontam")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@query("op9_site_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_prefix_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_table(table(spark, sf_dir, "documents"), keep_steps=False)
    return counted.withColumn("over_limit", prefix_counts.over_limit(F.col("n_tokens")))


# The check sum bit by bit, each tree level by level from the one below, the siblings by their
# positions, and a fold over each proof.
_OP11_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)),
        lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
        CAST(4294967295 AS BIGINT)) AS crc FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN
            sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM l)),
tree AS (SELECT lang, 0 AS level, pos, n, leaf AS node FROM d
    UNION ALL SELECT a.lang, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.node || coalesce(b.node, ''))
    FROM tree a LEFT JOIN tree b ON a.lang IS NOT DISTINCT FROM b.lang AND b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0),
tops AS (SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS rank,
    count(*) OVER () AS n FROM tree WHERE n = 1),
heads AS (SELECT 0 AS level, rank AS pos, n, subroot AS node FROM tops
    UNION ALL SELECT a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.node || coalesce(b.node, ''))
    FROM heads a LEFT JOIN heads b ON b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0),
root AS (SELECT node AS root, level AS height FROM heads WHERE n = 1),
sides AS (SELECT d.lang, d.pos, t.level, xor(d.pos >> t.level, 1) % 2 = 1 AS is_right, s.node
    FROM d JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang CROSS JOIN LATERAL (SELECT unnest(range(tops.height)) AS level) t
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM d.lang AND s.level = t.level AND s.pos = xor(d.pos >> t.level, 1)
    UNION ALL SELECT d.lang, d.pos, tops.height + h.level, xor(tops.rank >> h.level, 1) % 2 = 1, s.node
    FROM d JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang CROSS JOIN (SELECT unnest(range(height)) AS level FROM root) h
    LEFT JOIN heads s ON s.level = h.level AND s.pos = xor(tops.rank >> h.level, 1)),
proofs AS (SELECT lang, pos, list(struct_pack(is_right, node) ORDER BY level) AS path FROM sides GROUP BY lang, pos),
folded AS (SELECT d.doc_id, d.leaf, tops.subroot, root.root, sha256(coalesce(array_to_string(list_transform(path, lambda s: coalesce(s.node, '')), ''), '')) AS proof_sha256,
    list_reduce(list_transform(coalesce(path, []), lambda s: struct_pack(x := '', l := CASE WHEN s.is_right THEN '' ELSE coalesce(s.node, '') END,
        r := CASE WHEN s.is_right THEN coalesce(s.node, '') ELSE '' END)),
        lambda a, s: struct_pack(x := sha256(s.l || a.x || s.r), l := '', r := ''), struct_pack(x := coalesce(tampered, leaf), l := '', r := '')).x AS folded_root
    FROM d JOIN tops ON d.lang IS NOT DISTINCT FROM tops.lang CROSS JOIN root
    LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM d.lang AND p.pos = d.pos)
SELECT *, folded_root = root AS verified FROM folded"""


@query("op11_manifest", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


# Matches and the texts between them give the places; each window's entropy on its own.
_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
patterns AS (SELECT * FROM (VALUES
    (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'run', '[A-Za-z0-9+/_-]{20,}={0,2}')) t(rank, kind, pattern)),
found AS (SELECT r, rank, kind, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS g FROM d, patterns),
listed AS (SELECT r, rank, kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT r, rank, kind, m, sum(length(m) + length(g)) OVER (PARTITION BY r, rank ORDER BY i) AS e FROM listed),
base AS (SELECT r, rank, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
    WHERE (kind = 'assign' AND length(regexp_replace(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '')) >= 12)
        OR (kind = 'access' AND length(m) >= 18) OR (kind = 'hex' AND length(m) >= 16)),
runs AS (SELECT p.r, regexp_matches(m, '^[0-9A-Fa-f]+$') AS is_hex, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, m,
        text[greatest(e - length(m) - 200, 0) + 1:e - length(m)] AS before
    FROM placed p JOIN d USING (r) WHERE kind = 'run'),
free AS (SELECT * FROM runs WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = runs.r AND b.s <= runs.s AND runs.e <= b.e)
    AND NOT regexp_matches(m, '^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$|^[A-Za-z]+(?:[+/_-]+[A-Za-z]+)*[+/_-]*=*$|^[0-9+/_-]+=*$')
    AND NOT regexp_matches(m, '(?i)example|placeholder|changeme|dummy|your[_-]|x{6}|0123456789|abcdefgh')
    AND NOT regexp_matches(before, '(?i)(?:sha-?(?:1|256|384|512)|md5|checksum|digest|integrity|commit)[\x22'' ]*[:=]?[\x22'' ]*$')
    AND NOT regexp_matches(before, '(?i)[a-z]{3,8}://[^\s?\x22''<>]*$') AND NOT regexp_matches(before, '(?i)base64,$')),
windows AS (SELECT r, s, e, is_hex, regexp_replace(m, '=+$', '') AS m, unnest(range(1, length(regexp_replace(m, '=+$', '')) - 18)) AS k FROM free),
scored AS (SELECT r, s, e, is_hex, max(list_aggregate(string_split(m[k:k + 19], ''), 'entropy')) AS bits FROM windows GROUP BY ALL),
spans AS (SELECT r, rank, kind, s, e, true AS base FROM base UNION ALL
    SELECT r, CASE WHEN is_hex THEN 3 ELSE 4 END, CASE WHEN is_hex THEN 'entropy_hex' ELSE 'entropy_base64' END, s, e, false
    FROM scored WHERE bits >= CASE WHEN is_hex THEN 3.0 ELSE 3.7 END),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)"""


@query("op13_secrets", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


@query("op12_token_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
