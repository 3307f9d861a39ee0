"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, dedup, fim, html_extract, language_id, license_scan, merkle, packing, quality, secrets, token_counts, toxicity, warc
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), digest=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.as_files(read(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(read(spark, sf_dir, "documents")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.rate(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality_rules, op3_near_duplicates, op4_toxicity, op5_html_text,
        op6_secret_scan, op7_packing, op8_token_counts, op9_license_scan, op10_warc,
        op11_fill_in_middle, op12_language_id, op13_merkle_manifest,
    )
}


SQL = {
    "op1_decontamination": r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM w WHERE len(w) >= 5),
v AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM v WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
""",
    # all pairs that share a window of five words, then classes by reachability
    "op3_near_duplicates": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT text, min(doc_id) AS rep FROM t GROUP BY text),
w AS (SELECT rep, string_split_regex(regexp_replace(lower(text), '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), '[ \t-\r]+') AS w FROM r),
s AS (SELECT rep, s, count(*) AS n FROM (SELECT rep, unnest([hash(w[i:i+4]) FOR i IN range(1, len(w) - 3)]) AS s FROM w WHERE len(w) >= 5) GROUP BY rep, s),
z AS (SELECT rep, sum(n) AS z FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS m FROM s a JOIN s b ON a.s = b.s AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM p JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE m >= 0.8 * (x.z + y.z - m) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT rep AS a, rep AS b FROM r UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
k AS (SELECT a AS rep, min(b) AS class_id FROM c GROUP BY a)
SELECT doc_id, min(class_id) AS class_id FROM t JOIN r USING (text) JOIN k USING (rep) GROUP BY doc_id
""",
    # base32 by five hexadecimal digits at a time
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, first, octet_length(encode(html)) AS size, [CAST('0x' || substr(sha1(html), 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS v FROM p JOIN f USING (html))
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
    array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) % 32 + 1 AS BIGINT), 1) FOR s IN [15, 10, 5, 0]], '') FOR x IN v], '') AS payload_digest,
    CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (SELECT doc_id, text, len(u) AS n, h, u, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, h, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:], '') AS suf FROM c),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM f
""",
    # trees level by level; crc32 bit by bit over the digits
    "op13_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '-') AS tree,
    [CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS v,
    xor(4294967295, list_reduce(list_concat([4294967295], [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 0 AND n_chars IS NOT NULL AS chosen FROM documents),
l AS (SELECT tree, doc_id, sha256(array_to_string(v, '')) AS leaf,
    CASE WHEN chosen THEN sha256(v[1] || v[2] || v[3] || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || v[5]) ELSE sha256(array_to_string(v, '')) END AS used FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM l),
n AS (SELECT tree, 0 AS lvl, place, leaf AS node, size FROM p
    UNION ALL SELECT tree, lvl + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (size + 1) // 2 FROM n WHERE size > 1 GROUP BY tree, lvl, place // 2, size),
s AS (SELECT tree, lvl AS height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM n WHERE size = 1),
r AS (SELECT 0 AS lvl, place, subroot AS node, size FROM s
    UNION ALL SELECT lvl + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (size + 1) // 2 FROM r WHERE size > 1 GROUP BY lvl, place // 2, size),
q AS (SELECT tree, place, doc_id, lvl, (place >> lvl) & 1 AS side, node FROM (SELECT p.tree, p.place, doc_id, unnest(range(height)) AS lvl FROM p JOIN s ON p.tree = s.tree) x
    LEFT JOIN (SELECT tree AS t2, lvl AS l2, place AS p2, node FROM n) y ON t2 = tree AND l2 = lvl AND p2 = xor(place >> lvl, 1)
    UNION ALL SELECT p.tree, p.place, doc_id, s.height + x.lvl, (s.place >> x.lvl) & 1, y.node FROM p JOIN s ON p.tree = s.tree
    JOIN (SELECT DISTINCT lvl FROM r WHERE size > 1) x ON true LEFT JOIN r y ON y.lvl = x.lvl AND y.place = xor(s.place >> x.lvl, 1)),
w AS (SELECT tree, place, list({'side': side, 'node': coalesce(node, '')} ORDER BY lvl) AS path FROM q GROUP BY tree, place),
f AS (SELECT tree, place, 1 AS lvl, used AS node FROM p
    UNION ALL SELECT f.tree, f.place, lvl + 1, sha256(CASE WHEN path[lvl].side = 1 THEN path[lvl].node || f.node ELSE f.node || path[lvl].node END) FROM f JOIN w ON w.tree = f.tree AND w.place = f.place WHERE lvl <= len(path)),
e AS (SELECT tree, place, arg_max(node, lvl) AS folded_root FROM f GROUP BY tree, place)
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, sha256(array_to_string([x.node FOR x IN coalesce(path, [])], '')) AS proof_sha256, folded_root, folded_root = t.node AS verified
FROM p JOIN s ON s.tree = p.tree JOIN e ON e.tree = p.tree AND e.place = p.place JOIN (SELECT node FROM r WHERE size = 1) t ON true LEFT JOIN w ON w.tree = p.tree AND w.place = p.place
""",
}
