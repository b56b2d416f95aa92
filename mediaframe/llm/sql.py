"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"'[^\x20\x09-\x0D]+'"

LINES = r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, pos, line, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS flat FROM l),
t AS (SELECT doc_id, pos, string_split(regexp_replace(flat, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM f),
g AS (SELECT doc_id, pos, len(t) AS n, t, list_concat([CAST(len(t) AS VARCHAR)], t[1:4]) AS leaf FROM t WHERE len(t) >= 4 OR (NOT list_contains(t, '<*>') AND t[1] <> '')),
w AS (SELECT leaf FROM g GROUP BY leaf HAVING count(*) >= 8),
c AS (SELECT g.* FROM g JOIN w ON g.leaf = w.leaf),
x AS (SELECT doc_id, pos, n, leaf, generate_subscripts(t, 1) AS p, unnest(t) AS x FROM c),
s AS (SELECT leaf, p, x FROM x WHERE x <> '<*>' GROUP BY ALL HAVING count(*) >= 8),
k AS (SELECT x.doc_id, x.pos, any_value(x.n) AS n, any_value(x.leaf) AS leaf, list({'p': x.p, 'x': x.x} ORDER BY x.p) AS c FROM x JOIN s ON x.leaf = s.leaf AND x.p = s.p AND x.x = s.x GROUP BY x.doc_id, x.pos),
m AS (SELECT doc_id, pos, leaf, c FROM k WHERE len(c) >= CASE WHEN n < 4 THEN n ELSE n * 0.6 END),
o AS (SELECT leaf, c FROM m GROUP BY leaf, c HAVING count(DISTINCT doc_id) >= 8),
d AS (SELECT m.doc_id, m.pos FROM m JOIN o ON m.leaf = o.leaf AND m.c = o.c)
SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (d.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.a"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT i.a, i.b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a)
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON id = n.doc_id GROUP BY id"""


def _apportion(rows: str, by: str, share: str, seats: str, order: str) -> str:
    """A query over rows that adds quota; by is '' or the grouping columns."""
    over = f"PARTITION BY {by}" if by else ""
    seats_in = f"{by}, " if by else ""
    return f"""(WITH r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rid, CAST({share} AS DOUBLE) AS sh, CAST({seats} AS BIGINT) AS seats FROM {rows}),
q AS (SELECT *, CASE WHEN sum(sh) OVER ({over}) > 0 THEN seats * sh / sum(sh) OVER ({over}) ELSE 0 END AS exact FROM r), b AS (SELECT *, CAST(greatest(floor(exact) - 2, 0) AS BIGINT) AS base FROM q),
l AS (SELECT *, seats - sum(base) OVER ({over}) AS remaining FROM b), o AS (SELECT {seats_in}rid, remaining, sh, unnest(range(base, CAST(ceil(exact) AS BIGINT) + 4)) AS k FROM l WHERE sh > 0),
z AS (SELECT *, row_number() OVER ({over} ORDER BY sh / (2 * k + 1) DESC, rid, k) AS place FROM o), won AS (SELECT rid, count(*) AS won FROM z WHERE place <= remaining GROUP BY rid)
SELECT l.* EXCLUDE (rid, sh, seats, exact, base, remaining), base + coalesce(won, 0) AS quota FROM l LEFT JOIN won USING (rid))"""


_BEFORE = "CASE WHEN blocks = 0 THEN 0 ELSE (({x} // 64 + turn) * extra // blocks) * 64 + ({x} % 64) * ((({x} // 64 + turn + 1) * extra // blocks) - (({x} // 64 + turn) * extra // blocks)) END"
MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORDS})), 0) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(ceil(count(*) / 2048.0) AS BIGINT) AS shards FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s0), s2 AS (SELECT *, ([5, 2, 1])[rank % 3 + 1]::DOUBLE AS w FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w, coalesce(sum(source_size) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fl, coalesce(sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fw FROM s2),
s4 AS (SELECT *, (total - 3.0 * fl) / (all_w - fw) AS level FROM s3), s5 AS (SELECT *, w * level > 3.0 * source_size AS capped FROM s4), s6 AS (SELECT *, (SELECT arg_min(level, (source_size / w, rank)) FROM s5 WHERE NOT capped) AS free FROM s5),
s7 AS (SELECT source, source_size, shards, rank, CAST(CASE WHEN capped THEN 3.0 * source_size ELSE w * free END AS DOUBLE) AS target FROM s6),
s8 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM s7), s AS (SELECT *, target - passes * source_size AS rest FROM s8),
sq AS {_apportion("s", "", "rest", "floor(sum(rest) OVER () / 64 + 0.5)", "rank")},
e AS (SELECT d.*, sq.* EXCLUDE (source), CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
ln AS (SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS line_end FROM e),
h AS (SELECT rank, shard, shard // 4096 AS grp, sum(size) AS shard_size, any_value(quota) AS source_quota FROM e GROUP BY rank, shard),
g AS (SELECT rank, grp, sum(shard_size) AS group_size, any_value(source_quota) AS source_quota FROM h GROUP BY rank, grp), gq AS {_apportion("g", "rank", "group_size", "source_quota", "rank, grp")},
h2 AS (SELECT h.*, gq.quota AS group_quota FROM h JOIN gq ON h.rank = gq.rank AND h.grp = gq.grp), hq AS {_apportion("h2", "rank, grp", "shard_size", "group_quota", "rank, shard")},
hb AS (SELECT rank, shard, CAST(ceil(shard_size / 64.0) AS BIGINT) AS blocks, quota, CAST('0x' || substr(md5('mix-1:' || rank || ':' || shard), 1, 6) AS BIGINT) AS t FROM hq),
hh AS (SELECT rank, shard, blocks, least(quota, blocks) AS extra, CASE WHEN blocks > 0 THEN t % blocks ELSE 0 END AS turn FROM hb),
a AS (SELECT ln.*, CAST(line_end AS BIGINT) AS y, CAST(line_end - size AS BIGINT) AS x, blocks, extra, turn FROM ln JOIN hh USING (rank, shard))
SELECT doc_id, size, source_size, target, CAST(passes * size + {_BEFORE.replace("{x}", "y")} - {_BEFORE.replace("{x}", "x")} AS BIGINT) AS taken FROM a"""

MIDDLE = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
g AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM h),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS q FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""

ORACLES: dict[str, str] = {"op13_fill_in_middle": MIDDLE, "op1_line_dedup": LINES, "op2_near_vectors": VECTORS, "op5_jaccard_join": JACCARD, "op7_mixing": MIX}
