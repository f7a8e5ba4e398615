"""SQL for the registered queries, written against the dense pileup and DuckDB's functions."""

from __future__ import annotations

import re

ALPHABET = "ACGT-N"

_NOISE = "(rid*7919 + pos*104729 + rid*pos) % 1009"


def _shift(k: int) -> str:
    return f"substr('ACGT', CAST(1+(b+{k})%4 AS INT), 1)"


_PLANTED = f"""CASE
    WHEN h=1 AND pos IN (12,37,55,80,108) THEN {_shift(1)}
    WHEN h=2 AND pos IN (20,37,62,90) THEN {_shift(2)}
    WHEN h=3 AND pos IN (48,49,50,51) THEN '-'
    WHEN h=3 AND pos IN (30,75,100) THEN {_shift(1)}
    ELSE {_shift(0)} END"""

_ALLELE = f"""CASE WHEN {_NOISE} < 2 THEN 'N' WHEN {_NOISE} < 7 THEN {_shift(1)} WHEN {_NOISE} < 11 THEN {_shift(2)}
    WHEN {_NOISE} < 14 THEN {_shift(3)} WHEN {_NOISE} < 24 THEN {_shift(0)} ELSE {_PLANTED} END"""

_H = "CASE WHEN ck % 20 < 10 THEN 0 WHEN ck % 20 < 15 THEN 1 WHEN ck % 20 < 18 THEN 2 ELSE 3 END AS h"

#: Shared common table expressions; a query lists what it needs after them.
BASE = f"""WITH RECURSIVE o AS (SELECT o_orderkey AS rid, o_custkey AS ck, (o_orderkey*37) % 61 AS s FROM orders),
segs AS (
  SELECT rid, ck, s AS off, CASE WHEN rid % 3 = 0 THEN s+59 ELSE s+24 END AS fin, 0 AS mate FROM o
  UNION ALL SELECT rid, ck, s+35 AS off, s+59 AS fin, 1 AS mate FROM o WHERE rid % 3 <> 0),
places AS (SELECT range AS pos, (range*range + 3*range + (range % 7)) % 4 AS b FROM range(120)),
cell AS (SELECT rid, ck, mate, off, fin, CAST(pos AS INT) AS pos, b, {_H} FROM segs JOIN places ON pos BETWEEN off AND fin),
pile2 AS (SELECT rid AS read_id, mate, off, fin, ck, pos, {_ALLELE} AS allele FROM cell),
pile AS (SELECT read_id, pos, allele FROM pile2),
lcell AS (SELECT rid, ck, CAST(pos AS INT) AS pos, b, {_H} FROM o CROSS JOIN places),
lpile AS (SELECT rid AS read_id, pos, CASE WHEN pos < rid % 10 OR pos >= 120 - rid % 7 THEN 'N' ELSE {_ALLELE} END AS allele FROM lcell),
truth AS (SELECT h AS haplotype, CAST(pos AS INT) AS pos, {_PLANTED} AS allele FROM (SELECT range AS h FROM range(4)) CROSS JOIN places),
counts AS (SELECT pos, allele, count(*) AS n FROM pile GROUP BY pos, allele),
prof AS (SELECT pos, allele, n, n / sum(n) OVER (PARTITION BY pos) AS freq FROM counts),
cons_del AS (SELECT pos, arg_min(allele, (-n, strpos('ACGT-N', allele))) AS major FROM counts WHERE allele <> 'N' GROUP BY pos),
cons AS (SELECT pos, CASE WHEN max(freq) < 0.001 THEN 'N' ELSE arg_min(allele, (-n, strpos('ACGT-N', allele))) END AS major FROM prof WHERE allele NOT IN ('N', '-') GROUP BY pos),
minors AS (SELECT read_id, pos, allele, major FROM pile JOIN cons USING (pos) WHERE allele <> major AND allele <> 'N'),
hits AS (
  SELECT a.pos AS p1, a.allele AS a1, b.pos AS p2, b.allele AS a2, count(*) AS o22
  FROM minors a JOIN minors b ON a.read_id = b.read_id AND a.pos < b.pos GROUP BY ALL),
cand AS (SELECT * FROM hits WHERE o22 >= 10),
link AS (
  SELECT c.p1, c.a1, c.p2, c.a2,
    count(*) FILTER (x.allele = m.major AND y.allele = n.major) AS o11, count(*) FILTER (x.allele = m.major AND y.allele = c.a2) AS o12,
    count(*) FILTER (x.allele = c.a1 AND y.allele = n.major) AS o21, c.o22, count(*) AS reads
  FROM cand c JOIN pile x ON x.pos = c.p1 JOIN pile y ON y.read_id = x.read_id AND y.pos = c.p2
  JOIN cons m ON m.pos = c.p1 JOIN cons n ON n.pos = c.p2
  WHERE x.allele <> 'N' AND y.allele <> 'N' GROUP BY c.p1, c.a1, c.p2, c.a2, c.o22),
lf AS (SELECT range AS k, coalesce(sum(CASE WHEN range > 0 THEN ln(range) END) OVER (ORDER BY range), 0) AS f FROM range(200001)),
rated AS (
  SELECT *, o12*o21 / nullif(o11*reads, 0)::DOUBLE AS p,
    o22 / nullif(0.2*o11 + 0.8*(o12+o21), 0)::DOUBLE AS ratio FROM link WHERE o22 / reads > 0.02),
tails AS (
  SELECT p1, a1, p2, a2, sum(exp(n.f - k.f - r.f + k.k*ln(p) + (reads-k.k)*ln(1-p))) AS tail
  FROM rated JOIN lf n ON n.k = reads JOIN lf k ON k.k > o22 AND k.k <= reads JOIN lf r ON r.k = reads - k.k
  WHERE p > 0 AND p < 1 GROUP BY p1, a1, p2, a2),
tested AS (
  SELECT rated.*, CASE WHEN o12 = 0 OR o21 = 0 THEN NOT coalesce(ratio < 0.2, false)
    WHEN p > 1 THEN false WHEN p < 1e-12 THEN true
    ELSE coalesce(tail, 0) < 1e-7 / (120*119/2) OR coalesce(ratio > 0.2, true) END AS is_edge
  FROM rated LEFT JOIN tails USING (p1, a1, p2, a2)),
edges AS (
  SELECT printf('%010d%s', p1, a1) AS u, printf('%010d%s', p2, a2) AS v, * FROM tested WHERE is_edge),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
nodes AS (SELECT DISTINCT u FROM ways),
grow AS (
  SELECT [u] AS vs FROM nodes
  UNION ALL
  SELECT list_append(vs, w.v) FROM grow JOIN ways w ON w.u = vs[1]
  WHERE w.v > vs[-1] AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(vs) AS x) t WHERE NOT EXISTS (SELECT 1 FROM ways q WHERE q.u = t.x AND q.v = w.v))),
cliques AS (
  SELECT vs, row_number() OVER (ORDER BY array_to_string(vs, ',')) - 1 AS clique_id FROM grow
  WHERE len(vs) > 1 AND NOT EXISTS (
    SELECT 1 FROM nodes n WHERE NOT list_contains(vs, n.u)
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(vs) AS x) t WHERE NOT EXISTS (SELECT 1 FROM ways q WHERE q.u = t.x AND q.v = n.u)))),
member AS (SELECT clique_id, v, CAST(substr(v, 1, 10) AS INT) AS pos, substr(v, 11) AS allele FROM (SELECT clique_id, unnest(vs) AS v FROM cliques)),
pm AS (SELECT haplotype AS clique_id, pos, allele FROM truth JOIN cons USING (pos) WHERE allele <> major),
ids AS (SELECT range AS clique_id FROM range(4)),
strings AS (
  SELECT ids.clique_id, c.pos, coalesce(pm.allele, major) AS allele, pm.allele IS NOT NULL AS is_snp
  FROM ids CROSS JOIN (SELECT pos, major FROM cons WHERE pos IN (SELECT pos FROM pm)) c LEFT JOIN pm ON pm.clique_id = ids.clique_id AND pm.pos = c.pos),
bare AS (SELECT clique_id, NOT bool_or(is_snp) AS bare FROM strings GROUP BY clique_id),
dist AS (
  SELECT read_id, clique_id, count(*) FILTER (p.allele <> s.allele) AS d, count(*) FILTER (is_snp OR bare) AS coincidences
  FROM pile p JOIN strings s USING (pos) JOIN bare USING (clique_id) WHERE p.allele <> 'N' GROUP BY read_id, clique_id),
near AS (SELECT *, min(d) OVER (PARTITION BY read_id) AS least FROM dist WHERE coincidences > 0 AND coincidences <> d),
assigned AS (SELECT read_id, clique_id, count(*) OVER (PARTITION BY read_id) AS k FROM near WHERE d = least),
lik AS (
  SELECT read_id, haplotype AS hap_id, count(*) FILTER (p.allele <> t.allele) AS misses, count(*) AS size FROM pile p JOIN truth t USING (pos) GROUP BY ALL),
likely AS (SELECT *, pow(0.999, size - misses) * pow(0.001/3, misses) AS h FROM lik),
called AS (SELECT DISTINCT pos, allele FROM pm),
letters AS (SELECT pos, allele, n / sum(n) OVER (PARTITION BY pos) AS freq FROM counts WHERE allele <> 'N'),
called_at AS (SELECT pos, count(*) + 1 AS alleles FROM called GROUP BY pos),
ranked AS (
  SELECT l.pos, l.allele, l.freq, greatest(a.alleles, (SELECT count(*) FROM letters x WHERE x.pos = l.pos AND x.freq > l.freq) + 1) AS alleles
  FROM letters l JOIN called_at a USING (pos) JOIN called c ON c.pos = l.pos AND c.allele = l.allele),
eps AS (
  SELECT r.*, least(0.002, coalesce((SELECT sum(x.freq) FROM (SELECT freq, row_number() OVER (ORDER BY freq DESC) AS i FROM letters y WHERE y.pos = r.pos) x WHERE x.i > r.alleles), 0) / nullif(5 - r.alleles, 0)) AS e FROM ranked r),
vc AS (SELECT pos, allele, freq, alleles, CASE WHEN alleles > 4 THEN freq ELSE (freq - e) / (1 - 5*e) END AS corrected FROM eps)
"""

_SEG = "SELECT read_id, mate, off, string_agg(allele, '' ORDER BY pos) AS seq FROM pile2 GROUP BY read_id, mate, off"

_PAIRS = f"""pairs AS (
  SELECT a.read_id, a.seq AS l, a.off AS l_off, coalesce(b.seq, '') AS r, CASE WHEN b.seq IS NULL THEN -1 ELSE a.off + 15 + a.read_id % 20 END AS r_off
  FROM ({_SEG}) a LEFT JOIN ({_SEG}) b ON b.read_id = a.read_id AND b.mate = 1 WHERE a.mate = 0)"""

_DIGITS = "CASE WHEN x >= 1 THEN 2 WHEN x >= 0.1 THEN 3 WHEN x >= 0.01 THEN 4 WHEN x >= 0.001 THEN 5 WHEN x >= 1e-4 THEN 6 WHEN x >= 1e-5 THEN 7 WHEN x >= 1e-6 THEN 8 WHEN x >= 1e-7 THEN 9 WHEN x >= 1e-8 THEN 10 WHEN x >= 1e-9 THEN 11 ELSE 1 END"
_SMART = "CASE " + " ".join(f"WHEN {_DIGITS} = {d} THEN CAST(CAST(CAST(x AS VARCHAR) AS DECIMAL(30,{d})) AS VARCHAR)" for d in range(1, 12)) + " END"

#: Pairs of vertices, both ways, that reads do not link, and the pairs of cliques that they or a position keep apart.
_UNLINKED = """, vx AS (SELECT DISTINCT p1 AS pos, a1 AS allele FROM edges UNION SELECT p2, a2 FROM edges),
        pr AS (SELECT x.pos AS p1, x.allele AS a1, y.pos AS p2, y.allele AS a2 FROM vx x JOIN vx y ON x.pos < y.pos),
        tb AS (SELECT pr.*, count(*) AS reads, count(*) FILTER (x.allele = m.major AND y.allele = n.major) AS o11, count(*) FILTER (x.allele = a1 AND y.allele = a2) AS o22
          FROM pr JOIN pile x ON x.pos = p1 JOIN pile y ON y.read_id = x.read_id AND y.pos = p2 JOIN cons m ON m.pos = p1 JOIN cons n ON n.pos = p2 WHERE x.allele <> 'N' AND y.allele <> 'N' GROUP BY p1, a1, p2, a2),
        sw AS (SELECT *, CASE WHEN o11 = 0 THEN o11 ELSE o22 END AS z FROM tb WHERE reads >= 50),
        lo AS (SELECT p1, a1, p2, a2, reads, z, sum(exp(n.f - k.f - r.f + k.k*ln(0.02) + (reads-k.k)*ln(0.98))) AS cdf FROM sw JOIN lf n ON n.k = reads JOIN lf k ON k.k <= z JOIN lf r ON r.k = reads - k.k GROUP BY ALL),
        bad AS (SELECT printf('%010d%s', p1, a1) AS x, printf('%010d%s', p2, a2) AS y FROM lo WHERE cdf < 1e-4),
        un AS (SELECT x, y FROM bad WHERE NOT EXISTS (SELECT 1 FROM edges WHERE u = x AND v = y)),
        both_ways AS (SELECT x, y FROM un UNION SELECT y, x FROM un)"""
_APART = """SELECT DISTINCT a.clique_id AS c1, b.clique_id AS c2 FROM member a JOIN member b ON a.clique_id < b.clique_id
        WHERE (a.pos = b.pos AND a.v <> b.v) OR EXISTS (SELECT 1 FROM both_ways w WHERE w.x = a.v AND w.y = b.v)"""

#: Clusters around the planted haplotypes, and the letters g of each.
_CLUSTERS = """, w AS (SELECT clique_id, pos, allele, sum(1.0::DOUBLE / k) AS weight FROM pile JOIN assigned USING (read_id) GROUP BY ALL),
        f AS (SELECT *, weight / sum(weight) OVER (PARTITION BY clique_id, pos) AS freq FROM w),
        own AS (SELECT clique_id, pos, CASE WHEN max(freq) < 0.01 THEN 'N' ELSE arg_min(allele, (-freq, strpos('ACGT-N', allele))) END AS a FROM f WHERE allele <> 'N' GROUP BY clique_id, pos),
        g AS (SELECT i.clique_id, c.pos, c.major, CASE WHEN a <> 'N' THEN a ELSE c.major END AS allele FROM (SELECT DISTINCT clique_id FROM assigned) i CROSS JOIN cons c LEFT JOIN own ON own.clique_id = i.clique_id AND own.pos = c.pos)"""

_SELECTS = {
    "coverage_counts": "SELECT pos, allele, n FROM counts",
    "coverage_counts_no_n": "SELECT pos, allele, n FROM counts WHERE allele <> 'N'",
    "profile_freq": "SELECT pos, allele, n, round(freq, 9) AS freq FROM prof",
    "weighted_profile": """, w AS (SELECT clique_id, pos, allele, sum(1.0::DOUBLE / k) AS weight FROM pile JOIN assigned USING (read_id) GROUP BY ALL)
        SELECT clique_id, pos, allele, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY clique_id, pos), 9) AS freq FROM w""",
    "consensus_with_del": "SELECT pos, major FROM cons_del",
    "consensus_no_del": "SELECT pos, major FROM cons",
    "consensus_string": "SELECT string_agg(major, '' ORDER BY pos) AS consensus FROM cons_del",
    "profile_matrix": """, r AS (SELECT i AS row_no, substr('ACGT-', CAST(i+1 AS INT), 1) AS allele FROM (SELECT range AS i FROM range(5)))
        SELECT CAST(row_no AS INT) AS row_no, r.allele, string_agg(coalesce(n, 0)::VARCHAR || chr(9), '' ORDER BY p.pos) AS line
        FROM r CROSS JOIN (SELECT DISTINCT pos FROM counts) p LEFT JOIN counts c ON c.pos = p.pos AND c.allele = r.allele GROUP BY row_no, r.allele""",
    "minors_sparse": """SELECT read_id, pos, allele, CASE WHEN allele <> 'N' THEN CAST(pos*4 + strpos('ACGT-N', allele) - 1 - CASE WHEN strpos('ACGT-N', allele) >= strpos('ACGT-N', major) THEN 1 ELSE 0 END AS INT) END AS v
        FROM pile JOIN cons USING (pos) WHERE allele <> major""",
    "major_counts": "SELECT pos, count(*) FILTER (allele = major) AS majors FROM pile JOIN cons USING (pos) GROUP BY pos",
    "n_index": "SELECT pos, count(*) FILTER (allele = 'N') AS n_reads FROM pile GROUP BY pos",
    "split_encode_roundtrip": """SELECT pos, allele, n, CAST(pos*4 + strpos('ACGT-N', allele) - 1 - CASE WHEN strpos('ACGT-N', allele) >= strpos('ACGT-N', major) THEN 1 ELSE 0 END AS INT) AS v, pos AS decoded_pos, allele AS decoded
        FROM counts JOIN cons USING (pos) WHERE allele NOT IN (major, 'N')""",
    "overlap_merge": f""", {_PAIRS} SELECT read_id, CASE WHEN r_off >= 0 AND l_off + length(l) > r_off THEN l || substr(r, CAST(l_off + length(l) - r_off + 1 AS INT)) ELSE l END AS l, CAST(l_off AS INT) AS l_off,
        CASE WHEN r_off >= 0 AND l_off + length(l) > r_off THEN '' ELSE r END AS r, CAST(CASE WHEN r_off >= 0 AND l_off + length(l) > r_off THEN -1 ELSE r_off END AS INT) AS r_off FROM pairs""",
    "mate_pairing": """, rec AS (
          SELECT rid*4 + mate AS rec_id, rid AS qname, off + 1 AS pos, CASE WHEN rid % 3 = 0 THEN off + 1 WHEN mate = 0 THEN off + 36 ELSE off - 34 END AS pnext, CASE WHEN rid % 11 = 0 OR rid % 3 = 0 THEN 0 ELSE 1 END AS flag FROM segs
          UNION ALL SELECT rid*4 + 2, rid, s + 1, CASE WHEN rid % 3 = 0 THEN s + 1 ELSE s + 36 END, CASE WHEN rid % 11 = 0 THEN 0 ELSE 1 END FROM o WHERE rid % 13 = 0),
        sized AS (SELECT *, count(*) OVER (PARTITION BY qname) AS size FROM rec)
        SELECT qname, 'single' AS kind, rec_id AS i, CAST(NULL AS BIGINT) AS j FROM sized WHERE size = 1 OR flag % 2 = 0
        UNION ALL SELECT a.qname, CASE WHEN a.rec_id = b.rec_id THEN 'single' ELSE 'pair' END, a.rec_id, CASE WHEN a.rec_id <> b.rec_id THEN b.rec_id END
        FROM sized a JOIN rec b ON a.qname = b.qname AND a.pnext = b.pos AND a.pos = b.pnext AND a.pos <= b.pos
        WHERE a.size > 1 AND a.flag % 2 = 1 AND (a.rec_id = b.rec_id OR a.pos < b.pos)""",
    "minor_hits": "SELECT p1, a1, p2, a2, o22 FROM hits",
    "common_reads_short": ", pq AS (SELECT DISTINCT p1, p2 FROM cand) SELECT p1, p2, count(*) AS reads FROM pq JOIN pile x ON x.pos = p1 JOIN pile y ON y.read_id = x.read_id AND y.pos = p2 WHERE x.allele <> 'N' AND y.allele <> 'N' GROUP BY p1, p2",
    "common_reads_long": ", x AS (SELECT read_id, pos FROM lpile WHERE allele <> 'N') SELECT a.pos AS p1, b.pos AS p2, count(*) AS reads FROM x a JOIN x b ON a.read_id = b.read_id AND a.pos < b.pos GROUP BY a.pos, b.pos",
    "linkage_table": "SELECT p1, a1, p2, a2, o11, o12, o21, o22, reads FROM link",
    "edges_ratio": "SELECT p1, a1, p2, a2, o11, o12, o21, o22, reads, round(ratio, 6) AS ratio FROM rated WHERE ratio > 0.2",
    "edges_pvalue": "SELECT p1, a1, p2, a2, is_edge FROM tested",
    "linked_variants": "SELECT p1, a1, p2, a2, o11, o12, o21, o22, reads, round(o22 / reads, 9) AS rel_freq FROM edges",
    "top_edges": "SELECT p1, a1, p2, a2, o22, reads, round(o22 / reads, 9) AS rel_freq FROM link ORDER BY o22 / reads DESC, p1, a1, p2, a2 LIMIT 20",
    "second_minor_prune": """, way AS (SELECT p1 AS p, a1 AS a, p2 AS q, a2 AS b FROM link UNION ALL SELECT p2, a2, p1, a1 FROM link),
        best AS (SELECT p, a, q, b FROM (SELECT w.*, row_number() OVER (PARTITION BY p, a, q ORDER BY freq DESC, b) AS i FROM way w JOIN prof ON prof.pos = q AND prof.allele = b) WHERE i = 1)
        SELECT p1, a1, p2, a2, o22 FROM link WHERE EXISTS (SELECT 1 FROM best WHERE p = p1 AND a = a1 AND q = p2 AND b = a2) AND EXISTS (SELECT 1 FROM best WHERE p = p2 AND a = a2 AND q = p1 AND b = a1)""",
    "frequent_minor_candidates": "SELECT pos, allele, depth, round(freq, 9) AS freq FROM (SELECT pos, allele, freq, row_number() OVER (PARTITION BY pos ORDER BY freq DESC, strpos('ACGT-N', allele)) AS i, CAST(sum(n) OVER (PARTITION BY pos) AS BIGINT) AS depth FROM prof) WHERE i = 2 AND depth >= 40 AND freq >= 0.2 AND allele NOT IN ('N', '-')",
    "conflict_resolution": """, c AS (SELECT 0 AS clique_id, pos, allele FROM called UNION ALL SELECT clique_id, pos, allele FROM pm),
        b AS (SELECT c.*, freq, max(freq) OVER (PARTITION BY clique_id, c.pos) AS best FROM c JOIN prof USING (pos, allele))
        SELECT CAST(clique_id AS BIGINT) AS clique_id, string_agg(printf('%010d%s', pos, allele), ',' ORDER BY printf('%010d%s', pos, allele)) AS vs FROM b WHERE freq = best GROUP BY clique_id""",
    "deletion_regions": """, d AS (SELECT read_id, mate, off, fin, pos, pos - row_number() OVER (PARTITION BY read_id, mate ORDER BY pos) AS g FROM pile2 WHERE allele = '-'),
        r AS (SELECT read_id, mate, fin, min(pos) AS s, max(pos) AS e, count(*) AS len FROM d GROUP BY read_id, mate, fin, g)
        SELECT CAST(s AS INT) AS s, CAST(CASE WHEN e = fin THEN e + 1 ELSE e END AS INT) AS e, count(*) AS n FROM r WHERE len >= CASE WHEN e = fin THEN 3 ELSE 4 END GROUP BY ALL HAVING count(*) >= 10""",
    "deletion_edges": """, d AS (SELECT read_id, mate, off, fin, pos, pos - row_number() OVER (PARTITION BY read_id, mate ORDER BY pos) AS g FROM pile2 WHERE allele = '-'),
        r AS (SELECT read_id, mate, fin, min(pos) AS s, max(pos) AS e, count(*) AS len FROM d GROUP BY read_id, mate, fin, g),
        t AS (SELECT s, CASE WHEN e = fin THEN e + 1 ELSE e END AS e FROM r WHERE len >= CASE WHEN e = fin THEN 3 ELSE 4 END GROUP BY ALL HAVING count(*) >= 10)
        SELECT DISTINCT CAST(x.range AS INT) AS p1, CAST(y.range AS INT) AS p2 FROM t JOIN range(120) x ON x.range >= s AND x.range < e JOIN range(120) y ON y.range > x.range AND y.range < e""",
    "edge_graph_short": """, d AS (SELECT read_id, mate, off, fin, pos, pos - row_number() OVER (PARTITION BY read_id, mate ORDER BY pos) AS g FROM pile2 WHERE allele = '-'),
        r AS (SELECT read_id, mate, fin, min(pos) AS s, max(pos) AS e, count(*) AS len FROM d GROUP BY read_id, mate, fin, g),
        t AS (SELECT s, CASE WHEN e = fin THEN e + 1 ELSE e END AS e FROM r WHERE len >= CASE WHEN e = fin THEN 3 ELSE 4 END GROUP BY ALL HAVING count(*) >= 10),
        al AS (SELECT p1, a1, p2, a2 FROM edges UNION SELECT CAST(x.range AS INT), '-', CAST(y.range AS INT), '-' FROM t JOIN range(120) x ON x.range >= s AND x.range < e JOIN range(120) y ON y.range > x.range AND y.range < e),
        way AS (SELECT p1 AS p, a1 AS a, p2 AS q, a2 AS b FROM al UNION ALL SELECT p2, a2, p1, a1 FROM al),
        rk AS (SELECT w.*, row_number() OVER f AS i, first_value(b) OVER f AS winner FROM way w JOIN prof ON prof.pos = q AND prof.allele = b WINDOW f AS (PARTITION BY p, a, q ORDER BY freq DESC, b)),
        best AS (SELECT * FROM rk WHERE i = 1 OR winner <> '-')
        SELECT printf('%010d%s', p1, a1) AS u, printf('%010d%s', p2, a2) AS v FROM al WHERE EXISTS (SELECT 1 FROM best WHERE p = p1 AND a = a1 AND q = p2 AND b = a2) AND EXISTS (SELECT 1 FROM best WHERE p = p2 AND a = a2 AND q = p1 AND b = a1)""",
    "fragment_length": ", f AS (SELECT CASE WHEN rid % 3 = 0 THEN 60 ELSE 60 END AS size, count(*) AS n FROM o GROUP BY 1) SELECT CAST(min(size) AS INT) AS fragment_length FROM (SELECT size, sum(n) OVER (ORDER BY size) AS upto, sum(n) OVER () AS total FROM f) WHERE upto > 0.9 * total",
    "most_covered_position": ", d AS (SELECT pos, sum(n) AS depth FROM counts GROUP BY pos), m AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS c FROM d WHERE depth = (SELECT max(depth) FROM d)) SELECT pos FROM m WHERE i = c // 2",
    "read_stats": "SELECT count(DISTINCT rid) AS n_reads, count(DISTINCT CASE WHEN rid % 3 = 0 THEN rid END) AS n_single, count(DISTINCT CASE WHEN rid % 3 <> 0 THEN rid END) AS n_paired, CAST(max(fin) + 1 AS INT) AS reference_length, count(DISTINCT CASE WHEN rid % 3 <> 0 THEN rid END) < count(DISTINCT CASE WHEN rid % 3 = 0 THEN rid END) AS single_read FROM segs",
    "snp_components": ", reach AS (SELECT u AS a, u AS b FROM nodes UNION SELECT reach.a, w.v FROM reach JOIN ways w ON w.u = reach.b) SELECT a AS node, min(b) AS component FROM reach GROUP BY a",
    "maximal_cliques": "SELECT clique_id, array_to_string(vs, ',') AS vs FROM cliques",
    "merge_scores": """, pair AS (SELECT a.clique_id AS c1, b.clique_id AS c2, a.v AS x, b.v AS y, a.pos AS px, b.pos AS py FROM member a JOIN member b ON a.clique_id < b.clique_id)
        SELECT c1, c2, count(*) FILTER (x = y OR EXISTS (SELECT 1 FROM ways w WHERE w.u = x AND w.v = y)) AS score FROM pair GROUP BY c1, c2
        HAVING count(*) FILTER (px = py AND x <> y) = 0 AND count(*) FILTER (x = y OR EXISTS (SELECT 1 FROM ways w WHERE w.u = x AND w.v = y)) > 0""",
    "subset_elimination": """, c AS (SELECT clique_id, vs FROM cliques UNION ALL SELECT clique_id + 1000, vs[1:2] FROM cliques WHERE len(vs) > 2)
        SELECT clique_id, array_to_string(vs, ',') AS vs FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE len(d.vs) > len(c.vs) AND list_has_all(d.vs, c.vs))""",
    "clique_strings": "SELECT CAST(clique_id AS INT) AS clique_id, string_agg(allele, '' ORDER BY pos) AS letters FROM strings GROUP BY clique_id",
    "read_assignment": "SELECT read_id, CAST(clique_id AS INT) AS clique_id, k FROM assigned",
    "cluster_sizes": "SELECT CAST(clique_id AS INT) AS clique_id, count(*) AS reads, round(sum(1.0::DOUBLE / k), 6) AS weight FROM assigned GROUP BY clique_id",
    "low_quality_filter": """, m AS (SELECT read_id, count(*) FILTER (p.allele <> c.major AND p.allele <> 'N' AND p.pos NOT IN (SELECT pos FROM pm)) AS mistakes FROM pile p JOIN cons c USING (pos) GROUP BY read_id)
        SELECT read_id, mistakes FROM (SELECT *, row_number() OVER (ORDER BY mistakes, read_id) AS i, count(*) OVER () AS n FROM m) WHERE i <= ceil(0.9 * n)""",
    "read_likelihood": "SELECT read_id, CAST(hap_id AS INT) AS hap_id, misses, size, round(h, 9) AS h FROM likely",
    "em_one_step": """, t AS (SELECT read_id, sum(h * 0.25) AS total FROM likely GROUP BY read_id),
        s AS (SELECT hap_id, sum(h * 0.25 / total) AS s FROM likely JOIN t USING (read_id) WHERE total > 0 GROUP BY hap_id)
        SELECT CAST(hap_id AS INT) AS hap_id, round(s / sum(s) OVER (), 9) AS frequency FROM s""",
    "vc_frequencies": "SELECT pos, allele, round(freq, 9) AS freq, CAST(alleles AS INT) AS alleles, round(corrected, 9) AS corrected FROM vc",
    "vcf_rows": f""", a AS (SELECT vc.pos, major, allele, (SELECT {_SMART} FROM (SELECT corrected AS x) q) AS af FROM vc JOIN cons USING (pos) WHERE allele <> '-' AND major <> '-')
        SELECT 'ref' AS chrom, CAST(pos + 1 AS INT) AS pos, '.' AS id, major AS ref, string_agg(allele, ',' ORDER BY allele) AS alt, '.' AS qual, 'PASS' AS filter, 'AF=' || string_agg(af, ',' ORDER BY allele) AS info FROM a GROUP BY pos, major""",
    "imputed_reads": """, m AS (SELECT read_id, haplotype, count(*) FILTER (p.allele <> t.allele AND p.allele <> 'N') AS bad FROM lpile p JOIN truth t USING (pos) GROUP BY read_id, haplotype),
        f AS (SELECT read_id, min(haplotype) AS haplotype FROM m WHERE bad = 0 GROUP BY read_id)
        SELECT p.read_id, string_agg(CASE WHEN p.allele = 'N' THEN coalesce(t.allele, 'N') ELSE p.allele END, '' ORDER BY p.pos) AS value
        FROM lpile p LEFT JOIN f USING (read_id) LEFT JOIN truth t ON t.haplotype = f.haplotype AND t.pos = p.pos GROUP BY p.read_id""",
    "hamming_pairs": "SELECT read_id, CAST(mate AS INT) AS mate, count(*) FILTER (p.allele <> t.allele) AS distance FROM pile2 p JOIN truth t ON t.pos = p.pos AND t.haplotype = 0 GROUP BY read_id, mate",
    "string_difference": "SELECT read_id, CAST(mate AS INT) AS mate, coalesce(string_agg(printf('%d %s %s', p.pos - off, p.allele, t.allele), ';' ORDER BY p.pos) FILTER (p.allele <> t.allele), '') AS difference FROM pile2 p JOIN truth t ON t.pos = p.pos AND t.haplotype = 0 GROUP BY read_id, mate",
    "nearest_truth": """, c AS (SELECT ck % 20 AS g, pos, allele, count(*) AS n FROM pile2 WHERE allele <> 'N' GROUP BY ALL),
        s AS (SELECT g, pos, arg_min(allele, (-n, strpos('ACGT-N', allele))) AS allele FROM c GROUP BY g, pos),
        d AS (SELECT t.haplotype, s.g, count(*) FILTER (s.allele <> t.allele) AS distance FROM truth t JOIN s USING (pos) GROUP BY ALL)
        SELECT CAST(haplotype AS INT) AS haplotype, arg_min(g, (distance, g)) AS nearest, min(distance) AS distance, min(distance) = 0 AS found FROM d GROUP BY haplotype""",
    "padded_segments": f"SELECT read_id, CAST(mate AS INT) AS mate, rpad(seq, 70, '%') AS padded FROM ({_SEG})",
    "letters_at": "SELECT rid AS read_id, CAST(30 + rid % 60 AS INT) AS pos, coalesce(p.allele, 'N') AS letter FROM o LEFT JOIN pile p ON p.read_id = rid AND p.pos = 30 + rid % 60",
    "normalised_counts": "SELECT pos, allele, round(CASE WHEN pos % 10 = 0 THEN (SELECT n::DOUBLE FROM counts c WHERE c.pos = l.pos AND c.allele = l.allele) ELSE freq END, 9) AS share FROM letters l",
    "minus_log_chances": """, d AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS depth FROM counts)
        SELECT pos, allele, n, round(-(x.f - y.f - z.f + n*ln(0.25) + (depth - n)*ln(0.75)), 3) AS minus_log FROM d JOIN lf x ON x.k = depth JOIN lf y ON y.k = n JOIN lf z ON z.k = depth - n""",
    "edge_chances": "SELECT p1, a1, p2, a2, round(CASE WHEN p > 1 THEN 1 WHEN coalesce(ratio > 0.2, true) THEN 0 WHEN p < 1e-12 THEN 0 ELSE coalesce(tail, 0) END, 9) AS p FROM rated LEFT JOIN tails USING (p1, a1, p2, a2)",
    "linked_variants_long": """, lc AS (SELECT pos, arg_min(allele, (-n, strpos('ACGT-N', allele))) AS major FROM (SELECT pos, allele, count(*) AS n FROM lpile WHERE allele <> 'N' GROUP BY ALL) GROUP BY pos),
        lm AS (SELECT read_id, pos, allele FROM lpile JOIN lc USING (pos) WHERE allele NOT IN (major, 'N', '-')),
        lh AS (SELECT a.pos AS p1, a.allele AS a1, b.pos AS p2, b.allele AS a2, count(*) AS o22 FROM lm a JOIN lm b ON a.read_id = b.read_id AND b.pos - a.pos > 5 GROUP BY ALL HAVING count(*) >= 10),
        lt AS (SELECT h.p1, h.a1, h.p2, h.a2, count(*) FILTER (x.allele = m.major AND y.allele = n.major) AS o11, count(*) FILTER (x.allele = m.major AND y.allele = a2) AS o12,
            count(*) FILTER (x.allele = a1 AND y.allele = n.major) AS o21, o22, count(*) AS reads
          FROM lh h JOIN lpile x ON x.pos = p1 JOIN lpile y ON y.read_id = x.read_id AND y.pos = p2 JOIN lc m ON m.pos = p1 JOIN lc n ON n.pos = p2 WHERE x.allele <> 'N' AND y.allele <> 'N' GROUP BY h.p1, h.a1, h.p2, h.a2, o22),
        lr AS (SELECT *, o12*o21 / (o11*reads)::DOUBLE AS p, o22 / nullif(0.1*o11 + 0.9*(o12+o21), 0)::DOUBLE AS ratio FROM lt WHERE o22 / reads > 0.02),
        ls AS (SELECT p1, a1, p2, a2, sum(exp(n.f - k.f - r.f + k.k*ln(p) + (reads-k.k)*ln(1-p))) AS tail FROM lr JOIN lf n ON n.k = reads JOIN lf k ON k.k > o22 AND k.k <= reads JOIN lf r ON r.k = reads - k.k WHERE p > 0 AND p < 1 GROUP BY ALL)
        SELECT p1, a1, p2, a2, o11, o12, o21, o22, reads FROM lr LEFT JOIN ls USING (p1, a1, p2, a2) WHERE p <= 1 AND (p < 1e-12 OR coalesce(tail, 0) < 1e-7 / (120*119/2) OR coalesce(ratio > 0.1, true))""",
    "heaviest_clusters": "SELECT CAST(clique_id AS INT) AS clique_id, count(*) AS reads, round(sum(1.0::DOUBLE / k), 6) AS weight FROM assigned GROUP BY clique_id HAVING count(*) > 10 ORDER BY sum(1.0::DOUBLE / k) DESC, clique_id LIMIT 3",
    "cluster_haplotypes": _CLUSTERS + """
        SELECT CAST(clique_id AS INT) AS clique_id, string_agg(allele, '' ORDER BY pos) AS haplotype, coalesce(string_agg(pos || ':' || allele, ',' ORDER BY pos) FILTER (allele <> major), '') AS snps FROM g GROUP BY clique_id""",
    "source_cliques": """, hit AS (SELECT t.haplotype, m.clique_id, count(*) AS hits FROM truth t JOIN pm m ON m.pos = t.pos AND m.allele = t.allele GROUP BY ALL),
        sz AS (SELECT i.clique_id, count(pm.pos) AS size FROM ids i LEFT JOIN pm ON pm.clique_id = i.clique_id GROUP BY i.clique_id),
        whole AS (SELECT haplotype, arg_min(clique_id, (-size, clique_id)) AS clique_id FROM hit JOIN sz USING (clique_id) WHERE hits = size GROUP BY haplotype)
        SELECT CAST(h.haplotype AS INT) AS hap_id, CAST(coalesce(clique_id, (SELECT min(clique_id) FROM sz WHERE size = 0)) AS INT) AS clique_id FROM (SELECT DISTINCT haplotype FROM truth) h LEFT JOIN whole ON whole.haplotype = h.haplotype""",
    "truth_mismatches": """, tv AS (SELECT clique_id, printf('%010d%s', pos, allele) AS v FROM pm),
        hit AS (SELECT tv.clique_id AS t, m.clique_id AS c, count(*) AS hits FROM tv JOIN member m ON m.v = tv.v GROUP BY ALL),
        best AS (SELECT t, max(hits) AS hits FROM hit GROUP BY t)
        SELECT CAST(z.clique_id AS INT) AS truth, z.size - coalesce(hits, 0) AS missing FROM (SELECT clique_id, count(*) AS size FROM tv GROUP BY clique_id) z LEFT JOIN best ON t = z.clique_id""",
    "clique_mismatches": """, tv AS (SELECT clique_id, printf('%010d%s', pos, allele) AS v FROM pm),
        hit AS (SELECT m.clique_id AS c, tv.clique_id AS t, count(*) AS hits FROM member m JOIN tv ON tv.v = m.v GROUP BY ALL),
        best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY c ORDER BY hits DESC, t) = 1),
        z AS (SELECT clique_id, count(*) AS size FROM member GROUP BY clique_id)
        SELECT z.clique_id, CAST(z.size AS INT) AS size, CAST(t AS INT) AS truth, CAST(z.size - coalesce(hits, 0) AS INT) AS mismatches FROM z LEFT JOIN best ON c = z.clique_id""",
    "missed_edges": """, tv AS (SELECT clique_id, pos, allele, printf('%010d%s', pos, allele) AS v FROM pm)
        SELECT DISTINCT a.v AS u, b.v AS v FROM tv a JOIN tv b ON a.clique_id = b.clique_id AND a.v < b.v
        WHERE b.pos - a.pos <= 120 AND NOT (a.allele = '-' AND b.allele = '-') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.u = a.v AND e.v = b.v)""",
    "no_edge_pairs": f"{_UNLINKED} {_APART}",
    "non_edges": """, vx AS (SELECT DISTINCT p1 AS pos, a1 AS allele FROM edges UNION SELECT p2, a2 FROM edges),
        pr AS (SELECT x.pos AS p1, x.allele AS a1, y.pos AS p2, y.allele AS a2 FROM vx x JOIN vx y ON x.pos < y.pos),
        tb AS (SELECT pr.*, count(*) AS reads, count(*) FILTER (x.allele = m.major AND y.allele = n.major) AS o11, count(*) FILTER (x.allele = a1 AND y.allele = a2) AS o22
          FROM pr JOIN pile x ON x.pos = p1 JOIN pile y ON y.read_id = x.read_id AND y.pos = p2 JOIN cons m ON m.pos = p1 JOIN cons n ON n.pos = p2 WHERE x.allele <> 'N' AND y.allele <> 'N' GROUP BY p1, a1, p2, a2),
        sw AS (SELECT *, CASE WHEN o11 = 0 THEN o11 ELSE o22 END AS z FROM tb WHERE reads >= 50),
        lo AS (SELECT p1, a1, p2, a2, reads, z, sum(exp(n.f - k.f - r.f + k.k*ln(0.02) + (reads-k.k)*ln(0.98))) AS cdf FROM sw JOIN lf n ON n.k = reads JOIN lf k ON k.k <= z JOIN lf r ON r.k = reads - k.k GROUP BY ALL)
        SELECT p1, a1, p2, a2, reads, z AS o22 FROM lo WHERE cdf < 1e-4""",
}

_SELECTS["minor_hits_bitmap"] = _SELECTS["minor_hits"]
_SELECTS["minor_reads_bitmap"] = "SELECT pos, allele, count(*) AS n, min(read_id) AS first_read, max(read_id) AS last_read FROM minors GROUP BY pos, allele"
_SELECTS["pair_frequencies"] = """, h AS (SELECT t, o, ([[0.99::DOUBLE, 0.01], [0.01, 0.99]])[t // 2 + 1][o // 2 + 1] * ([[0.99::DOUBLE, 0.01], [0.01, 0.99]])[t % 2 + 1][o % 2 + 1] AS c FROM (SELECT range AS t FROM range(4)), (SELECT range AS o FROM range(4))),
    em AS (
      SELECT p1, a1, p2, a2, [o11, o12, o21, o22] AS n, 0 AS rounds, [0.25::DOUBLE, 0.25, 0.25, 0.25] AS f, 1.0::DOUBLE AS change FROM link
      UNION ALL
      SELECT p1, a1, p2, a2, n, rounds + 1, g, sqrt((g[1]-f[1])**2 + (g[2]-f[2])**2 + (g[3]-f[3])**2 + (g[4]-f[4])**2) FROM (
        SELECT *, list_transform(m, lambda x: x / list_sum(m)) AS g FROM (
          SELECT em.*, list_transform([1, 2, 3, 4], lambda t: f[t] * list_sum(list_transform([1, 2, 3, 4], lambda o: coalesce(n[o] * c[t][o] / nullif(f[1]*c[1][o] + f[2]*c[2][o] + f[3]*c[3][o] + f[4]*c[4][o], 0), 0)))) AS m
          FROM em, (SELECT list(row_ ORDER BY t) AS c FROM (SELECT t, list(c ORDER BY o) AS row_ FROM h GROUP BY t)) k
          WHERE change > 0.001 AND rounds < 100)))
    SELECT p1, a1, p2, a2, round(f[1], 6) AS f11, round(f[2], 6) AS f12, round(f[3], 6) AS f21, round(f[4], 6) AS f22, CAST(rounds AS INT) AS rounds
    FROM em QUALIFY row_number() OVER (PARTITION BY p1, a1, p2, a2 ORDER BY rounds DESC) = 1"""
_SELECTS["near_duplicate_merge"] = """, c AS (SELECT ck % 20 AS g, pos, allele, count(*) AS n FROM pile2 WHERE allele <> 'N' GROUP BY ALL),
    s AS (SELECT g, string_agg(major, '' ORDER BY pos) AS text FROM (SELECT g, pos, arg_min(allele, (-n, strpos('ACGT-N', allele))) AS major FROM c GROUP BY g, pos) GROUP BY g),
    q AS (SELECT text, n / (SELECT count(*) FROM o) AS freq FROM s JOIN (SELECT ck % 20 AS g, count(*) AS n FROM o GROUP BY 1) USING (g)),
    u AS (SELECT text, sum(freq) AS freq, row_number() OVER (ORDER BY max(freq) DESC, text) AS i FROM q GROUP BY text),
    fold AS (
      SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept
      UNION ALL
      SELECT u.i, CASE WHEN len(list_filter(kept, lambda k: CASE WHEN length(k) = length(text) THEN hamming(k, text) <= 1 ELSE false END)) = 0 THEN list_append(kept, text) ELSE kept END
      FROM fold JOIN u ON u.i = fold.i + 1),
    ends AS (SELECT u.freq, list_filter(kept, lambda k: CASE WHEN length(k) = length(text) THEN hamming(k, text) <= 1 ELSE false END)[1] AS haplotype FROM u JOIN fold USING (i))
    SELECT haplotype, round(sum(freq), 9) AS frequency FROM ends GROUP BY haplotype"""
_SELECTS["graph_metrics"] = f"""{_UNLINKED}, apart AS ({_APART}),
    figures AS (
      SELECT 'graph' AS part, 'vertices' AS figure, count(*) AS value FROM nodes
      UNION ALL SELECT 'graph', 'ends', count(*) FROM ways
      UNION ALL SELECT 'graph', 'most_neighbours', max(n) FROM (SELECT count(*) AS n FROM ways GROUP BY u)
      UNION ALL SELECT 'cliques', 'cliques', count(*) FROM cliques
      UNION ALL SELECT 'cliques', 'vertices', count(*) FROM member
      UNION ALL SELECT 'cliques', 'largest', max(len(vs)) FROM cliques
      UNION ALL SELECT 'no_edges', 'pairs', count(*) FROM apart)
    SELECT part, figure, value FROM figures"""
_SELECTS["transitive_graph"] = """, reach AS (SELECT u AS a, u AS b FROM nodes UNION SELECT reach.a, w.v FROM reach JOIN ways w ON w.u = reach.b),
    vx AS (SELECT DISTINCT u, CAST(substr(u, 1, 10) AS INT) AS pos, substr(u, 11) AS allele FROM nodes),
    pr AS (SELECT x.u, y.u AS v, x.pos AS p1, x.allele AS a1, y.pos AS p2, y.allele AS a2 FROM reach JOIN vx x ON x.u = a JOIN vx y ON y.u = b WHERE x.pos < y.pos),
    tb AS (SELECT p1, a1, p2, a2, count(*) AS reads, count(*) FILTER (x.allele = m.major AND y.allele = n.major) AS o11, count(*) FILTER (x.allele = m.major AND y.allele = a2) AS o12,
        count(*) FILTER (x.allele = a1 AND y.allele = n.major) AS o21, count(*) FILTER (x.allele = a1 AND y.allele = a2) AS o22
      FROM pr JOIN pile x ON x.pos = p1 JOIN pile y ON y.read_id = x.read_id AND y.pos = p2 JOIN cons m ON m.pos = p1 JOIN cons n ON n.pos = p2 WHERE x.allele <> 'N' AND y.allele <> 'N' GROUP BY p1, a1, p2, a2),
    sw AS (SELECT *, CASE WHEN o11 = 0 THEN o22 ELSE o11 END AS x11, CASE WHEN o11 = 0 THEN o11 ELSE o22 END AS x22 FROM tb),
    ch AS (SELECT *, CASE WHEN x11 = 0 OR reads = 0 THEN CASE WHEN o12*o21 = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE o12*o21 / (x11*reads)::DOUBLE END AS pp, coalesce(x22 / nullif(0.2*x11 + 0.8*(o12+o21), 0)::DOUBLE, 'inf'::DOUBLE) AS ra FROM sw),
    ta AS (SELECT p1, a1, p2, a2, sum(exp(n.f - k.f - r.f + k.k*ln(pp) + (reads-k.k)*ln(1-pp))) AS tl FROM ch JOIN lf n ON n.k = reads JOIN lf k ON k.k > x22 AND k.k <= reads JOIN lf r ON r.k = reads - k.k WHERE pp > 1e-12 AND pp < 1 AND ra <= 0.2 AND reads >= 50 GROUP BY ALL),
    pv AS (SELECT pr.u, pr.v, CASE WHEN ch.reads IS NULL OR ch.reads < 50 THEN 0 WHEN pp > 1 THEN 1 WHEN ra > 0.2 THEN 0 WHEN pp < 1e-12 THEN 0 ELSE coalesce(tl, 0) END AS p FROM pr LEFT JOIN ch USING (p1, a1, p2, a2) LEFT JOIN ta USING (p1, a1, p2, a2)),
    gone AS (SELECT u, v FROM pv WHERE p > 0.01),
    bo AS (SELECT u AS f, v AS s FROM gone UNION SELECT v, u FROM gone),
    beside AS (SELECT least(f, w.v) AS u, greatest(f, w.v) AS v FROM bo JOIN ways w ON w.u = s),
    between_ AS (SELECT least(x.v, y.v) AS u, greatest(x.v, y.v) AS v FROM bo JOIN ways x ON x.u = f JOIN ways y ON y.u = s),
    own AS (SELECT least(u, v) AS u, greatest(u, v) AS v FROM edges)
    SELECT u, v FROM pv WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.u = pv.u AND g.v = pv.v)
      AND (p <= 1e-6 OR EXISTS (SELECT 1 FROM own e WHERE e.u = pv.u AND e.v = pv.v) OR NOT EXISTS (SELECT 1 FROM beside b WHERE b.u = pv.u AND b.v = pv.v))
      AND (p <= 5e-5 OR EXISTS (SELECT 1 FROM own e WHERE e.u = pv.u AND e.v = pv.v) OR NOT EXISTS (SELECT 1 FROM between_ b WHERE b.u = pv.u AND b.v = pv.v))"""

_SELECTS["merged_cliques"] = f"""{_UNLINKED}, apart AS ({_APART}),
    pair AS (SELECT a.clique_id AS c1, b.clique_id AS c2, a.v AS x, b.v AS y, a.pos AS px, b.pos AS py FROM member a JOIN member b ON a.clique_id < b.clique_id),
    scored AS (SELECT c1, c2 FROM pair GROUP BY c1, c2
      HAVING count(*) FILTER (px = py AND x <> y) = 0 AND count(*) FILTER (x = y OR EXISTS (SELECT 1 FROM ways w WHERE w.u = x AND w.v = y)) > 0),
    beside AS (SELECT c1 AS x, c2 AS y FROM scored UNION SELECT c2, c1 FROM scored),
    alike AS (SELECT clique_id AS a, clique_id AS b FROM cliques UNION SELECT alike.a, beside.y FROM alike JOIN beside ON beside.x = alike.b),
    joined AS (SELECT a AS x, b AS y FROM alike WHERE a <> b AND NOT EXISTS (SELECT 1 FROM apart WHERE c1 = least(a, b) AND c2 = greatest(a, b))),
    larger AS (
      SELECT [clique_id] AS cs FROM cliques
      UNION ALL
      SELECT list_append(cs, j.y) FROM larger JOIN joined j ON j.x = cs[1]
      WHERE j.y > cs[-1] AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(cs) AS c) t WHERE NOT EXISTS (SELECT 1 FROM joined q WHERE q.x = t.c AND q.y = j.y))),
    whole AS (
      SELECT cs FROM larger WHERE NOT EXISTS (
        SELECT 1 FROM cliques k WHERE NOT list_contains(cs, k.clique_id)
        AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(cs) AS c) t WHERE NOT EXISTS (SELECT 1 FROM joined q WHERE q.x = t.c AND q.y = k.clique_id)))),
    unions AS (SELECT DISTINCT vs FROM (SELECT cs, list(DISTINCT v ORDER BY v) AS vs FROM (SELECT cs, unnest(cs) AS c FROM whole) JOIN member ON clique_id = c GROUP BY cs))
    SELECT array_to_string(vs, ',') AS vs FROM unions x WHERE NOT EXISTS (SELECT 1 FROM unions y WHERE len(y.vs) > len(x.vs) AND list_has_all(y.vs, x.vs))"""
_SELECTS["em_frequencies"] = """, patterns AS (SELECT list(struct_pack(h := h, n := n)) AS p FROM (SELECT h, count(*) AS n FROM (SELECT read_id, list(h ORDER BY hap_id) AS h FROM likely GROUP BY read_id) GROUP BY h)),
    em AS (
      SELECT 0 AS i, [0.25::DOUBLE, 0.25, 0.25, 0.25] AS f, 1.0::DOUBLE AS change
      UNION ALL
      SELECT i + 1, g, sqrt((g[1]-f[1])**2 + (g[2]-f[2])**2 + (g[3]-f[3])**2 + (g[4]-f[4])**2) FROM (
        SELECT *, list_transform(m, lambda x: x / list_sum(m)) AS g FROM (
          SELECT em.*, list_transform([1, 2, 3, 4], lambda j: list_sum(list_transform(p, lambda r: coalesce(r.n * f[j] * r.h[j] / nullif(f[1]*r.h[1] + f[2]*r.h[2] + f[3]*r.h[3] + f[4]*r.h[4], 0), 0)))) AS m
          FROM em, patterns WHERE change > 0.001)))
    SELECT CAST(j - 1 AS INT) AS hap_id, round(f[j], 6) AS frequency FROM (SELECT f FROM em ORDER BY i DESC LIMIT 1), (SELECT unnest([1, 2, 3, 4]) AS j)"""
_GROUPS = """c AS (SELECT ck % 20 AS g, pos, allele, count(*) AS n FROM pile2 WHERE allele <> 'N' GROUP BY ALL),
    s AS (SELECT g, string_agg(major, '' ORDER BY pos) AS text FROM (SELECT g, pos, arg_min(allele, (-n, strpos('ACGT-N', allele))) AS major FROM c GROUP BY g, pos) GROUP BY g)"""
_SELECTS |= {
    "haplotype_fasta": """, f AS (SELECT h, count(*) AS n FROM (SELECT CASE WHEN ck % 20 < 10 THEN 0 WHEN ck % 20 < 15 THEN 1 WHEN ck % 20 < 18 THEN 2 ELSE 3 END AS h FROM o) GROUP BY h)
        SELECT printf('>sample_%d_%.3f', h, n / (SELECT count(*) FROM o)) || chr(10) || string_agg(allele, '' ORDER BY pos) || chr(10) AS value FROM f JOIN truth ON haplotype = h WHERE pos >= 10 AND pos < 60 GROUP BY h, n""",
    "equal_haplotypes": f", {_GROUPS} SELECT text AS haplotype, min(g) AS hap_id, string_agg(g::VARCHAR, ',' ORDER BY g) AS groups FROM s GROUP BY text",
    "read_assignment_long": """, lc AS (SELECT pos, arg_min(allele, (-n, strpos('ACGT-N', allele))) AS major FROM (SELECT pos, allele, count(*) AS n FROM lpile WHERE allele <> 'N' GROUP BY ALL) GROUP BY pos),
        lpm AS (SELECT haplotype AS clique_id, pos, allele FROM truth JOIN lc USING (pos) WHERE allele <> major),
        lst AS (SELECT i.clique_id, c.pos, coalesce(p.allele, major) AS allele, p.allele IS NOT NULL AS is_snp FROM ids i CROSS JOIN (SELECT pos, major FROM lc WHERE pos IN (SELECT pos FROM lpm)) c LEFT JOIN lpm p ON p.clique_id = i.clique_id AND p.pos = c.pos),
        lb AS (SELECT clique_id, NOT bool_or(is_snp) AS bare FROM lst GROUP BY clique_id),
        ld AS (SELECT read_id, clique_id, count(*) FILTER (p.allele <> s.allele) AS d, count(*) FILTER (is_snp OR bare) AS coincidences FROM lpile p JOIN lst s USING (pos) JOIN lb USING (clique_id) WHERE p.allele <> 'N' GROUP BY read_id, clique_id),
        ln_ AS (SELECT *, min(d) OVER (PARTITION BY read_id) AS least FROM ld WHERE coincidences > 0 AND coincidences <> d)
        SELECT read_id, CAST(clique_id AS INT) AS clique_id, count(*) OVER (PARTITION BY read_id) AS k FROM ln_ WHERE d = least""",
    "read_likelihood_long": """, m AS (SELECT read_id, haplotype, count(*) FILTER (p.allele <> t.allele AND p.allele <> 'N') AS misses FROM lpile p JOIN truth t USING (pos) GROUP BY ALL)
        SELECT read_id, CAST(haplotype AS INT) AS hap_id, misses, 120::BIGINT AS size, round(pow(0.99, 120 - misses) * pow(0.01/3, misses), 9) AS h FROM m""",
    "window_edges": """, kn AS (SELECT clique_id AS hap, printf('%010d%s', pos, allele) AS v FROM pm WHERE clique_id IN (1, 3)),
        e AS (SELECT u, v, p1 BETWEEN 30 AND 62 AS in1, p2 BETWEEN 30 AND 62 AS in2, EXISTS (SELECT 1 FROM kn WHERE kn.v = edges.u) AS k1, EXISTS (SELECT 1 FROM kn WHERE kn.v = edges.v) AS k2,
          EXISTS (SELECT 1 FROM kn a JOIN kn b ON a.hap = b.hap WHERE a.v = edges.u AND b.v = edges.v) AS one FROM edges)
        SELECT u, v FROM e WHERE (in1 AND in2) OR one OR (k1 AND in2) OR (k2 AND in1)""",
    "masked_haplotypes": _CLUSTERS + """,
        own_ AS (SELECT clique_id, pos, allele, count(*) AS n FROM pile JOIN assigned USING (read_id) GROUP BY ALL),
        dp AS (SELECT clique_id, pos, sum(n) AS depth FROM own_ GROUP BY ALL),
        mk AS (SELECT g.clique_id, g.pos, CASE WHEN coalesce(depth, 0) < 200 OR (g.clique_id NOT IN (SELECT clique_id FROM pm) AND coalesce(n, 0) < 4000) THEN major ELSE g.allele END AS allele
          FROM g LEFT JOIN dp ON dp.clique_id = g.clique_id AND dp.pos = g.pos LEFT JOIN own_ o_ ON o_.clique_id = g.clique_id AND o_.pos = g.pos AND o_.allele = g.allele)
        SELECT CAST(clique_id AS INT) AS clique_id, string_agg(allele, '' ORDER BY pos) AS haplotype FROM mk GROUP BY clique_id""",
    "default_haplotype": "SELECT string_agg(major, '' ORDER BY pos) AS haplotype, 1.0::DOUBLE AS frequency FROM cons",
    "read_names": "SELECT DISTINCT CAST(clique_id AS INT) AS rank, 'r' || read_id AS name FROM assigned",
    "exploded_coverage": "SELECT pos, allele, n FROM counts",
    "closure_edges": "SELECT DISTINCT a.v AS u, b.v AS v FROM member a JOIN member b ON a.clique_id = b.clique_id AND a.v < b.v",
    "clique_slices": "SELECT clique_id, array_to_string(list_filter(vs, lambda v: CAST(substr(v, 1, 10) AS INT) BETWEEN 30 AND 60), ',') AS vs FROM cliques",
    "deletion_islands": """, g AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS run FROM pile WHERE allele = '-')
        SELECT read_id, CAST(min(pos) AS INT) AS s, CAST(max(pos) AS INT) AS e FROM g GROUP BY read_id, run""",
    "profile_columns": """, r AS (SELECT i, substr('ACGT-', CAST(i+1 AS INT), 1) AS allele FROM (SELECT range AS i FROM range(5)))
        SELECT p.pos, string_agg(coalesce(n, 0)::VARCHAR, chr(9) ORDER BY i) AS line FROM r CROSS JOIN (SELECT DISTINCT pos FROM counts) p LEFT JOIN counts c ON c.pos = p.pos AND c.allele = r.allele GROUP BY p.pos""",
}

_PLAIN = {
    "floor_seek": """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM (SELECT DISTINCT o_custkey * 13 AS value FROM orders))
        SELECT l_orderkey, l_linenumber, v.value AS floor, coalesce(i, 0) AS place FROM lineitem ASOF LEFT JOIN v ON l_orderkey >= v.value""",
    "letter_digits": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN substr('ACGT-', CAST(o_orderkey % 7 + 1 AS INT), 1) ELSE 'N' END AS letter FROM orders",
    "cigar_projection": """WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS k, substr(repeat('ACGTTGCATTAGC', 6), CAST(1 + l_partkey % 13 AS INT), 60) AS seq FROM lineitem),
        n AS (SELECT *, CAST(k % 4 AS INT) AS a, CAST(10 + k % 7 AS INT) AS b, CAST(1 + k % 3 AS INT) AS c, 12 AS d, CAST(1 + k % 5 AS INT) AS e FROM t)
        SELECT l_orderkey, l_linenumber, repeat('-', a) || substr(seq, a+1, b) || substr(seq, a+b+c+1, d) || repeat('-', e) || substr(seq, a+b+c+d+1, 60-a-b-c-d) AS projected FROM n""",
    "interval_parse": """WITH t AS (SELECT o_orderkey AS k, 100 + o_orderkey % 977 AS s, 2000 + o_orderkey AS e, 1 + o_orderkey % 300 AS x FROM orders)
        SELECT k AS o_orderkey, 'chr' || (k % 22) AS contig,
          CAST(greatest(0, CASE k % 3 WHEN 0 THEN s WHEN 1 THEN s - x ELSE s - x END) AS INT) AS "start", CAST(CASE k % 3 WHEN 0 THEN e WHEN 1 THEN s + x ELSE e + x END AS INT) AS "end" FROM t""",
    "quantity_parse": """SELECT o_orderkey, CASE WHEN v <= 2147483647 THEN CAST(v AS BIGINT) END AS value FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_orderkey * [1, 1000, 1000000, 1, 1, 1000, 1000000][CAST(o_orderkey % 8 + 1 AS INT)] END AS v FROM orders)""",
    "contig_alias": """SELECT name, contig, count(*) AS n FROM (SELECT ['chr1', '1', 'CHR1', 'chr2', '2', 'chrM', 'MT', 'chrX', 'x', 'y9'][CAST(o_custkey % 10 + 1 AS INT)] AS name,
        ['chr1', 'chr1', 'chr1', '2', '2', 'MT', 'MT', 'chrX', NULL, NULL][CAST(o_custkey % 10 + 1 AS INT)] AS contig FROM orders) GROUP BY name, contig""",
    "smart_double": f"SELECT o_orderkey, {_SMART} AS text FROM (SELECT o_orderkey, o_totalprice / pow(10, o_orderkey % 14) AS x FROM orders)",
    "si_format": """SELECT o_orderkey, CASE WHEN v >= 1000000000000 THEN printf('%.1fT', floor(v / 100000000000) / 10) WHEN v >= 1000000000 THEN printf('%.1fG', floor(v / 100000000) / 10) WHEN v >= 1000000 THEN printf('%.1fM', floor(v / 100000) / 10) WHEN v >= 1000 THEN printf('%.1fk', floor(v / 100) / 10) ELSE v::VARCHAR END AS text
        FROM (SELECT o_orderkey, CAST(o_orderkey * [1, 37, 4001, 500009, 70000027][CAST(o_orderkey % 5 + 1 AS INT)] AS BIGINT) AS v FROM orders)""",
}


def _needed(select: str) -> str:
    """BASE with only the tables that a query reads, directly or through others."""
    head, body = BASE.split(" ", 2)[:2], BASE.split(" ", 2)[2]
    tables = dict(re.findall(r"^(\w+) AS (\(.*?\))(?:,(?=\n\w+ AS \()|\Z)", body.strip(), re.DOTALL | re.MULTILINE))
    wanted: list[str] = []
    open_ = [select]
    while open_:
        text = open_.pop()
        for name in tables:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.append(name)
                open_.append(tables[name])
    listed = ",\n".join(f"{name} AS {tables[name]}" for name in tables if name in wanted)
    return f"{' '.join(head)} {listed}\n{select}"


def oracle_sql() -> dict[str, str]:
    return {name: _needed(select) for name, select in _SELECTS.items()} | _PLAIN
