"""The SQL that the clustering queries are held against: merges, cuts, metrics and ranking by recursion over rows.

The active pairs of all groups and linkages are the recursion's state. Each round drops the pairs of the least (distance,
idx1, idx2) and adds those of the cluster it makes. Sums run in the order of the dimensions, so that ties fall alike.
"""

_DOT = "list_reduce(list_transform(list_zip({0}, {1}), lambda t: t[1] * t[2]), lambda s, x: s + x)"

#: unit vectors with their place in the group; distances of pairs; the groups' sizes
_BASE = f"""
 raw AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
 unit AS (SELECT id, label, list_transform(e, lambda x: x / n) AS vec FROM (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x)) AS n FROM raw)),
 obs AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS o, vec FROM unit),
 size AS (SELECT label, count(*) AS n FROM obs GROUP BY label),
 dist AS (SELECT x.label, x.o AS i, y.o AS j, 1 - greatest(-1, least(1, {_DOT.format('x.vec', 'y.vec')})) AS d FROM obs x JOIN obs y ON x.label = y.label AND x.o < y.o),
 kinds AS (SELECT unnest(['single', 'complete', 'average', 'ward']) AS linkage),
 pairs AS (
  SELECT label, linkage, n, 0 AS step, i, j, d * CASE linkage WHEN 'ward' THEN 2 ELSE 1 END AS d, 1::DOUBLE AS ni, 1::DOUBLE AS nj FROM dist JOIN size USING (label), kinds
  UNION ALL
  (WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, linkage ORDER BY d, i, j) AS r FROM pairs) WHERE r = 1),
   rest AS (SELECT p.*, b.i AS a, b.j AS b, b.d AS dab, b.ni AS na, b.nj AS nb FROM pairs p JOIN best b ON p.label = b.label AND p.linkage = b.linkage WHERE NOT (p.i = b.i AND p.j = b.j)),
   ends AS (SELECT label, linkage, n, step, a, b, dab, na, nb, CASE WHEN i IN (a, b) THEN j ELSE i END AS k, CASE WHEN i IN (a, b) THEN nj ELSE ni END AS nk,
     max(d) FILTER (a IN (i, j)) AS da, max(d) FILTER (b IN (i, j)) AS db FROM rest WHERE i IN (a, b) OR j IN (a, b) GROUP BY ALL)
   SELECT label, linkage, n, step + 1, i, j, d, ni, nj FROM rest WHERE i NOT IN (a, b) AND j NOT IN (a, b)
   UNION ALL
   SELECT label, linkage, n, step + 1, k, n + step, CASE linkage WHEN 'single' THEN 0.5 * da + 0.5 * db + -0.5 * abs(da - db) WHEN 'complete' THEN 0.5 * da + 0.5 * db + 0.5 * abs(da - db)
     WHEN 'average' THEN na / (na + nb) * da + nb / (na + nb) * db ELSE (na + nk) / (na + nb + nk) * da + (nb + nk) / (na + nb + nk) * db - nk / (na + nb + nk) * dab END, nk, na + nb FROM ends)),
 merges AS MATERIALIZED (SELECT label, linkage, n, step, i AS idx1, j AS idx2, d AS merge_distance, (ni + nj)::INT AS size FROM (SELECT *, row_number() OVER (PARTITION BY label, linkage, step ORDER BY d, i, j) AS r FROM pairs) WHERE r = 1)"""

LINKAGE = f"WITH RECURSIVE {_BASE} SELECT label, linkage, step::INT AS step, idx1::INT AS idx1, idx2::INT AS idx2, round(merge_distance, 6) AS merge_distance, size FROM merges"

#: every leaf's clusters from itself to the root; paths from the root; cuts; metrics
_EVALUATION = f"""{_BASE},
 ups AS (
  SELECT label, kinds.linkage, n, o, o AS node FROM obs JOIN size USING (label), kinds
  UNION ALL
  SELECT u.label, u.linkage, u.n, u.o, m.n + m.step FROM ups u JOIN merges m ON m.label = u.label AND m.linkage = u.linkage AND u.node IN (m.idx1, m.idx2)),
 tops AS MATERIALIZED (SELECT * FROM ups),
 downs AS (
  SELECT label, linkage, n, 2 * n - 2 AS node, '' AS path FROM size, kinds
  UNION ALL
  SELECT d.label, d.linkage, d.n, unnest([m.idx1, m.idx2]), unnest([path || '0', path || '1']) FROM downs d JOIN merges m ON m.label = d.label AND m.linkage = d.linkage AND d.node = m.n + m.step),
 leaves AS (SELECT label, linkage, string_agg(node, ' ' ORDER BY path) AS leaf_order FROM downs WHERE node < n GROUP BY ALL),
 ks AS (SELECT unnest([2, 3, 4, 5]) AS k),
 cuts AS (SELECT label, linkage, k, n, o, max(node) AS cluster FROM tops, ks WHERE k <= n - 1 AND node < 2 * n - k GROUP BY ALL),
 firsts AS (SELECT *, min(o) OVER (PARTITION BY label, linkage, k, cluster) AS first FROM cuts),
 cut AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY label, linkage, k ORDER BY first) - 1 AS c FROM firsts),
 labels AS (SELECT label, linkage, k, string_agg(c, ' ' ORDER BY o) AS labels FROM cut GROUP BY ALL),
 joined AS (SELECT x.label, x.linkage, x.o AS i, y.o AS j, min(x.node) AS node FROM tops x JOIN tops y ON x.label = y.label AND x.linkage = y.linkage AND x.node = y.node AND x.o < y.o GROUP BY ALL),
 coph AS (SELECT label, linkage, corr(d, merge_distance) AS cophenetic FROM joined JOIN dist USING (label, i, j) JOIN merges m USING (label, linkage) WHERE m.n + m.step = node GROUP BY ALL),
 sided AS (SELECT label, i, j, d FROM dist UNION ALL SELECT label, j, i, d FROM dist),
 means AS (SELECT x.label, x.linkage, x.k, x.o, x.c, y.c AS other, avg(d) AS m FROM cut x JOIN sided b ON b.label = x.label AND b.i = x.o JOIN cut y ON y.label = x.label AND y.linkage = x.linkage AND y.k = x.k AND y.o = b.j GROUP BY ALL),
 sides AS (SELECT label, linkage, k, o, max(m) FILTER (other = c) AS a, min(m) FILTER (other <> c) AS b FROM means GROUP BY ALL),
 sil AS (SELECT label, linkage, k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sides GROUP BY ALL),
 coords AS (SELECT label, linkage, k, c, pos, avg(x) AS x FROM (SELECT label, linkage, k, c, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM cut JOIN obs USING (label, o)) GROUP BY ALL),
 mids AS (SELECT label, linkage, k, c, list(x ORDER BY pos) AS mid FROM coords GROUP BY ALL),
 spreads AS (SELECT label, linkage, k, c, mid, avg(list_distance(vec, mid)) AS s FROM cut JOIN obs USING (label, o) JOIN mids USING (label, linkage, k, c) GROUP BY ALL),
 ratios AS (SELECT x.label, x.linkage, x.k, x.c, max((x.s + y.s) / nullif(list_distance(x.mid, y.mid), 0)) AS r, min(list_distance(x.mid, y.mid)) AS least FROM spreads x JOIN spreads y ON x.label = y.label AND x.linkage = y.linkage AND x.k = y.k AND x.c <> y.c GROUP BY ALL),
 db AS (SELECT label, linkage, k, CASE WHEN min(least) > 0 THEN avg(r) END AS davies_bouldin FROM ratios GROUP BY ALL),
 evaluation AS (SELECT * FROM coph JOIN sil USING (label, linkage) JOIN db USING (label, linkage, k) JOIN leaves USING (label, linkage) JOIN labels USING (label, linkage, k))"""

EVALUATION = f"""WITH RECURSIVE {_EVALUATION}
 SELECT label, linkage, k::INT AS k, round(cophenetic, 6) AS cophenetic, round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin, leaf_order, labels FROM evaluation"""

RANKING = f"""WITH RECURSIVE {_EVALUATION},
 e AS (SELECT label, linkage, cophenetic, silhouette, davies_bouldin, max(cophenetic) OVER (PARTITION BY label) - cophenetic <= 1e-3 AS tied, list_position(['single', 'complete', 'average', 'ward'], linkage) AS place FROM evaluation WHERE k = 3)
 SELECT label, linkage, round(cophenetic, 6) AS cophenetic, round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin, tied,
  row_number() OVER (PARTITION BY label ORDER BY tied DESC, silhouette DESC, coalesce(davies_bouldin, 'inf'::DOUBLE), place) = 1 AS leader, row_number() OVER (PARTITION BY label ORDER BY silhouette DESC, place) = 1 AS silhouette_leader FROM e"""
