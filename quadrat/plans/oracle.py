"""DuckDB SQL for the named queries, written independently of the operators.

Richness uses log-gamma here and a product in the operators.
"""

from __future__ import annotations

REC = r"""rec AS (
  SELECT o_orderkey AS id, lower(r_name) AS continent, n_name AS cnt, o_custkey AS cust, concat(n_nationkey, '-', c_mktsegment) AS site,
    CASE WHEN o_orderkey % 53 <> 0 THEN ((o_custkey * 37) % 1400) / 10e0 - 60 + (o_orderkey % 10) / 100e0 END AS lat,
    ((o_custkey * 91) % 3600) / 10e0 - 180 + (o_orderkey % 7) / 100e0 AS lon,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, coalesce(names, []) AS names,
    idx_quantity, idx_price, idx_discount, idx_tax, o_totalprice AS idx_total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (
    SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS names, avg(l_quantity) AS idx_quantity, avg(l_extendedprice) AS idx_price,
      avg(l_discount) AS idx_discount, avg(l_tax) AS idx_tax
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
  ) ON l_orderkey = o_orderkey
)"""
CELL = (
    REC
    + r""", g AS (SELECT *, floor(lat * 10) / 10 AS lat_cell, floor(lon * 10) / 10 AS lon_cell FROM rec WHERE lat IS NOT NULL),
main AS (SELECT lat_cell, lon_cell, max(continent) AS continent, count(*) AS n_rec, avg(idx_quantity) AS mean_idx_quantity, avg(idx_price) AS mean_idx_price,
  avg(idx_discount) AS mean_idx_discount, avg(idx_tax) AS mean_idx_tax, avg(idx_total) AS mean_idx_total FROM g GROUP BY 1, 2),
inc AS (SELECT lat_cell, lon_cell, s, count(*) AS c FROM (SELECT lat_cell, lon_cell, unnest(names) AS s FROM g) GROUP BY 1, 2, 3),
per AS (SELECT lat_cell, lon_cell, count(*) AS s_obs, sum(CASE WHEN n_rec < 10 THEN NULL WHEN n_rec - c < 10 THEN 1e0 ELSE
  1 - exp(lgamma(n_rec - c + 1) - lgamma(n_rec - c - 9) - lgamma(n_rec + 1) + lgamma(n_rec - 9)) END) AS s
  FROM inc JOIN main USING (lat_cell, lon_cell) GROUP BY 1, 2),
cell AS (SELECT main.*, coalesce(s_obs, 0) AS s_obs, CASE WHEN n_rec >= 10 THEN coalesce(s, 0) END AS s_rare,
  round(CASE WHEN n_rec >= 10 THEN coalesce(s, 0) END, 3) AS s_rare_r3 FROM main LEFT JOIN per USING (lat_cell, lon_cell)),
lab AS (SELECT *, CAST(floor(lat_cell / 10) * 10 AS INTEGER) AS lat_band,
  CASE WHEN s_rare_r3 IS NULL THEN 'insufficient_data' ELSE ['bad', 'moderate', 'good'][ntile(3) OVER (PARTITION BY s_rare_r3 IS NULL ORDER BY s_rare_r3, lat_cell, lon_cell)] END AS label,
  CASE WHEN s_rare_r3 IS NULL THEN 'insufficient_data' ELSE ['bad', 'moderate', 'good'][ntile(3) OVER (PARTITION BY s_rare_r3 IS NULL, floor(lat_cell / 10) ORDER BY s_rare_r3, lat_cell, lon_cell)] END AS label_regional
  FROM cell)"""
)
YEAR = (
    REC
    + r""", y AS (SELECT *, substr(date, 1, 4) AS year FROM rec WHERE regexp_matches(date, '^[0-9]{4}')),
main AS (SELECT site, year, max(continent) AS continent, count(*) AS n_rec FROM y GROUP BY 1, 2),
inc AS (SELECT site, year, s, count(*) AS c FROM (SELECT site, year, unnest(names) AS s FROM y) GROUP BY 1, 2, 3),
per AS (SELECT site, year, count(*) AS s_obs, sum(CASE WHEN n_rec < 10 THEN NULL WHEN n_rec - c < 10 THEN 1e0 ELSE
  1 - exp(lgamma(n_rec - c + 1) - lgamma(n_rec - c - 9) - lgamma(n_rec + 1) + lgamma(n_rec - 9)) END) AS s
  FROM inc JOIN main USING (site, year) GROUP BY 1, 2),
cy AS (SELECT main.*, coalesce(s_obs, 0) AS s_obs, CASE WHEN n_rec >= 10 THEN coalesce(s, 0) END AS s_rare FROM main LEFT JOIN per USING (site, year)),
ch AS (SELECT *, last_richness - first_richness AS delta FROM (SELECT site, min(year) AS first_year, max(year) AS last_year, arg_min(s_rare, year) AS first_richness,
  arg_max(s_rare, year) AS last_richness FROM cy WHERE s_rare IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)),
dir AS (SELECT *, CASE WHEN delta > 0.5 THEN 'up' WHEN delta < -0.5 THEN 'down' ELSE 'flat' END AS direction FROM ch)"""
)
POINT = r"""pt AS (SELECT o_orderkey AS pid, ((o_custkey * 91) % 3600) / 10e0 - 180 + (o_orderkey % 7) / 100e0 AS x,
  ((o_custkey * 37) % 1400) / 10e0 - 60 + (o_orderkey % 10) / 100e0 AS y, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS v, o_custkey AS cust FROM orders)"""
POLY = (
    POINT
    + r""", pl AS (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'city' ELSE 'town' END AS kind, CAST(1995 + s_suppkey % 7 AS INTEGER) AS py FROM (
  SELECT s_suppkey, ((s_suppkey * 530) % 3300) / 10e0 - 180 AS a, ((s_suppkey * 310) % 1200) / 10e0 - 60 AS b, CAST(10 + s_suppkey % 5 * 5 AS DOUBLE) AS w FROM supplier)),
hit AS (SELECT pid, kind, year, py FROM pt JOIN pl ON x BETWEEN a AND a + w AND y BETWEEN b AND b + w WHERE CASE s_suppkey % 3
  WHEN 0 THEN true WHEN 1 THEN (x - a) + (y - b) <= w ELSE NOT (x > a + w / 4 AND x < a + w * 3 / 4 AND y > b + w / 4 AND y < b + w * 3 / 4) END)"""
)
CLS = POLY + ", h AS (SELECT pid, min(kind) AS kind FROM hit WHERE year = py GROUP BY 1), cl AS (SELECT pt.*, coalesce(kind, 'rural') AS urban_class FROM pt LEFT JOIN h USING (pid))"
SRC = (
    REC
    + r""", src AS (SELECT id, continent, idx_total, 0 AS src_rank FROM rec WHERE idx_total >= 100000 UNION ALL SELECT id, continent, idx_total + 1, 1 FROM rec WHERE idx_total < 150000
  UNION ALL SELECT id, continent, idx_total + 2, 2 FROM rec WHERE idx_total >= 140000 OR idx_total < 60000),
kept AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY continent, id ORDER BY src_rank) = 1)"""
)
META = "meta AS (SELECT l_orderkey AS id, max(l_partkey * 100000 + l_suppkey) AS seq FROM lineitem GROUP BY 1)"
RANK = (
    CELL
    + r""", long AS (SELECT index_name, round(value, 9) AS x, s_rare_r3 AS y FROM (SELECT * FROM cell WHERE s_rare IS NOT NULL) UNPIVOT (value FOR index_name IN
  (mean_idx_quantity, mean_idx_price, mean_idx_discount, mean_idx_tax, mean_idx_total))),
rk AS (SELECT index_name, rank() OVER (PARTITION BY index_name ORDER BY x) + (count(*) OVER (PARTITION BY index_name, x) - 1) / 2e0 AS rx,
  rank() OVER (PARTITION BY index_name ORDER BY y) + (count(*) OVER (PARTITION BY index_name, y) - 1) / 2e0 AS ry FROM long),
rho AS (SELECT index_name, count(*) AS n, CASE WHEN count(*) >= 10 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) END AS rho FROM rk GROUP BY 1)"""
)
MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY s_rare DESC)"
ODD = "CASE o_orderkey % 4 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE o_totalprice END"


def _bins(rel: str, value: str, bins: int) -> str:
    return f"""SELECT CASE WHEN lo = hi THEN 1 ELSE least(CAST(floor(({value} - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) END AS bin, count(*) AS n
FROM {rel}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {rel}) GROUP BY 1"""


_agg = lambda cols: ", ".join(f"round(avg({c}) + 0.00003, 4) AS {c}__mean, round(median({c}) + 0.00003, 4) AS {c}__median" for c in cols)

SCORES = """sc AS (SELECT l_orderkey AS id, l_partkey AS part, l_suppkey AS supp, concat('say "', l_returnflag, '", ', chr(10), l_linestatus) AS note,
  (l_partkey * 31 + l_suppkey) % 4 AS b, (l_partkey * 7919 + l_suppkey * 104729) % 100003 AS o FROM lineitem)"""
ODD_ROWS = """od AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS file, c_custkey AS k, c_name, c_mktsegment,
  CASE WHEN c_custkey % 11 = 5 THEN 'too many fields' WHEN c_custkey % 13 = 7 THEN 'too few fields' END AS reason FROM customer)"""

ORACLE: dict[str, str] = {
    "s02_month_range": """WITH o AS (SELECT o_orderkey, o_orderkey % 12 + 1 AS lo, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 12 + 1 ELSE o_custkey % 12 + 1 END AS hi FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN lpad(CAST(m AS VARCHAR), 2, '0') END AS month FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [0::BIGINT] WHEN lo <= hi THEN range(lo, hi + 1) ELSE [] END) AS m FROM o)""",
    "s04_json_pages": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS gen, concat(o_orderpriority, ';', o_orderstatus) AS also, o_orderpriority AS loc, CAST(NULL AS VARCHAR) AS en, o_custkey // 50 AS page FROM orders WHERE (o_custkey // 50) % 7 <> 3",
    "s05_bad_pages": """SELECT DISTINCT o_custkey // 50 AS page, 'not JSON' AS reason, '{"recordings":[' AS begins FROM orders WHERE (o_custkey // 50) % 7 = 3""",
    "s08_csv_scan": f"WITH {SCORES} SELECT CAST(id AS VARCHAR) AS id, CAST(part AS VARCHAR) AS part, CAST(supp AS VARCHAR) AS supp, note FROM sc",
    "s09_pruned_scan": f"WITH {SCORES} SELECT CAST(id AS VARCHAR) AS id, CAST(supp AS VARCHAR) AS supp FROM sc",
    "s09_good_rows": f"WITH {ODD_ROWS} SELECT CAST(k AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM od WHERE reason IS NULL",
    "s09_bad_rows": f"WITH {ODD_ROWS} SELECT file, reason, concat(k, ',', c_name, CASE WHEN reason = 'too many fields' THEN concat(',', c_mktsegment, ',more') ELSE '' END) AS content FROM od WHERE reason IS NOT NULL",
    "s10_tagged_union": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, lower(r_name) AS continent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
    "s11_glob_scan": f"WITH {ODD_ROWS} SELECT file, count(*) AS n FROM od GROUP BY 1",
    "s13_shapefile": """WITH p AS (SELECT s_suppkey, ((s_suppkey * 530) % 3300) / 10e0 - 180 AS minx, ((s_suppkey * 310) % 1200) / 10e0 - 60 AS miny, CAST(10 + s_suppkey % 5 * 5 AS DOUBLE) AS w FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 7 = 1)
SELECT 'city' AS kind, CAST(1996 AS INTEGER) AS year, row_number() OVER (ORDER BY s_suppkey) AS poly_id, CAST(CASE s_suppkey % 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS n_rings, CAST(CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 10 END AS INTEGER) AS n_points,
  minx, miny, minx + w AS maxx, miny + w AS maxy FROM p""",
    "s14_zipped_outline": "SELECT n_nationkey + 1 AS record, n_name AS name, CAST(n_nationkey AS INTEGER) AS code, n_nationkey * 7e0 - 90 AS minx, n_regionkey * 20e0 - 50 AS miny, n_nationkey * 7e0 - 86 AS maxx, n_regionkey * 20e0 - 46 AS maxy FROM nation WHERE n_name ILIKE 'india'",
    "s15_result_sink": f"WITH {CELL} SELECT round(lat_cell + 0.05, 4) AS lat, round(lon_cell + 0.05, 4) AS lon, continent, n_rec, round(s_rare_r3, 6) AS richness, label, CAST(CASE label WHEN 'bad' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS INTEGER) AS label_code FROM lab WHERE s_rare_r3 IS NOT NULL",
    "s17_counters": """WITH p AS (SELECT o_custkey // 50 AS page, o_orderkey FROM orders), r AS (SELECT * FROM p WHERE page % 7 <> 3), m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.05)
SELECT (SELECT count(DISTINCT o_orderkey) FROM r) AS n_written, (SELECT count(DISTINCT page) FROM p) AS n_pages, (SELECT count(DISTINCT page) FROM p WHERE page % 7 = 3) AS n_bad_pages, (SELECT count(*) FROM r) AS n_read, (SELECT count(*) FROM r) AS n_blank,
  (SELECT count(*) - count(DISTINCT o_orderkey) FROM r) AS n_dupes, (SELECT count(DISTINCT o_orderkey) FROM r JOIN m ON l_orderkey = o_orderkey) AS n_matched, (SELECT count(DISTINCT o_orderkey) FROM r LEFT JOIN m ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL) AS n_unmatched""",
    "p20_null_default": f"WITH {REC}, t AS (SELECT l_orderkey, max(l_linestatus) AS tag FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT id, coalesce(tag, '') AS tag, tag IS NOT NULL AS matched FROM rec LEFT JOIN t ON l_orderkey = id",
    "p21_short_names": "SELECT p_partkey, ['ACI', 'ADI', 'AEI', 'Bioacoustic', 'NDSI', 'Spectral Entropy', 'Temporal Entropy', 'NB peaks', 'ADI (NR)', 'Bioacoustic (NR)', 'Spectral Entropy (NR)', 'other'][p_size % 12 + 1] AS short FROM part",
    "j02_last_in_files": f"WITH {SCORES} SELECT CAST(id AS VARCHAR) AS id, CAST(part AS VARCHAR) AS part, CAST(supp AS VARCHAR) AS supp FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY b DESC, o DESC, part DESC, supp DESC) = 1",
    "j03_first_in_files": f"WITH {SCORES} SELECT CAST(id AS VARCHAR) AS id, CAST(part AS VARCHAR) AS part, CAST(supp AS VARCHAR) AS supp FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY b, o, part, supp) = 1",
    "o05_reading_order": f"""WITH {SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o, part, supp, id) AS r, row_number() OVER (PARTITION BY b ORDER BY o DESC, part DESC, supp DESC, id DESC) AS z, count(*) OVER (PARTITION BY b) AS n FROM sc)
SELECT CAST(x.id AS VARCHAR) AS id, CAST(x.part AS VARCHAR) AS part, CAST(x.supp AS VARCHAR) AS supp, CAST(y.id AS VARCHAR) AS last_id, CAST(y.part AS VARCHAR) AS last_part, x.n FROM n x JOIN n y USING (b) WHERE x.r = 1 AND y.z = 1""",
    "s06_unnest": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem",
    "p01_lenient_double": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey + 0.5e0 END AS x FROM orders",
    "p02_grid_snap": f"WITH {CELL} SELECT id, lat_cell, lon_cell FROM g",
    "p03_skipped_coord": f"WITH {REC} SELECT count(*) AS n_read, count(*) FILTER (lat IS NULL) AS skipped_coord FROM rec",
    "p04_year_text": f"WITH {REC} SELECT id, substr(date, 1, 4) AS year FROM rec WHERE id % 7 <> 0",
    "p05_year_range": f"WITH {REC} SELECT id, CAST(substr(date, 1, 4) AS INTEGER) AS year FROM rec WHERE CAST(substr(date, 1, 4) AS INTEGER) BETWEEN 1996 AND 1998",
    "p06_species_key": "SELECT p_partkey, nullif(trim(concat(CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) ELSE '' END, ' ', CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_name, ' ', 2) ELSE '' END)), '') AS species FROM part",
    "p07_species_set": f"WITH {REC} SELECT id, array_to_string(names, ';') AS species, CAST(len(names) AS INTEGER) AS n_species FROM rec",
    "p08_list_text": "SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) ELSE 'plain, text' END AS also FROM lineitem GROUP BY 1",
    "p09_lat_band": f"WITH {CELL} SELECT lat_cell, lon_cell, lat_band FROM lab",
    "p10_cell_center": f"WITH {CELL} SELECT round(lat_cell + 0.05, 4) AS lat, round(lon_cell + 0.05, 4) AS lon FROM cell",
    "p12_inf_to_null": f"SELECT o_orderkey, CASE WHEN isfinite({ODD}) THEN {ODD} END AS x FROM orders",
    "p13_nan_skip_mean": "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderkey % 4 <> 1), 4) AS mean FROM orders GROUP BY 1",
    "p15_country_filter": f"WITH {REC} SELECT id, continent, date FROM rec WHERE cnt = 'INDIA'",
    "p16_country_name": "SELECT n_nationkey, n_name FROM nation WHERE n_name ILIKE 'india'",
    "p17_label_code": f"WITH {CELL} SELECT lat_cell, lon_cell, label, CAST(CASE label WHEN 'bad' THEN 0 WHEN 'moderate' THEN 1 WHEN 'good' THEN 2 END AS INTEGER) AS label_code FROM lab",
    "p18_change_direction": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 * 0.25 - 0.5 > 0.25 THEN 'up' WHEN o_orderkey % 5 * 0.25 - 0.5 < -0.25 THEN 'down' ELSE 'flat' END AS direction FROM orders",
    "p19_growth_pct": "SELECT n_nationkey, CAST(floor(100e0 * (3 - n_regionkey) / nullif(n_regionkey, 0)) AS BIGINT) AS growth, round(100e0 * n_regionkey / nullif(n_nationkey, 0), 6) AS pct FROM nation",
    "j01_left_join": f"WITH {REC}, {META} SELECT id, continent, seq, seq IS NOT NULL AS matched FROM rec LEFT JOIN meta USING (id)",
    "j02_build_last_wins": f"WITH {META} SELECT id, seq // 100000 AS l_partkey, seq % 100000 AS l_suppkey FROM meta",
    "j03_probe_first_wins": f"WITH {SRC} SELECT continent, id, CAST(src_rank AS INTEGER) AS src_rank, round(idx_total, 6) AS idx_total FROM kept",
    "u01_union_dedup": f"WITH {SRC} SELECT continent, CAST(src_rank AS INTEGER) AS src_rank, count(*) AS n FROM kept GROUP BY 1, 2",
    "j04_match_counters": f"""WITH {SRC}, {META}, r AS (SELECT continent, count(*) AS n_read, count(*) FILTER (src_rank = 1) AS n_gap, count(*) FILTER (src_rank = 2) AS n_hist FROM src GROUP BY 1),
k AS (SELECT continent, count(*) AS n_total, count(seq) AS n_matched FROM kept LEFT JOIN meta USING (id) GROUP BY 1)
SELECT continent, n_read, n_gap, n_hist, n_total, n_read - n_total AS n_dupes, n_matched, n_total - n_matched AS n_unmatched, round(100e0 * n_matched / n_total, 6) AS pct_matched FROM r JOIN k USING (continent)""",
    "j05_pip_semi": f"WITH {POLY} SELECT DISTINCT pid, kind FROM hit",
    "j05_many_vertices": f"""WITH {POINT} SELECT DISTINCT pid, CASE WHEN s_suppkey % 2 = 0 THEN 'city' ELSE 'town' END AS kind FROM pt JOIN (
  SELECT s_suppkey, ((s_suppkey * 530) % 3300) / 10e0 - 180 + 1e0 / 3 AS a, ((s_suppkey * 310) % 1200) / 10e0 - 60 + 1e0 / 7 AS b, CAST(10 + s_suppkey % 5 * 5 AS DOUBLE) AS w FROM supplier
) ON x BETWEEN a AND a + w AND y BETWEEN b AND b + w WHERE y <= b + w * (5000 - floor((x - a) / (w / 5000))) / 5000""",
    "j06_pip_by_year": f"WITH {POLY} SELECT DISTINCT pid, kind FROM hit WHERE year = py",
    "j07_priority_overlay": f"WITH {POLY}, h AS (SELECT pid, min(kind) AS kind FROM hit WHERE year = py GROUP BY 1) SELECT pid, year, coalesce(kind, 'rural') AS urban_class FROM pt LEFT JOIN h USING (pid)",
    "j08_left_fanout": f"WITH {REC} SELECT id, date, l_linenumber FROM rec LEFT JOIN lineitem ON l_orderkey = id WHERE cnt = 'INDIA'",
    "j09_dense_years": f"WITH {POINT}, c AS (SELECT year, count(*) AS n FROM pt GROUP BY 1) SELECT CAST(yy AS INTEGER) AS year, coalesce(n, 0) AS n FROM range(1993, 2004) t(yy) LEFT JOIN c ON year = yy",
    "a01_cell_counts": f"WITH {CELL} SELECT lat_cell, lon_cell, n_rec FROM cell",
    "a02_last_continent": f"WITH {REC} SELECT CAST(floor(lat) AS BIGINT) AS gy, CAST(floor(lon) AS BIGINT) AS gx, max(continent) AS continent FROM rec WHERE lat IS NOT NULL GROUP BY 1, 2",
    "a03_incidence": f"WITH {CELL} SELECT CAST(round(lat_cell * 10) AS BIGINT) AS gy, CAST(round(lon_cell * 10) AS BIGINT) AS gx, s AS species_name, c AS n_inc FROM inc",
    "a04_rarefied": f"WITH {CELL} SELECT lat_cell, lon_cell, n_rec, s_obs, round(s_rare, 6) AS s_rare FROM cell",
    "a05_cell_means": f"WITH {CELL} SELECT lat_cell, lon_cell, " + ", ".join(f"round(mean_idx_{c} + 0.00003, 4) AS mean_idx_{c}" for c in ("quantity", "price", "discount", "tax", "total")) + " FROM cell",
    "a06_cell_year": f"WITH {YEAR} SELECT site, year, continent, n_rec, s_obs, round(s_rare, 6) AS s_rare FROM cy",
    "a07_coverage": f"WITH {CELL} SELECT count(*) AS n_cells, count(s_rare) AS n_scored FROM cell",
    "a08_multi_year": f"""WITH {YEAR}, n AS (SELECT count(DISTINCT year) AS n_years, count(DISTINCT year) FILTER (s_rare IS NOT NULL) AS n_scored_years FROM cy),
k AS (SELECT site, count(DISTINCT year) AS k FROM cy WHERE s_rare IS NOT NULL GROUP BY 1)
SELECT n_years, n_scored_years, count(*) FILTER (k >= 2) AS n_multi, count(*) FILTER (k = n_years) AS n_all_years, count(*) FILTER (k = n_scored_years) AS n_all_scored_years FROM n LEFT JOIN k ON true GROUP BY 1, 2""",
    "a09_first_last": f"WITH {YEAR} SELECT site, first_year, last_year, round(first_richness, 6) AS first_richness, round(last_richness, 6) AS last_richness, round(delta, 6) AS delta FROM ch",
    "a10_direction_counts": f"WITH {YEAR} SELECT direction, count(*) AS n FROM dir GROUP BY 1",
    "a11_trend_grouping_sets": f"WITH {YEAR} SELECT year, CASE WHEN grouping(continent) = 1 THEN 'ALL' ELSE continent END AS continent, round({MEDIAN}, 6) AS median_richness, count(s_rare) AS n_scored FROM cy GROUP BY GROUPING SETS ((year, continent), (year))",
    "a12_group_medians": f"WITH {CELL} SELECT continent, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY s_rare_r3 DESC), 6) AS median_richness, count(*) AS n FROM cell WHERE s_rare_r3 IS NOT NULL GROUP BY 1",
    "a13_order_quantiles": f"WITH {CELL}, v AS (SELECT list_sort(list(s_rare_r3)) AS x, count(*) AS n FROM cell WHERE s_rare_r3 IS NOT NULL) SELECT round(x[1], 6) AS lo, "
    + ", ".join(f"round(x[CAST(floor(n * {p}::DOUBLE) AS BIGINT) + 1], 6) AS q{round(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9))
    + ", round(x[n], 6) AS hi FROM v",
    "a14_class_summary": f"WITH {CLS} SELECT urban_class, count(*) AS n_recordings, {_agg('vxy')} FROM cl GROUP BY 1",
    "a15_year_class_summary": f"WITH {CLS} SELECT year, urban_class, count(*) AS n_recordings, {_agg('vy')} FROM cl GROUP BY 1, 2",
    "a16_pivot_pct": f"""WITH {CLS}, w AS (SELECT year, count(*) FILTER (urban_class = 'city') AS city, count(*) FILTER (urban_class = 'town') AS town, count(*) FILTER (urban_class = 'rural') AS rural, count(*) AS total FROM cl GROUP BY 1)
SELECT *, round(100e0 * city / total, 1) AS city_pct, round(100e0 * town / total, 1) AS town_pct FROM w""",
    "a17_label_counts": f"WITH {CELL} SELECT 'global' AS scope, label, count(*) AS n FROM lab GROUP BY 2 UNION ALL SELECT 'regional', label_regional, count(*) FROM lab GROUP BY 2",
    "a18_effort_totals": f"WITH {YEAR} SELECT year, CASE WHEN grouping(continent) = 1 THEN 'ALL' ELSE continent END AS continent, CAST(sum(n_rec) AS BIGINT) AS n_rec FROM cy GROUP BY GROUPING SETS ((year, continent), (year))",
    "a19_scored_by_year": f"WITH {YEAR} SELECT year, count(s_rare) AS n_scored, round({MEDIAN}, 6) AS median_richness FROM cy GROUP BY 1",
    "a20_series_extrema": f"""WITH {POINT}, c AS (SELECT year, count(*) AS n FROM pt GROUP BY 1) SELECT min(n) AS low, max(n) AS peak, (SELECT year FROM c ORDER BY n, year LIMIT 1) AS low_at,
(SELECT year FROM c ORDER BY n DESC, year LIMIT 1) AS peak_at, arg_max(n, year) AS last, max(n) - arg_max(n, year) AS "drop" FROM c""",
    "a21_histogram": f"WITH {CELL}, z AS (SELECT * FROM cell WHERE s_rare_r3 IS NOT NULL) " + _bins("z", "s_rare_r3", 40),
    "a22_value_counts": f"WITH {CLS} SELECT urban_class, count(*) AS n FROM cl GROUP BY 1",
    "a23_year_counts": f"WITH {REC} SELECT substr(date, 1, 4) AS year, count(*) AS n FROM rec GROUP BY 1",
    "a24_share": f"WITH {CLS} SELECT count(*) FILTER (urban_class IN ('city', 'town')) AS n_part, count(*) AS n_all, round(count(*) FILTER (urban_class IN ('city', 'town')) / CAST(count(*) AS DOUBLE), 6) AS share FROM cl",
    "a25_extent": f"""WITH {POLY}, b AS (SELECT min(a) - 1 AS minx, min(b) - 1 AS miny, max(a + w) + 1 AS maxx, max(b + w) + 1 AS maxy FROM pl)
SELECT round(minx, 6) AS minx, round(miny, 6) AS miny, round(maxx, 6) AS maxx, round(maxy, 6) AS maxy, round(1 / cos(radians((miny + maxy) / 2)), 6) AS aspect FROM b""",
    "w01_avg_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2e0 AS rank FROM part",
    "w02_spearman": f"WITH {RANK} SELECT index_name, n, rho FROM rho",
    "w03_global_tertile": f"WITH {CELL} SELECT lat_cell, lon_cell, label FROM lab",
    "w04_band_tertile": f"WITH {CELL} SELECT lat_cell, lon_cell, lat_band, label_regional FROM lab",
    "w05_stack_offset": f"WITH {CLS}, c AS (SELECT year, urban_class, count(*) AS n FROM cl GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY year ORDER BY urban_class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM c",
    "o01_sort_abs": f"WITH {RANK} SELECT index_name, rho, CAST(row_number() OVER (ORDER BY abs(coalesce(rho, 0)) DESC, index_name) AS INTEGER) AS place FROM rho",
    "o02_best_rho": f"WITH {RANK} SELECT max(abs(rho)) AS best_rho FROM rho",
    "o04_distinct_years": f"WITH {REC} SELECT DISTINCT substr(date, 1, 4) AS year FROM rec",
    "r01_unpivot": "SELECT l_orderkey, 'quantity' AS index_name, max(l_quantity) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'discount', max(l_discount) FROM lineitem GROUP BY 1",
    "r02_pivot_fill": f"WITH {CLS} SELECT CAST(yy AS INTEGER) AS year, count(*) FILTER (urban_class = 'city') AS city, count(*) FILTER (urban_class = 'town') AS town, count(*) FILTER (urban_class = 'rural') AS rural FROM range(1994, 2003) t(yy) LEFT JOIN cl ON year = yy GROUP BY 1",
    "v1_summary": f"WITH {CELL} SELECT count(*) AS n_cells, count(s_rare) AS n_scored, round(100e0 * count(s_rare) / count(*), 6) AS pct_scored, count(*) FILTER (label = 'bad') AS n_bad, count(*) FILTER (label = 'moderate') AS n_moderate, count(*) FILTER (label = 'good') AS n_good FROM lab",
    "v2_label_map": f"WITH {CELL} SELECT round(lat_cell + 0.05, 4) AS lat, round(lon_cell + 0.05, 4) AS lon, continent, n_rec, round(s_rare_r3, 6) AS richness, label, CAST(CASE label WHEN 'bad' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS INTEGER) AS label_code FROM lab WHERE s_rare_r3 IS NOT NULL",
    "v4_distribution": f"WITH {YEAR} " + _bins("ch", "delta", 30),
    "v6_trend": f"WITH {YEAR} SELECT year, continent, round({MEDIAN}, 6) AS median_richness, count(s_rare) AS n_scored FROM cy GROUP BY 1, 2 UNION ALL SELECT year, 'ALL', round({MEDIAN}, 6), count(s_rare) FROM cy GROUP BY 1",
    "v8_effort_metric": f"WITH {YEAR} SELECT year, CAST(sum(n_rec) AS BIGINT) AS n_rec, count(s_rare) AS n_scored, round({MEDIAN}, 6) AS median_richness FROM cy GROUP BY 1",
    "v8_effort_stack": f"""WITH {YEAR}, c AS (SELECT year, continent, CAST(sum(n_rec) AS BIGINT) AS n_rec FROM cy GROUP BY 1, 2)
SELECT *, CAST(coalesce(sum(n_rec) OVER (PARTITION BY year ORDER BY coalesce(nullif(list_position(['europe', 'america', 'asia', 'africa', 'australia'], continent), 0), 9), continent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM c""",
    "v8_metric_extrema": f"""WITH {YEAR}, m AS (SELECT year, round({MEDIAN}, 6) AS m FROM cy GROUP BY 1 HAVING count(s_rare) > 0)
SELECT min(m) AS low, max(m) AS peak, (SELECT year FROM m ORDER BY m, year LIMIT 1) AS low_at, (SELECT year FROM m ORDER BY m DESC, year LIMIT 1) AS peak_at,
  (SELECT m FROM m ORDER BY year DESC LIMIT 1) AS last, round(max(m) - (SELECT m FROM m ORDER BY year DESC LIMIT 1), 6) AS drop FROM m""",
    "v9_country_split": f"""WITH {POLY}, h AS (SELECT pid, min(kind) AS kind FROM hit WHERE year = py GROUP BY 1),
c AS (SELECT year, coalesce(kind, 'rural') AS urban_class, count(*) AS n FROM pt LEFT JOIN h USING (pid) JOIN customer ON cust = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'INDIA' GROUP BY 1, 2),
d AS (SELECT CAST(yy AS INTEGER) AS year, k AS urban_class, coalesce(n, 0) AS n FROM range(1995, 2002) t(yy) CROSS JOIN (VALUES ('city'), ('town'), ('rural')) u(k) LEFT JOIN c ON year = yy AND urban_class = k)
SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY year ORDER BY list_position(['city', 'town', 'rural'], urban_class) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base,
  round(n / CAST(nullif(sum(n) OVER (PARTITION BY year), 0) AS DOUBLE), 6) AS share FROM d""",
    "flagship_grid_labels": f"WITH {CELL} SELECT lat_cell, lon_cell, continent, n_rec, s_obs, round(s_rare_r3, 6) AS s_rare10, label, lat_band, label_regional FROM lab",
}


def _beside(*names: str) -> str:
    """Frames of one row each, or the first of several rows, side by side."""
    return "SELECT * FROM " + " CROSS JOIN ".join(f"({x if x.startswith(('WITH', 'SELECT')) else ORACLE[x]})" for x in names)


def _directions(first: str = "") -> str:
    return f"WITH {YEAR} SELECT {first}" + ", ".join(f"count(*) FILTER (direction = '{x}') AS n_{x}" for x in ("up", "down", "flat")) + " FROM dir"


ORACLE |= {
    "v1_report": _beside("v1_summary", "o02_best_rho", f"SELECT CAST(sum(n_read) AS BIGINT) AS n_read, CAST(sum(n_total) AS BIGINT) AS n_merged, round(100e0 * sum(n_matched) / sum(n_total), 6) AS pct_matched FROM ({ORACLE['j04_match_counters']})"),
    "v3_signed_rho": f"WITH {RANK} SELECT index_name, n, rho, CASE WHEN rho < 0 THEN 'negative' ELSE 'positive' END AS sign, CAST(row_number() OVER (ORDER BY abs(coalesce(rho, 0)) DESC, index_name) AS INTEGER) AS place FROM rho",
    "v4_richness": _beside("a21_histogram", "a13_order_quantiles"),
    "v6_change": _beside("v4_distribution", _directions()),
    "v7_decade": _beside("a08_multi_year", _directions("count(*) AS n_changed, "), "v8_metric_extrema"),
    "v9_country_years": f"""WITH {REC}, c AS (SELECT CAST(substr(date, 1, 4) AS INTEGER) AS year, count(*) AS n FROM rec WHERE cnt = 'INDIA' GROUP BY 1)
SELECT CAST(yy AS INTEGER) AS year, coalesce(n, 0) AS n, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c) AS total FROM range(1996, 2004) t(yy) LEFT JOIN c ON year = yy""",
    "v10_country_map": f"""WITH {REC}, {POLY}, h AS (SELECT pid, min(kind) AS kind FROM hit WHERE year = py GROUP BY 1),
o AS (SELECT n_nationkey * 7e0 - 92 AS minx, n_regionkey * 20e0 - 52 AS miny, n_nationkey * 7e0 - 84 AS maxx, n_regionkey * 20e0 - 44 AS maxy FROM nation WHERE n_name = 'INDIA')
SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(kind, 'rural') AS urban_class, minx, miny, maxx, maxy, round(1 / cos(radians((miny + maxy) / 2)), 6) AS aspect FROM rec LEFT JOIN h ON pid = id, o WHERE cnt = 'INDIA' AND lat IS NOT NULL""",
}
ORACLE["a06_roll_up"] = f"""WITH {YEAR}, am AS (SELECT site, max(continent) AS continent, count(*) AS n_rec FROM rec GROUP BY 1),
ai AS (SELECT site, s, count(*) AS c FROM (SELECT site, unnest(names) AS s FROM rec) GROUP BY 1, 2),
ap AS (SELECT site, count(*) AS s_obs, sum(CASE WHEN n_rec < 10 THEN NULL WHEN n_rec - c < 10 THEN 1e0 ELSE 1 - exp(lgamma(n_rec - c + 1) - lgamma(n_rec - c - 9) - lgamma(n_rec + 1) + lgamma(n_rec - 9)) END) AS s FROM ai JOIN am USING (site) GROUP BY 1)
SELECT site, 'all' AS over, NULL AS year, continent, n_rec, coalesce(s_obs, 0) AS s_obs, round(CASE WHEN n_rec >= 10 THEN coalesce(s, 0) END, 6) AS s_rare FROM am LEFT JOIN ap USING (site)
UNION ALL SELECT site, 'year', year, continent, n_rec, s_obs, round(s_rare, 6) FROM cy"""
ORACLE["s07_csv_sink"] = f"SELECT id, gen, also, loc FROM ({ORACLE['s04_json_pages']})"
ORACLE["o06_first_hit"] = f"WITH {POLY} SELECT kind, py AS year, count(*) AS n, min(a) AS minx, max(a + w) AS maxx FROM pl GROUP BY 1, 2"
ORACLE["u02_union_continents"] = f"SELECT continent, count(*) AS n FROM ({ORACLE['s10_tagged_union']}) GROUP BY 1"
ORACLE["r03_append_labels"] = f"WITH {CELL} SELECT lat_cell, lon_cell, n_rec, s_obs, lat_band, label, label_regional FROM lab"
