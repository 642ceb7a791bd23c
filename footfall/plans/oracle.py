"""The same results as ANSI SQL, for checking the catalogue in another engine.

Each statement is built from named common table expressions; only those it needs
are included.
"""

from __future__ import annotations

import re

from footfall.functions.geo import EARTH_RADIUS_KM, KM2_PER_SQUARE_DEGREE
from footfall.functions.grid import grid_steps
from footfall.functions.tags import STOP_FRAGMENTS, STOP_WORDS
from footfall.sources.derived import PLACES

STEP_Y, STEP_X = (f"{step:.17e}" for step in grid_steps())
METRES = f"{EARTH_RADIUS_KM * 1000.0:.17e}"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _distance(a: str, b: str) -> str:
    """Haversine metres to the nearest micrometre between two (lat, lon) prefixes."""
    half_lat = f"sin(radians({a}lat - {b}lat) * 0.5e0)"
    half_lon = f"sin(radians({a}lon - {b}lon) * 0.5e0)"
    h = f"{half_lat} * {half_lat} + cos(radians({a}lat)) * cos(radians({b}lat)) * {half_lon} * {half_lon}"
    return f"(floor(2.0e0 * {METRES} * asin(sqrt(least(1.0e0, {h}))) * 1000000.0e0 + 0.5e0) / 1000000.0e0)"


PLACE_ROWS = ", ".join(f"({i},'{name}')" for i, name in enumerate(PLACES))

CTES: dict[str, str] = {
    "poi_names": f"SELECT * FROM (VALUES {PLACE_ROWS}) AS t(poi_id, poi)",
    "h": """SELECT e.event_id, e.user_id, e.ts,
  ((e.event_id + 1) * 1103515245 + 12345) % 2147483648 AS x1,
  ((e.event_id + 7) * 22695477 + 1) % 2147483648 AS x2 FROM events e""",
    "r": """SELECT event_id, user_id, ts,
  CAST(floor(x1 / 65536) AS BIGINT) AS a, CAST(floor(x2 / 65536) AS BIGINT) AS b FROM h""",
    "q": """SELECT *, (user_id * 3 + (a % 5)) % 12 AS poi_id,
  (a % 31) + (b % 29) - 29 AS jy,
  (CAST(floor(a / 31) AS BIGINT) % 31) + (CAST(floor(b / 29) AS BIGINT) % 29) - 29 AS jx,
  CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS is_noise FROM r""",
    "g": """SELECT q.*, p.poi,
  CASE WHEN is_noise = 1 THEN 41870000 + (a * 7 + b) % 50000
       ELSE 41875000 + (q.poi_id % 4) * 12000 + jy * 50 END AS lat_u,
  CASE WHEN is_noise = 1 THEN 12440000 + (b * 5 + a) % 70000
       ELSE 12450000 + ((q.poi_id - q.poi_id % 4) / 4) * 22000 + jx * 60 END AS lon_u
  FROM q JOIN poi_names p ON q.poi_id = p.poi_id""",
    "raw_posts": """SELECT g.event_id AS post_id,
  CASE WHEN g.event_id % 101 = 50 THEN -1.0e0 ELSE 1.0e0 END * (CAST(lat_u AS DOUBLE) / 1000000.0e0) AS latitude,
  CAST(lon_u AS DOUBLE) / 1000000.0e0 AS longitude,
  concat('user', CAST(user_id AS VARCHAR(20))) AS username, g.ts AS posted_ts,
  concat_ws(' ', CASE WHEN g.event_id % 97 = 13 THEN NULL ELSE concat_ws(' ',
     'rome', pt.p_name, CASE WHEN is_noise = 0 THEN poi END,
     CASE WHEN is_noise = 0 AND g.event_id % 9 = 4 THEN poi END,
     CASE WHEN g.event_id % 7 = 2 THEN 'foto' END,
     CASE WHEN g.event_id % 5 = 1 THEN concat('img', CAST(g.event_id AS VARCHAR(20))) END,
     CASE WHEN g.event_id % 50 = 8 THEN '罗马' END,
     CASE WHEN g.event_id % 40 = 6 THEN 'new-york' END) END) AS tag_text
FROM g JOIN part pt ON pt.p_partkey = g.event_id % (SELECT count(*) FROM part)""",
    "posts": "SELECT * FROM raw_posts WHERE latitude > 0 AND longitude > 0 AND tag_text <> ''",
    "tags": """SELECT post_id, latitude, longitude, username, posted_ts,
  unnest(string_split(tag_text, ' ')) AS tag,
  CAST(unnest(range(0, len(string_split(tag_text, ' ')))) AS INTEGER) AS pos FROM posts""",
    "post_cells": f"""SELECT *, CAST(trunc(latitude / {STEP_Y}) AS BIGINT) AS cell_y,
  CAST(trunc(longitude / {STEP_X}) AS BIGINT) AS cell_x FROM posts""",
    "centred": f"""SELECT *, (cell_y + 1) * {STEP_Y} - 0.5e0 * {STEP_Y} AS c_lat,
  (cell_x + 1) * {STEP_X} - 0.5e0 * {STEP_X} AS c_lon FROM post_cells""",
    "bag": """SELECT c.cell_y, c.cell_x, t.tag, count(*) AS n FROM tags t JOIN post_cells c ON c.post_id = t.post_id
GROUP BY c.cell_y, c.cell_x, t.tag""",
    "merged": "SELECT * FROM bag WHERE tag NOT IN ({words}) AND {fragments}".format(
        words=_list(STOP_WORDS), fragments=" AND ".join(f"NOT contains(tag, '{f}')" for f in STOP_FRAGMENTS)
    ),
    "tf": """SELECT cell_y, cell_x, tag AS term, n AS tf FROM bag
WHERE regexp_full_match(tag, '[a-zA-Z]*') AND tag <> 'foto'""",
    "n_cells": "SELECT count(*) AS n_cells FROM (SELECT DISTINCT cell_y, cell_x FROM bag)",
    "doc_freq": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "idf_all": "SELECT term, df, ln(n_cells / CAST(df AS DOUBLE)) AS idf FROM doc_freq, n_cells",
    "idf_l": "SELECT * FROM idf_all WHERE df > 2",
    "idf_t": "SELECT * FROM idf_all WHERE idf BETWEEN 2 AND 10",
}


def _elbow(prefix: str, source: str, keys: str, value: str, gap: float | None = None) -> None:
    """Add the tables ``{prefix}_knee`` (keys, i, d, y) for curves held as histograms."""
    part = f"PARTITION BY {keys}"
    CTES[f"{prefix}_pos"] = f"""SELECT {keys}, {value} AS y, n,
  CAST(coalesce(sum(n) OVER ({part} ORDER BY {value} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS i,
  CAST(sum(n) OVER ({part}) AS BIGINT) AS total,
  max({value}) OVER ({part}) AS ya, min({value}) OVER ({part}) AS yb FROM {source}"""
    CTES[f"{prefix}_dist"] = f"""SELECT *, CASE WHEN ya > yb AND total >= 3 THEN
  (y - yb) / CAST(ya - yb AS DOUBLE) END AS yn,
  CASE WHEN total > 1 THEN i / CAST(total - 1 AS DOUBLE) END AS xn FROM {prefix}_pos"""
    limit = "" if gap is None else f" AND yn < 1.0e0 - {gap}e0 - xn"
    CTES[f"{prefix}_best"] = f"""SELECT *, row_number() OVER ({part} ORDER BY d DESC, i) AS rk FROM (
  SELECT *, ((1.0e0 - yn) - xn) * sqrt(2.0e0) / 2.0e0 AS d FROM {prefix}_dist) WHERE d > 0{limit}"""
    first = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    match = " AND ".join(f"b.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    CTES[f"{prefix}_knee"] = f"""SELECT {first}, coalesce(b.i, 0) AS i, coalesce(b.d, 0.0e0) AS d,
  CASE WHEN p.total < 3 THEN 0 ELSE coalesce(b.y, p.ya) END AS y
FROM (SELECT DISTINCT {keys}, total, ya FROM {prefix}_pos) p
LEFT JOIN (SELECT * FROM {prefix}_best WHERE rk = 1) b ON {match}"""


CTES["tag_counts"] = "SELECT tag, count(*) AS c FROM tags GROUP BY tag"
CTES["tag_hist"] = "SELECT 'tags' AS curve, c, count(*) AS n FROM tag_counts GROUP BY c"
_elbow("tag_curve", "tag_hist", "curve", "c")
CTES["tf_hist"] = "SELECT 0 AS curve, tf, count(*) AS n FROM tf GROUP BY tf"
_elbow("tf_curve", "tf_hist", "curve", "tf")
CTES["scores"] = """SELECT tf.cell_y, tf.cell_x, tf.term, tf.tf, (1 + ln(tf.tf)) * w.idf AS score
FROM tf JOIN idf_l w ON w.term = tf.term WHERE tf.tf > (SELECT CAST(y AS BIGINT) FROM tf_curve_knee)"""
CTES["score_hist"] = "SELECT cell_y, cell_x, score, count(*) AS n FROM scores GROUP BY cell_y, cell_x, score"
_elbow("score_curve", "score_hist", "cell_y, cell_x", "score")
CTES["kept_scores"] = """SELECT s.* FROM scores s JOIN score_curve_knee k ON k.cell_y = s.cell_y AND k.cell_x = s.cell_x
WHERE s.score >= k.y"""
CTES["top_scores"] = """SELECT *, row_number() OVER (PARTITION BY cell_y, cell_x ORDER BY score DESC, term) AS rk FROM (
  SELECT tf.cell_y, tf.cell_x, tf.term, (1 + ln(tf.tf)) * w.idf AS score
  FROM tf JOIN idf_t w ON w.term = tf.term WHERE tf.tf >= 100)"""

CTES["points"] = f"""SELECT tag AS term, post_id, pos, longitude AS lon, latitude AS lat FROM tags
WHERE tag IN ({_list(PLACES)})"""
CTES["locations"] = "SELECT term, lon, lat, count(*) AS w FROM points GROUP BY term, lon, lat"
CTES["pairs"] = f"""SELECT a.term, a.lon, a.lat, a.w, b.lon AS b_lon, b.lat AS b_lat, b.w AS b_w, {_distance("a.", "b.")} AS d
FROM locations a JOIN locations b ON a.term = b.term"""
CTES["near"] = """SELECT *, sum(b_w) OVER (PARTITION BY term, lon, lat ORDER BY d ROWS UNBOUNDED PRECEDING) AS reached
FROM pairs WHERE lon <> b_lon OR lat <> b_lat"""
CTES["knn"] = """SELECT term, lon, lat, w, min(d) AS dist FROM near WHERE reached >= 4 GROUP BY term, lon, lat, w"""
CTES["curve"] = "SELECT term, dist, CAST(sum(w) AS BIGINT) AS n FROM knn GROUP BY term, dist"
_elbow("knn_curve", "curve", "term", "dist")
_elbow("gap_curve", "curve", "term", "dist", 0.27)
CTES["curve_points"] = """SELECT term, y, total, ya, yb, unnest(range(i, i + n)) AS i FROM knn_curve_pos"""
CTES["far_flags"] = """SELECT a.term, a.i, a.y, a.ya,
  coalesce(bool_or((b.y - a.yb) / (a.y - a.yb) < 1.0e0 - 0.27e0 - (b.i - a.i) / CAST(a.total - 1 - a.i AS DOUBLE)), false) AS far
FROM curve_points a LEFT JOIN curve_points b
  ON b.term = a.term AND b.i > a.i AND b.i < a.total - 1 AND a.y > a.yb
WHERE a.i <= a.total - 3 GROUP BY a.term, a.i, a.y, a.ya"""
CTES["eps_by_term"] = "SELECT term, coalesce(arg_min(y, i) FILTER (WHERE NOT far), max(ya)) AS eps FROM far_flags GROUP BY term"
CTES["steps"] = """SELECT term, total, greatest(1, (total - 2) // least(100, total)) AS step FROM (
  SELECT DISTINCT term, total FROM curve_points)"""
CTES["jumps"] = """SELECT f.term, f.i, f.far FROM far_flags f JOIN steps s ON s.term = f.term
WHERE f.i % s.step = 0 OR f.i = s.total - 3"""
CTES["reached"] = """SELECT j.term, coalesce(max(j.i) FILTER (WHERE m.miss IS NULL OR j.i < m.miss), 0) AS i FROM jumps j
LEFT JOIN (SELECT term, min(i) AS miss FROM jumps WHERE NOT far GROUP BY term) m ON m.term = j.term GROUP BY j.term"""
CTES["eps_coarse"] = """SELECT f.term, coalesce(arg_min(f.y, f.i) FILTER (WHERE NOT f.far AND f.i >= r.i), max(f.ya)) AS eps
FROM far_flags f JOIN reached r ON r.term = f.term GROUP BY f.term"""
CTES["draws"] = """SELECT term, rep,
  CAST(floor((((rep * 1000003 + draw) % 2147483648) * 1103515245 + 12345) % 2147483648 / 2147483648.0e0 * total) AS BIGINT) AS i
FROM (SELECT DISTINCT term, total FROM curve_points) t, range(1, 10) AS a(rep), range(1, 201) AS b(draw)"""
CTES["draw_hist"] = """SELECT d.term, d.rep, p.y AS dist, count(*) AS n FROM draws d
JOIN curve_points p ON p.term = d.term AND p.i = d.i GROUP BY d.term, d.rep, p.y"""
_elbow("draw_curve", "draw_hist", "term, rep", "dist")

CTES["near_eps"] = "SELECT p.* FROM pairs p JOIN eps_by_term e ON e.term = p.term WHERE p.d <= e.eps"
CTES["neighbour_counts"] = """SELECT term, lon, lat, CAST(sum(b_w) - 1 AS BIGINT) AS neighbours, sum(b_w) - 1 >= 4 AS core
FROM near_eps GROUP BY term, lon, lat"""
CTES["ids"] = "SELECT *, row_number() OVER (PARTITION BY term ORDER BY lat, lon) AS id FROM neighbour_counts"
CTES["links"] = """SELECT a.term, a.id AS a, b.id AS b, a.core AS a_core FROM near_eps n
JOIN ids a ON a.term = n.term AND a.lon = n.lon AND a.lat = n.lat
JOIN ids b ON b.term = n.term AND b.lon = n.b_lon AND b.lat = n.b_lat WHERE b.core"""
CTES["core_links"] = "SELECT term, a, b FROM links WHERE a_core AND a <> b"
CTES["spread(term, id, label)"] = """SELECT term, id, id FROM ids WHERE core
UNION SELECT l.term, l.b, s.label FROM spread s JOIN core_links l ON l.term = s.term AND l.a = s.id AND s.label < l.b"""
CTES["core_labels"] = "SELECT term, id, min(label) AS label FROM spread GROUP BY term, id"
CTES["labels"] = """SELECT term, id, label FROM core_labels UNION ALL
SELECT l.term, l.a, min(c.label) FROM links l JOIN core_labels c ON c.term = l.term AND c.id = l.b
WHERE NOT l.a_core GROUP BY l.term, l.a"""
CTES["clusters"] = """SELECT i.term, i.lon, i.lat, i.core, l.label, n.lat AS label_lat, n.lon AS label_lon FROM ids i
LEFT JOIN labels l ON l.term = i.term AND l.id = i.id
LEFT JOIN ids n ON n.term = l.term AND n.id = l.label"""
CTES["cluster_sizes"] = """SELECT *, row_number() OVER (PARTITION BY term ORDER BY places DESC, label) AS rk FROM (
  SELECT term, label, label_lat, label_lon, count(*) AS places FROM clusters WHERE label IS NOT NULL
  GROUP BY term, label, label_lat, label_lon)"""
CTES["largest"] = "SELECT * FROM cluster_sizes WHERE rk = 1 AND places > 4"
CTES["chosen"] = """SELECT c.term, c.lon, c.lat FROM clusters c
JOIN largest g ON g.term = c.term AND g.label = c.label
WHERE c.term IN (SELECT term FROM points GROUP BY term HAVING count(*) > 50)"""


def _hull_area(prefix: str, source: str) -> None:
    """Add ``{prefix}_area``: area of the convex hull of the places of each term.

    An edge of the hull is a pair of places with no place to its right; the places
    farthest apart on each side give the edge, and the edges the area.
    """
    cross = "(b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon)"
    CTES[f"{prefix}_outer"] = f"""SELECT term, lon, min(lat) AS lat FROM {source} GROUP BY term, lon
UNION SELECT term, lon, max(lat) FROM {source} GROUP BY term, lon"""
    CTES[f"{prefix}_edges"] = f"""SELECT a.term, a.lon, a.lat, b.lon AS b_lon, b.lat AS b_lat,
  (b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat) AS len
FROM {prefix}_outer a JOIN {prefix}_outer b ON b.term = a.term AND (b.lon <> a.lon OR b.lat <> a.lat)
JOIN {prefix}_outer c ON c.term = a.term
GROUP BY a.term, a.lon, a.lat, b.lon, b.lat HAVING min({cross}) > -1e-14"""
    CTES[f"{prefix}_longest"] = f"""SELECT *, row_number() OVER (PARTITION BY term, lon, lat ORDER BY len DESC) AS out_rk,
  row_number() OVER (PARTITION BY term, b_lon, b_lat ORDER BY len DESC) AS in_rk FROM {prefix}_edges"""
    CTES[f"{prefix}_origin"] = f"SELECT term, min(lon) AS x, min(lat) AS y FROM {source} GROUP BY term"
    CTES[f"{prefix}_area"] = f"""SELECT e.term, round(abs(sum((e.lon - o.x) * (e.b_lat - o.y) - (e.b_lon - o.x) * (e.lat - o.y)))
  / 2.0e0 * 1000000.0e0, 6) AS micro_square_degrees
FROM {prefix}_longest e JOIN {prefix}_origin o ON o.term = e.term WHERE out_rk = 1 AND in_rk = 1 GROUP BY e.term"""


_hull_area("all_hull", "locations")
_hull_area("roi_hull", "chosen")

CTES["boxes"] = """SELECT term AS poi, min(lon) AS lon_lo, max(lon) AS lon_hi, min(lat) AS lat_lo, max(lat) AS lat_hi
FROM points GROUP BY term"""
CTES["foto_boxes"] = """SELECT p.term AS poi, min(p.lon) AS lon_lo, max(p.lon) AS lon_hi, min(p.lat) AS lat_lo, max(p.lat) AS lat_hi
FROM points p WHERE p.post_id IN (SELECT post_id FROM tags WHERE tag = 'foto') GROUP BY p.term"""
CTES["box_pairs"] = """SELECT f.poi, b.poi AS other_poi,
  (least(f.lon_hi, b.lon_hi) - greatest(f.lon_lo, b.lon_lo)) * (least(f.lat_hi, b.lat_hi) - greatest(f.lat_lo, b.lat_lo)) AS area
FROM foto_boxes f JOIN boxes b ON f.lon_lo <= b.lon_hi AND b.lon_lo <= f.lon_hi AND f.lat_lo <= b.lat_hi AND b.lat_lo <= f.lat_hi"""
CTES["quality"] = """SELECT b.poi, f.poi IS NOT NULL AS matched,
  (least(f.lon_hi, b.lon_hi) - greatest(f.lon_lo, b.lon_lo)) * (least(f.lat_hi, b.lat_hi) - greatest(f.lat_lo, b.lat_lo)) AS tp,
  (f.lon_hi - f.lon_lo) * (f.lat_hi - f.lat_lo) AS found, (b.lon_hi - b.lon_lo) * (b.lat_hi - b.lat_lo) AS real_area
FROM boxes b LEFT JOIN foto_boxes f ON f.poi = b.poi"""

for _table in ("boxes", "foto_boxes"):
    CTES[f"{_table}_ells"] = f"""SELECT poi, lon_lo AS x0, lat_lo AS y0, lon_hi AS x1, (lat_lo + lat_hi) / 2 AS y1 FROM {_table}
UNION ALL SELECT poi, lon_lo, (lat_lo + lat_hi) / 2, (lon_lo + lon_hi) / 2, lat_hi FROM {_table}"""
CTES["ell_pairs"] = """SELECT f.poi, b.poi AS other_poi, sum(greatest(0.0e0, least(f.x1, b.x1) - greatest(f.x0, b.x0))
  * greatest(0.0e0, least(f.y1, b.y1) - greatest(f.y0, b.y0))) AS area
FROM foto_boxes_ells f JOIN boxes_ells b ON f.x0 < b.x1 AND b.x0 < f.x1 AND f.y0 < b.y1 AND b.y0 < f.y1 GROUP BY f.poi, b.poi"""
CTES["ell_quality"] = """SELECT b.poi, f.poi IS NOT NULL AS matched, sum((least(f.x1, b.lon_hi) - greatest(f.x0, b.lon_lo))
  * (least(f.y1, b.lat_hi) - greatest(f.y0, b.lat_lo))) AS tp, sum((f.x1 - f.x0) * (f.y1 - f.y0)) AS found,
  (b.lon_hi - b.lon_lo) * (b.lat_hi - b.lat_lo) AS real_area
FROM boxes b LEFT JOIN foto_boxes_ells f ON f.poi = b.poi GROUP BY b.poi, f.poi, b.lon_lo, b.lon_hi, b.lat_lo, b.lat_hi"""

CTES["centres"] = """SELECT poi, 41875000 + (poi_id % 4) * 12000 AS lat_u, 12450000 + ((poi_id - poi_id % 4) / 4) * 22000 AS lon_u
FROM poi_names"""
CTES["regions"] = """SELECT poi, CAST(lon_u - 1000 AS DOUBLE) / 1000000.0e0 AS x0, CAST(lat_u - 800 AS DOUBLE) / 1000000.0e0 AS y0,
  CAST(lon_u + 1000 AS DOUBLE) / 1000000.0e0 AS x1, CAST(lat_u + 800 AS DOUBLE) / 1000000.0e0 AS y1 FROM centres"""
CTES["hits"] = """SELECT p.post_id, p.username, p.posted_ts, r.poi FROM posts p JOIN regions r
ON p.longitude BETWEEN r.x0 AND r.x1 AND p.latitude BETWEEN r.y0 AND r.y1"""
CTES["visit_rows"] = """SELECT username, strftime(posted_ts, '%Y-%m-%d') AS day, poi,
  strftime(posted_ts, '%Y-%m-%d %H:%M:%S') AS ts FROM hits"""
CTES["day_places"] = "SELECT username, day, poi, min(ts) AS ts FROM visit_rows GROUP BY username, day, poi"
CTES["n_days"] = "SELECT count(*) AS n FROM (SELECT DISTINCT username, day FROM day_places)"
CTES["subsets(username, day, items, last)"] = """SELECT username, day, [poi], poi FROM day_places
UNION ALL SELECT s.username, s.day, list_append(s.items, p.poi), p.poi
FROM subsets s JOIN day_places p ON p.username = s.username AND p.day = s.day AND p.poi > s.last"""
CTES["itemsets"] = """SELECT items, count(*) AS freq FROM subsets GROUP BY items
HAVING count(*) >= (SELECT ceil(0.01e0 * n) FROM n_days)"""
CTES["split_sets"] = """SELECT items, freq, unnest(items) AS consequent FROM itemsets WHERE len(items) > 1"""
CTES["set_rules"] = """SELECT array_to_string(a.items, ',') AS antecedent, s.consequent,
  s.freq / CAST(a.freq AS DOUBLE) AS confidence,
  s.freq / CAST(a.freq AS DOUBLE) / (c.freq / CAST(d.n AS DOUBLE)) AS lift, s.freq / CAST(d.n AS DOUBLE) AS support
FROM split_sets s JOIN itemsets a ON a.items = [x FOR x IN s.items IF x <> s.consequent]
JOIN itemsets c ON c.items = [s.consequent] CROSS JOIN n_days d WHERE s.freq / CAST(a.freq AS DOUBLE) >= 0.2e0"""
CTES["ordered"] = """SELECT username, day, poi, row_number() OVER (PARTITION BY username, day ORDER BY ts, poi) AS pos FROM day_places"""
CTES["subsequences(username, day, items, last)"] = """SELECT username, day, [poi], pos FROM ordered
UNION ALL SELECT s.username, s.day, list_append(s.items, p.poi), p.pos
FROM subsequences s JOIN ordered p ON p.username = s.username AND p.day = s.day AND p.pos > s.last WHERE len(s.items) < 5"""
CTES["sequences"] = """SELECT items, count(*) AS freq FROM subsequences GROUP BY items
HAVING count(*) >= (SELECT ceil(0.01e0 * n) FROM n_days)"""
CTES["split_sequences"] = "SELECT items, freq, unnest(items) AS consequent FROM sequences WHERE len(items) > 1"
CTES["seq_rules"] = """SELECT array_to_string(a.items, '>') AS antecedent, s.consequent, s.freq / CAST(a.freq AS DOUBLE) AS confidence
FROM split_sequences s JOIN sequences a ON a.items = [x FOR x IN s.items IF x <> s.consequent]
WHERE s.freq / CAST(a.freq AS DOUBLE) >= 0.01e0"""


CTES["hull_edges"] = "SELECT * FROM roi_hull_longest WHERE out_rk = 1 AND in_rk = 1"
CTES["hull_boxes"] = """SELECT term, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM hull_edges GROUP BY term"""
CTES["keyword_places"] = """SELECT term, post_id, pos, lon, lat FROM (SELECT tag AS term, post_id, pos, longitude AS lon, latitude AS lat,
  count(*) OVER (PARTITION BY tag) AS n FROM tags WHERE tag IN (SELECT term FROM kept_scores)) WHERE n > 50"""
CTES["hull_hits"] = """SELECT p.post_id, p.username, p.posted_ts, e.term AS poi FROM posts p
JOIN hull_boxes b ON p.longitude BETWEEN b.x0 AND b.x1 AND p.latitude BETWEEN b.y0 AND b.y1
JOIN hull_edges e ON e.term = b.term GROUP BY p.post_id, p.username, p.posted_ts, e.term
HAVING min(((e.b_lon - e.lon) * (p.latitude - e.lat) - (e.b_lat - e.lat) * (p.longitude - e.lon)) / sqrt(e.len)) >= -1e-12"""


def _copy(prefix: str, names: list[str], swaps: dict[str, str]) -> None:
    """Add the chain of tables ``names`` once more under ``prefix``, on other input."""
    keys = {key.split("(")[0]: key for key in CTES}
    renamed = {**{name: prefix + name for name in names}, **swaps}
    word = re.compile(r"\b(" + "|".join(renamed) + r")\b")
    for name in names:
        CTES[prefix + keys[name]] = word.sub(lambda m: renamed[m.group()], CTES[keys[name]])


REGION_CHAIN = (
    "locations pairs near knn curve knn_curve_pos curve_points far_flags eps_by_term near_eps neighbour_counts ids links "
    "core_links spread core_labels labels clusters cluster_sizes largest chosen roi_hull_outer roi_hull_edges "
    "roi_hull_longest hull_edges hull_boxes hull_hits"
).split()
RULE_CHAIN = "visit_rows day_places n_days subsets itemsets split_sets set_rules".split()
_copy("w_", REGION_CHAIN, {"points": "keyword_places"})
_copy("w_", RULE_CHAIN, {"hits": "w_hull_hits"})

# Overlap of a hull and a rectangle: its height is linear between the longitudes
# where either shape bends or their borders cross, so trapezoids give the area.
CTES["bends"] = """SELECT DISTINCT term, x FROM (
  SELECT term, lon AS x FROM hull_edges
  UNION ALL SELECT r.poi, unnest([r.x0, r.x1]) FROM regions r
  UNION ALL SELECT e.term, e.lon + (v.y - e.lat) / (e.b_lat - e.lat) * (e.b_lon - e.lon)
    FROM hull_edges e JOIN (SELECT poi, unnest([y0, y1]) AS y FROM regions) v ON v.poi = e.term
    WHERE (e.lat - v.y) * (e.b_lat - v.y) < 0) t"""
CTES["heights"] = """SELECT t.term, t.x, greatest(0.0e0, least(max(r.y1), max(t.y)) - greatest(max(r.y0), min(t.y))) AS height
FROM (SELECT b.term, b.x, unnest(CASE WHEN e.b_lon = e.lon THEN [e.lat, e.b_lat]
    ELSE [e.lat + (b.x - e.lon) / (e.b_lon - e.lon) * (e.b_lat - e.lat)] END) AS y
  FROM bends b JOIN hull_edges e ON e.term = b.term AND b.x BETWEEN least(e.lon, e.b_lon) AND greatest(e.lon, e.b_lon)) t
JOIN regions r ON r.poi = t.term AND t.x BETWEEN r.x0 AND r.x1 GROUP BY t.term, t.x"""
CTES["slices"] = """SELECT term, height, x, lag(height) OVER (PARTITION BY term ORDER BY x) AS h_before,
  lag(x) OVER (PARTITION BY term ORDER BY x) AS x_before FROM heights"""
CTES["hull_quality"] = """SELECT r.poi, a.term IS NOT NULL AS matched, CASE WHEN a.term IS NOT NULL THEN coalesce(s.tp, 0.0e0) END AS tp,
  a.micro_square_degrees / 1000000.0e0 AS found, (r.x1 - r.x0) * (r.y1 - r.y0) AS real_area
FROM regions r LEFT JOIN roi_hull_area a ON a.term = r.poi
LEFT JOIN (SELECT term, sum((height + h_before) / 2.0e0 * (x - x_before)) AS tp FROM slices GROUP BY term) s ON s.term = r.poi"""

SHARED = set(
    "raw_posts tags bag kept_scores locations pairs near_eps ids core_links far_flags clusters roi_hull_edges "
    "hull_edges day_places itemsets sequences".split()
)


def _statement(select: str) -> str:
    """The select with every table expression it needs, in definition order."""
    names = {key.split("(")[0]: key for key in CTES}
    needed: set[str] = set()
    queue = [select]
    while queue:
        for word in re.findall(r"[a-z_]+", queue.pop()):
            if word in names and word not in needed:
                needed.add(word)
                queue.append(CTES[names[word]])
    parts = [
        f"{names[name]} AS {'MATERIALIZED ' if name.removeprefix('w_') in SHARED else ''}({CTES[names[name]]})"
        for name in names
        if name in needed
    ]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + select


POST_ROWS = """SELECT username, latitude, longitude, strftime(posted_ts, '%b %-d, %Y %-I:%M:%S %p') AS date_posted,
  CAST(CASE WHEN tag_text = '' THEN 0 ELSE len(string_split(tag_text, ' ')) END AS BIGINT) AS n_tags,
  replace(tag_text, ' ', '|') AS tags FROM """
RING_ROWS = "SELECT poi, CAST(5 AS BIGINT) AS vertices, lon_lo, lon_hi, lat_lo, lat_hi FROM boxes"
ROI_AREAS = "SELECT term AS poi, micro_square_degrees FROM roi_hull_area"
SEQUENCE_RULES = "SELECT antecedent, consequent, round(confidence, 6) AS confidence FROM seq_rules"
KEYWORDS = "SELECT term, count(*) AS cells FROM kept_scores GROUP BY term"
CORNERS = ("lon_lo,lat_lo", "lon_hi,lat_lo", "lon_hi,lat_hi", "lon_lo,lat_hi", "lon_lo,lat_lo")
TRIPLES = " || ' ' || ".join(
    "CAST({} AS VARCHAR) || ',' || CAST({} AS VARCHAR) || ',0.0'".format(*corner.split(",")) for corner in CORNERS
)

QUALITY = """SELECT poi, matched, round(tp * 1000000.0e0, 5) AS tp,
  CASE WHEN matched THEN round(greatest(0, found - tp) * 1000000.0e0, 5) END AS fp,
  CASE WHEN matched THEN round(greatest(0, real_area - tp) * 1000000.0e0, 5) END AS fn,
  round(tp / found, 5) AS precision, round(tp / real_area, 5) AS recall,
  round(2.0e0 * tp / (found + real_area), 5) AS f1 FROM """

SELECTS: dict[str, str] = {
    "read_posts_json": POST_ROWS + "posts",
    "read_posts_parquet": POST_ROWS + "posts",
    "read_posts": POST_ROWS + "posts",
    "json_to_parquet": POST_ROWS + "posts",
    "read_terms": "SELECT DISTINCT tag AS term FROM tags",
    "read_roi_kml": RING_ROWS,
    "write_roi_kml": f"""SELECT '<Placemark><name>' || poi || '</name><Style><LineStyle><color>ff0000ff</color></LineStyle>'
  || '<PolyStyle><color>ff0000ff</color></PolyStyle></Style><Polygon><outerBoundaryIs>'
  || '<LinearRing><tessellate>0</tessellate><coordinates>' || {TRIPLES}
  || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS kml FROM boxes""",
    "write_points_kml": f"""SELECT '<Placemark><name>' || poi || '</name><Point><coordinates>'
  || CAST(lon_lo AS VARCHAR) || ',' || CAST(lat_lo AS VARCHAR) || '</coordinates></Point></Placemark>' AS kml FROM boxes""",
    "write_results": KEYWORDS,
    "normalise_posts": POST_ROWS + "raw_posts",
    "valid_posts": "SELECT post_id, latitude, longitude, username FROM posts",
    "term_filter": "SELECT post_id, pos, tag FROM tags WHERE regexp_full_match(tag, '[a-zA-Z]*') AND tag <> 'foto'",
    "explode_tags": "SELECT post_id, pos, tag FROM tags",
    "keyword_points": "SELECT term, lon, lat, post_id, pos FROM points",
    "stop_term_prune": "SELECT post_id, array_to_string([x FOR x IN string_split(tag_text, ' ') IF x NOT IN ({w}) AND {f}], '|') AS tags FROM posts".format(
        w=_list(STOP_WORDS), f=" AND ".join(f"NOT contains(x, '{f}')" for f in STOP_FRAGMENTS)
    ),
    "min_points": "SELECT tag AS term, post_id, pos FROM tags WHERE tag IN (SELECT tag FROM tags GROUP BY tag HAVING count(*) > 50)",
    "grid_cell": "SELECT post_id, cell_y, cell_x, round(c_lat, 9) AS key_latitude, round(c_lon, 9) AS key_longitude FROM centred",
    "cell_tags": f"""SELECT round((cell_y + 1) * {STEP_Y} - 0.5e0 * {STEP_Y}, 9) AS key_latitude,
  round((cell_x + 1) * {STEP_X} - 0.5e0 * {STEP_X}, 9) AS key_longitude, tag, n FROM merged""",
    "merge_lists": "SELECT cell_y, cell_x, tag, n FROM merged",
    "distinct_merge_lists": "SELECT cell_y, cell_x, tag FROM bag",
    "cell_distinct_tags": "SELECT cell_y, cell_x, tag FROM bag",
    "cell_count": "SELECT n_cells FROM n_cells",
    "document_frequency": "SELECT term, df FROM doc_freq",
    "idf": "SELECT term, df, round(idf, 9) AS idf FROM idf_l",
    "idf_topn": "SELECT term, df, round(idf, 9) AS idf FROM idf_t",
    "cell_term_frequency": "SELECT cell_y, cell_x, term, tf FROM tf",
    "doc_raw_tf": "SELECT cell_y, cell_x, tag, n FROM merged WHERE tag <> 'foto'",
    "doc_presence": "SELECT cell_y, cell_x, tag, 1 AS n FROM merged WHERE tag <> 'foto'",
    "log_tf": "SELECT cell_y, cell_x, term, tf, round(1 + ln(tf), 9) AS log_tf FROM tf",
    "relative_tf": """SELECT cell_y, cell_x, term, tf,
  round(tf / CAST(sum(tf) OVER (PARTITION BY cell_y, cell_x) AS DOUBLE), 9) AS relative_tf FROM tf""",
    "tf_histogram": "SELECT tf, n FROM tf_hist",
    "elbow": "SELECT curve, CAST(i AS DOUBLE) AS i, round(d, 9) AS d, CAST(i AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM tag_curve_knee",
    "global_elbow": "SELECT CAST(y AS BIGINT) AS cut FROM tf_curve_knee",
    "local_elbow": "SELECT cell_y, cell_x, term, tf, round(score, 9) AS score FROM kept_scores",
    "keywords_lcurve": KEYWORDS,
    "keywords_tfidf_topn": "SELECT term, count(*) AS cells FROM top_scores WHERE rk <= 10 GROUP BY term",
    "ranked_keywords": """SELECT cell_y, cell_x, term, round(score, 9) AS score,
  CAST(row_number() OVER (PARTITION BY cell_y, cell_x ORDER BY score DESC, term) AS INTEGER) AS rank FROM kept_scores""",
    "term_idf_join": "SELECT tf.cell_y, tf.cell_x, tf.term, tf.tf, round(w.idf, 9) AS idf FROM tf JOIN idf_l w ON w.term = tf.term",
    "pair_distance": "SELECT post_id, round({}, 3) AS metres FROM (SELECT post_id, latitude AS a_lat, longitude AS a_lon, c_lat AS b_lat, c_lon AS b_lon FROM centred)".format(
        _distance("a_", "b_")
    ),
    "degree_metric": f"""SELECT post_id, round(radians(latitude) * {EARTH_RADIUS_KM}e0, 6) AS lat_km,
  round(radians(longitude) * {METRES}, 3) AS lon_m, round(degrees(latitude * 1000.0e0 / {METRES}), 9) AS degrees FROM posts""",
    "knn_distance": "SELECT term, lon, lat, w, round(dist, 3) AS dist FROM knn",
    "eps_threshold": "SELECT term, round(eps, 3) AS eps FROM eps_by_term",
    "eps_elbow": "SELECT term, round(y, 3) AS eps FROM knn_curve_knee",
    "eps_percentile": """SELECT term, round(y, 3) AS eps FROM curve_points
WHERE i = least(CAST(floor(total * 0.3e0) AS BIGINT), total - 1)""",
    "eps_threshold_coarse": "SELECT term, round(eps, 3) AS eps FROM eps_coarse",
    "eps_bootstrap": "SELECT term, round(median(y), 3) AS eps FROM draw_curve_knee GROUP BY term",
    "elbow_min_gap": "SELECT term, CAST(i AS DOUBLE) AS i, round(d, 9) AS d, round(y, 3) AS eps FROM gap_curve_knee",
    "cap_points": f"""SELECT term, post_id, pos FROM (SELECT tag AS term, post_id, pos, row_number() OVER (PARTITION BY tag
  ORDER BY ((post_id % 2147483648) * 1103515245 + 12345) % 2147483648, post_id, pos) AS rk FROM tags
  WHERE tag IN ({_list([*PLACES, "rome"])})) WHERE rk <= 5000""",
    "eps_neighbours": "SELECT term, lon, lat, neighbours FROM neighbour_counts",
    "core_points": "SELECT term, lon, lat, core FROM neighbour_counts",
    "dbscan": "SELECT term, lon, lat, core, label_lat, label_lon FROM clusters",
    "largest_cluster": "SELECT term, label_lat, label_lon, places FROM largest",
    "convex_hull": "SELECT term, micro_square_degrees FROM all_hull_area",
    "convex_hull_vertices": "SELECT term, round(lon, 9) AS lon, round(lat, 9) AS lat FROM all_hull_longest WHERE out_rk = 1 AND in_rk = 1",
    "extract_rois_vertices": "SELECT term AS poi, round(lon, 9) AS lon, round(lat, 9) AS lat FROM hull_edges",
    "hull_close_ring": RING_ROWS,
    "extract_rois": ROI_AREAS,
    "extract_rois_uncapped": ROI_AREAS,
    "point_in_roi": "SELECT post_id, poi FROM hits",
    "roi_within_roi": """SELECT f.poi AS inner_poi, b.poi FROM foto_boxes f JOIN boxes b
ON f.lon_lo >= b.lon_lo AND f.lon_hi <= b.lon_hi AND f.lat_lo >= b.lat_lo AND f.lat_hi <= b.lat_hi""",
    "roi_overlap": "SELECT poi, other_poi, round(area * 1000000.0e0, 6) AS micro_square_degrees FROM box_pairs WHERE area > 0",
    "roi_within_concave": """SELECT f.poi AS inner_poi, b.poi FROM foto_boxes f JOIN boxes b
ON f.lon_lo >= b.lon_lo AND f.lon_hi <= b.lon_hi AND f.lat_lo >= b.lat_lo AND f.lat_hi <= b.lat_hi
AND (f.lon_hi <= (b.lon_lo + b.lon_hi) / 2 OR f.lat_hi <= (b.lat_lo + b.lat_hi) / 2)""",
    "roi_overlap_concave": "SELECT poi, other_poi, round(area * 1000000.0e0, 6) AS micro_square_degrees FROM ell_pairs WHERE round(area * 1000000.0e0, 6) > 0",
    "roi_quality_concave": QUALITY + "ell_quality",
    "within_radius": "SELECT post_id, name, round(d, 3) AS dist FROM (SELECT *, {} AS d FROM (SELECT p.post_id, p.latitude AS a_lat, p.longitude AS a_lon, r.poi AS name, r.x0 AS b_lon, r.y0 AS b_lat FROM posts p CROSS JOIN regions r)) WHERE d <= 150".format(
        _distance("a_", "b_")
    ),
    "bbox_filter": """SELECT post_id FROM posts WHERE latitude BETWEEN 41.88e0 AND 41.9e0
  AND longitude BETWEEN 12.46e0 AND 12.48e0""",
    "bbox_filter_stored": POST_ROWS + "posts WHERE latitude BETWEEN 41.88e0 AND 41.9e0 AND longitude BETWEEN 12.46e0 AND 12.48e0",
    "roi_area": f"""SELECT poi, round((lon_hi - lon_lo) * (lat_hi - lat_lo) * {KM2_PER_SQUARE_DEGREE}e0
  * (sin(radians(lat_hi)) - sin(radians(lat_lo))) / (radians(lat_hi) - radians(lat_lo)), 6) AS area_km2,
  round((lon_hi - lon_lo) * (lat_hi - lat_lo) * {KM2_PER_SQUARE_DEGREE}e0, 6) AS planar_km2 FROM boxes""",
    "roi_quality": QUALITY + "quality",
    "roi_quality_extracted": QUALITY + "hull_quality",
    "visits": "SELECT username, day, poi, ts FROM visit_rows",
    "user_day_places": "SELECT username, day, string_agg(poi, ',' ORDER BY poi) AS places FROM day_places GROUP BY username, day",
    "transactions": "SELECT string_agg(poi, ',' ORDER BY poi) AS items FROM day_places GROUP BY username, day",
    "frequent_itemsets": "SELECT array_to_string(items, ',') AS items, freq FROM itemsets",
    "association_rules": """SELECT antecedent, consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
  round(support, 6) AS support FROM set_rules""",
    "encode_places": "SELECT poi, CAST(row_number() OVER (ORDER BY poi) - 1 AS INTEGER) AS code FROM boxes",
    "user_day_sequences": "SELECT username, day, string_agg(poi, '>' ORDER BY pos) AS sequence FROM ordered GROUP BY username, day",
    "frequent_sequences": "SELECT array_to_string(items, '>') AS items, freq FROM sequences",
    "sequence_rules": SEQUENCE_RULES,
    "mobility_pipeline": """SELECT antecedent, consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
  round(support, 6) AS support FROM w_set_rules""",
    "roi_job": ROI_AREAS,
    "roi_job_vertices": "SELECT term AS poi, round(lon, 9) AS lon, round(lat, 9) AS lat FROM hull_edges",
    "mobility_tables": """SELECT 'keywords' AS table_name, term AS name, CAST(count(*) AS DOUBLE) AS value FROM kept_scores GROUP BY term
UNION ALL SELECT 'rois', term, CAST(count(*) AS DOUBLE) FROM w_hull_edges GROUP BY term
UNION ALL SELECT 'itemsets', array_to_string(items, ','), CAST(freq AS DOUBLE) FROM w_itemsets
UNION ALL SELECT 'rules', antecedent || '=>' || consequent, round(confidence, 6) FROM w_set_rules UNION ALL SELECT 'rejected', 'posts', 0.0e0""",
    "trajectory_tables": """SELECT 'sequences' AS table_name, array_to_string(items, '>') AS name, CAST(freq AS DOUBLE) AS value FROM sequences
UNION ALL SELECT 'sequence_rules', antecedent || '=>' || consequent, round(confidence, 6) FROM seq_rules
UNION ALL SELECT 'itemsets', array_to_string(items, ','), CAST(freq AS DOUBLE) FROM itemsets
UNION ALL SELECT 'rules', antecedent || '=>' || consequent, round(confidence, 6) FROM set_rules""",
    "trajectory_job": SEQUENCE_RULES,
}

ORACLE = {name: _statement(select) for name, select in SELECTS.items()}
