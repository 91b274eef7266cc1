"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Every statement rebuilds the trajectory fixture from the driver's tables as
CTEs and computes the operator with plain SQL (window functions, joins,
aggregates), without any code shared with the Spark side. Doubles are rounded
to 6 digits and -0.0 is folded to 0.0, as in the Spark queries.
"""

from __future__ import annotations


def R(e: str) -> str:
    x = f"CAST({e} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1e6 + 0.5) / 1e6 + 0.0 ELSE {x} END)"


def _rad(x: str) -> str:
    return f"radians({x})"


def _hav(lng1, lat1, lng2, lat2) -> str:
    a = (f"(pow(sin(({_rad(lat2)} - {_rad(lat1)}) / 2), 2) + cos({_rad(lat1)}) * cos({_rad(lat2)}) "
         f"* pow(sin(({_rad(lng2)} - {_rad(lng1)}) / 2), 2))")
    return f"(2 * asin(CASE WHEN sqrt({a}) > 1 THEN 1.0 ELSE sqrt({a}) END) * 6371000.0)"


def _azi(lat1, lon1, lat2, lon2) -> str:
    r = lambda v: f"(({v}) * pi() / 180.0)"
    y = f"(sin({r(lon2)} - {r(lon1)}) * cos({r(lat2)}))"
    x = f"(cos({r(lat1)}) * sin({r(lat2)}) - sin({r(lat1)}) * cos({r(lat2)}) * cos({r(lon2)} - {r(lon1)}))"
    return f"((atan2({y}, {x}) * 180.0 / pi() + 360.0) % 360.0)"


def _clip(e, lo, hi) -> str:
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE greatest(least({e}, {hi}), {lo}) END)"


NORM = ["tod", "lng", "lat", "speed", "acceleration", "heading_angle"]

BASE = f"""
ev AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
tr0 AS (
  SELECT event_id, us,
         CASE WHEN user_id % 10 = 0 THEN 1000000 + (user_id // 30)
              ELSE user_id * 10 + (us - 1704067200000000) // 345600000000 END AS trip
  FROM ev),
trips AS (
  SELECT trip, event_id AS seq_i,
         1704067200 + (trip % 168) * 3600 + ((us - 1704067200000000) // 10000000000) * 10 AS secs,
         (event_id * 7919) % 97 AS road,
         CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS road_prop,
         CASE WHEN event_id % 997 = 0 THEN NULL
              ELSE CAST(104.0 AS DOUBLE) + CAST((event_id * 7919) % 1000 AS DOUBLE) / 50000 END AS lng,
         CAST(30.6 AS DOUBLE) + CAST((event_id * 104729) % 1000 AS DOUBLE) / 50000 AS lat
  FROM tr0),
pts AS (
  SELECT *, CAST(secs AS DOUBLE) AS seconds,
         CAST(secs % 86400 AS DOUBLE) / 86400 AS tod,
         CAST(((secs // 86400) + 3) % 7 AS INTEGER) AS weekday,
         CAST((secs % 86400) // 3600 AS INTEGER) AS hour
  FROM trips),
trip_info AS (
  SELECT trip, trip % 50 AS driver, row_number() OVER (ORDER BY trip) - 1 AS ord, count(*) OVER () AS ntrips
  FROM (SELECT DISTINCT trip FROM trips)),
split_info AS (
  SELECT trip, driver, ord,
         CAST(CASE WHEN ord < CAST(floor(CAST(ntrips AS DOUBLE) * 0.8) AS BIGINT) THEN 0
                   WHEN ord < CAST(floor(CAST(ntrips AS DOUBLE) * 0.9) AS BIGINT) THEN 1 ELSE 2 END AS INTEGER) AS split
  FROM trip_info),
road_info AS (
  SELECT road, CAST(104.0 AS DOUBLE) + CAST(road AS DOUBLE) / 5000 AS lng,
         CAST(30.6 AS DOUBLE) + CAST(96 - road AS DOUBLE) / 5000 AS lat
  FROM (SELECT DISTINCT road FROM trips)),
pois AS (
  SELECT s_suppkey AS poi_id, s_name AS name, concat('District ', s_nationkey) AS address,
         CAST(104.0 AS DOUBLE) + CAST((s_suppkey * 6151) % 1000 AS DOUBLE) / 50000 AS lng,
         CAST(30.6 AS DOUBLE) + CAST((s_suppkey * 3571) % 1000 AS DOUBLE) / 50000 AS lat
  FROM supplier),
pois_large AS (
  SELECT c_custkey AS poi_id, c_name AS name, concat('District ', c_nationkey) AS address,
         CAST(104.0 AS DOUBLE) + CAST((c_custkey * 6151) % 1000 AS DOUBLE) / 50000 AS lng,
         CAST(30.6 AS DOUBLE) + CAST((c_custkey * 3571) % 1000 AS DOUBLE) / 50000 AS lat
  FROM customer),
m1 AS (
  SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat, lag(seconds) OVER w AS ps,
         CAST(row_number() OVER w - 1 AS INTEGER) AS pos0,
         CAST(count(*) OVER (PARTITION BY trip) AS INTEGER) AS n0
  FROM pts WINDOW w AS (PARTITION BY trip ORDER BY seconds, seq_i)),
m2 AS (
  SELECT *, seconds - ps AS dt,
         CASE WHEN pos0 = 0 THEN 0.0
              WHEN seconds - ps > 0 THEN {_clip(_hav('lng', 'lat', 'plng', 'plat') + ' / (seconds - ps)', -33.33, 33.33)}
              ELSE 0.0 END AS speed,
         CASE WHEN pos0 > 0 THEN {_azi('lng', 'lat', 'plng', 'plat')} END AS h
  FROM m1),
motion AS (
  SELECT *,
         CASE WHEN pos0 = 0 THEN 0.0
              WHEN dt > 0 THEN {_clip('(speed - lag(speed) OVER w) / dt', -3.0, 3.0)}
              ELSE 0.0 END AS acceleration,
         CASE WHEN pos0 > 0 THEN h WHEN n0 > 1 THEN lead(h) OVER w ELSE 0.0 END AS heading_angle
  FROM m2 WINDOW w AS (PARTITION BY trip ORDER BY seconds, seq_i)),
validity AS (
  SELECT trip, count(*) AS length,
         sum(CASE WHEN lng IS NULL OR lat IS NULL OR road IS NULL OR road_prop IS NULL THEN 1 ELSE 0 END) AS nulls
  FROM trips GROUP BY trip),
valid AS (
  SELECT v.trip, s.split, v.length FROM validity v JOIN split_info s USING (trip)
  WHERE v.nulls = 0 AND v.length BETWEEN 6 AND 120),
vp AS (
  SELECT m.*, v.split, m.pos0 AS pos, m.n0 AS n FROM motion m JOIN valid v USING (trip)),
nstat AS (
  SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in NORM)} FROM motion),
tf AS (
  SELECT vp.split, vp.trip, vp.pos, vp.n,
         {", ".join(
             f"CASE WHEN mx_{c} = mn_{c} THEN NULL ELSE (COALESCE(vp.{c}, 0.0) - mn_{c}) / (mx_{c} - mn_{c}) * 2 - 1 END AS {c}"
             for c in NORM)},
         CAST(vp.road AS DOUBLE) AS road, vp.road_prop, CAST(vp.weekday AS DOUBLE) AS weekday,
         CAST(vp.seq_i AS DOUBLE) AS seq_i, vp.seconds,
         CASE WHEN max(vp.seconds) OVER t = min(vp.seconds) OVER t THEN NULL
              ELSE (vp.seconds - min(vp.seconds) OVER t) / (max(vp.seconds) OVER t - min(vp.seconds) OVER t) * 2 - 1
         END AS "offset"
  FROM vp CROSS JOIN nstat WINDOW t AS (PARTITION BY vp.trip)),
hop AS (
  SELECT trip, split, CAST(idx AS INTEGER) AS idx FROM (
    SELECT trip, split, row_number() OVER (PARTITION BY split ORDER BY trip) - 1 AS idx,
           count(*) OVER (PARTITION BY split) AS cnt FROM valid)
  WHERE idx < least(cnt - 1, {{hop_n}})),
hq AS (
  SELECT tf.*, h.idx, CASE WHEN tf.pos % 2 = 0 THEN 'qry' ELSE 'tgt' END AS role,
         CAST(tf.pos // 2 AS INTEGER) AS sub_pos
  FROM tf JOIN hop h USING (trip, split))
"""

FEATURES = ["tod", "road", "road_prop", "lng", "lat", "weekday", "seq_i", "seconds", "speed",
            "acceleration", "heading_angle", "offset"]
NUMERIC = ["trip", "road", "road_prop", "lng", "lat", "seq_i", "seconds", "tod", "weekday",
           "speed", "acceleration", "heading_angle"]


def _knn_cte(name: str, queries: str, table: str, k: int) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT q.qid, p.poi_id, p.name, p.address,
           (p.lng - q.lng) * (p.lng - q.lng) + (p.lat - q.lat) * (p.lat - q.lat) AS dist2,
           CAST(row_number() OVER (PARTITION BY q.qid ORDER BY
                (p.lng - q.lng) * (p.lng - q.lng) + (p.lat - q.lat) * (p.lat - q.lat), p.poi_id) - 1 AS INTEGER) AS rank
    FROM ({queries}) q CROSS JOIN {table} p
    WHERE q.lng IS NOT NULL AND q.lat IS NOT NULL)
  WHERE rank < {k})"""


def _odpois_ctes(k: int, pre: int = 0, momentum: bool = False) -> str:
    if momentum and pre >= 1:
        dsrc = f"""SELECT a.trip, 'd' AS "end",
                   a.lng + CASE WHEN a.seconds = b.seconds THEN NULL ELSE {pre}.0 / (a.seconds - b.seconds) END * (a.lng - b.lng) AS lng,
                   a.lat + CASE WHEN a.seconds = b.seconds THEN NULL ELSE {pre}.0 / (a.seconds - b.seconds) END * (a.lat - b.lat) AS lat
                 FROM vp a JOIN vp b ON a.trip = b.trip AND a.pos = a.n - 2 - {pre} AND b.pos = a.n - 3 - {pre}"""
    else:
        dsrc = f"""SELECT trip, 'd' AS "end", lng, lat FROM vp WHERE pos = n - 2 - {pre}"""
    return f""",
od AS (
  SELECT trip, 'o' AS "end", lng, lat FROM vp WHERE pos = 0
  UNION ALL {dsrc}),
odq AS (SELECT trip * 2 + CASE WHEN "end" = 'd' THEN 1 ELSE 0 END AS qid, trip, "end", lng, lat FROM od),
{_knn_cte('odnb', 'SELECT qid, lng, lat FROM odq', 'pois', k)},
odtxt AS (
  SELECT qid, concat(max(CASE WHEN rank = 0 THEN address END),
                     string_agg(name, '、' ORDER BY rank)) AS text
  FROM odnb GROUP BY qid),
odpois AS (
  SELECT v.split, v.trip,
         max(CASE WHEN q."end" = 'o' THEN t.text END) AS o_text,
         max(CASE WHEN q."end" = 'd' THEN t.text END) AS d_text
  FROM valid v JOIN odq q USING (trip) LEFT JOIN odtxt t USING (qid)
  GROUP BY v.split, v.trip)"""


def _sql(final: str, extra: str = "", hop_n: int = 5) -> str:
    return "WITH " + BASE.replace("{hop_n}", str(hop_n)).strip() + extra + "\n" + final


KSEG_CTE = """,
kseg AS (
  SELECT split, trip, seg, avg(lng) AS lng, avg(lat) AS lat FROM (
    SELECT split, trip, lng, lat,
           CAST(CASE WHEN n // {k} = 0 THEN {k} - 1 ELSE least(pos // (n // {k}), {k} - 1) END AS INTEGER) AS seg
    FROM {src}) GROUP BY split, trip, seg)"""


def _kseg(k: int, src: str = "tf", name: str = "kseg") -> str:
    return KSEG_CTE.replace("kseg AS", f"{name} AS").replace("{k}", str(k)).replace("{src}", src)


# Vectors as (split, trip, d, v): dimension d = 2 seg + (0 lng, 1 lat).
def _kvec(name: str, kseg_name: str) -> str:
    return f""",
{name} AS (
  SELECT split, trip, seg * 2 AS d, lng AS v FROM {kseg_name}
  UNION ALL SELECT split, trip, seg * 2 + 1 AS d, lat AS v FROM {kseg_name})"""


EMB = """,
emb AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(u.v AS DOUBLE) AS v, CAST(u.i - 1 AS INTEGER) AS i
        FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) u),
cent AS (SELECT label AS cls, i, sum(v) / greatest(CAST(count(v) AS DOUBLE), 1e-9) AS c FROM emb GROUP BY label, i),
escore AS (
  SELECT e.vec_id AS id, c.cls, -sqrt(sum((e.v - c.c) * (e.v - c.c))) AS score
  FROM emb e JOIN cent c ON e.i = c.i GROUP BY e.vec_id, c.cls),
elabel AS (SELECT DISTINCT vec_id AS id, label FROM emb)"""

CLS_METRICS = """,
pred AS (SELECT id, arg_max(cls, score * 1e0) AS pred0 FROM escore GROUP BY id),
pred2 AS (
  SELECT id, min(cls) AS pred FROM (
    SELECT s.id, s.cls FROM escore s JOIN (SELECT id, max(score) AS ms FROM escore GROUP BY id) m
      ON s.id = m.id AND s.score = m.ms) GROUP BY id),
trank AS (
  SELECT s.id, CAST(1 + sum(CASE WHEN s.score > t.score OR (s.score = t.score AND s.cls > t.cls) THEN 1 ELSE 0 END) AS BIGINT) AS rank
  FROM escore s JOIN (SELECT e.id, e.cls, e.score FROM escore e JOIN elabel l ON e.id = l.id AND e.cls = l.label) t
    ON s.id = t.id GROUP BY s.id),
per AS (SELECT l.id, l.label, p.pred, r.rank FROM elabel l JOIN pred2 p USING (id) JOIN trank r USING (id)),
pc AS (
  SELECT c, sum(n_true) AS n_true, sum(tp) AS tp, sum(n_pred) AS n_pred FROM (
    SELECT label AS c, 1 AS n_true, CASE WHEN pred = label THEN 1 ELSE 0 END AS tp, 0 AS n_pred FROM per
    UNION ALL SELECT pred AS c, 0, 0, 1 FROM per) GROUP BY c)"""


def _cls_final(ns=(5, 10)) -> str:
    accs = ", ".join(f"{R(f'avg(CASE WHEN rank <= {n} THEN 1.0 ELSE 0.0 END)')} AS \"acc@{n}\"" for n in ns)
    return f"""SELECT {R('h.mean_rank')} AS mean_rank, {R('m.macro_f1')} AS macro_f1, {R('m.macro_rec')} AS macro_rec,
       {R('h.acc1')} AS "acc@1", {', '.join(f'h."acc@{n}"' for n in ns)}, (SELECT count(*) FROM elabel) - h.n AS unscored
FROM (SELECT count(*) AS n, avg(rank) AS mean_rank, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc1, {accs} FROM per) h,
     (SELECT avg(CASE WHEN n_true + n_pred > 0 THEN 2.0 * tp / (n_true + n_pred) ELSE 0.0 END) AS macro_f1,
             avg(CASE WHEN n_true > 0 THEN 1.0 * tp / n_true ELSE 0.0 END) AS macro_rec FROM pc) m"""


_FARTHEST = """negs AS (
  SELECT f.split, f.qid AS trip, f.item AS neg_trip, f.neg_idx
  FROM far f JOIN ssize s USING (split) JOIN qsize q USING (split)
  WHERE f.neg_idx <= least(s.t - q.nq, {m}))"""
# Seeded: the M trips that follow the query's place in the split's md5 order, round the end.
def _rounds() -> str:
    """The keyed permutation of steps 0..a*b-1: six rounds over (l, r), l < a and r < b."""
    sql = "SELECT *, step % a AS l, step // a AS r FROM walk"
    for i in range(6):
        to, of, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        sql = f"SELECT *, CAST(concat('0x', substr(md5(concat('{{seed}}:{i}:', qid)), 1, 7)) AS BIGINT) AS k FROM ({sql})"
        sql = f"SELECT *, ({of} + k) % 2147483647 AS v0 FROM ({sql})"
        sql = f"SELECT *, (v0 * v0 + k) % 2147483647 AS v1 FROM ({sql})"
        sql = f"SELECT * EXCLUDE (k, v0, v1) REPLACE (({to} + v1 * v1 % 2147483647) % {size} AS {to}) FROM ({sql})"
    return sql


_UNIFORM = """place AS (SELECT split, trip AS item, row_number() OVER (PARTITION BY split ORDER BY trip) - 1 AS at FROM valid),
dims AS (SELECT split, t, CAST(ceil(sqrt(t)) AS BIGINT) AS a, (t + CAST(ceil(sqrt(t)) AS BIGINT) - 1) // CAST(ceil(sqrt(t)) AS BIGINT) AS b FROM ssize),
walk AS (SELECT q.split, q.qid, d.t, d.a, d.b, greatest(0, least(d.t - n.nq, {m})) AS m, unnest(generate_series(0, d.a * d.b - 1)) AS step
         FROM hopq q JOIN dims d USING (split) JOIN qsize n USING (split)),
walked AS (SELECT split, qid, t, m, step, r * a + l AS at FROM ({rounds})),
pick AS (
  SELECT w.split, w.qid, p.item, w.m, w.step FROM walked w JOIN place p ON p.split = w.split AND p.at = w.at
  WHERE CASE WHEN w.t <= 10 THEN EXISTS (SELECT 1 FROM far f WHERE f.split = w.split AND f.qid = w.qid AND f.item = p.item AND f.neg_idx <= w.m)
        ELSE NOT EXISTS (SELECT 1 FROM near x WHERE x.split = w.split AND x.qid = w.qid AND x.item = p.item) END),
negs AS (
  SELECT split, qid AS trip, item AS neg_trip, neg_idx FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY split, qid ORDER BY step) AS INTEGER) AS neg_idx FROM pick) WHERE neg_idx <= m)"""


def _search_ctes(seed: int | None = None, m: int = 5) -> str:
    """Search over kseg(6) selection and kseg(3) vectors; farthest negatives, or seeded ones."""
    return _kseg(6) + _kvec("kv", "kseg") + f""",
hopq AS (SELECT split, trip AS qid FROM hop),
pd AS (
  SELECT q.split, q.qid, i.trip AS item, sqrt(sum((i.v - qv.v) * (i.v - qv.v))) AS dist
  FROM hopq q JOIN kv qv ON qv.split = q.split AND qv.trip = q.qid
  JOIN kv i ON i.split = q.split AND i.d = qv.d
  GROUP BY q.split, q.qid, i.trip),
near AS (
  SELECT split, qid, item FROM (
    SELECT *, row_number() OVER (PARTITION BY split, qid ORDER BY dist, item) AS r FROM pd) WHERE r <= 10),
ssize AS (SELECT split, count(*) AS t FROM valid GROUP BY split),
qsize AS (SELECT split, count(*) AS nq FROM hop GROUP BY split),
far AS (
  SELECT p.split, p.qid, p.item, p.dist,
         CAST(row_number() OVER (PARTITION BY p.split, p.qid ORDER BY p.dist DESC, p.item) AS INTEGER) AS neg_idx
  FROM pd p JOIN ssize s USING (split)
  WHERE s.t <= 10 OR NOT EXISTS (SELECT 1 FROM near x WHERE x.split = p.split AND x.qid = p.qid AND x.item = p.item)),
""" + (_FARTHEST if seed is None else _UNIFORM.replace("{rounds}", _rounds())).replace("{m}", str(m)).replace("{seed}", str(seed)) + _kseg(3, "tf", "k3") + _kvec("v3", "k3") + _kseg(
        3, "(SELECT split, trip || ':' || role AS trip, lng, lat, sub_pos AS pos, "
           "count(*) OVER (PARTITION BY trip, role) AS n FROM hq)", "k3h") + _kvec("v3h", "k3h") + """,
scores AS (
  SELECT q.split, CAST(split_part(q.trip, ':', 1) AS BIGINT) AS qid, 0 AS cls,
         -sqrt(sum((q.v - t.v) * (q.v - t.v))) AS score
  FROM v3h q JOIN v3h t ON q.split = t.split AND split_part(q.trip, ':', 1) = split_part(t.trip, ':', 1) AND q.d = t.d
  WHERE split_part(q.trip, ':', 2) = 'qry' AND split_part(t.trip, ':', 2) = 'tgt'
  GROUP BY q.split, q.trip
  UNION ALL
  SELECT n.split, n.trip AS qid, n.neg_idx AS cls, -sqrt(sum((q.v - i.v) * (q.v - i.v))) AS score
  FROM negs n JOIN v3h q ON q.split = n.split AND q.trip = n.trip || ':qry'
  JOIN v3 i ON i.split = n.split AND i.trip = n.neg_trip AND i.d = q.d
  GROUP BY n.split, n.trip, n.neg_idx)"""


ORACLE_SQL: dict[str, str] = {}


def _add(key: str, sql: str) -> None:
    ORACLE_SQL[key] = sql


_add("load_trips", _sql(f"SELECT trip, seq_i, {R('seconds')} AS seconds, road, {R('road_prop')} AS road_prop, "
                        f"{R('lng')} AS lng, {R('lat')} AS lat FROM pts"))
_add("load_pois", _sql(f"SELECT poi_id, name, address, {R('lng')} AS lng, {R('lat')} AS lat FROM pois"))
_add("point_time_features", _sql(f"SELECT trip, seq_i, {R('seconds')} AS seconds, {R('tod')} AS tod, weekday, hour FROM pts"))
_add("trip_start_context", _sql("SELECT trip, weekday AS start_weekday, hour AS start_hour FROM m1 WHERE pos0 = 0"))
_motion_sel = (f"SELECT trip, seq_i, {R('speed')} AS speed, {R('acceleration')} AS acceleration, "
               f"{R('heading_angle')} AS heading_angle FROM motion")
_add("speed_accel_heading", _sql(_motion_sel))
_add("speed_accel_heading_chunked", _sql(_motion_sel))
_unpiv = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM motion" for c in NUMERIC)
_add("describe_points", _sql(
    f"""SELECT "column", count(value) AS count, {R('avg(value)')} AS mean,
       {R('sqrt(sum((value - mu) * (value - mu)) / (count(value) - 1))')} AS std,
       {R('min(value)')} AS min, {R('max(value)')} AS max,
       {R('quantile_cont(value, 0.25)')} AS p25, {R('quantile_cont(value, 0.5)')} AS p50,
       {R('quantile_cont(value, 0.75)')} AS p75
FROM (SELECT *, avg(value) OVER (PARTITION BY "column") AS mu FROM ({_unpiv}) WHERE value IS NOT NULL)
GROUP BY "column" """))
_add("cardinalities", _sql("SELECT (SELECT max(road) + 1 FROM road_info) AS num_road, "
                           "(SELECT max(driver) + 1 FROM trip_info) AS num_class"))
_add("trip_counts", _sql("SELECT (SELECT count(*) FROM trip_info) AS num_trips, "
                         "(SELECT count(DISTINCT trip) FROM trips) AS distinct_trips"))
_add("trip_lengths", _sql("SELECT trip, count(*) AS length FROM trips GROUP BY trip"))
_add("trip_endpoints", _sql(
    "SELECT trip, " + ", ".join(
        f"{R(f'max(CASE WHEN pos0 = 0 THEN {c} END)')} AS first_{c}, "
        f"{R(f'max(CASE WHEN pos0 = n0 - 1 THEN {c} END)')} AS last_{c}" for c in ("lng", "lat", "seconds"))
    + " FROM m1 GROUP BY trip"))
_add("bounding_box", _sql(f"SELECT {R('min(lng)')} AS min_lng, {R('max(lng)')} AS max_lng, "
                          f"{R('min(lat)')} AS min_lat, {R('max(lat)')} AS max_lat FROM trips"))
_add("train_val_test_split", _sql("SELECT trip, driver, split FROM split_info"))
_add("row_ordinal", _sql("SELECT trip, ord AS ordinal FROM trip_info"))
_add("valid_trips", _sql("SELECT trip, split, length FROM valid"))
_add("trips_in_split", _sql("SELECT t.trip, t.seq_i, s.split FROM trips t JOIN split_info s USING (trip)"))
_add("known_trips", _sql("SELECT trip, split FROM valid WHERE split IN (0, 1)"))
_add("prefix_sample", _sql(
    "SELECT trip, split FROM (SELECT trip, split, row_number() OVER (PARTITION BY split ORDER BY trip) - 1 AS o, "
    "count(*) OVER (PARTITION BY split) AS c FROM valid) WHERE o < floor(CAST(c AS DOUBLE) * 0.5)"))
_add("truncate_trip", _sql("SELECT trip, pos FROM vp WHERE pos < n - 5"))
_add("valid_mask", _sql(
    "SELECT trip, CAST(length AS INTEGER) AS n_true, CAST(max(length) OVER (PARTITION BY split) - length AS INTEGER) AS n_false "
    "FROM valid"))
_add("batch_assign", _sql(
    "SELECT trip, split, batch_id FROM (SELECT trip, split, b AS batch_id, count(*) OVER (PARTITION BY split, b) AS bs FROM "
    "(SELECT trip, split, (row_number() OVER (PARTITION BY split ORDER BY trip) - 1) // 16 AS b FROM valid)) WHERE bs > 1"))
_add("trip_features", _sql(
    "SELECT split, trip, pos, n, " + ", ".join(f'{R(c if c != "offset" else chr(34) + "offset" + chr(34))} AS "{c}"'
                                               for c in FEATURES) + " FROM tf"))
_add("trip_offset", _sql(
    f"""SELECT trip, seq_i, {R('CASE WHEN max(seconds) OVER t = min(seconds) OVER t THEN NULL '
                               'ELSE (seconds - min(seconds) OVER t) / (max(seconds) OVER t - min(seconds) OVER t) * 2 - 1 END')} AS "offset"
FROM pts WINDOW t AS (PARTITION BY trip)"""))
_add("fill_missing", _sql(
    f"SELECT trip, seq_i, {R('COALESCE(lng, 0.0)')} AS lng, {R('COALESCE(speed, 0.0)')} AS speed, "
    f"{R('COALESCE(heading_angle, 0.0)')} AS heading_angle FROM motion"))
_add("trip_sequences", _sql(
    f"SELECT split, trip, CAST(count(*) AS INTEGER) AS length, {R('sum(lng)')} AS sum_lng, {R('sum(speed)')} AS sum_speed, "
    f"{R('max(CASE WHEN pos = n - 1 THEN road END)')} AS last_road FROM tf GROUP BY split, trip"))
_add("normalize_zscore", _sql(
    "SELECT trip, pos, " + ", ".join(
        f"{R(f'CASE WHEN sd_{c} = 0 THEN NULL ELSE ({c} - av_{c}) / sd_{c} END')} AS {c}" for c in NORM)
    + " FROM vp CROSS JOIN (SELECT " + ", ".join(f"avg({c}) AS av_{c}, stddev_samp({c}) AS sd_{c}" for c in NORM)
    + " FROM motion)"))
_add("denormalize", _sql(
    f"SELECT trip, pos, {R('(lng + 1) / 2 * (mx_lng - mn_lng) + mn_lng')} AS lng, "
    f"{R('(lat + 1) / 2 * (mx_lat - mn_lat) + mn_lat')} AS lat FROM tf CROSS JOIN nstat"))
_add("normalize_minmax", _sql("SELECT trip, pos, " + ", ".join(
    f"{R(f'CASE WHEN mx_{c} = mn_{c} THEN NULL ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) * 2 - 1 END')} AS {c}" for c in NORM)
    + " FROM vp CROSS JOIN nstat"))
_add("scale_unit", _sql(
    f"""SELECT trip, pos, {R('(speed - lo) / (hi - lo)')} AS speed, {R('(acceleration - lo) / (hi - lo)')} AS acceleration
FROM vp CROSS JOIN (SELECT least(min(speed), min(acceleration)) AS lo, greatest(max(speed), max(acceleration)) AS hi
                    FROM vp)"""))
_pairs = ("(SELECT trip, pos, lng, lat, lead(lng) OVER w AS next_lng, lead(lat) OVER w AS next_lat, "
          "lead(pos) OVER w AS np FROM vp WINDOW w AS (PARTITION BY trip ORDER BY pos))")
_add("haversine", _sql(f"SELECT trip, pos, {R(_hav('lng', 'lat', 'next_lng', 'next_lat'))} AS dist_m FROM {_pairs} WHERE np IS NOT NULL"))
_add("azimuth", _sql(f"SELECT trip, pos, {R(_azi('lat', 'lng', 'next_lat', 'next_lng'))} AS bearing FROM {_pairs} WHERE np IS NOT NULL"))
_GRID = """,
gdim AS (SELECT x0, x1, y0, y1, CAST(ceil((x1 - x0) / 0.0015) AS BIGINT) AS num_w,
                CAST(ceil((y1 - y0) / 0.0015) AS BIGINT) AS num_h
         FROM (SELECT min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM trips))"""


def _gidx(v, lo, hi, n):
    raw = f"(ceil(CASE WHEN {hi} = {lo} THEN NULL ELSE ({v} - {lo}) / ({hi} - {lo}) END * {n}) - 1)"
    return f"CAST(CASE WHEN {raw} IS NULL THEN NULL ELSE greatest(least({raw}, {n} - 1), 0) END AS BIGINT)"


_add("grid_project", _sql(
    f"SELECT trip, seq_i, CAST({_gidx('lat', 'y0', 'y1', 'num_h')} * num_w + {_gidx('lng', 'x0', 'x1', 'num_w')} AS DOUBLE) AS grid_road "
    "FROM trips CROSS JOIN gdim", _GRID))
_add("grid_cells", _sql(
    f"SELECT CAST(r AS BIGINT) AS road, {R('(r % num_w) * 0.0015 + 0.0015 / 2 + x0')} AS lng, "
    f"{R('(r // num_w) * 0.0015 + 0.0015 / 2 + y0')} AS lat "
    "FROM gdim CROSS JOIN (SELECT unnest(generate_series(0, (SELECT num_w * num_h - 1 FROM gdim))) AS r)", _GRID))
_add("model_features", _sql(
    "SELECT trip, pos, " + R("road") + " AS road, " + R("weekday") + " AS weekday, "
    "CAST((CAST(seconds AS BIGINT) % 86400) // 3600 AS INTEGER) AS hour, "
    + ", ".join(f"{R(c)} AS {c}" for c in NORM) + " FROM tf"))
_D = 8
_add("cosine_encoding", _sql(
    f"SELECT trip, pos, CAST(i AS INTEGER) AS i, {R(f'sqrt(1.0 / {_D}) * cos(tod * pow(10.0, -i * {9.0 / (_D - 1)!r}))')} AS value "
    f"FROM tf CROSS JOIN (SELECT unnest(generate_series(0, {_D - 1})) AS i)"))
_add("position_encoding", _sql(
    f"SELECT CAST(p AS INTEGER) AS pos, CAST(i AS INTEGER) AS i, "
    f"{R(f'CASE WHEN i % 2 = 0 THEN sin(p * exp(-(i - i % 2) * {__import__('math').log(10000.0) / _D!r})) ELSE cos(p * exp(-(i - i % 2) * {__import__('math').log(10000.0) / _D!r})) END')} AS value "
    f"FROM (SELECT unnest(generate_series(0, (SELECT max(length) - 1 FROM valid))) AS p) "
    f"CROSS JOIN (SELECT unnest(generate_series(0, {_D - 1})) AS i)"))
_half = _D // 2
_kt = __import__("math").log(10000.0) / (_half - 1)
_add("time_encoding", _sql(
    f"SELECT trip, pos, CAST(i AS INTEGER) AS i, "
    f"{R(f'CASE WHEN i < {_half} THEN sin(tod * 100 * exp(-i * {_kt!r})) ELSE cos(tod * 100 * exp(-(i - {_half}) * {_kt!r})) END')} AS value "
    f"FROM tf CROSS JOIN (SELECT unnest(generate_series(0, {_D - 1})) AS i)"))
_add("attach_road_coords", _sql(
    f"SELECT t.trip, t.seq_i, {R('r.lng')} AS road_lng, {R('r.lat')} AS road_lat FROM trips t LEFT JOIN road_info r USING (road)"))
_add("knn_poi", _sql(f"SELECT qid AS trip, rank, poi_id, {R('sqrt(dist2)')} AS dist FROM nb",
                     ",\n" + _knn_cte("nb", "SELECT trip AS qid, lng, lat FROM vp WHERE pos = 0", "pois", 3)))
_add("knn_poi_grid", _sql(f"SELECT qid AS trip, rank, poi_id, {R('sqrt(dist2)')} AS dist FROM nb",
                          ",\n" + _knn_cte("nb", "SELECT trip AS qid, lng, lat FROM vp WHERE pos = 0", "pois_large", 3)))
_add("od_pois", _sql("SELECT split, trip, o_text, d_text FROM odpois", _odpois_ctes(3)))
_add("od_pois_momentum", _sql("SELECT split, trip, o_text, d_text FROM odpois", _odpois_ctes(3, 2, True)))
_add("extrapolate_trip", _sql(
    f"""SELECT a.trip, CAST(s AS INTEGER) AS step,
       {R('a.lng + CASE WHEN a.seconds = b.seconds THEN NULL ELSE s / (a.seconds - b.seconds) END * (a.lng - b.lng)')} AS lng,
       {R('a.lat + CASE WHEN a.seconds = b.seconds THEN NULL ELSE s / (a.seconds - b.seconds) END * (a.lat - b.lat)')} AS lat,
       {R('a.seconds + s * (a.seconds - b.seconds)')} AS seconds
FROM vp a JOIN vp b ON a.trip = b.trip AND a.pos = a.n - 4 AND b.pos = a.n - 5
CROSS JOIN (SELECT unnest(generate_series(1, 2)) AS s)"""))
_add("destination_labels", _sql("SELECT split, trip, CAST(road AS BIGINT) AS destination FROM tf WHERE pos = n - 1"))
_add("tte_labels", _sql(f"SELECT split, trip, {R('max(seconds) - min(seconds)')} AS tte FROM tf GROUP BY split, trip"))
_add("driver_labels", _sql("SELECT v.split, v.trip, s.driver FROM valid v JOIN split_info s USING (trip)"))
_TV = _odpois_ctes(3) + """,
tv AS (
  SELECT v.split, v.trip, v.length, CAST(f.weekday AS INTEGER) AS start_weekday,
         CAST((CAST(f.seconds AS BIGINT) % 86400) // 3600 AS INTEGER) AS start_hour,
         o.o_text, o.d_text, CAST(l.road AS BIGINT) AS destination, f2.tte
  FROM valid v JOIN tf f ON f.trip = v.trip AND f.pos = 0
  JOIN odpois o ON o.trip = v.trip
  JOIN tf l ON l.trip = v.trip AND l.pos = l.n - 1
  JOIN (SELECT trip, max(seconds) - min(seconds) AS tte FROM tf GROUP BY trip) f2 ON f2.trip = v.trip)"""
_add("training_view", _sql(
    f"SELECT split, trip, length, start_weekday, start_hour, o_text, d_text, destination, {R('tte')} AS tte, driver, "
    f"{R('sum_lng')} AS sum_lng, {R('sum_hour')} AS sum_hour FROM tv JOIN split_info USING (trip, split) JOIN (SELECT trip, sum(lng) AS sum_lng, "
    "sum(CAST((CAST(seconds AS BIGINT) % 86400) // 3600 AS DOUBLE)) AS sum_hour FROM tf GROUP BY trip) USING (trip)", _TV))
_add("kseg_resample", _sql(
    f"""SELECT g.split, g.trip, CAST(g.seg AS INTEGER) AS seg, {R('k.lng')} AS lng, {R('k.lat')} AS lat
FROM (SELECT split, trip, unnest(generate_series(0, 5)) AS seg FROM valid) g
LEFT JOIN kseg k ON k.trip = g.trip AND k.seg = g.seg""", _kseg(6)))
_add("trip_vectors", _sql(f"SELECT split, trip, CAST(d AS INTEGER) AS i, {R('v')} AS value FROM kv3",
                          _kseg(3, "tf", "k3") + _kvec("kv3", "k3")))
_add("next_point_pairs", _sql(
    f"SELECT trip, pos, {R('lng')} AS lng, {R('next_lng')} AS next_lng, next_road FROM "
    "(SELECT trip, pos, lng, lead(lng) OVER w AS next_lng, lead(road) OVER w AS next_road, lead(pos) OVER w AS np "
    "FROM vp WINDOW w AS (PARTITION BY trip ORDER BY pos)) WHERE np IS NOT NULL"))
_add("sequence_conv", _sql(
    f"SELECT trip, pos, {R('0.25 * COALESCE(lag(speed) OVER w, 0.0) + 0.5 * COALESCE(speed, 0.0) + 0.25 * COALESCE(lead(speed) OVER w, 0.0)')} AS conv "
    "FROM vp WINDOW w AS (PARTITION BY trip ORDER BY pos)"))
_add("first_n_trips", _sql("SELECT trip, split, idx FROM hop", hop_n=1000))
_add("hop_query_target", _sql(
    f"SELECT split, idx, trip, role, sub_pos, {R('lng')} AS lng, {R('lat')} AS lat, {R('speed')} AS speed FROM hq", hop_n=1000))
_add("query_target_union", _sql(
    f"SELECT split, trip, CASE WHEN pos % 2 = 0 THEN 'qry' ELSE 'tgt' END AS role, CAST(pos // 2 AS INTEGER) AS sub_pos, "
    f"{R('lng')} AS lng, {R('lat')} AS lat FROM tf"))
_add("hop_query_target_pois", _sql(
    "SELECT h.split, h.trip, h.idx, o.o_text, o.d_text, r.role FROM hop h JOIN odpois o USING (trip) "
    "CROSS JOIN (SELECT 'qry' AS role UNION ALL SELECT 'tgt') r", _odpois_ctes(3)))
_add("concat_sequences", _sql(
    f"""SELECT split, trip, CAST(CASE WHEN pos % 2 = 0 THEN pos // 2 ELSE nq + pos // 2 END AS INTEGER) AS i, {R('lng')} AS lng
FROM (SELECT *, count(*) FILTER (WHERE pos % 2 = 0) OVER (PARTITION BY trip) AS nq FROM tf)"""))
_add("pad_trips", _sql(
    f"""SELECT g.trip, CAST(g.i AS INTEGER) AS i, {R('COALESCE(p.lng, l.lng)')} AS lng
FROM (SELECT trip, unnest(generate_series(0, L - 1)) AS i
      FROM (SELECT trip, max(length) OVER (PARTITION BY split) AS L FROM valid)) g
LEFT JOIN tf p ON p.trip = g.trip AND p.pos = g.i
JOIN tf l ON l.trip = g.trip AND l.pos = l.n - 1"""))
_add("flatten_valid", _sql(f"SELECT trip, pos, {R('speed')} AS speed FROM tf"))
_add("pairwise_distance", _sql(
    f"""SELECT q.split, q.trip AS qid, i.trip AS item, {R('sqrt(sum((i.v - qv.v) * (i.v - qv.v)))')} AS dist
FROM hop q JOIN kv qv ON qv.split = q.split AND qv.trip = q.trip
JOIN kv i ON i.split = q.split AND i.d = qv.d GROUP BY q.split, q.trip, i.trip""", _kseg(6) + _kvec("kv", "kseg")))
_add("near_set", _sql(
    f"SELECT CAST(split AS INTEGER) AS split, qid, item, CAST(r - 1 AS INTEGER) AS rank, {R('dist')} AS dist FROM "
    "(SELECT *, row_number() OVER (PARTITION BY split, qid ORDER BY dist, item) AS r FROM pd) WHERE r <= 10",
    _search_ctes()))
_add("farthest_negatives", _sql("SELECT split, trip, neg_trip, neg_idx FROM negs", _search_ctes()))
_add("search_candidates", _sql(f"SELECT split, qid, CAST(cls AS INTEGER) AS cls, {R('score')} AS score FROM scores",
                               _search_ctes()))
_SS_FINAL = f"""SELECT split, {R('avg(rank)')} AS mean_rank, {R('avg(f1)')} AS macro_f1, {R('avg(rec)')} AS macro_rec,
       {R('max(acc1)')} AS "acc@1", {R('max(acc5)')} AS "acc@5", {R('max(acc10)')} AS "acc@10", CAST(0 AS BIGINT) AS unscored
FROM (
  SELECT pc.split, pc.f1, pc.rec, h.rank, h.acc1, h.acc5, h.acc10 FROM
  (SELECT split, CASE WHEN n_true + n_pred > 0 THEN 2.0 * tp / (n_true + n_pred) ELSE 0.0 END AS f1,
          CASE WHEN n_true > 0 THEN 1.0 * tp / n_true ELSE 0.0 END AS rec FROM spc) pc
  JOIN (SELECT split, avg(rank) AS rank, avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END) AS acc1,
               avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS acc5,
               avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS acc10 FROM sper GROUP BY split) h USING (split))
GROUP BY split"""
_SS_EXTRA = """,
smax AS (SELECT split, qid, max(score) AS ms FROM scores GROUP BY split, qid),
spred AS (SELECT s.split, s.qid, min(s.cls) AS pred FROM scores s JOIN smax m USING (split, qid)
          WHERE s.score = m.ms GROUP BY s.split, s.qid),
srank AS (SELECT s.split, s.qid, 1 + sum(CASE WHEN s.score > t.score OR (s.score = t.score AND s.cls > 0) THEN 1 ELSE 0 END) AS rank
          FROM scores s JOIN (SELECT split, qid, score FROM scores WHERE cls = 0) t USING (split, qid) GROUP BY s.split, s.qid),
sper AS (SELECT p.split, p.qid, p.pred, r.rank FROM spred p JOIN srank r USING (split, qid)),
spc AS (SELECT split, c, sum(n_true) AS n_true, sum(tp) AS tp, sum(n_pred) AS n_pred FROM (
          SELECT split, 0 AS c, 1 AS n_true, CASE WHEN pred = 0 THEN 1 ELSE 0 END AS tp, 0 AS n_pred FROM sper
          UNION ALL SELECT split, pred AS c, 0, 0, 1 FROM sper) GROUP BY split, c)"""
_add("similar_search", _sql(_SS_FINAL, _search_ctes() + _SS_EXTRA))
_add("mean_pool", _sql(f"SELECT label, CAST(i AS INTEGER) AS i, {R('c')} AS value FROM (SELECT cls AS label, i, c FROM cent)", EMB))
_add("l2_similarity", _sql(
    f"SELECT e.vec_id, {R('-sqrt(sum((e.v - c.c) * (e.v - c.c)))')} AS similarity FROM emb e "
    "JOIN cent c ON c.cls = e.label AND c.i = e.i GROUP BY e.vec_id", EMB))
_add("argmax_class", _sql("SELECT id AS vec_id, pred FROM pred2", EMB + CLS_METRICS))
_add("score_rank", _sql(
    "SELECT id AS vec_id, cls, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, cls DESC) AS BIGINT) AS rank FROM escore",
    EMB))
_add("classification_metrics", _sql(_cls_final(), EMB + CLS_METRICS))
_add("topn_accuracy", _sql(
    f"SELECT {R('avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0.0 END)')} AS \"acc@2\", "
    f"{R('avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END)')} AS \"acc@3\" FROM per", EMB + CLS_METRICS))
_add("mean_rank", _sql(f"SELECT id AS vec_id, rank FROM trank", EMB + CLS_METRICS))
_CE = """,
ce AS (
  SELECT avg(lse - ts) AS cross_entropy FROM (
    SELECT s.id, m.ms + ln(sum(exp(s.score - m.ms))) AS lse, max(CASE WHEN s.cls = l.label THEN s.score END) AS ts
    FROM escore s JOIN (SELECT id, max(score) AS ms FROM escore GROUP BY id) m USING (id)
    JOIN elabel l USING (id) GROUP BY s.id, m.ms))"""
_add("cross_entropy", _sql(f"SELECT {R('cross_entropy')} AS cross_entropy, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM trank)) AS unscored FROM ce", EMB + CLS_METRICS + _CE))
_MSE = """,
mse AS (
  SELECT sum((lng - next_lng) * (lng - next_lng) + (lat - next_lat) * (lat - next_lat)) / (count(*) * 2) AS mse FROM (
    SELECT lng, lat, lead(lng) OVER w AS next_lng, lead(lat) OVER w AS next_lat, lead(pos) OVER w AS np
    FROM tf WINDOW w AS (PARTITION BY trip ORDER BY pos)) WHERE np IS NOT NULL)"""
_add("multi_mse", _sql(f"SELECT {R('mse')} AS mse FROM mse", _MSE))


def _entropy(name: str, src: str, target: str, contexts: list[str], classes: str) -> str:
    """CTE (loss, n): counts by window sums over the table of combinations."""
    every = ", ".join(dict.fromkeys(", ".join(contexts).split(", ")))
    p = f"(sum(c) OVER (PARTITION BY y) + 1.0) / (sum(c) OVER () + {classes})"
    for ctx in reversed(contexts):
        p = f"(sum(c) OVER (PARTITION BY {ctx}, y) + {p}) / (sum(c) OVER (PARTITION BY {ctx}) + 1.0)"
    return f""",
{name}_c AS (SELECT {every}, {target} AS y, count(*) FILTER (WHERE split = 0) AS c, count(*) FILTER (WHERE split = 2) AS n
             FROM {src} WHERE {target} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT sum(-ln(p) * n) / sum(n) AS loss, sum(n) AS n FROM (SELECT n, {p} AS p FROM {name}_c) WHERE n > 0)"""


def _ridge(features: list[str], src: str) -> str:
    """CTEs: sums of products, Gauss-Jordan elimination column by column, squared errors (e0, e1, ...)."""
    x, k, m = ["1.0", *features], len(features) + 1, len(features)
    sums = ", ".join([f"sum({x[i]} * {x[j]}) + {1.0 if i == j and i else 0.0} AS a{i}_{j}" for i in range(k) for j in range(k)]
                     + [f"sum({x[i]} * next_{f}) AS a{i}_{k + j}" for i in range(k) for j, f in enumerate(features)])
    whole = " AND ".join(f"{f} IS NOT NULL AND next_{f} IS NOT NULL" for f in features)
    out = f",\nelim0 AS (SELECT {sums} FROM {src} WHERE split = 0 AND {whole})"
    for s in range(k):
        cells = [f"a{i}_{j} / a{s}_{s} AS a{i}_{j}" if i == s else f"a{i}_{j} - a{i}_{s} * a{s}_{j} / a{s}_{s} AS a{i}_{j}"
                 for i in range(k) for j in range(s, k + m)]
        out += f",\nelim{s + 1} AS (SELECT {', '.join(cells)} FROM elim{s})"
    errors = ", ".join(f"avg(pow({' + '.join(f'a{i}_{k + j} * {x[i]}' for i in range(k))} - next_{f}, 2)) AS e{j}" for j, f in enumerate(features))
    return out + f",\nridge AS (SELECT {errors}, count(*) AS n FROM {src}, elim{k} WHERE split = 2 AND {whole})"


from .constants import CONTINUOUS_COLS as _CON  # noqa: E402

_HOUR = "(CAST(seconds AS BIGINT) % 86400) // 3600"
_NEXT = _TV + f""",
nxt AS (
  SELECT * FROM (SELECT split, road, weekday, {_HOUR} AS hour, {', '.join(_CON)}, lead(road) OVER w AS next_road, lead(weekday) OVER w AS next_weekday,
                        lead({_HOUR}) OVER w AS next_hour, {', '.join(f'lead({c}) OVER w AS next_{c}' for c in _CON)}, lead(pos) OVER w AS np
                 FROM tf WINDOW w AS (PARTITION BY trip ORDER BY pos)) WHERE np IS NOT NULL),
o_words AS (SELECT split, start_weekday, start_hour, unnest(regexp_split_to_array(o_text, '、| ')) AS word FROM tv WHERE split <> 1),
d_words AS (SELECT split, start_weekday, start_hour, unnest(regexp_split_to_array(d_text, '、| ')) AS word FROM tv WHERE split <> 1)"""
_NEXT += _entropy("ce_road", "nxt", "next_road", ["road", "weekday, hour"], "(SELECT max(road) + 1 FROM road_info)")
_NEXT += _entropy("ce_weekday", "nxt", "next_weekday", ["weekday, hour", "road"], "7") + _entropy("ce_hour", "nxt", "next_hour", ["weekday, hour", "road"], "24")
for _e in "od":
    _NEXT += _entropy(f"ce_{_e}_text", f"{_e}_words", "word", ["start_weekday, start_hour"], f"(SELECT count(DISTINCT word) + 1 FROM {_e}_words)")
_NEXT += _ridge(_CON, "nxt")
_NEXT += ",\nrec AS (" + " UNION ALL ".join(
    [f"SELECT 'discrete' AS kind, '{f}' AS feature, 0.5 AS weight, loss, n FROM ce_{f}" for f in ("road", "weekday", "hour")]
    + [f"SELECT 'continuous', '{f}', 0.5 / {len(_CON)}, e{j}, n FROM ridge" for j, f in enumerate(_CON)]
    + [f"SELECT 'place', '{e}_text', 1.0, loss, n FROM ce_{e}_text" for e in "od"]) + ")"
_add("recovery_loss", _sql(
    f"SELECT kind, feature, {R('weight')} AS weight, {R('loss')} AS loss, CAST(n AS BIGINT) AS n FROM (SELECT * FROM rec "
    "UNION ALL SELECT 'total', '', 1.0, sum(weight * loss), max(n) FROM rec)", _NEXT))
_TTE = """,
tte AS (SELECT split, trip, max(seconds) - min(seconds) AS label FROM tf GROUP BY split, trip),
base AS (SELECT t.*, m.pred FROM tte t CROSS JOIN (SELECT avg(label) AS pred FROM tte WHERE split = 0) m),
reg AS (SELECT split, sqrt(avg((pred - label) * (pred - label))) AS rmse, avg(abs(pred - label)) AS mae,
               avg(abs(CASE WHEN label <> 0 THEN (pred - label) / label END)) AS mape,
               sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS mape_skipped FROM base GROUP BY split)"""
_REG_FINAL = (f"SELECT split, {R('rmse')} AS rmse, {R('mae')} AS mae, {R('mape')} AS mape, "
              "CAST(mape_skipped AS BIGINT) AS mape_skipped FROM reg")
_add("regression_metrics", _sql(_REG_FINAL, _TTE))
_add("selection_score", _sql(f"SELECT split, {R('mape')} AS mape, {R('1.0 / (mape + 1e-6)')} AS score FROM reg", _TTE))
_add("set_intersection", _sql("SELECT DISTINCT road FROM vp WHERE split < 2 INTERSECT SELECT DISTINCT road FROM vp WHERE split = 2"))
from .constants import PREFIX_EN as _PEN, PREFIX_ZH as _PZH, PROMPT_PARTS as _PP  # noqa: E402
from .constants import TASK_SUFFIXES as _TS, WEEKDAYS_EN as _WEN, WEEKDAYS_ZH as _WZH  # noqa: E402


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(vs) -> str:
    return "[" + ", ".join(_lit(v) for v in vs) + "]"


def _prefix_sql(template: str, names) -> str:
    import re as _re
    out = []
    for x in [p for p in _re.split(r"(\{weekday\}|\{hour\})", template) if p]:
        if x == "{weekday}":
            out.append(f"{_list(names)}[start_weekday + 1]")
        elif x == "{hour}":
            out.append("CAST(start_hour AS VARCHAR)")
        else:
            out.append(_lit(x))
    return "concat(" + ", ".join(out) + ")"


_PREFIX_ZH = _prefix_sql(_PZH, _WZH)
_PREFIX_EN = _prefix_sql(_PEN, _WEN)
_Z = {k: _lit(v) for k, v in _PP["zh"].items()}
_add("prompt_prefix", _sql(f"SELECT trip, {_PREFIX_ZH} AS prefix_zh, {_PREFIX_EN} AS prefix_en FROM tv", _TV))
_add("prompt_eval", _sql(
    f"""SELECT trip, 'destination' AS task, concat({_PREFIX_ZH}, {_Z['start']}, o_text, {_Z['traj']}, '<traj>', {_lit(_TS[('destination', 'zh')])}) AS prompt FROM tv
UNION ALL SELECT trip, 'tte', concat({_PREFIX_ZH}, {_Z['start']}, o_text, {_Z['end']}, d_text, {_Z['traj']}, '<traj>', {_lit(_TS[('tte', 'zh')])}) FROM tv
UNION ALL SELECT trip, 'classification', concat({_PREFIX_ZH}, {_Z['start']}, o_text, {_Z['end']}, d_text, {_Z['traj']}, '<traj>', {_lit(_TS[('classification', 'zh')])}) FROM tv""",
    _TV))
_add("prompt_pretrain", _sql(
    f"""SELECT trip, 'trip' AS recover_type, concat({_PREFIX_ZH}, {_Z['start']}, o_text, {_Z['end']}, d_text, {_Z['traj']}, '<traj>', {_Z['suffix']}) AS prompt FROM tv
UNION ALL SELECT trip, 'poi', concat({_PREFIX_ZH}, {_Z['traj']}, '<traj>', {_Z['start']}, o_text, {_Z['end']}, d_text, {_Z['suffix']}) FROM tv""",
    _TV))
_add("embedding_lookup", _sql(
    f"""SELECT v.trip, v.pos, {R('r.lng + sin(CAST(v.weekday AS DOUBLE) * exp(0.0))')} AS e0,
       {R('r.lat + cos(CAST(v.weekday AS DOUBLE) * exp(0.0))')} AS e1
FROM vp v JOIN road_info r USING (road)"""))
_add("anchor_attention", _sql(
    f"""SELECT a.vec_id, CAST(c.i AS INTEGER) AS i, {R('sum(c.c * a.wt)')} AS value FROM (
  SELECT vec_id, cls, ex / sum(ex) OVER (PARTITION BY vec_id) AS wt FROM (
    SELECT vec_id, cls, exp(s - max(s) OVER (PARTITION BY vec_id)) AS ex
    FROM (SELECT e.vec_id, c.cls, sum(e.v * c.c) / sqrt(64.0) AS s FROM emb e JOIN cent c ON c.i = e.i GROUP BY e.vec_id, c.cls))) a
JOIN cent c ON c.cls = a.cls GROUP BY a.vec_id, c.i""", EMB))
_add("meta_roundtrip", _sql(
    "SELECT trip, pos, n, " + ", ".join(f'{R(c if c != "offset" else chr(34) + "offset" + chr(34))} AS "{c}"'
                                        for c in FEATURES) + ", split FROM tf WHERE split = 2"))

from .constants import ANCHOR_WORDS as _ANCHORS, ANCHOR_WORDS_ZH as _ANCHORS_ZH  # noqa: E402

_ASKED = [*_ANCHORS, *(f"[anchor{i}]" for i in range(4)), *dict.fromkeys(_ANCHORS_ZH[:12])]
_add("new_vocabulary", _sql(
    "SELECT word FROM (VALUES " + ", ".join(f"('{w}')" for w in _ASKED) + ") AS a(word) "
    "WHERE word NOT IN (SELECT t FROM (SELECT unnest(regexp_split_to_array(lower(concat_ws(' ', name, address)), "
    "'[^a-z0-9#-]+')) AS t FROM pois "
    "UNION ALL SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9#-]+')) FROM documents) WHERE length(t) > 0)"))

_WORDS = "SELECT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM {}) WHERE length(word) > 0"
_add("vocabulary_difference", f"{_WORDS.format('conversations')} EXCEPT {_WORDS.format('documents')}")
_add("pairwise", _sql(
    f"SELECT trip, pos, {R('lng')} AS lng, {R('lat')} AS lat, {R('next_lng')} AS next_lng, {R('next_lat')} AS next_lat "
    f"FROM {_pairs} WHERE np IS NOT NULL"))
_add("od_poi_text", _sql(
    "SELECT q.trip, q.\"end\", t.text FROM odq q JOIN odtxt t USING (qid)", _odpois_ctes(3)))
_add("negative_candidates", _sql(
    "SELECT h.split, h.trip, v.trip AS neg_trip FROM hop h JOIN valid v USING (split) WHERE NOT EXISTS "
    "(SELECT 1 FROM near x WHERE x.split = h.split AND x.qid = h.trip AND x.item = v.trip)", _search_ctes()))
_add("prompt_suffix", _sql(
    "SELECT v.trip, s.task, s.lang, s.suffix FROM valid v CROSS JOIN (VALUES "
    + ", ".join(f"({_lit(t)}, {_lit(lang)}, {_lit(v)})" for (t, lang), v in _TS.items())
    + ") AS s(task, lang, suffix)"))


def _metrics_table_sql() -> str:
    metrics = ["mean_rank", "macro_f1", "macro_rec", "acc@1", "acc@5", "acc@10", "unscored"]
    rm = ["rmse", "mae", "mape", "mape_skipped"]
    u1 = " UNION ALL ".join(
        f"SELECT 'search' AS task, split, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value FROM ss" for m in metrics)
    u2 = " UNION ALL ".join(
        f"SELECT 'tte_baseline' AS task, split, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM rg" for m in rm)
    extra = _search_ctes() + _SS_EXTRA + _TTE + f""",
ss AS ({_SS_FINAL}),
rg AS ({_REG_FINAL})"""
    return _sql(f"SELECT task, split, metric, {R('value')} AS value FROM ({u1} UNION ALL {u2})", extra)


_add("metrics_table", _metrics_table_sql())

_add("farthest_negatives_default", _sql("SELECT split, trip, neg_trip, neg_idx FROM negs",
                                        _search_ctes(m=10000), hop_n=1000))
_add("similar_search_default", _sql(_SS_FINAL, _search_ctes(m=10000) + _SS_EXTRA, hop_n=1000))

_add("sample_negatives", _sql("SELECT split, trip, neg_trip, neg_idx FROM negs", _search_ctes(seed=7)))
_add("similar_search_sampled", _sql(_SS_FINAL, _search_ctes(seed=7) + _SS_EXTRA))
_add("seeded_shuffle", _sql(
    "SELECT trip, split, row_number() OVER (PARTITION BY split ORDER BY md5(concat('42:', trip)), trip) - 1 AS shuffled FROM valid"))
_add("encode_trips", _sql(
    "SELECT trip, CAST(k * 3 + c AS INTEGER) AS i, " + R("CASE k WHEN 0 THEN m WHEN 1 THEN s WHEN 2 THEN f ELSE l END") + " AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT trip, {i} AS c, avg({c}) AS m, stddev_pop({c}) AS s, max(CASE WHEN pos = 0 THEN {c} END) AS f, "
        f"max(CASE WHEN pos = n - 1 THEN {c} END) AS l FROM tf GROUP BY trip" for i, c in enumerate(("lng", "lat", "speed")))
    + ") CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS k)"))

_E = {k: _lit(v) for k, v in _PP["en"].items()}
_add("prompt_eval_en", _sql(
    f"""SELECT trip, 'destination' AS task, concat({_PREFIX_EN}, {_E['start']}, o_text, {_E['traj']}, '<traj>', {_lit(_TS[('destination', 'en')])}) AS prompt FROM tv
UNION ALL SELECT trip, 'tte', concat({_PREFIX_EN}, {_E['start']}, o_text, {_E['end']}, d_text, {_E['traj']}, '<traj>', {_lit(_TS[('tte', 'en')])}) FROM tv
UNION ALL SELECT trip, 'classification', concat({_PREFIX_EN}, {_E['start']}, o_text, {_E['end']}, d_text, {_E['traj']}, '<traj>', {_lit(_TS[('classification', 'en')])}) FROM tv""",
    _TV))
_add("prompt_pretrain_no_places", _sql(
    f"SELECT trip, 'trip' AS recover_type, concat({_PREFIX_EN}, {_E['traj']}) AS before, CAST(length AS INTEGER) AS n_points, '' AS after FROM tv", _TV))
_CELL = f"{_gidx('lat', 'y0', 'y1', 'num_h')} * num_w + {_gidx('lng', 'x0', 'x1', 'num_w')}"
_add("trip_features_grid", _sql(
    f"SELECT tf.trip, tf.pos, CAST(c.cell AS DOUBLE) AS road, {R('tf.lng')} AS lng, {R('tf.lat')} AS lat FROM tf "
    f"JOIN (SELECT trip, seq_i, {_CELL} AS cell FROM trips CROSS JOIN gdim) c ON c.trip = tf.trip AND c.seq_i = tf.seq_i", _GRID))
_add("cardinalities_grid", _sql("SELECT num_w * num_h AS num_road, (SELECT max(driver) + 1 FROM trip_info) AS num_class, num_w, num_h FROM gdim", _GRID))
_add("build_dataset", _sql(
    """SELECT type, split, n_rows FROM (
  SELECT 'trip' AS type, split, count(*) AS n_rows FROM tf GROUP BY split
  UNION ALL SELECT 'destination', split, count(*) FROM valid GROUP BY split UNION ALL SELECT 'tte', split, count(*) FROM valid GROUP BY split
  UNION ALL SELECT 'odpois-3', split, count(*) FROM valid GROUP BY split UNION ALL SELECT 'hopqrytgt-5', split, count(*) FROM hq GROUP BY split
  UNION ALL SELECT 'hopqrytgtpois-5-3', split, 2 * count(*) FROM hop GROUP BY split UNION ALL SELECT 'hopnegindex-5-5', split, count(*) FROM negs GROUP BY split)""",
    _search_ctes(seed=0)))
_add("stats_roundtrip", ORACLE_SQL["describe_points"].replace(
    'SELECT "column", count(value) AS count', 'SELECT (SELECT max(road) + 1 FROM road_info) AS num_road, '
    '(SELECT max(driver) + 1 FROM trip_info) AS num_class, "column", count(value) AS count'))


def _binned(q: float) -> str:
    """The value of the logarithmic bin (accuracy 0.005) of the value at rank floor((n - 1) q), in hundredths."""
    gamma = (1 + 0.005) / (1 - 0.005)
    v = f"list_sort(list(value))[CAST(floor((count(value) - 1) * {q}) AS BIGINT) + 1]"
    x = f"CASE WHEN {v} = 0 THEN 0 ELSE sign({v}) * 2 * pow({gamma!r}, ceil(ln(abs({v})) / ln({gamma!r}))) / ({gamma!r} + 1) END"
    return R(f"floor(greatest(least({x}, max(value)), min(value)) * 100 + 0.5) / 100")


_add("stats_merge", _sql(
    f"""SELECT (SELECT max(road) + 1 FROM road_info) AS num_road, (SELECT max(driver) + 1 FROM trip_info) AS num_class, "column", count(value) AS count,
       {R('avg(value)')} AS mean, {R('sqrt(sum((value - mu) * (value - mu)) / (count(value) - 1))')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max,
       {_binned(0.25)} AS p25, {_binned(0.5)} AS p50, {_binned(0.75)} AS p75
FROM (SELECT *, avg(value) OVER (PARTITION BY "column") AS mu FROM ({_unpiv}) WHERE value IS NOT NULL) GROUP BY "column" """))
