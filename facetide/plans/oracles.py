"""The registered queries as DuckDB SQL over the same tables, for checking results."""

from __future__ import annotations

EVENTS = """
ev AS (
  SELECT 'cam_0' || CAST(user_id % 4 + 1 AS VARCHAR) AS source_id,
         event_id AS frame_id,
         user_id % 3 + 1 AS face_id,
         CASE WHEN event_id % 101 = 0 THEN NULL
              WHEN event_id % 97 = 0 THEN epoch_us(ts) / 1e6::DOUBLE * 1000
              ELSE epoch_us(ts) / 1e6::DOUBLE END AS producer_ts,
         CASE WHEN event_id % 5 = 0 THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2)
              ELSE event_type END AS emotion,
         CASE WHEN event_id % 89 <> 0 THEN least(value / 25::DOUBLE, 1::DOUBLE) END AS score,
         CAST(event_id * 7 % 540 AS INTEGER) AS bbox_x,
         CAST(event_id * 11 % 380 AS INTEGER) AS bbox_y,
         CAST(80 + event_id % 60 AS INTEGER) AS bbox_w,
         CAST(80 + event_id % 50 AS INTEGER) AS bbox_h,
         ts + to_milliseconds(event_id % 5000 - 200) AS spark_ts
  FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL),
sec AS (
  SELECT *, CASE WHEN producer_ts > 1e12::DOUBLE THEN producer_ts / 1000::DOUBLE ELSE producer_ts END AS producer_ts_sec
  FROM ev),
timed AS (
  SELECT *, coalesce(CASE WHEN producer_ts_sec BETWEEN -62135596800 AND 253402300799
                          THEN make_timestamp(CAST(trunc(producer_ts_sec) AS BIGINT) * 1000000) END, spark_ts) AS event_ts
  FROM sec),
stored AS (
  SELECT *, event_ts AS event_time, date_trunc('minute', event_ts) AS event_minute,
         (epoch_us(spark_ts) / 1e6::DOUBLE - producer_ts_sec) * 1000::DOUBLE AS raw_latency_ms,
         greatest(0::DOUBLE, (epoch_us(spark_ts) / 1e6::DOUBLE - producer_ts_sec) * 1000::DOUBLE) AS e2e_latency_ms,
         CAST(NULL AS DOUBLE) AS processing_time_ms,
         CAST(event_ts AS DATE) AS event_date
  FROM timed)"""

RECENT = """
recent AS (
  SELECT * FROM stored WHERE event_ts >= (SELECT max(event_ts) FROM stored) - INTERVAL 10080 MINUTE),
good AS (SELECT * FROM recent WHERE coalesce(score, 0) >= 0.5)"""


def _detections(cameras: int = 1) -> str:
    source = "'cam_01'" if cameras == 1 else "'cam_0' || CAST(l_orderkey % 4 + 1 AS VARCHAR)"
    return f"""
det AS (
  SELECT {source} AS source_id, l_orderkey AS frame_id, l_orderkey * 0.1::DOUBLE AS ts,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS det_no,
         CAST(l_partkey % 200 - 20 AS INTEGER) AS x,
         CAST(l_suppkey * 3 % 200 - 10 AS INTEGER) AS y,
         60 + CAST(trunc(l_quantity) AS INTEGER) AS w,
         CAST(60 + l_partkey % 50 AS INTEGER) AS h,
         CASE WHEN l_partkey % 50 <> 0 THEN 1::DOUBLE - l_discount * 6::DOUBLE END AS conf,
         200 AS frame_w, 180 AS frame_h
  FROM lineitem),
edges AS (
  SELECT *, greatest(0, x) AS x0, greatest(0, y) AS y0,
         least(frame_w, greatest(0, x) + w) AS x1, least(frame_h, greatest(0, y) + h) AS y1,
         least(frame_w, x + w) AS raw_x1, least(frame_h, y + h) AS raw_y1
  FROM det),
cut AS (
  SELECT source_id, frame_id, ts, det_no, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h
  FROM edges WHERE x1 > x0 AND y1 > y0)"""


FRAMES = """
frames AS (
  SELECT 'cam_0' || CAST(o_orderkey % 4 + 1 AS VARCHAR) AS source_id, o_orderkey AS frame_id,
         o_orderkey * 0.1::DOUBLE AS ts FROM orders)"""

VECTORS = """
vec AS (
  SELECT CAST(label AS BIGINT) AS track_id, vec_id AS frame_id,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"""

SOFTMAX = """
powers AS (
  SELECT track_id, frame_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM logit),
probs AS (
  SELECT track_id, frame_id, list_transform(e, lambda x: x / (list_sum(e) + 1e-9::DOUBLE)) AS p FROM powers)"""

FOLDED = """
logit AS (
  SELECT track_id, frame_id, list_transform(range(1, 9), lambda j:
           10::DOUBLE * list_sum(list_transform(range(0, 8), lambda m: f[8 * m + j]))) AS logits FROM vec)"""

FACE_PROBS = f"""{VECTORS},
{FOLDED},
{SOFTMAX}"""

NAMES = "['anger', 'contempt', 'disgust', 'fear', 'happiness', 'neutral', 'sadness', 'surprise']"


def _labelled(classes: int) -> str:
    return f"""
best AS (
  SELECT track_id, frame_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS idx, list_max(p) AS score FROM probs),
named AS (
  SELECT *, CASE WHEN idx < {classes} THEN {NAMES}[idx + 1] ELSE 'class_' || CAST(idx AS VARCHAR) END AS label FROM best)"""


def _votes(rows: str, label: str, size: int) -> str:
    """``voted``: most frequent label of the last ``size`` rows, ties to the newest."""
    return f"""
windows AS (
  SELECT track_id, frame_id, list({label}) OVER (PARTITION BY track_id ORDER BY frame_id
         ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS seen FROM {rows}),
ballots AS (
  SELECT track_id, frame_id, unnest(seen) AS choice, generate_subscripts(seen, 1) AS spot FROM windows),
counts AS (
  SELECT track_id, frame_id, choice, count(*) AS n, max(spot) AS newest FROM ballots GROUP BY ALL),
voted AS (
  SELECT track_id, frame_id, arg_max(choice, n * 1000 + newest) AS vote_label FROM counts GROUP BY ALL)"""


def _switch(rows: str, min_score: float, confirm: int) -> str:
    """``shown``: the switch walked over ``rows`` (track_id, frame_id, candidate, score)."""
    return f"""
offers AS (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS rn FROM {rows}),
shown AS (
  SELECT track_id, frame_id, rn, candidate AS stable, score AS stable_score,
         CAST(NULL AS VARCHAR) AS pending, 0 AS seen FROM offers WHERE rn = 1
  UNION ALL
  SELECT o.track_id, o.frame_id, o.rn,
         CASE WHEN o.candidate = s.stable OR {_confirmed(min_score, confirm)} THEN o.candidate ELSE s.stable END,
         CASE WHEN o.candidate = s.stable OR {_confirmed(min_score, confirm)} THEN o.score ELSE s.stable_score END,
         CASE WHEN o.candidate = s.stable OR {_confirmed(min_score, confirm)} THEN NULL
              WHEN o.score < {min_score} THEN s.pending ELSE o.candidate END,
         CASE WHEN o.candidate = s.stable OR {_confirmed(min_score, confirm)} THEN 0
              WHEN o.score < {min_score} THEN s.seen
              WHEN o.candidate = s.pending THEN s.seen + 1 ELSE 1 END
  FROM shown s JOIN offers o ON o.track_id = s.track_id AND o.rn = s.rn + 1)"""


def _confirmed(min_score: float, confirm: int) -> str:
    again = "CASE WHEN o.candidate = s.pending THEN s.seen + 1 ELSE 1 END"
    return f"(o.score >= {min_score} AND {again} >= {confirm})"


AVERAGES = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_id) AS rn FROM probs),
ema AS (
  SELECT track_id, frame_id, rn, p AS e FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.track_id, o.frame_id, o.rn,
         list_transform(range(1, 9), lambda i: 0.65::DOUBLE * o.p[i] + (1::DOUBLE - 0.65::DOUBLE) * m.e[i])
  FROM ema m JOIN ordered o ON o.track_id = m.track_id AND o.rn = m.rn + 1)"""

SMOOTHED = f"""{FACE_PROBS},{AVERAGES},
tops AS (
  SELECT track_id, frame_id, {NAMES}[list_position(e, list_max(e))] AS top, list_max(e) AS score FROM ema),
{_votes("tops", "top", 5)},
cand AS (
  SELECT v.track_id, v.frame_id, v.vote_label AS candidate, t.score FROM voted v JOIN tops t USING (track_id, frame_id)),
{_switch("cand", 0.2, 2)}"""


def _throttle(keys: str, ties: str) -> str:
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {EVENTS},
e AS (
  SELECT source_id, frame_id, face_id, epoch_us(event_ts) / 1e6::DOUBLE AS t, emotion FROM stored),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, {ties}) AS rn FROM e),
hop AS (
  SELECT a.*, (SELECT min(b.rn) FROM n b WHERE {same} AND b.t - a.t >= 1800) AS next_rn FROM n a),
passed AS (
  SELECT * FROM hop WHERE rn = 1
  UNION ALL
  SELECT b.* FROM passed a JOIN hop b ON {same} AND b.rn = a.next_rn)
SELECT source_id, frame_id, face_id, t, emotion FROM passed"""


def _tracks(rows: str) -> str:
    """``walk``: track numbers of ``rows`` (source_id, frame_id, det_no, ts, x, y, w, h), walked box by box: a box takes the free
    live track it overlaps most, the oldest on a tie; boxes that tracks take count from the next frame on."""
    track = "{{'id': {id}, 'x': {x}, 'y': {y}, 'w': {w}, 'h': {h}, 'seen': {seen}, 'taken': {taken}, 'nx': {nx}, 'ny': {ny}, 'nw': {nw}, 'nh': {nh}}}"
    taken_now = {"taken": "true", "nx": "x", "ny": "y", "nw": "w", "nh": "h"}
    new = track.format(id="following", x="x", y="y", w="w", h="h", seen="ts", **taken_now)
    first = track.format(id="1::BIGINT", x="x", y="y", w="w", h="h", seen="ts", **taken_now)
    hit = track.format(id="t.id", x="t.x", y="t.y", w="t.w", h="t.h", seen="t.seen", **taken_now)
    moved = track.format(id="t.id", x="t.nx", y="t.ny", w="t.nw", h="t.nh", seen="s.ts", taken="false", nx="t.nx", ny="t.ny", nw="t.nw", nh="t.nh")
    shared = "greatest(0, least(x + w, t.x + t.w) - greatest(x, t.x)) * greatest(0, least(y + h, t.y + t.h) - greatest(y, t.y))"
    return f"""
boxes AS (
  SELECT source_id, frame_id, det_no, ts, x, y, w, h,
         row_number() OVER (PARTITION BY source_id ORDER BY ts, frame_id, det_no) AS rn,
         frame_id IS DISTINCT FROM lag(frame_id) OVER (PARTITION BY source_id ORDER BY ts, frame_id, det_no) AS opens FROM {rows}),
walk AS (
  SELECT source_id, frame_id, det_no, ts, rn, 1::BIGINT AS track_id, 2::BIGINT AS following, [{first}] AS tracks FROM boxes WHERE rn = 1
  UNION ALL
  SELECT source_id, frame_id, det_no, ts, rn, coalesce(hit, following), CASE WHEN hit IS NULL THEN following + 1 ELSE following END,
         CASE WHEN hit IS NULL THEN list_append(live, {new}) ELSE list_transform(live, lambda t: CASE WHEN t.id = hit THEN {hit} ELSE t END) END
  FROM (
    SELECT *, CASE WHEN best.iou >= 0.25::DOUBLE THEN -best.age END AS hit FROM (
      SELECT *, list_max(list_transform(list_filter(live, lambda t: NOT t.taken), lambda t:
               {{'iou': CAST({shared} AS DOUBLE) / (w * h + t.w * t.h - {shared}), 'age': -t.id}})) AS best
      FROM (
        SELECT b.*, s.following, CASE WHEN b.opens THEN list_filter(
                 list_transform(s.tracks, lambda t: CASE WHEN t.taken THEN {moved} ELSE t END), lambda t: b.ts - t.seen <= 0.9::DOUBLE)
               ELSE s.tracks END AS live
        FROM walk s JOIN boxes b ON b.source_id = s.source_id AND b.rn = s.rn + 1))))"""


def _tracked(cameras: int) -> str:
    return f"""WITH RECURSIVE {_detections(cameras)},{_tracks("cut")}
SELECT source_id, frame_id, det_no, track_id FROM walk"""


TIMELINE = f"""WITH {EVENTS}
SELECT event_minute AS minute, lower(emotion) AS emotion, count(*) AS "count" FROM stored GROUP BY ALL"""

INGEST = f"""WITH {EVENTS}
SELECT source_id, frame_id, face_id, producer_ts, emotion, score, bbox_x, bbox_y, bbox_w, bbox_h, spark_ts,
       producer_ts_sec, event_ts, event_time, event_minute, e2e_latency_ms, processing_time_ms, event_date
FROM stored"""

HELD = f"""WITH {_detections(4)},{FRAMES},
searched AS (SELECT source_id, frame_id AS held_from, ts AS since FROM frames WHERE frame_id % 3 = 0),
held AS (
  SELECT f.source_id, f.frame_id, f.ts, s.held_from, s.since
  FROM frames f ASOF JOIN searched s ON f.source_id = s.source_id AND f.ts >= s.since)
SELECT h.source_id, h.frame_id, h.held_from, d.det_no, d.x, d.y, d.w, d.h
FROM held h JOIN det d ON d.source_id = h.source_id AND d.frame_id = h.held_from
WHERE h.frame_id = h.held_from OR (h.ts - h.since) * 1000::DOUBLE <= 450"""

LIVE = f"""WITH RECURSIVE {_detections(4)},{FRAMES},
searched AS (SELECT source_id, frame_id AS held_from, ts AS since FROM frames WHERE frame_id % 3 = 0),
held AS (
  SELECT f.source_id, f.frame_id, f.ts, s.held_from, s.since
  FROM frames f ASOF JOIN searched s ON f.source_id = s.source_id AND f.ts >= s.since),
visible AS (
  SELECT h.source_id, h.frame_id, h.ts, c.det_no, c.x, c.y, c.w, c.h, d.x * 7 + d.y * 3 AS seed
  FROM held h JOIN det d ON d.source_id = h.source_id AND d.frame_id = h.held_from AND coalesce(d.conf, 0.8::DOUBLE) >= 0.45::DOUBLE
  JOIN cut c ON c.source_id = d.source_id AND c.frame_id = d.frame_id AND c.det_no = d.det_no
  WHERE h.frame_id = h.held_from OR (h.ts - h.since) * 1000::DOUBLE <= 450),{_tracks("visible")},
faces AS (
  SELECT v.*, w.track_id AS face_id, v.source_id || '/' || CAST(w.track_id AS VARCHAR) AS track_id
  FROM visible v JOIN walk w USING (source_id, frame_id, det_no)),
logit AS (
  SELECT track_id, frame_id, list_transform(range(0, 8), lambda i: CAST((seed + i * 13) % 17 AS DOUBLE) / 4::DOUBLE) AS logits FROM faces),{SOFTMAX},{AVERAGES},
tops AS (
  SELECT track_id, frame_id, {NAMES}[list_position(e, list_max(e))] AS top, list_max(e) AS score FROM ema),
{_votes("tops", "top", 15)},
cand AS (
  SELECT v.track_id, v.frame_id, v.vote_label AS candidate, t.score FROM voted v JOIN tops t USING (track_id, frame_id)),
{_switch("cand", 0.55, 6)},
n AS (
  SELECT f.*, s.stable, s.stable_score, row_number() OVER (PARTITION BY f.source_id ORDER BY f.ts, f.frame_id, f.det_no) AS place
  FROM faces f JOIN shown s USING (track_id, frame_id)),
hop AS (
  SELECT a.*, (SELECT min(b.place) FROM n b WHERE b.source_id = a.source_id AND b.place > a.place AND b.ts - a.ts >= 0.5::DOUBLE) AS next_place FROM n a),
passed AS (
  SELECT * FROM hop WHERE place = 1
  UNION ALL
  SELECT b.* FROM passed a JOIN hop b ON b.source_id = a.source_id AND b.place = a.next_place)
SELECT source_id, frame_id, face_id, ts AS producer_ts, stable AS emotion, round(stable_score, 6) AS score,
       x AS bbox_x, y AS bbox_y, w AS bbox_w, h AS bbox_h FROM passed"""

FRAME_RATE = f"""WITH {FRAMES}
SELECT source_id, date_trunc('second', make_timestamp(frame_id * 100000)) AS second, CAST(count(*) AS DOUBLE) AS fps
FROM frames GROUP BY ALL"""

SMOOTH = f"""WITH RECURSIVE {SMOOTHED}
SELECT s.track_id, s.frame_id, c.candidate AS vote_label, s.stable AS stable_label,
       round(c.score, 6) AS ema_score, round(s.stable_score, 6) AS stable_score
FROM shown s JOIN cand c USING (track_id, frame_id)"""

THROTTLE = _throttle("source_id", "frame_id, face_id")

ORACLES: dict[str, str] = {
    "ingest_enrich": INGEST,
    "ingest_unclamped_latency": f"""WITH {EVENTS}
SELECT source_id, frame_id, producer_ts_sec, raw_latency_ms AS e2e_latency_ms FROM stored""",
    "json_props_parse": """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "coerce_numeric_ts": """
WITH texts AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS number_text,
         CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_text FROM events)
SELECT event_id, TRY_CAST(number_text AS DOUBLE) AS number, TRY_CAST(time_text AS TIMESTAMP) AS moment FROM texts""",
    "raw_messages": f"""WITH {EVENTS} SELECT frame_id, emotion, spark_ts AS event_time FROM stored""",
    "label_lines": r"""
WITH raw AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\x{FEFF}', ''), '\r\n|\r|\n') AS parts FROM documents),
trimmed AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda line:
           regexp_replace(line, '\A[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+|[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+\z', '', 'g')),
         lambda line: line <> '') AS lines FROM raw)
SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS idx, unnest(lines) AS label FROM trimmed""",
    "required_fields": f"""WITH {EVENTS} SELECT source_id, frame_id, emotion, score FROM ev WHERE score IS NOT NULL""",
    "zoneless_times": f"""WITH {EVENTS} SELECT frame_id, event_ts FROM stored""",
    "labelled_folder": "SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL",
    "class_list_files": """
WITH classes AS (SELECT row_number() OVER (ORDER BY source) - 1 AS idx, source AS label FROM (SELECT DISTINCT source FROM documents))
SELECT 'json' AS kind, idx, label FROM classes UNION ALL SELECT 'text', NULL, label FROM classes""",
    "compacted_store": f"""WITH {EVENTS} SELECT source_id, frame_id, event_ts, event_date FROM stored""",
    "pick_timestamp": f"""WITH {EVENTS}
SELECT count(event_ts) AS event_ts_rows, max(event_ts) AS event_ts_newest,
       count(spark_ts) AS spark_ts_rows, max(spark_ts) AS spark_ts_newest,
       count(event_time) AS event_time_dt_rows, max(event_time) AS event_time_dt_newest,
       count(event_time) AS event_time_rows, max(event_time) AS event_time_newest,
       count(producer_ts) AS producer_ts_rows,
       max(make_timestamp(CAST(trunc(producer_ts_sec) AS BIGINT) * 1000000)) AS producer_ts_newest FROM stored""",
    "recent_window": f"""WITH {EVENTS},{RECENT} SELECT source_id, frame_id, event_ts, emotion, score FROM recent""",
    "filtered_events": f"""WITH {EVENTS},{RECENT}
SELECT source_id, frame_id, event_ts, emotion, score FROM good WHERE source_id = 'cam_01'""",
    "kpi_latency": f"""WITH {EVENTS},{RECENT},
k AS (
  SELECT count(*) AS events, quantile_cont(e2e_latency_ms, 0.5) AS latency_p50,
         quantile_cont(e2e_latency_ms, 0.95) AS latency_p95 FROM good)
SELECT events, round(latency_p50, 6) AS latency_p50, round(latency_p95, 6) AS latency_p95,
       CAST(NULL AS DOUBLE) AS processing_p50, CAST(NULL AS DOUBLE) AS processing_p95,
       CAST(CAST(round_even(latency_p50, 0) AS BIGINT) AS VARCHAR) AS latency_p50_text,
       CAST(CAST(round_even(latency_p95, 0) AS BIGINT) AS VARCHAR) AS latency_p95_text,
       '—' AS processing_p50_text, '—' AS processing_p95_text FROM k""",
    "latest_events": f"""WITH {EVENTS}
SELECT event_time AS event_time_dt, event_ts, spark_ts, producer_ts, source_id, frame_id, face_id, emotion, score, e2e_latency_ms
FROM stored ORDER BY event_ts DESC NULLS LAST, frame_id, face_id LIMIT 200""",
    "last_arrived": f"""WITH {EVENTS}
SELECT source_id, frame_id, face_id, spark_ts FROM stored ORDER BY spark_ts DESC, frame_id DESC, face_id DESC LIMIT 20""",
    "emotion_distribution": f"""WITH {EVENTS}
SELECT lower(emotion) AS emotion, count(*) AS "count" FROM stored GROUP BY 1""",
    "emotion_top_k": f"""WITH {EVENTS}
SELECT emotion, count(*) AS "count" FROM stored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    "timeline_minute": TIMELINE,
    "timeline_5s": f"""WITH {EVENTS}
SELECT time_bucket(INTERVAL 5 SECOND, event_ts) AS slot, lower(emotion) AS emotion, count(*) AS "count"
FROM stored GROUP BY ALL""",
    "timeline_pivot": f"""WITH {EVENTS}
SELECT event_minute AS minute, count(*) FILTER (lower(emotion) = 'click') AS click,
       count(*) FILTER (lower(emotion) = 'error') AS error, count(*) FILTER (lower(emotion) = 'purchase') AS purchase,
       count(*) FILTER (lower(emotion) = 'signup') AS signup, count(*) FILTER (lower(emotion) = 'view') AS "view"
FROM stored GROUP BY 1""",
    "timeline_legacy_case": f"""WITH {EVENTS}, split AS (
  SELECT event_minute AS minute, emotion, count(*) AS "count" FROM stored GROUP BY ALL)
SELECT minute, lower(emotion) AS emotion, "count" FROM split""",
    "distinct_sources": f"""WITH {EVENTS} SELECT DISTINCT source_id FROM stored ORDER BY 1""",
    "union_v1_v2": f"""WITH {EVENTS},
v1 AS (
  SELECT 'cam_0' || CAST(user_id % 4 + 1 AS VARCHAR) AS source_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time,
         event_type AS emotion, least(value / 25::DOUBLE, 1::DOUBLE) AS score FROM events),
v2 AS (
  SELECT source_id, frame_id, face_id, producer_ts, emotion, score, bbox_x, bbox_y, bbox_w, bbox_h, producer_ts_sec,
         event_ts, CAST(event_time AS VARCHAR) AS event_time, e2e_latency_ms, event_date FROM stored)
SELECT * FROM v1 UNION ALL BY NAME SELECT * FROM v2""",
    "union_drift": """
SELECT CAST(event_id AS BIGINT) AS n, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v, CAST(user_id AS VARCHAR) AS k FROM events
UNION ALL SELECT event_id + 1099511627776, value, event_type FROM events""",
    "recent_by_date": f"""WITH {EVENTS},{RECENT} SELECT source_id, frame_id, event_ts, emotion, score FROM recent""",
    "store_mixed_depth": f"""WITH {EVENTS}
SELECT source_id, frame_id, face_id, emotion, score, event_ts, CASE WHEN frame_id % 4 = 0 THEN event_date END AS event_date,
       CASE frame_id % 4 WHEN 2 THEN emotion WHEN 3 THEN CAST(frame_id AS VARCHAR) END AS note FROM stored""",
    "recent_by_clock": f"""WITH {EVENTS},{RECENT} SELECT source_id, frame_id, event_ts FROM recent""",
    "frame_rate": FRAME_RATE,
    "bbox_to_pixels": """
SELECT l_orderkey, l_linenumber, CAST(trunc(l_discount * 640) AS INTEGER) AS x, CAST(trunc(l_tax * 480) AS INTEGER) AS y,
       CAST(trunc(l_quantity / 60 * 640) AS INTEGER) AS w,
       CAST(trunc(CAST(l_partkey % 50 AS DOUBLE) / 60 * 480) AS INTEGER) AS h FROM lineitem""",
    "bbox_rescale": f"""WITH {_detections()},
inv AS (SELECT *, 1::DOUBLE / least(1::DOUBLE, 640::DOUBLE / (1280 + frame_id % 3 * 320)) AS k FROM det)
SELECT source_id, frame_id, det_no, CAST(trunc(x * k) AS INTEGER) AS x, CAST(trunc(y * k) AS INTEGER) AS y,
       CAST(trunc(w * k) AS INTEGER) AS w, CAST(trunc(h * k) AS INTEGER) AS h FROM inv""",
    "bbox_clamp": f"""WITH {_detections()} SELECT source_id, frame_id, det_no, x, y, w, h FROM cut""",
    "bbox_clamp_raw_edge": f"""WITH {_detections()}
SELECT source_id, frame_id, det_no, x0 AS x, y0 AS y, raw_x1 - x0 AS w, raw_y1 - y0 AS h
FROM edges WHERE raw_x1 > x0 AND raw_y1 > y0""",
    "detection_filter": f"""WITH {_detections()}
SELECT source_id, frame_id, det_no, round(coalesce(conf, 0.8::DOUBLE), 6) AS conf FROM det
WHERE frame_id % 3 = 0 AND coalesce(conf, 0.8::DOUBLE) >= 0.45::DOUBLE""",
    "best_detection": f"""WITH {_detections()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, frame_id ORDER BY conf DESC NULLS LAST, det_no) AS r FROM det)
SELECT source_id, frame_id, det_no, x, y, w, h, round(conf, 6) AS conf FROM ranked WHERE r = 1""",
    "face_position": f"""WITH {_detections()} SELECT source_id, frame_id, det_no, det_no AS face_id FROM cut""",
    "frame_counter": f"""WITH {FRAMES}
SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, frame_id) AS frame_no FROM frames""",
    "iou_match": f"""WITH {_detections()},
linked AS (
  SELECT source_id, frame_id, lag(frame_id) OVER (PARTITION BY source_id ORDER BY frame_id) AS before
  FROM (SELECT DISTINCT source_id, frame_id FROM cut)),
pairs AS (
  SELECT a.source_id, a.frame_id, a.det_no, b.det_no AS prev_det_no, a.w * a.h + b.w * b.h AS areas,
         greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
         * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared
  FROM cut a JOIN linked USING (source_id, frame_id) JOIN cut b ON b.source_id = a.source_id AND b.frame_id = before),
scored AS (SELECT *, CAST(shared AS DOUBLE) / (areas - shared) AS iou FROM pairs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, frame_id, det_no ORDER BY iou DESC, prev_det_no) AS r
  FROM scored WHERE iou >= 0.25)
SELECT source_id, frame_id, det_no, prev_det_no, round(iou, 6) AS iou FROM ranked WHERE r = 1""",
    "held_boxes": HELD,
    "softmax_argmax_label": f"""WITH {FACE_PROBS},{_labelled(7)}
SELECT track_id, frame_id, idx, label, round(score, 6) AS score FROM named""",
    "pixel_normalise": f"""WITH {VECTORS},
planes AS (
  SELECT frame_id, list_transform(f, lambda x: ((x + 1) * 127.5::DOUBLE / 255::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE) AS g FROM vec),
stacked AS (SELECT frame_id, g || g || g AS g FROM planes)
SELECT frame_id, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS pos, round(unnest(g), 6) AS "value" FROM stacked""",
    "ema_probs": f"""WITH RECURSIVE {FACE_PROBS},{AVERAGES}
SELECT track_id, frame_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS class_idx, round(unnest(e), 6) AS "value" FROM ema""",
    "vote_label": f"""WITH {FACE_PROBS},{_labelled(8)},{_votes("named", "label", 15)}
SELECT track_id, frame_id, label, vote_label FROM named JOIN voted USING (track_id, frame_id)""",
    "hysteresis_label": f"""WITH RECURSIVE {FACE_PROBS},{_labelled(8)},
cand AS (SELECT track_id, frame_id, label AS candidate, score FROM named),{_switch("cand", 0.2, 2)}
SELECT track_id, frame_id, stable AS stable_label, round(stable_score, 6) AS stable_score FROM shown""",
    "smooth_tracks": SMOOTH,
    "throttle_events": THROTTLE,
    "throttle_faces": _throttle("source_id, face_id", "frame_id"),
    "score_faces_labels": f"""WITH {FACE_PROBS},{_labelled(8)}
SELECT track_id, frame_id, idx, label, round(score, 6) AS score FROM named""",
    "bad_faces_skipped": f"""WITH {FACE_PROBS},
good AS (SELECT p.* FROM probs p JOIN vec v USING (track_id, frame_id) WHERE v.f[1] >= 0)
SELECT track_id, frame_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS idx, round(unnest(p), 6) AS p FROM good""",
    "class_index": """
SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx, lang AS label FROM (SELECT DISTINCT lang FROM documents)""",
    "class_weights": """
SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx, lang AS label, count(*) AS "count",
       1::DOUBLE / count(*) AS weight FROM documents GROUP BY lang""",
    "accuracy": """
SELECT CAST(doc_id % 5 + 1 AS INTEGER) AS epoch, round(avg(CASE WHEN quality = 1 - toxic THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS accuracy
FROM labels GROUP BY 1""",
    "classification_report": """
WITH p AS (SELECT quality AS t, 1 - toxic AS q FROM labels WHERE doc_id % 5 + 1 = 5),
classes AS (SELECT t AS c FROM p UNION SELECT q FROM p),
sums AS (
  SELECT c, (SELECT count(*) FROM p WHERE t = c) AS support, (SELECT count(*) FROM p WHERE q = c) AS called,
         (SELECT count(*) FROM p WHERE t = c AND q = c) AS hits FROM classes),
ratios AS (
  SELECT *, CASE WHEN called = 0 THEN 0::DOUBLE ELSE hits / called::DOUBLE END AS precision,
         CASE WHEN support = 0 THEN 0::DOUBLE ELSE hits / support::DOUBLE END AS recall FROM sums),
scored AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ratios),
report AS (
  SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM scored
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM scored
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scored)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""",
    "best_epoch": """
WITH a AS (
  SELECT CAST(doc_id % 5 + 1 AS INTEGER) AS epoch, avg(CASE WHEN quality = 1 - toxic THEN 1::DOUBLE ELSE 0::DOUBLE END) AS accuracy
  FROM labels GROUP BY 1)
SELECT epoch AS best_epoch, round(accuracy, 6) AS best_accuracy FROM a WHERE accuracy > 0 ORDER BY accuracy DESC, epoch LIMIT 1""",
    "epoch_improvements": """
WITH a AS (
  SELECT CAST(doc_id % 5 + 1 AS INTEGER) AS epoch, avg(CASE WHEN quality = 1 - toxic THEN 1::DOUBLE ELSE 0::DOUBLE END) AS accuracy
  FROM labels GROUP BY 1),
b AS (
  SELECT *, greatest(0::DOUBLE, max(accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS best_before FROM a)
SELECT epoch, round(accuracy, 6) AS accuracy, round(best_before, 6) AS best_before FROM b WHERE accuracy > best_before""",
    "epoch_loss": """
SELECT CAST(o_orderkey % 12 + 1 AS INTEGER) AS epoch, round(avg(o_totalprice / 1e5::DOUBLE), 6) AS train_loss FROM orders GROUP BY 1""",
    "stream_ingest": INGEST,
    "stream_to_both": f"""WITH {EVENTS}
SELECT source_id, frame_id, emotion, place FROM stored, (VALUES (0), (1)) places(place)""",
    "stream_timeline": TIMELINE,
    "stream_watermark_account": f"""WITH {EVENTS},
fed AS (
  SELECT frame_id % 4 AS part, event_ts, event_minute, lower(emotion) AS emotion FROM stored WHERE emotion IS NOT NULL),
marks AS (
  SELECT part, max(max(event_ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark
  FROM fed GROUP BY part),
judged AS (
  SELECT f.*, coalesce(date_trunc('minute', f.event_ts) + INTERVAL 1 MINUTE <= m.mark, false) AS behind FROM fed f JOIN marks m USING (part))
SELECT count(*) AS n_input, count(*) FILTER (NOT behind) AS n_kept, count(*) FILTER (behind) AS n_dropped,
       count(DISTINCT (part, event_minute, emotion)) FILTER (behind) AS groups_dropped FROM judged""",
    "stream_pair_outcome": f"""WITH {EVENTS},
bad AS (SELECT count(*) > 0 AS any_bad FROM stored WHERE score IS NULL)
SELECT name, CASE WHEN NOT any_bad THEN 'finished' WHEN name = 'strict' THEN 'failed' ELSE 'stopped' END AS outcome,
       any_bad AND name = 'strict' AS told FROM bad, (VALUES ('keep'), ('strict')) AS pair(name)""",
    "stream_late_rows": f"""WITH {EVENTS},
e AS (
  SELECT source_id, frame_id % 4 AS part, {{'t': epoch_us(event_ts), 'frame': frame_id, 'face': face_id}} AS place FROM stored),
newest AS (
  SELECT source_id, part, max(max(place)) OVER (PARTITION BY source_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM e GROUP BY source_id, part)
SELECT source_id, count(*) AS n_rows, count(*) FILTER (place < seen) AS n_late FROM e JOIN newest USING (source_id, part) GROUP BY source_id""",
    "stream_vote_change": f"""WITH RECURSIVE {FACE_PROBS},
fed AS (
  SELECT *, least(CAST(floor(frame_id * 3 / (SELECT max(frame_id) FROM probs)) AS INTEGER), 2) AS part FROM probs),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY track_id, part = 2 ORDER BY frame_id) AS rn FROM fed),
ema AS (
  SELECT track_id, frame_id, part, rn, p AS e FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.track_id, o.frame_id, o.part, o.rn,
         list_transform(range(1, 9), lambda i: 0.65::DOUBLE * o.p[i] + (1::DOUBLE - 0.65::DOUBLE) * m.e[i])
  FROM ema m JOIN ordered o ON o.track_id = m.track_id AND o.rn = m.rn + 1 AND (o.part = 2) = (m.part = 2)),
tops AS (
  SELECT track_id, frame_id, part, {NAMES}[list_position(e, list_max(e))] AS top, list_max(e) AS score FROM ema),
wide AS (
  SELECT *, list(top) OVER (PARTITION BY track_id, part = 2 ORDER BY frame_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS seen FROM tops),
ballots AS (
  SELECT track_id, frame_id, unnest(votes) AS choice, generate_subscripts(votes, 1) AS spot
  FROM (SELECT track_id, frame_id, CASE WHEN part = 0 THEN seen ELSE seen[-3:] END AS votes FROM wide)),
counts AS (
  SELECT track_id, frame_id, choice, count(*) AS n, max(spot) AS newest FROM ballots GROUP BY ALL),
voted AS (
  SELECT track_id, frame_id, arg_max(choice, n * 1000 + newest) AS vote_label FROM counts GROUP BY ALL)
SELECT track_id, frame_id, vote_label, round(score, 6) AS ema_score FROM voted JOIN tops USING (track_id, frame_id)""",
    "stream_frame_rate": FRAME_RATE,
    "stream_throttle": THROTTLE,
    "stream_smooth": SMOOTH,
    "stream_hold": HELD,
    "track_assign": _tracked(1),
    "frame_to_event": LIVE,
    "stream_track": _tracked(4),
}
