"""Point view over the ``events`` table and the oracle's SQL chain.

The driver's tables carry no coordinates, so a deterministic projection of every event
becomes a GPS ping: signups are at home, purchases at work, everything else in between.
The same formulas are written once per engine; only the spelling of epoch differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.config import Corridor, TripConfig, TzRegion, Waypoint, Zones
from tripweave.functions.numeric import stable_round
from tripweave.operators.classify import build_ensemble
from tripweave.operators.segment import segment
from tripweave.operators.sequence import enrich, enrich_and_detect

CFG = TripConfig(
    home_lat=40.75, home_lon=-74.0, home_radius_m=200.0, work_lat=40.85, work_lon=-73.95, work_radius_m=200.0
)
ZONES = Zones(
    waypoints=(
        Waypoint("Station", 40.8002, -73.98, 30.0, "train"),
        Waypoint("Stop", 40.8005, -73.98, 25.0, None),
        Waypoint("Garage", 40.8007, -73.98, 15.0, "driving"),
    ),
    corridors=(
        Corridor("Line", "train", ((40.8004, -73.98), (40.8008, -73.98)), 25.0),
        Corridor("Road", "driving", ((40.8001, -73.98), (40.8003, -73.9801), (40.8006, -73.98)), 20.0),
    ),
)
TZ_REGIONS = (
    TzRegion("America/New_York", 40.0, 41.0, -75.0, -73.0),
    TzRegion("America/Chicago", 40.8003, 40.86, -74.5, -73.5),
    TzRegion("Europe/London", 40.8005, 40.8006, -74.0, -73.9),
)
# the report date of "the last seven days"
AS_OF = "2024-01-25"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# ---------------------------------------------------------------- Spark side


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GPS ping per event."""
    ev = events(spark, sf_dir)
    ev.createOrReplaceTempView("_events_of_pings")
    return spark.sql(
        _PINGS.format(events="_events_of_pings", epoch="unix_timestamp", string="string", div="div", extra="")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw message table: one message per event, the ping inside its JSON payload."""
    events(spark, sf_dir).createOrReplaceTempView("_events_of_messages")
    rows = spark.sql(
        _PINGS.format(
            events="_events_of_messages", epoch="unix_timestamp", string="string", div="div", extra=_MESSAGE
        )
    )
    payload = F.to_json(
        F.struct(
            F.col("msg_type").alias("_type"), F.lit("ph").alias("tid"),
            F.when(~F.col("no_fix"), F.col("lat")).alias("lat"), "lon", "tst", "acc", "batt",
            # half of the senders leave the receive time to the receiver
            F.when(F.col("event_type") != "view", F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("received_at"),
            F.col("user").alias("_receiver_user"), F.col("device").alias("_receiver_device"),
            F.col("record_id").alias("event_id"),
        )
    )
    return rows.select(
        F.col("record_id").alias("id"), F.col("received_at").cast("timestamp").alias("received_at"),
        "msg_type", "user", "device", payload.alias("payload"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages exported so far: those of the signup events."""
    done = events(spark, sf_dir).filter("event_type = 'signup'")
    return done.select(
        F.col("event_id").alias("id"), F.lit("2024-01-31").cast("timestamp").alias("synced_at"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


def enriched(spark, sf_dir) -> DataFrame:
    return enrich(pings(spark, sf_dir), CFG)


def trip_points(spark, sf_dir) -> DataFrame:
    return enrich_and_detect(pings(spark, sf_dir), CFG)


def points(spark, sf_dir, zones: Zones = Zones(), cfg: TripConfig = CFG) -> DataFrame:
    return segment(enrich_and_detect(pings(spark, sf_dir), cfg), build_ensemble(zones, cfg), cfg)


# ---------------------------------------------------------------- DuckDB side

_PINGS = """
SELECT event_id AS record_id,
       'u' || CAST((user_id % 10) {div} 2 AS {string}) AS user,
       'd' || CAST(user_id % 2 AS {string}) AS device,
       {epoch}(date_trunc('day', ts)) + 39600
         + 15 * row_number() OVER (PARTITION BY user_id % 10, CAST(ts AS date) ORDER BY ts, event_id) AS tst,
       CASE event_type WHEN 'signup' THEN 40.75e0 WHEN 'purchase' THEN 40.85e0
            ELSE 40.80e0 + (value - floor(value / 8) * 8) * 0.0001e0 END AS lat,
       CASE event_type WHEN 'signup' THEN -74.0e0 WHEN 'purchase' THEN -73.95e0 ELSE -73.98e0 END AS lon{extra}
FROM {events}
"""

# what a raw message adds to a ping: errors are not location messages, a few views lack a latitude
_MESSAGE = """,
       ts AS received_at,
       CASE event_type WHEN 'error' THEN 'transition' ELSE 'location' END AS msg_type,
       event_type = 'view' AND value < 1 AS no_fix,
       CAST(floor(value) AS int) % 50 AS acc, 100 - CAST(floor(value) AS int) % 90 AS batt, event_type"""


def rnd(expr: str, decimals: int) -> str:
    """Half-up rounding on the decimal value, as Spark's round does for doubles."""
    return f"CAST(round(CAST(round({expr}, 6) AS DECIMAL(30, 6)), {decimals}) AS DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"sin((radians({lat2})-radians({lat1}))/2)*sin((radians({lat2})-radians({lat1}))/2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*sin((radians({lon2})-radians({lon1}))/2)*sin((radians({lon2})-radians({lon1}))/2)"
    )
    return f"(12742000.0*asin(sqrt(least(1.0,{a}))))"


_ENT = '"user", device'
_W = f"(PARTITION BY {_ENT} ORDER BY tst, record_id)"
_WU = f"(PARTITION BY {_ENT} ORDER BY tst, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_TRIP = f"PARTITION BY {_ENT}, commute_id ORDER BY tst, record_id"


def _pings_cte(extra: str = "") -> str:
    sql = _PINGS.format(events="events", epoch="CAST(epoch", string="VARCHAR", div="//", extra=extra)
    sql = sql.replace("CAST(epoch(date_trunc('day', ts))", "CAST(epoch(date_trunc('day', ts)) AS BIGINT)")
    return sql.replace(" AS user,", ' AS "user",')


PINGS_SQL = _pings_cte()
MESSAGES_SQL = f"SELECT * REPLACE (CASE WHEN no_fix THEN NULL ELSE lat END AS lat) FROM ({_pings_cte(_MESSAGE)})"
# pings as the pipeline takes them from raw messages
LOCATED_SQL = (
    f"SELECT record_id, \"user\", device, tst, lat, lon FROM ({MESSAGES_SQL}) "
    "WHERE msg_type = 'location' AND lat IS NOT NULL"
)

ENRICHED_SQL = f"""
SELECT *, CASE WHEN time_delta_s > 0 THEN distance_m / time_delta_s * 3.6 ELSE 0.0 END AS speed_kmh,
       CASE WHEN time_delta_s > 0 THEN distance_m / time_delta_s * 3.6 ELSE 0.0 END < 1.0 AS is_stationary
FROM (
  SELECT *, CAST(to_timestamp(tst) AT TIME ZONE 'UTC' AS TIMESTAMP) AS "timestamp",
         CAST(to_timestamp(tst) AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS timestamp_local,
         CAST(to_timestamp(tst) AT TIME ZONE 'America/New_York' AS DATE) AS local_date,
         'America/New_York' AS timezone,
         CASE WHEN lag(tst) OVER {_W} IS NULL THEN 0.0
              ELSE {haversine(f"lag(lat) OVER {_W}", f"lag(lon) OVER {_W}", "lat", "lon")} END AS distance_m,
         coalesce(CAST(tst - lag(tst) OVER {_W} AS DOUBLE), 0.0) AS time_delta_s
  FROM pings)
"""

TRIPS_SQL = f"""
SELECT * EXCLUDE (z, pz, dep, nxt, ishome),
       CASE WHEN z = 0 OR pz = 0 THEN
         CASE WHEN ishome AND nxt IN (2, 3) THEN 'morning'
              WHEN NOT ishome AND nxt IN (1, 3) THEN 'evening' END END AS commute_direction,
       CASE WHEN z = 0 OR pz = 0 THEN
         CASE WHEN ishome AND nxt IN (2, 3) THEN CAST(dep.d AS VARCHAR) || '-morning'
              WHEN NOT ishome AND nxt IN (1, 3) THEN CAST(dep.d AS VARCHAR) || '-evening' END END AS commute_id
FROM (
  SELECT *, dep.o IN (1, 3) AS ishome FROM (
    SELECT *,
           last_value(CASE WHEN z = 0 AND pz > 0 THEN {{'o': pz, 'd': local_date}} END IGNORE NULLS) OVER {_WU} AS dep,
           first_value(CASE WHEN z > 0 THEN z END IGNORE NULLS) OVER
             (PARTITION BY {_ENT} ORDER BY tst, record_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt
    FROM (
      SELECT *, lag(z) OVER {_W} AS pz FROM (
        SELECT *, CAST(at_home AS INT) + 2 * CAST(at_work AS INT) AS z FROM (
          SELECT *, {haversine("lat", "lon", "40.75e0", "-74.0e0")} <= 200.0 AS at_home,
                 {haversine("lat", "lon", "40.85e0", "-73.95e0")} <= 200.0 AS at_work
          FROM enriched)))))
"""

_RULE = (
    "CASE WHEN speed_kmh < 1 THEN 'stationary' WHEN speed_kmh < 7 THEN 'walking' "
    "WHEN speed_kmh < 30 THEN 'driving' ELSE 'train' END"
)
VARIANCE_SQL = f"""
SELECT *, CASE WHEN speed_kmh >= 15 AND n7 >= 3 AND mean7 >= 1 THEN sd7 / mean7 END AS cv FROM (
  SELECT *, avg(speed_kmh) OVER w7 AS mean7, stddev_samp(speed_kmh) OVER w7 AS sd7, count(*) OVER w7 AS n7
  FROM trips WHERE commute_id IS NOT NULL
  WINDOW w7 AS ({_TRIP} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
"""

CASES_TRAIN = "CASE WHEN cv < 0.25 THEN 1.0 - cv / 0.25 ELSE 0.0 END"
CASES_DRIVE = "CASE WHEN cv >= 0.25 THEN least(1.0, (cv - 0.25) / 0.25) ELSE 0.0 END"


def waypoint_in(w: Waypoint) -> str:
    return f"({haversine('lat', 'lon', f'{w.lat!r}', f'{w.lon!r}')} <= {w.radius_m!r})"


def corridor_dist(c: Corridor) -> str:
    return "least(" + ", ".join(haversine("lat", "lon", repr(a), repr(b)) for a, b in c.sample_points()) + ")"


def votes_sql(zones: Zones) -> dict[str, str]:
    """Ensemble votes per mode over the columns of VARIANCE_SQL."""
    votes = {
        m: f"CASE WHEN {_RULE} = '{m}' THEN 1.0e0 ELSE 0.0e0 END"
        for m in ("stationary", "walking", "driving", "train")
    }
    votes["waiting"] = "0.0e0"
    votes["train"] += f" + ({CASES_TRAIN}) * 0.5e0"
    votes["driving"] += f" + ({CASES_DRIVE}) * 0.5e0"
    for m in votes:
        hints = [waypoint_in(w) for w in zones.waypoints if w.mode_hint == m]
        if hints:
            votes[m] += f" + (CASE WHEN {' OR '.join(hints)} THEN 1.0e0 ELSE 0.0e0 END) * 1.5e0"
        near = [
            f"(CASE WHEN {corridor_dist(c)} <= {c.buffer_m!r} THEN 1.0e0 - {corridor_dist(c)} / {c.buffer_m!r} ELSE 0.0e0 END)"
            for c in zones.corridors
            if c.mode == m
        ]
        if near:
            votes[m] += f" + greatest({', '.join(near)}) * 1.2e0"
    return votes


def zone_set_sql(zones: Zones) -> str:
    if not zones.waypoints:
        return "''"
    parts = [f"CASE WHEN {waypoint_in(w)} THEN '{w.name}' END" for w in sorted(zones.waypoints, key=lambda w: w.name)]
    return f"concat_ws('|', {', '.join(parts)})"


MODE_ORDER = ("stationary", "waiting", "walking", "driving", "train")


def classified_sql(zones: Zones = Zones()) -> str:
    v = votes_sql(zones)
    best = "greatest(v_stationary, v_waiting, v_walking, v_driving, v_train)"
    winner = " ".join(f"WHEN v_{m} = {best} THEN '{m}'" for m in MODE_ORDER)
    cols = ", ".join(f"{v[m]} AS v_{m}" for m in MODE_ORDER)
    return f"""
SELECT *, CASE {winner} END AS mode0, coalesce(zset <> lag(zset) OVER ({_TRIP}), FALSE) AS bnd FROM (
  SELECT *, {cols}, {zone_set_sql(zones)} AS zset FROM variance)
"""


def _count(this: str) -> str:
    return "(" + " + ".join(f"CAST({o} = {this} AS INT)" for o in ("l2", "l1", "mode0", "r1", "r2")) + ")"


def segmented_sql(keep_boundaries: bool = False) -> str:
    names = ("l2", "l1", "mode0", "r1", "r2")
    top = "greatest(" + ", ".join(_count(n) for n in names) + ")"
    major = " ".join(f"WHEN {_count(n)} = {top} THEN {n}" for n in names)
    last = f"OVER ({_TRIP} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"OVER ({_TRIP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    final_cut = "OR (rn > 1 AND bnd)" if keep_boundaries else ""
    return f"""
SELECT * EXCLUDE (cut), CAST(sum(cut) {last} AS BIGINT) AS segment_id FROM (
  SELECT *, CAST(rn > 1 AND (transport_mode <> lag(transport_mode) OVER ({_TRIP}) {final_cut}) AS INT) AS cut FROM (
    SELECT *, CASE WHEN mode2 = 'stationary' AND pm IS DISTINCT FROM nm THEN 'waiting' ELSE mode2 END AS transport_mode FROM (
      SELECT *,
        last_value(CASE WHEN mode2 IN ('walking','driving','train') THEN mode2 END IGNORE NULLS) {last} AS pm,
        first_value(CASE WHEN mode2 IN ('walking','driving','train') THEN mode2 END IGNORE NULLS) {ahead} AS nm
      FROM (
        SELECT *, last_value(CASE WHEN sid0 = 0 OR dur >= 30 OR prot THEN mode1 END IGNORE NULLS) {last} AS mode2 FROM (
          SELECT *, sum(time_delta_s) OVER (PARTITION BY {_ENT}, commute_id, sid0) AS dur,
                 first_value(bnd) OVER (PARTITION BY {_ENT}, commute_id, sid0 ORDER BY tst, record_id) AS prot
          FROM (
            SELECT *, sum(cut0) {last} AS sid0 FROM (
              SELECT *, CAST(rn > 1 AND (mode1 <> lag(mode1) OVER ({_TRIP}) OR bnd) AS INT) AS cut0 FROM (
                SELECT *, CASE WHEN n > 5 AND rn > 2 AND rn <= n - 2 THEN CASE {major} END ELSE mode0 END AS mode1 FROM (
                  SELECT *, lag(mode0, 2) OVER ({_TRIP}) AS l2, lag(mode0, 1) OVER ({_TRIP}) AS l1,
                         lead(mode0, 1) OVER ({_TRIP}) AS r1, lead(mode0, 2) OVER ({_TRIP}) AS r2,
                         row_number() OVER ({_TRIP}) AS rn, count(*) OVER (PARTITION BY {_ENT}, commute_id) AS n
                  FROM classified)))))))))
"""


def chain(
    upto: str,
    body: str,
    zones: Zones = Zones(),
    keep_boundaries: bool = False,
    source: str = PINGS_SQL,
    **extra: str,
) -> str:
    """SQL text: the CTEs up to ``upto``, any extra CTEs, then ``body``."""
    steps = {
        "pings": source,
        "enriched": ENRICHED_SQL,
        "trips": TRIPS_SQL,
        "variance": VARIANCE_SQL,
        "classified": classified_sql(zones),
        "segmented": segmented_sql(keep_boundaries),
    }
    ctes = []
    for name, sql in steps.items():
        ctes.append(f"{name} AS ({sql})")
        if name == upto:
            break
    ctes += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return "WITH " + ", ".join(ctes) + " " + body


# trips and segments as the summaries see them
COMMUTES_SQL = f"""
SELECT {_ENT}, commute_id, commute_direction, min("timestamp") AS start_time, max("timestamp") AS end_time,
       count(*) AS point_count, sum(distance_m) AS total_distance_m,
       {rnd('(max(tst) - min(tst)) / 60.0', 1)} AS duration_min, (max(tst) - min(tst)) / 60.0 AS raw_min
FROM segmented GROUP BY ALL
"""
SEGMENTS_SQL = f"""
SELECT {_ENT}, commute_id, commute_direction, segment_id, transport_mode,
       min("timestamp") AS start_time, max("timestamp") AS end_time, count(*) AS point_count,
       {rnd('sum(distance_m)', 0)} AS distance_m, {rnd('(max(tst) - min(tst)) / 60.0', 1)} AS duration_min,
       {rnd('avg(speed_kmh)', 1)} AS avg_speed_kmh, {rnd('max(speed_kmh)', 1)} AS max_speed_kmh
FROM segmented GROUP BY ALL
"""


def with_summaries(body: str, **extra: str) -> str:
    return chain("segmented", body, commutes=COMMUTES_SQL, segments=SEGMENTS_SQL, **extra)


# ---------------------------------------------------------------- labels on both sides
# Log: every second segment of a trip was first called walking, then train; the trips of the
# first and last day carry labels under a neighbouring date; some ids are not trip ids at all.


def label_log(segs: DataFrame) -> DataFrame:
    day = F.substring("commute_id", 1, 10)

    tagged = segs.select(
        "*",
        F.when(
            F.col("segment_id") == 1,
            F.array(F.lit("old"), F.lit("new")),
        )
        .when((F.col("segment_id") == 0) & (day == "2024-01-30"), F.array(F.lit("late")))
        .when((F.col("segment_id") == 0) & (day == "2024-01-01"), F.array(F.lit("early")))
        .when((F.col("segment_id") == 0) & (day == "2024-01-15"), F.array(F.lit("odd")))
        .when((F.col("segment_id") == 0) & (day == "2024-01-16"), F.array(F.lit("same")))
        .alias("_kinds"),
    ).withColumn("_kind", F.explode("_kinds"))
    kind = F.col("_kind")
    cid = (
        F.when(kind == "late", F.concat(F.lit("2024-01-31-"), F.col("commute_direction")))
        .when(kind == "early", F.concat(F.lit("2023-12-31-"), F.col("commute_direction")))
        .when(kind == "odd", F.concat(F.lit("trip-"), F.col("commute_id")))
        .otherwise(F.col("commute_id"))
    )
    mode = (
        F.when(kind == "old", F.lit("walking")).when(kind == "new", F.lit("train")).otherwise(F.col("transport_mode"))
    )
    at = F.when(kind == "old", F.lit("2024-02-01 08:00:00")).otherwise(F.lit("2024-02-02 09:30:00"))
    return tagged.select(
        "user", "device", cid.alias("commute_id"), "segment_id", F.col("transport_mode").alias("original_mode"),
        mode.alias("corrected_mode"), kind.alias("notes"), at.cast("timestamp").alias("labeled_at"),
    )


LABELS_SQL = """
SELECT "user", device,
       CASE kind WHEN 'late' THEN '2024-01-31-' || commute_direction WHEN 'early' THEN '2023-12-31-' || commute_direction
                 WHEN 'odd' THEN 'trip-' || commute_id ELSE commute_id END AS commute_id,
       segment_id, transport_mode AS original_mode,
       CASE kind WHEN 'old' THEN 'walking' WHEN 'new' THEN 'train' ELSE transport_mode END AS corrected_mode,
       kind AS notes,
       CASE kind WHEN 'old' THEN TIMESTAMP '2024-02-01 08:00:00' ELSE TIMESTAMP '2024-02-02 09:30:00' END AS labeled_at
FROM (SELECT *, unnest(kinds) AS kind FROM (
  SELECT *, CASE WHEN segment_id = 1 THEN ['old', 'new']
                 WHEN segment_id = 0 AND commute_id LIKE '2024-01-30%' THEN ['late']
                 WHEN segment_id = 0 AND commute_id LIKE '2024-01-01%' THEN ['early']
                 WHEN segment_id = 0 AND commute_id LIKE '2024-01-15%' THEN ['odd']
                 WHEN segment_id = 0 AND commute_id LIKE '2024-01-16%' THEN ['same'] ELSE [] END AS kinds
  FROM segments))
"""
LIVE_SQL = """
SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY "user", device, commute_id, segment_id ORDER BY labeled_at DESC) = 1
"""


def with_labels(body: str, **extra: str) -> str:
    """Summaries, the label log (``log``) and its live rows (``live``), then ``body``."""
    return with_summaries(body, log=LABELS_SQL, live=LIVE_SQL, **extra)


# ---------------------------------------------------------------- plain results


def plain(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Columns in types both engines print alike: rounded doubles, texts for times, bigints."""
    def cast(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "double":
            return stable_round(c, decimals)
        if kind == "timestamp" or kind == "timestamp_ntz":
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if kind == "date":
            return c.cast("string")
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("bigint")
        if kind == "array<string>":
            return F.array_join(c, ",")
        return c

    return df.select(*[cast(n, k).alias(n) for n, k in df.dtypes])


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
