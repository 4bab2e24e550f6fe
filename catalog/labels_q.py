"""Label management, classification review and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CFG, chain, label_log, plain, points, rnd, ts, with_labels
from catalog.points_q import FEATURE_NAMES, FEATURE_OUT_SQL, FEATURES_SQL
from catalog.registry import register
from tripweave.config import MODES
from tripweave.functions import modes
from tripweave.operators import analytics as A, labels as L, model as M, review as R
from tripweave.operators.features import FEATURE_COLUMNS, point_features, training_set
from tripweave.sources.storage import scratch_path, stage, unstage

_E = '"user", device'
_ENT = ["user", "device"]
_KEY = [*_ENT, "commute_id", "segment_id"]
_K = f"{_E}, commute_id, segment_id"
NOW = "2024-03-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _log(spark, sf):
    return label_log(A.segments(points(spark, sf)))


# ------------------------------------------------------------- labels

_LIVE_OUT = f"SELECT {_K}, original_mode, corrected_mode, notes, {ts('labeled_at')} AS labeled_at FROM "
_NEW_LABELS = f"""
SELECT {_K}, transport_mode AS original_mode, 'driving' AS corrected_mode, 'bulk' AS notes, TIMESTAMP '{NOW}' AS labeled_at
FROM segments WHERE segment_id IN (1, 2)"""


@register(
    "upsert_labels_l1",
    with_labels(
        _LIVE_OUT + f"(SELECT * FROM both_logs QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY labeled_at DESC) = 1)",
        both_logs=f"SELECT * FROM log UNION ALL ({_NEW_LABELS})",
    ),
)
def upsert_labels_l1(spark, sf):
    segs = A.segments(points(spark, sf))
    new = segs.filter("segment_id in (1, 2)").select(
        *_KEY, F.col("transport_mode").alias("original_mode"), F.lit("driving").alias("corrected_mode"),
        F.lit("bulk").alias("notes"), _now().alias("labeled_at"),
    )
    return plain(L.latest_labels(L.upsert_labels(label_log(segs), new)))


@register("list_labels_l2", with_labels(_LIVE_OUT + "live"))
def list_labels_l2(spark, sf):
    return plain(L.list_labels(_log(spark, sf)))


@register("list_labels_of_trip_l2", with_labels(_LIVE_OUT + "live WHERE commute_id = '2024-01-10-morning'"))
def list_labels_of_trip_l2(spark, sf):
    return plain(L.list_labels(_log(spark, sf), "2024-01-10-morning"))


@register("corrections_map_l3", with_labels(f"SELECT {_E}, commute_id || ':' || CAST(segment_id AS VARCHAR) AS key, corrected_mode FROM live"))
def corrections_map_l3(spark, sf):
    return L.corrections_map(_log(spark, sf))


@register("label_count_l3", with_labels("SELECT count(*) AS label_count FROM live"))
def label_count_l3(spark, sf):
    return L.label_count(_log(spark, sf))


@register(
    "export_labels_l3",
    with_labels(
        "SELECT '{\"user\":\"' || \"user\" || '\",\"device\":\"' || device || '\",\"commute_id\":\"' || commute_id || '\",\"segment_id\":' || "
        "CAST(segment_id AS VARCHAR) || ',\"original_mode\":\"' || original_mode || '\",\"corrected_mode\":\"' || corrected_mode || "
        "'\",\"notes\":\"' || notes || '\",\"labeled_at\":\"' || strftime(labeled_at, '%Y-%m-%dT%H:%M:%S.000Z') || '\"}' AS value FROM live"
    ),
)
def export_labels_l3(spark, sf):
    return L.export_json(_log(spark, sf))


ORPHANS_SQL = f"SELECT live.* FROM live WHERE NOT EXISTS (SELECT 1 FROM commutes c WHERE c.\"user\" = live.\"user\" AND c.device = live.device AND c.commute_id = live.commute_id)"


@register("orphaned_labels_j5", with_labels(_LIVE_OUT + "orphans", orphans=ORPHANS_SQL))
def orphaned_labels_j5(spark, sf):
    pts = points(spark, sf)
    return plain(L.orphaned_labels(label_log(A.segments(pts)), A.commutes(pts)))


MOVES_SQL = f"""
SELECT m."user", m.device, old_id, arg_min(new_id, shift) AS new_id FROM (
  SELECT o."user", o.device, o.commute_id AS old_id, s.shift,
         CAST(CAST(substr(o.commute_id, 1, 10) AS DATE) + s.shift AS VARCHAR) || substr(o.commute_id, 11) AS new_id
  FROM orphans o, (VALUES (-1), (1)) s(shift) WHERE regexp_matches(o.commute_id, '^\\d{{4}}-\\d{{2}}-\\d{{2}}-(morning|evening)')) m
JOIN commutes c ON c."user" = m."user" AND c.device = m.device AND c.commute_id = m.new_id GROUP BY ALL"""


@register("migration_map_j6", with_labels("SELECT * FROM moves", orphans=ORPHANS_SQL, moves=MOVES_SQL))
def migration_map_j6(spark, sf):
    pts = points(spark, sf)
    return L.migration_map(label_log(A.segments(pts)), A.commutes(pts))


@register(
    "migrate_labels_l4",
    with_labels(
        f"SELECT l.\"user\", l.device, coalesce(m.new_id, l.commute_id) AS commute_id, segment_id, notes FROM log l "
        "LEFT JOIN moves m ON l.\"user\" = m.\"user\" AND l.device = m.device AND l.commute_id = m.old_id",
        orphans=ORPHANS_SQL, moves=MOVES_SQL,
    ),
)
def migrate_labels_l4(spark, sf):
    pts = points(spark, sf)
    return L.migrate_labels(label_log(A.segments(pts)), A.commutes(pts)).select(*_KEY, "notes")


@register(
    "confirm_segments_l5",
    with_labels(
        f"SELECT {_K}, transport_mode AS original_mode, transport_mode AS corrected_mode, 'confirmed correct' AS notes, '{NOW}' AS labeled_at "
        f"FROM segments ANTI JOIN live USING ({_K})"
    ),
)
def confirm_segments_l5(spark, sf):
    segs = A.segments(points(spark, sf))
    return plain(L.confirm_segments(segs, label_log(segs), _now()))


@register(
    "label_summary_l6",
    with_labels(
        f"SELECT {_K}, original_mode, corrected_mode, CASE WHEN original_mode <> corrected_mode THEN 'yes' ELSE 'confirmed' END AS changed, "
        "notes, strftime(labeled_at, '%Y-%m-%dT%H:%M:%S') AS labeled FROM live"
    ),
)
def label_summary_l6(spark, sf):
    return L.label_summary(_log(spark, sf))


@register("labelled_trips_j9", with_labels(f"SELECT {_K} FROM segments SEMI JOIN (SELECT DISTINCT {_E}, commute_id FROM log) USING ({_E}, commute_id)"))
def labelled_trips_j9(spark, sf):
    segs = A.segments(points(spark, sf))
    return L.restrict_to_labelled(segs, label_log(segs)).select(*_KEY)


# ------------------------------------------------------------- review

_RANGES = {"stationary": (0, 1), "waiting": (0, 2), "walking": (1, 7), "driving": (7, 80), "train": (30, 300)}
_LO = "CASE classified_mode " + " ".join(f"WHEN '{m}' THEN {lo}" for m, (lo, _) in _RANGES.items()) + " END"
_HI = "CASE classified_mode " + " ".join(f"WHEN '{m}' THEN {hi}" for m, (_, hi) in _RANGES.items()) + " END"
_SUGGEST = (
    "CASE WHEN avg_speed_kmh < 1 THEN 'stationary' WHEN avg_speed_kmh < 7 THEN 'walking' WHEN avg_speed_kmh < 30 THEN 'driving' "
    "WHEN speed_std_kmh > 0 AND speed_std_kmh / avg_speed_kmh < 0.4 THEN 'train' WHEN max_speed_kmh > 80 THEN 'train' "
    "WHEN avg_speed_kmh < 60 THEN 'driving' ELSE 'train' END"
)


def _profile(source: str, mode: str) -> str:
    return f"""
SELECT *, lag(classified_mode) OVER w AS prev_segment_mode, lead(classified_mode) OVER w AS next_segment_mode, {_LO} AS lo, {_HI} AS hi FROM (
  SELECT {_K}, {mode} AS classified_mode, count(*) AS point_count, {rnd('(max(tst) - min(tst)) / 60.0', 1)} AS duration_min,
         {rnd('sum(distance_m)', 0)} AS distance_m, {rnd('avg(speed_kmh)', 1)} AS avg_speed_kmh, {rnd('max(speed_kmh)', 1)} AS max_speed_kmh,
         coalesce({rnd('stddev_samp(speed_kmh)', 1)}, 0.0) AS speed_std_kmh, {rnd('median(speed_kmh)', 1)} AS speed_median_kmh,
         {rnd('min(speed_kmh)', 1)} AS speed_min_kmh
  FROM {source} GROUP BY {_K}, {mode})
WINDOW w AS (PARTITION BY {_E}, commute_id ORDER BY segment_id)"""


_TRANSFER = (
    "coalesce(classified_mode = 'stationary' AND avg_speed_kmh < 2 AND prev_segment_mode IN ('walking','driving','train') "
    "AND next_segment_mode IN ('walking','driving','train') AND prev_segment_mode <> next_segment_mode, FALSE)"
)
_REVIEWED = f"""
SELECT *, NOT ok OR transfer AS mismatch,
       CASE WHEN ok AND transfer THEN 0.8 WHEN ok THEN 0.0 ELSE {rnd('least(0.95, 0.5 + 0.5 * over)', 2)} END AS confidence,
       CASE WHEN ok AND transfer THEN 'waiting' WHEN ok THEN NULL ELSE {_SUGGEST} END AS suggested_mode
FROM (SELECT *, avg_speed_kmh BETWEEN lo AND hi AS ok, {_TRANSFER} AS transfer,
      CASE WHEN avg_speed_kmh < lo THEN (lo - avg_speed_kmh) / greatest(lo, 1) ELSE (avg_speed_kmh - hi) / greatest(hi, 1) END AS over FROM profile)
LEFT JOIN (SELECT {_K}, corrected_mode AS existing_correction FROM live) USING ({_K})
"""


def _review_sql(body: str, source: str = "segmented", mode: str = "transport_mode", **extra: str) -> str:
    before = {k: extra.pop(k) for k in ("rigged",) if k in extra}
    return with_labels(body, **before, profile=_profile(source, mode), reviewed=_REVIEWED, **extra)


# "rigged" points get a wrong mode on every third segment, so that review has something to find
_RIG = "CASE WHEN segment_id % 3 = 0 THEN 'walking' WHEN segment_id % 3 = 1 THEN 'stationary' ELSE transport_mode END"
_RIGGED = f"SELECT * REPLACE ({_RIG} AS transport_mode) FROM segmented"


def _rigged(spark, sf):
    pts = points(spark, sf)
    log = label_log(A.segments(pts))
    return pts.withColumn("transport_mode", F.when(F.col("commute_id").isNotNull(), F.expr(_RIG))), log


_REVIEW_COLS = (
    "classified_mode", "point_count", "duration_min", "distance_m", "avg_speed_kmh", "max_speed_kmh", "speed_std_kmh",
    "prev_segment_mode", "next_segment_mode", "mismatch", "confidence", "suggested_mode", "existing_correction",
)
_REVIEW_OUT = f"SELECT {_K}, {', '.join(_REVIEW_COLS)}"


@register("analyze_segment_r1", _review_sql(_REVIEW_OUT + ", speed_median_kmh, speed_min_kmh FROM reviewed"))
def analyze_segment_r1(spark, sf):
    pts = points(spark, sf)
    rows = R.review(pts, label_log(A.segments(pts)), detail=True)
    return plain(rows.select(*_KEY, *_REVIEW_COLS, "speed_median_kmh", "speed_min_kmh"))


@register("review_r2", _review_sql(_REVIEW_OUT + " FROM reviewed", source="rigged", rigged=_RIGGED))
def review_r2(spark, sf):
    pts, log = _rigged(spark, sf)
    return plain(R.review(pts, log).select(*_KEY, *_REVIEW_COLS))


_SUGGESTIONS = (
    f"SELECT {_K}, classified_mode AS original_mode, suggested_mode AS corrected_mode, confidence FROM reviewed "
    "WHERE mismatch AND suggested_mode IS NOT NULL AND existing_correction IS NULL"
)


@register("suggestions_r2", _review_sql(_SUGGESTIONS, source="rigged", rigged=_RIGGED))
def suggestions_r2(spark, sf):
    pts, log = _rigged(spark, sf)
    return plain(R.suggestions(R.review(pts, log)).drop("notes"))


_LATEST = f"SELECT {_E}, commute_id FROM commutes QUALIFY row_number() OVER (PARTITION BY {_E} ORDER BY start_time DESC, commute_id) <= 5"
_RECENT_REVIEW = f"SELECT * FROM reviewed SEMI JOIN ({_LATEST}) USING ({_E}, commute_id)"


@register(
    "recent_trip_counts_r3",
    _review_sql(
        f"SELECT {_E}, commute_id, count(*) AS total_segments, count(*) FILTER (mismatch) AS flagged_count FROM recent GROUP BY {_E}, commute_id",
        source="rigged", rigged=_RIGGED, recent=_RECENT_REVIEW,
    ),
)
def recent_trip_counts_r3(spark, sf):
    pts, log = _rigged(spark, sf)
    return plain(R.trip_counts(R.review_recent(pts, log)))


@register(
    "recent_patterns_r3",
    _review_sql(
        f"SELECT {_E}, classified_mode || ' -> ' || suggested_mode AS pattern, count(*) AS count, {rnd('avg(avg_speed_kmh)', 1)} AS avg_speed_kmh, "
        f"{rnd('avg(confidence)', 2)} AS avg_confidence, array_to_string(list_sort(list(DISTINCT commute_id)), ',') AS commute_ids "
        f"FROM recent WHERE mismatch AND suggested_mode IS NOT NULL GROUP BY {_E}, 3",
        source="rigged", rigged=_RIGGED, recent=_RECENT_REVIEW,
    ),
)
def recent_patterns_r3(spark, sf):
    pts, log = _rigged(spark, sf)
    return plain(R.patterns(R.review_recent(pts, log)))


@register(
    "apply_suggestions_r4",
    _review_sql(
        f"SELECT {_K}, original_mode, corrected_mode, {ts('labeled_at')} AS labeled_at FROM (SELECT * FROM applied "
        f"QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY labeled_at DESC) = 1)",
        source="rigged", rigged=_RIGGED,
        applied=f"SELECT {_K}, original_mode, corrected_mode, labeled_at FROM log UNION ALL "
        f"SELECT {_K}, original_mode, corrected_mode, TIMESTAMP '{NOW}' FROM ({_SUGGESTIONS}) WHERE confidence >= 0.7",
    ),
)
def apply_suggestions_r4(spark, sf):
    pts, log = _rigged(spark, sf)
    applied, _ = R.apply_suggestions(log, R.suggestions(R.review(pts, log)), _now())
    return plain(L.latest_labels(applied).drop("notes"))


@register("skipped_suggestions_r4", _review_sql(f"SELECT {_K}, confidence FROM ({_SUGGESTIONS}) WHERE confidence < 0.7", source="rigged", rigged=_RIGGED))
def skipped_suggestions_r4(spark, sf):
    pts, log = _rigged(spark, sf)
    _, left_out = R.apply_suggestions(log, R.suggestions(R.review(pts, log)), _now())
    return plain(left_out.select(*_KEY, "confidence"))


# mismatch and suggestion rules straight on the events: every mode meets every speed
_MODE_OF = "CASE event_type WHEN 'view' THEN 'walking' WHEN 'click' THEN 'driving' WHEN 'signup' THEN 'stationary' WHEN 'purchase' THEN 'train' ELSE 'waiting' END"
_RULE_EVENTS = f"""
SELECT event_id, {_MODE_OF} AS classified_mode, value AS avg_speed_kmh, value * 1.5e0 AS max_speed_kmh, user_id / 2.0e0 AS speed_std_kmh,
       CASE user_id % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'train' END AS prev_segment_mode,
       CASE user_id % 5 WHEN 0 THEN 'driving' WHEN 1 THEN 'walking' ELSE 'train' END AS next_segment_mode FROM events"""


def _rule_events(spark, sf):
    from catalog.base import events

    events(spark, sf).createOrReplaceTempView("_events_of_rules")
    return spark.sql(_RULE_EVENTS.replace("FROM events", "FROM _events_of_rules"))


@register(
    "mode_mismatch_c10",
    f"""WITH profile AS (SELECT *, {_LO} AS lo, {_HI} AS hi FROM ({_RULE_EVENTS}))
    SELECT event_id, NOT ok OR transfer AS mismatch,
           CASE WHEN ok AND transfer THEN 0.8 WHEN ok THEN 0.0 ELSE {rnd('least(0.95, 0.5 + 0.5 * over)', 2)} END AS confidence,
           CASE WHEN ok AND transfer THEN 'waiting' WHEN ok THEN NULL ELSE {_SUGGEST} END AS suggested_mode
    FROM (SELECT *, avg_speed_kmh BETWEEN lo AND hi AS ok, avg_speed_kmh BETWEEN lo AND hi AND {_TRANSFER} AS transfer,
          CASE WHEN avg_speed_kmh < lo THEN (lo - avg_speed_kmh) / greatest(lo, 1) ELSE (avg_speed_kmh - hi) / greatest(hi, 1) END AS over FROM profile)""",
)
def mode_mismatch_c10(spark, sf):
    verdict = modes.mode_mismatch(
        "classified_mode", "avg_speed_kmh", "max_speed_kmh", "speed_std_kmh", "prev_segment_mode", "next_segment_mode"
    )
    return plain(_rule_events(spark, sf).select("event_id", verdict.alias("v")).select("event_id", "v.mismatch", "v.confidence", "v.suggested_mode"))


@register("suggest_mode_c11", f"SELECT event_id, {_SUGGEST} AS mode FROM ({_RULE_EVENTS})")
def suggest_mode_c11(spark, sf):
    return _rule_events(spark, sf).select("event_id", modes.suggest_mode("avg_speed_kmh", "max_speed_kmh", "speed_std_kmh").alias("mode"))


# ------------------------------------------------------------- model


@register(
    "training_set_m1",
    chain(
        "segmented",
        f"SELECT record_id, {rnd('speed_kmh', 3)} AS speed_kmh, "
        + FEATURE_OUT_SQL.replace(" AS bearing,", " AS skip_bearing,")
        + ", CAST(day_of_week AS BIGINT) AS day_of_week, CAST(is_stopped AS BIGINT) AS is_stopped, transport_mode AS label FROM feats",
        feats=FEATURES_SQL,
    ).replace("SELECT record_id, CAST(round", "SELECT * EXCLUDE (skip_bearing) FROM (SELECT record_id, CAST(round", 1) + ")",
)
def training_set_m1(spark, sf):
    rows = training_set(point_features(points(spark, sf), CFG))
    names = [n for n in FEATURE_NAMES if n != "bearing"]
    return plain(rows.select("record_id", "speed_kmh", *names, "day_of_week", "is_stopped", "label"))


@register(
    "labelled_training_set_m2",
    with_labels(
        "SELECT label, count(*) AS n FROM (SELECT coalesce(l.corrected_mode, p.transport_mode) AS label FROM segmented p "
        f"SEMI JOIN (SELECT DISTINCT {_E}, commute_id FROM log) k USING ({_E}, commute_id) LEFT JOIN live l USING ({_K})) GROUP BY label"
    ),
)
def labelled_training_set_m2(spark, sf):
    pts = points(spark, sf)
    rows = M.labelled_training_set(pts, label_log(A.segments(pts)), cfg=CFG)
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def _model(spark, sf):
    # read by the log, the training and the judging: written once
    pts = stage(points(spark, sf), "points")
    log = stage(label_log(A.segments(pts)), "log")
    model = M.train_from_labels(pts, log, cfg=CFG)
    unstage(log)
    return pts, model


@register(
    "metrics_m4",
    chain(
        "classified",
        f"""SELECT mode, {rnd('CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END', 3)} AS "precision",
        {rnd('CASE WHEN support > 0 THEN hits / support ELSE 0.0 END', 3)} AS recall,
        {rnd('CASE WHEN hits > 0 THEN 2.0 * hits / (claimed + support) ELSE 0.0 END', 3)} AS f1, CAST(support AS BIGINT) AS support FROM (
        SELECT mode, CAST(sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS DOUBLE) AS hits, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS DOUBLE) AS support,
               CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) AS DOUBLE) AS claimed
        FROM (SELECT m AS mode, s.transport_mode = m AS a, c.mode0 = m AS b FROM classified c JOIN segz s USING (record_id),
              (VALUES {', '.join(f"('{m}')" for m in MODES)}) v(m)) GROUP BY mode) WHERE support > 0 OR claimed > 0""",
        segz="SELECT record_id, CASE WHEN speed_kmh < 1 THEN 'waiting' WHEN lat < 40.8004 THEN 'walking' ELSE 'train' END AS transport_mode FROM classified",
    ),
)
def metrics_m4(spark, sf):
    """Metrics of the speed rule against a synthetic truth on the same points."""
    from tripweave.operators.classify import build_ensemble

    pts = A.on_trips(points(spark, sf))
    truth = F.when(F.col("speed_kmh") < 1, "waiting").when(F.col("lat") < 40.8004, "walking").otherwise("train")
    judged = build_ensemble(cfg=CFG).classify(pts, [*_ENT, "commute_id"], "predicted").withColumn("label", truth)
    return plain(M.per_class_metrics(M.confusion(judged)))


_LABELLED_SQL = (
    "SELECT p.record_id, coalesce(l.corrected_mode, p.transport_mode) AS label FROM segmented p "
    f"SEMI JOIN (SELECT DISTINCT {_E}, commute_id FROM log) k USING ({_E}, commute_id) LEFT JOIN live l USING ({_K})"
)
_SPLIT_SQL = (
    "SELECT label, draw % 1000000 < 200000 OR (count(*) OVER (PARTITION BY label) > 1 AND draw = min(draw) OVER (PARTITION BY label)) AS is_test "
    f"FROM (SELECT label, CAST('0x' || substr(md5('42|' || CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT) AS draw FROM ({_LABELLED_SQL}))"
)


def _labelled_rows(spark, sf):
    pts = points(spark, sf)
    return M.labelled_training_set(pts, label_log(A.segments(pts)), cfg=CFG)


@register("hold_out_m3", with_labels(f"SELECT label, is_test, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY ALL"))
def hold_out_m3(spark, sf):
    """Rows held out of every class by a hash that both engines have."""
    return M.hold_out(_labelled_rows(spark, sf), 0.2).groupBy("label", "is_test").agg(F.count("*").alias("n"))


@register(
    "class_weights_m3",
    with_labels(
        f"SELECT label, {rnd('sum(n) OVER () / (count(*) OVER () * n)', 4)} AS weight FROM (SELECT label, count(*) AS n FROM ({_SPLIT_SQL}) WHERE NOT is_test GROUP BY label)"
    ),
)
def class_weights_m3(spark, sf):
    training = M.hold_out(_labelled_rows(spark, sf), 0.2).filter("not is_test")
    weights = M.class_weights({r["label"]: r["n"] for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()})
    return plain(spark.createDataFrame(sorted(weights.items()), "label string, weight double"), 4)


# The tree in SQL: one step for each level, over all trip points; only training rows are counted. Children of node n are 2n and 2n + 1.
_CLASSES = range(len(MODES))
_DEPTH = 10
_COLUMNS = [f"f{i}" for i in range(len(FEATURE_COLUMNS))]


def _purity_sql(counts: list[str]) -> str:
    weighted = [f"({n} * w{c})" for c, n in enumerate(counts)]
    return f"(({' + '.join(f'{x} * {x}' for x in weighted)}) / ({' + '.join(weighted)}))"


def _level_sql(k: int) -> str:
    left, total = [f"l{c}" for c in _CLASSES], [f"t{c}" for c in _CLASSES]
    right = [f"(t{c} - l{c})" for c in _CLASSES]
    counts = ", ".join(f"count(*) FILTER (label = {c}) AS c{c}" for c in _CLASSES)
    sums = ", ".join(f"sum(c{c}) OVER v AS l{c}, sum(c{c}) OVER (PARTITION BY node, feature) AS t{c}" for c in _CLASSES)
    moved = " ".join(f"WHEN {i} THEN n.{f}" for i, f in enumerate(_COLUMNS))
    return f"""
h{k} AS MATERIALIZED (SELECT node, feature, value, {counts} FROM long JOIN n{k} USING (record_id) GROUP BY node, feature, value),
b{k} AS MATERIALIZED (
  SELECT *, {_purity_sql(left)} + {_purity_sql(right)} AS score, {_purity_sql(total)} AS before
  FROM (SELECT node, feature, value, {sums}, lead(value) OVER v AS after FROM h{k} WINDOW v AS (PARTITION BY node, feature ORDER BY value)), weights
  WHERE after IS NOT NULL AND {' + '.join(f'CAST(t{c} > 0 AS INT)' for c in _CLASSES)} > 1
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, feature, value) = 1),
n{k + 1} AS MATERIALIZED (
  SELECT n.* REPLACE (CASE WHEN b.node IS NULL THEN n.node WHEN CASE b.feature {moved} END <= floor((b.value + b.after) / 2.0) THEN 2 * n.node
                      ELSE 2 * n.node + 1 END AS node) FROM n{k} n LEFT JOIN b{k} b ON n.node = b.node)"""


_NAMES_SQL = " ".join(f"WHEN {c} THEN '{m}'" for c, m in enumerate(MODES))
_WHOLE_SQL = ", ".join(f"CAST(round(1000 * {n}) AS BIGINT) AS {f}" for n, f in zip(FEATURE_COLUMNS, _COLUMNS, strict=True))
_INDEX_SQL = " ".join(f"WHEN '{m}' THEN {c}" for c, m in enumerate(MODES))
_WEIGHT_SQL = ", ".join(f"coalesce(CAST(sum(n) AS DOUBLE) / (count(*) * max(n) FILTER (label = {c})), 0) AS w{c}" for c in _CLASSES)
_LEAF_SQL = ", ".join(f"count(*) FILTER (label = {c} AND is_test = false) * any_value(w{c}) AS p{c}" for c in _CLASSES)
_CHOICE_SQL = " ".join(f"WHEN p{c} = greatest({', '.join(f'p{x}' for x in _CLASSES)}) THEN '{MODES[c]}'" for c in _CLASSES)


def _tree_sql(body: str) -> str:
    """``body`` over ``judged`` (trip points with their leaf's class weights p0.. and ``predicted``) and ``splits``."""
    splits = " UNION ALL ".join(f"SELECT feature, score - before AS gain FROM b{k}" for k in range(_DEPTH))
    inner = f"""
WITH split AS MATERIALIZED ({_SPLIT_SQL.replace("SELECT label, draw %", "SELECT record_id, label, draw %").replace("(SELECT label, CAST(", "(SELECT record_id, label, CAST(")}),
valued AS MATERIALIZED (SELECT record_id, transport_mode, {rnd('speed_kmh', 3)} AS speed_kmh, day_of_week, is_stopped,
  {FEATURE_OUT_SQL} FROM feats),
n0 AS MATERIALIZED (SELECT record_id, transport_mode, CASE s.label {_INDEX_SQL} END AS label, is_test, {_WHOLE_SQL}, CAST(1 AS BIGINT) AS node
  FROM valued LEFT JOIN split s USING (record_id)),
long AS MATERIALIZED (
  {" UNION ALL ".join(f"SELECT record_id, {i} AS feature, {f} AS value FROM n0 WHERE is_test = false" for i, f in enumerate(_COLUMNS))}),
weights AS MATERIALIZED (SELECT {_WEIGHT_SQL} FROM (SELECT label, count(*) AS n FROM n0 WHERE is_test = false GROUP BY label)),
{",".join(_level_sql(k) for k in range(_DEPTH))},
leaves AS MATERIALIZED (SELECT node, {_LEAF_SQL} FROM n{_DEPTH}, weights GROUP BY node),
judged AS MATERIALIZED (SELECT record_id, transport_mode, CASE label {_NAMES_SQL} END AS label, is_test, leaves.*, CASE {_CHOICE_SQL} END AS predicted
  FROM n{_DEPTH} JOIN leaves USING (node)),
splits AS MATERIALIZED ({splits})
{body}"""
    return with_labels(f"SELECT * FROM ({inner})", feats=FEATURES_SQL)


_FEATURE_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURE_COLUMNS))
_METRICS_SQL = f"""
SELECT 'overall' AS section, 'all' AS name, 'accuracy' AS metric, {rnd("avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END)", 4)} AS value FROM judged WHERE is_test
UNION ALL SELECT 'overall', 'all', 'sample_count', CAST(count(*) AS DOUBLE) FROM judged WHERE label IS NOT NULL
UNION ALL SELECT 'importance', name, 'importance', {rnd("coalesce(sum(gain), 0) / (SELECT sum(gain) FROM splits)", 4)}
  FROM (VALUES {_FEATURE_VALUES}) v(feature, name) LEFT JOIN splits USING (feature) GROUP BY name
UNION ALL SELECT 'per_class', mode, metric, value FROM (
  UNPIVOT (SELECT mode, {rnd('CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END', 3)} AS "precision",
    {rnd('CASE WHEN support > 0 THEN hits / support ELSE 0.0 END', 3)} AS recall,
    {rnd('CASE WHEN hits > 0 THEN 2.0 * hits / (claimed + support) ELSE 0.0 END', 3)} AS f1, support
    FROM (SELECT mode, CAST(count(*) FILTER (label = mode AND predicted = mode) AS DOUBLE) AS hits, CAST(count(*) FILTER (label = mode) AS DOUBLE) AS support,
      CAST(count(*) FILTER (predicted = mode) AS DOUBLE) AS claimed
      FROM (SELECT * FROM judged WHERE is_test), (VALUES {', '.join(f"('{m}')" for m in MODES)}) v(mode) GROUP BY mode) WHERE support > 0 OR claimed > 0)
  ON "precision", recall, f1, support INTO NAME metric VALUE value)"""


@register("train_model_m3", _tree_sql(_METRICS_SQL))
def train_model_m3(spark, sf):
    return M.metrics_frame(spark, _model(spark, sf)[1])


@register("model_probabilities_m5", chain("segmented", "SELECT true AS sums_to_one, count(*) AS n FROM segmented"))
def model_probabilities_m5(spark, sf):
    """Class probabilities of every trip point add up to 1."""
    pts, model = _model(spark, sf)
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return model.score(A.on_trips(pts), _ENT, "odds").groupBy((F.abs(total - 1) < 1e-9).alias("sums_to_one")).agg(F.count("*").alias("n"))


@register("untrained_model_m5", chain("segmented", "SELECT true AS all_zero, count(*) AS n FROM segmented"))
def untrained_model_m5(spark, sf):
    """Without a tree every score is zero."""
    rows = M.ModeModel(cfg=CFG).score(A.on_trips(points(spark, sf)), _ENT, "odds")
    return rows.groupBy(F.forall("odds", lambda x: x == 0).alias("all_zero")).agg(F.count("*").alias("n"))


@register("model_predict_m5", _tree_sql("SELECT transport_mode, predicted, count(*) AS n FROM judged GROUP BY ALL"))
def model_predict_m5(spark, sf):
    pts, model = _model(spark, sf)
    return model.predict(A.on_trips(pts)).groupBy("transport_mode", "predicted").agg(F.count("*").alias("n"))


_TOTAL_SQL = f"({' + '.join(f'p{c}' for c in _CLASSES)})"
_VOTED_SQL = ", ".join(f"v_{m} + p{c} / {_TOTAL_SQL} * 2.0 AS s{c}" for c, m in enumerate(MODES))
_VOTE_SQL = " ".join(f"WHEN s{c} = greatest({', '.join(f's{x}' for x in _CLASSES)}) THEN '{m}'" for c, m in enumerate(MODES))


@register(
    "model_ensemble_m5",
    _tree_sql(
        f"SELECT transport_mode, CASE {_VOTE_SQL} END AS mode, count(*) AS n FROM (SELECT judged.transport_mode, {_VOTED_SQL} "
        "FROM judged JOIN classified USING (record_id)) GROUP BY ALL"
    ),
)
def model_ensemble_m5(spark, sf):
    from tripweave.operators.classify import build_ensemble

    pts, model = _model(spark, sf)
    voted = build_ensemble(cfg=CFG).plus(model, 2.0).classify(A.on_trips(pts), [*_ENT, "commute_id"], "mode")
    return voted.groupBy("transport_mode", "mode").agg(F.count("*").alias("n"))


@register("save_load_model_m6", chain("segmented", "SELECT true AS same, count(*) AS n FROM segmented"))
def save_load_model_m6(spark, sf):
    pts, model = _model(spark, sf)
    path = scratch_path(spark, "model")
    model.save(path)
    again = M.ModeModel.load(spark, path, CFG)
    both = again.predict(model.predict(A.on_trips(pts), "first"), "second")
    return both.groupBy((F.col("first") == F.col("second")).alias("same")).agg(F.count("*").alias("n"))


_CONFUSION = f"SELECT coalesce(transport_mode, 'none') AS predicted, corrected_mode AS actual, count(*) AS n FROM segmented JOIN live USING ({_K}) GROUP BY 1, 2"


@register("evaluate_classifier_m7", with_labels(_CONFUSION))
def evaluate_classifier_m7(spark, sf):
    pts = points(spark, sf)
    log = label_log(A.segments(pts))
    return M.evaluate_classifier(L.apply_corrections(pts, log), log)


@register(
    "classifier_accuracy_m7",
    with_labels(f"SELECT {rnd('sum(CASE WHEN predicted = actual THEN n ELSE 0 END) / sum(n)', 4)} AS accuracy, CAST(sum(CASE WHEN predicted = actual THEN n ELSE 0 END) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS total FROM ({_CONFUSION})"),
)
def classifier_accuracy_m7(spark, sf):
    pts = points(spark, sf)
    return plain(M.accuracy(M.evaluate_classifier(pts, label_log(A.segments(pts))), "actual", "predicted"), 4)

