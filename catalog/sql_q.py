"""Ad-hoc SQL over the point views, one query per family of SELECT features."""

from __future__ import annotations

from catalog.base import plain, points, rnd, with_summaries
from catalog.registry import register
from tripweave.plans.sql import query, register_views

# name -> (Spark SQL, DuckDB body over CTEs commute_data, commutes, segments)
_R1 = "round(round({}, 6), 1)"
_PAIRS = {
    "sql_aggregate_q1": (
        f"SELECT commute_direction, {_R1.format('avg(speed_kmh)')} AS avg_speed, count(*) AS n FROM commute_data WHERE commute_id IS NOT NULL GROUP BY commute_direction",
        f"SELECT commute_direction, {rnd('avg(speed_kmh)', 1)} AS avg_speed, count(*) AS n FROM commute_data GROUP BY commute_direction",
    ),
    "sql_departures_q1": (
        "SELECT commute_id, user, device, hour(start_time) AS h, minute(start_time) AS m FROM commutes",
        "SELECT commute_id, \"user\", device, hour(start_time) AS h, minute(start_time) AS m FROM commutes",
    ),
    "sql_join_q1": (
        "SELECT c.user, c.device, c.commute_id, s.segment_id, s.transport_mode, c.duration_min FROM commutes c JOIN segments s "
        "ON c.user = s.user AND c.device = s.device AND c.commute_id = s.commute_id WHERE s.duration_min >= 0.5",
        "SELECT c.\"user\", c.device, c.commute_id, s.segment_id, s.transport_mode, c.duration_min FROM commutes c JOIN segments s "
        "ON c.\"user\" = s.\"user\" AND c.device = s.device AND c.commute_id = s.commute_id WHERE s.duration_min >= 0.5",
    ),
    "sql_set_operations_q1": (
        "SELECT user, commute_id FROM commutes WHERE device = 'd0' EXCEPT SELECT user, commute_id FROM commutes WHERE device = 'd1' "
        "UNION SELECT user, commute_id FROM segments WHERE transport_mode = 'walking'",
        "(SELECT \"user\", commute_id FROM commutes WHERE device = 'd0' EXCEPT SELECT \"user\", commute_id FROM commutes WHERE device = 'd1') "
        "UNION SELECT \"user\", commute_id FROM segments WHERE transport_mode = 'walking'",
    ),
    "sql_rollup_q1": (
        "SELECT user, commute_direction, grouping_id(user, commute_direction) AS g, count(*) AS n FROM commutes GROUP BY ROLLUP (user, commute_direction)",
        "SELECT \"user\", commute_direction, grouping_id(\"user\", commute_direction) AS g, count(*) AS n FROM commutes GROUP BY ROLLUP (\"user\", commute_direction)",
    ),
    "sql_cube_q1": (
        "SELECT device, transport_mode, count(*) AS n FROM segments GROUP BY CUBE (device, transport_mode)",
        "SELECT device, transport_mode, count(*) AS n FROM segments GROUP BY CUBE (device, transport_mode)",
    ),
    "sql_grouping_sets_q1": (
        "SELECT user, transport_mode, count(*) AS n FROM segments GROUP BY GROUPING SETS ((user), (transport_mode))",
        "SELECT \"user\", transport_mode, count(*) AS n FROM segments GROUP BY GROUPING SETS ((\"user\"), (transport_mode))",
    ),
    "sql_ranking_q1": (
        "SELECT user, device, commute_id, dense_rank() OVER (PARTITION BY user, device ORDER BY duration_min DESC) AS place, "
        "row_number() OVER (PARTITION BY user, device ORDER BY start_time, commute_id) AS nth FROM commutes",
        "SELECT \"user\", device, commute_id, dense_rank() OVER (PARTITION BY \"user\", device ORDER BY duration_min DESC) AS place, "
        "row_number() OVER (PARTITION BY \"user\", device ORDER BY start_time, commute_id) AS nth FROM commutes",
    ),
    "sql_top_k_q1": (
        "SELECT user, device, commute_id, duration_min FROM commutes ORDER BY duration_min DESC, commute_id, user, device LIMIT 10",
        "SELECT \"user\", device, commute_id, duration_min FROM commutes ORDER BY duration_min DESC, commute_id, \"user\", device LIMIT 10",
    ),
    "sql_subquery_cte_q1": (
        "SELECT * FROM (WITH slow AS (SELECT commute_id, user, device FROM segments WHERE avg_speed_kmh < 7) "
        "SELECT DISTINCT user, device, commute_id FROM slow WHERE commute_id IN (SELECT commute_id FROM commutes WHERE point_count >= 3))",
        "SELECT DISTINCT \"user\", device, commute_id FROM segments WHERE avg_speed_kmh < 7 AND commute_id IN (SELECT commute_id FROM commutes WHERE point_count >= 3)",
    ),
    "sql_string_functions_q1": (
        "SELECT DISTINCT upper(transport_mode) AS mode, concat_ws('/', user, device) AS who, substr(commute_id, 12) AS way, "
        "length(transport_mode) AS n FROM segments WHERE commute_id LIKE '2024-01-1%'",
        "SELECT DISTINCT upper(transport_mode) AS mode, concat_ws('/', \"user\", device) AS who, substr(commute_id, 12) AS way, "
        "length(transport_mode) AS n FROM segments WHERE commute_id LIKE '2024-01-1%'",
    ),
    "sql_date_functions_q1": (
        "SELECT cast(local_date AS string) AS day, cast(date_add(local_date, 7) AS string) AS next_week, dayofyear(local_date) AS nth, count(*) AS n "
        "FROM commute_data WHERE commute_id IS NOT NULL GROUP BY local_date",
        "SELECT CAST(local_date AS VARCHAR) AS day, CAST(local_date + 7 AS VARCHAR) AS next_week, dayofyear(local_date) AS nth, count(*) AS n "
        "FROM commute_data GROUP BY local_date",
    ),
    "sql_array_functions_q1": (
        "SELECT user, device, commute_id, array_join(array_sort(collect_set(transport_mode)), ',') AS modes FROM segments GROUP BY user, device, commute_id",
        "SELECT \"user\", device, commute_id, array_to_string(list_sort(list(DISTINCT transport_mode)), ',') AS modes FROM segments GROUP BY \"user\", device, commute_id",
    ),
    "sql_conditional_aggregate_q1": (
        "SELECT user, device, count(*) FILTER (WHERE transport_mode = 'train') AS trains, max(CASE WHEN transport_mode = 'walking' THEN duration_min END) AS longest_walk "
        "FROM segments GROUP BY user, device HAVING count(*) > 1",
        "SELECT \"user\", device, count(*) FILTER (WHERE transport_mode = 'train') AS trains, max(CASE WHEN transport_mode = 'walking' THEN duration_min END) AS longest_walk "
        "FROM segments GROUP BY \"user\", device HAVING count(*) > 1",
    ),
}


def _query(sql: str):
    def run(spark, sf):
        register_views(points(spark, sf))
        return plain(query(spark, sql))

    return run


for _name, (_spark_sql, _duck_sql) in _PAIRS.items():
    register(_name, with_summaries(_duck_sql, commute_data="SELECT * FROM segmented"))(_query(_spark_sql))
