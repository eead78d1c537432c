"""Registry of named queries, shared steps of the network context, and oracle SQL pieces."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transitloom import constants as C
from transitloom.functions.draws import poisson_cdf
from transitloom.operators import demand, network, routes, scenario, timetable
from transitloom.session import STEPS, input_state
from transitloom.sources.bindings import Tables, oracle

RUN_ID = "run-1"
SERVICE_DATE = "1998-01-05"

COMPRESSION = "spark.sql.sources.fileCompressionFactor"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Names a query; ``sql`` is its DuckDB twin with bindings and steps in braces."""

    def wrap(build: Callable[["Context"], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Context(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql, STEPS_SQL)
        return build

    return wrap


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounds a double for output, so that summation order does not show."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits)


class Context:
    """Bound tables plus the derived steps that many queries share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.t = Tables(spark, folder)
        # Stored steps repeat names and shrink to few bytes a row; without this factor millions of rows look small enough to broadcast.
        if float(spark.conf.get(COMPRESSION, "1")) == 1:
            spark.conf.set(COMPRESSION, "32")

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return STEPS.get(self.spark, (self.folder, self.state), name, build)

    @cached_property
    def state(self) -> int:
        return input_state(self.spark, self.folder)

    @cached_property
    def frequencies(self) -> DataFrame:
        return timetable.valid_frequencies(self.t.frequencies, self.t.trips)

    @cached_property
    def template(self) -> DataFrame:
        return self.step("template", lambda: timetable.template_stops(self.t.stop_times, self.t.stops))

    @cached_property
    def matched(self) -> DataFrame:
        return self.step("matched", lambda: timetable.match_segments(self.template, self.t.trips, self.t.segments))

    @cached_property
    def patterns(self) -> DataFrame:
        summary = timetable.match_summary(self.matched)
        return self.step("patterns", lambda: timetable.service_patterns(self.frequencies, self.template, summary))

    @cached_property
    def ranked(self) -> DataFrame:
        return self.step("ranked", lambda: timetable.rank_members(timetable.group_patterns(self.patterns)))

    @cached_property
    def selected(self) -> DataFrame:
        return timetable.selected_patterns(self.ranked)

    @cached_property
    def instances(self) -> DataFrame:
        return self.step("instances", lambda: timetable.trip_instances(self.selected))

    @cached_property
    def visits(self) -> DataFrame:
        return timetable.instance_stops(self.instances, self.template)

    @cached_property
    def hops(self) -> DataFrame:
        return timetable.instance_hops(self.instances, self.trip_hops)

    @cached_property
    def trip_hops(self) -> DataFrame:
        return self.step("trip_hops", lambda: timetable.template_hops(self.template, self.matched))

    @cached_property
    def loads(self) -> DataFrame:
        def build() -> DataFrame:
            resolved = demand.resolve_ridership(self.t.riders, self.t.members, SERVICE_DATE, RUN_ID)
            return demand.trip_loads(self.instances, resolved, RUN_ID)

        return self.step("loads", build)

    @cached_property
    def segment_loads(self) -> DataFrame:
        return demand.trip_segment_loads(demand.trip_segments(self.trip_hops, self.matched), self.loads, RUN_ID)

    def segment_loads_at(self, second: Column) -> DataFrame:
        """Segment loads of the instances that ride a segment at ``second``."""
        return demand.trip_segment_loads(demand.trip_segments(self.trip_hops, self.matched), self.loads, RUN_ID, second)

    @cached_property
    def all_segments(self) -> DataFrame:
        return network.augment_segments(self.t.segments, self.t.members, self.t.stop_times, self.t.trips, self.t.stops)[0]

    @cached_property
    def edges(self) -> DataFrame:
        """Network edges with the constant density; searches do not depend on density."""
        weighted = network.edge_weights(self.all_segments, None, None, None)
        return self.step("edges", lambda: network.network_edges(weighted, self.t.members, self.t.stops))

    @cached_property
    def od(self) -> DataFrame:
        """All pairs of the request table."""
        pairs = self.t.catalog.select("origin", "destination").distinct()
        return pairs.select(F.concat_ws(">", "origin", "destination").alias("od_id"), "origin", "destination")

    @cached_property
    def routes(self) -> DataFrame:
        return self.step("routes", lambda: routes.candidate_routes(self.od, network.route_moves(self.edges)))

    @cached_property
    def route_totals(self) -> DataFrame:
        """Totals of the stored routes, one row per route."""
        return self.step("route_totals", lambda: routes.route_totals(self.t.route_steps))

    @cached_property
    def ranked_routes(self) -> DataFrame:
        return self.step("ranked_routes", lambda: routes.primary_ranks(self.step("scored_routes", lambda: routes.scored_routes(self.route_totals))))

    @cached_property
    def typed_routes(self) -> DataFrame:
        ranked = self.ranked_routes.withColumnRenamed("primary_rank", "rank")
        return self.step("typed_routes", lambda: scenario.classify_routes(ranked, ["od_id"]))


# ---- oracle pieces ---------------------------------------------------------------------------------


def sec_sql(c: str) -> str:
    part = f"string_split(trim({c}), ':')"
    return (
        f"CASE WHEN len({part}) = 3 THEN try_cast({part}[1] AS INT) * 3600 + try_cast({part}[2] AS INT) * 60 "
        f"+ try_cast({part}[3] AS INT) END"
    )


def norm_sql(c: str) -> str:
    return f"coalesce(regexp_replace(trim(CAST({c} AS VARCHAR)), '\\.0$', ''), '')"


def hash_sql(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts) + ")"
    return f"CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT)"


def pick_sql(n: str, *parts: str) -> str:
    """The 64-bit hash modulo n, from its two halves."""
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts) + ")"
    return f"CAST(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT) % ({n}) AS BIGINT)"


def uniform_sql(*parts: str) -> str:
    return f"(({hash_sql(*parts)} + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def normal_sql(std: float, low: float, high: float, *parts: str) -> str:
    u1, u2 = uniform_sql(*parts, "'a'"), uniform_sql(*parts, "'b'")
    return (
        f"greatest({low}::DOUBLE, least({high}::DOUBLE, 1.0::DOUBLE + {std}::DOUBLE * sqrt(-2.0::DOUBLE * ln({u1})) "
        f"* cos(6.283185307179586::DOUBLE * {u2})))"
    )


def band_sql(c: str, field: int) -> str:
    s = f"(({c}) % 86400)"
    show = (lambda v: f"'{v}'") if field == 0 else (lambda v: f"{v}::DOUBLE")
    arms = " ".join(f"WHEN {s} >= {b[1]} AND {s} < {b[2]} THEN {show(b[field])}" for b in C.TIME_BANDS[:-1])
    return f"CASE {arms} ELSE {show(C.TIME_BANDS[-1][field])} END"


def cdf_sql(lam: float) -> str:
    return "[" + ", ".join(f"{p!r}::DOUBLE" for p in poisson_cdf(lam)) + "]"


def poisson_sql(lam: float, *parts: str) -> str:
    return f"CAST(len(list_filter({cdf_sql(lam)}, lambda p: p < {uniform_sql(*parts)})) AS INT)"


def clamp_sql(c: str) -> str:
    return f"coalesce(greatest(0.0::DOUBLE, least({c}, 1.0::DOUBLE)), 0.5::DOUBLE)"


def dist_sql(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) "
        f"* sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    )
    return f"(2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bearing_sql(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"fmod(degrees(atan2({y}, {x})) + 360.0::DOUBLE, 360.0::DOUBLE)"


TIMES_SQL = "(VALUES " + ", ".join(f"('{label}', {s})" for label, s in C.SAMPLE_TIMES) + ") AS times(time, second)"

STEPS_SQL: dict[str, str] = {
    "o_freq": f"""
        SELECT f.trip_id, {norm_sql('t.route_id')} AS corridor_id, t.direction_id, {sec_sql('f.start_time')} AS start_sec,
               {sec_sql('f.end_time')} AS end_sec, f.headway_secs AS headway
        FROM {{frequencies}} f LEFT JOIN {{trips}} t ON f.trip_id = t.trip_id""",
    "o_freq_ok": "SELECT * FROM {o_freq} WHERE corridor_id <> '' AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND headway > 0 AND end_sec > start_sec",
    "o_rows": f"""
        SELECT st.trip_id, st.stop_sequence AS seq, st.stop_id, s.name, s.lat, s.lng, {sec_sql('st.arrival_time')} AS arr,
               {sec_sql('st.departure_time')} AS dep
        FROM {{stop_times}} st LEFT JOIN {{stops}} s ON st.stop_id = s.stop_id""",
    "o_template": """
        SELECT trip_id, seq, stop_id, name, lat, lng, arr, dep, row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS pos
        FROM {o_rows} WHERE trip_id IN (
          SELECT trip_id FROM {o_rows} GROUP BY trip_id
          HAVING count(*) >= 2 AND count(*) = count(CASE WHEN lat IS NOT NULL AND arr IS NOT NULL AND dep IS NOT NULL THEN 1 END))""",
    "o_hops": """
        SELECT h.*, t.route_id AS corridor_id FROM (
          SELECT trip_id, pos, stop_id AS from_stop, dep, lead(stop_id) OVER w AS to_stop, lead(arr) OVER w AS next_arr
          FROM {o_template} WINDOW w AS (PARTITION BY trip_id ORDER BY pos)) h
        JOIN {trips} t ON h.trip_id = t.trip_id WHERE to_stop IS NOT NULL""",
    "o_matched": """
        SELECT h.trip_id, h.corridor_id, h.pos, h.from_stop, h.to_stop, g.segment_id
        FROM {o_hops} h LEFT JOIN {segments} g
          ON g.corridor_id = h.corridor_id AND g.from_stop = h.from_stop AND g.to_stop = h.to_stop""",
    "o_summary": """
        SELECT trip_id, corridor_id, count(segment_id) AS matched, count(*) AS pairs,
               count(segment_id)::DOUBLE / count(*) AS match_ratio FROM {o_matched} GROUP BY ALL""",
    "o_sig": """
        SELECT trip_id, list(stop_id ORDER BY pos) AS signature, min(dep) AS first_dep, max(arr) AS last_arr FROM {o_template} GROUP BY trip_id""",
    "o_patterns": """
        SELECT corridor_id, direction_id, signature, start_sec, end_sec, headway, min(trip_id) AS trip_id, count(*) AS raw_rows,
               any_value(last_arr - first_dep) AS duration, any_value(first_dep) AS first_dep, any_value(match_ratio) AS match_ratio,
               len(signature) AS stop_count, concat_ws('|', min(trip_id), start_sec, end_sec, headway) AS pattern_id
        FROM (SELECT f.corridor_id, f.direction_id, s.signature, f.start_sec, f.end_sec, f.headway, f.trip_id, s.first_dep, s.last_arr, m.match_ratio
              FROM {o_freq_ok} f JOIN {o_sig} s ON f.trip_id = s.trip_id JOIN {o_summary} m ON f.trip_id = m.trip_id) p
        GROUP BY corridor_id, direction_id, signature, start_sec, end_sec, headway""",
    "o_nodes": "SELECT corridor_id, direction_id, signature, min(pattern_id) AS node FROM {o_patterns} GROUP BY ALL",
    "o_pairs": """
        SELECT a.corridor_id, a.direction_id, a.node AS short, b.node AS long, a.signature AS sa, b.signature AS sb
        FROM {o_nodes} a JOIN {o_nodes} b ON a.corridor_id = b.corridor_id AND a.direction_id = b.direction_id
         AND (len(a.signature) < len(b.signature) OR (len(a.signature) = len(b.signature) AND a.node < b.node))""",
    "o_lcs": """
        SELECT short, long, sa, sb, 0 AS i, list_transform(range(0, len(sb) + 1), lambda x: 0::BIGINT) AS line FROM {o_pairs}
        UNION ALL
        SELECT short, long, sa, sb, i + 1,
               list_transform(range(0, len(sb) + 1), lambda j: list_max(list_transform(range(0, j + 1),
                 lambda k: CASE WHEN k > 0 AND sb[k] = sa[i + 1] THEN line[k] + 1 ELSE line[k + 1] END)))
        FROM o_lcs WHERE i < len(sa)""",
    "o_overlap": """
        SELECT short, long, sa, sb, line[len(line)]::DOUBLE / len(sa) AS overlap FROM {o_lcs} WHERE i = len(sa) AND line[len(line)]::DOUBLE / len(sa) >= 0.8""",
    "o_reach": """
        SELECT node AS a, node AS b FROM {o_nodes}
        UNION SELECT r.a, CASE WHEN o.short = r.b THEN o.long ELSE o.short END FROM o_reach r JOIN {o_overlap} o ON o.short = r.b OR o.long = r.b""",
    "o_grouped": """
        SELECT p.*, g.label AS group_id FROM {o_patterns} p
        JOIN {o_nodes} n ON p.corridor_id = n.corridor_id AND p.direction_id = n.direction_id AND p.signature = n.signature
        JOIN (SELECT a, min(b) AS label FROM {o_reach} GROUP BY a) g ON n.node = g.a""",
    "o_ranked": """
        SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY match_ratio DESC, stop_count DESC, headway, duration DESC, trip_id, start_sec, end_sec) AS preference,
               min(headway) OVER (PARTITION BY group_id) AS service_headway, count(*) OVER (PARTITION BY group_id) AS members
        FROM {o_grouped}""",
    "o_chosen": """
        SELECT *, row_number() OVER w - 1 AS pattern_index, count(*) OVER (PARTITION BY corridor_id, direction_id) AS group_count
        FROM {o_ranked} WHERE preference = 1
        WINDOW w AS (PARTITION BY corridor_id, direction_id ORDER BY start_sec, end_sec, service_headway, trip_id, pattern_id)""",
    "o_selected": """
        SELECT *, CASE WHEN group_count > 1 THEN CAST(round_even(pattern_index * service_headway / group_count, 0) AS INT) ELSE 0 END AS shift_secs FROM {o_chosen}""",
    "o_departures": """
        SELECT s.corridor_id, s.direction_id, s.trip_id, s.pattern_index, s.first_dep, s.duration, unnest(range(s.start_sec + s.shift_secs, s.end_sec, s.service_headway)) AS departure
        FROM {o_selected} s""",
    "o_instances": """
        SELECT concat('BUS-', corridor_id, '-', direction_id, '-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS instance_id,
               corridor_id, direction_id, trip_id, departure, departure - first_dep AS shift, departure AS first_dep, departure + duration AS last_arr
        FROM (SELECT *, row_number() OVER (PARTITION BY corridor_id, direction_id ORDER BY pattern_index, departure) AS n FROM {o_departures}) numbered WHERE duration > 0""",
    "o_visits": """
        SELECT i.instance_id, i.corridor_id, i.direction_id, i.trip_id, i.departure, t.pos, t.stop_id, t.name, t.lat, t.lng, t.arr + i.shift AS arr, t.dep + i.shift AS dep
        FROM {o_instances} i JOIN {o_template} t ON i.trip_id = t.trip_id""",
    "o_ihops": """
        SELECT h.*, m.segment_id FROM (
          SELECT instance_id, corridor_id, direction_id, trip_id, departure, pos, stop_id AS from_stop, lat, lng, arr, dep,
                 lead(stop_id) OVER w AS to_stop, lead(name) OVER w AS to_name, lead(lat) OVER w AS to_lat, lead(lng) OVER w AS to_lng,
                 lead(arr) OVER w AS next_arr, count(*) OVER (PARTITION BY instance_id) - 1 AS pairs
          FROM {o_visits} WINDOW w AS (PARTITION BY instance_id ORDER BY pos)) h
        LEFT JOIN {o_matched} m ON m.trip_id = h.trip_id AND m.pos = h.pos WHERE h.to_stop IS NOT NULL""",
    "o_ridden": """
        SELECT instance_id, corridor_id, pos, segment_id, dep, next_arr FROM {o_ihops} WHERE segment_id IS NOT NULL
        UNION ALL
        SELECT i.instance_id, i.corridor_id, NULL, g.segment_id, NULL, NULL
        FROM {o_instances} i JOIN {o_summary} m ON m.trip_id = i.trip_id AND m.matched = 0 JOIN {segments} g ON g.corridor_id = i.corridor_id""",
    "o_used": f"""
        SELECT r.corridor_id, r.date AS used_date, r.riders FROM {{riders}} r
        JOIN (SELECT corridor_id, coalesce(max(CASE WHEN date = DATE '{SERVICE_DATE}' THEN date END), max(date)) AS pick FROM {{riders}} GROUP BY corridor_id) p
          ON r.corridor_id = p.corridor_id AND r.date = p.pick""",
    "o_weights": f"""
        SELECT i.*, u.used_date, u.riders, {band_sql('i.departure', 0)} AS band,
               {band_sql('i.departure', 3)} * {normal_sql(0.15, 0.6, 1.4, 'u.used_date', 'i.corridor_id', 'i.instance_id', f"'{RUN_ID}'")} AS weight
        FROM {{o_instances}} i LEFT JOIN {{o_used}} u ON i.corridor_id = u.corridor_id""",
    "o_loads": """
        SELECT instance_id, corridor_id, direction_id, trip_id, departure, used_date, riders, band,
               CASE WHEN riders IS NULL THEN NULL ELSE weight END AS weight,
               CASE WHEN riders IS NULL THEN 40.0::DOUBLE ELSE riders * weight / total END AS passengers,
               CASE WHEN riders IS NULL THEN 0.5::DOUBLE ELSE riders * weight / total / 80 END AS load
        FROM (SELECT *, sum(weight) OVER (PARTITION BY corridor_id) AS total FROM {o_weights}) w""",
    "o_segraw": f"""
        SELECT h.instance_id, h.corridor_id, h.pos, h.segment_id, h.dep, h.next_arr, l.load,
               l.load * {normal_sql(0.10, 0.8, 1.2, 'l.used_date', 'h.corridor_id', 'h.instance_id', 'h.segment_id', f"'{RUN_ID}'")} AS raw
        FROM {{o_ridden}} h JOIN {{o_loads}} l ON h.instance_id = l.instance_id""",
    "o_segloads": """
        SELECT *, CASE WHEN avg_raw > 0 THEN raw * (load / avg_raw) ELSE raw END AS segment_load
        FROM (SELECT *, avg(raw) OVER (PARTITION BY instance_id) AS avg_raw FROM {o_segraw}) s""",
}
