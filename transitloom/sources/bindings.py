"""Transit tables derived from the driver's generic tables, as SQL that both engines read.

Each binding names its inputs in braces. ``@explode(a, b, ...)`` stands for one output row per
listed value (Spark ``explode``, DuckDB ``unnest``). The network grows with ``supplier``: every
100 suppliers form a district with 13 lines, so lines keep a realistic length at any scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _hms(expr: str) -> str:
    def two(e: str) -> str:
        return f"lpad(CAST(CAST({e} AS BIGINT) AS STRING), 2, '0')"

    return (
        f"concat({two(f'floor(({expr}) / 3600)')}, ':', "
        f"{two(f'floor((({expr}) % 3600) / 60)')}, ':', {two(f'({expr}) % 60')})"
    )


def _millis(ts: str) -> str:
    return f"@millis({ts})"


BINDINGS: dict[str, str] = {
    # ---- network family (supplier) -------------------------------------------------------------
    "net": "SELECT s_suppkey AS k, CAST(floor(s_suppkey / 100) AS BIGINT) AS d, s_nationkey AS nk FROM {supplier}",
    "stops": """
        SELECT CAST(k AS STRING) AS stop_id,
               concat('Stop ', CAST(CAST(floor(k / 2) AS BIGINT) AS STRING),
                      CASE WHEN k % 2 = 0 THEN ' arah utara' ELSE ' arah selatan' END) AS name,
               CAST(-6.2 AS DOUBLE) + (k % 2) * CAST(0.001 AS DOUBLE) + (d % 50) * CAST(0.02 AS DOUBLE) AS lat,
               CAST(106.8 AS DOUBLE) + CAST(floor((k % 100) / 2) AS BIGINT) * CAST(0.004 AS DOUBLE)
                   + CAST(floor(d / 50) AS BIGINT) * CAST(0.25 AS DOUBLE) AS lng
        FROM {net}""",
    "members": """
        SELECT corridor_id, cnum, stop_id, k, seq, n_stops FROM (
          SELECT CAST(cnum AS STRING) AS corridor_id, cnum, CAST(k AS STRING) AS stop_id, k,
                 CAST(row_number() OVER (PARTITION BY cnum ORDER BY k) AS INT) AS seq,
                 CAST(count(*) OVER (PARTITION BY cnum) AS INT) AS n_stops
          FROM (SELECT d * 13 + 1 + nk % 8 AS cnum, k FROM {net}
                UNION ALL SELECT d * 13 + 9 + k % 5 AS cnum, k FROM {net}) AS both_lines) AS numbered
        WHERE n_stops >= 2""",
    "hops": """
        SELECT corridor_id, cnum, stop_id AS a, seq, CAST(120 + 7 * (seq % 5) AS INT) AS secs,
               lead(stop_id) OVER (PARTITION BY corridor_id ORDER BY seq) AS b
        FROM {members}""",
    # Lines with a number divisible by five have one gap, which the timetable must fill. One line in 26 has only segments
    # that skip a stop, so that none of its hops is matched.
    "segment_pairs": """
        SELECT corridor_id, a, b, seq, secs FROM {hops} WHERE b IS NOT NULL AND NOT (cnum % 5 = 0 AND seq = 2) AND cnum % 26 <> 6
        UNION ALL
        SELECT corridor_id, a, c AS b, seq, secs FROM (
          SELECT corridor_id, cnum, a, seq, secs, lead(b) OVER (PARTITION BY corridor_id ORDER BY seq) AS c FROM {hops}) AS skipped
        WHERE c IS NOT NULL AND cnum % 26 = 6""",
    "segments": """
        SELECT concat(corridor_id, ':', a, '>', b) AS segment_id, corridor_id, a AS from_stop, b AS to_stop, seq, secs FROM {segment_pairs}
        UNION ALL
        SELECT concat(corridor_id, ':', b, '>', a) AS segment_id, corridor_id, b AS from_stop, a AS to_stop, seq, secs FROM {segment_pairs}""",
    # Variants: 0 whole line, 1 without the last stop, 2 and 3 the two halves, 4 a copy of 0.
    "trips": """
        SELECT concat(corridor_id, '-', CAST(dir AS STRING), '-', CAST(variant AS STRING)) AS trip_id,
               corridor_id AS route_id, cnum, CAST(dir AS STRING) AS direction_id, variant,
               concat('To ', corridor_id) AS headsign,
               CASE WHEN variant = 0 THEN concat('B', corridor_id) END AS block_id,
               concat('S', corridor_id, '-', CAST(dir AS STRING)) AS shape_id
        FROM (SELECT corridor_id, cnum, dir, @explode(0, 1, 2, 3, 4) AS variant
              FROM (SELECT corridor_id, cnum, @explode(0, 1) AS dir
                    FROM (SELECT DISTINCT corridor_id, cnum FROM {members}) AS lines) AS directed) AS variants
        WHERE (cnum % 4 <> 0 AND variant IN (0, 1)) OR (cnum % 4 = 0 AND variant IN (2, 3))
           OR (cnum % 4 <> 0 AND cnum % 3 = 0 AND variant = 4)""",
    "positions_in_trip": """
        SELECT t.trip_id, t.route_id, t.cnum, t.direction_id, t.variant, m.stop_id, m.n_stops,
               CASE WHEN t.direction_id = '0' THEN m.seq ELSE m.n_stops - m.seq + 1 END AS pos
        FROM {trips} t JOIN {members} m ON t.route_id = m.corridor_id""",
    "stop_seconds": """
        SELECT trip_id, CAST(pos AS INT) AS stop_sequence, stop_id, cnum, variant,
               CAST(18000 + 160 * (pos - 1) + 7 * (pos % 5) AS BIGINT) AS arr
        FROM {positions_in_trip}
        WHERE variant IN (0, 4) OR (variant = 1 AND pos < n_stops)
           OR (variant = 2 AND pos <= ceil(n_stops / 2)) OR (variant = 3 AND pos > ceil(n_stops / 2))""",
    "stop_times": f"""
        SELECT trip_id, stop_sequence, stop_id,
               CASE WHEN variant = 1 AND cnum % 7 = 0 AND stop_sequence = 2 THEN 'late'
                    ELSE {_hms('arr')} END AS arrival_time,
               {_hms('arr + 20')} AS departure_time
        FROM {{stop_seconds}}""",
    "frequencies": """
        SELECT trip_id, CASE WHEN part = 1 THEN '12:00:00' ELSE '05:00:00' END AS start_time,
               CASE WHEN cnum % 2 = 0 AND part = 0 THEN '12:00:00' ELSE '22:00:00' END AS end_time,
               CAST(300 + 60 * (cnum % 5) + CASE WHEN variant = 1 THEN 60 ELSE 0 END AS INT) AS headway_secs
        FROM (SELECT trip_id, cnum, variant, @explode(0, 1) AS part FROM {trips}) AS parts
        WHERE part = 0 OR cnum % 2 = 0
        UNION ALL
        SELECT trip_id, '05:00:00' AS start_time, '22:00:00' AS end_time, 0 AS headway_secs FROM {trips} WHERE variant = 1
        UNION ALL
        SELECT trip_id, '09:00:00' AS start_time, '05:61' AS end_time, 600 AS headway_secs FROM {trips} WHERE variant = 2
        UNION ALL
        SELECT concat('ghost-', corridor_id) AS trip_id, '05:00:00' AS start_time, '22:00:00' AS end_time, 600 AS headway_secs
        FROM (SELECT DISTINCT corridor_id FROM {members}) AS lines""",
    "shape_stop_points": """
        SELECT concat('S', m.corridor_id, '-', CAST(m.dir AS STRING)) AS shape_id, m.corridor_id,
               CASE WHEN m.dir = 0 THEN m.seq ELSE m.n_stops - m.seq + 1 END AS pos, s.lat, s.lng
        FROM (SELECT corridor_id, stop_id, seq, n_stops, @explode(0, 1) AS dir FROM {members}) AS m
        JOIN {stops} s ON m.stop_id = s.stop_id""",
    "shapes": """
        SELECT shape_id, corridor_id, CAST(2 * pos AS INT) AS seq, lat, lng FROM {shape_stop_points}
        UNION ALL
        SELECT shape_id, corridor_id, CAST(2 * pos + 1 AS INT) AS seq, lat, lng FROM (
          SELECT shape_id, corridor_id, pos,
                 (lat + lead(lat) OVER (PARTITION BY shape_id ORDER BY pos)) / 2 + CAST(0.0003 AS DOUBLE) AS lat,
                 (lng + lead(lng) OVER (PARTITION BY shape_id ORDER BY pos)) / 2 AS lng
          FROM {shape_stop_points}) AS mid WHERE lat IS NOT NULL""",
    "ridership": """
        SELECT CAST(o_orderdate AS DATE) AS date, CAST(cnum AS STRING) AS corridor_id,
               CAST(round(sum(o_totalprice)) AS BIGINT) AS total
        FROM (SELECT o.o_orderdate, o.o_totalprice,
                     CAST(floor((c.c_custkey % (SELECT count(*) FROM {supplier})) / 100) AS BIGINT) * 13
                         + 1 + c.c_nationkey % 13 AS cnum
              FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) AS paid
        GROUP BY CAST(o_orderdate AS DATE), CAST(cnum AS STRING)""",
    "riders": "SELECT date, corridor_id, CAST(total AS DOUBLE) / 100 AS riders FROM {ridership}",
    # ---- feed family (orders, lineitem): many short trips on fifteen routes ---------------------
    "feed_trips": """
        SELECT CAST(o_orderkey AS STRING) AS trip_id, concat(' ', CAST(1 + o_custkey % 15 AS STRING), '.0') AS route_id,
               CAST(o_orderkey % 2 AS STRING) AS direction_id,
               concat(CASE WHEN o_orderstatus = 'F' THEN 'Line ' ELSE 'Line via ' END,
                      CAST(1 + o_custkey % 15 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' branch' END) AS short_name,
               o_orderkey
        FROM {orders}""",
    "feed_stop_times": f"""
        SELECT trip_id, stop_sequence, CAST(l_suppkey AS STRING) AS stop_id,
               {_hms('18000 + 300 * stop_sequence + l_linenumber * 11')} AS arrival_time,
               CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 'n/a'
                    ELSE {_hms('18000 + 300 * stop_sequence + l_linenumber * 11 + 15')} END AS departure_time
        FROM (SELECT trip_id, l_suppkey, l_linenumber, l_returnflag, l_quantity,
                     CAST(row_number() OVER (PARTITION BY trip_id
                          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS stop_sequence
              FROM (SELECT CAST(l_orderkey AS STRING) AS trip_id, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice
                    FROM {{lineitem}}) AS named) AS ordered""",
    # ---- stored routes (orders, lineitem): a customer is an origin-destination pair, an order a route --
    "route_lines": """
        SELECT CAST(o.o_custkey AS STRING) AS od_id, l.l_orderkey AS candidate, l.pos, l.l_suppkey AS a,
               coalesce(lead(l.l_suppkey) OVER (PARTITION BY l.l_orderkey ORDER BY l.pos), l.l_suppkey) AS b,
               CASE WHEN l.l_returnflag = 'R' AND l.pos > 1 THEN 'transit' ELSE 'segmen' END AS kind,
               CAST(1 + (l.l_linenumber * l.l_linenumber) % 3 AS STRING) AS corridor_id, l.l_quantity, l.l_extendedprice, l.l_discount
        FROM (SELECT l_orderkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount,
                     CAST(row_number() OVER (PARTITION BY l_orderkey
                          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos
              FROM {lineitem}) AS l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "route_steps": """
        SELECT od_id, candidate, pos, CAST(a AS STRING) AS from_stop, CAST(b AS STRING) AS to_stop, kind, corridor_id,
               CASE WHEN kind = 'segmen' THEN concat(corridor_id, ':', CAST(a AS STRING), '>', CAST(b AS STRING)) END AS segment_id,
               CAST(CASE WHEN kind = 'segmen' THEN l_quantity * 20 ELSE 0 END AS INT) AS secs,
               CASE WHEN kind = 'segmen' THEN l_extendedprice / 100 ELSE CAST(0 AS DOUBLE) END AS meters,
               CASE WHEN kind = 'segmen' THEN l_discount * 10 ELSE CAST(0 AS DOUBLE) END AS density
        FROM {route_lines}""",
    "lines_of_stop": "SELECT corridor_id, cnum, stop_id FROM {members} WHERE NOT ((cnum - 1) % 13 >= 8 AND k % 3 = 0) AND NOT ((cnum - 1) % 13 < 8 AND k % 7 = 1)",
    "catalog": """
        SELECT DISTINCT CAST(l_suppkey AS STRING) AS origin,
               CAST((l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM {supplier}) AS STRING) AS destination FROM {lineitem}""",
    # ---- results of replications (lineitem): a supplier is a scenario, a line a replication -----------
    "mc_rows": """
        SELECT CAST(l_suppkey AS STRING) AS scenario, l_orderkey * 10 + l_linenumber AS replication, l_partkey, l_extendedprice,
               l_discount * 10 AS baseline, l_tax * 12 AS recommended, l_returnflag <> 'N' AS changed, l_quantity * 10 AS extra_secs,
               CASE WHEN l_tax > 0.07 THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS signature
        FROM {lineitem}""",
    # ---- live and telemetry family (events) -----------------------------------------------------
    "readings": f"""
        SELECT event_id, concat('bus-', CAST(user_id AS STRING)) AS bus_id, event_type, value, props,
               {_millis('ts')} AS ms, CAST(floor(value) AS BIGINT) AS passengers
        FROM {{events}}""",
    "fixes": """
        SELECT event_id, bus_id, ms, CAST(-6.2 AS DOUBLE) + (passengers % 40) * CAST(0.001 AS DOUBLE) AS lat,
               CAST(106.8 AS DOUBLE) + (passengers % 7) * CAST(0.01 AS DOUBLE) AS lng
        FROM {readings}""",
    "vehicle_messages": """
        SELECT event_id, ms, concat('{{"route_code":', CASE WHEN event_type = 'error' THEN 'null' ELSE concat('"', CAST(1 + event_id % 15 AS STRING), '"') END,
               ',"bus_body_no":"', bus_id, '","trip_id":"t', CAST(event_id AS STRING),
               '","latitude":', CASE WHEN event_id % 19 = 0 THEN '"x"' ELSE CAST(CAST(-6.9 AS DOUBLE) + passengers * CAST(0.003 AS DOUBLE) AS STRING) END,
               ',"longitude":', CAST(CAST(106.3 AS DOUBLE) + passengers * CAST(0.005 AS DOUBLE) AS STRING),
               ',"bearing":', CAST(passengers % 400 AS STRING), ',"eta":', CAST(passengers % 30 AS STRING),
               ',"stops":[{{"name":"A","stop_id":"', CAST(event_id % 120 AS STRING), '","parent_stop_id":null,"eta":', CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '3' END,
               '}},{{"name":"B","stop_id":"p', CAST(event_id % 90 AS STRING), '","parent_stop_id":"', CAST(event_id % 90 AS STRING), '","eta":', CAST(4 + passengers % 9 AS STRING), '}}]}}') AS payload
        FROM {readings}""",
    # Camera messages: device clock, retained flag, clock offset and a tiny image, in JSON.
    "camera_messages": """
        SELECT event_id, bus_id, event_type, ms AS received_ms, event_id % 23 = 0 AS retain,
               CASE WHEN event_id % 11 <> 0 THEN CAST(passengers % 40 AS DOUBLE) - 15 END AS offset_ms,
               CASE WHEN event_id % 37 = 0 THEN 'not json'
                    ELSE concat('{{"timestamp":', CASE WHEN event_id % 31 = 0 THEN '12345' ELSE CAST(ms - passengers + 8 AS STRING) END,
                         ',"image":"', CASE WHEN event_id % 13 = 0 THEN '%%%' WHEN event_id % 17 = 0 THEN 'AAAA'
                              WHEN event_id % 19 = 0 THEN 'data:image/jpeg;base64,/9j/2Q==' ELSE '/9j/2Q==' END, '"}}') END AS payload
        FROM {readings}""",
    "power_messages": """
        SELECT event_id, bus_id, event_type, ms AS received_ms,
               concat('{{', CASE WHEN event_id % 3 = 0 THEN concat('"voltage_v":', CAST(passengers / 8 AS STRING)) ELSE concat('"voltage":', CAST(passengers / 8 AS STRING)) END, ',',
                      CASE WHEN event_id % 4 = 0 THEN concat('"current_a":', CAST(passengers / 4 AS STRING)) WHEN event_id % 29 = 0 THEN '"x":1' ELSE concat('"current_ma":', CAST(passengers AS STRING)) END, ',',
                      CASE WHEN event_id % 5 = 0 THEN concat('"power_w":', CAST(passengers / 2 AS STRING)) ELSE concat('"power_mw":', CAST(passengers * 3 AS STRING)) END, '}}') AS payload
        FROM {readings}""",
    # ---- image family (lineitem, embeddings, documents): some images have no box, some no known count ----
    "detections": """
        SELECT l_orderkey AS image, l_linenumber AS line, l_partkey, l_suppkey, l_extendedprice,
               l_discount * 10 AS conf, l_quantity * 8 AS w,
               CAST(l_partkey % 60 AS DOUBLE) * 8 AS h, l_returnflag, l_tax
        FROM {lineitem} WHERE l_orderkey % 41 <> 0""",
    "truth": "SELECT l_orderkey AS image, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS actual FROM {lineitem} WHERE l_orderkey % 43 <> 0 GROUP BY l_orderkey",
    "label_lines": """
        SELECT concat('img-', CAST(l_orderkey AS STRING)) AS file,
               concat(CASE WHEN l_returnflag = 'N' THEN '0' WHEN l_returnflag = 'A' THEN '1' ELSE '0.5' END, ' ',
                      CAST(l_discount AS STRING), ' ', CAST(l_tax AS STRING), ' ', CAST(l_quantity / 50 AS STRING),
                      CASE WHEN l_linenumber = 7 THEN '' ELSE concat(' ', CAST(l_quantity / 40 AS STRING)) END) AS line
        FROM {lineitem}""",
    "chunk_starts": """
        SELECT doc_id AS frame_id, text, CAST(length(text) AS INT) AS total_len,
               CAST(ceil(length(text) / 512) AS INT) AS total_chunks, @series(0, CAST(ceil(length(text) / 512) AS BIGINT) - 1) AS chunk_index
        FROM {documents} WHERE length(text) > 0""",
    "chunks_all": """
        SELECT frame_id, CAST(chunk_index AS INT) AS chunk_index, total_chunks, total_len,
               substr(text, CAST(chunk_index * 512 + 1 AS INT), 512) AS body,
               (frame_id * 31 + chunk_index * 17) % 50 AS fate, frame_id * 1000 + (chunk_index * 7919) % 997 AS seen
        FROM {chunk_starts}""",
    # Some chunks are lost, some arrive twice, a few of the second copies are damaged, some headers disagree.
    "chunks": """
        SELECT frame_id, chunk_index, total_chunks, total_len, body, seen FROM {chunks_all} WHERE fate <> 0
        UNION ALL
        SELECT frame_id, chunk_index, total_chunks, total_len, body, seen + 1 AS seen FROM {chunks_all} WHERE fate IN (1, 2)
        UNION ALL
        SELECT frame_id, chunk_index, total_chunks, total_len, concat('#', substr(body, 2)) AS body, seen + 2 AS seen
        FROM {chunks_all} WHERE fate = 3 AND chunk_index = 1
        UNION ALL
        SELECT frame_id, chunk_index, total_chunks, total_len + 1 AS total_len, body, seen + 3 AS seen
        FROM {chunks_all} WHERE fate = 4""",
    # ---- comparison family (part) ----------------------------------------------------------------
    "static_rows": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_retailprice AS price, p_size AS size FROM {part}",
    "live_rows": """
        SELECT p_partkey AS id, concat(' ', p_name) AS name, p_brand AS brand,
               CASE WHEN p_type = 'ECONOMY' THEN p_retailprice + 1 ELSE p_retailprice END AS price, p_size AS size
        FROM {part} WHERE p_size <= 42""",
    "hubs": """
        SELECT CAST(c_custkey AS STRING) AS stop_id,
               concat('Hub', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING),
                      CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(' ', CAST(c_custkey % 3 AS STRING)) END) AS name,
               CAST(-6.2 AS DOUBLE) + (c_custkey % 3) * (1 + c_nationkey % 3) * CAST(0.0005 AS DOUBLE) AS lat,
               CAST(106.8 AS DOUBLE) AS lng
        FROM {customer}""",
}

_DEP = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def dependencies(sql: str) -> list[str]:
    return list(dict.fromkeys(_DEP.findall(sql)))


def spark_text(sql: str) -> str:
    sql = re.sub(r"@explode\(([^)]*)\)", r"explode(array(\1))", sql)
    sql = re.sub(r"@series\((.+?) - 1\) AS", r"explode(sequence(\1 - 1)) AS", sql)
    return re.sub(r"@millis\(([^)]*)\)", r"unix_millis(CAST(\1 AS TIMESTAMP))", sql)


def duckdb_text(sql: str) -> str:
    sql = re.sub(r"@explode\(([^)]*)\)", r"unnest([\1])", sql)
    sql = re.sub(r"@series\((.+?) - 1\) AS", r"unnest(generate_series(\1 - 1)) AS", sql)
    sql = re.sub(r"@millis\(([^)]*)\)", r"CAST(floor(epoch_us(\1) / 1000) AS BIGINT)", sql)
    sql = _DEP.sub(r"\1", sql)
    return sql.replace("{{", "{").replace("}}", "}")


class Tables:
    """Lazily loads the driver's tables and the bound transit tables of one input folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                sql = spark_text(BINDINGS[name])
                inputs = {dep: getattr(self, dep) for dep in dependencies(sql)}
                self._frames[name] = self.spark.sql(sql, **inputs)
        return self._frames[name]


def oracle(final_sql: str, steps: dict[str, str] | None = None) -> str:
    """One DuckDB statement: the bindings and steps that ``final_sql`` names in braces, as CTEs."""
    known = {**BINDINGS, **(steps or {})}
    ordered: list[str] = []

    def visit(name: str, trail: tuple[str, ...] = ()) -> None:
        if name in TABLES or name in ordered or name in trail:
            return
        for dep in dependencies(known[name]):
            visit(dep, (*trail, name))
        ordered.append(name)

    for name in dependencies(final_sql):
        visit(name)
    ctes = [f"{name} AS ({duckdb_text(known[name])})" for name in ordered]
    body = duckdb_text(final_sql).strip()
    own = re.match(r"WITH\s+", body)
    if own:
        ctes.append(body[own.end():])
        return f"WITH RECURSIVE {', '.join(ctes)}"
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body
