"""Candidate routes for whole origin-destination tables by frontier relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.functions.sequences import collapse_runs, revisits
from transitloom.operators import route_search as S
from transitloom.operators.components import connected_groups
from transitloom.operators.ordered import number_rows
from transitloom.session import cut, load, store_counted

STATE = ["search_id", "stop", "corridor"]


def best_routes(searches: DataFrame, moves: DataFrame, max_transfers: int = C.MAX_TRANSFERS) -> DataFrame:
    """Cheapest route of every search row (search_id, origin, destination, block_segment, block_corridor).

    All searches advance together, one move per round. A label is (stop, corridor, transfers, cost,
    path); it survives when no earlier label of its state is as cheap with as few transfers and it is
    cheaper than the best arrival known for its search. Each round is written to the shared step
    folder. Returns search_id, cost, transfers and the path as edge ids.
    """
    open_move = (
        (F.col("block_segment").isNull() | (F.col("segment_id") != F.col("block_segment")))
        & (F.col("block_corridor").isNull() | (F.col("m_corridor") != F.col("block_corridor")))
    )
    steps = cut(moves.select(
        F.col("from_stop").alias("stop"), "to_stop", F.col("corridor").alias("m_corridor"), "segment_id",
        F.col("transfers").alias("m_transfers"), F.col("cost").alias("m_cost"), "edges",
    ))
    frontier = searches.select(
        "search_id", "destination", "block_segment", "block_corridor", F.col("origin").alias("stop"), F.lit(None).cast("string").alias("corridor"),
        F.lit(0).alias("transfers"), F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<string>").alias("path"),
    )
    spark = searches.sparkSession
    written: list[str] = []
    schema = None
    while True:
        legal = F.when(F.col("corridor").isNull(), F.col("m_transfers") == 0).otherwise(
            (F.col("m_transfers") == 0) == (F.col("m_corridor") == F.col("corridor"))
        )
        grown = frontier.join(steps, "stop").filter(legal & open_move).select(
            "search_id", "destination", "block_segment", "block_corridor", F.col("to_stop").alias("stop"), F.col("m_corridor").alias("corridor"),
            (F.col("transfers") + F.col("m_transfers")).alias("transfers"), (F.col("cost") + F.col("m_cost")).alias("cost"),
            F.concat("path", "edges").alias("path"),
        ).filter(F.col("transfers") <= max_transfers)
        best = grown.groupBy(*STATE, "transfers").agg(
            F.min(F.struct("cost", "path")).alias("b"), F.first("destination").alias("destination"),
            F.first("block_segment").alias("block_segment"), F.first("block_corridor").alias("block_corridor"),
        ).select(*STATE, "transfers", "b.cost", "b.path", "destination", "block_segment", "block_corridor")
        if written:
            labels = load(spark, schema, *written)
            bound = labels.filter(F.col("stop") == F.col("destination")).groupBy("search_id").agg(F.min("cost").alias("_bound"))
            best = best.join(bound, "search_id", "left").filter("_bound IS NULL OR cost < _bound").drop("_bound")
            seen = labels.select(*[F.col(c).alias(f"_{c}") for c in [*STATE, "transfers", "cost"]])
            same_state = (F.col("search_id") == F.col("_search_id")) & (F.col("stop") == F.col("_stop")) & (F.col("corridor") == F.col("_corridor"))
            no_worse = (F.col("_transfers") <= F.col("transfers")) & (F.col("_cost") <= F.col("cost"))
            best = best.join(seen, same_state & no_worse, "left_anti")
        schema = best.schema
        path, grew = store_counted(best)
        if not grew:
            break
        written.append(path)
        frontier = load(spark, schema, path).filter(F.col("stop") != F.col("destination"))
    found = load(spark, schema, *(written or [path]))
    return cut(_cheapest(found.filter(F.col("stop") == F.col("destination"))))


def _cheapest(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("search_id").agg(F.min(F.struct("cost", "transfers", "path")).alias("b")).select(
        "search_id", "b.cost", "b.path", "b.transfers"
    )


def _part(edge: Column, i: int) -> Column:
    return F.get(F.split(edge, "~"), F.lit(i))


def ridden(path: Column) -> Column:
    """Edge ids of the ride edges of a path."""
    return F.filter(path, lambda e: _part(e, 2) == "segmen")


def corridor_sequence(path: Column) -> Column:
    """Corridor of every ride edge, in order."""
    return F.transform(ridden(path), lambda e: _part(e, 4))


def network_parts(moves: DataFrame) -> DataFrame:
    """stop_id and part: no route leads from one part of the network into another."""
    links = cut(moves.select(F.col("from_stop").alias("a"), F.col("to_stop").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return connected_groups(nodes, links).select(F.col("node").alias("stop_id"), F.col("label").alias("part"))


def candidate_routes(pairs: DataFrame, moves: DataFrame, k: int = C.CANDIDATES_K, max_reruns: int = C.MAX_BLOCK_RERUNS,
                     max_transfers: int = C.MAX_TRANSFERS, parts: DataFrame | None = None) -> DataFrame:
    """Up to ``k`` routes per pair (od_id, origin, destination): the best one and detours.

    Detours are the best routes with one of the first ``max_reruns`` ride segments of the best route closed, and with each of
    its corridors closed. Routes that return to a corridor are rejected; equal paths count once. Searches are shared:
    one per origin, and per (origin, closure) only the part that the closure breaks (``route_search``). Pairs whose ends lie in
    different parts of the network (``network_parts``, made here if not given) have no route and leave first.
    """
    part = cut(network_parts(moves)) if parts is None else parts
    end = lambda name: part.select(F.col("stop_id").alias(name), "part")
    wanted = cut(pairs.filter("origin <> destination").join(end("origin"), "origin").join(end("destination"), ["destination", "part"]).select("od_id", "origin", "destination"))
    net = S.line_network(moves)
    search = S.search_origins(wanted.select("origin"), net, max_transfers)
    ends = S.open_ends(wanted.select("origin", "destination").distinct(), search)
    first = cut(S.paths(ends, net, search).filter(~revisits(corridor_sequence(F.col("path")))))
    if k <= 1:
        return wanted.join(first, ["origin", "destination"]).select("od_id", "cost", "transfers", "path", F.lit(1).alias("candidate"))
    segments = F.transform(ridden(F.col("path")), lambda e: _part(e, 3))
    if max_reruns > 0:
        segments = F.slice(segments, 1, max_reruns)
    closures = F.concat(
        F.transform(segments, lambda s: S.segment_closure(s)), F.transform(F.array_distinct(corridor_sequence(F.col("path"))), lambda c: S.corridor_closure(c))
    )
    asked = cut(first.select("origin", "destination", F.posexplode(closures).alias("n", "closure")))
    keys = ["origin", "closure", "destination"]
    states, labels = S.search_closures(search, net, cut(asked.select("origin", "closure").distinct()), max_transfers)
    again = S.closed_ends(asked.select(*keys).distinct(), search, states, labels)
    found = S.paths(again, net, search, states, labels).filter(~revisits(corridor_sequence(F.col("path"))))
    detours = asked.groupBy(*keys).agg(F.min("n").alias("n")).join(found, keys).select("origin", "destination", "cost", "transfers", "path", (F.col("n") + 1).alias("n"))
    every = first.select("origin", "destination", "cost", "transfers", "path", F.lit(0).alias("n")).unionByName(detours)
    unique = every.groupBy("origin", "destination", "path").agg(F.min("n").alias("n"), F.first("cost").alias("cost"), F.first("transfers").alias("transfers"))
    # The best route stays first; the others follow by cost.
    w = Window.partitionBy("origin", "destination").orderBy(F.col("n") != 0, "cost", "n")
    best = unique.withColumn("candidate", F.row_number().over(w)).filter(F.col("candidate") <= k)
    return wanted.join(best, ["origin", "destination"]).select("od_id", "cost", "transfers", "path", "candidate")


def route_edges(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge of every route, with time, length and density looked up from the edge table."""
    steps = routes.select("od_id", "candidate", F.posexplode("path").alias("pos", "e")).select(
        "od_id", "candidate", "pos", _part(F.col("e"), 0).alias("from_stop"), _part(F.col("e"), 1).alias("to_stop"), _part(F.col("e"), 2).alias("kind"),
        F.nullif(_part(F.col("e"), 3), F.lit("")).alias("segment_id"), _part(F.col("e"), 4).alias("corridor_id"),
    )
    values = edges.filter("kind = 'segmen'").select("segment_id", "secs", "meters", "density")
    return steps.join(values, "segment_id", "left").fillna({"secs": 0, "meters": 0.0, "density": 0.0})


def _figures() -> list[Column]:
    ride = F.col("kind") == "segmen"
    return [
        F.sum("secs").cast("bigint").alias("secs"), F.sum("meters").alias("meters"), F.count_if(~ride).alias("transfers"),
        F.count_if(ride).alias("rides"), F.coalesce(F.avg(F.when(ride, F.col("density"))), F.lit(0.0)).alias("density"),
    ]


def route_figures(steps: DataFrame) -> DataFrame:
    """Only the numbers of ``route_totals``: steps are summed before they are shuffled."""
    return steps.groupBy("od_id", "candidate").agg(*_figures())


def route_totals(steps: DataFrame) -> DataFrame:
    """Totals per route, corridor sequence and readable path.

    Length and density are summed along the route, so that neither the order of the rows nor their partitions show in the last bit.
    """
    ride = F.col("kind") == "segmen"
    packed = F.array_sort(F.collect_list(F.struct("pos", "from_stop", "to_stop", "kind", "corridor_id", "meters", F.when(ride, F.col("density")).alias("density"))))
    own = lambda field: F.filter(F.transform("_p", lambda e: e[field].cast("double")), lambda x: x.isNotNull())
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    rows = steps.groupBy("od_id", "candidate").agg(
        F.sum("secs").cast("bigint").alias("secs"), F.count_if(~ride).alias("transfers"), F.count_if(ride).alias("rides"), packed.alias("_p")
    ).withColumn("_m", own("meters")).withColumn("_d", own("density"))
    rows = rows.withColumn("meters", F.when(F.size("_m") > 0, total("_m"))).withColumn("density", F.when(F.size("_d") > 0, total("_d") / F.size("_d")).otherwise(0.0))
    return rows.withColumn("corridors", F.transform(F.filter("_p", lambda e: e["kind"] == "segmen"), lambda e: e["corridor_id"])).withColumn(
        "route_text", F.array_join(F.concat(F.array(F.col("_p")[0]["from_stop"]), F.transform("_p", lambda e: e["to_stop"])), " -> ")
    ).withColumn("runs", collapse_runs(F.col("corridors"))).select("od_id", "candidate", "secs", "meters", "transfers", "rides", "density", "corridors", "route_text", "runs")


def route_shapes(steps: DataFrame) -> DataFrame:
    """Path signature, corridor sequence, length and density per route, from one shuffle of the steps."""
    edge = F.concat_ws("~", "from_stop", "to_stop", "kind", F.coalesce("segment_id", F.lit("")), "corridor_id")
    ride = F.col("kind") == "segmen"
    packed = F.array_sort(F.collect_list(F.struct("pos", edge.alias("edge"), F.when(ride, F.col("corridor_id")).alias("corridor_id"), ride.alias("ride"))))
    rows = steps.groupBy("od_id", "candidate").agg(F.sum("meters").alias("meters"), F.coalesce(F.avg(F.when(ride, F.col("density"))), F.lit(0.0)).alias("density"), packed.alias("_p"))
    corridors = F.transform(F.filter("_p", lambda e: e["ride"]), lambda e: e["corridor_id"])
    return rows.withColumn("_c", corridors).select(
        "od_id", "candidate", "meters", "density", F.array_join(F.transform("_p", lambda e: e["edge"]), "|").alias("signature"), collapse_runs(F.col("_c")).alias("runs")
    )


def path_verdict(path: Column) -> Column:
    """``ok`` or the first broken rule of a path given as edge ids."""
    size = F.size(path)
    indexes = F.sequence(F.lit(1), size - 1)
    pair = F.when(size > 1, indexes).otherwise(F.array().cast("array<int>"))
    before = lambda i: F.get(path, i - 1)
    here = lambda i: F.get(path, i)
    broken = F.exists(pair, lambda i: _part(before(i), 1) != _part(here(i), 0))
    doubled = F.exists(pair, lambda i: (_part(before(i), 2) == "transit") & (_part(here(i), 2) == "transit"))
    idle = F.exists(pair, lambda i: (_part(here(i), 2) == "transit") & (_part(before(i), 4) == _part(here(i), 4)))
    jump = F.exists(pair, lambda i: (_part(here(i), 2) == "segmen") & (_part(before(i), 4) != _part(here(i), 4)))
    return (
        F.when(size == 0, "empty")
        .when(broken, "not_continuous")
        .when((_part(F.get(path, F.lit(0)), 2) == "transit"), "starts_with_transfer")
        .when(doubled, "double_transfer")
        .when(idle, "transfer_to_same_corridor")
        .when(jump, "corridor_change_without_transfer")
        .when(_part(F.element_at(path, -1), 2) == "transit", "ends_with_transfer")
        .otherwise("ok")
    )


def route_legs(steps: DataFrame) -> DataFrame:
    """Rides and transfer rows: consecutive ride edges of one corridor form one ride.

    A transfer row carries the corridor of the ride before it.
    """
    # The few steps of a route are one array, so a task holds one sort of its steps, not one per window and per aggregate.
    packed = F.array_sort(F.collect_list(F.struct("pos", "kind", "corridor_id", "from_stop", "to_stop", "density", "secs", "meters")))
    whole = steps.groupBy("od_id", "candidate").agg(packed.alias("_p"))
    at = lambda i: F.get("_p", i)

    def fresh(e: Column, i: Column) -> Column:
        before = at(i - 1)
        return F.coalesce(before["kind"].isNull() | (e["kind"] == "transit") | (before["kind"] == "transit") | (before["corridor_id"] != e["corridor_id"]), F.lit(False))

    starts = F.filter(F.transform("_p", lambda e, i: F.when(fresh(e, i), i)), lambda i: i.isNotNull())
    cut_at = whole.withColumn("_s", starts)
    heads = cut_at.withColumn("_h", F.transform("_s", lambda i: F.struct(at(i)["kind"].alias("kind"), at(i)["corridor_id"].alias("corridor_id"))))
    each = heads.select("od_id", "candidate", "_p", "_s", "_h", F.posexplode("_s").alias("_i", "_a"))
    size = F.coalesce(F.get("_s", F.col("_i") + 1), F.size("_p")) - F.col("_a")
    rides = F.filter(F.slice("_h", F.lit(1), F.col("_i")), lambda h: (h["kind"] == "segmen") & h["corridor_id"].isNotNull())
    legs = each.select(
        "od_id", "candidate", (F.col("_i") + 1).cast("bigint").alias("leg"), F.get("_h", F.col("_i")).alias("_head"), F.slice("_p", F.col("_a") + 1, size).alias("_l"),
        F.try_element_at(rides, F.lit(-1))["corridor_id"].alias("_before"),
    )

    def total(field: str, kind: str, value=lambda x: x) -> Column:
        own = F.filter(F.transform("_l", lambda e: value(e[field]).cast(kind)), lambda x: x.isNotNull())
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0).cast(kind), lambda s, x: s + x))

    return legs.select(
        "od_id", "candidate", "leg", "_head.kind", "_head.corridor_id", F.get("_l", F.lit(0))["from_stop"].alias("board_stop"), F.element_at("_l", -1)["to_stop"].alias("alight_stop"),
        (total("density", "double") / F.size(F.filter("_l", lambda e: e["density"].isNotNull()))).alias("density"), total("secs", "bigint").alias("secs"), total("meters", "double").alias("meters"),
        F.size("_l").cast("bigint").alias("segments"), total("secs", "bigint", lambda x: F.bround(x / 60, 0)).alias("rounded_min"),
        F.when(F.col("_head.kind") == "transit", F.col("_before")).alias("from_corridor"),
    )


def scored_routes(totals: DataFrame, weights: dict[str, float] | None = None, max_transfers: int = C.MAX_TRANSFERS, keys: list[str] | None = None) -> DataFrame:
    """Primary score: weighted sum of min-max time and distance, transfer share and clamped density.

    The extremes per origin-destination are a small aggregate joined back, not a window.
    """
    keys = keys or ["od_id"]
    weights = weights or C.RANK_WEIGHTS
    extremes = totals.groupBy(*keys).agg(
        *[f(field).alias(f"_{f.__name__}_{field}") for field in ("secs", "meters") for f in (F.min, F.max)]
    )

    def norm(field: str) -> Column:
        low, high = F.col(f"_min_{field}"), F.col(f"_max_{field}")
        return F.when(F.abs(high - low) <= 1e-9, 0.0).otherwise((F.col(field) - low) / (high - low))

    out = totals.join(extremes, keys).withColumn("time_norm", norm("secs")).withColumn("distance_norm", norm("meters"))
    out = out.withColumn("transfer_norm", F.least(F.col("transfers") / max(1, max_transfers), F.lit(1.0)))
    out = out.withColumn("density_norm", F.least(F.greatest(F.col("density"), F.lit(0.0)), F.lit(1.0)))
    score = sum(weights[name] * F.col(f"{name}_norm") for name in ["time", "distance", "transfer", "density"])
    return out.withColumn("primary_score", score).drop(*[c for c in extremes.columns if c not in keys])


def primary_ranks(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``primary_rank``; rows are numbered inside thousandths of the score, not per whole key."""
    keyed = scored.withColumn("_s", F.round("primary_score", 9)).withColumn("_b", F.floor(F.col("_s") * 1000))
    return number_rows(keyed, keys or ["od_id"], ["_s", "candidate"], "_b", "primary_rank").drop("_s", "_b")


def with_aliases(pairs: DataFrame, aliases: DataFrame, moves: DataFrame, edges: DataFrame, k: int = C.CANDIDATES_K) -> DataFrame:
    """Best platform pair per request: candidates are searched for every alias of both ends.

    The pair with the lowest (score to 6 digits, time, length) wins; among equals the nearest aliases.
    """
    parts = cut(network_parts(moves))
    placed = cut(aliases.join(parts.withColumnRenamed("stop_id", "alias_id"), "alias_id"))
    end = lambda p: placed.select(F.col("stop_id").alias(p), F.col("alias_id").alias(f"used_{p}"), F.col("rank").alias(f"{p}_rank"), "part")
    # Only platforms of one part of the network meet, so that requests without a route are not multiplied by their platforms.
    wide = pairs.join(end("origin"), "origin").join(end("destination"), ["destination", "part"]).filter("used_origin <> used_destination").drop("part")
    wide = cut(wide.withColumn("alias_id", F.concat_ws(">", "used_origin", "used_destination")))
    asked = wide.select(F.col("alias_id").alias("od_id"), F.col("used_origin").alias("origin"), F.col("used_destination").alias("destination")).distinct()
    found = candidate_routes(asked, moves, k, parts=parts)
    totals = scored_routes(route_totals(route_edges(found, edges)))
    best = totals.groupBy("od_id").agg(F.min(F.struct(F.round("primary_score", 12).alias("s"), "candidate", "secs", "meters", "primary_score")).alias("b"))
    costs = found.select(F.col("od_id").alias("alias_id"), "candidate", "cost", "transfers")
    keyed = wide.join(best.select(F.col("od_id").alias("alias_id"), "b.*"), "alias_id").join(costs, ["alias_id", "candidate"])
    order = F.struct(F.round("primary_score", 6).alias("p"), F.col("secs"), F.round("meters", 6).alias("m"), "origin_rank", "destination_rank")
    row = F.struct("used_origin", "used_destination", "cost", "transfers", "primary_score")
    return keyed.groupBy("od_id", "origin", "destination").agg(F.min_by(row, order).alias("r")).select("od_id", "origin", "destination", "r.*")


def reachability(pairs: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """Share of pairs with a route and with two or more, and the number of transfer stops."""
    per_pair = pairs.join(found.groupBy("od_id").agg(F.count(F.lit(1)).alias("n")), "od_id", "left").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") >= 1).alias("connected"), F.count_if(F.col("n") >= 2).alias("with_choice")
    )
    transfers = members.groupBy("stop_id").agg(F.count_distinct("corridor_id").alias("n")).agg(F.count_if(F.col("n") >= 2).alias("transfer_stops"))
    return per_pair.withColumn("_k", F.lit(1)).join(transfers.withColumn("_k", F.lit(1)), "_k").select(
        "pairs", "connected", "with_choice", F.round(F.col("connected") / F.col("pairs"), 6).alias("connected_share"),
        F.round(F.col("with_choice") / F.col("pairs"), 6).alias("choice_share"), "transfer_stops",
    )
