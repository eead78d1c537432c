"""Best routes of all requests from shared tables: one search per origin, and per origin and closure only what the closure breaks.

A line is ridden in one step: ``line_rides`` holds the best ride between any two stops of a line. A search from an origin then needs
one round per transfer. Labels are (origin, stop, corridor, transfers) with cost and a pointer to the label before; paths are put
together once, for the routes that are wanted.

A closure shuts a segment or a corridor. Labels whose chain does not use it stay as they are; the states of the others are
computed again from the stored candidates of the open search and spread from there. Searches are keyed by (origin, closure), so
all requests from an origin share them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from transitloom import constants as C
from transitloom.session import cut, load, store, store_counted

STATE = ["origin", "stop", "corridor"]
CLOSED = ["origin", "closure", "stop", "corridor"]
LABEL = ["cost", "board", "p_stop", "p_corridor"]


def segment_closure(segment: Column) -> Column:
    return F.concat(F.lit("s:"), segment)


def corridor_closure(corridor: Column) -> Column:
    return F.concat(F.lit("c:"), corridor)


def _edge_part(edge: Column, i: int) -> Column:
    return F.get(F.split(edge, "~"), F.lit(i))


def _uses(edges: Column, corridor: Column) -> Column:
    """Closures that shut a ride: its segments and its corridor."""
    return F.concat(F.transform(edges, lambda e: segment_closure(_edge_part(e, 3))), F.array(corridor_closure(corridor)))


@dataclass(frozen=True)
class LineNetwork:
    """segments: corridor, a, b, closure, secs, edge; rides: corridor, board, stop, ride, edges, uses;
    detours: closure, corridor, board, stop, ride, edges; transfers: stop, board, corridor, transfer."""

    segments: DataFrame
    rides: DataFrame
    detours: DataFrame
    transfers: DataFrame


def line_rides(segments: DataFrame) -> DataFrame:
    """corridor, board, stop, ride (cost) and edges of the best ride between any two stops of a line, by doubling.

    The number of stops of a line is bounded by nature; pairs are built within a line only.
    """
    best = F.min(F.struct(F.col("ride"), F.size("edges").alias("hops"), F.col("edges"))).alias("r")
    keys = ["corridor", "board", "stop"]
    shortest = lambda df: df.groupBy(*keys).agg(best).select(*keys, "r.ride", "r.edges")
    rides = cut(shortest(segments.where("a <> b").select("corridor", F.col("a").alias("board"), F.col("b").alias("stop"), F.col("secs").alias("ride"), F.array("edge").alias("edges"))))
    while True:
        onward = rides.select("corridor", F.col("board").alias("stop"), F.col("stop").alias("end"), F.col("ride").alias("ride2"), F.col("edges").alias("edges2"))
        joined = rides.join(onward, ["corridor", "stop"]).where("board <> end").select(
            "corridor", "board", F.col("end").alias("stop"), (F.col("ride") + F.col("ride2")).alias("ride"), F.concat("edges", "edges2").alias("edges")
        )
        longer = shortest(rides.unionByName(joined))
        before = rides.select(*keys, F.col("ride").alias("_old"))
        compared = longer.join(before, keys, "left")
        path, changed = store_counted(compared, F.col("_old").isNull() | (F.col("ride") < F.col("_old")))
        rides = load(segments.sparkSession, compared.schema, path).drop("_old")
        if not changed:
            return rides


def line_detours(segments: DataFrame, rides: DataFrame) -> DataFrame:
    """Best rides that replace a ride on its own line when one of its segments is closed, where there is one.

    Rides whose first part does not use the segment are extended by one open segment, and what is found goes on by segments.
    """
    keys = ["closure", "corridor", "board", "stop"]
    broken = cut(rides.select(F.explode(F.transform("edges", lambda e: segment_closure(_edge_part(e, 3)))).alias("closure"), "corridor", "board", "stop"))
    into = segments.select("corridor", F.col("a").alias("via"), F.col("b").alias("stop"), F.col("closure").alias("own"), "secs", "edge")
    last = broken.join(into, ["corridor", "stop"]).where("own <> closure AND stop <> board")
    direct = last.where("via = board").select(*keys, F.col("secs").alias("ride"), F.array("edge").alias("edges"))
    whole = rides.select("corridor", "board", F.col("stop").alias("via"), F.col("ride").alias("first"), F.col("edges").alias("head"), "uses")
    open_first = last.where("via <> board").join(whole, ["corridor", "board", "via"]).where(~F.expr("array_contains(uses, closure)")).select(
        *keys, (F.col("first") + F.col("secs")).alias("ride"), F.concat("head", F.array("edge")).alias("edges")
    )
    best = F.min(F.struct("ride", "edges")).alias("r")
    shortest = lambda df: df.groupBy(*keys).agg(best).select(*keys, "r.ride", "r.edges")
    found = cut(shortest(direct.unionByName(open_first)))
    front = found
    out_of = segments.select("corridor", F.col("a").alias("stop"), F.col("b").alias("next"), F.col("closure").alias("own"), "secs", "edge")
    while True:
        grown = front.join(out_of, ["corridor", "stop"]).where("own <> closure AND next <> board").select(
            "closure", "corridor", "board", F.col("next").alias("stop"), (F.col("ride") + F.col("secs")).alias("ride"), F.concat("edges", F.array("edge")).alias("edges")
        ).join(broken, keys, "left_semi")
        known = found.select(*keys, F.col("ride").alias("_old"))
        better = shortest(grown).join(known, keys, "left").where("_old IS NULL OR ride < _old").drop("_old")
        path, grew = store_counted(better)
        if not grew:
            return found
        front = load(segments.sparkSession, better.schema, path)
        found = cut(shortest(found.unionByName(front)))


def line_network(moves: DataFrame) -> LineNetwork:
    """Search tables from ``network.route_moves``."""
    segments = cut(moves.where("transfers = 0").select(
        "corridor", F.col("from_stop").alias("a"), F.col("to_stop").alias("b"), segment_closure(F.col("segment_id")).alias("closure"), F.col("cost").alias("secs"),
        F.col("edges")[0].alias("edge"),
    ))
    transfer = F.col("edges")[0]
    transfers = cut(moves.where("transfers = 1").select(F.col("from_stop").alias("stop"), _edge_part(transfer, 1).alias("board"), "corridor", transfer.alias("transfer")).distinct())
    rides = line_rides(segments)
    rides = cut(rides.withColumn("uses", _uses(F.col("edges"), F.col("corridor"))))
    return LineNetwork(segments, rides, line_detours(segments, rides), transfers)


@dataclass(frozen=True)
class OpenSearch:
    """labels: STATE, transfers, LABEL; candidates: the same before the cheapest of each state was taken, a table per number of transfers."""

    labels: DataFrame
    candidates: tuple[DataFrame, ...]


def _cheapest(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.min(F.struct(*LABEL)).alias("b")).select(*keys, "b.*")


def _onward(labels: DataFrame, net: LineNetwork, keep: list[str]) -> DataFrame:
    """Candidates one transfer and one ride behind ``labels``, with the closures that shut the ride."""
    change = net.transfers.select("stop", F.col("board").alias("next_board"), F.col("corridor").alias("next_corridor"))
    rides = net.rides.select(F.col("corridor").alias("next_corridor"), F.col("board").alias("next_board"), F.col("stop").alias("next_stop"), "ride", "uses")
    moved = labels.join(change, "stop").where("next_corridor <> corridor").join(rides, ["next_corridor", "next_board"]).where("next_stop <> origin")
    return moved.select(
        *keep, F.col("next_stop").alias("stop"), F.col("next_corridor").alias("corridor"), (F.col("transfers") + 1).alias("transfers"),
        (F.col("cost") + C.TRANSFER_PENALTY_SECS + F.col("ride")).alias("cost"), F.col("next_board").alias("board"), F.col("stop").alias("p_stop"),
        F.col("corridor").alias("p_corridor"), "ride", "uses",
    )


def search_origins(origins: DataFrame, net: LineNetwork, max_transfers: int = C.MAX_TRANSFERS) -> OpenSearch:
    """All states that the origins (column origin) reach; a label with more transfers is kept only if it is cheaper."""
    spark = origins.sparkSession
    none = F.lit(None).cast("string")
    first = origins.select("origin").distinct().join(net.rides, F.col("origin") == F.col("board")).select(
        "origin", "stop", "corridor", F.lit(0).alias("transfers"), F.col("ride").alias("cost"), "board", none.alias("p_stop"), none.alias("p_corridor")
    )
    schema = first.schema
    candidate_paths = [store(first)]
    front = load(spark, schema, candidate_paths[0])
    label_paths = list(candidate_paths)
    best = front.select(*STATE, F.col("cost").alias("low"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(max_transfers):
        # Dozens of candidates come from one label, so the labels are dealt to all tasks first.
        path, n = store_counted(_onward(front.repartition(parts, *STATE), net, ["origin"]).drop("ride", "uses").select(*first.columns))
        if not n:
            break
        candidate_paths.append(path)
        grown = _cheapest(load(spark, schema, path), [*STATE, "transfers"]).select(*first.columns)
        cheaper = grown.join(best, STATE, "left").where("low IS NULL OR cost < low").drop("low")
        path, n = store_counted(cheaper)
        if not n:
            break
        label_paths.append(path)
        front = load(spark, schema, path)
        best = cut(best.unionByName(front.select(*STATE, F.col("cost").alias("low"))).groupBy(*STATE).agg(F.min("low").alias("low")))
    return OpenSearch(load(spark, schema, *label_paths), tuple(load(spark, schema, path) for path in candidate_paths))


def _shut(candidates: DataFrame, detours: DataFrame) -> DataFrame:
    """Replaces rides that the closure shuts by their detours and drops those without one. Needs c, r, ride and uses."""
    priced = candidates.withColumn("_shut", F.expr("array_contains(uses, c)")).drop("uses").join(detours, ["c", "r"], "left").where("NOT _shut OR other IS NOT NULL")
    return priced.withColumn("cost", F.when(F.col("_shut"), F.col("cost") - F.col("ride") + F.col("other")).otherwise(F.col("cost"))).drop("ride", "other", "_shut")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number each; written, so that the numbers stay."""
    return cut(rows.withColumn(name, F.monotonically_increasing_id()))


@dataclass(frozen=True)
class Numbers:
    """Numbers for what the closed search joins and sorts by, as names are slow keys. asked: k, origin, closure, c; places: s, stop, corridor, l;
    rides: r, corridor, board, stop, ride, uses (numbers of asked closures); detours: c, r, other."""

    asked: DataFrame
    places: DataFrame
    rides: DataFrame
    detours: DataFrame


def number_closures(net: LineNetwork, keys: DataFrame) -> Numbers:
    closures = _numbered(keys.select("closure").distinct(), "c")
    lines = _numbered(net.rides.select("corridor").distinct(), "l")
    rides = _numbered(net.rides.select("corridor", "board", "stop", "ride", "uses"), "r")
    uses = rides.select("r", F.explode("uses").alias("closure")).join(closures, "closure").groupBy("r").agg(F.collect_list("c").alias("uses"))
    rides = cut(rides.drop("uses").join(uses, "r", "left").withColumn("uses", F.coalesce("uses", F.array().cast("array<bigint>"))))
    detours = net.detours.select("closure", "corridor", "board", "stop", F.col("ride").alias("other")).join(closures, "closure")
    return Numbers(
        _numbered(keys.select("origin", "closure").distinct().join(closures, "closure"), "k"), _numbered(net.rides.select("stop", "corridor").distinct().join(lines, "corridor"), "s"),
        rides, cut(detours.join(rides, ["corridor", "board", "stop"]).select("c", "r", "other")),
    )


def affected_labels(search: OpenSearch, net: LineNetwork, keys: DataFrame) -> DataFrame:
    """CLOSED, transfers: open labels whose chain uses the closure. ``keys``: origin, closure."""
    rides = net.rides.select("corridor", "board", "stop", "uses")
    own = search.labels.join(rides, ["corridor", "board", "stop"]).select(*STATE, "transfers", F.explode("uses").alias("closure"))
    own = cut(own.join(keys, ["origin", "closure"], "left_semi").select(*CLOSED, "transfers"))
    found, front = own, own
    child = search.labels.where("p_stop IS NOT NULL").select("origin", F.col("p_stop").alias("stop"), F.col("p_corridor").alias("corridor"), (F.col("transfers") - 1).alias("transfers"),
                                                              F.col("stop").alias("c_stop"), F.col("corridor").alias("c_corridor"))
    while True:
        below = front.join(child, [*STATE, "transfers"]).select(
            "origin", "closure", F.col("c_stop").alias("stop"), F.col("c_corridor").alias("corridor"), (F.col("transfers") + 1).alias("transfers")
        ).join(found, [*CLOSED, "transfers"], "left_anti")
        path, grew = store_counted(below)
        if not grew:
            return found
        front = load(keys.sparkSession, below.schema, path)
        found = cut(found.unionByName(front))


def search_closures(search: OpenSearch, net: LineNetwork, keys: DataFrame, max_transfers: int = C.MAX_TRANSFERS) -> tuple[DataFrame, DataFrame]:
    """(states that a closure breaks: CLOSED; their labels under the closure: CLOSED, transfers, LABEL)."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = ["k", "s"]
    columns = [*state, "transfers", *LABEL]
    ids = number_closures(net, keys)
    place = ids.places.select("stop", "corridor", "s")
    named = affected_labels(search, net, keys)
    states = cut(named.select(*CLOSED).distinct())
    broken = cut(named.join(ids.asked, ["origin", "closure"]).join(place, ["stop", "corridor"]).select("k", "s", "transfers"))
    # On a closed line no ride is left, so its own states stay without a label.
    targets = states.where(F.col("closure") != corridor_closure(F.col("corridor")))
    targets = cut(targets.join(ids.asked, ["origin", "closure"]).join(ids.places, ["stop", "corridor"]).select("k", "s", "origin", "c", "l"))
    rides = ids.rides.select("corridor", "board", "stop", "r", "ride", "uses")
    before = place.select(F.col("stop").alias("p_stop"), F.col("corridor").alias("p_corridor"), F.col("s").alias("p_s"))
    parents = broken.select("k", F.col("s").alias("p_s"), (F.col("transfers") + 1).alias("transfers"))

    def undominated(labels: DataFrame) -> DataFrame:
        """Of each state, the labels that are cheaper than all with fewer transfers; a state has at most max_transfers + 1."""
        fewer = Window.partitionBy(*state).orderBy("transfers").rowsBetween(Window.unboundedPreceding, -1)
        return labels.withColumn("_low", F.min("cost").over(fewer)).where("_low IS NULL OR cost < _low").drop("_low").select(*columns)

    # Stored candidates by number of transfers: those that are no cheaper than a label with fewer transfers leave in the join.
    written: list[str] = []
    labels = None
    for candidates in search.candidates:
        stored = candidates.join(rides, ["corridor", "board", "stop"]).join(place, ["stop", "corridor"]).join(before, ["p_stop", "p_corridor"], "left").drop("stop", "corridor")
        wanted = targets.withColumn("low", F.lit(None).cast("bigint")) if labels is None else targets.join(labels.groupBy(*state).agg(F.min("cost").alias("low")), state, "left")
        cheaper = "low IS NULL OR cost < low"
        again = _shut(wanted.drop("l").join(stored, ["origin", "s"]).where(cheaper).drop("origin"), ids.detours).where(cheaper).drop("low")
        valid = again.join(parents, ["k", "p_s", "transfers"], "left_anti")
        found = _cheapest(valid, [*state, "transfers"]).select(*columns)
        written.append(store(found))
        labels = load(spark, found.schema, *written)
    # Labels that the open search has too are among the parents of the stored candidates already.
    opened = search.labels.join(place, ["stop", "corridor"]).select("origin", "s", "transfers", "cost")
    kept = targets.join(opened, ["origin", "s"]).join(broken, [*state, "transfers"], "left_anti").select(*state, "transfers", "cost")
    front = labels.join(kept, [*state, "transfers", "cost"], "left_anti")
    lines = ids.places.select(F.col("corridor").alias("next"), "l").distinct()
    change = net.transfers.select("stop", "board", F.col("corridor").alias("next")).join(lines, "next").join(place, "stop").where("next <> corridor").select(
        "s", "l", "board", F.col("stop").alias("p_stop"), F.col("corridor").alias("p_corridor")
    )
    ridden = ids.rides.join(ids.places, ["stop", "corridor"]).select("l", "board", "s", "r", "ride", "uses")
    while True:
        # Lines are left for broken states only, and only where the cheapest label known there does not rule the new one out.
        best = labels.groupBy(*state).agg(F.min(F.struct("cost", "transfers")).alias("b")).select(*state, F.col("b.cost").alias("_c"), F.col("b.transfers").alias("_t"))
        gaining = targets.select("k", "c", "s", "l").join(best, state, "left")
        going = front.where(F.col("transfers") < max_transfers).select(*state, "transfers", "cost").repartition(parts, *state)
        moved = going.join(change, "s").select(
            "k", "l", "board", (F.col("transfers") + 1).alias("transfers"), (F.col("cost") + C.TRANSFER_PENALTY_SECS).alias("cost"), "p_stop", "p_corridor"
        )
        lower = "_c IS NULL OR cost < _c OR transfers < _t"
        reached = moved.join(gaining, ["k", "l"]).where(lower).join(ridden, ["l", "board", "s"]).withColumn("cost", F.col("cost") + F.col("ride")).where(lower)
        grown = _cheapest(_shut(reached.drop("_c", "_t", "l"), ids.detours), [*state, "transfers"])
        known = labels.select(*state, F.col("transfers").alias("_t"), F.col("cost").alias("_c"))
        no_worse = (F.col("_t") <= F.col("transfers")) & (F.col("_c") <= F.col("cost"))
        same = [grown[c] == known[c] for c in state]
        better = grown.join(known, [*same, no_worse], "left_anti").select(*columns)
        path, grew = store_counted(better)
        if not grew:
            break
        front = load(spark, better.schema, path)
        labels = cut(undominated(_cheapest(labels.unionByName(front), [*state, "transfers"])))
    return states, cut(labels.join(ids.asked, "k").join(place, "s").select(*CLOSED, "transfers", *LABEL))


def cheapest_ends(wanted: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, corridor, transfers, cost of the cheapest label at the destination. ``labels`` has stop for the destination."""
    ends = wanted.join(labels.withColumnRenamed("stop", "destination"), keys)
    return ends.groupBy(*keys).agg(F.min(F.struct("cost", "transfers", "corridor")).alias("b")).select(*keys, "b.*")


def open_ends(wanted: DataFrame, search: OpenSearch) -> DataFrame:
    """origin, destination, cost, transfers, corridor of the best route of every wanted pair that has one."""
    return cheapest_ends(wanted, search.labels.select(*STATE, "transfers", "cost"), ["origin", "destination"])


def closed_ends(wanted: DataFrame, search: OpenSearch, states: DataFrame, labels: DataFrame) -> DataFrame:
    """The same per (origin, closure, destination): states that the closure leaves alone keep their open labels."""
    keys = ["origin", "closure", "destination"]
    at = search.labels.select("origin", F.col("stop").alias("destination"), "corridor", "transfers", "cost")
    broken = states.withColumnRenamed("stop", "destination")
    untouched = wanted.join(at, ["origin", "destination"]).join(broken, [*keys, "corridor"], "left_anti")
    again = wanted.join(labels.select("origin", "closure", F.col("stop").alias("destination"), "corridor", "transfers", "cost"), keys)
    both = untouched.select(*keys, "corridor", "transfers", "cost").unionByName(again.select(*keys, "corridor", "transfers", "cost"))
    return both.groupBy(*keys).agg(F.min(F.struct("cost", "transfers", "corridor")).alias("b")).select(*keys, "b.*")


def paths(ends: DataFrame, net: LineNetwork, search: OpenSearch, states: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``ends`` (origin, destination, corridor, transfers, ... and closure where ``states`` is given) with their path as edge ids.

    The chain is followed from the destination, one transfer per round for all routes at once.
    """
    spark = ends.sparkSession
    held = ends.columns
    walk = cut(ends.select("*", F.col("destination").alias("_stop"), F.col("corridor").alias("_line"), F.col("transfers").alias("_t"), F.array().cast("array<string>").alias("path")))
    opened = search.labels.select("origin", F.col("stop").alias("_stop"), F.col("corridor").alias("_line"), F.col("transfers").alias("_t"), "board", "p_stop", "p_corridor")
    rides = net.rides.select(F.col("corridor").alias("_line"), "board", F.col("stop").alias("_stop"), "edges", "uses")
    steps = ["origin", "_stop", "_line", "_t"]
    done: DataFrame | None = None
    while True:
        if labels is None:
            here = walk.join(opened, steps)
        else:
            again = labels.select("origin", "closure", F.col("stop").alias("_stop"), F.col("corridor").alias("_line"), F.col("transfers").alias("_t"), "board", "p_stop", "p_corridor")
            broken = states.select("origin", "closure", F.col("stop").alias("_stop"), F.col("corridor").alias("_line"))
            here = walk.join(again, ["closure", *steps]).unionByName(walk.join(broken, ["origin", "closure", "_stop", "_line"], "left_anti").join(opened, steps))
        ridden = here.join(rides, ["_line", "board", "_stop"])
        if labels is not None:
            other = net.detours.select("closure", F.col("corridor").alias("_line"), "board", F.col("stop").alias("_stop"), F.col("edges").alias("other"))
            ridden = ridden.join(other, ["closure", "_line", "board", "_stop"], "left")
            ridden = ridden.withColumn("edges", F.when(F.expr("array_contains(uses, closure)"), F.col("other")).otherwise(F.col("edges"))).drop("other")
        change = F.concat_ws("~", "p_stop", "board", F.lit("transit"), F.lit(""), "_line")
        piece = F.when(F.col("p_stop").isNotNull(), F.concat(F.array(change), "edges")).otherwise(F.col("edges"))
        walked = ridden.select(*held, F.col("p_stop").alias("_stop"), F.col("p_corridor").alias("_line"), (F.col("_t") - 1).alias("_t"), F.concat(piece, "path").alias("path"))
        path, open_routes = store_counted(walked, F.col("_stop").isNotNull())
        table = load(spark, walked.schema, path)
        finished = table.where("_stop IS NULL").select(*held, "path")
        done = finished if done is None else done.unionByName(finished)
        if not open_routes:
            return done
        walk = table.where("_stop IS NOT NULL")
