"""Link and junction flow: the point-queue node model, integer vehicle tokens, event effects, demand by turn."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from roadweave.functions import traffic as T
from roadweave.plans.loops import cut

TOLERANCE = 1e-6


def segment_sum(keys: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of rows' values by key; keys without a row have 0."""
    return keys.join(rows.groupBy(key).agg(F.sum(value).alias(value)), key, "left").fillna(0.0, [value])


def turn_links(turn: DataFrame, link: DataFrame) -> DataFrame:
    """Each turn with the queue and capacity of the link that it leaves and the capacity of the one that it enters."""
    a = link.select(F.col("link_id").alias("from_link_id"), F.col("queue_vehicles").alias("from_queue"), F.col("capacity").alias("from_capacity"))
    b = link.select(F.col("link_id").alias("to_link_id"), F.col("capacity").alias("to_capacity"))
    return turn.join(a, "from_link_id").join(b, "to_link_id")


def turn_flows(turn: DataFrame, link: DataFrame) -> DataFrame:
    """Turns with flow and supply: a link's queue and an entered link's capacity are shared by demand times priority. link: link_id, queue_vehicles, capacity."""
    t = turn.withColumn("weighted", F.when(F.col("is_forbidden"), 0.0).otherwise(F.col("turn_demand") * F.coalesce("base_priority", F.lit(1.0))))
    t = t.withColumn("from_sum", F.sum("weighted").over(Window.partitionBy("from_link_id"))).withColumn("to_sum", F.sum("weighted").over(Window.partitionBy("to_link_id")))
    share = lambda total: F.when(F.col(total) > 0, F.col("weighted") / F.col(total)).otherwise(0.0)
    t = turn_links(t, link)
    sending = F.least("from_queue", "from_capacity") * share("from_sum")
    supply = F.when(F.col("is_forbidden"), 0.0).otherwise(F.least(sending, F.col("to_capacity") * share("to_sum")))
    t = t.withColumn("supply", supply)
    return t.withColumn("flow", F.least("turn_demand", "supply"))


def point_queue_step(turn: DataFrame, link: DataFrame) -> DataFrame:
    """link_id, outflow, inflow, queue_next, travel_time_next and over_capacity of each link after one tick. link: link_id, queue_vehicles, capacity, base_ticks."""
    moved = turn_flows(turn, link).select(F.explode(F.array(F.struct(F.col("from_link_id").alias("link_id"), F.col("flow").alias("out"), F.lit(0.0).alias("into")), F.struct(F.col("to_link_id").alias("link_id"), F.lit(0.0).alias("out"), F.col("flow").alias("into")))).alias("m"))
    sums = moved.select("m.*").groupBy("link_id").agg(F.sum("out").alias("outflow"), F.sum("into").alias("inflow"))
    x = link.join(sums, "link_id", "left").fillna(0.0, ["outflow", "inflow"])
    queue = F.greatest(F.lit(0.0), F.col("queue_vehicles") - F.col("outflow") + F.col("inflow"))
    return x.select("link_id", "outflow", "inflow", queue.alias("queue_next"), T.refreshed_travel_time(F.col("base_ticks"), queue, F.col("capacity")).alias("travel_time_next"), (F.col("outflow") > F.col("capacity") + TOLERANCE).alias("over_capacity"))


def event_effects(link: DataFrame, event: DataFrame, tick: int, groups: DataFrame | None = None) -> DataFrame:
    """link_id, n_events, multiplier: the least multiplier of a link's events active at a tick, 1 without one; a closure leaves a link that can't be blocked alone.

    Events name a link_id, or (with groups: bridge_group_id, link_id) a bridge group whose links they all meet.
    """
    active = event.where((F.col("start_tick") <= tick) & (F.col("end_tick") >= tick))
    aimed = active.where("link_id IS NOT NULL").select("event_id", "link_id", "effect_model", "severity")
    if groups is not None:
        aimed = aimed.unionByName(active.where("link_id IS NULL").drop("link_id").join(groups, "bridge_group_id").select("event_id", "link_id", "effect_model", "severity"))
    x = link.select("link_id", "is_blockable").join(aimed, "link_id", "left")
    hit = F.when((F.col("effect_model") == "closure") & ~F.col("is_blockable"), None).otherwise(T.event_multiplier(F.col("effect_model"), F.col("severity")))
    return x.groupBy("link_id").agg(F.count("event_id").alias("n_events"), F.least(F.lit(1.0), F.coalesce(F.min(hit), F.lit(1.0))).alias("multiplier"))


def demand_flags(turn: DataFrame, link: DataFrame) -> DataFrame:
    """link_id, sends, receives: whether a link has turn demand that flows out of it or into it."""
    t = turn_flows(turn, link).withColumn("eligible", (F.col("turn_demand") > 0) & (F.col("flow") > 0))
    sides = t.select("eligible", F.explode(F.array(F.struct(F.col("from_link_id").alias("link_id"), F.lit(True).alias("sending")), F.struct(F.col("to_link_id").alias("link_id"), F.lit(False).alias("sending")))).alias("s"))
    flags = sides.groupBy("s.link_id").agg(F.bool_or(F.col("eligible") & F.col("s.sending")).alias("sends"), F.bool_or(F.col("eligible") & ~F.col("s.sending")).alias("receives"))
    return link.select("link_id").join(flags, "link_id", "left").fillna(False, ["sends", "receives"])


def turn_demand_of(position: DataFrame) -> DataFrame:
    """Agents by what they want next: from_link_id, to_link_id (null: they leave the network there), n_agents. position: agent_id, path (array of link ids), at (0-based place in it), ready."""
    nxt = F.try_element_at("path", F.col("at") + 2)
    return position.where("ready").select(F.element_at("path", F.col("at") + 1).alias("from_link_id"), nxt.alias("to_link_id")).groupBy("from_link_id", "to_link_id").agg(F.count("*").alias("n_agents"))


_TOKENS = "node_id int, from_link_id int, to_link_id int, is_sink boolean, realized long, credit double"


def _junction(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """One junction: each vehicle goes to the movement of the most credit that still has demand, service of its link, a vehicle there and space ahead."""
    p = pdf.sort_values(["is_sink", "from_link_id", "to_link_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    source, target, sink = p["from_link_id"].to_numpy(), p["to_link_id"].to_numpy(), p["is_sink"].to_numpy()
    want = np.floor(p["demand"].to_numpy() + TOLERANCE).astype(np.int64)
    credit = p["credit"].to_numpy(float) + p["share"].to_numpy(float)
    service = dict(zip(source, p["service"], strict=True))
    vehicles = dict(zip(source, p["vehicles"], strict=True))
    space = {t: s for t, s, k in zip(target, p["receiving"], sink, strict=True) if not k}
    done = np.zeros(len(p), np.int64)

    def open_(i: int) -> bool:
        s = source[i]
        return want[i] > done[i] and service[s] > 0 and vehicles[s] > 0 and (sink[i] or space[target[i]] > 0)

    heap = [(-credit[i], not sink[i], i) for i in range(len(p)) if open_(i)]
    heapq.heapify(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        if not open_(i):
            continue
        done[i] += 1
        credit[i] -= 1.0
        service[source[i]] -= 1
        vehicles[source[i]] -= 1
        if not sink[i]:
            space[target[i]] -= 1
        if open_(i):
            heapq.heappush(heap, (-credit[i], not sink[i], i))
    return p.assign(realized=done, credit=credit)[["node_id", "from_link_id", "to_link_id", "is_sink", "realized", "credit"]]


def token_arbitration(turn: DataFrame, link: DataFrame, sinks: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """Integer vehicles of each movement in a tick: node_id, from_link_id, to_link_id, is_sink, realized, credit (carried to the next tick).

    A movement's credit grows by its fractional flow and falls by 1 for each vehicle; links have whole service and receiving tokens, the floor of residual
    and capacity (link: link_id, queue_vehicles, capacity, and optionally service_residual, receiving_residual, storage). sinks: link_id, demand of vehicles that
    end on a link. A link's turns all leave at one node, and its space is taken by turns of one node, so nodes are arbitrated apart: a group is a junction.
    """
    cols = set(link.columns)
    residual = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in cols else F.lit(0.0)
    tokens = link.select(
        "link_id", F.floor("queue_vehicles").alias("vehicles"), F.floor(residual("service_residual") + F.col("capacity") + 1e-9).alias("service"),
        (F.least(F.floor(residual("receiving_residual") + F.col("capacity") + 1e-9), F.floor(F.greatest(F.col("storage") - F.col("queue_vehicles"), F.lit(0.0)) + TOLERANCE)) if "storage" in cols else F.floor(residual("receiving_residual") + F.col("capacity") + 1e-9)).alias("receiving"),
    )
    moves = turn_flows(turn, link).where("NOT is_forbidden AND turn_demand > 0 AND flow > 0").select("node_id", "from_link_id", "to_link_id", F.lit(False).alias("is_sink"), F.col("turn_demand").alias("demand"), F.col("flow").alias("share"))
    if sinks is not None:
        node_of = turn.select("from_link_id", "node_id").distinct()
        ends = sinks.select(F.col("link_id").alias("from_link_id"), F.col("demand").cast("double").alias("demand")).join(node_of, "from_link_id")
        moves = moves.unionByName(ends.select("node_id", "from_link_id", F.lit(-1).alias("to_link_id"), F.lit(True).alias("is_sink"), "demand", F.col("demand").alias("share")))
    if state is not None:
        moves = moves.join(state.select("from_link_id", "to_link_id", "credit"), ["from_link_id", "to_link_id"], "left").fillna(0.0, ["credit"])
    else:
        moves = moves.withColumn("credit", F.lit(0.0))
    moves = moves.join(tokens.select(F.col("link_id").alias("from_link_id"), "service", "vehicles"), "from_link_id")
    moves = moves.join(tokens.select(F.col("link_id").alias("to_link_id"), "receiving"), "to_link_id", "left").fillna(0, ["receiving"])
    return moves.groupBy("node_id").applyInPandas(_junction, _TOKENS)


def token_tick(turn: DataFrame, link: DataFrame, sinks: DataFrame, moves_before: DataFrame | None = None, links_before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(moves, links) after a tick of integer vehicles; both are the next tick's state, so that ticks can be chained.

    link: link_id, queue_vehicles, capacity, and optionally storage; sinks: link_id, demand of vehicles that end there.
    links_before: link_id, service_residual, receiving_residual, service_carry, receiving_carry; moves_before: from_link_id, to_link_id (-1: a sink), credit; none: zeros.
    moves: node_id, from_link_id, to_link_id, is_sink, realized, credit. links: link_id, queue_vehicles, capacity and those of links_before.

    A link that has something to send (or to receive) gains its capacity in tokens; the fraction is left as a residual, and of whole tokens not used one is carried
    on. Others start at zero again. Its capacity is shared as credit between turns and sink in proportion to their demands, turns among themselves by their flow;
    a sink gets what the turns leave. A turn with demand that can't flow keeps its credit.
    """
    zero = F.lit(0.0)
    names = ("service_residual", "receiving_residual", "service_carry", "receiving_carry")
    before = link if links_before is None else link.join(links_before.select("link_id", *names), "link_id", "left")
    before = before.select(*link.columns, *[(F.coalesce(n, zero) if links_before is not None else zero).alias(n) for n in names])
    waiting = turn_flows(turn, link).where("NOT is_forbidden AND turn_demand > 0").select("node_id", "from_link_id", "to_link_id", F.lit(False).alias("is_sink"), F.col("turn_demand").alias("demand"), "flow")
    if "storage" in link.columns:
        full = link.where(F.col("storage") - F.col("queue_vehicles") < 1 - TOLERANCE).select(F.col("link_id").alias("to_link_id"), F.lit(True).alias("full"))
        waiting = waiting.join(full, "to_link_id", "left").withColumn("flow", F.when(F.col("full"), 0.0).otherwise(F.col("flow"))).drop("full")
    ends = sinks.select(F.col("link_id").alias("from_link_id"), F.floor(F.greatest("demand", zero) + TOLERANCE).cast("double").alias("demand")).where("demand > 0")
    node_of = turn.select("from_link_id", "node_id").distinct()
    open_ = waiting.where("flow > 0")
    sent = open_.groupBy("from_link_id").agg(F.sum("demand").alias("inner"), F.sum("flow").alias("fraction"))
    source = before.select(F.col("link_id").alias("from_link_id"), F.col("capacity").alias("cap")).join(sent, "from_link_id", "left").join(ends.withColumnRenamed("demand", "outer"), "from_link_id", "left").fillna(0.0, ["inner", "fraction", "outer"])
    total = F.col("inner") + F.col("outer")
    source = source.withColumn("inner_credit", F.least(F.when(total > 0, F.col("cap") * F.col("inner") / total).otherwise(0.0), "fraction"))
    source = source.withColumn("outer_credit", F.least("outer", F.greatest(F.col("cap") - F.col("inner_credit"), zero)))
    shares = source.select("from_link_id", "fraction", "inner_credit", "outer_credit")
    credit = lambda df: df.join(moves_before.select("from_link_id", "to_link_id", "credit"), ["from_link_id", "to_link_id"], "left").fillna(0.0, ["credit"]) if moves_before is not None else df.withColumn("credit", zero)
    sinking = ends.join(node_of, "from_link_id").withColumns({"to_link_id": F.lit(-1), "is_sink": F.lit(True), "flow": F.lit(None).cast("double")})
    moves = credit(waiting.unionByName(sinking)).join(shares, "from_link_id")
    moves = moves.withColumn("share", F.when(F.col("is_sink"), F.col("outer_credit")).when(F.col("flow") > 0, F.col("flow") * F.col("inner_credit") / F.col("fraction")).otherwise(0.0))
    sends = source.where(total > 0).select(F.col("from_link_id").alias("link_id"), F.lit(True).alias("sends"))
    receives = open_.select(F.col("to_link_id").alias("link_id")).distinct().withColumn("receives", F.lit(True))
    tokens = before.join(sends, "link_id", "left").join(receives, "link_id", "left").fillna(False, ["sends", "receives"])
    for side, has in (("service", "sends"), ("receiving", "receives")):
        gained = F.when(F.col(has), F.col(f"{side}_residual") + F.col("capacity")).otherwise(0.0)
        whole = F.floor(gained + 1e-9)
        rest = F.when(F.abs(gained - whole) <= 1e-9, 0.0).otherwise(gained - whole)
        carried = F.when(F.col(has) & (F.col("capacity") > 0), F.round(f"{side}_carry").cast("long")).otherwise(0)
        tokens = tokens.withColumn(f"{side}_left", rest).withColumn(side, whole + carried)
    if "storage" in link.columns:
        tokens = tokens.withColumn("receiving", F.least("receiving", F.floor(F.greatest(F.col("storage") - F.col("queue_vehicles"), zero) + TOLERANCE)))
    tokens = tokens.withColumn("vehicles", F.floor(F.col("queue_vehicles") + TOLERANCE))
    dealt = moves.join(tokens.select(F.col("link_id").alias("from_link_id"), "service", "vehicles"), "from_link_id").join(tokens.select(F.col("link_id").alias("to_link_id"), "receiving"), "to_link_id", "left").fillna(0, ["receiving"])
    # a turn that can't flow this tick has no demand in the deal
    dealt = dealt.withColumn("demand", F.when(F.col("is_sink") | (F.col("flow") > 0), F.col("demand")).otherwise(0.0))
    out = cut(dealt.groupBy("node_id").applyInPandas(_junction, _TOKENS))
    gone = out.groupBy(F.col("from_link_id").alias("link_id")).agg(F.sum("realized").alias("sent"))
    came = out.where("NOT is_sink").groupBy(F.col("to_link_id").alias("link_id")).agg(F.sum("realized").alias("came"))
    x = tokens.join(gone, "link_id", "left").join(came, "link_id", "left").fillna(0, ["sent", "came"])
    one = lambda side, used, has: F.when(F.col(has) & (F.col("capacity") > 0), F.greatest(F.least(F.col(side) - F.col(used), F.lit(1)), F.lit(0))).otherwise(0).cast("double").alias(f"{side}_carry")
    queue = F.greatest(zero, F.col("queue_vehicles") - F.col("sent") + F.col("came")).alias("queue_vehicles")
    after = x.select("link_id", queue, *[c for c in link.columns if c not in ("link_id", "queue_vehicles")], F.col("service_left").alias("service_residual"), F.col("receiving_left").alias("receiving_residual"), one("service", "sent", "sends"), one("receiving", "came", "receives"))
    return out, cut(after)
