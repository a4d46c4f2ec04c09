"""Operating envelopes: candidates as rows, evaluated by the power flow, and offers and reservations against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederflow.functions.keys import shared_keys
from feederflow.functions.running import dealt_in_order, sums_before
from feederflow.functions.units import ENVELOPE_CAP_KW, INTERVAL_H, WIDTH_WEIGHT
from feederflow.operators import matching
from feederflow.operators import thermal as th
from feederflow.operators.flow import RANGE, along_path, below_and_own, first_candidate, first_tier, limit_violations, of_pieces, pieces, power_flow, together, voltage_current_results
from feederflow.sources.tables import discard, stored


def envelope_linear(tree: DataFrame, branch: DataFrame, bus: DataFrame, load: DataFrame, readings: DataFrame, people: DataFrame, cap_kw: float = ENVELOPE_CAP_KW) -> DataFrame:
    """A lossless estimate, the same kW for each participant of a network and time: (n, t, lb_kw, ub_kw).

    Each limit's headroom is divided by what one kW of every participant takes of it; the least
    quotient is the envelope. Readings of participants are replaced, the others stay. Sensitivities
    are running sums over the trees' order, and a bus counts from its own tree's infeeder.
    """
    keys = ("n", "t")
    r = load.select("n", "load_id", "bus_id").join(readings, shared_keys(load, readings)).join(people.select("n", "load_id", F.lit(1.0).alias("_in")), ["n", "load_id"], "left")
    by_bus = r.groupBy("n", "t", "bus_id").agg(F.sum(F.when(F.col("_in").isNull(), F.col("real_power_w")).otherwise(0.0) / 1e6).alias("p"), F.sum(F.col("reactive_power_var") / 1e6).alias("q"), F.sum(F.coalesce("_in", F.lit(0.0))).alias("k"))
    at = by_bus.join(tree.select("n", "bus_id", "enter"), ["n", "bus_id"])
    flow = below_and_own(tree, at, {"p": "p", "q": "q", "k": "k"}, keys, RANGE)
    sets = bus.where("v_set_pu is not null").select("n", F.col("bus_id").alias("root"), (F.col("v_set_pu") ** 2).alias("v0"))
    place = tree.select("n", "branch_id", "bus_id", "root", "enter", "leave").join(branch.select("n", "branch_id", "r_pu", "x_pu"), ["n", "branch_id"]).join(sets, ["n", "root"])
    drop = flow.join(place, ["n", "branch_id"]).withColumns({"_d": 2 * (F.col("r_pu") * F.col("p") + F.col("x_pu") * F.col("q")), "_s": 2 * F.col("r_pu") * F.col("k") / 1e3})
    v = along_path(drop, {"d": "_d", "s": "_s"}, keys, RANGE, "bus_id", "v0")
    v = v.join(bus.select("n", "bus_id", "v_min_pu", "v_max_pu"), ["n", "bus_id"]).where("s > 1e-15")
    down = (F.col("v0") - F.col("d") - F.col("v_min_pu") ** 2) / F.col("s")
    up = (F.col("v_max_pu") ** 2 - F.col("v0") + F.col("d")) / F.col("s")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.min(c), F.lit(cap_kw)))
    return v.groupBy("n", "t").agg((-clip(down)).alias("lb_kw"), clip(up).alias("ub_kw"))


def _filled(total: Column) -> Column:
    """A segment's kW of a candidate total: its group takes what is left after those before it, its loads share by size."""
    group = F.greatest(F.lit(0.0), F.least(total - F.col("before"), F.col("group_kw")))
    return F.when(F.col("group_kw") > 0, group * F.col("size_kw") / F.col("group_kw")).otherwise(0.0)


def _sensitivity(tree: DataFrame) -> DataFrame:
    """(n, bus_id, s): resistance of each bus's path to its infeeder."""
    # rounded, so that paths of equal resistance rank as equals
    return tree.select("n", "bus_id", F.greatest(F.round("path_r", 12), F.lit(1e-12)).alias("s"))


def _ordered(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments (``by``, bus_id, load_id, rank, size_kw) with their group's size and the kW filled before it: lowest rank first, then by bus.

    A network's groups may fill several tasks: they are dealt out in their order.
    """
    same = [*by, "rank", "bus_id"]
    groups = dealt_in_order(segments.groupBy(*same).agg(F.sum("size_kw").alias("group_kw")), by, ["rank", "bus_id"])
    groups = sums_before(groups, by, "_part", ["rank", "bus_id"], {"before": "group_kw"}).drop("_part")
    return segments.join(groups, same).select(*by, "bus_id", "load_id", "size_kw", "group_kw", "before")


def _divided(tree: DataFrame, branch: DataFrame, bus: DataFrame, base: DataFrame, segments: DataFrame, limits: DataFrame | None, most_branches: int = 200_000) -> dict | None:
    """What the candidates of networks above ``most_branches`` are judged by, cut into pieces of whole feeders: the same for all rounds of a search. None if there are none.

    ``over`` are the networks above, ``whole`` those of them that are not cut, ``names`` the pieces (n) of each network (of), ``given`` what ``first_candidate`` takes.
    """
    over = stored(branch.groupBy("n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most_branches).select("n"), "envelope-over")
    if over.isEmpty():
        return None
    cut, whole = pieces(tree.join(over, "n", "left_semi"), most_branches)
    if cut is None:
        return {"over": over, "whole": whole, "names": None, "given": None}
    mine = lambda df, on, roots=False: None if df is None else stored(of_pieces(cut, df, on, roots), "envelope-pieces")
    columns = branch.select("n", "branch_id", "r_pu", "x_pu", "ratio_pu", "i_max_pu")
    given = (cut.drop("of"), mine(columns, "branch_id"), mine(bus.select("n", "bus_id", "v_set_pu", "v_min_pu", "v_max_pu"), "bus_id", True), mine(base, "bus_id"), mine(segments, "bus_id"), mine(limits, "branch_id"))
    return {"over": over, "whole": whole, "names": stored(cut.select("n", "of").distinct(), "envelope-pieces"), "given": given}


def _first(tree: DataFrame, branch: DataFrame, bus: DataFrame, base: DataFrame, segments: DataFrame, tried: DataFrame, broken: bool, limits: DataFrame | None, passes: int, most_branches: int = 200_000, divided: dict | bool | None = None) -> DataFrame:
    """(n, t, oe, first) as ``first_candidate`` gives it, in networks above ``most_branches`` by pieces of them; candidates of networks that can't be cut are rows of one power flow.

    ``divided`` is what ``_divided`` gives, made here if None; False: no network is above.
    """
    if divided is None:
        divided = _divided(tree, branch, bus, base, segments, limits, most_branches)
    if not divided:
        return first_candidate(tree, branch, bus, base, segments, tried, broken, limits, passes)
    over, whole = divided["over"], divided["whole"]
    found, small = None, tried.join(over, "n", "left_anti")
    if not small.isEmpty():
        found = first_candidate(tree.join(over, "n", "left_anti"), branch, bus, base, segments, small, broken, limits, passes)
    least = lambda df: df.groupBy("n", "t", "oe").agg(F.min("c").alias("first"))
    if divided["names"] is not None:
        *given, own = divided["given"]
        each = tried.withColumnRenamed("n", "of").join(divided["names"], "of").select(*tried.columns)
        # a candidate is broken if a piece is; one that is not has to hold in all of them
        bad = first_candidate(*given, each, True, own, passes, all_such=not broken).join(divided["names"], "n").select(F.col("of").alias("n"), "t", "oe", F.col("first").alias("c"))
        some = tried.join(divided["names"].select(F.col("of").alias("n")).distinct(), "n", "left_semi")
        found = together(found, least(bad if broken else some.join(bad, ["n", "t", "oe", "c"], "left_anti")))
    if whole is None:
        return found
    keys = ("n", "t", "oe", "c")
    tried, base = stored(tried.join(whole, "n", "left_semi"), "envelope-tried"), base.join(whole, "n", "left_semi")
    sign = F.when(F.col("oe") == "oel", 1.0).otherwise(-1.0)
    given = segments.join(tried, [c for c in ("n", "oe", "t") if c in segments.columns]).select(*keys, "bus_id", (sign * _filled(F.col("total")) / 1e3).alias("p_pu"), F.lit(0.0).alias("q_pu"))
    nodal = base.join(tried.select(*keys), ["n", "t"]).select(*keys, "bus_id", "p_pu", "q_pu").unionByName(given)
    nodal = nodal.groupBy(*keys, "bus_id").agg(F.sum("p_pu").alias("p_pu"), F.sum("q_pu").alias("q_pu"))
    flow, volt, done = power_flow(tree, branch, bus, nodal, passes, keys, most_branches=most_branches)
    bad = limit_violations(flow, volt, branch, bus, keys).select(*keys)
    if limits is not None:
        bad = bad.unionByName(flow.join(limits, ["n", "t", "branch_id"]).where("l_pu > i_max_pu * i_max_pu").select(*keys))
    bad = bad.unionByName(done.where("not converged").select(*keys)).distinct()
    return together(found, least(tried.join(bad, list(keys), "left_semi" if broken else "left_anti")))


def _fill_search(tree: DataFrame, branch: DataFrame, bus: DataFrame, load: DataFrame, readings: DataFrame, segments: DataFrame, by: list[str], limits: DataFrame | None, grid: int, rounds: int, passes: int) -> DataFrame:
    """Largest feasible total of each network, time and side, filled into ordered segments: (n, t, load_id, lb_kw, ub_kw, feasible).

    ``by`` holds n and oe, and t where segments differ by time. Loads with segments give up their
    forecast active power for what they are filled with, also at times at which they have none.
    """
    p = stored(segments, "envelope-people")
    own = p.select("n", "load_id").distinct().withColumn("_in", F.lit(True))
    r = load.select("n", "load_id", "bus_id").join(readings, shared_keys(load, readings)).join(own, ["n", "load_id"], "left")
    kept = F.when(F.col("_in").isNull(), F.col("real_power_w")).otherwise(0.0)
    r = stored(r.groupBy("n", "t", "bus_id").agg((F.sum(kept) / 1e6).alias("p_pu"), (F.sum("reactive_power_var") / 1e6).alias("q_pu")), "envelope-readings")
    divided = _divided(tree, branch, bus, r, p, limits) or False
    most = p.groupBy(*by).agg(F.sum("size_kw").cast("double").alias("hi"))
    cell = r.select("n", "t").distinct().join(most, [c for c in by if c != "oe"]).select("n", "t", "oe", F.lit(0.0).alias("lo"), "hi", F.lit(True).alias("ok"))
    for _ in range(rounds):
        cell = stored(cell, "envelope-cell")
        # without a feasible point there is nothing to narrow
        if cell.where("ok").isEmpty():
            break
        tried = cell.where("ok").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid)))).select("n", "t", "oe", "c", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("c") / grid).alias("total"))
        first_bad = _first(tree, branch, bus, r, p, tried, True, limits, passes, divided=divided)
        step = (F.col("hi") - F.col("lo")) / grid
        k = F.when(F.col("ok"), F.coalesce("first", F.lit(grid + 1)) - 1).otherwise(-1)
        cell = cell.join(first_bad, ["n", "t", "oe"], "left").select("n", "t", "oe", (F.col("lo") + step * F.greatest(k, F.lit(0))).alias("lo"), F.least(F.col("hi"), F.col("lo") + step * (F.greatest(k, F.lit(0)) + 1)).alias("hi"), (F.col("ok") & (k >= 0)).alias("ok"))
    cell = stored(cell, "envelope-cell")
    best = p.join(cell, by).select("n", "t", "load_id", "oe", _filled(F.col("lo")).alias("kw"), "ok")
    side = lambda s: F.sum(F.when(F.col("oe") == s, F.col("kw")))
    return best.groupBy("n", "t", "load_id").agg((-side("oel")).alias("lb_kw"), side("oer").alias("ub_kw"), F.min("ok").alias("feasible"))


def envelope_search(tree: DataFrame, branch: DataFrame, bus: DataFrame, load: DataFrame, readings: DataFrame, people: DataFrame, rule: str = "uniform", prices: DataFrame | None = None, limits: DataFrame | None = None, cap_kw: float = ENVELOPE_CAP_KW, grid: int = 16, rounds: int = 3, passes: int = 60) -> DataFrame:
    """Largest feasible import (lb, negative) and export (ub) of each participant: (n, t, load_id, lb_kw, ub_kw, feasible).

    A round evaluates ``grid`` totals in the cell left for each network, time and side, all as rows
    of one power flow, keeps the largest total below which all are feasible, and narrows the cell
    to it. ``uniform`` gives all participants the same; ``nearest`` fills them by value per
    sensitivity, (export price x 5/60 + 0.001) / path resistance (prices count on the export side
    only), in groups by bus. ``limits`` (n, t, branch_id, i_max_pu) tightens branch ratings by time.
    If 0 kW is infeasible the envelope is 0 and ``feasible`` false.
    """
    p = load.select("n", "load_id", "bus_id").join(people.select("n", "load_id"), ["n", "load_id"])
    p = matching.index_product(p.join(_sensitivity(tree), ["n", "bus_id"])).withColumn("size_kw", F.lit(float(cap_kw)))
    if rule == "uniform":
        groups = p.groupBy("n", "oe").agg(F.sum("size_kw").alias("group_kw"))
        p = p.join(groups, ["n", "oe"]).select("n", "oe", "bus_id", "load_id", "size_kw", "group_kw", F.lit(0.0).alias("before"))
    else:
        on = shared_keys(p, prices) if prices is not None else []
        p = p.join(prices.select(*on, "export_price_kwh"), on, "left") if on else p.withColumn("export_price_kwh", F.lit(0.0))
        p = _ordered(p.withColumn("rank", F.struct((-_width_value(F.col("export_price_kwh"))).alias("less_value"))), ["n", "oe"])
    return _fill_search(tree, branch, bus, load, readings, p, ["n", "oe"], limits, grid, rounds, passes)


def _width_value(price: Column) -> Column:
    """What a kW of envelope is worth per unit of sensitivity; prices count on the export side."""
    paid = F.when(F.col("oe") == "oer", F.coalesce(price, F.lit(0.0))).otherwise(0.0)
    return (paid * INTERVAL_H + WIDTH_WEIGHT) / F.col("s")


def envelope_reserved(tree: DataFrame, branch: DataFrame, bus: DataFrame, load: DataFrame, readings: DataFrame, offers: DataFrame, cap_kw: float = ENVELOPE_CAP_KW, grid: int = 16, rounds: int = 3, passes: int = 60) -> DataFrame:
    """Shared envelopes of the loads with offers: (n, t, load_id, lb_kw, ub_kw, feasible, dispatch_kw, payment_dlr, shortfall_kw).

    On each side a load has three segments, filled in this order: the part of its reservation that
    no dispatch could stand in for, the rest of it (dearest dispatch per unit of sensitivity first),
    and what is left up to the cap, nearest first. What the first search leaves of a reservation is
    dispatched, which moves what the other side has to hold; the second search fills with these
    needs. Dispatch and shortfall are those of the second envelopes. Null reservations count as 0.
    """
    on = shared_keys(load, offers)
    o = offers.select(*on, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("reservation_l", "reservation_u")], "injection", "consumption")
    p = load.select("n", "load_id", "bus_id").join(o, on).join(_sensitivity(tree), ["n", "bus_id"])

    def search(p: DataFrame, by: list[str]) -> DataFrame:
        """``d`` is the net dispatch settled so far."""
        up = F.col("oe") == "oer"
        held = F.when(up, F.col("reservation_u") + F.col("d")).otherwise(-F.col("reservation_l") - F.col("d"))
        # import that is short is made up by injection, export that is short by consumption
        offered = F.when(up, first_tier("consumption", 0) + F.least(F.col("d"), F.lit(0.0))).otherwise(first_tier("injection", 0) - F.greatest(F.col("d"), F.lit(0.0)))
        price = F.when(up, first_tier("consumption", 1)).otherwise(first_tier("injection", 1))
        p = matching.index_product(p).withColumn("held", F.greatest(F.lit(0.0), F.least(F.lit(float(cap_kw)), held))).withColumn("free", F.least(F.col("held"), F.greatest(F.lit(0.0), offered)))
        part = lambda tier, value, kw: F.struct(F.struct(F.lit(tier).alias("tier"), (-value).alias("less_value")).alias("rank"), kw.alias("size_kw"))
        dear, wide = price * INTERVAL_H / F.col("s"), _width_value(F.lit(0.0))
        parts = F.array(part(0, dear, F.col("held") - F.col("free")), part(1, dear, F.col("free")), part(2, wide, F.lit(float(cap_kw)) - F.col("held")))
        segments = p.select(*by, "bus_id", "load_id", F.explode(parts).alias("s")).select(*by, "bus_id", "load_id", "s.*")
        return stored(_fill_search(tree, branch, bus, load, readings, _ordered(segments, by), by, None, grid, rounds, passes), "reserved-envelope")

    first = search(p.withColumn("d", F.lit(0.0)), ["n", "oe"])
    settled = reservation_dispatch(first, o).select("n", "t", "load_id", F.col("dispatch_kw").alias("d"))
    second = search(p.join(settled, ["n", "load_id"]), ["n", "t", "oe"])
    return second.join(reservation_dispatch(second, o), ["n", "t", "load_id"])


def multistep_envelopes(tree: DataFrame, branch: DataFrame, bus: DataFrame, load: DataFrame, readings: DataFrame, people: DataFrame, ambient: DataFrame, params: DataFrame | None = None, rule: str = "uniform", prices: DataFrame | None = None, cap_kw: float = ENVELOPE_CAP_KW, grid: int = 16, rounds: int = 3, passes: int = 60, state_from: str = "oel", within: float = 1e-6) -> dict[str, DataFrame]:
    """Envelopes of all networks and times, and what follows from them: ``envelope``, ``bus``, ``branch``, ``violations``, ``thermal``.

    With ``params`` the transformers' hot spots limit the envelopes, and a step starts from the temperatures
    that the final envelopes of the steps before it lead to. Both are found together, all times at once:
    envelopes without the limit are searched once; temperatures follow from the last envelopes' currents, the current
    that they allow follows for each step, and only steps whose limit binds and has moved by more than ``within`` (relative) are
    searched again. A step depends on earlier ones alone, so after k rounds at least k steps are final, and as
    the influence of a step fades most series settle in a few.

    ``state_from`` says whose currents heat the transformers: import (``oel``), export (``oer``) or the larger (``max``).
    A step without a feasible point, of either side, does not heat: temperatures stay, and ``thermal`` says ``solved`` false.
    ``thermal`` holds the temperatures at the envelopes' currents, or no rows without ``params``. ``ambient`` has a row for each time.
    """
    if state_from not in ("oel", "oer", "max"):
        raise ValueError(f"state_from is oel, oer or max, not {state_from}")

    def search(given: DataFrame, limits: DataFrame | None) -> DataFrame:
        found = envelope_search(tree, branch, bus, load, given, people, rule, prices, limits, cap_kw, grid, rounds, passes)
        return stored(found, "multistep-envelope")

    def flows(envelope: DataFrame, given: DataFrame):
        sides = F.explode(F.array(F.struct(F.lit("oel").alias("oe"), F.col("lb_kw").alias("kw")), F.struct(F.lit("oer").alias("oe"), F.col("ub_kw").alias("kw"))))
        e = envelope.select("n", "t", "load_id", sides.alias("s")).select("n", "t", "load_id", "s.*")
        f, v, _ = power_flow(tree, branch, bus, matching.nodal_allocation(load, given, e), passes)
        return f, v

    # branch ids need only be unique in their network
    tx = branch.where("kind = 'transformer'").select("n", "branch_id", "i_base_a", F.to_json(F.struct("n", "branch_id")).alias("tx_id"))
    side = lambda s: F.max(F.when(F.col("oe") == s, F.sqrt("l_pu") * F.col("i_base_a")))

    def currents(envelope: DataFrame, flow: DataFrame) -> DataFrame:
        """(n, t, tx_id, branch_id, oel, oer, solved) in A."""
        solved = envelope.groupBy("n", "t").agg(F.min("feasible").alias("solved"))
        amps = flow.join(tx, ["n", "branch_id"]).groupBy("n", "t", "tx_id", "branch_id").agg(side("oel").alias("oel"), side("oer").alias("oer"))
        return stored(amps.join(solved, ["n", "t"]), "multistep-currents")

    def temperatures(amps: DataFrame) -> DataFrame:
        heat = F.greatest("oel", "oer") if state_from == "max" else F.col(state_from)
        given = amps.select("tx_id", "t", F.when(F.col("solved"), heat).alias("current_a"))
        return stored(th.thermal_series(th.ultimate_rise(th.load_factor(given, params), params), ambient, params), "multistep-thermal")

    envelope = search(readings, None)
    flow, volt = flows(envelope, readings)
    if params is None:
        warm = tx.select("n", F.lit(None).cast("timestamp_ntz").alias("t"), "branch_id", *[F.lit(None).cast("double").alias(c) for c in ("delta_theta_TO", "delta_theta_HS", "theta_HS")], F.lit(None).cast("boolean").alias("solved")).where(F.lit(False))
    else:
        free = amps = currents(envelope, flow)
        free_flow, free_volt = flow, volt
        used = None
        while True:
            heated = temperatures(amps)
            before = Window.partitionBy("tx_id").orderBy("t")
            start = heated.select("tx_id", "t", *[F.coalesce(F.lag(c).over(before), F.lit(0.0)).alias(c) for c in ("delta_theta_TO", "delta_theta_HS")])
            allowed = th.max_current_for_hotspot(start, ambient, params).select("tx_id", "t", "i_max_a")
            # steps at which some transformer's limit binds; a step takes the limits of all its transformers
            near = free.join(allowed, ["tx_id", "t"]).withColumn("_binds", F.col("solved") & (F.greatest("oel", "oer") > F.col("i_max_a")))
            limits = stored(near.withColumn("_some", F.max("_binds").over(Window.partitionBy("n", "t"))).where("_some").join(tx.select("tx_id", "i_base_a"), "tx_id").select("n", "t", "branch_id", (F.col("i_max_a") / F.col("i_base_a")).alias("i_max_pu")), "multistep-limits")
            if used is None:
                moved = limits.select("n", "t").distinct()
                dropped = moved.limit(0)
            else:
                both = limits.join(used.withColumnRenamed("i_max_pu", "_last"), ["n", "t", "branch_id"], "full")
                shift = F.abs(F.col("i_max_pu") - F.col("_last")) > within * F.abs(F.col("_last"))
                both = both.groupBy("n", "t").agg(F.max(F.coalesce(shift, F.lit(True))).alias("moved"), F.count("i_max_pu").alias("binds")).where("moved")
                both = stored(both, "multistep-moved")
                moved, dropped = both.where("binds > 0").select("n", "t"), both.where("binds = 0").select("n", "t")
            moved = stored(moved, "multistep-moved")
            if moved.isEmpty() and dropped.isEmpty():
                break
            if used is None:
                unlimited = envelope
            given = stored(load.select("n", "load_id").join(readings, shared_keys(load, readings)).join(moved, ["n", "t"], "left_semi"), "multistep-steps")
            again = search(given, limits.join(moved, ["n", "t"], "left_semi"))
            again_flow, again_volt = flows(again, given)
            again_amps = currents(again, again_flow)
            change = stored(moved.unionByName(dropped), "multistep-moved")
            keep = lambda old, new, base: old.join(change, ["n", "t"], "left_anti").unionByName(new).unionByName(base.join(dropped, ["n", "t"], "left_semi"))  # noqa: B023, E731
            envelope = stored(keep(envelope, again, unlimited), "multistep-envelope")
            amps = stored(keep(amps, again_amps, free), "multistep-currents")
            # a step's flows follow from its own envelopes, so only those of changed steps are made again
            flow, volt = keep(flow, again_flow, free_flow), keep(volt, again_volt, free_volt)
            # the limits that the kept envelopes were searched with
            new = limits.join(moved, ["n", "t"], "left_semi")
            used = stored(new if used is None else used.join(change, ["n", "t"], "left_anti").unionByName(new), "multistep-limits")
        warm = heated.join(amps.select("tx_id", "n", "branch_id", "t", "solved"), ["tx_id", "t"]).select("n", "t", "branch_id", "delta_theta_TO", "delta_theta_HS", "theta_HS", "solved")
    buses, branches = voltage_current_results(flow, volt, branch)
    return {"envelope": envelope, "bus": buses, "branch": branches, "violations": limit_violations(flow, volt, branch, bus), "thermal": warm}


def _of_time(df: DataFrame, *others: DataFrame) -> list[str]:
    """``t`` where all tables have it."""
    return [c for c in ("t",) if all(c in x.columns for x in (df, *others))]


def offer_cap_check(dispatch: DataFrame, offers: DataFrame) -> DataFrame:
    """(n and t if given, load_id, ci, dispatch_kw, cap_kw, ok) for (load_id, ci, kw); offers hold for all times unless they have a ``t``."""
    cap = F.when(F.col("ci") == "inj", first_tier("injection", 0)).otherwise(first_tier("consumption", 0))
    on = [*shared_keys(dispatch, offers), *_of_time(dispatch, offers)]
    keys = [c for c in ("n", "t") if c in dispatch.columns]
    return dispatch.join(offers.select(*on, "injection", "consumption"), on, "left").select(*keys, "load_id", "ci", F.col("kw").alias("dispatch_kw"), cap.alias("cap_kw"), (F.col("kw") <= cap).alias("ok"))


def reservation_check(envelope: DataFrame, offers: DataFrame, dispatch: DataFrame) -> DataFrame:
    """(n, t if given, load_id, short_l_kw, short_u_kw): what the envelope lacks of the reservation around the net dispatch of its time."""
    on = [*shared_keys(envelope, offers), *_of_time(envelope, offers)]
    to = [*shared_keys(envelope, dispatch), *_of_time(envelope, dispatch)]
    j = envelope.join(offers.select(*on, "reservation_l", "reservation_u"), on).join(dispatch.select(*to, F.col("dispatch_kw").alias("_d")), to, "left")
    d = F.coalesce("_d", F.lit(0.0))
    return j.select("n", *_of_time(envelope), "load_id", F.greatest(F.lit(0.0), F.col("lb_kw") - (F.col("reservation_l") + d)).alias("short_l_kw"), F.greatest(F.lit(0.0), F.col("reservation_u") + d - F.col("ub_kw")).alias("short_u_kw"))


def reservation_dispatch(envelope: DataFrame, offers: DataFrame, hours: float = INTERVAL_H) -> DataFrame:
    """(n, t if given, load_id, dispatch_kw, payment_dlr, shortfall_kw): the net dispatch nearest 0 that honours both reservations.

    It lies in [lb - reservation_l, ub - reservation_u]; clipped to the first tiers' quantities. What an
    empty interval or the clip leaves open is the shortfall.
    """
    j = envelope.join(offers, shared_keys(envelope, offers))
    lo, hi = F.col("lb_kw") - F.col("reservation_l"), F.col("ub_kw") - F.col("reservation_u")
    want = F.greatest(lo, F.least(F.lit(0.0), hi))
    got = F.greatest(-first_tier("consumption", 0), F.least(first_tier("injection", 0), want))
    price = F.when(got >= 0, first_tier("injection", 1)).otherwise(first_tier("consumption", 1))
    short = F.greatest(F.lit(0.0), lo - got) + F.greatest(F.lit(0.0), got - hi)
    keys = [c for c in ("n", "t") if c in envelope.columns]
    return j.select(*keys, "load_id", F.round(got, 9).alias("dispatch_kw"), F.round(F.abs(got) * price * hours, 9).alias("payment_dlr"), F.round(short, 9).alias("shortfall_kw"))


def required_shed(tree: DataFrame, branch: DataFrame, bus: DataFrame, load: DataFrame, readings: DataFrame, passes: int = 60, grid: int = 16, rounds: int = 3) -> DataFrame:
    """(n, t, bus_id, shed_kw, restored): the least relief at each network's most sensitive load bus that restores the limits.

    Networks and times within their limits have 0. The relief is searched like an envelope, up to all
    loads' summed size; where no relief of that bus helps, ``shed_kw`` is null and ``restored`` false.
    """
    near = _sensitivity(tree)
    worst = load.select("n", "bus_id").distinct().join(near, ["n", "bus_id"]).groupBy("n").agg(F.max_by("bus_id", F.struct("s", "bus_id")).alias("bus_id"))
    nodal = stored(matching.nodal_allocation(load, readings, None).where("oe = 'oel'").drop("oe"), "shed-nodal")
    cell = nodal.groupBy("n", "t").agg(F.sum(F.abs("p_pu")).alias("hi")).select("n", "t", F.lit(0.0).alias("lo"), "hi", F.lit(True).alias("restored"))
    # one segment, filled from below, that takes all
    cell = stored(cell, "shed-cell")
    relief = stored(cell.join(worst, "n").select("n", "t", F.lit("oer").alias("oe"), "bus_id", (F.col("hi") * 1e3).alias("size_kw"), (F.col("hi") * 1e3).alias("group_kw"), F.lit(0.0).alias("before")), "shed-relief")
    divided = _divided(tree, branch, bus, nodal, relief, None) or False
    for _ in range(rounds):
        tried = cell.where("restored").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid)))).select("n", "t", F.lit("oer").alias("oe"), "c", ((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("c") / grid) * 1e3).alias("total"))
        good = _first(tree, branch, bus, nodal, relief, tried, False, None, passes, divided=divided).select("n", "t", F.col("first").alias("k"))
        step = (F.col("hi") - F.col("lo")) / grid
        k = F.coalesce("k", F.lit(grid))
        cell = cell.join(good, ["n", "t"], "left").select("n", "t", (F.col("lo") + step * F.greatest(k - 1, F.lit(0))).alias("lo"), (F.col("lo") + step * k).alias("hi"), (F.col("restored") & F.col("k").isNotNull()).alias("restored"))
        cell = stored(cell, "shed-cell")
        if cell.where("restored").isEmpty():
            break
    return cell.join(worst, "n").select("n", "t", "bus_id", F.when(F.col("restored"), F.col("hi") * 1e3).alias("shed_kw"), "restored")
