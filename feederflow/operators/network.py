"""Network tables from component rows, and the tree that they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feederflow.functions.units import BASE_VA, LINE_RATING_A, TRANSFORMER_RATING_W
from feederflow.sources.tables import discard, stored, unreadable


def components_of_type(components: DataFrame, ctype: str) -> DataFrame:
    return components.where(F.col("ctype") == ctype)


def ordinal_ids(df: DataFrame, key: str) -> DataFrame:
    """A dense index from 0 in each network, by key."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy(key)) - 1)


def _node(k: int) -> Column:
    return F.get("body.cons", F.lit(k))["node"]


def bus_table(components: DataFrame) -> DataFrame:
    base = F.col("body.v_base")
    nodes = components_of_type(components, "Node").select("n", F.col("cid").alias("bus_id"), (base * F.col("units.voltage")).alias("v_base_v"), (F.col("body.user_data.v_min") / base).alias("v_min_pu"), (F.col("body.user_data.v_max") / base).alias("v_max_pu"), base.alias("v_base"))
    return ordinal_ids(nodes, "bus_id")


def bus_setpoint(bus: DataFrame, components: DataFrame) -> DataFrame:
    """``v_set_pu`` where an infeeder is; of several, that of the last id."""
    feed = components_of_type(components, "Infeeder").groupBy("n", _node(0).alias("bus_id")).agg(F.max_by("body.v_setpoint", "cid").alias("_set"))
    return bus.join(feed, ["n", "bus_id"], "left").withColumn("v_set_pu", F.col("_set") / F.col("v_base")).drop("_set")


def load_table(components: DataFrame) -> DataFrame:
    loads = components_of_type(components, "Load").select("n", F.col("cid").alias("load_id"), _node(0).alias("bus_id"))
    return ordinal_ids(loads, "load_id")


def load_buses(load: DataFrame) -> DataFrame:
    return load.groupBy("n", "bus_id").agg(F.min("i").alias("first_i"))


def line_table(components: DataFrame) -> DataFrame:
    z = F.from_json("body.z", "array<double>")
    ohm = lambda a, k: F.get(a, F.lit(k)) * F.col("units.impedance") * F.col("body.length")
    z0 = F.col("body.z0")
    rating = F.coalesce(F.col("body.i_max") * F.col("units.current"), F.lit(LINE_RATING_A))
    return components_of_type(components, "Line").select("n", F.col("cid").alias("branch_id"), _node(0).alias("from_bus"), _node(1).alias("to_bus"), ohm(z, 0).alias("r_ohm"), ohm(z, 1).alias("x_ohm"), ohm(z0, 0).alias("r0_ohm"), ohm(z0, 1).alias("x0_ohm"), rating.alias("i_max_a"))


def transformer_table(components: DataFrame, bus: DataFrame) -> DataFrame:
    """Secondary impedance, secondary rating, and the per-unit turns ratio with its tap."""
    z = F.get(F.from_json("body.z", "array<array<double>>"), F.lit(1))
    ohm = lambda k: F.get(z, F.lit(k)) * F.col("units.impedance")
    tap = 1 + F.get("body.taps", F.lit(0)) * F.col("body.tap_factor")
    turns = F.get("body.nom_turns_ratio", F.lit(0)) * F.when(F.col("body.tap_side") == "primary", tap).otherwise(1 / tap)
    amps = F.coalesce(F.col("body.s_max") * F.col("units.power"), F.lit(TRANSFORMER_RATING_W)) / (F.get("body.v_winding_base", F.lit(1)) * F.col("units.voltage"))
    tx = components_of_type(components, "Transformer").select("n", F.col("cid").alias("branch_id"), _node(0).alias("from_bus"), _node(1).alias("to_bus"), ohm(0).alias("r_ohm"), ohm(1).alias("x_ohm"), F.lit(0.0).alias("r0_ohm"), F.lit(0.0).alias("x0_ohm"), amps.alias("i_max_a"), turns.alias("_turns"))
    base = bus.select("n", "bus_id", "v_base_v")
    tx = tx.join(base.withColumnsRenamed({"bus_id": "from_bus", "v_base_v": "_vf"}), ["n", "from_bus"]).join(base.withColumnsRenamed({"bus_id": "to_bus", "v_base_v": "_vt"}), ["n", "to_bus"])
    return tx.withColumn("tx_bus", F.col("to_bus")).withColumn("ratio_pu", F.col("_turns") * F.col("_vt") / F.col("_vf")).drop("_turns", "_vf", "_vt")


def transformer_buses(bus: DataFrame, transformers: DataFrame) -> DataFrame:
    tx = transformers.select("n", F.col("tx_bus").alias("bus_id"), F.lit(True).alias("_tx")).distinct()
    return bus.join(tx, ["n", "bus_id"], "left").withColumn("is_transformer", F.coalesce("_tx", F.lit(False))).drop("_tx")


def branch_table(lines: DataFrame, transformers: DataFrame) -> DataFrame:
    return lines.withColumn("kind", F.lit("line")).unionByName(transformers.withColumn("kind", F.lit("transformer")), allowMissingColumns=True)


def per_unit(branch: DataFrame, bus: DataFrame) -> DataFrame:
    """Per-unit impedance (z0 + 2 z) / 3 and rating, on the base of the bus that a branch goes to."""
    b = branch.join(bus.select("n", F.col("bus_id").alias("to_bus"), "v_base_v"), ["n", "to_bus"])
    b = b.withColumns({"z_base_ohm": F.col("v_base_v") ** 2 / BASE_VA, "i_base_a": BASE_VA / F.col("v_base_v")})
    pu = lambda z0, z: (F.col(z0) + 2 * F.col(z)) / 3 / F.col("z_base_ohm")
    return b.withColumns({"r_pu": pu("r0_ohm", "r_ohm"), "x_pu": pu("x0_ohm", "x_ohm"), "i_max_pu": F.col("i_max_a") / F.col("i_base_a")})


def split_lines_transformers(branch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return branch.where("ratio_pu is null"), branch.where("ratio_pu is not null")


def network_quality(components: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Failed rules as (n, rule, cid, detail): unequal vector groups, ends at unknown nodes, buses with several feeds, with none, and with no path to an infeeder.

    With the ``documents`` (n, doc) that the components come from, also those that do not parse, or in part only (``unreadable``).
    """
    ends = components.where("ctype <> 'Node'").select("n", "cid", "ctype", F.posexplode("body.cons").alias("k", "con")).select("n", "cid", "ctype", "k", F.col("con.node").alias("bus_id"))
    nodes = components_of_type(components, "Node").select("n", F.col("cid").alias("bus_id"))
    vector = components_of_type(components, "Transformer").where(~F.get("body.vector_group", F.lit(0)).eqNullSafe(F.get("body.vector_group", F.lit(1)))).select("n", F.lit("vector_group").alias("rule"), "cid", F.array_join("body.vector_group", "/").alias("detail"))
    dangling = ends.join(nodes, ["n", "bus_id"], "left_anti").select("n", F.lit("dangling_node").alias("rule"), "cid", F.col("bus_id").alias("detail"))
    feeds = ends.where("ctype in ('Line', 'Transformer') and k = 1").groupBy("n", "bus_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("n", F.lit("several_feeds").alias("rule"), F.col("bus_id").alias("cid"), F.col("c").cast("string").alias("detail"))
    fed = ends.where("(ctype in ('Line', 'Transformer') and k = 1) or ctype = 'Infeeder'").select("n", "bus_id").distinct()
    unfed = nodes.join(fed, ["n", "bus_id"], "left_anti").select("n", F.lit("not_fed").alias("rule"), F.col("bus_id").alias("cid"), F.lit("").alias("detail"))
    lost = no_path_to_infeeder(components).select("n", F.lit("no_path").alias("rule"), F.col("bus_id").alias("cid"), F.lit("").alias("detail"))
    found = vector.unionByName(dangling).unionByName(feeds).unionByName(unfed).unionByName(lost)
    return found if documents is None else found.unionByName(unreadable(documents))


def tables(components: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bus with setpoint and transformer flag, load, per-unit branch) of all networks, stored once."""
    components = stored(components, "components")
    bus = bus_setpoint(bus_table(components), components)
    tx = transformer_table(components, bus)
    bus = stored(transformer_buses(bus, tx), "bus")
    return bus, stored(load_table(components), "load"), stored(per_unit(branch_table(line_table(components), tx), bus), "branch")


def downstream_branches(branch: DataFrame) -> DataFrame:
    child = branch.select("n", F.col("from_bus").alias("to_bus"), F.col("branch_id").alias("child_branch_id"))
    return branch.select("n", "branch_id", "to_bus").join(child, ["n", "to_bus"]).select("n", "branch_id", "child_branch_id")


def tree_closure(branch: DataFrame) -> DataFrame:
    """(n, branch_id, bus_id, depth): each bus below each branch; depth 0 is the branch's own end.

    Paths double in length each round, so a tree of depth d takes about log2(d) joins. A path as long
    as its network has branches means a cycle, which is an error (``network_quality`` lists its buses).
    """
    paths = stored(branch.select("n", F.col("to_bus").alias("bus_id"), "branch_id", F.lit(0).alias("depth"), F.col("from_bus").alias("up")), "paths")
    most = paths.groupBy("n").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).head()[0] or 0
    jump, step = paths.select("n", "bus_id", "up"), 1
    while True:
        hop = jump.select("n", F.col("bus_id").alias("b"), F.col("up").alias("mid"))
        far = paths.select("n", F.col("bus_id").alias("mid"), "branch_id", "depth", "up")
        more = stored(hop.join(far, ["n", "mid"]).select("n", F.col("b").alias("bus_id"), "branch_id", (F.col("depth") + step).alias("depth"), "up"), "paths")
        if more.isEmpty():
            return paths.select("n", "branch_id", "bus_id", "depth")
        if step >= most:
            raise ValueError(f"networks with a cycle, or several feeds of a bus: {[r.n for r in more.select('n').distinct().orderBy('n').limit(10).collect()]}")
        paths = paths.unionByName(more)
        step *= 2
        jump = paths.where(F.col("depth") == step - 1).select("n", "bus_id", "up")


def tree_labels(branch: DataFrame) -> DataFrame:
    """Each branch's place in its tree: (n, branch_id, bus_id, from_bus, root, depth, enter, leave, rho, path_r, tx), linear in branches.

    ``bus_id`` is the branch's end, ``root`` the bus that no branch leads to at the top of its path. A network's branches
    are numbered in preorder, trees one after the other: those below a branch, and itself, have ``enter``
    in [enter, leave). ``rho`` is the product of squared ratios along the path, ``path_r`` the sum of resistances, both with the
    branch's own; ``tx`` is the nearest transformer at or above. Pointers to the branch above double in length each round, so a tree of depth d takes
    about log2(d) joins of one row a branch, both sides sorted: a row a branch is never sent to the driver to be broadcast. A cycle, or a bus that several branches lead to, is an error.
    """
    r2 = F.coalesce(F.col("ratio_pu") if "ratio_pu" in branch.columns else F.lit(None).cast("double"), F.lit(1.0)) ** 2
    r_pu = F.col("r_pu") if "r_pu" in branch.columns else F.lit(0.0)
    tx = F.when(F.col("ratio_pu").isNotNull(), F.col("branch_id")) if "ratio_pu" in branch.columns else F.lit(None).cast("string")
    own = branch.select("n", "branch_id", F.col("to_bus").alias("bus_id"), "from_bus", r2.alias("rho"), r_pu.alias("path_r"), tx.alias("tx"))
    above = branch.select("n", F.col("to_bus").alias("from_bus"), F.lit(True).alias("fed"))
    at = own.join(above.distinct().hint("merge"), ["n", "from_bus"], "left").select("*", F.when(F.col("fed"), F.col("from_bus")).alias("up"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("depth")).withColumn("root", F.when(F.col("up").isNull(), F.col("from_bus"))).drop("fed")
    at = stored(at, "labels")
    shape = at.groupBy("n").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("bus_id").alias("ends"))
    most, several = shape.agg(F.max("m"), F.max(F.when(F.col("m") > F.col("ends"), F.struct("n")))).head()  # one row
    if several is not None:
        raise ValueError(f"several branches lead to one bus in network {several[0]}")
    ends, length = at, 1
    # pointers reach 1, 2, 4 ... branches up; sizes count what lies below within that reach
    while not at.where("up is not null").isEmpty():
        if length > most:
            raise ValueError(f"networks with a cycle: {[r.n for r in at.where('up is not null').select('n').distinct().orderBy('n').limit(10).collect()]}")
        far = at.select("n", F.col("bus_id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("rho").alias("_rho"), F.col("path_r").alias("_path_r"), F.col("tx").alias("_tx"))
        below = at.where("up is not null").groupBy("n", F.col("up").alias("bus_id")).agg(F.sum("size").alias("_size"))
        # up, depth, rho and path_r of the path to the pointer, exclusive of its end, joined with the end's own
        jumped = at.join(far.hint("merge"), ["n", "up"], "left").join(below.hint("merge"), ["n", "bus_id"], "left")
        own_or = lambda c, x: F.when(F.col("up").isNull(), F.col(c)).otherwise(x).alias(c)
        spent, at = at, stored(jumped.select("n", "branch_id", "bus_id", "from_bus", own_or("rho", F.col("rho") * F.col("_rho")), own_or("path_r", F.col("path_r") + F.col("_path_r")), F.coalesce("tx", "_tx").alias("tx"), F.col("_up").alias("up"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"), own_or("depth", F.col("depth") + F.col("_depth") + 1), F.coalesce("root", "_root").alias("root")), "labels")
        if spent is not ends:
            discard(spent)
        length *= 2
    # a branch enters after the one above it and all that its earlier siblings hold
    first = Window.partitionBy("n", "_top", "_over").orderBy("from_bus", "branch_id").rowsBetween(Window.unboundedPreceding, -1)
    kin = ends.select("n", "bus_id", F.col("up").alias("_above")).join(at.drop("up").hint("merge"), ["n", "bus_id"])
    kin = kin.withColumns({"_top": F.col("_above").isNull(), "_over": F.col("_above")})
    place = kin.withColumn("enter", F.coalesce(F.sum("size").over(first), F.lit(0)) + F.when(F.col("_top"), 0).otherwise(1)).drop("_top", "_over").withColumnRenamed("_above", "up")
    place = stored(place, "labels")
    discard(*{id(x): x for x in (ends, at)}.values())
    while not place.where("up is not null").isEmpty():
        far = place.select("n", F.col("bus_id").alias("up"), F.col("up").alias("_up"), F.col("enter").alias("_enter"))
        spent, place = place, stored(place.join(far.hint("merge"), ["n", "up"], "left").withColumns({"enter": F.col("enter") + F.coalesce("_enter", F.lit(0)), "up": F.col("_up")}).drop("_up", "_enter").select(*place.columns), "labels")
        discard(spent)
    return place.select("n", "branch_id", "bus_id", "from_bus", "root", "depth", "enter", (F.col("enter") + F.col("size")).alias("leave"), "rho", "path_r", "tx")


def transformer_loads(tree: DataFrame, branch: DataFrame, load: DataFrame) -> DataFrame:
    """(n, load_id, tx_id, i_base_a): each load with all transformers on its path, whose loads include those of transformers below."""
    near = tree.select("n", "bus_id", F.col("tx").alias("near"))
    tx = branch.where("ratio_pu is not null").select("n", "branch_id", "from_bus", "i_base_a")
    above = tx.join(near.withColumnsRenamed({"bus_id": "from_bus", "near": "over"}), ["n", "from_bus"], "left")
    # transformers alone are closed: few, and few deep
    nested = tree_closure(above.select("n", "branch_id", F.coalesce("over", F.concat(F.lit("above "), "branch_id")).alias("from_bus"), F.col("branch_id").alias("to_bus")))
    every = nested.select("n", F.col("branch_id").alias("tx_id"), F.col("bus_id").alias("near")).join(tx.select("n", F.col("branch_id").alias("tx_id"), "i_base_a"), ["n", "tx_id"])
    return load.select("n", "load_id", "bus_id").join(near.where("near is not null"), ["n", "bus_id"]).join(every, ["n", "near"]).select("n", "load_id", "tx_id", "i_base_a")


def no_path_to_infeeder(components: DataFrame) -> DataFrame:
    """(n, bus_id): buses that a branch feeds, but over no path from an infeeder: below an unfed bus, or on or below a cycle.

    Every bus points to the bus above it (of several, the first by id), an infeeder's to itself; pointers double in
    length each round until each ends at an infeeder or is as long as the network has buses.
    """
    ends = components.where("ctype in ('Line', 'Transformer')").select("n", _node(0).alias("up"), _node(1).alias("bus_id")).where("up is not null and bus_id is not null")
    feeds = components_of_type(components, "Infeeder").select("n", _node(0).alias("bus_id")).distinct().withColumn("fed", F.lit(True))
    at = ends.groupBy("n", "bus_id").agg(F.min("up").alias("up")).join(feeds, ["n", "bus_id"], "left_anti")
    at = stored(at.join(feeds.withColumnRenamed("bus_id", "up"), ["n", "up"], "left").select("n", "bus_id", "up", F.coalesce("fed", F.lit(False)).alias("fed")), "pointers")
    most, step = at.groupBy("n").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).head()[0] or 0, 1
    while step <= most and not at.where("not fed").isEmpty():
        above = at.select("n", F.col("bus_id").alias("up"), F.col("up").alias("_up"), F.col("fed").alias("_fed"))
        jumped = at.join(above, ["n", "up"], "left").select("n", "bus_id", F.when(F.col("fed"), F.col("up")).otherwise(F.coalesce("_up", "up")).alias("up"), (F.col("fed") | F.coalesce("_fed", F.lit(False))).alias("fed"))
        at, step = stored(jumped, "pointers"), 2 * step
    return at.where("not fed").select("n", "bus_id")
