"""DuckDB SQL that the registered queries must agree with, written from the tables, not from the operators."""

from __future__ import annotations

from feederflow.plans.queries import SNAPSHOT, TX

BASE = """
c AS (SELECT n_regionkey AS n, c_nationkey AS nation, c_custkey AS cust, c_acctbal AS bal,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS nn
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
line AS (SELECT c.n, 'L' || c.cust AS branch_id, CASE WHEN c.k = 1 THEN 'N' || c.nation ELSE 'C' || p.cust END AS from_bus,
        'C' || c.cust AS to_bus, 1.2::DOUBLE / c.nn * (1 + c.cust % 7) AS r, c.cust
      FROM c LEFT JOIN c p ON p.nation = c.nation AND c.k > 1 AND p.k = floor((c.k - 2) / 3) + 1),
tx AS (SELECT n_regionkey AS n, 'T' || n_nationkey AS branch_id, 'R' || n_regionkey AS from_bus, 'N' || n_nationkey AS to_bus, n_nationkey AS nation FROM nation),
branch AS (SELECT n, branch_id, from_bus, to_bus, r AS r_pu, 0.4 * r AS x_pu, CASE WHEN cust % 5 = 0 THEN 0.04 ELSE 100.0 END AS i_max_pu, 'line' AS kind FROM line
      UNION ALL SELECT n, branch_id, from_bus, to_bus, 0.002, 0.0008, 0.3, 'transformer' FROM tx),
bus AS (SELECT n, 'C' || cust AS bus_id FROM c UNION ALL SELECT n, to_bus FROM tx UNION ALL SELECT r_regionkey, 'R' || r_regionkey FROM region),
load AS (SELECT n, 'D' || cust AS load_id, 'C' || cust AS bus_id, cust, bal, row_number() OVER (PARTITION BY n ORDER BY 'D' || cust) - 1 AS i FROM c),
o AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1),
tier AS (SELECT 'D' || o_custkey AS load_id, l_quantity AS kw, l_discount AS price, l_linenumber % 2 AS odd,
        row_number() OVER (PARTITION BY o_custkey, l_linenumber % 2 ORDER BY l_linenumber, l_quantity, l_discount) - 1 AS tier
      FROM o JOIN lineitem ON l_orderkey = o_orderkey),
offer AS (SELECT load_id, coalesce(max(kw) FILTER (WHERE odd = 1 AND tier = 0), 0) AS inj_kw, coalesce(max(price) FILTER (WHERE odd = 1 AND tier = 0), 0) AS inj_price,
        coalesce(max(kw) FILTER (WHERE odd = 0 AND tier = 0), 0) AS con_kw, coalesce(max(price) FILTER (WHERE odd = 0 AND tier = 0), 0) AS con_price,
        count(*) FILTER (WHERE odd = 1) AS n_inj FROM tier GROUP BY 1),
reading AS (SELECT event_id, user_id, ts AS t, 'D' || user_id AS load_id, CASE WHEN event_type = 'purchase' THEN -value ELSE value END * 1000 AS p FROM events),
ambient AS (SELECT date_trunc('hour', ts) AS t, avg(value) / 10 AS theta_a FROM events GROUP BY 1),
current AS (SELECT 'T' || c_nationkey AS tx_id, date_trunc('hour', ts) AS t, sum(value) AS current_a FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2),
series AS (SELECT date_trunc('hour', t) AS t, sum(p) / 1000 - 60 AS total_kw FROM reading GROUP BY 1),
price AS (SELECT 'D' || o_custkey AS load_id, o_orderkey % 10 / 100.0 AS export_price_kwh FROM o),
daily AS (SELECT n, r.load_id, bus_id, date_trunc('day', t) AS t, sum(p) AS p FROM reading r JOIN load USING (load_id) GROUP BY 1, 2, 3, 4),
envd AS (SELECT n, t, load_id, -abs(p) / 1000 AS lb, abs(p) / 500 AS ub FROM daily),
dispd AS (SELECT n, t, load_id, greatest(p / 1e4, 0) AS inj, greatest(-p / 1e4, 0) AS con FROM daily),
air AS (SELECT n, date_trunc('hour', t) AS t, avg(value) / 10 AS theta_a FROM (SELECT 'D' || user_id AS load_id, ts AS t, value FROM events) JOIN load USING (load_id) GROUP BY 1, 2),
disp AS (SELECT 'D' || c_custkey AS load_id, greatest(c_acctbal / 1000, 0) AS inj, greatest(-c_acctbal / 1000, 0) AS con FROM customer),
env AS (SELECT n, load_id, -abs(bal) / 1000 AS lb, abs(bal) / 500 AS ub FROM load),
wide AS (SELECT 'D' || user_id AS "Nmi", CASE event_type WHEN 'view' THEN 'E1' ELSE 'B1' END AS suffix, ts::DATE AS "IntervalDay", hour(ts) AS h, round(sum(value), 6) AS energy FROM events GROUP BY 1, 2, 3, 4),
meter AS (SELECT * FROM wide WHERE suffix = 'E1'),
closure AS (SELECT n, branch_id, to_bus AS bus_id, 0 AS depth FROM branch
      UNION ALL SELECT u.n, u.branch_id, b.to_bus, u.depth + 1 FROM closure u JOIN branch b ON b.n = u.n AND b.from_bus = u.bus_id)
"""


def sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE, *more]) + "\n" + select


K2 = f"power(current_a / {TX['I_rated']}, 2)"
TO_U = f"{TX['delta_theta_TO_R']} * power(({K2} * {TX['R']} + 1) / ({TX['R']} + 1), {TX['n']})"
HS_U = f"{TX['delta_theta_HS_R']} * power({K2}, {TX['m']})"
D1, D2 = f"exp(-{TX['dt']} / {TX['tau_TO']})", f"exp(-{TX['dt']} / {TX['tau_W']})"
STEPS = (
    f"rise AS (SELECT tx_id, t, {TO_U} AS u1, {HS_U} AS u2, row_number() OVER (PARTITION BY tx_id ORDER BY t) AS k FROM current)",
    f"temp AS (SELECT tx_id, t, k, u1 * (1 - {D1}) AS x1, u2 * (1 - {D2}) AS x2 FROM rise WHERE k = 1 UNION ALL SELECT r.tx_id, r.t, r.k, (u1 - x1) * (1 - {D1}) + x1, (u2 - x2) * (1 - {D2}) + x2 FROM temp p JOIN rise r ON r.tx_id = p.tx_id AND r.k = p.k + 1)",
)
HOT = "hot AS (SELECT tx_id, t, x1, x2, theta_a + x1 + x2 AS theta FROM temp JOIN ambient USING (t))"


#: Passes of the unrolled sweep: the last ones change nothing that is printed.
PASSES = 20


def passes(nodal: str, pre: str = "", n: int = PASSES) -> list[str]:
    """The sweep unrolled for every case ``k`` of ``nodal`` (k, n, bus_id, p, q): flows with losses, currents, voltages."""
    w, v = pre + "w", pre + "v"
    out = [
        f"{pre}f0 AS MATERIALIZED (SELECT k, u.n, branch_id, sum(p) AS p0, sum(q) AS q0 FROM closure u JOIN {nodal} USING (n, bus_id) GROUP BY 1, 2, 3)",
        f"{w}0 AS (SELECT k, n, branch_id, p0 AS p, q0 AS q, 0.0::DOUBLE AS l FROM {pre}f0)",
        f"{v}0 AS (SELECT DISTINCT k, n, bus_id, 1.0::DOUBLE AS v FROM (SELECT DISTINCT k, n FROM {pre}f0) JOIN bus USING (n))",
    ]
    for j in range(1, n + 1):
        i = f"{pre}i{j}"
        out += [
            f"{i} AS MATERIALIZED (SELECT w.k, w.n, w.branch_id, b.to_bus, b.r_pu, b.x_pu, CASE WHEN v.v > 0 THEN (p * p + q * q) / v.v ELSE 'nan'::DOUBLE END AS l FROM {w}{j - 1} w JOIN branch b USING (n, branch_id) JOIN {v}{j - 1} v ON v.k = w.k AND v.n = b.n AND v.bus_id = b.from_bus)",
            f"{w}{j} AS MATERIALIZED (SELECT k, n, branch_id, p0 + dp AS p, q0 + dq AS q, l FROM {pre}f0 JOIN (SELECT k, u.n, u.branch_id, sum(r_pu * l) AS dp, sum(x_pu * l) AS dq FROM closure u JOIN {i} i ON i.n = u.n AND i.to_bus = u.bus_id GROUP BY 1, 2, 3) USING (k, n, branch_id) JOIN (SELECT k, n, branch_id, l FROM {i}) USING (k, n, branch_id))",
            f"{v}{j} AS MATERIALIZED (SELECT k, u.n, u.bus_id, 1 - sum(2 * (r_pu * p + x_pu * q) - (r_pu * r_pu + x_pu * x_pu) * l) AS v FROM closure u JOIN {w}{j} USING (n, branch_id) JOIN branch b USING (n, branch_id) GROUP BY 1, 2, 3 UNION ALL SELECT k, n, bus_id, 1.0 FROM {v}0 WHERE bus_id LIKE 'R%')",
        ]
    return out


def broken(pre: str, name: str, limits: str | None = None) -> str:
    """Cases (k, n) with a voltage or current beyond its limit, or none at all; not a number is above everything."""
    over = "" if limits is None else f" UNION SELECT w.k, w.n FROM {pre}w{PASSES} w JOIN {limits} USING (n, branch_id) WHERE w.l > most * most"
    return f"{name} AS MATERIALIZED (SELECT k, n FROM {pre}v{PASSES} WHERE NOT v BETWEEN 0.94 * 0.94 AND 1.06 * 1.06 UNION SELECT w.k, w.n FROM {pre}w{PASSES} w JOIN branch USING (n, branch_id) WHERE l > i_max_pu * i_max_pu{over})"


def filled(total: str) -> str:
    return f"CASE WHEN group_kw > 0 THEN greatest(0, least({total} - before, group_kw)) * size_kw / group_kw ELSE 0 END"


def search(pre: str, segment: str, given: str, rounds: int = 3, limits: str | None = None) -> list[str]:
    """{pre}best (n, load_id, oe, kw, ok): 16 steps of the cell left, ``rounds`` times, from segments (n, oe, load_id, bus_id, size_kw, group_kw, before).

    ``given`` has what stays at each bus (n, bus_id, p, q).
    """
    out = [f"{pre}s0 AS (SELECT n, oe, 0.0::DOUBLE AS lo, sum(size_kw)::DOUBLE AS hi, true AS ok FROM {segment} GROUP BY 1, 2)"]
    for r in range(1, rounds + 1):
        here = f"{pre}{r}"
        out += [
            f"{here}t AS MATERIALIZED (SELECT n, oe, c, oe || c AS k, lo + (hi - lo) * c / 16 AS total FROM {pre}s{r - 1}, range(17) g(c))",
            f"{here}m AS MATERIALIZED (SELECT k, n, bus_id, sum(p) AS p, sum(q) AS q FROM (SELECT k, n, bus_id, p, q FROM {given} JOIN {here}t USING (n) UNION ALL SELECT k, n, bus_id, CASE oe WHEN 'oel' THEN 1 ELSE -1 END * ({filled('total')}) / 1000, 0.0 FROM {segment} JOIN {here}t USING (n, oe)) GROUP BY 1, 2, 3)",
            *passes(f"{here}m", here),
            broken(here, f"{here}bad", limits),
            f"{here}stop AS (SELECT n, oe, coalesce(min(c) FILTER (WHERE (k, n) IN (SELECT (k, n) FROM {here}bad)), 17) - 1 AS last FROM {here}t GROUP BY 1, 2)",
            f"{pre}s{r} AS MATERIALIZED (SELECT n, oe, lo + (hi - lo) / 16 * greatest(last, 0) AS lo, least(hi, lo + (hi - lo) / 16 * (greatest(last, 0) + 1)) AS hi, ok AND last >= 0 AS ok FROM {pre}s{r - 1} JOIN {here}stop USING (n, oe))",
        ]
    out.append(f"{pre}best AS (SELECT n, load_id, oe, sum({filled('lo')}) AS kw, bool_and(ok) AS ok FROM {segment} JOIN {pre}s{rounds} USING (n, oe) GROUP BY 1, 2, 3)")
    out.append(f"{pre}env AS (SELECT n, load_id, -sum(kw) FILTER (WHERE oe = 'oel') AS lb, sum(kw) FILTER (WHERE oe = 'oer') AS ub, bool_and(ok) AS ok FROM {pre}best GROUP BY 1, 2)")
    return out


SIDES = "(VALUES ('oel'), ('oer')) a(oe)"
ENVELOPE = "SELECT n, load_id, round(lb, 6) AS lb_kw, round(ub, 6) AS ub_kw, ok AS feasible FROM {}env"
SMALL = "small AS (SELECT n, bus_id, 0.0::DOUBLE AS p, 0.04 * bal / 1e6 AS q FROM load)"
UNIFORM = f"seg AS (SELECT n, oe, load_id, bus_id, 50.0::DOUBLE AS size_kw, count(*) OVER (PARTITION BY n, oe) * 50.0::DOUBLE AS group_kw, 0.0::DOUBLE AS before FROM load, {SIDES})"
PATH = "path AS (SELECT u.n, bus_id, greatest(round(sum(r_pu), 12), 1e-12) AS s FROM closure u JOIN branch USING (n, branch_id) GROUP BY 1, 2)"


def ordered(name: str, source: str) -> str:
    """Segments (n, oe, tier, less, bus_id, load_id, size_kw) with their groups, in order."""
    return f"{name} AS MATERIALIZED (SELECT r.n, r.oe, load_id, r.bus_id, size_kw, group_kw, before FROM {source} r JOIN (SELECT *, coalesce(sum(group_kw) OVER (PARTITION BY n, oe ORDER BY tier, less, bus_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT n, oe, tier, less, bus_id, sum(size_kw) AS group_kw FROM {source} GROUP BY ALL)) g ON g.n = r.n AND g.oe = r.oe AND g.tier = r.tier AND g.less = r.less AND g.bus_id = r.bus_id)"


NEAREST = (PATH, f"rank AS (SELECT n, oe, 0 AS tier, -(CASE oe WHEN 'oer' THEN coalesce(export_price_kwh, 0) ELSE 0 END * (5 / 60) + 0.001) / s AS less, bus_id, load_id, 50.0::DOUBLE AS size_kw FROM load JOIN path USING (n, bus_id) LEFT JOIN price USING (load_id), {SIDES})", ordered("seg", "rank"))


def allowed(state: str) -> tuple[str, str]:
    """Bisections of the squared load factor between 0 and what the winding alone allows, from (tx_id, t, theta_a, x1, x2)."""
    up = lambda k2: f"{TX['delta_theta_TO_R']} * power(({k2} * {TX['R']} + 1) / ({TX['R']} + 1), {TX['n']})"
    mid = "((lo + hi) / 2)"
    hot = f"theta_a + ({up(mid)} - x1) * (1 - {D1}) + x1 + ({TX['delta_theta_HS_R']} * power({mid}, {TX['m']}) - x2) * (1 - {D2}) + x2 <= {TX['theta_HS_max']}"
    left = f"({TX['theta_HS_max']} - theta_a - x1 * {D1} - x2 * {D2})"
    return (
        f"half AS (SELECT tx_id, t, theta_a, x1, x2, 0 AS i, 0.0::DOUBLE AS lo, CASE WHEN {left} > 0 THEN power({left} / ({TX['delta_theta_HS_R']} * (1 - {D2})), 1 / {TX['m']}) ELSE 0 END::DOUBLE AS hi FROM {state} UNION ALL SELECT tx_id, t, theta_a, x1, x2, i + 1, CASE WHEN {hot} THEN {mid} ELSE lo END, CASE WHEN {hot} THEN hi ELSE {mid} END FROM half WHERE i < 50)",
        "allowed AS (SELECT tx_id, t, lo AS k2_max FROM half WHERE i = 50)",
    )


def lcg(x: str, seed: int) -> str:
    s = f"(({x}) + {seed}) % 2147483648"
    for _ in range(3):
        s = f"(({s}) * 1103515245 + 12345) % 2147483648"
    return f"(({s}) + 0.5) / 2147483648"


def normal(x: str, seed: int) -> str:
    return f"sqrt(-2 * ln({lcg(x, seed)})) * cos(2 * pi() * {lcg(x, seed + 7919)})"


def profile(name: str, seed: int, total: str, where: str) -> tuple[str, str, str]:
    minute = "floor(epoch(t) / 60)::BIGINT"
    size, noise = normal("idx * 1009", seed), normal(f"(idx * 65537 + {minute} * 31) % 2147483648", seed + 1)
    return (
        f"{name}_w AS (SELECT idx, load_id, t, total_kw, 1 + 0.15 * {noise} AS noise, exp(0.4 * {size}) * (1 + 0.15 * {noise}) AS weight FROM roster, series WHERE {where})",
        f"{name}_s AS (SELECT *, greatest(avg(weight) OVER (PARTITION BY load_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 1e-6) AS w FROM {name}_w)",
        f"{name} AS (SELECT load_id, t, total_kw, CASE WHEN {total} > 0 THEN w / sum(w) OVER (PARTITION BY t) * {total} ELSE 0 END AS kw FROM {name}_s)",
    )


ROSTER = "roster AS (SELECT idx, printf('NMI_%03d', idx + 1) AS load_id, CASE WHEN idx < round_even(nn * 0.33, 0) THEN 'bus_a' WHEN idx < 2 * round_even(nn * 0.33, 0) THEN 'bus_b' ELSE 'bus_c' END AS bus_id, idx < round_even(nn * 0.3, 0) AS is_solar FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, count(*) OVER () AS nn FROM customer))"
NET = (ROSTER, *profile("pb", 42, "greatest(total_kw, 0)", "true"), *profile("ps", 142, "greatest(-total_kw, 0)", "is_solar"), "net AS (SELECT load_id, t, pb.kw - coalesce(ps.kw, 0) AS net_kw FROM pb LEFT JOIN ps USING (load_id, t))")
CASES = f"nodal AS (SELECT oe AS k, n, bus_id, bal / 1e6 AS p, 0.4 * bal / 1e6 AS q FROM load, {SIDES})"
FLOW = [CASES, *passes("nodal")]
OUT = f"flow AS (SELECT w.k AS oe, w.n, w.branch_id, b.to_bus AS bus_id, p, q, l, v, i_max_pu FROM w{PASSES} w JOIN branch b USING (n, branch_id) JOIN v{PASSES} v ON v.k = w.k AND v.n = b.n AND v.bus_id = b.to_bus)"
SLACK = "slack AS (SELECT n, date_trunc('day', t) AS t, load_id AS bus_id, p > 0 AS load, p / 1000 AS kw FROM reading JOIN load USING (load_id))"
SHED = [PATH, "worst AS (SELECT n, max_by(bus_id, (s, bus_id)) AS bus_id FROM load JOIN path USING (n, bus_id) GROUP BY 1)", "given AS (SELECT n, bus_id, bal / 1e6 AS p, 0.4 * bal / 1e6 AS q FROM load)", "s0 AS (SELECT n, 0.0::DOUBLE AS lo, sum(abs(p)) AS hi, true AS ok FROM given GROUP BY 1)"]
for _r in range(1, 4):
    SHED += [
        f"t{_r} AS MATERIALIZED (SELECT n, c, c AS k, lo + (hi - lo) * c / 16 AS kw FROM s{_r - 1}, range(17) g(c))",
        f"m{_r} AS MATERIALIZED (SELECT k, n, bus_id, sum(p) AS p, sum(q) AS q FROM (SELECT k, n, bus_id, p, q FROM given JOIN t{_r} USING (n) UNION ALL SELECT k, n, bus_id, -kw, 0.0 FROM worst JOIN t{_r} USING (n)) GROUP BY 1, 2, 3)",
        *passes(f"m{_r}", f"r{_r}"),
        broken(f"r{_r}", f"bad{_r}"),
        f"good{_r} AS (SELECT n, min(c) AS c FROM t{_r} WHERE (k, n) NOT IN (SELECT (k, n) FROM bad{_r}) GROUP BY 1)",
        f"s{_r} AS MATERIALIZED (SELECT n, lo + (hi - lo) / 16 * greatest(coalesce(c, 16) - 1, 0) AS lo, lo + (hi - lo) / 16 * coalesce(c, 16) AS hi, ok AND c IS NOT NULL AS ok FROM s{_r - 1} LEFT JOIN good{_r} USING (n))",
    ]


def reserved() -> str:
    """Two searches: the dispatch that the first leaves moves what the second has to hold."""
    def parts(name: str, settled: str) -> tuple[str, ...]:
        side = lambda c, a, b: f"CASE oe WHEN 'oer' THEN {a} ELSE {b} END AS {c}"
        need = f"{name}n AS (SELECT n, oe, bus_id, load_id, s, {side('want', '5 + d', '5 - d')}, {side('bid', 'con_kw + least(d, 0)', 'inj_kw - greatest(d, 0)')}, {side('price', 'con_price', 'inj_price')} FROM load JOIN offer USING (load_id) JOIN path USING (n, bus_id) JOIN {settled} USING (n, load_id), {SIDES})"
        held = f"{name}h AS (SELECT *, greatest(0, least(50, want))::DOUBLE AS held, least(greatest(0, least(50, want)), greatest(0, bid))::DOUBLE AS free FROM {name}n)"
        less = "-(price * (5 / 60) / s)"
        rank = f"{name}r AS (SELECT n, oe, 0 AS tier, {less} AS less, bus_id, load_id, held - free AS size_kw FROM {name}h UNION ALL SELECT n, oe, 1, {less}, bus_id, load_id, free FROM {name}h UNION ALL SELECT n, oe, 2, -(0.001 / s), bus_id, load_id, 50.0 - held FROM {name}h)"
        return need, held, rank, ordered(f"{name}seg", f"{name}r")

    got = lambda pre, name: f"{name} AS (SELECT e.*, inj_kw, inj_price, con_kw, con_price, greatest(-con_kw, least(inj_kw, greatest(lb + 5, least(0, ub - 5)))) AS got FROM {pre}env e JOIN offer USING (load_id))"
    given = "stay AS (SELECT n, bus_id, CASE WHEN load_id IN (SELECT load_id FROM offer) THEN 0 ELSE 0.1 * bal / 1e6 END::DOUBLE AS p, 0.04 * bal / 1e6 AS q FROM load)"
    zero = "zero AS (SELECT n, load_id, 0.0::DOUBLE AS d FROM load)"
    settled = "settled AS (SELECT n, load_id, round(got, 9) AS d FROM g1)"
    select = "SELECT n, load_id, round(lb, 6) AS lb_kw, round(ub, 6) AS ub_kw, ok AS feasible, round(got, 6) AS dispatch_kw, round(abs(got) * CASE WHEN got >= 0 THEN inj_price ELSE con_price END * 5 / 60, 6) AS payment_dlr, round(greatest(0, lb + 5 - got) + greatest(0, got - (ub - 5)), 6) AS shortfall_kw FROM g2"
    return sql(select, PATH, given, zero, *parts("a", "zero"), *search("a", "aseg", "stay"), got("a", "g1"), settled, *parts("b", "settled"), *search("b", "bseg", "stay"), got("b", "g2"))


#: Networks with two infeeders, ratios and taps: a path's voltage is that of its own root, divided by its squared ratios.
RICH = (
    """rbranch AS (SELECT b.n, branch_id, CASE WHEN kind = 'transformer' AND nation % 2 = 1 THEN 'S' || b.n ELSE from_bus END AS from_bus, to_bus, r_pu, x_pu, kind,
      CASE WHEN kind = 'line' THEN 1 ELSE CASE WHEN nation % 4 = 0 THEN 1.02 ELSE 1 END * CASE WHEN nation % 2 = 0 THEN tap ELSE 1 / tap END END::DOUBLE AS ratio
      FROM (SELECT branch.*, nation, 1 + 0.025 * CASE nation % 3 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 0 END AS tap FROM branch LEFT JOIN tx USING (n, branch_id)) b)""",
    "rtop AS (SELECT n, to_bus AS bus_id, from_bus AS root, CASE WHEN from_bus LIKE 'S%' THEN 1.03 ELSE 1 END::DOUBLE AS set, ratio * ratio AS rho, 1.0::DOUBLE AS rho_from, branch_id, 0 AS depth, r_pu AS path_r, branch_id AS tx FROM rbranch WHERE from_bus LIKE 'R%' OR from_bus LIKE 'S%' UNION ALL SELECT b.n, b.to_bus, root, set, rho * ratio * ratio, rho, b.branch_id, depth + 1, path_r + b.r_pu, tx FROM rtop JOIN rbranch b ON b.n = rtop.n AND b.from_bus = rtop.bus_id)",
    f"rnodal AS MATERIALIZED (SELECT oe AS k, n, bus_id, bal / 1e6 AS p, 0.4 * bal / 1e6 AS q FROM load, {SIDES})",
    "rf0 AS MATERIALIZED (SELECT k, u.n, branch_id, sum(p) AS p0, sum(q) AS q0 FROM closure u JOIN rnodal USING (n, bus_id) GROUP BY 1, 2, 3)",
)


def rich_passes(n: int = PASSES) -> list[str]:
    """The sweep unrolled for the rich networks, whose branches are those of the others."""
    out = ["rw0 AS (SELECT k, n, branch_id, p0 AS p, q0 AS q, 0.0::DOUBLE AS l FROM rf0)", "rv0 AS (SELECT DISTINCT k, n, bus_id, 1.0::DOUBLE AS v FROM (SELECT DISTINCT k, n FROM rf0) JOIN rtop USING (n))"]
    for j in range(1, n + 1):
        out += [
            f"ri{j} AS MATERIALIZED (SELECT w.k, w.n, w.branch_id, b.to_bus, r_pu, x_pu, (p * p + q * q) / coalesce(v, set * set) AS l FROM rw{j - 1} w JOIN rbranch b USING (n, branch_id) JOIN rtop t USING (n, branch_id) LEFT JOIN rv{j - 1} v ON v.k = w.k AND v.n = b.n AND v.bus_id = b.from_bus)",
            f"rw{j} AS MATERIALIZED (SELECT k, n, branch_id, p0 + dp AS p, q0 + dq AS q, l FROM rf0 JOIN (SELECT k, u.n, u.branch_id, sum(r_pu * l) AS dp, sum(x_pu * l) AS dq FROM closure u JOIN ri{j} i ON i.n = u.n AND i.to_bus = u.bus_id GROUP BY 1, 2, 3) USING (k, n, branch_id) JOIN (SELECT k, n, branch_id, l FROM ri{j}) USING (k, n, branch_id))",
            f"rv{j} AS MATERIALIZED (SELECT k, u.n, u.bus_id, (any_value(e.set) * any_value(e.set) - sum(t.rho_from * (2 * (r_pu * p + x_pu * q) - (r_pu * r_pu + x_pu * x_pu) * l))) / any_value(e.rho) AS v FROM closure u JOIN rw{j} USING (n, branch_id) JOIN rbranch b USING (n, branch_id) JOIN rtop t USING (n, branch_id) JOIN rtop e ON e.n = u.n AND e.bus_id = u.bus_id GROUP BY 1, 2, 3)",
        ]
    return out


RICH_FLOW = sql(f"SELECT w.n, w.k AS oe, w.branch_id, round(p, 6) AS p_pu, round(q, 6) AS q_pu, round(l, 6) AS l_pu, round(v, 6) AS v2_pu, true AS converged FROM rw{PASSES} w JOIN rbranch b USING (n, branch_id) JOIN rv{PASSES} v ON v.k = w.k AND v.n = b.n AND v.bus_id = b.to_bus", *RICH, *rich_passes())

_ORACLES: dict[str, str] = {
    "rich_transformers": sql("SELECT n, branch_id, from_bus, to_bus, round(ratio, 6) AS ratio_pu FROM rbranch WHERE kind = 'transformer'", RICH[0]),
    "rich_labels": sql("SELECT n, branch_id, bus_id, root, depth, round(rho, 9) AS rho, round(path_r, 9) AS path_r, tx, size FROM rtop JOIN (SELECT n, branch_id, count(*) AS size FROM closure GROUP BY 1, 2) USING (n, branch_id)", *RICH[:2]),
    "rich_path_voltage": sql("SELECT u.n, k AS oe, u.bus_id, round((any_value(e.set) * any_value(e.set) - sum(t.rho_from * 2 * (r_pu * p0 + x_pu * q0))) / any_value(e.rho), 6) AS v2_pu FROM closure u JOIN rf0 USING (n, branch_id) JOIN rbranch b USING (n, branch_id) JOIN rtop t USING (n, branch_id) JOIN rtop e ON e.n = u.n AND e.bus_id = u.bus_id GROUP BY 1, 2, 3", *RICH),
    "rich_flow": RICH_FLOW,
    "rich_flow_by_ranges": RICH_FLOW,
    "rich_envelope_linear": sql("SELECT n, round(-greatest(0, least(50, min((set * set - d - 0.94 * 0.94) / s))), 6) AS lb_kw, round(greatest(0, least(50, min((1.06 * 1.06 - set * set + d) / s))), 6) AS ub_kw FROM (SELECT u.n, u.bus_id, any_value(e.set) AS set, sum(2 * x_pu * q) AS d, sum(2 * r_pu * k / 1000) AS s FROM closure u JOIN (SELECT u.n, branch_id, sum(0.04 * bal / 1e6) AS q, count(*) AS k FROM closure u JOIN load USING (n, bus_id) GROUP BY 1, 2) USING (n, branch_id) JOIN rbranch USING (n, branch_id) JOIN rtop e ON e.n = u.n AND e.bus_id = u.bus_id GROUP BY 1, 2) GROUP BY 1", *RICH[:2]),
    "net_components": sql("SELECT n, 'I' || r_regionkey AS cid, 'Infeeder' AS ctype, 'R' || r_regionkey AS node FROM (SELECT r_regionkey AS n, r_regionkey FROM region) UNION ALL SELECT n, bus_id, 'Node', NULL FROM bus UNION ALL SELECT n, branch_id, CASE kind WHEN 'line' THEN 'Line' ELSE 'Transformer' END, from_bus FROM branch UNION ALL SELECT n, load_id, 'Load', bus_id FROM load"),
    "write_network": sql("SELECT 'I' || r_regionkey AS cid, 'Infeeder' AS ctype, 'R' || r_regionkey AS node, NULL::DOUBLE AS v_base, NULL::DOUBLE AS i_max FROM region UNION ALL SELECT bus_id, 'Node', NULL, 1.0, NULL FROM bus UNION ALL SELECT branch_id, CASE kind WHEN 'line' THEN 'Line' ELSE 'Transformer' END, from_bus, NULL, CASE WHEN kind = 'line' AND i_max_pu < 1 THEN 40.0 END FROM branch UNION ALL SELECT 'S' || load_id, 'Load', bus_id, NULL, NULL FROM load"),
    "read_offers": sql("SELECT load_id, inj_kw, inj_price, con_kw, n_inj, -5.0::DOUBLE AS reservation_l, 5.0::DOUBLE AS reservation_u FROM offer"),
    "read_forecast": sql("SELECT load_id, bal AS real_power_w, round(0.4 * bal, 6) AS reactive_power_var FROM load"),
    "read_forecast_ts": sql("SELECT t, load_id, round(p, 6) AS real_power_w, round(0.4 * p, 6) AS reactive_power_var FROM reading"),
    "read_tx_params": f"SELECT 'T' || n_nationkey AS tx_id, 180.0::DOUBLE + n_nationkey AS \"tau_TO\", {', '.join(f'{v}::DOUBLE AS "{c}"' for c, v in TX.items() if c not in ('tau_TO', 'I_rated'))}, 150.0::DOUBLE + 5 * n_nationkey AS \"I_rated\" FROM nation",
    "read_forecast_clock": sql("SELECT TIMESTAMP '2026-06-29' + to_minutes(hour(t) * 60 + minute(t)) AS t, load_id, round(sum(p), 6) AS real_power_w, round(sum(0.4 * p), 6) AS reactive_power_var FROM reading GROUP BY 1, 2"),
    "damaged_rows": sql("SELECT load_id, NULL::DOUBLE AS real_power_w, round(0.4 * bal, 6) AS reactive_power_var FROM load WHERE bal < 0"),
    "read_wide_meter": sql("SELECT \"Nmi\", suffix, \"IntervalDay\", " + ", ".join(f'max(energy) FILTER (WHERE h = {h}) AS "Data_{h:02d}_00"' for h in range(24)) + " FROM wide GROUP BY 1, 2, 3"),
    "read_tx_series": sql("SELECT t, round(total_kw, 6) AS total_kw, round(total_kw / 2, 6) AS estimated_kw FROM series"),
    "read_ambient": sql("SELECT t, round(theta_a, 6) AS theta_a FROM ambient"),
    "read_prices": sql("SELECT load_id, export_price_kwh::DOUBLE AS export_price_kwh FROM price"),
    "write_results": sql("SELECT n, t, load_id, round(lb * w, 6) AS lb_kw, round(ub * w, 6) AS ub_kw, round(inj - con, 6) AS dispatch_kw FROM (SELECT *, CASE WHEN t = TIMESTAMP '2024-01-05' THEN 2 ELSE 1 END AS w FROM envd) JOIN disp USING (load_id)"),
    "unreadable": sql("SELECT r_regionkey AS n, CASE r_regionkey WHEN 2 THEN 'no_components' ELSE 'not_json' END AS rule, '' AS cid FROM region WHERE r_regionkey IN (0, 2, 3) UNION ALL SELECT n, 'bad_value', bus_id FROM bus WHERE n = 1"),
    "components_of_type": sql("SELECT n, branch_id AS cid FROM line"),
    "ordinal_ids": sql("SELECT n, load_id AS cid, i FROM load"),
    "scale_loads": sql("SELECT load_id, factor::DOUBLE AS factor, round(bal * factor::DOUBLE, 6) AS real_power_w, round(0.4 * bal * factor::DOUBLE, 6) AS reactive_power_var FROM load, (VALUES (1.0), (2.2), (2.5)) f(factor)"),
    "bus_table": sql("SELECT n, bus_id, 1000.0::DOUBLE AS v_base_v, 0.94::DOUBLE AS v_min_pu, 1.06::DOUBLE AS v_max_pu, row_number() OVER (PARTITION BY n ORDER BY bus_id) - 1 AS i FROM bus"),
    "bus_setpoint": sql("SELECT n, bus_id, CASE WHEN bus_id LIKE 'R%' THEN 1.0::DOUBLE END AS v_set_pu FROM bus"),
    "load_table": sql("SELECT n, load_id, bus_id, i FROM load"),
    "load_buses": sql("SELECT n, bus_id, min(i) AS first_i FROM load GROUP BY 1, 2"),
    "line_table": sql("SELECT n, branch_id, from_bus, to_bus, round(r, 6) AS r_ohm, round(0.4 * r, 6) AS x_ohm, round(r, 6) AS r0_ohm, round(0.4 * r, 6) AS x0_ohm, CASE WHEN cust % 5 = 0 THEN 40.0::DOUBLE ELSE 100000 END AS i_max_a FROM line"),
    "transformer_table": sql("SELECT n, branch_id, from_bus, to_bus, 0.003::DOUBLE AS r_ohm, 0.0012::DOUBLE AS x_ohm, 0.0::DOUBLE AS r0_ohm, 0.0::DOUBLE AS x0_ohm, 300.0::DOUBLE AS i_max_a, to_bus AS tx_bus, 1.0::DOUBLE AS ratio_pu FROM tx"),
    "transformer_buses": sql("SELECT n, bus_id, bus_id LIKE 'N%' AS is_transformer FROM bus"),
    "branch_table": sql("SELECT n, branch_id, from_bus, to_bus, kind, CASE kind WHEN 'line' THEN round(r_pu, 6) ELSE 0.003 END AS r_ohm, CASE kind WHEN 'line' THEN NULL ELSE 1.0::DOUBLE END AS ratio_pu FROM branch"),
    "per_unit": sql("SELECT n, branch_id, 1.0::DOUBLE AS z_base_ohm, 1000.0::DOUBLE AS i_base_a, round(r_pu, 6) AS r_pu, round(x_pu, 6) AS x_pu, i_max_pu::DOUBLE AS i_max_pu FROM branch"),
    "split_lines_transformers": sql("SELECT n, branch_id, from_bus, to_bus, round(CASE kind WHEN 'line' THEN r_pu ELSE 0.003 END, 6) AS r_ohm, CASE kind WHEN 'line' THEN CASE WHEN i_max_pu < 1 THEN 40.0 ELSE 100000.0 END ELSE 300.0 END::DOUBLE AS i_max_a, kind AS side FROM branch"),
    "snapshot_at": sql("SELECT load_id, round(p, 6) AS real_power_w, round(0.4 * p, 6) AS reactive_power_var FROM reading WHERE date_trunc('day', t) = TIMESTAMP '2024-01-05'"),
    "network_quality": sql("""SELECT n, 'vector_group' AS rule, branch_id AS cid, 'Yd11/Dyn11' AS detail FROM tx WHERE nation % 7 = 3
      UNION ALL SELECT n, 'dangling_node', branch_id, from_bus FROM line WHERE from_bus IN (SELECT bus_id FROM gone)
      UNION ALL SELECT n, 'dangling_node', branch_id, to_bus FROM line WHERE to_bus IN (SELECT bus_id FROM gone)
      UNION ALL SELECT n, 'dangling_node', load_id, bus_id FROM load WHERE bus_id IN (SELECT bus_id FROM gone)""", "gone AS (SELECT 'C' || cust AS bus_id FROM c WHERE cust % 50 = 7)"),
    "downstream_branches": sql("SELECT a.n, a.branch_id, b.branch_id AS child_branch_id FROM branch a JOIN branch b ON a.n = b.n AND a.to_bus = b.from_bus"),
    "tree_closure": sql("SELECT n, branch_id, bus_id, depth FROM closure"),
    "match_forecasts": sql("SELECT t, load_id, round(p, 6) AS real_power_w, round(0.4 * p, 6) AS reactive_power_var FROM reading WHERE load_id IN (SELECT load_id FROM load)"),
    "match_offers": sql("SELECT load_id, -5.0::DOUBLE AS reservation_l, 5.0::DOUBLE AS reservation_u FROM offer JOIN load USING (load_id)"),
    "unmatched_ids": sql("SELECT DISTINCT 'forecast' AS source, load_id FROM reading WHERE load_id NOT IN (SELECT load_id FROM load) UNION ALL SELECT 'offer', load_id FROM offer WHERE load_id NOT IN (SELECT load_id FROM load) UNION ALL SELECT 'network', load_id FROM load WHERE load_id NOT IN (SELECT load_id FROM reading)"),
    "participants": sql("SELECT n, load_id, 'doe' AS mode FROM load WHERE load_id IN (SELECT load_id FROM reading) UNION ALL SELECT n, load_id, 'soe' FROM load WHERE load_id IN (SELECT load_id FROM offer)"),
    "prices_default_zero": sql("SELECT n, load_id, coalesce(export_price_kwh, 0)::DOUBLE AS export_price_kwh FROM load LEFT JOIN price USING (load_id)"),
    "index_product": sql("SELECT n, load_id, oe, ci FROM load, (VALUES ('oel'), ('oer')) a(oe), (VALUES ('con'), ('inj')) b(ci)"),
    "ambient_at": sql("""SELECT e.t, CASE WHEN e.t <= lo THEN th_lo WHEN e.t >= hi THEN th_hi ELSE round(a.theta_a + (a.th2 - a.theta_a) * (epoch_us(e.t) - epoch_us(a.t))::DOUBLE / (epoch_us(a.t2) - epoch_us(a.t)), 9) END AS theta_a, e.t < lo OR e.t > hi AS extrapolated
      FROM (SELECT DISTINCT ts AS t FROM events) e LEFT JOIN a ON e.t >= a.t AND e.t < a.t2, (SELECT min(t) AS lo, max(t) AS hi, round(arg_min(theta_a, t), 9) AS th_lo, round(arg_max(theta_a, t), 9) AS th_hi FROM ambient WHERE hour(t) <> 5)""", "a AS (SELECT t, theta_a, lead(t) OVER (ORDER BY t) AS t2, lead(theta_a) OVER (ORDER BY t) AS th2 FROM ambient WHERE hour(t) <> 5)"),
    "bus_background_load": sql("SELECT b.n, x.t, b.bus_id, round(coalesce(sum(CASE WHEN load_id NOT IN (SELECT load_id FROM offer) THEN p ELSE 0 END), 0) / 1000, 6) AS p_kw, round(coalesce(sum(0.4 * p), 0) / 1000, 6) AS q_kw FROM bus b JOIN (SELECT DISTINCT n, t FROM daily) x USING (n) LEFT JOIN daily y ON y.n = b.n AND y.t = x.t AND y.bus_id = b.bus_id GROUP BY 1, 2, 3"),
    "ambient_by_network": sql("""SELECT n, t, round(CASE WHEN t1 IS NULL THEN (SELECT arg_min(theta_a, t) FROM a WHERE a.n = x.n) WHEN t2 IS NULL THEN theta_a ELSE theta_a + (th2 - theta_a) * (epoch_us(t) - epoch_us(t1))::DOUBLE / (epoch_us(t2) - epoch_us(t1)) END, 9) AS theta_a, t1 IS NULL OR (t2 IS NULL AND t > t1) AS extrapolated
      FROM (SELECT e.n, e.t, a.t AS t1, a.theta_a, a.t2, a.th2 FROM (SELECT DISTINCT n, r.t FROM reading r JOIN load USING (load_id)) e ASOF LEFT JOIN a ON e.n = a.n AND e.t >= a.t) x""", "a AS (SELECT n, t, theta_a, lead(t) OVER (PARTITION BY n ORDER BY t) AS t2, lead(theta_a) OVER (PARTITION BY n ORDER BY t) AS th2 FROM air WHERE hour(t) <> 5)"),
    "resample_by_network": sql("SELECT n, g AS t, round(CASE WHEN t2 IS NULL THEN theta_a ELSE theta_a + (th2 - theta_a) * (epoch(g) - epoch(t)) / (epoch(t2) - epoch(t)) END, 9) AS theta_a FROM (SELECT *, unnest(CASE WHEN t2 IS NULL THEN [t] ELSE generate_series(t, t2 - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE) END) AS g FROM (SELECT n, t, theta_a, lead(t) OVER (PARTITION BY n ORDER BY t) AS t2, lead(theta_a) OVER (PARTITION BY n ORDER BY t) AS th2 FROM air))"),
    "nodal_allocation": sql("SELECT n, oe, bus_id, round(CASE WHEN load_id IN (SELECT load_id FROM reading) THEN CASE oe WHEN 'oel' THEN 0.002 ELSE -0.002 END ELSE bal / 1e6 END * 1e3, 6) AS p_pu, round(0.4 * bal / 1e6 * 1e3, 6) AS q_pu FROM load, (VALUES ('oel'), ('oer')) s(oe)"),
    "subtree_flow": sql("SELECT n, k AS oe, branch_id, round(p0, 9) AS p_pu, round(q0, 9) AS q_pu FROM f0", *FLOW[:2]),
    "path_voltage": sql("SELECT u.n, k AS oe, u.bus_id, round(1 - sum(2 * (r_pu * p0 + x_pu * q0)), 6) AS v2_pu FROM closure u JOIN f0 USING (n, branch_id) JOIN branch USING (n, branch_id) GROUP BY 1, 2, 3", *FLOW[:2]),
    "power_flow": sql("SELECT n, oe, branch_id, round(p, 6) AS p_pu, round(q, 6) AS q_pu, round(l, 6) AS l_pu, round(v, 6) AS v2_pu, true AS converged FROM flow", *FLOW, OUT),
    "unit_conversions": sql("SELECT n, oe, branch_id, round(sqrt(abs(l)) * 1000, 4) AS current_a, round(p * 1e6, 3) AS p_w, round(sqrt(abs(v)), 6) AS voltage_pu FROM flow", *FLOW, OUT),
    "limit_violations": sql("SELECT n, oe, 'v_min' AS kind, bus_id AS id, round(sqrt(abs(v)), 6) AS value, 0.94::DOUBLE AS \"limit\", round(0.94 - sqrt(abs(v)), 6) AS excess FROM flow WHERE sqrt(abs(v)) < 0.94 UNION ALL SELECT n, oe, 'v_max', bus_id, round(sqrt(abs(v)), 6), 1.06, round(sqrt(abs(v)) - 1.06, 6) FROM flow WHERE sqrt(abs(v)) > 1.06 UNION ALL SELECT n, oe, 'i_max', branch_id, round(sqrt(l), 6), i_max_pu, round(sqrt(l) - i_max_pu, 6) FROM flow WHERE sqrt(l) > i_max_pu", *FLOW, OUT),
    "voltage_current_results": sql("SELECT n, bus_id, branch_id, " + ", ".join(f"max({x}) FILTER (WHERE oe = '{s}') AS {c}_{s}" for c, x in (("voltage_pu", "round(sqrt(abs(v)), 6)"), ("current_a", "round(sqrt(abs(l)) * 1000, 3)"), ("p_w", "round(p * 1e6, 3)"), ("q_va", "round(q * 1e6, 3)")) for s in ("oel", "oer")) + " FROM flow GROUP BY 1, 2, 3", *FLOW, OUT),
    "viol_report": sql("SELECT n, t, bus_id, round(coalesce(sum(kw) FILTER (WHERE load), 0), 6) AS viol_a_kw_oel, round(coalesce(sum(kw) FILTER (WHERE NOT load), 0), 6) AS viol_a_kw_oer, 0.0::DOUBLE AS viol_r_kw_oel, 0.0::DOUBLE AS viol_r_kw_oer FROM slack GROUP BY 1, 2, 3", SLACK),
    "dispatch_payment": sql("SELECT load_id, round(inj - con, 9) AS dispatch_kw, round((inj * coalesce(inj_price, 0) + con * coalesce(con_price, 0)) * 5 / 60, 9) AS payment_dlr FROM disp LEFT JOIN offer USING (load_id)"),
    "objective_value": sql("SELECT n, t, round(cost, 3) AS cost, round(benefit, 3) AS benefit, round(width, 3) AS width, round(coalesce(penalty, 0), 3) AS penalty, round(cost - benefit - width + coalesce(penalty, 0), 3) AS total FROM pay JOIN ben USING (n, t) LEFT JOIN pen USING (n, t)", SLACK, "pay AS (SELECT n, t, sum(round((inj * coalesce(inj_price, 0) + con * coalesce(con_price, 0)) * 5 / 60, 9)) AS cost FROM dispd LEFT JOIN offer USING (load_id) GROUP BY 1, 2)", "ben AS (SELECT n, t, sum(coalesce(export_price_kwh, 0) * ub * 5 / 60) AS benefit, sum(0.001 * (ub - lb)) AS width FROM envd LEFT JOIN price USING (load_id) GROUP BY 1, 2)", "pen AS (SELECT n, t, sum(1000 * abs(kw)) AS penalty FROM slack GROUP BY 1, 2)"),
    "offer_cap_check": sql("SELECT load_id, t, 'inj' AS ci, round(inj, 6) AS dispatch_kw, coalesce(inj_kw, 0)::DOUBLE AS cap_kw, inj <= coalesce(inj_kw, 0) AS ok FROM dispd LEFT JOIN offer USING (load_id) UNION ALL SELECT load_id, t, 'con', round(con, 6), coalesce(con_kw, 0), con <= coalesce(con_kw, 0) FROM dispd LEFT JOIN offer USING (load_id)"),
    "reservation_check": sql("SELECT n, t, load_id, round(greatest(0, lb - (-5 + inj - con)), 6) AS short_l_kw, round(greatest(0, 5 + inj - con - ub), 6) AS short_u_kw FROM envd JOIN offer USING (load_id) JOIN dispd USING (n, t, load_id)"),
    "reservation_dispatch": sql("SELECT n, load_id, round(got, 9) AS dispatch_kw, round(abs(got) * CASE WHEN got >= 0 THEN inj_price ELSE con_price END * 5 / 60, 9) AS payment_dlr, round(greatest(0, lb + 5 - got) + greatest(0, got - (ub - 5)), 9) AS shortfall_kw FROM g", "g AS (SELECT *, greatest(-con_kw, least(inj_kw, greatest(lb + 5, least(0, ub - 5)))) AS got FROM env JOIN offer USING (load_id))"),
    "load_factor": sql("SELECT tx_id, t, round(current_a, 6) AS current_a, round(power(current_a / (150 + 5 * nation), 2), 6) AS k2 FROM current JOIN tx ON tx_id = branch_id"),
    "max_current_for_hotspot": sql(f"SELECT tx_id, t, round(k2_max, 6) AS k2_max, round(sqrt(k2_max) * {TX['I_rated']}, 6) AS i_max_a FROM allowed", "state AS (SELECT branch_id AS tx_id, t, theta_a, (nation + 10)::DOUBLE AS x1, nation / 2.0::DOUBLE AS x2 FROM tx, ambient)", *allowed("state")),
    "thermal_stream": sql('SELECT tx_id, t, round(x1, 6) AS "delta_theta_TO", round(x2, 6) AS "delta_theta_HS" FROM temp WHERE t + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events JOIN customer ON user_id = c_custkey) - INTERVAL 1 HOUR', *STEPS),
    "network_thermal_stream": sql(
        'SELECT n, tx_id, t, round(a, 6) AS current_a, round(x1, 6) AS "delta_theta_TO", round(x2, 6) AS "delta_theta_HS" FROM run',
        "amp AS (SELECT x.n, branch_id AS tx_id, nation, date_trunc('hour', t) AS t, sqrt(power(sum(p), 2) + power(sum(0.4 * p), 2)) / 1000 AS a FROM reading r JOIN load l USING (load_id) JOIN c USING (n, cust) JOIN tx x USING (n, nation) GROUP BY 1, 2, 3, 4)",
        "hours AS (SELECT n, tx_id, nation, unnest(generate_series(lo, date_trunc('hour', hi) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t, lo FROM (SELECT n, tx_id, nation, min(t) AS lo FROM amp GROUP BY 1, 2, 3), (SELECT max(ts) - INTERVAL 1 HOUR AS hi FROM events))",
        "step AS (SELECT h.n, h.tx_id, h.nation, h.t, coalesce(a, 0) AS a, row_number() OVER (PARTITION BY h.n, h.tx_id ORDER BY h.t) AS k FROM hours h LEFT JOIN amp USING (n, tx_id, t))",
        f"goal AS (SELECT *, {TX['delta_theta_TO_R']} * power((power(a / (150 + 5 * nation), 2) * {TX['R']} + 1) / ({TX['R']} + 1), {TX['n']}) AS u1, {TX['delta_theta_HS_R']} * power(power(a / (150 + 5 * nation), 2), {TX['m']}) AS u2, exp(-60.0 / (180 + nation)) AS d1 FROM step)",
        f"run AS (SELECT n, tx_id, t, a, k, u1 * (1 - d1) AS x1, u2 * (1 - {D2}) AS x2 FROM goal WHERE k = 1 UNION ALL SELECT g.n, g.tx_id, g.t, g.a, g.k, x1 + (u1 - x1) * (1 - d1), x2 + (u2 - x2) * (1 - {D2}) FROM run r JOIN goal g ON g.n = r.n AND g.tx_id = r.tx_id AND g.k = r.k + 1)",
    ),
    "envelope_uniform": sql(ENVELOPE.format("u"), SMALL, UNIFORM, *search("u", "seg", "small")),
    "envelope_nearest_first": sql(ENVELOPE.format("u"), SMALL, *NEAREST, *search("u", "seg", "small")),
    "envelope_thermal": sql(ENVELOPE.format("u"), SMALL, UNIFORM, f"state AS (SELECT branch_id AS tx_id, TIMESTAMP '{SNAPSHOT}' AS t, 20.0::DOUBLE AS theta_a, (nation + 10)::DOUBLE AS x1, nation / 2.0::DOUBLE AS x2 FROM tx)", *allowed("state"), f"cool AS (SELECT n, branch_id, sqrt(k2_max) * {TX['I_rated']} / 1000 AS most FROM allowed JOIN tx ON tx_id = branch_id)", *search("u", "seg", "small", limits="cool")),
    "envelope_reserved": reserved(),
    "required_shed": sql("SELECT n, bus_id, CASE WHEN ok THEN round(hi * 1e3, 6) END AS shed_kw, ok AS restored FROM s3 JOIN worst USING (n)", *SHED),
    "ultimate_rise": sql(f"SELECT tx_id, t, round({K2}, 6) AS k2, round({TO_U}, 6) AS to_u, round({HS_U}, 6) AS hs_u FROM current"),
    "thermal_step": sql(f"SELECT tx_id, t, round(x1, 6) AS \"delta_theta_TO\", round(x2, 6) AS \"delta_theta_HS\", round(theta_a + x1 + x2, 6) AS \"theta_HS\" FROM s JOIN ambient USING (t)", f"s AS (SELECT tx_id, t, ({TO_U} - (nation + 10)) * (1 - {D1}) + nation + 10 AS x1, ({HS_U} - nation / 2.0) * (1 - {D2}) + nation / 2.0 AS x2 FROM current JOIN tx ON tx_id = branch_id)"),
    "thermal_series": sql('SELECT tx_id, t, round(x1, 6) AS "delta_theta_TO", round(x2, 6) AS "delta_theta_HS", round(theta, 6) AS "theta_HS" FROM hot', *STEPS, HOT),
    "hotspot_check": sql(f"SELECT tx_id, round(max(theta), 6) AS peak, round(count(*) FILTER (WHERE theta > {TX['theta_HS_max']}) * {TX['dt']} / 60, 6) AS hours_over FROM hot GROUP BY 1", *STEPS, HOT),
    "hotspots_over": sql(f"SELECT tx_id, t, round(theta, 6) AS \"theta_HS\", round(theta - {TX['theta_HS_max']}, 6) AS over FROM hot WHERE theta > {TX['theta_HS_max']}", *STEPS, HOT),
    "register_filter": sql("SELECT \"Nmi\", \"IntervalDay\", max(energy) FILTER (WHERE h = 7) AS \"Data_07_00\" FROM meter GROUP BY 1, 2"),
    "wide_to_long": sql("SELECT \"Nmi\", \"IntervalDay\", printf('Data_%02d_00', h) AS \"interval\", energy FROM meter"),
    "interval_timestamp": sql("SELECT \"Nmi\", \"IntervalDay\"::TIMESTAMP + to_hours(h) AS t, energy FROM meter"),
    "to_power": sql("SELECT \"IntervalDay\"::TIMESTAMP + to_hours(h) AS t, \"Nmi\" AS load_id, round_even(energy * 1000, 0)::BIGINT AS real_power_w, round_even(energy * 1000 * 0.4, 0)::BIGINT AS reactive_power_var FROM meter"),
    "sorted_export": sql("SELECT t, load_id, round(p, 6) AS real_power_w FROM reading ORDER BY t, load_id"),
    "drop_missing": sql("SELECT t, round(total_kw, 6) AS total_kw, NULL::BIGINT AS dropped FROM series WHERE hour(t) <> 3 UNION ALL SELECT NULL, NULL, count(*) FROM series WHERE hour(t) = 3"),
    "split_net_load": sql("SELECT t, round(greatest(total_kw, 0), 6) AS base_kw, round(greatest(-total_kw, 0), 6) AS solar_kw FROM series"),
    "smooth_centered": "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM events",
    "share_of_total": "SELECT event_id, round(CASE WHEN day(ts) % 5 = 0 THEN 0 ELSE value / sum(value) OVER (PARTITION BY date_trunc('day', ts)) * 100 END, 6) AS share FROM events",
    "resample_interpolate": sql("SELECT g AS t, round(CASE WHEN t2 IS NULL THEN theta_a ELSE theta_a + (th2 - theta_a) * (epoch(g) - epoch(t)) / (epoch(t2) - epoch(t)) END, 9) AS theta_a FROM (SELECT *, unnest(CASE WHEN t2 IS NULL THEN [t] ELSE generate_series(t, t2 - INTERVAL 5 MINUTE, INTERVAL 5 MINUTE) END) AS g FROM (SELECT t, theta_a, lead(t) OVER (ORDER BY t) AS t2, lead(theta_a) OVER (ORDER BY t) AS th2 FROM ambient))"),
    "step_number": sql("SELECT n, load_id, t, dense_rank() OVER (PARTITION BY n ORDER BY t) AS step FROM reading JOIN load USING (load_id)"),
    "interval_check": sql("SELECT n, load_id, t, gap AS gap_min, CASE WHEN gap = 0 THEN 'duplicate' WHEN gap > 60 THEN 'gap' ELSE 'short' END AS kind FROM (SELECT n, load_id, h AS t, (epoch(h) - epoch(lag(h) OVER (PARTITION BY n, load_id ORDER BY h))) / 60.0 AS gap FROM (SELECT n, load_id, date_trunc('hour', t) AS h FROM reading JOIN load USING (load_id))) WHERE gap IS NOT NULL AND gap <> 60"),
    "merit_order": sql("SELECT n, CASE odd WHEN 1 THEN 'inj' ELSE 'con' END AS ci, load_id, tier, round(taken, 6) AS taken_kw, round(taken * price * 5 / 60, 6) AS cost_dlr FROM (SELECT n, odd, load_id, tier, price, greatest(0, least(kw, need - before)) AS taken FROM (SELECT t.*, l.n, coalesce(sum(kw) OVER (PARTITION BY l.n, odd ORDER BY price, t.load_id, tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tier t JOIN load l USING (load_id)) JOIN (SELECT n, count(*) * 3.0 AS need FROM load GROUP BY 1) USING (n)) WHERE taken > 0"),
    "series_stats": sql("SELECT count(*) AS n_rows, min(t) AS t_min, max(t) AS t_max, round(min(total_kw), 6) AS kw_min, round(max(total_kw), 6) AS kw_max, round(avg(total_kw), 6) AS kw_mean, round(avg((total_kw < 0)::INT), 6) AS neg_share FROM series"),
    "customer_roster": "SELECT idx, printf('NMI_%03d', idx + 1) AS load_id, CASE WHEN idx < round_even(nn * 0.33, 0) THEN 'bus_a' WHEN idx < 2 * round_even(nn * 0.33, 0) THEN 'bus_b' ELSE 'bus_c' END AS bus_id, idx < round_even(nn * 0.3, 0) AS is_solar FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, count(*) OVER () AS nn FROM customer)",
    "customer_weights": sql("SELECT load_id, t, round(noise, 6) AS noise, round(weight, 6) AS weight FROM pb_w", ROSTER, profile("pb", 42, "total_kw", "true")[0]),
    "make_profiles": sql("SELECT load_id, t, round(kw, 6) AS kw FROM pb", ROSTER, *profile("pb", 42, "total_kw", "true")),
    "disaggregate": sql("SELECT load_id, t, round(net_kw, 6) AS net_kw FROM net", *NET),
    "sum_check": sql("SELECT max(abs(s - total_kw)) <= 1e-6 AS ok FROM (SELECT t, sum(net_kw) AS s FROM net GROUP BY 1) JOIN series USING (t)", *NET),
    "customer_summary": sql("SELECT bus_id, count(*) AS customers, round(avg(m), 6) AS mean_kw, round(min(m), 6) AS min_mean_kw, round(max(m), 6) AS max_mean_kw, round(avg(e), 6) AS export_share FROM (SELECT load_id, avg(net_kw) AS m, avg((net_kw < 0)::INT) AS e FROM net GROUP BY 1) JOIN roster USING (load_id) GROUP BY ROLLUP (bus_id)", *NET),
    "customer_rows": sql("SELECT load_id, bus_id, is_solar, round(avg(net_kw), 6) AS mean_kw, round(min(net_kw), 6) AS min_kw, round(max(net_kw), 6) AS max_kw, round(avg((net_kw < 0)::INT), 6) AS export_share FROM net JOIN roster USING (load_id) GROUP BY 1, 2, 3", *NET),
    "reactive_from_pf": sql("SELECT t, load_id, round(p, 2) AS real_power_w, round(p * tan(acos(0.95)), 2) AS reactive_power_var FROM reading"),
    "envelope_linear": sql("""SELECT n, round(-greatest(0, least(50, min((1 - d - 0.94 * 0.94) / s))), 6) AS lb_kw, round(greatest(0, least(50, min((1.06 * 1.06 - 1 + d) / s))), 6) AS ub_kw
      FROM (SELECT u.n, u.bus_id, sum(2 * (r_pu * p + x_pu * q)) AS d, sum(2 * r_pu * k / 1000) AS s FROM closure u JOIN fl USING (n, branch_id) JOIN branch USING (n, branch_id) GROUP BY 1, 2) WHERE s > 0 GROUP BY 1""", "fl AS (SELECT u.n, branch_id, sum(CASE WHEN load_id IN (SELECT load_id FROM reading) THEN 0 ELSE bal * 0.1 / 1e6 END) AS p, sum(0.4 * bal * 0.1 / 1e6) AS q, sum(CASE WHEN load_id IN (SELECT load_id FROM reading) THEN 1.0 ELSE 0 END) AS k FROM closure u JOIN load USING (n, bus_id) GROUP BY 1, 2)"),
    "pu_conversion": sql("SELECT load_id, round(bal / 1e6 * 1e3, 6) AS p_mpu FROM load"),
}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
