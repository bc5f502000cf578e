"""Reshapes, joins, sets, rosters, flows and strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rosters as R
from ..operators.quantiles import exact_quantiles
from ..operators.windows import first_by, share_of_total
from ..sources import tables as S
from ..sources.tables import table
from .common import GAMES, PREDICTIONS, games, predictions, rounded, year

_EVENTS_HIST = ["ts", "event_id"]


def asof_prior_event(spark, d):
    """Each purchase with the last view of its user strictly before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = J.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", ["event_id", "value"], [F.col("event_id").desc()])
    return found.select("event_id", "user_id", "value", "asof_event_id", "asof_value")


ASOF_PRIOR_EVENT = """WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT p.event_id, p.user_id, p.value, v.event_id AS asof_event_id, v.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts"""


def eligibility_gate(spark, d):
    """A purchase is eligible by the mean of its user's last three views once there are three, else by their sum."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = e.where("event_type = 'view'")
    w = Window.partitionBy("user_id").orderBy(*_EVENTS_HIST)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    hist = views.withColumns({"n_views": F.count(F.lit(1)).over(upto), "avg3": F.avg("value").over(w.rowsBetween(-2, 0)), "total": F.sum("value").over(upto)})
    found = J.asof_join(e.where("event_type = 'purchase'"), hist, ["user_id"], "ts", ["n_views", "avg3", "total"], [F.col("event_id").desc()])
    gate = F.when(F.col("asof_n_views") >= 3, F.col("asof_avg3") >= 40).otherwise(F.col("asof_total") >= 60)
    return found.select("event_id", F.coalesce("asof_n_views", F.lit(0).cast("long")).alias("games"), F.coalesce(gate, F.lit(False)).cast("int").alias("eligible"))


ELIGIBILITY_GATE = """WITH h AS (SELECT user_id, ts, event_id, count(*) OVER u AS n_views, avg(value) OVER l AS avg3, sum(value) OVER u AS total FROM events WHERE event_type = 'view'
 WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)),
g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT p.event_id, coalesce(g.n_views, 0) AS games, CAST(coalesce(CASE WHEN g.n_views >= 3 THEN g.avg3 >= 40 ELSE g.total >= 60 END, FALSE) AS INTEGER) AS eligible
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN g ON p.user_id = g.user_id AND p.ts > g.ts"""


def zero_filled_target(spark, d):
    """All members of each day's universe, with 0 for those without an outcome."""
    e = table(spark, d, "events").withColumn("day", F.dayofmonth("ts").cast("int"))
    eligible = e.where("event_type = 'view'").select("user_id", "day").distinct()
    real = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.sum("value").alias("amount"))
    out = eligible.join(real, ["user_id", "day"], "left")
    return rounded(out.select("user_id", "day", F.coalesce("amount", F.lit(0.0)).alias("amount"), F.col("amount").isNotNull().alias("played")))


ZERO_FILLED_TARGET = """WITH e AS (SELECT *, CAST(day(ts) AS INTEGER) AS day FROM events), u AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'view'),
r AS (SELECT user_id, day, sum(value) AS amount FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, day, round(coalesce(amount, 0), 6) AS amount, amount IS NOT NULL AS played FROM u LEFT JOIN r USING (user_id, day)"""


def home_away_stack(spark, d):
    rows = J.stack_sides(games(spark, d), ["game", "season", "week"], {"team": "home", "opponent": "away", "points": "home_points", "allowed": "away_points"}, {"team": "away", "opponent": "home", "points": "away_points", "allowed": "home_points"})
    return rows.withColumnRenamed("is_first", "is_home")


STACK = """st AS (SELECT game, season, week, home AS team, away AS opponent, home_points AS points, away_points AS allowed, TRUE AS is_home FROM games
 UNION ALL SELECT game, season, week, away, home, away_points, home_points, FALSE FROM games)"""


def _team_season(spark, d):
    return home_away_stack(spark, d).groupBy("team", "season").agg(F.avg("points").alias("avg_all"), F.avg(F.when(F.col("week") > 9, F.col("points"))).alias("avg3"), F.avg("allowed").alias("allowed_avg_all"))


_TS = "ts AS (SELECT team, season, avg(points) AS avg_all, avg(points) FILTER (WHERE week > 9) AS avg3, avg(allowed) AS allowed_avg_all FROM st GROUP BY ALL)"


def home_away_pivot(spark, d):
    g = games(spark, d).select("game", "season", "home", "away")
    return rounded(J.attach_sides(g, _team_season(spark, d), "team", "home", "away", ["avg_all", "avg3"], ["season"]))


HOME_AWAY_PIVOT = f"""WITH {GAMES}, {STACK}, {_TS} SELECT g.game, g.season, g.home, g.away, round(h.avg_all, 6) AS home_avg_all, round(h.avg3, 6) AS home_avg3, round(a.avg_all, 6) AS away_avg_all, round(a.avg3, 6) AS away_avg3
FROM games g LEFT JOIN ts h ON h.team = g.home AND h.season = g.season LEFT JOIN ts a ON a.team = g.away AND a.season = g.season"""


def differential_trend(spark, d):
    cols = ["avg_all", "avg3", "allowed_avg_all"]
    g = J.attach_sides(games(spark, d).select("game", "season", "home", "away"), _team_season(spark, d), "team", "home", "away", cols, ["season"])
    c = F.col
    out = {f"diff_{x}": c(f"home_{x}") - c(f"away_{x}") for x in cols} | {f"{s}_trend": c(f"{s}_avg3") - c(f"{s}_avg_all") for s in ("home", "away")}
    out |= {f"{s}_expectation": E.pythagorean(c(f"{s}_avg_all"), c(f"{s}_allowed_avg_all"), 2.0, 1e-6) for s in ("home", "away")}
    out["matchup"] = c("home_avg_all") - c("away_allowed_avg_all")
    return rounded(g.select("game", *[e.alias(n) for n, e in out.items()]))


DIFFERENTIAL_TREND = f"""WITH {GAMES}, {STACK}, {_TS} SELECT g.game, round(h.avg_all - a.avg_all, 6) AS diff_avg_all, round(h.avg3 - a.avg3, 6) AS diff_avg3, round(h.allowed_avg_all - a.allowed_avg_all, 6) AS diff_allowed_avg_all,
 round(h.avg3 - h.avg_all, 6) AS home_trend, round(a.avg3 - a.avg_all, 6) AS away_trend, round(h.avg_all ** 2 / (h.avg_all ** 2 + h.allowed_avg_all ** 2 + 1e-6), 6) AS home_expectation,
 round(a.avg_all ** 2 / (a.avg_all ** 2 + a.allowed_avg_all ** 2 + 1e-6), 6) AS away_expectation, round(h.avg_all - a.allowed_avg_all, 6) AS matchup
FROM games g LEFT JOIN ts h ON h.team = g.home AND h.season = g.season LEFT JOIN ts a ON a.team = g.away AND a.season = g.season"""


def opponent_self_join(spark, d):
    """Totals of an order's return flags where it has exactly two of them, each with the other's."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    return rounded(J.opponent_values(rows, "l_orderkey", ["quantity", "n"]))


OPPONENT_SELF_JOIN = """WITH r AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey FROM r GROUP BY 1 HAVING count(*) = 2)
SELECT a.*, b.quantity AS quantity_allowed, b.n AS n_allowed FROM r a JOIN c USING (l_orderkey) JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag <> b.l_returnflag"""


def consensus_or_average(spark, d):
    li = table(spark, d, "lineitem").withColumn("x", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    return rounded(A.preferred_or_average(li, ["l_orderkey"], F.lower("l_returnflag") == "n", "x", "line"))


CONSENSUS_OR_AVERAGE = """WITH l AS (SELECT l_orderkey, lower(l_returnflag) = 'n' AS pref, CASE WHEN l_linenumber <> 3 THEN l_tax END AS x FROM lineitem)
SELECT l_orderkey, round(CASE WHEN count_if(pref) > 0 THEN max(x) FILTER (WHERE pref) ELSE avg(x) END, 6) AS line FROM l GROUP BY 1"""


def best_of_two_matches(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") * 3).alias("other"))
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_partkey")).alias("alt"), "p_size")
    return J.best_of_two(li, part, ("l_partkey", "alt"), ("other", "p_partkey"), "p_size").groupBy("l_orderkey").agg(F.max("best_p_size").alias("best"), F.count("best_p_size").alias("matched"))


BEST_OF_TWO_MATCHES = """WITH m AS (SELECT l_orderkey, greatest(a.p_size, b.p_size) AS best FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey AND a.p_size > 10 LEFT JOIN part b ON b.p_partkey = l_suppkey * 3)
SELECT l_orderkey, max(best) AS best, count(best) AS matched FROM m GROUP BY 1"""


def blue_chip_ratio(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, d, "part").where("p_partkey % 5 <> 0").select("p_partkey", (F.col("p_size") % 6).alias("stars"), "p_retailprice")
    return rounded(A.star_ratio(li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left"), ["l_suppkey"], "l_partkey", "stars", "p_retailprice"))


BLUE_CHIP_RATIO = """WITH j AS (SELECT l_suppkey, l_partkey, p_size % 6 AS stars, p_retailprice FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) ON l_partkey = p_partkey)
SELECT l_suppkey, count(DISTINCT l_partkey) AS members, CAST(count_if(stars >= 4) AS BIGINT) AS high, count(stars) AS matched, round(coalesce(avg(p_retailprice), 0), 6) AS avg_rating,
 round(coalesce(count_if(stars >= 4) / nullif(count(DISTINCT l_partkey), 0), 0), 6) AS ratio, round(CASE WHEN count(stars) >= 20 THEN count_if(stars >= 4) / count(stars) END, 6) AS matched_ratio FROM j GROUP BY 1"""


def roster_turnover(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(F.dayofmonth("ts") / 8).cast("int").alias("season"), "event_type")
    roster = first_by(e.groupBy("user_id", "season", "event_type").count(), ["user_id", "season"], [F.col("count").desc(), "event_type"])
    return rounded(R.turnover(roster, "user_id", "event_type", "season"))


ROSTER_TURNOVER = """WITH n AS (SELECT user_id, CAST(floor(day(ts) / 8) AS INTEGER) AS season, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT user_id, season, event_type AS t FROM n QUALIFY row_number() OVER (PARTITION BY user_id, season ORDER BY n DESC, event_type) = 1),
s AS (SELECT DISTINCT season FROM r WHERE season - 1 IN (SELECT season FROM r)),
b AS (SELECT user_id, season, a.t AS now, p.t AS before FROM r a FULL JOIN (SELECT user_id, season + 1 AS season, t FROM r) p USING (user_id, season) WHERE season IN (SELECT season FROM s)),
i AS (SELECT now AS event_type, season, count_if(now = before) AS stayed, count_if(before IS NULL) AS new, count_if(now <> before) AS moved_in, count(*) AS size FROM b WHERE now IS NOT NULL GROUP BY ALL),
o AS (SELECT before AS event_type, season, count_if(now IS NULL) AS gone, count_if(now <> before) AS moved_out FROM b WHERE before IS NOT NULL GROUP BY ALL)
SELECT event_type, season, CAST(coalesce(stayed, 0) AS BIGINT) AS stayed, CAST(coalesce(new, 0) AS BIGINT) AS new, CAST(coalesce(moved_in, 0) AS BIGINT) AS moved_in, CAST(coalesce(size, 0) AS BIGINT) AS size,
 CAST(coalesce(gone, 0) AS BIGINT) AS gone, CAST(coalesce(moved_out, 0) AS BIGINT) AS moved_out, round(coalesce(stayed, 0) / nullif(coalesce(stayed, 0) + coalesce(gone, 0) + coalesce(moved_out, 0), 0), 6) AS kept_share
FROM i FULL JOIN o USING (event_type, season)"""


def tenure_counts(spark, d):
    return R.tenure(table(spark, d, "orders").select("o_custkey", year("o_orderdate").alias("season")), "o_custkey", "season")


TENURE_COUNTS = """WITH r AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders)
SELECT o_custkey, season, count(*) OVER (PARTITION BY o_custkey ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tenure FROM r"""


def _moves(spark, d):
    """A line item as a move from its customer's nation to its supplier's; both come through the nation table, in two roles."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    origin, target = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("origin")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_tax")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").join(F.broadcast(origin), "c_nationkey").join(F.broadcast(target), "s_nationkey").select("origin", "target", F.col("l_tax").alias("rating"))


MOVES = """mv AS (SELECT a.n_name AS origin, b.n_name AS target, l_tax AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey)"""


def portal_flow_totals(spark, d):
    return rounded(R.flow_totals(_moves(spark, d), "origin", "target", "rating"))


PORTAL_FLOW_TOTALS = f"""WITH {MOVES}, i AS (SELECT target AS place, count(*) AS n_in, avg(rating) AS avg_in FROM mv GROUP BY 1), o AS (SELECT origin AS place, count(*) AS n_out, avg(rating) AS avg_out FROM mv GROUP BY 1)
SELECT place, coalesce(n_in, 0) AS n_in, round(avg_in, 6) AS avg_in, coalesce(n_out, 0) AS n_out, round(avg_out, 6) AS avg_out, coalesce(n_in, 0) - coalesce(n_out, 0) AS net, coalesce(n_in, 0) + coalesce(n_out, 0) AS activity,
 round(avg_in - avg_out, 6) AS quality_delta FROM i FULL JOIN o USING (place)"""


def pair_net_flow(spark, d):
    return R.pair_flows(_moves(spark, d), "origin", "target")


PAIR_NET_FLOW = f"""WITH {MOVES}, p AS (SELECT least(origin, target) AS a, greatest(origin, target) AS b, count(*) AS moves, CAST(sum(CASE WHEN target > origin THEN 1 ELSE -1 END) AS BIGINT) AS net_to_b FROM mv WHERE origin <> target GROUP BY ALL)
SELECT *, CASE WHEN net_to_b > 0 THEN b WHEN net_to_b < 0 THEN a END AS importer, CASE WHEN net_to_b > 0 THEN a WHEN net_to_b < 0 THEN b END AS exporter FROM p"""


def quality_delta(spark, d):
    flows = R.flow_totals(_moves(spark, d), "origin", "target", "rating")
    rank = F.row_number().over(Window.orderBy(F.col("activity").desc(), "place")).cast("int")  # one row for each place
    angle = 2 * 3.141592653589793 * (F.col("place_rank") - 1) / 25
    return rounded(flows.select("place", "activity", "quality_delta", rank.alias("place_rank")).withColumn("x", F.cos(angle)).withColumn("y", F.sin(angle)))


QUALITY_DELTA = f"""WITH {PORTAL_FLOW_TOTALS.removeprefix('WITH ').replace('SELECT place,', ', f AS (SELECT place,', 1)}), r AS (SELECT place, activity, quality_delta, CAST(row_number() OVER (ORDER BY activity DESC, place) AS INTEGER) AS place_rank FROM f)
SELECT *, round(cos(2 * 3.141592653589793 * (place_rank - 1) / 25), 6) AS x, round(sin(2 * 3.141592653589793 * (place_rank - 1) / 25), 6) AS y FROM r"""


def union_universe(spark, d):
    g = games(spark, d)
    return g.select("season", F.col("home").alias("team")).union(g.select("season", "away")).distinct()


UNION_UNIVERSE = f"WITH {GAMES} SELECT season, home AS team FROM games UNION SELECT season, away FROM games"


def set_difference(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    only = c.select("c_nationkey").distinct().join(s.select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_anti").withColumn("kind", F.lit("customers only"))
    both = c.select("c_nationkey").intersect(s.select("s_nationkey")).withColumn("kind", F.lit("both"))
    return only.unionByName(both)


SET_DIFFERENCE = """SELECT *, 'customers only' AS kind FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT *, 'both' FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)"""


def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment")
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("c_acctbal")), allowMissingColumns=True)


def top_bottom_n(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    top = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).withColumn("end", F.lit("top"))
    return top.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(10).withColumn("end", F.lit("bottom")))


TOP_BOTTOM_N = """(SELECT o_orderkey, o_totalprice, 'top' AS "end" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)"""


def largest_misses(spark, d):
    p = predictions(spark, d).withColumn("miss", F.round(F.abs(F.col("predicted") - F.col("actual")), 6))
    return p.orderBy(F.col("miss").desc(), "event_id").limit(20).select("event_id", "miss")


def split_compound(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.concat_ws("-", F.col("o_orderkey") % 30, F.col("o_custkey") % 45)))
    made, tried = E.compound_part(F.col("text"), 1), E.compound_part(F.col("text"), 2)
    return rounded(o.select("o_orderkey", made.alias("made"), tried.alias("tried"), E.safe_div(made, tried).alias("rate")))


SPLIT_COMPOUND = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE (o_orderkey % 30) || '-' || (o_custkey % 45) END AS t FROM orders),
s AS (SELECT o_orderkey, TRY_CAST(split_part(t, '-', 1) AS INTEGER) AS made, TRY_CAST(split_part(t, '-', 2) AS INTEGER) AS tried FROM o)
SELECT o_orderkey, made, tried, round(made / nullif(tried, 0), 6) AS rate FROM s"""


def mmss_minutes(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.when(F.col("o_orderkey") % 11 == 0, "late").otherwise(F.format_string("%d:%02d", F.col("o_orderkey") % 60, F.col("o_custkey") % 60)))
    return rounded(o.select("o_orderkey", E.clock_minutes(F.col("text")).alias("minutes")))


MMSS_MINUTES = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN round(o_orderkey % 60 + (o_custkey % 60) / 60, 6) END AS minutes FROM orders"


def json_ids(spark, d):
    """The id in an event's JSON, three times: as it is, as "0" and as "", of which only the first counts."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    text = F.concat(F.lit('["'), F.col("k"), F.lit('", "0", "", null]'))
    out = e.select("event_id", F.explode_outer(E.json_ids(text)).alias("id"))
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


JSON_IDS = "SELECT CASE WHEN k <> '0' THEN k END AS id, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1"


def name_normalize(spark, d):
    c = table(spark, d, "customer")
    suffix = F.when(F.col("c_custkey") % 3 == 0, " Jr.").when(F.col("c_custkey") % 3 == 1, " III").otherwise("")
    raw = F.concat(F.lit("  José  O'"), "c_name", suffix)
    return c.select("c_custkey", E.normalize_name(raw).alias("name"), E.slug(F.col("c_name")).alias("slug"))


NAME_NORMALIZE = """SELECT c_custkey, 'jose o' || lower(c_name) AS name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer"""


def resolve_names(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("P. "), F.col("c_custkey") % 40).alias("name"))
    upper = F.when(F.col("c_custkey") % 2 == 0, F.upper("name")).otherwise(F.col("name"))
    asked = c.select("c_nationkey", F.col("c_custkey").alias("asked"), F.when(F.col("c_custkey") % 13 == 0, "nobody").otherwise(upper).alias("name"))
    roster = c.withColumnRenamed("c_custkey", "who")
    return J.resolve(asked, roster, ["c_nationkey"], "name", "who", E.normalize_name(F.col("name"))).select("asked", "who", "method")


RESOLVE_NAMES = """WITH c AS (SELECT c_nationkey, c_custkey, 'P. ' || (c_custkey % 40) AS name FROM customer),
a AS (SELECT c_nationkey, c_custkey AS asked, CASE WHEN c_custkey % 13 = 0 THEN 'nobody' WHEN c_custkey % 2 = 0 THEN upper(name) ELSE name END AS name FROM c),
e AS (SELECT c_nationkey, name, min(c_custkey) AS w, count(DISTINCT c_custkey) AS n FROM c GROUP BY ALL), l AS (SELECT c_nationkey, lower(replace(name, '.', '')) AS k, min(c_custkey) AS w, count(DISTINCT c_custkey) AS n FROM c GROUP BY ALL),
m AS (SELECT asked, e.w AS ew, l.w AS lw, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'ambiguous' WHEN l.n = 1 THEN 'normalized' WHEN l.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS method
 FROM a LEFT JOIN e USING (c_nationkey, name) LEFT JOIN l ON l.c_nationkey = a.c_nationkey AND l.k = lower(replace(a.name, '.', '')))
SELECT asked, CASE method WHEN 'exact' THEN ew WHEN 'normalized' THEN lw END AS who, method FROM m"""


def match_shares(spark, d):
    n = resolve_names(spark, d).groupBy((F.col("asked") % 5).cast("int").alias("season"), "method").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", share_of_total(["season"], "n")))


MATCH_SHARES = RESOLVE_NAMES.replace("SELECT asked, CASE method", ", z AS (SELECT asked, CASE method") + """)
SELECT CAST(asked % 5 AS INTEGER) AS season, method, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY asked % 5), 6) AS share FROM z GROUP BY asked % 5, method"""


def keep_latest_upsert(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 20 == 0, 0).otherwise(1_000_000_000)).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderstatus")
    return rounded(S.upsert(o, new, ["o_orderkey"]))


KEEP_LATEST_UPSERT = """WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 0 ELSE 1000000000 END AS o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderstatus FROM (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n)"""


def missing_slots(spark, d):
    o = table(spark, d, "orders").select(year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    calendar = o.select("season").distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return S.missing_slots(calendar, o.where("(season + week) % 5 <> 0"), ["season", "week"])


MISSING_SLOTS = """WITH o AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week FROM orders), c AS (SELECT DISTINCT season, CAST(unnest(range(1, 13)) AS INTEGER) AS week FROM o)
SELECT * FROM c EXCEPT SELECT * FROM o WHERE (season + week) % 5 <> 0"""


def insert_missing_dim(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return S.insert_missing(c.select(F.col("c_nationkey").alias("nation")).where("nation < 12").distinct(), s.select(F.col("s_nationkey").alias("nation")), ["nation"])


def pivot_categories(spark, d):
    flags = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.struct(F.concat(F.lit("flag"), F.upper("l_returnflag")).alias("category"), F.lit(1).alias("stat"))).alias("stats"))
    return S.flatten_payload(flags, ["l_suppkey"], "stats", ["flagA", "flagN", "flagR"])


PIVOT_CATEGORIES = """SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN 1 END) AS flag_a, max(CASE WHEN l_returnflag = 'N' THEN 1 END) AS flag_n, max(CASE WHEN l_returnflag = 'R' THEN 1 END) AS flag_r FROM lineitem GROUP BY 1"""


def fill_and_clip(spark, d):
    c = table(spark, d, "customer").withColumn("b", F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")))
    median = exact_quantiles(c, [], "b", [0.5], "q").select(F.col("q")[0].alias("m"))
    c = c.join(F.broadcast(median))
    return rounded(c.select("c_custkey", F.col("b").isNull().alias("b_missing"), F.coalesce("b", "m").alias("filled"), E.clip(F.col("b"), -500.0, 5000.0).alias("clipped"), F.coalesce("b", F.lit(0.0)).alias("zero_filled")))


FILL_AND_CLIP = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS b FROM customer), m AS (SELECT quantile_cont(b, 0.5) AS m FROM c)
SELECT c_custkey, b IS NULL AS b_missing, round(coalesce(b, m), 6) AS filled, round(CASE WHEN b IS NOT NULL THEN greatest(-500, least(5000, b)) END, 6) AS clipped, round(coalesce(b, 0), 6) AS zero_filled FROM c, m"""

QUERIES = {
    "asof_prior_event": asof_prior_event, "eligibility_gate": eligibility_gate, "zero_filled_target": zero_filled_target, "home_away_stack": home_away_stack, "home_away_pivot": home_away_pivot,
    "differential_trend": differential_trend, "opponent_self_join": opponent_self_join, "consensus_or_average": consensus_or_average, "best_of_two_matches": best_of_two_matches,
    "blue_chip_ratio": blue_chip_ratio, "roster_turnover": roster_turnover, "tenure_counts": tenure_counts, "portal_flow_totals": portal_flow_totals, "pair_net_flow": pair_net_flow,
    "quality_delta": quality_delta, "union_universe": union_universe, "set_difference": set_difference, "union_by_name": union_by_name, "top_bottom_n": top_bottom_n, "largest_misses": largest_misses,
    "split_compound": split_compound, "mmss_minutes": mmss_minutes, "json_ids": json_ids, "name_normalize": name_normalize, "resolve_names": resolve_names, "match_shares": match_shares,
    "keep_latest_upsert": keep_latest_upsert, "missing_slots": missing_slots, "insert_missing_dim": insert_missing_dim, "pivot_categories": pivot_categories,
    "fill_and_clip": fill_and_clip,
}
ORACLES = {
    "asof_prior_event": ASOF_PRIOR_EVENT, "eligibility_gate": ELIGIBILITY_GATE, "zero_filled_target": ZERO_FILLED_TARGET, "home_away_stack": f"WITH {GAMES}, {STACK} SELECT * FROM st", "home_away_pivot": HOME_AWAY_PIVOT,
    "differential_trend": DIFFERENTIAL_TREND, "opponent_self_join": OPPONENT_SELF_JOIN, "consensus_or_average": CONSENSUS_OR_AVERAGE, "best_of_two_matches": BEST_OF_TWO_MATCHES,
    "blue_chip_ratio": BLUE_CHIP_RATIO, "roster_turnover": ROSTER_TURNOVER, "tenure_counts": TENURE_COUNTS, "portal_flow_totals": PORTAL_FLOW_TOTALS, "pair_net_flow": PAIR_NET_FLOW, "quality_delta": QUALITY_DELTA,
    "union_universe": UNION_UNIVERSE, "set_difference": SET_DIFFERENCE,
    "union_by_name": "SELECT c_name AS name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier",
    "top_bottom_n": TOP_BOTTOM_N, "largest_misses": f"WITH {PREDICTIONS} SELECT event_id, round(abs(predicted - actual), 6) AS miss FROM pr ORDER BY miss DESC, event_id LIMIT 20",
    "split_compound": SPLIT_COMPOUND, "mmss_minutes": MMSS_MINUTES, "json_ids": JSON_IDS, "name_normalize": NAME_NORMALIZE, "resolve_names": RESOLVE_NAMES, "match_shares": MATCH_SHARES,
    "keep_latest_upsert": KEEP_LATEST_UPSERT, "missing_slots": MISSING_SLOTS,
    "insert_missing_dim": "SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey < 12 UNION SELECT s_nationkey FROM supplier", "pivot_categories": PIVOT_CATEGORIES,
    "fill_and_clip": FILL_AND_CLIP,
}
