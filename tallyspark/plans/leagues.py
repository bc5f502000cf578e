"""Teams through seasons: schedules, rosters, leaders, pools of opponents, sweeps, thresholds by fold, and checks of what was loaded."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import aggregates as A
from ..operators import checks as C
from ..operators import features as X
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import ratings as T
from ..operators import rosters as R
from ..sources.tables import table
from .common import GAMES, PLAYS, PREDICTIONS, games, plays, predictions, rounded, year
from .evaluation import _MARGINS, _margins, _srs_sql
from .relations import RESOLVE_NAMES, STACK, home_away_stack, resolve_names

_BIGINT = "CAST(coalesce(count_if({}), 0) AS BIGINT) AS {}"


def defense_allowed(spark, d):
    """What the defence of each game allowed on runs."""
    p = plays(spark, d).where("kind = 'run'").withColumn("success", E.is_success(F.col("down"), F.col("distance"), F.col("gained"))).withColumn("stuffed", F.col("gained") <= 5)
    return rounded(A.allowed_by_game(p, ["game", "opponent", "season"], 15.0))


DEFENSE_ALLOWED = f"""WITH {PLAYS}, q AS (SELECT *, coalesce(distance > 0 AND gained >= CASE down WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1.0 END * distance, FALSE) AS ok FROM plays WHERE is_run)
SELECT game, opponent, season, round(avg(CAST(ok AS INTEGER)), 6) AS success_rate_allowed, CAST(count_if(gained >= 15) AS BIGINT) AS explosives_allowed, round(avg(value), 6) AS value_per_play_allowed,
 round(avg(CAST(gained <= 5 AS INTEGER)), 6) AS stuffed_rate_forced, round(count_if(gained >= 15) / nullif(count(gained), 0), 6) AS explosive_rate_allowed FROM q GROUP BY ALL"""


def matchup_adjusted(spark, d):
    """Each game's sides: own scoring less what the other allows, and a rate of close games that is 0 where a side has none."""
    rows = home_away_stack(spark, d).withColumns({"close": F.abs(F.col("points") - F.col("allowed")) <= 3, "won": F.col("points") > F.col("allowed")})
    cols = {"points": F.avg("points"), "points_allowed": F.avg("allowed"), "close": F.count_if("close"), "close_won": F.count_if(F.col("close") & F.col("won")), "close_lost": F.count_if(F.col("close") & ~F.col("won"))}
    team = rows.groupBy("team", "season").agg(*[x.alias(n) for n, x in cols.items()])
    g = J.attach_sides(games(spark, d).select("game", "season", "home", "away"), team, "team", "home", "away", list(cols), ["season"])
    adjusted = E.opponent_adjusted([("points", "points_allowed")], [("close_rate", "close_won", "close", "close_lost", "close")])
    return rounded(g.select("game", *[x.alias(n) for n, x in adjusted.items()]))


MATCHUP_ADJUSTED = f"""WITH {GAMES}, {STACK}, t AS (SELECT team, season, avg(points) AS p, avg(allowed) AS a, count_if(abs(points - allowed) <= 3) AS c, count_if(abs(points - allowed) <= 3 AND points > allowed) AS w,
 count_if(abs(points - allowed) <= 3 AND points <= allowed) AS l FROM st GROUP BY ALL)
SELECT game, round(h.p - a.a, 6) AS home_adjusted_points, round(a.p - h.a, 6) AS away_adjusted_points, round(coalesce(h.w / nullif(h.c, 0), 0) - coalesce(a.l / nullif(a.c, 0), 0), 6) AS home_adjusted_close_rate,
 round(coalesce(a.w / nullif(a.c, 0), 0) - coalesce(h.l / nullif(h.c, 0), 0), 6) AS away_adjusted_close_rate
FROM games LEFT JOIN t h ON h.team = home AND h.season = games.season LEFT JOIN t a ON a.team = away AND a.season = games.season"""


def cover_labels(spark, d):
    g = games(spark, d).select("game", (F.col("home_points") - F.col("away_points")).alias("margin"), (F.col("game") % 15 - 7).alias("line"))
    return g.select("game", E.cover_label(F.col("margin"), F.col("line")).alias("covers"))


COVER_LABELS = f"""WITH {GAMES}, l AS (SELECT game, home_points - away_points AS m, game % 15 - 7 AS line FROM games)
SELECT game, CASE WHEN m + line = 0 OR line = 0 THEN NULL WHEN (m + line > 0) = (line < 0) THEN 'favourite' ELSE 'underdog' END AS covers FROM l"""


def schedule_features(spark, d):
    """21 features of each team's season; opponents count by what they were in the season before."""
    c = F.col
    g = games(spark, d).join(table(spark, d, "orders").select(c("o_orderkey").alias("game"), c("o_orderdate").alias("date")), "game")
    rows = J.stack_sides(g, ["game", "season", "week", "date", "neutral"], {"team": "home", "opponent": "away", "points": "home_points", "allowed": "away_points"}, {"team": "away", "opponent": "home", "points": "away_points", "allowed": "home_points"})
    prior = rows.groupBy(c("team").alias("opponent"), (c("season") + 1).alias("season")).agg(F.avg(E.flag(c("points") > c("allowed"))).alias("prior_pct"))
    talent = lambda team, season: F.when((c(team) + season) % 7 != 0, ((c(team) * 37 + season * 11) % 100).cast("double"))
    power = c("opponent").isin(1, 2, 3) | ((c("season") >= 1996) & (c("opponent") == 4))
    sub = c("opponent") % 6 == 5
    rows = rows.join(prior, ["opponent", "season"], "left").withColumns({
        "is_road": ~c("is_first") & ~c("neutral"), "is_home": c("is_first") & ~c("neutral"), "conference": c("team") % 5 == c("opponent") % 5, "power": power, "sub": sub,
        "prior_talent": talent("opponent", c("season") - 1), "own_talent": talent("team", c("season")), "prior_returning": ((c("opponent") * 13 + c("season")) % 50) / F.lit(50.0),
    })
    return rounded(A.schedule_summary(rows, ["team", "season"], 4, 9))


SCHEDULE_FEATURES = f"""WITH {GAMES}, {STACK}, pr AS (SELECT team AS opponent, season + 1 AS season, avg(CAST(points > allowed AS INTEGER)) AS pct FROM st GROUP BY ALL),
r AS (SELECT st.*, o_orderdate AS dt, neutral, pct, is_home AND NOT neutral AS h, NOT is_home AND NOT neutral AS road, team % 5 = opponent % 5 AS conf, opponent IN (1, 2, 3) OR (season >= 1996 AND opponent = 4) AS power, opponent % 6 = 5 AS sub,
 CASE WHEN (opponent + season - 1) % 7 <> 0 THEN CAST((opponent * 37 + (season - 1) * 11) % 100 AS DOUBLE) END AS pt, CASE WHEN (team + season) % 7 <> 0 THEN CAST((team * 37 + season * 11) % 100 AS DOUBLE) END AS own,
 ((opponent * 13 + season) % 50) / 50.0 AS ret FROM st JOIN orders ON o_orderkey = game JOIN (SELECT game, neutral FROM games) USING (game) LEFT JOIN pr USING (opponent, season)),
w AS (SELECT *, date_sub('day', lag(dt) OVER o, dt) AS gap, coalesce(lag(road) OVER o, FALSE) AND road AS again FROM r WINDOW o AS (PARTITION BY team, season ORDER BY dt, game))
SELECT team, season, count(*) AS games, {", ".join(_BIGINT.format(c, n) for c, n in (("h", "home"), ("road", "road"), ("neutral", "neutral"), ("conf", "conference"), ("power", "power"), ("NOT power AND NOT sub", "middle"), ("sub", "sub"), ("pt > own", "above_own_talent"), ("gap > 10", "byes"), ("gap < 6", "short_rests"), ("again", "road_again"), ("NOT conf", "nonconference")))},
 round(avg(pct), 6) AS avg_prior_pct, round(avg(pt), 6) AS avg_prior_talent, max(pt) AS max_prior_talent, round(avg(ret), 6) AS avg_prior_returning, CAST(sum(CAST(power AS INTEGER)) FILTER (WHERE week <= 4) AS BIGINT) AS power_early,
 CAST(sum(CAST(power AS INTEGER)) FILTER (WHERE week >= 9) AS BIGINT) AS power_late, round(avg(pt) FILTER (WHERE conf), 6) AS talent_conference, round(avg(pt) FILTER (WHERE NOT conf), 6) AS talent_nonconference FROM w GROUP BY ALL"""


def _roster(spark, d):
    """Customers as members of the team that their month's clerk gives, by season, with a role; ratings for some."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), year("o_orderdate").alias("season"), F.month("o_orderdate").alias("m"))
    rows = o.groupBy("who", "season").agg(F.min("m").alias("m"))
    rows = rows.select("who", "season", ((F.col("who") + F.floor(F.col("m") / 5)) % 20).cast("int").alias("team"), F.when(F.col("who") % 7 == 0, "lead").otherwise("other").alias("role"))
    ratings = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("who"), (F.col("c_custkey") % 90 / 100).alias("rating"))
    return rows, ratings


_ROSTER = """ro AS (SELECT o_custkey AS who, CAST(year(o_orderdate) AS INTEGER) AS season, min(month(o_orderdate)) AS m FROM orders GROUP BY ALL),
r AS (SELECT who, season, CAST((who + m // 5) % 20 AS INTEGER) AS team, CASE WHEN who % 7 = 0 THEN 'lead' ELSE 'other' END AS role FROM ro), ra AS (SELECT c_custkey AS who, c_custkey % 90 / 100 AS rating FROM customer WHERE c_custkey % 4 <> 0)"""


def rated_turnover(spark, d):
    rows, ratings = _roster(spark, d)
    return rounded(R.rated_turnover(rows, ratings, "who", "team", "season", ("role", "lead")))


RATED_TURNOVER = f"""WITH {_ROSTER}, s AS (SELECT DISTINCT season FROM r WHERE season - 1 IN (SELECT season FROM r)),
b AS (SELECT season, n.team AS now, p.team AS before, p.role AS prole, rating FROM r n FULL JOIN (SELECT who, season + 1 AS season, team, role FROM r) p USING (who, season) LEFT JOIN ra USING (who) WHERE season IN (SELECT season FROM s)),
o AS (SELECT before AS team, season, count(*) AS size_before, count_if(now = before) AS stayed, count_if(now IS DISTINCT FROM before) AS departed, count_if(now <> before) AS transferred_out, count_if(now IS DISTINCT FROM before AND prole = 'lead') AS k,
 coalesce(sum(rating) FILTER (WHERE now <> before), 0) AS ro FROM b WHERE before IS NOT NULL GROUP BY ALL),
i AS (SELECT now AS team, season, count(*) AS size_now, count_if(before IS DISTINCT FROM now) AS incoming, count_if(now <> before) AS transferred_in, coalesce(sum(rating) FILTER (WHERE now <> before), 0) AS ri FROM b WHERE now IS NOT NULL GROUP BY ALL)
SELECT team, season, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("size_before", "stayed", "departed", "transferred_out", "size_now", "incoming", "transferred_in"))}, coalesce(k, 0) > 0 AS key_departed,
 round(coalesce(ri, 0) - coalesce(ro, 0), 6) AS net_transfer_rating, round(coalesce(stayed, 0) / nullif(coalesce(size_before, 0), 0), 6) AS stayed_share, round(coalesce(departed, 0) / nullif(coalesce(size_before, 0), 0), 6) AS turnover_share
FROM o FULL JOIN i USING (team, season)"""


def arrivals_and_departures(spark, d):
    rows, ratings = _roster(spark, d)
    return rounded(R.arrivals_and_departures(rows, ratings, "who", "team", "season"))


ARRIVALS = f"""WITH {_ROSTER}, i AS (SELECT team, season, count(*) AS n, coalesce(sum(rating), 0) AS x FROM r LEFT JOIN ra USING (who) WHERE (who, season - 1) NOT IN (SELECT (who, season) FROM r) GROUP BY ALL),
o AS (SELECT team, season + 1 AS season, count(*) AS n, coalesce(sum(rating), 0) AS x FROM r LEFT JOIN ra USING (who) WHERE (who, season + 1) NOT IN (SELECT (who, season) FROM r) AND season + 1 IN (SELECT season FROM r) GROUP BY ALL)
SELECT team, season, CAST(coalesce(i.n, 0) AS BIGINT) AS arrivals, CAST(coalesce(o.n, 0) AS BIGINT) AS departures, round(coalesce(i.x, 0) - coalesce(o.x, 0), 6) AS net_rating FROM i FULL JOIN o USING (team, season)"""


def tenure_lookback(spark, d):
    """Roster experience of the seasons from 1995 on, counting back two seasons before the first of them."""
    rows, _ = _roster(spark, d)
    years = R.tenure(rows, "who", "season", (1995, 1998), 2)
    out = rows.join(years, ["who", "season"])
    return rounded(out.groupBy("team", "season").agg(F.avg("tenure").alias("experience"), F.avg((F.col("tenure") >= 2).cast("int")).alias("veteran_share")))


TENURE_LOOKBACK = f"""WITH {_ROSTER}, t AS (SELECT *, count(*) OVER (PARTITION BY who ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM r WHERE season BETWEEN 1993 AND 1998)
SELECT team, season, round(avg(n), 6) AS experience, round(avg(CAST(n >= 2 AS INTEGER)), 6) AS veteran_share FROM t WHERE season >= 1995 GROUP BY ALL"""


def leader_tenure(spark, d):
    """The supplier with the most lines of each nation and season as its leader."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("who"), year("l_shipdate").alias("season"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("who"), F.col("s_nationkey").alias("team"))
    lines = li.groupBy("who", "season").agg(F.count(F.lit(1)).alias("n")).join(s, "who")
    leaders = lines.groupBy("team", "season").agg(F.min(F.struct(-F.col("n"), "who"))["who"].alias("who"))
    return R.leader_tenure(leaders, "team", "season", "who", 1992)


LEADER_TENURE = """WITH n AS (SELECT s_nationkey AS team, CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey AS who, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
l AS (SELECT team, season, who FROM n QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY n DESC, who) = 1), t AS (SELECT *, min(season) OVER (PARTITION BY team, who ORDER BY season) AS since FROM l)
SELECT t.team, t.season, t.who, since, coalesce(p.who <> t.who, FALSE) AS changed, t.season - since AS years, since <= 1992 AS censored, t.season = since AS first_year FROM t LEFT JOIN l p ON p.team = t.team AND p.season = t.season - 1"""


def committed_members(spark, d):
    """Members who are on the team that they committed to: a join on the member and on the team."""
    rows, ratings = _roster(spark, d)
    promised = ratings.withColumn("team", (F.col("who") % 20).cast("int"))
    return rounded(rows.join(promised, ["who", "team"]).groupBy("team", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("rating")))


COMMITTED_MEMBERS = f"WITH {_ROSTER} SELECT r.team, r.season, count(*) AS n, round(avg(rating), 6) AS rating FROM r JOIN ra ON ra.who = r.who AND CAST(ra.who % 20 AS INTEGER) = r.team GROUP BY ALL"


def mean_transfers(spark, d):
    """Mean number of transfers in and out of a team, by season."""
    rows, ratings = _roster(spark, d)
    t = R.rated_turnover(rows, ratings, "who", "team", "season", ("role", "lead"))
    return rounded(t.groupBy("season").agg(F.avg(F.col("transferred_in") + F.col("transferred_out")).alias("mean_transfers")))


MEAN_TRANSFERS = f"SELECT season, round(avg(transferred_in + transferred_out), 6) AS mean_transfers FROM ({RATED_TURNOVER}) GROUP BY 1"


def valid_years(spark, d):
    """Class years outside 1 to 5 count as unknown."""
    o = table(spark, d, "orders").select(year("o_orderdate").alias("season"), (F.col("o_custkey") % 8).alias("class"))
    valid = F.when(F.col("class").between(1, 5), F.col("class"))
    return rounded(o.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count(valid).alias("known"), F.avg(valid).alias("mean_class")))


VALID_YEARS = "SELECT CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n, CAST(count_if(o_custkey % 8 BETWEEN 1 AND 5) AS BIGINT) AS known, round(avg(o_custkey % 8) FILTER (WHERE o_custkey % 8 BETWEEN 1 AND 5), 6) AS mean_class FROM orders GROUP BY 1"


def leaked_seasons(spark, d):
    o = table(spark, d, "orders").select(year("o_orderdate").alias("season"), F.when(F.col("o_orderkey") % 16 == 0, year("o_orderdate").cast("long")).when(F.col("o_orderkey") % 16 < 12, F.col("o_custkey") % 5).alias("class"))
    return C.leaked_periods(o, "season", "class")


LEAKED_SEASONS = """WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CASE WHEN o_orderkey % 16 = 0 THEN year(o_orderdate) WHEN o_orderkey % 16 < 12 THEN o_custkey % 5 END AS class FROM orders)
SELECT season, CAST(class AS BIGINT) AS class, count(*) AS n, season = class AS leaked FROM o WHERE class IS NOT NULL GROUP BY ALL"""


def weighted_match_rate(spark, d):
    rows = resolve_names(spark, d).select((F.col("asked") % 5).cast("int").alias("season"), "method", (F.col("asked") % 10 + 1).cast("double").alias("weight"))
    return rounded(C.weighted_match_rate(rows, ["season"], "method", "weight"))


WEIGHTED_MATCH_RATE = f"""WITH w AS (SELECT CAST(asked % 5 AS INTEGER) AS season, method, asked % 10 + 1.0 AS w FROM ({RESOLVE_NAMES})),
x AS (SELECT season, coalesce(sum(w) FILTER (WHERE method IN ('exact', 'normalized')), 0) / sum(w) AS m, coalesce(sum(w) FILTER (WHERE method = 'unmatched'), 0) / sum(w) AS u FROM w GROUP BY 1)
SELECT season, round(m, 6) AS matched_rate, round(u, 6) AS unmatched_rate, CASE WHEN u > 0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM x"""


def far_values(spark, d):
    return rounded(C.far_values(table(spark, d, "lineitem").withColumn("odd", F.when(F.col("l_orderkey") % 5000 == 1, 1e6).otherwise(F.col("l_quantity"))), ["l_quantity", "odd"]))


FAR_VALUES = """WITH l AS (SELECT l_quantity AS a, CASE WHEN l_orderkey % 5000 = 1 THEN 1e6 ELSE l_quantity END AS b FROM lineitem), s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM l)
SELECT 'l_quantity' AS "column", CAST(count_if(abs(a - ma) / nullif(sa, 0) > 6) AS BIGINT) AS n, round(max(abs(a - ma) / nullif(sa, 0)), 6) AS max_z FROM l, s UNION ALL SELECT 'odd', CAST(count_if(abs(b - mb) / nullif(sb, 0) > 6) AS BIGINT), round(max(abs(b - mb) / nullif(sb, 0)), 6) FROM l, s"""


def wrong_labels(spark, d):
    return C.wrong_values(table(spark, d, "lineitem"), {"l_returnflag": ["A", "N"], "l_linenumber": [1, 2, 3, 4, 5]})


WRONG_LABELS = """SELECT 'l_returnflag' AS "column", CAST(count_if(coalesce(l_returnflag NOT IN ('A', 'N'), TRUE)) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(count_if(coalesce(l_linenumber NOT BETWEEN 1 AND 5, TRUE)) AS BIGINT) FROM lineitem"""


def pool_ratings(spark, d):
    """Ratings of 20 teams; the other five are one pool of a fixed rating."""
    rated = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("team"))
    return rounded(T.rate(T.with_pool(_margins(spark, d), rated, "season"), "season", 4))


POOL_RATINGS = f"""WITH {_MARGINS}, po AS (SELECT season, -avg(margin) AS r FROM mg WHERE team < 20 AND opponent >= 20 GROUP BY 1),
mw AS (SELECT mg.season, team, CASE WHEN opponent < 20 THEN opponent END AS opponent, margin + CASE WHEN opponent < 20 THEN 0 ELSE r END AS margin FROM mg LEFT JOIN po ON po.season = mg.season WHERE team < 20), {_srs_sql(4, 'mw')}"""


def fixed_opponents(spark, d):
    """Ratings where two opponents have a rating that never changes."""
    rows = _margins(spark, d).where("team not in (3, 7)")
    fixed = table(spark, d, "nation").where("n_nationkey in (3, 7)").select(F.col("n_nationkey").alias("opponent"), (F.col("n_nationkey") * 2.5 - 10).cast("double").alias("rating"))
    return rounded(T.rate(T.with_fixed(rows, fixed), "season", 4))


FIXED_OPPONENTS = f"""WITH {_MARGINS}, mw AS (SELECT season, team, CASE WHEN opponent NOT IN (3, 7) THEN opponent END AS opponent, margin + CASE WHEN opponent IN (3, 7) THEN opponent * 2.5 - 10 ELSE 0 END AS margin FROM mg WHERE team NOT IN (3, 7)), {_srs_sql(4, 'mw')}"""

_WEEKS, _KS = [3, 6, 9, 12], [0, 4]


def _sweep(spark, d):
    g = games(spark, d).withColumn("margin", (F.col("home_points") - F.col("away_points")).cast("double"))
    rows = J.stack_sides(g.withColumn("lost", -F.col("margin")), ["season", "week"], {"team": "home", "opponent": "away", "margin": "margin"}, {"team": "away", "opponent": "home", "margin": "lost"})
    priors = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("team"), (F.col("n_nationkey").cast("double") - 10).alias("rating"))
    return g, X.swept_ratings(rows.drop("is_first"), priors, "season", "week", _WEEKS, _KS, 2)


_SWEEP = f"""{GAMES}, st AS (SELECT season, week, home AS team, away AS opponent, home_points - away_points AS margin FROM games UNION ALL SELECT season, week, away, home, away_points - home_points FROM games),
pri AS (SELECT n_nationkey AS team, n_nationkey - 10.0 AS rating FROM nation WHERE n_nationkey % 4 <> 0), gr AS (SELECT * FROM (SELECT unnest({_WEEKS}) AS as_of), (SELECT unnest({_KS}) AS k)),
gm AS (SELECT st.season * 1000000 + as_of * 1000 + k AS season, team, opponent, CAST(margin AS DOUBLE) AS margin, k FROM st JOIN gr ON week < as_of), te AS (SELECT DISTINCT season, team, k FROM gm),
mw AS (SELECT season, team, opponent, margin, 1.0 AS wt FROM gm UNION ALL SELECT season, team, NULL, coalesce(rating, (SELECT avg(rating) FROM pri)), CAST(k AS DOUBLE) FROM te LEFT JOIN pri USING (team))"""


def swept_ratings(spark, d):
    return rounded(_sweep(spark, d)[1])


_SWEPT = f"WITH {_SWEEP}, {_srs_sql(2, 'mw', 'm.wt')}".replace("round(rating, 6) AS rating", "rating")
SWEPT_RATINGS = f"SELECT CAST(season // 1000000 AS INTEGER) AS season, CAST(season // 1000 % 1000 AS INTEGER) AS as_of, CAST(season % 1000 AS INTEGER) AS k, team, round(rating, 6) AS rating FROM ({_SWEPT})"


def sweep_phases(spark, d):
    """Mean absolute error of each week's projected margins, over all, early and late weeks, for every weight of the prior."""
    g, ratings = _sweep(spark, d)
    g = g.select("season", F.col("week").alias("as_of"), "home", "away", "margin")
    for side in ("home", "away"):
        g = g.join(ratings.select("season", "as_of", "k", F.col("team").alias(side), F.col("rating").alias(f"{side}_rating")), ["season", "as_of", side, *(["k"] if side == "away" else [])])
    weekly = g.groupBy("k", "season", "as_of").agg(F.avg(F.abs(F.col("home_rating") - F.col("away_rating") - F.col("margin"))).alias("mae"))
    return rounded(X.phase_means(weekly, ["k"], "as_of", ["mae"], 6))


SWEEP_PHASES = f"""WITH sr AS (SELECT season // 1000000 AS season, season // 1000 % 1000 AS as_of, season % 1000 AS k, team, rating FROM ({_SWEPT})), {GAMES},
wk AS (SELECT h.k, games.season, week, avg(abs(h.rating - a.rating - (home_points - away_points))) AS mae FROM games JOIN sr h ON h.team = home AND h.season = games.season AND h.as_of = week JOIN sr a ON a.team = away AND a.season = games.season AND a.as_of = week AND a.k = h.k GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, round(avg(mae), 6) AS mae_all, round(avg(mae) FILTER (WHERE week <= 6), 6) AS mae_early, round(avg(mae) FILTER (WHERE week > 6), 6) AS mae_late FROM wk GROUP BY 1"""


def fit_quality_weight(spark, d):
    rows = home_away_stack(spark, d).withColumn("z", (F.col("opponent") - 12) / F.lit(7.0))
    actual = rows.groupBy("team", "season").agg(F.avg(E.flag(F.col("points") > F.col("allowed"))).alias("y"))
    return rounded(T.fit_quality_weight(rows, ["team", "season"], "points", "allowed", "z", actual, rounds=1))


FIT_QUALITY_WEIGHT = f"""WITH {GAMES}, {STACK}, al AS (SELECT -0.3 + 0.6 * i / 12 AS alpha FROM range(13) AS t(i)), s AS (SELECT alpha, team, season, sum(points * (1 + alpha * (opponent - 12) / 7.0)) AS p, sum(allowed / (1 + alpha * (opponent - 12) / 7.0)) AS a,
 avg(CAST(points > allowed AS INTEGER)) AS y FROM st, al GROUP BY ALL), e AS (SELECT alpha, avg((y - p ** 2 / nullif(p ** 2 + a ** 2, 0)) ** 2) AS mse FROM s GROUP BY 1) SELECT round(alpha, 6) AS alpha, round(mse, 6) AS mse FROM e ORDER BY e.mse, e.alpha LIMIT 1"""


def score_at_coverage(spark, d):
    return rounded(M.score_at_coverage(predictions(spark, d), ["event_type", "season"], "score", 0.15))


SCORE_AT_COVERAGE = f"""WITH {PREDICTIONS}, r AS (SELECT event_type, season, score, row_number() OVER (PARTITION BY event_type, season ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY event_type, season) AS n FROM pr)
SELECT event_type, season, n, round(score, 6) AS threshold FROM r WHERE k = greatest(1, ceil(0.15 * n))"""


def threshold_for_every_fold(spark, d):
    grid = M.threshold_grid(predictions(spark, d), ["event_type", "season"], "label", "score", [0.1, 0.3, 0.5, 0.7, 0.9])
    return rounded(M.threshold_for_every_fold(grid, ["event_type"], 0.2))


THRESHOLD_FOR_EVERY_FOLD = f"""WITH {PREDICTIONS}, g AS (SELECT event_type, season, th AS threshold, count_if(score >= th) / count(*) AS cov, coalesce(count_if(score >= th AND label = 1) / nullif(count_if(score >= th), 0), 0) AS pre FROM pr, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS th) GROUP BY ALL),
s AS (SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, avg(pre) AS mp, avg(cov) AS mc, min(cov) AS lc, CAST(count_if(cov >= 0.2) AS BIGINT) AS met, count(*) AS folds FROM g GROUP BY ALL)
SELECT event_type, threshold, round(mp, 6) AS mean_precision, round(mc, 6) AS mean_coverage, round(lc, 6) AS min_coverage, met AS folds_met, folds, met = folds AS every_fold FROM s
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (met = folds) DESC, met DESC, mp DESC, threshold) = 1"""


def precision_recall(spark, d):
    return rounded(M.precision_recall_curve(predictions(spark, d), "label", "score"))


PRECISION_RECALL = f"""WITH {PREDICTIONS}, c AS (SELECT score, sum(label) AS p, count(*) AS n FROM pr GROUP BY 1), a AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS s, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 6) AS threshold, round(tp / nullif(s, 0), 6) AS "precision", round(tp / nullif(pp, 0), 6) AS recall, round(s / nullif(nn, 0), 6) AS coverage FROM a"""


def correlation_matrix_long(spark, d):
    """A wide correlation matrix as (a, b, corr), both orders of every pair."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, d, "lineitem")
    one = li.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in cols for b in cols if a != b])
    long = one.unpivot([], one.columns, "pair", "corr")
    return rounded(long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "corr"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORRELATION_LONG = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _CORR for b in _CORR if a != b)

QUERIES = {
    "defense_allowed": defense_allowed, "matchup_adjusted": matchup_adjusted, "cover_labels": cover_labels, "schedule_features": schedule_features, "rated_turnover": rated_turnover,
    "arrivals_and_departures": arrivals_and_departures, "tenure_lookback": tenure_lookback, "leader_tenure": leader_tenure, "committed_members": committed_members, "mean_transfers": mean_transfers,
    "valid_years": valid_years, "leaked_seasons": leaked_seasons, "weighted_match_rate": weighted_match_rate, "far_values": far_values, "wrong_labels": wrong_labels, "pool_ratings": pool_ratings,
    "fixed_opponents": fixed_opponents, "swept_ratings": swept_ratings, "sweep_phases": sweep_phases, "fit_quality_weight": fit_quality_weight, "score_at_coverage": score_at_coverage,
    "threshold_for_every_fold": threshold_for_every_fold, "precision_recall": precision_recall, "correlation_matrix_long": correlation_matrix_long,
}
ORACLES = {
    "defense_allowed": DEFENSE_ALLOWED, "matchup_adjusted": MATCHUP_ADJUSTED, "cover_labels": COVER_LABELS, "schedule_features": SCHEDULE_FEATURES, "rated_turnover": RATED_TURNOVER,
    "arrivals_and_departures": ARRIVALS, "tenure_lookback": TENURE_LOOKBACK, "leader_tenure": LEADER_TENURE, "committed_members": COMMITTED_MEMBERS, "mean_transfers": MEAN_TRANSFERS,
    "valid_years": VALID_YEARS, "leaked_seasons": LEAKED_SEASONS, "weighted_match_rate": WEIGHTED_MATCH_RATE, "far_values": FAR_VALUES, "wrong_labels": WRONG_LABELS, "pool_ratings": POOL_RATINGS,
    "fixed_opponents": FIXED_OPPONENTS, "swept_ratings": SWEPT_RATINGS, "sweep_phases": SWEEP_PHASES, "fit_quality_weight": FIT_QUALITY_WEIGHT, "score_at_coverage": SCORE_AT_COVERAGE,
    "threshold_for_every_fold": THRESHOLD_FOR_EVERY_FOLD, "precision_recall": PRECISION_RECALL, "correlation_matrix_long": CORRELATION_LONG,
}
