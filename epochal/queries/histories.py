"""Queries of episodes, survivor functions, rate models and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes, rates, sequences, survival
from .registry import plain, query, table

#: Days from order to shipping; an event if the item was returned.
_EPISODES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderpriority AS grp, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::DOUBLE AS tf, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS d, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 0"


def shipping(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.col("o_orderpriority").alias("grp"))
    rows = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return episodes.checked(episodes.define(rows, F.lit(0), days, 0, F.when(F.col("l_returnflag") == "R", 1).otherwise(0), "l_orderkey", 1, keep=["grp", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]))


def visits(spark, sf_dir):
    """Spells of users between events: states by the kind of event, time in hours."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("t"), (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("state"))
    return e


_VISITS = "SELECT event_id, user_id, epoch_us(ts) / 3.6e9 - 473352 AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS state FROM events"
_SPELLS = f"SELECT user_id AS id, state AS org, t AS ts, lead(t) OVER w AS tf, lead(state) OVER w AS des, row_number() OVER w AS sn FROM ({_VISITS}) WINDOW w AS (PARTITION BY user_id ORDER BY t, state)"


@query(f"SELECT 1::BIGINT AS sn, 0::BIGINT AS org, d::BIGINT AS des, count(*) AS episodes, round(sum(tf), 3) AS duration, round(avg(tf), 6) AS mean_duration FROM ({_EPISODES}) GROUP BY d")
def transitions(spark, sf_dir):
    out = episodes.transitions(shipping(spark, sf_dir))
    return plain(out.withColumn("duration", F.round("duration", 3)))


@query("""
    WITH e AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS tf FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT count(*) AS rows, 0::BIGINT AS negative_start, count(*) FILTER (tf <= 0) AS empty, 0::BIGINT AS bad_state, 0::BIGINT AS bad_number, 0::BIGINT AS missing FROM e""".replace("AS rows", 'AS "rows"'))
def invalid_episodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    return plain(episodes.invalid(episodes.define(rows, F.lit(0), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))))


@query(f"""
    WITH e AS ({_EPISODES}), c AS (SELECT *, list_sort(list_distinct(list_filter([100.0, 500.0, 1000.0, q * 10], lambda x: x > 0 AND x < tf))) AS cuts FROM e), b AS (SELECT *, list_concat([0.0], cuts, [tf]) AS b FROM c),
    p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, d, b, unnest(generate_series(1, len(b) - 1)) AS k FROM b)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, k AS split_no, round(b[k], 6) AS ts, round(b[k + 1], 6) AS tf, CASE WHEN k = len(b) - 1 THEN d ELSE 0 END::BIGINT AS des FROM p""")
def episode_splits(spark, sf_dir):
    e = shipping(spark, sf_dir).withColumn("mark", F.col("l_quantity") * 10)
    return plain(episodes.split(e, ["mark"], [100, 500, 1000]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "split_no", "ts", "tf", "des"))


@query(f"""
    WITH s AS ({_SPELLS}), p AS (SELECT unnest([50.0, 200.0, 400.0, 600.0])::DOUBLE AS u), f AS (SELECT p.u, s.id, arg_min(s.org, s.sn) AS state FROM s JOIN p ON s.ts <= p.u AND p.u < s.tf WHERE s.tf IS NOT NULL GROUP BY p.u, s.id),
    n AS (SELECT count(DISTINCT id) AS n FROM s WHERE tf IS NOT NULL)
    SELECT u AS "at", state::BIGINT AS state, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT p.u, NULL, any_value(n.n) - count(f.id) FROM p CROSS JOIN n LEFT JOIN f ON f.u = p.u GROUP BY p.u""")
def states_at(spark, sf_dir):
    return plain(episodes.states_at(episodes.from_events(visits(spark, sf_dir), "user_id", "t", "state"), [50, 200, 400, 600]))


@query(f"""
    WITH s AS ({_SPELLS}), p AS (SELECT DISTINCT user_id AS id, unnest([100.0, 300.0, 500.0])::DOUBLE AS at FROM events)
    SELECT p.id, p.at, (SELECT arg_max(CASE WHEN p.at < s.tf THEN s.org END, s.ts) FROM s WHERE s.id = p.id AND s.ts <= p.at AND s.tf IS NOT NULL)::BIGINT AS state FROM p""")
def state_as_of(spark, sf_dir):
    v = visits(spark, sf_dir)
    points = v.select(F.col("user_id").alias("id")).distinct().withColumn("at", F.explode(F.array(*[F.lit(x) for x in (100.0, 300.0, 500.0)])))
    return plain(episodes.state_as_of(episodes.from_events(v, "user_id", "t", "state"), points))


@query(f"SELECT id, org::BIGINT AS org, des::BIGINT AS des, round(ts, 6) AS ts, round(tf, 6) AS tf, sn FROM ({_SPELLS}) WHERE tf IS NOT NULL")
def spells_from_events(spark, sf_dir):
    return plain(episodes.from_events(visits(spark, sf_dir), "user_id", "t", "state"))


@query(f"""
    WITH e AS ({_EPISODES}), t AS (SELECT grp, tf AS time, sum(d)::DOUBLE AS events, count(*)::DOUBLE AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS risk, sum(n - events) OVER (PARTITION BY grp ORDER BY time) - (n - events) AS cens FROM t),
    s AS (SELECT *, sum(CASE WHEN events < risk THEN ln(1 - events / risk) ELSE 0 END) OVER w AS lg, max(CASE WHEN events >= risk THEN 1 ELSE 0 END) OVER w AS z, sum(CASE WHEN events < risk THEN events / (risk * (risk - events)) ELSE 0 END) OVER w AS g, cens - coalesce(lag(cens) OVER w, 0) AS censored FROM r WHERE events > 0 WINDOW w AS (PARTITION BY grp ORDER BY time))
    SELECT grp, time, events, censored, risk, round(CASE WHEN z > 0 THEN 0 ELSE exp(lg) END, 8) AS survivor, round(CASE WHEN z > 0 THEN -1 ELSE exp(lg) * sqrt(g) END, 8) AS se, round(CASE WHEN z = 0 THEN -lg END, 8) AS cumulated_rate FROM s""")
def product_limit(spark, sf_dir):
    return plain(survival.product_limit(shipping(spark, sf_dir), ["grp"]), 8)


@query(f"""
    WITH s AS (SELECT * FROM ({_SPELLS}) WHERE tf IS NOT NULL AND tf > ts AND ts >= 0), t AS (SELECT DISTINCT tf AS time FROM s WHERE des = 2 AND org <> 2), r AS (SELECT time, (SELECT count(*) FROM s WHERE ts < time AND tf >= time)::DOUBLE AS risk, (SELECT count(*) FROM s WHERE tf = time AND des = 2 AND org <> 2)::DOUBLE AS events FROM t)
    SELECT round(time, 6) AS time, events, risk, round(exp(sum(ln(1 - events / risk)) OVER (ORDER BY time)), 8) AS survivor FROM r""")
def product_limit_late_entry(spark, sf_dir):
    e = episodes.checked(episodes.from_events(visits(spark, sf_dir), "user_id", "t", "state"))
    out = survival.product_limit(e, des=2).select("time", "events", "risk", "survivor")
    return plain(out.withColumn("time", F.round("time", 6)), 8)


@query(f"""
    WITH e AS ({_EPISODES}), t AS (SELECT grp, tf AS time, sum(d)::DOUBLE AS events, count(*)::DOUBLE AS n FROM e GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS risk FROM t),
    s AS (SELECT grp, time, exp(sum(CASE WHEN events < risk THEN ln(1 - events / risk) ELSE -1e9 END) OVER w) AS s FROM r WHERE events > 0 WINDOW w AS (PARTITION BY grp ORDER BY time)), l AS (SELECT *, coalesce(lag(time) OVER w, 0) AS t0, coalesce(lag(s) OVER w, 1) AS s0 FROM s WINDOW w AS (PARTITION BY grp ORDER BY time)), q AS (SELECT unnest([0.25, 0.5])::DOUBLE AS share)
    SELECT grp, share, round(min(CASE WHEN s <= 1 - share AND s0 > 1 - share THEN t0 + (s0 - (1 - share)) / (s0 - s) * (time - t0) END), 5) AS time FROM l, q GROUP BY grp, share""")
def survivor_times(spark, sf_dir):
    return plain(survival.survivor_times(survival.product_limit(shipping(spark, sf_dir), ["grp"]), [0.25, 0.5], ["grp"]), 5)


@query()
def survivor_tests(spark, sf_dir):
    return plain(survival.compare(shipping(spark, sf_dir), "grp"))


@query(f"""
    WITH e AS ({_EPISODES}), p AS (SELECT unnest(generate_series(0, 5)) AS k), x AS (SELECT grp, least(floor(tf / 400), 5)::INT AS k, sum(d)::DOUBLE AS events, sum(1 - d)::DOUBLE AS censored FROM e GROUP BY ALL),
    f AS (SELECT g.grp, p.k, coalesce(events, 0) AS events, coalesce(censored, 0) AS censored FROM (SELECT DISTINCT grp FROM e) g CROSS JOIN p LEFT JOIN x ON x.grp = g.grp AND x.k = p.k), n AS (SELECT *, sum(events + censored) OVER (PARTITION BY grp ORDER BY k DESC) AS entering FROM f),
    q AS (SELECT *, entering - 0.5 * censored AS exposed, CASE WHEN entering - 0.5 * censored > 0 THEN events / (entering - 0.5 * censored) ELSE 0 END AS q FROM n), s AS (SELECT *, coalesce(exp(sum(ln(1 - q)) OVER w), 1) AS s, coalesce(sum(q / ((1 - q) * exposed)) OVER w, 0) AS v FROM q WINDOW w AS (PARTITION BY grp ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT grp, (k * 400)::DOUBLE AS start, entering, censored, exposed, events, round(q, 8) AS q, round(s, 8) AS survivor, round(s * sqrt(v), 8) AS se, CASE WHEN k < 5 THEN round(s * q / 400, 10) END AS density FROM s""")
def life_table(spark, sf_dir):
    out = survival.life_table(shipping(spark, sf_dir), [0, 400, 800, 1200, 1600, 2000], ["grp"]).select("grp", "start", "entering", "censored", "exposed", "events", "q", "survivor", "se", "density")
    return plain(out.withColumns({c: F.round(c, 8) for c in ("q", "survivor", "se")}), 10)


@query(f"""
    WITH e AS (SELECT grp, floor(tf / 30)::BIGINT AS time, d FROM ({_EPISODES})), t AS (SELECT grp, time, sum(d)::DOUBLE AS events, sum(1 - d)::DOUBLE AS censored FROM e GROUP BY ALL), r AS (SELECT *, sum(events + censored) OVER (PARTITION BY grp ORDER BY time DESC) AS risk FROM t)
    SELECT grp, time, risk, events, censored, round(events / risk, 8) AS rate, round(coalesce(exp(sum(CASE WHEN events < risk THEN ln(1 - events / risk) ELSE -1e9 END) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1), 8) AS survivor FROM r""")
def discrete_product_limit(spark, sf_dir):
    e = shipping(spark, sf_dir).select("grp", F.floor(F.col("tf") / 30).alias("time"), F.col("des").alias("event"))
    return plain(survival.discrete_product_limit(e, "time", "event", by=["grp"]), 8)


@query(f"""
    WITH e AS (SELECT floor(tf / 100)::BIGINT AS age, d FROM ({_EPISODES})), t AS (SELECT age, sum(d)::DOUBLE AS deaths, sum(1 - d)::DOUBLE AS censored FROM e GROUP BY ALL), r AS (SELECT *, sum(deaths + censored) OVER (ORDER BY age DESC) AS risk FROM t),
    s AS (SELECT *, deaths / risk AS q, coalesce(exp(sum(CASE WHEN deaths < risk THEN ln(1 - deaths / risk) ELSE -1e9 END) OVER (ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS s FROM r)
    SELECT age, risk, deaths, censored, round(q, 8) AS q, round(s, 8) AS survivor, round(CASE WHEN s > 0 THEN sum(s * (1 - q)) OVER (ORDER BY age DESC) / s END, 6) AS expectation FROM s""")
def discrete_life_table(spark, sf_dir):
    e = shipping(spark, sf_dir).select(F.floor(F.col("tf") / 100).alias("age"), F.col("des").alias("death"))
    out = survival.discrete_life_table(e, "age", "death")
    return plain(out.withColumn("expectation", F.round("expectation", 6)), 8)


@query(f"SELECT grp, sum(d)::DOUBLE AS events, round(sum(tf), 3) AS exposure, round(sum(d) / sum(tf), 10) AS rate, round(sum(d) * ln(sum(d) / sum(tf)) - sum(d), 4) AS loglik FROM ({_EPISODES}) GROUP BY grp")
def constant_rates(spark, sf_dir):
    out = rates.null_exponential(shipping(spark, sf_dir), ["grp"])
    return plain(out.withColumns({"exposure": F.round("exposure", 3), "loglik": F.round("loglik", 4)}), 10)


@query(f"""
    WITH e AS ({_EPISODES}), p AS (SELECT * FROM (VALUES (0, 0.0, 200.0), (1, 200.0, 600.0), (2, 600.0, 1e9)) v(period, a, b))
    SELECT period::BIGINT AS period, a::DOUBLE AS start, sum(CASE WHEN a <= tf AND tf < b THEN d ELSE 0 END)::DOUBLE AS events, round(sum(least(tf, b) - a), 3) AS exposure, round(sum(CASE WHEN a <= tf AND tf < b THEN d ELSE 0 END) / sum(least(tf, b) - a), 10) AS rate FROM e JOIN p ON tf >= a GROUP BY period, a""")
def rates_by_period(spark, sf_dir):
    out = rates.occurrence_rates(shipping(spark, sf_dir), [0, 200, 600])
    return plain(out.withColumn("exposure", F.round("exposure", 3)), 10)


@query(f"""
    WITH g AS (SELECT CASE WHEN grp = '1-URGENT' THEN 1 ELSE 0 END AS u, sum(d) / sum(tf) AS r FROM ({_EPISODES}) GROUP BY 1)
    SELECT 'constant' AS term, round((SELECT ln(r) FROM g WHERE u = 0), 5) AS coef UNION ALL SELECT 'urgent', round((SELECT ln(r) FROM g WHERE u = 1) - (SELECT ln(r) FROM g WHERE u = 0), 5)""")
def exponential_model(spark, sf_dir):
    e = shipping(spark, sf_dir).withColumn("urgent", F.when(F.col("grp") == "1-URGENT", 1.0).otherwise(0.0))
    return plain(rates.exponential(e, ["urgent"]).table(spark).select("term", "coef"), 5)


@query(f"""
    WITH e AS ({_EPISODES}), p AS (SELECT * FROM (VALUES (0, 0.0, 200.0), (1, 200.0, 600.0), (2, 600.0, 1e9)) v(k, a, b)), r AS (SELECT k, ln(sum(CASE WHEN a <= tf AND tf < b THEN d ELSE 0 END) / sum(least(tf, b) - a)) AS r FROM e JOIN p ON tf >= a GROUP BY k)
    SELECT CASE k WHEN 0 THEN 'constant' ELSE 'period_' || k END AS term, round(CASE k WHEN 0 THEN r ELSE r - (SELECT r FROM r WHERE k = 0) END, 5) AS coef FROM r""")
def piecewise_model(spark, sf_dir):
    return plain(rates.piecewise(shipping(spark, sf_dir), [0, 200, 600]).table(spark).select("term", "coef"), 5)


@query()
def weibull_model(spark, sf_dir):
    e = shipping(spark, sf_dir).withColumn("q", F.col("l_quantity") / 50)
    return plain(rates.parametric(e, "weibull", [["q"], []]).table(spark), 4)


@query(f"SELECT 'constant' AS term, round(ln(sum(d) / (sum(ceil(tf / 100)) - sum(d))), 5) AS coef FROM ({_EPISODES})")
def discrete_time_model(spark, sf_dir):
    e = shipping(spark, sf_dir).withColumn("tf", F.ceil(F.col("tf") / 100).cast("double"))
    return plain(rates.discrete_time(e, degree=0).table(spark).select("term", "coef"), 5)


@query()
def polynomial_model(spark, sf_dir):
    return plain(rates.polynomial(shipping(spark, sf_dir), exponent=True).table(spark).select("term", "ratio"), 2)


@query()
def proportional_hazards(spark, sf_dir):
    e = shipping(spark, sf_dir).withColumn("q", F.col("l_quantity") / 50)
    return plain(rates.cox(e, ["q"]).table(spark), 5)


# sequences: the kinds of a user's events in their order


def kinds(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", "event_id", (F.array_position(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")) - 1).cast("int").alias("state"))
    t = t.withColumn("state", F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("state")))
    return sequences.from_long(t, "user_id", "event_id", "state")


_KINDS = "SELECT user_id AS id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS t, CASE WHEN event_id % 11 = 0 THEN -1 ELSE CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END END AS state FROM events"


@query(f"""
    WITH s AS ({_KINDS}), f AS (SELECT id, min(t) FILTER (state >= 0) AS first, max(t) FILTER (state >= 0) AS last FROM s GROUP BY id), m AS (SELECT s.id, s.t, s.t - row_number() OVER (PARTITION BY s.id ORDER BY s.t) AS g FROM s JOIN f USING (id) WHERE s.state < 0 AND s.t BETWEEN first AND last), r AS (SELECT id, g, count(*) AS n FROM m GROUP BY ALL)
    SELECT f.id, any_value(first) AS first, any_value(last) AS last, any_value(last) - any_value(first) + 1 AS length, count(n) AS gaps, coalesce(sum(n), 0)::BIGINT AS gap_total, min(n) AS gap_min, max(n) AS gap_max FROM f LEFT JOIN r ON r.id = f.id GROUP BY f.id""")
def sequence_lengths(spark, sf_dir):
    return plain(sequences.lengths(kinds(spark, sf_dir)))


@query(f"""
    WITH s AS ({_KINDS}), c AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS ch FROM s WINDOW w AS (PARTITION BY id ORDER BY t)), r AS (SELECT *, sum(ch) OVER (PARTITION BY id ORDER BY t) AS spell FROM c)
    SELECT id, spell::BIGINT AS spell, any_value(state)::BIGINT AS state, min(t) AS start, count(*) AS length FROM r GROUP BY id, spell""")
def sequence_spells(spark, sf_dir):
    return plain(sequences.spells(kinds(spark, sf_dir)))


@query(f"""
    WITH s AS ({_KINDS}), n AS (SELECT *, lead(state) OVER (PARTITION BY id ORDER BY t) AS next FROM s)
    SELECT id, count(DISTINCT state) FILTER (state >= 0) AS distinct_states, count(*) FILTER (state >= 0 AND next >= 0 AND state <> next) AS changes, count(*) FILTER (state < 0) AS missing, coalesce(count(*) FILTER (state = 4), 0) AS views FROM n GROUP BY id""")
def sequence_characteristics(spark, sf_dir):
    out = sequences.characteristics(kinds(spark, sf_dir))
    return plain(out.select("id", "distinct_states", "changes", "missing", F.coalesce(F.try_element_at("durations", F.lit(4)), F.lit(0)).alias("views")))


@query(f"WITH s AS ({_KINDS}) SELECT t, state::BIGINT AS state, count(*) AS n, CASE WHEN state >= 0 THEN round(count(*) / sum(CASE WHEN state >= 0 THEN count(*) END) OVER (PARTITION BY t), 8) END AS share FROM s GROUP BY t, state")
def state_distribution(spark, sf_dir):
    return plain(sequences.distribution(kinds(spark, sf_dir)), 8)


@query(f"WITH s AS ({_KINDS}), c AS (SELECT t, state, count(*) AS n FROM s WHERE state >= 0 GROUP BY ALL), p AS (SELECT t, n, n / sum(n) OVER (PARTITION BY t) AS p FROM c) SELECT t, sum(n)::BIGINT AS n, round(sum(-p * ln(p)) + 0.0, 8) AS entropy FROM p GROUP BY t")
def state_entropy(spark, sf_dir):
    return plain(sequences.entropy(kinds(spark, sf_dir)), 8)


@query(f"WITH n AS (SELECT *, lead(state) OVER (PARTITION BY id ORDER BY t) AS des FROM ({_KINDS})) SELECT state::BIGINT AS org, des::BIGINT AS des, count(*) AS n FROM n WHERE state >= 0 AND des >= 0 AND state <> des GROUP BY ALL")
def change_counts(spark, sf_dir):
    return plain(sequences.change_counts(kinds(spark, sf_dir)))


@query(f"""
    WITH n AS (SELECT *, lead(state) OVER (PARTITION BY id ORDER BY t) AS des FROM ({_KINDS})), c AS (SELECT t, state AS org, des, count(*) AS n FROM n WHERE state >= 0 AND des IS NOT NULL GROUP BY ALL)
    SELECT t, org::BIGINT AS org, des::BIGINT AS des, n, round(n / sum(n) OVER w, 8) AS share, round(sum(CASE WHEN des >= 0 AND des <> org THEN n ELSE 0 END) OVER w / sum(CASE WHEN des >= 0 THEN n END) OVER w, 8) AS movers FROM c WINDOW w AS (PARTITION BY t, org)""")
def transition_shares(spark, sf_dir):
    return plain(sequences.transition_shares(kinds(spark, sf_dir)), 8)


@query(f"WITH s AS ({_KINDS}), x AS (SELECT id, string_agg(state || ';', '' ORDER BY t) AS s FROM s GROUP BY id) SELECT id, len(regexp_extract_all(';' || replace(s, ';', ';;'), ';4;;-?[0-9]+;;0;'))::BIGINT AS n FROM x")
def pattern_matches(spark, sf_dir):
    return plain(sequences.matching(kinds(spark, sf_dir), [4, "?", 0]))


@query(f"WITH s AS ({_KINDS}), c AS (SELECT id, count(*) FILTER (state = 2) AS p, count(*) FILTER (state = 1) AS e FROM s GROUP BY id) SELECT id, CASE WHEN p >= 10 THEN 1 WHEN e BETWEEN 0 AND 5 THEN 2 ELSE 0 END::BIGINT AS grp FROM c".replace("AS grp", 'AS "group"'))
def group_membership(spark, sf_dir):
    return plain(sequences.members(kinds(spark, sf_dir), [(2, 10, 10**9), (1, 0, 5)]))


@query(f"WITH s AS ({_KINDS}) SELECT id, coalesce(max(t) FILTER (state = 2), -1)::BIGINT AS last_place FROM s GROUP BY id")
def last_places(spark, sf_dir):
    return plain(sequences.last_place(kinds(spark, sf_dir), 2))


@query()
def optimal_matching(spark, sf_dir):
    """Roles of conversations by turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.pmod(F.xxhash64("role"), F.lit(7)).cast("int").alias("role"))
    pairs, _ = sequences.optimal_matching(sequences.from_long(rows, "conv_id", ["turn", "role"], "role"))
    return pairs


@query("""
    WITH s AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' ELSE 'a' END, '' ORDER BY turn) AS w FROM conversations GROUP BY conv_id), d AS (SELECT w, min(conv_id) AS first FROM s GROUP BY w)
    SELECT x.first AS a, y.first AS b, levenshtein(x.w, y.w)::DOUBLE AS distance FROM d x JOIN d y ON x.first < y.first""")
def edit_distances(spark, sf_dir):
    """Roles of conversations by turns: the least number of insertions, deletions and replacements between any two that differ, each named by its first conversation."""
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    seq = sequences.from_long(table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role")), "conv_id", "turn", "role")
    pairs, members = sequences.optimal_matching(seq, substitution=1.0)
    first = members.groupBy("number").agg(F.min("id").alias("first"))
    named = lambda c: first.select(F.col("number").alias(c), F.col("first").alias(f"_{c}"))
    out = pairs.join(named("a"), "a").join(named("b"), "b")
    return plain(out.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "distance"))
