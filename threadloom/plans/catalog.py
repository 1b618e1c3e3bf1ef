"""The registered queries and their DuckDB SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dist, quantiles, resample, runs, stats, svd, topic_model, topics, tree
from ..sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Marker words that the invented prose has (the published lists are the library's defaults).
WORDS = {"system": ["the", "of", "and"], "relational": ["to", "in", "that"], "uncertainty": ["is", "of the", "der"]}

MSG = """m AS (SELECT *, strftime(ts, '%Y-%m') AS month, CAST((length(text) * 31 + turn) % 8 AS INTEGER) AS domain FROM (
  SELECT conv_id, turn, role, text, (DATE '2025-05-01' + to_months(CAST(conv_id % 8 AS INTEGER)))::TIMESTAMP + to_days(CAST((conv_id // 8) % 28 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts FROM conversations))"""
EVT = "e AS (SELECT event_id, user_id AS thread, ts, ts::DATE AS day, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, event_type AS domain FROM events)"
ORD = "o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_custkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, o_orderpriority AS domain, o_totalprice AS value FROM orders)"
NODES = """n AS (SELECT conv_id, turn, conv_id || '-' || turn AS node_id, CASE WHEN turn = 0 THEN NULL WHEN turn >= 2 AND (conv_id + turn) % 5 = 0 THEN conv_id || '-' || (turn - 2) ELSE conv_id || '-' || (turn - 1) END AS parent_id FROM conversations)"""


def sides(cte: str, table: str, period: str) -> str:
    """CTEs: counts c(period, domain, l, r, ls, rs) of both roles with their totals."""
    return f"""{cte}, c0 AS (SELECT {period} AS p, domain, count(*) FILTER (role = 'user') AS l, count(*) FILTER (role = 'assistant') AS r FROM {table} WHERE role IN ('user', 'assistant') GROUP BY 1, 2),
c AS (SELECT *, sum(l) OVER (PARTITION BY p) AS ls, sum(r) OVER (PARTITION BY p) AS rs FROM c0)"""


JS = "sqrt(greatest(0.0, sum(0.5 * (CASE WHEN l > 0 THEN l / ls * ln(l / ls / ((l / ls + r / rs) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r / rs * ln(r / rs / ((l / ls + r / rs) / 2)) ELSE 0 END))))"
ENT = "sum(CASE WHEN l > 0 THEN -(l / ls) * ln(l / ls) ELSE 0.0 END)"
CURVES = f"SELECT p AS month, CAST(max(ls) AS BIGINT) AS user_msgs, CAST(max(rs) AS BIGINT) AS assistant_msgs, {ENT} AS entropy_user, CASE WHEN max(ls) >= 10 AND max(rs) >= 10 THEN {JS} END AS js_distance FROM c GROUP BY p"


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- diagnostics and profiles


@query("SELECT role, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM conversations GROUP BY role")
def role_counts_pct(spark, d):
    n = S.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    return n.select("role", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


@query(f"WITH {MSG} SELECT ts::DATE AS day, role, count(*) AS n FROM m GROUP BY 1, 2")
def daily_role_counts(spark, d):
    return S.conversations(spark, d).groupBy(F.to_date("ts").alias("day"), "role").agg(F.count("*").alias("n"))


@query(f"WITH {MSG} SELECT count(*) AS n, count(DISTINCT conv_id) AS threads, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_text FROM m")
def corpus_scalars(spark, d):
    return S.conversations(spark, d).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("threads"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg(F.col("text").isNotNull().cast("double")), 6).alias("with_text"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (role = 'user') AS user_msgs, count(*) FILTER (role = 'assistant') AS assistant_msgs FROM conversations GROUP BY conv_id ORDER BY chars DESC, conv_id LIMIT 30")
def top_threads_by_chars(spark, d):
    c = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_msgs"), F.count_if(F.col("role") == "assistant").alias("assistant_msgs"))
    return c.orderBy(F.desc("chars"), "conv_id").limit(30)


@query("""SELECT count(*) FILTER (role = 'user') AS user_msgs, count(*) FILTER (role = 'assistant') AS assistant_msgs, round(avg(CASE WHEN role = 'user' THEN length(text) END), 6) AS avg_user_chars,
round(avg(CASE WHEN role = 'assistant' THEN length(text) END), 6) AS avg_assistant_chars, round(count(*) FILTER (role = 'assistant') / greatest(count(*) FILTER (role = 'user'), 1), 6) AS ratio FROM conversations WHERE role IN ('user', 'assistant')""")
def interaction_profile(spark, d):
    c = S.table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    u, a = F.col("role") == "user", F.col("role") == "assistant"
    return c.agg(F.count_if(u).alias("user_msgs"), F.count_if(a).alias("assistant_msgs"), F.round(F.avg(F.when(u, F.length("text"))), 6).alias("avg_user_chars"), F.round(F.avg(F.when(a, F.length("text"))), 6).alias("avg_assistant_chars"), F.round(X.per(F.count_if(a), F.count_if(u)), 6).alias("ratio"))


def _marks(words: list[str]) -> str:
    """DuckDB: whole-word matches by way of single blanks around all words."""
    return "(" + " + ".join(f"((length(t) - length(replace(t, ' {w} ', ''))) // {len(w) + 2})" for w in words) + ")"


_CLEAN = "SELECT *, ' ' || replace(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ', '  ') || ' ' AS t FROM m"


@query(f"WITH {MSG}, k AS ({_CLEAN}) SELECT month, count(*) AS user_messages, CAST(sum({_marks(['the', 'of', 'and'])}) AS BIGINT) AS system_words, round(1000.0 * sum({_marks(['the', 'of', 'and'])}) / count(*), 6) AS system_per_1k FROM k WHERE role = 'user' GROUP BY month")
def marker_trajectory_monthly(spark, d):
    m = S.conversations(spark, d).where("role = 'user'").withColumn("k", X.marker_count(F.col("text"), WORDS["system"]))
    return m.groupBy("month").agg(F.count("text").alias("user_messages"), F.sum("k").cast("long").alias("system_words"), F.round(F.sum("k") * 1000.0 / F.count("text"), 6).alias("system_per_1k"))


@query(f"WITH {MSG}, k AS ({_CLEAN}) SELECT role, CAST(sum({_marks(['to', 'in', 'that'])}) AS BIGINT) AS relational, count(*) AS n FROM k GROUP BY role")
def marker_profile(spark, d):
    return S.conversations(spark, d).groupBy("role").agg(F.sum(X.marker_count(F.col("text"), WORDS["relational"])).cast("long").alias("relational"), F.count("*").alias("n"))


def _ttr(df: DataFrame, key: str) -> DataFrame:
    w = df.select(key, F.explode(F.split(F.lower("text"), X.NOT_WORD)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("k"))
    # Distinct words are tested, not every word.
    w = w.where(X.is_ascii_word(F.col("w")))
    return w.groupBy(key).agg(F.count("*").alias("unique_words"), F.sum("k").alias("total_words"), F.round(F.count("*") / F.sum("k"), 4).alias("ttr"))


def _ttr_sql(src: str, key: str) -> str:
    return f"w AS (SELECT {key}, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM {src}) SELECT {key}, count(DISTINCT w) AS unique_words, count(*) AS total_words, round(count(DISTINCT w) / count(*), 4) AS ttr FROM w WHERE regexp_full_match(w, '[a-z]+') GROUP BY {key}"


@query(f"WITH {MSG}, u AS (SELECT * FROM m WHERE role = 'user'), {_ttr_sql('u', 'month')}")
def ttr_monthly(spark, d):
    return _ttr(S.conversations(spark, d).where("role = 'user'"), "month")


@query(f"WITH {_ttr_sql('documents', 'lang')}")
def ttr_by_lang(spark, d):
    return _ttr(S.table(spark, d, "documents"), "lang")


@query("SELECT doc_id, length(text) AS chars, 'doc ' || doc_id AS title FROM documents WHERE text IS NOT NULL AND length(text) > 0")
def nonempty_scan(spark, d):
    t = S.table(spark, d, "documents").where(F.col("text").isNotNull() & (F.length("text") > 0))
    return t.select("doc_id", F.length("text").cast("long").alias("chars"), X.safe_title(F.concat(F.lit("doc:  "), F.col("doc_id"), F.lit(" ?!"))).alias("title"))


# ---- shares, entropy, divergence


@query(f"WITH {MSG} SELECT month, role, domain, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY month, role), 6) AS share FROM m GROUP BY 1, 2, 3")
def share_by_period_role_domain(spark, d):
    return rounded(dist.shares(S.conversations(spark, d), ["month", "role"], "domain"), "share")


@query(f"WITH {sides(MSG, 'm', 'month')}, g AS (SELECT * FROM (SELECT DISTINCT p FROM c) x1 CROSS JOIN (SELECT DISTINCT domain FROM c) x2) SELECT p AS month, domain, round(coalesce(l / nullif(max(ls) OVER (PARTITION BY p), 0), 0), 6) AS left_share, round(coalesce(r / nullif(max(rs) OVER (PARTITION BY p), 0), 0), 6) AS right_share FROM g LEFT JOIN c USING (p, domain)")
def scaffolded_shares(spark, d):
    return rounded(dist.scaffolded(S.conversations(spark, d), "month", "domain", "role", "user", "assistant"), "left_share", "right_share")


@query(f"WITH {MSG}, s AS (SELECT month, domain, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY month) AS q FROM m WHERE role = 'user' GROUP BY 1, 2) SELECT month, CAST(sum(n) AS BIGINT) AS n, count(*) AS categories, round(sum(-q * ln(q)), 6) AS entropy FROM s GROUP BY month")
def entropy_ln_monthly(spark, d):
    return rounded(dist.entropy(S.conversations(spark, d).where("role = 'user'"), ["month"], "domain"), "entropy")


@query(f"WITH {EVT}, s AS (SELECT day, domain, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY day) AS q FROM e GROUP BY 1, 2) SELECT day, CAST(sum(n) AS BIGINT) AS n, count(*) AS categories, round(sum(-q * log2(q)), 6) AS entropy FROM s GROUP BY day")
def entropy_by_day(spark, d):
    return rounded(dist.entropy(S.event_facts(spark, d), ["day"], "domain", base=2.0), "entropy")


@query(f"WITH {sides(MSG, 'm', 'month')} SELECT p AS month, CAST(max(ls) AS BIGINT) AS left_n, CAST(max(rs) AS BIGINT) AS right_n, CASE WHEN max(ls) >= 10 AND max(rs) >= 10 THEN round({JS}, 6) END AS js_distance FROM c GROUP BY p")
def js_distance_monthly(spark, d):
    return rounded(dist.js_distance(S.conversations(spark, d), ["month"], "domain", "role", "user", "assistant"), "js_distance")


@query(f"WITH {sides(ORD, 'o', 'month')} SELECT p AS month, CAST(max(ls) AS BIGINT) AS left_n, CAST(max(rs) AS BIGINT) AS right_n, CASE WHEN max(ls) >= 10 AND max(rs) >= 10 THEN round({JS.replace('ls', 'nullif(ls,0)').replace('rs', 'nullif(rs,0)')}, 6) END AS js_distance FROM c GROUP BY p")
def js_distance_orders(spark, d):
    return rounded(dist.js_distance(S.order_facts(spark, d), ["month"], "domain", "role", "user", "assistant"), "js_distance")


@query(f"WITH {sides(MSG, 'm', 'month')}, k AS ({CURVES}) SELECT month, user_msgs, assistant_msgs, round(entropy_user, 6) AS entropy_user, round(js_distance, 6) AS js_distance FROM k")
def monthly_curves(spark, d):
    return rounded(dist.curves(S.conversations(spark, d), "month", "role", "domain"), "entropy_user", "js_distance")


@query(f"""WITH {ORD}, c AS (SELECT month, domain, count(*) / sum(count(*)) OVER (PARTITION BY month) AS share FROM o GROUP BY 1, 2), g AS (SELECT month, domain, coalesce(share, 0) AS share FROM (SELECT DISTINCT month FROM c) x1 CROSS JOIN (SELECT DISTINCT domain FROM c) x2 LEFT JOIN c USING (month, domain)),
ref AS (SELECT domain, avg(share) AS q FROM g WHERE month <= '1995-12' GROUP BY domain), x AS (SELECT month, (share + 1e-10) / sum(share + 1e-10) OVER (PARTITION BY month) AS p, (q + 1e-10) / sum(q + 1e-10) OVER (PARTITION BY month) AS q FROM g JOIN ref USING (domain))
SELECT month, round(sqrt(greatest(0, sum(0.5 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))))) / ln(2)), 6) AS jsd FROM x GROUP BY month""")
def js_distance_from_reference(spark, d):
    s = dist.shares(S.order_facts(spark, d), ["month"], "domain")
    grid = s.select("month").distinct().crossJoin(F.broadcast(s.select("domain").distinct())).join(s, ["month", "domain"], "left").select("month", "domain", F.coalesce("share", F.lit(0.0)).alias("share"))
    return rounded(dist.js_from_reference(grid, "month", "domain", F.col("month") <= "1995-12"), "jsd")


@query(f"WITH {ORD}, q AS (SELECT month FROM o GROUP BY month HAVING count(*) FILTER (role = 'user') >= 40 AND count(*) FILTER (role = 'assistant') >= 40) SELECT month, count(*) AS n FROM o SEMI JOIN q USING (month) GROUP BY month")
def semi_join_qualifying_periods(spark, d):
    return dist.qualifying(S.order_facts(spark, d), "month", "role", 40).groupBy("month").agg(F.count("*").alias("n"))


# ---- runs, shifts, windows, states

RUNS = "r0 AS (SELECT *, CASE WHEN domain IS DISTINCT FROM lag(domain) OVER w THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY thread ORDER BY ts, event_id)), r1 AS (SELECT *, sum(nw) OVER (PARTITION BY thread ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM r0), r AS (SELECT thread, CAST(run_id AS BIGINT) AS run_id, min(domain) AS category, arg_min(role, (ts, event_id)) AS initiator_role, min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS n FROM r1 GROUP BY 1, 2)"


def _runs(spark, d):
    return runs.runs(S.event_facts(spark, d), "thread", ["ts", "event_id"], "domain", "role")


@query(f"WITH {EVT}, s AS (SELECT thread, ts, event_id, role AS initiator_role, lag(domain) OVER (PARTITION BY thread ORDER BY ts, event_id) AS from_category, domain AS to_category FROM e WHERE domain IS NOT NULL) SELECT * FROM s WHERE from_category <> to_category")
def domain_shifts(spark, d):
    return runs.shifts(S.event_facts(spark, d), "thread", ["ts", "event_id"], "domain", "role")


@query(f"WITH {EVT}, s AS (SELECT role, lag(domain) OVER (PARTITION BY thread ORDER BY ts, event_id) AS f, domain AS t FROM e), x AS (SELECT * FROM s WHERE f <> t) SELECT count(*) AS total_shifts, round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END), 6) AS user_share FROM x")
def shift_initiation_summary(spark, d):
    s = runs.shifts(S.event_facts(spark, d), "thread", ["ts", "event_id"], "domain", "role")
    return s.agg(F.count("*").alias("total_shifts"), F.round(F.avg((F.col("initiator_role") == "user").cast("double")), 6).alias("user_share"))


@query(f"WITH {EVT}, {RUNS} SELECT * FROM r")
def run_segments(spark, d):
    return _runs(spark, d)


@query(f"WITH {EVT}, {RUNS} SELECT * FROM r WHERE n >= 3")
def sustained_runs(spark, d):
    return runs.sustained(_runs(spark, d), 3)


@query(f"WITH {EVT}, {RUNS} SELECT * FROM r WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY thread ORDER BY \"start\", run_id) = 1")
def first_sustained_run(spark, d):
    return runs.first_sustained(_runs(spark, d), "thread", 3)


_BINOM = "lf AS (SELECT i, coalesce((SELECT sum(ln(j)) FROM range(1, i + 1) t(j)), 0.0) AS v FROM range(0, (SELECT max(n) FROM s) + 1) q(i)), pm AS (SELECT s.n, s.k, f.i, exp((SELECT v FROM lf WHERE lf.i = s.n) - f.v - (SELECT v FROM lf WHERE lf.i = s.n - f.i) + s.n * ln(0.5)) AS p FROM s, lf f WHERE f.i <= s.n), po AS (SELECT p AS pk FROM pm WHERE i = k)"


@query(f"WITH {EVT}, {RUNS}, s AS (SELECT count(*) AS n, count(*) FILTER (initiator_role = 'user') AS k FROM r WHERE n >= 3), {_BINOM} SELECT max(k) AS k, max(n) AS n, round(least(1.0, sum(p)), 6) AS p_value FROM pm, po WHERE p <= pk + 1e-12")
def episode_summary(spark, d):
    s = runs.sustained(_runs(spark, d), 3).agg(F.count_if(F.col("initiator_role") == "user").alias("k"), F.count("*").alias("n"))
    return rounded(stats.binomial_two_sided(s, "k", "n"), "p_value")


@query(f"""WITH {EVT}, x AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS a FROM e), w AS (SELECT rn // 250 AS "window", rn % 250 AS place, ts, domain FROM x WHERE rn < (a // 250) * 250),
s AS (SELECT "window", domain, count(*) / 250.0 AS q FROM w GROUP BY 1, 2), t AS (SELECT "window", max(CASE WHEN place = 125 THEN ts END) AS mid_ts FROM w GROUP BY 1) SELECT "window", mid_ts, round(sum(-q * log2(q)), 6) AS entropy FROM s JOIN t USING ("window") GROUP BY 1, 2""")
def rolling_entropy_count_window(spark, d):
    w = runs.count_windows(S.event_facts(spark, d), ["ts", "event_id"], 250)
    mid = w.groupBy("window").agg(F.max(F.when(F.col("place") == 125, F.col("ts"))).alias("mid_ts"))
    return rounded(dist.entropy(w, ["window"], "domain", base=2.0).join(mid, "window").select("window", "mid_ts", "entropy"), "entropy")


_OC = f"WITH {sides(ORD, 'o', 'month')}, k0 AS ({CURVES.replace('ls', 'nullif(ls,0)').replace('rs', 'nullif(rs,0)')}), k AS (SELECT month, round(entropy_user, 9) AS entropy_user, round(js_distance, 9) AS js_distance FROM k0)"


def _order_curves(spark, d):
    return rounded(dist.curves(S.order_facts(spark, d), "month", "role", "domain"), "entropy_user", "js_distance", digits=9).select("month", "entropy_user", "js_distance")


@query(_OC + ", q AS (SELECT quantile_cont(entropy_user, 0.33) AS el, quantile_cont(entropy_user, 0.66) AS eh, quantile_cont(js_distance, 0.33) AS jl, quantile_cont(js_distance, 0.66) AS jh FROM k) SELECT month, CASE WHEN entropy_user >= eh AND js_distance >= jh THEN 'Exploration' WHEN entropy_user <= el AND js_distance <= jl THEN 'Consolidation' ELSE 'Transitional' END AS state FROM k, q")
def states_quantile(spark, d):
    return runs.states_quantile(_order_curves(spark, d), "entropy_user", "js_distance").select("month", "state")


_RATE = ", dl AS (SELECT month, entropy_user - lag(entropy_user) OVER (ORDER BY month) AS de, js_distance - lag(js_distance) OVER (ORDER BY month) AS dj, row_number() OVER (ORDER BY month) AS rn FROM k), st AS (SELECT month, de, dj, CASE WHEN rn = 1 THEN 'Initial' WHEN de > 0 AND dj > 0 THEN 'Exploration' WHEN de < 0 AND dj < 0 THEN 'Consolidation' ELSE 'Transitional' END AS state FROM dl)"


@query(_OC + _RATE + " SELECT month, round(de, 6) AS delta_entropy, state FROM st")
def states_rate(spark, d):
    return runs.states_rate(_order_curves(spark, d), "month", "entropy_user", "js_distance").select("month", F.round("delta_entropy_user", 6).alias("delta_entropy"), "state")


@query(_OC + _RATE + ", t AS (SELECT lag(state) OVER (ORDER BY month) AS from_state, state AS to_state FROM st) SELECT from_state, to_state, count(*) AS n FROM t WHERE from_state IS NOT NULL GROUP BY 1, 2")
def state_transitions(spark, d):
    return runs.transitions(runs.states_rate(_order_curves(spark, d), "month", "entropy_user", "js_distance"), "month")


# ---- coupling and statistics


def coupling_sql(cte: str, table: str, period: str) -> str:
    """CTEs to g (shares u and a of every period and domain), dd (their changes), pr (with the next ones) and cs (both cosines of each period)."""
    return f"WITH {sides(cte, table, period)}, g AS (SELECT p, domain, coalesce(l / nullif(ls, 0), 0.0) AS u, coalesce(r / nullif(rs, 0), 0.0) AS a FROM (SELECT DISTINCT p FROM c) x1 CROSS JOIN (SELECT DISTINCT domain FROM c) x2 LEFT JOIN c USING (p, domain)), dd AS (SELECT p, domain, u - lag(u) OVER w AS du, a - lag(a) OVER w AS da FROM g WINDOW w AS (PARTITION BY domain ORDER BY p)), pr AS (SELECT p, domain, du, da, lead(du) OVER w AS du2, lead(da) OVER w AS da2 FROM dd WINDOW w AS (PARTITION BY domain ORDER BY p)), cs AS (SELECT p, sum(du * da2) / nullif(sqrt(sum(du * du) * sum(da2 * da2)), 0) AS f, sum(da * du2) / nullif(sqrt(sum(da * da) * sum(du2 * du2)), 0) AS b FROM pr WHERE du IS NOT NULL AND du2 IS NOT NULL GROUP BY p)"


def shuffled_sql(draws: int) -> str:
    """More CTEs, to zc: both cosines of each draw and period, the right side's periods shuffled as whole vectors."""
    return f""", mo AS (SELECT DISTINCT p FROM dd WHERE du IS NOT NULL), k AS (SELECT perm_id, p, row_number() OVER (PARTITION BY perm_id ORDER BY p) AS pos, row_number() OVER (PARTITION BY perm_id ORDER BY md5(perm_id || '|42|' || p), p) AS dst FROM mo, range(0, {draws}) q(perm_id)),
mv AS (SELECT a.perm_id, a.p, b.p AS src FROM k a JOIN k b ON a.perm_id = b.perm_id AND a.pos = b.dst), z AS (SELECT perm_id, mv.p, x.domain, x.du, y.da FROM mv JOIN dd x ON x.p = mv.p JOIN dd y ON y.p = mv.src AND y.domain = x.domain),
zz AS (SELECT *, lead(du) OVER w AS du2, lead(da) OVER w AS da2 FROM z WINDOW w AS (PARTITION BY perm_id, domain ORDER BY p)), zc AS (SELECT perm_id, p, sum(du * da2) / nullif(sqrt(sum(du * du) * sum(da2 * da2)), 0) AS f, sum(da * du2) / nullif(sqrt(sum(da * da) * sum(du2 * du2)), 0) AS b FROM zz WHERE du2 IS NOT NULL GROUP BY 1, 2)"""


_G = coupling_sql(ORD, "o", "month")
#: Shuffles of a coupling and of a trend.
SHUFFLES, TREND_SHUFFLES = 2_000, 10_000
COUPLED = {"forward": ("delta_u", "next_a"), "reverse": ("delta_a", "next_u")}


def coupled_pairs(counts: DataFrame, period: str) -> DataFrame:
    """Changes of both sides' shares with the next period's changes beside them, per domain, of counts by period and domain; stored, as several things are made of them."""
    s = dist.scaffold(counts, period, "domain").withColumnsRenamed({"left_share": "u", "right_share": "a"})
    w = Window.partitionBy("domain").orderBy(period)
    x = runs.deltas(s, period, ["u", "a"], ["domain"])
    return S.stored(x.withColumns({"next_u": F.lead("delta_u").over(w), "next_a": F.lead("delta_a").over(w)}).where(F.col("delta_u").isNotNull()))


def _order_pairs(spark, d):
    return coupled_pairs(dist.side_counts(S.order_facts(spark, d), "month", "domain", "role", "user", "assistant"), "month")


def _mean_coupling(pairs: DataFrame, period: str) -> DataFrame:
    c = dist.cosines(pairs.where(F.col("next_u").isNotNull()), [period], COUPLED)
    return c.agg(F.avg("forward").alias("forward"), F.avg("reverse").alias("reverse"), (F.avg("forward") - F.avg("reverse")).alias("difference"))


def _pairs(spark, d):
    return _order_pairs(spark, d).where(F.col("next_u").isNotNull())


@query(_G + " SELECT p AS month, round(f, 6) AS forward, round(b, 6) AS reverse FROM cs")
def delta_coupling_pairs(spark, d):
    return rounded(dist.cosines(_pairs(spark, d), ["month"], COUPLED), "forward", "reverse")


@query(_G + " SELECT round(avg(f), 6) AS forward, round(avg(b), 6) AS reverse, round(avg(f) - avg(b), 6) AS difference FROM cs")
def delta_coupling_summary(spark, d):
    return rounded(_mean_coupling(_pairs(spark, d), "month"), "forward", "reverse", "difference")


@query(_G + " SELECT domain, round(corr(du, da2), 6) AS r, count(*) AS n FROM pr WHERE du IS NOT NULL AND da2 IS NOT NULL GROUP BY domain")
def domain_pearson(spark, d):
    return rounded(stats.pearson(_pairs(spark, d), ["domain"], "delta_u", "next_a"), "r")


@query(_G + ", tot AS (SELECT avg(f) AS f FROM cs), mm AS (SELECT max(u) - min(u) AS rng, domain FROM g GROUP BY domain), vol AS (SELECT domain, avg(abs(du)) AS v FROM dd GROUP BY domain) SELECT domain, round(rng, 6) AS value_range, round(v, 6) AS volatility, round(rng / (v + 1e-6), 4) AS structure_index FROM mm JOIN vol USING (domain)")
def scale_separation(spark, d):
    s = dist.scaffolded(S.order_facts(spark, d), "month", "domain", "role", "user", "assistant")
    x = runs.deltas(s, "month", ["left_share"], ["domain"]).groupBy("domain").agg((F.max("left_share") - F.min("left_share")).alias("g"), F.avg(F.abs("delta_left_share")).alias("v"))
    return x.select("domain", F.round("g", 6).alias("value_range"), F.round("v", 6).alias("volatility"), F.round(F.col("g") / (F.col("v") + 1e-6), 4).alias("structure_index"))


_SERIES = f"WITH {ORD}, v AS (SELECT domain, month, round(avg(value), 4) AS x, count(*) AS n, row_number() OVER (PARTITION BY domain ORDER BY month) - 1 AS t FROM o GROUP BY 1, 2)"


def _series(spark, d):
    o = S.order_facts(spark, d).groupBy("domain", "month").agg(F.round(F.avg("value"), 4).alias("x"), F.count("*").alias("n"))
    return o.withColumn("t", F.row_number().over(Window.partitionBy("domain").orderBy("month")) - 1)


@query(_SERIES + ", r AS (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY n) + (count(*) OVER (PARTITION BY domain, n) - 1) / 2 AS rx, rank() OVER (PARTITION BY domain ORDER BY t) AS rt FROM v) SELECT domain, round(corr(rx, rt), 6) AS rho, count(*) AS n FROM r GROUP BY domain")
def spearman_trend(spark, d):
    return rounded(stats.spearman(_series(spark, d).withColumnRenamed("n", "k"), ["domain"], "k", "t"), "rho")


@query(_SERIES + " SELECT domain, round(regr_slope(n, t), 6) AS slope, round(regr_intercept(n, t), 6) AS intercept FROM v GROUP BY domain")
def linear_trend(spark, d):
    return rounded(stats.line(_series(spark, d), ["domain"], "t", "n"), "slope", "intercept")


@query(_SERIES + " SELECT domain, median(n) AS med, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, quantile_cont(n, 0.66) AS q66, arg_max(month, (n, month)) AS peak, arg_min(month, (n, month)) AS low FROM v GROUP BY domain")
def series_summary(spark, d):
    k = F.struct("n", "month")
    return _series(spark, d).groupBy("domain").agg(F.median("n").alias("med"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("sd"), F.percentile("n", F.lit(0.66)).alias("q66"), F.max_by("month", k).alias("peak"), F.min_by("month", k).alias("low"))


@query(f"WITH {sides(MSG, 'm', 'month')}, k AS ({CURVES}) SELECT round(avg(CASE WHEN month IN ('2025-08', '2025-09', '2025-10') THEN entropy_user END) - avg(CASE WHEN month IN ('2025-05', '2025-06', '2025-07') THEN entropy_user END), 6) AS entropy_peak_early, round(avg(CASE WHEN month IN ('2025-09', '2025-10') THEN js_distance END) - avg(CASE WHEN month IN ('2025-05', '2025-06', '2025-07', '2025-08') THEN js_distance END), 6) AS js_spike FROM k")
def contrast_windows(spark, d):
    k = dist.curves(S.conversations(spark, d), "month", "role", "domain")
    e, p, _ = stats.pick_windows([f"2025-{m:02}" for m in range(5, 13)], ["2025-05", "2025-06", "2025-07"], ["2025-08", "2025-09", "2025-10"], ["2025-11", "2025-12"])
    return k.agg(F.round(stats.contrast(k, "month", "entropy_user", p, e), 6).alias("entropy_peak_early"), F.round(stats.contrast(k, "month", "js_distance", ["2025-09", "2025-10"], ["2025-05", "2025-06", "2025-07", "2025-08"]), 6).alias("js_spike"))


@query("WITH l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, l GROUP BY 1")
def value_histogram(spark, d):
    return stats.histogram(S.table(spark, d, "orders"), "o_totalprice", 20)


# ---- permutations (hash-ordered, so SQL can repeat them)


@query(_SERIES + """, s AS (SELECT month AS row_id, n AS x, t FROM v WHERE domain = '1-URGENT'), p AS (SELECT perm_id, row_id, x, t, row_number() OVER (PARTITION BY perm_id ORDER BY row_id) AS pos, row_number() OVER (PARTITION BY perm_id ORDER BY md5(perm_id || '|42|' || row_id), row_id) AS dst FROM s, range(0, N_) q(perm_id)),
j AS (SELECT a.perm_id, a.t, b.x FROM p a JOIN p b ON a.perm_id = b.perm_id AND a.pos = b.dst) SELECT perm_id, round(corr(t, x), 6) AS r, count(*) AS n FROM j GROUP BY perm_id""".replace("N_", str(SHUFFLES)))
def perm_trend(spark, d):
    s = _series(spark, d).where("domain = '1-URGENT'").select(F.col("month").alias("row_id"), F.col("n").alias("x"), "t")
    return rounded(stats.pearson(stats.permute(s, "row_id", "x", SHUFFLES), ["perm_id"], "t", "x_perm"), "r")


#: Messages of each role that a month needs to count in null models; the published 50 leave none of the smaller tables' months.
MONTH_ROWS = 20
_MSGS = f"{MSG}, s0 AS (SELECT month, role, domain FROM m WHERE role IN ('user', 'assistant') AND length(text) > 0), s AS (SELECT month, role, domain, count(*) AS n FROM s0 SEMI JOIN (SELECT month FROM s0 GROUP BY month HAVING count(*) FILTER (role = 'user') >= {MONTH_ROWS} AND count(*) FILTER (role = 'assistant') >= {MONTH_ROWS}) USING (month) GROUP BY 1, 2, 3)"
#: Draws of a null model, and its contrasts of periods: name -> (measure, periods, periods to take off).
DRAWS = 200
CONTRASTS = {
    "entropy_peak_early": ("entropy_user", ["2025-08", "2025-09", "2025-10"], ["2025-05", "2025-06", "2025-07"]),
    "js_spike": ("js_distance", ["2025-09", "2025-10"], ["2025-05", "2025-06", "2025-07", "2025-08"]),
    "js_recovery": ("js_distance", ["2025-11", "2025-12"], ["2025-09", "2025-10"]),
}
_MEAN = lambda x, months: f"avg(CASE WHEN month IN ({', '.join(repr(m) for m in months)}) THEN {x} END)"
_CONTRASTS = ", ".join(f"round({_MEAN(x, a)} - {_MEAN(x, b)}, 9) AS {name}" for name, (x, a, b) in CONTRASTS.items())


def _sides_of_counts(src: str, keys: str) -> str:
    """CTEs c0 and c of counts (keys, role, domain, n)."""
    return f"""c0 AS (SELECT {keys} AS p, domain, coalesce(sum(n) FILTER (role = 'user'), 0) AS l, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS r FROM {src} GROUP BY 1, 2),
c AS (SELECT p, domain, l, r, nullif(sum(l) OVER (PARTITION BY p), 0) AS ls, nullif(sum(r) OVER (PARTITION BY p), 0) AS rs FROM c0)"""


def _draws_sql(cells: str, take: str = "") -> str:
    """CTEs to dr(perm_id, g, v, cell, n): tables drawn from cells(g, v, cell, n) label by label and cell by cell, by inversion.

    g is the group's text; with take(g, floor) so many rows are drawn of all labels together.
    """
    labels = f"SELECT g, [''] AS vs, [floor] AS rs FROM ({take})" if take else "SELECT g, list(v ORDER BY v) AS vs, list(n ORDER BY v) AS rs FROM (SELECT g, v, sum(n)::BIGINT AS n FROM cells GROUP BY 1, 2) GROUP BY g"
    log = lambda a, b: f"(lgamma({a} + 1.0) - lgamma({b} + 1.0) - lgamma({a} - ({b}) + 1.0))"
    return f"""cells AS ({cells}), tc AS (SELECT g, list(cell ORDER BY cell) AS cs, list(n ORDER BY cell) AS ls FROM (SELECT g, cell, sum(n)::BIGINT AS n FROM cells GROUP BY 1, 2) GROUP BY g), tv AS ({labels}),
st AS (SELECT perm_id, g, 0 AS step, cs, vs, rs, ls AS rest, 0::BIGINT AS need, 0::BIGINT AS n FROM tc JOIN tv USING (g), range(0, {DRAWS}) q(perm_id)
  UNION ALL
  SELECT perm_id, g, step, cs, vs, rs, list_transform(rest, lambda x, i: CASE WHEN i = ci THEN x - n ELSE x END), need - n, n FROM (
    SELECT *, least(hi, lo + len(list_filter(list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_slice(ps, 1, i))), lambda x: x <= u)))::BIGINT AS n FROM (
      SELECT *, list_transform(range(lo, hi + 1), lambda k: exp({log("marked", "k")} + {log("(total - marked)", "(need - k)")} - {log("total", "need")})) AS ps FROM (
        SELECT *, greatest(0, need - (total - marked)) AS lo, least(marked, need) AS hi FROM (
          SELECT perm_id, g, step + 1 AS step, cs, vs, rs, rest, step % len(cs) + 1 AS ci, CASE WHEN step % len(cs) = 0 THEN rs[step // len(cs) + 1] ELSE need END AS need, rest[step % len(cs) + 1] AS marked, list_sum(list_slice(rest, step % len(cs) + 1, len(rest)))::BIGINT AS total,
            ('0x' || substr(md5(perm_id || '|42|' || g || '|' || vs[step // len(cs) + 1] || '|' || cs[step % len(cs) + 1]), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM st WHERE step < len(cs) * len(vs)))))),
dr AS (SELECT perm_id, g, vs[(step - 1) // len(cs) + 1] AS v, cs[(step - 1) % len(cs) + 1] AS cell, n FROM st WHERE step > 0)"""


_FLOOR = "SELECT month || '|' || role AS g, floor FROM (SELECT DISTINCT month, role FROM s) JOIN (SELECT role, min(n)::BIGINT AS floor FROM (SELECT month, role, sum(n) AS n FROM s GROUP BY 1, 2) GROUP BY 1) USING (role)"
_SAMPLED = _draws_sql("SELECT month || '|' || role AS g, '' AS v, domain::VARCHAR AS cell, n FROM s", _FLOOR) + ", x AS (SELECT perm_id, split_part(g, '|', 1) AS month, split_part(g, '|', 2) AS role, cell AS domain, n FROM dr)"
_NULL_CURVES = f"{_sides_of_counts('x', chr(123) + chr(39) + 'k' + chr(39) + ': perm_id, ' + chr(39) + 'm' + chr(39) + ': month' + chr(125))}, g AS (SELECT month.k AS perm_id, month.m AS month, entropy_user, js_distance FROM ({CURVES}))"

#: All messages of both roles, which the shuffles deal one by one.
_ROWS = f"{MSG}, s AS (SELECT conv_id || '-' || turn AS row_id, month, role, domain FROM m WHERE role IN ('user', 'assistant'))"


def _rank_sql(within: str) -> str:
    """CTE r: the messages ranked by hash in each draw and group."""
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY perm_id{within} ORDER BY md5(perm_id || '|42|' || row_id), row_id) AS rk FROM s, range(0, {DRAWS}) q(perm_id))"


def _row_curves_sql(rows: str) -> str:
    """CTEs to g(perm_id, month, curves) from a table of dealt or sampled messages x."""
    return f"""{rows}, y AS (SELECT {{'k': perm_id, 'm': month}} AS km, role, domain FROM x), {sides('z AS (SELECT 1)', 'y', 'km')}, g AS (SELECT month.k AS perm_id, month.m AS month, user_msgs, assistant_msgs, entropy_user, js_distance FROM ({CURVES}))"""


_MONTHS_SHUFFLED = f"{_rank_sql('')}, b AS (SELECT month AS month_perm, sum(count(*)) OVER (ORDER BY month) AS upto, sum(count(*)) OVER (ORDER BY month) - count(*) AS below FROM s GROUP BY month), x AS (SELECT perm_id, month_perm AS month, role, domain FROM r JOIN b ON rk > below AND rk <= upto)"
_ROLES_SHUFFLED = f"{_rank_sql(', month')}, b AS (SELECT month, role AS role_perm, sum(count(*)) OVER w AS upto, sum(count(*)) OVER w - count(*) AS below FROM s GROUP BY month, role WINDOW w AS (PARTITION BY month ORDER BY role)), x AS (SELECT perm_id, r.month, role_perm AS role, domain FROM r JOIN b ON r.month = b.month AND rk > below AND rk <= upto)"
_ROWS_SAMPLED = f"{_rank_sql(', month, role')}, b AS (SELECT role, min(n) AS floor FROM (SELECT month, role, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1), x AS (SELECT perm_id, month, r.role, domain FROM r JOIN b ON r.role = b.role AND rk <= floor)"


def counted(rows: DataFrame, least: int, category: str = "domain") -> DataFrame:
    """(month, role, category, n) of messages with text, of the months in which each role has ``least`` of them; the rows are read once."""
    c = rows.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0)).groupBy("month", "role", category).agg(F.count("*").alias("n"))
    c = S.stored(c)
    roles = c.groupBy("month").agg(*[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(r) for r in ("user", "assistant")])
    return c.join(roles.where((F.col("user") >= least) & (F.col("assistant") >= least)).select("month"), "month", "left_semi")


def _counts(spark, d):
    return counted(S.conversations(spark, d), MONTH_ROWS)


def contrasts_of_counts(counts: DataFrame, keys: list[str], category: str = "domain") -> DataFrame:
    """The contrasts of each key by its counts (keys, month, role, category, n)."""
    side = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0))
    c = counts.groupBy(*keys, "month", category).agg(side("user").alias("l"), side("assistant").alias("r"))
    return resample.contrasts(dist.curves_of_counts(c, [*keys, "month"]), "month", keys, CONTRASTS)


def _messages(spark, d):
    return S.conversations(spark, d).where("role in ('user', 'assistant')").select(F.col("node_id").alias("row_id"), "month", "role", "domain")


def _null_contrasts(rows: DataFrame) -> DataFrame:
    return resample.contrasts(dist.curves(rows, "month", "role", "domain", keys=("perm_id",)), "month", ["perm_id"], CONTRASTS)


def _months_dealt(rows: DataFrame) -> DataFrame:
    return resample.deal(rows, "row_id", "month", DRAWS).select("perm_id", F.col("month_perm").alias("month"), "role", "domain")


def _roles_dealt(rows: DataFrame) -> DataFrame:
    return resample.deal(rows, "row_id", "role", DRAWS, within=("month",)).select("perm_id", "month", F.col("role_perm").alias("role"), "domain")


def _rows_sampled(rows: DataFrame) -> DataFrame:
    return resample.sample_equal(rows, "row_id", "month", "role", DRAWS)


@query(f"WITH {_ROWS}, {_row_curves_sql(_MONTHS_SHUFFLED)} SELECT perm_id, {_CONTRASTS} FROM g GROUP BY perm_id")
def perm_month_shuffle(spark, d):
    """The contrasts of every shuffle of the months over all messages."""
    return _null_contrasts(_months_dealt(_messages(spark, d)))


@query(f"WITH {_ROWS}, {_ROLES_SHUFFLED} SELECT perm_id, month, domain, count(*) FILTER (role = 'user') AS user_n FROM x GROUP BY 1, 2, 3")
def perm_role_shuffle(spark, d):
    """Messages that every shuffle of the roles within months gives to users, by month and domain."""
    return _roles_dealt(_messages(spark, d)).groupBy("perm_id", "month", "domain").agg(F.count_if(F.col("role") == "user").alias("user_n"))


@query(f"WITH RECURSIVE {_MSGS}, {_SAMPLED}, {_NULL_CURVES} SELECT perm_id, {_CONTRASTS} FROM g GROUP BY perm_id")
def volume_control(spark, d):
    """The contrasts of samples of one size a month and role."""
    return contrasts_of_counts(resample.null_tables(_counts(spark, d), "month", "role", "domain", DRAWS)["volume"], ["perm_id"])


def _pvalues_sql() -> str:
    models = {"months": _MONTHS_SHUFFLED, "roles": _ROLES_SHUFFLED, "volume": _ROWS_SAMPLED}
    real = f"e AS (SELECT {_CONTRASTS} FROM ({CURVES}))"
    parts = []
    for name, rows in models.items():
        cols = [f"max(e.{c}) AS real_{c}" for c in CONTRASTS] + [f"round(avg(CASE WHEN e.{c} >= 0 AND g.{c} >= e.{c} OR e.{c} < 0 AND g.{c} <= e.{c} THEN 1.0 ELSE 0 END) FILTER (e.{c} IS NOT NULL AND g.{c} IS NOT NULL), 6) AS p_{c}" for c in CONTRASTS]
        parts.append(f"SELECT '{name}' AS model, {', '.join(cols)} FROM (WITH {_row_curves_sql(rows)} SELECT perm_id, {_CONTRASTS} FROM g GROUP BY perm_id) g, (WITH {sides('z AS (SELECT 1)', 's', 'month')}, {real} SELECT * FROM e) e")
    return f"WITH {_ROWS} " + " UNION ALL ".join(parts)


def null_pvalues(counts: DataFrame, draws: int, within: tuple[str, ...] = (), category: str = "domain") -> DataFrame:
    """(model, within, real and p of each contrast) of the three null models of a count table, which is all that is drawn from."""
    real = contrasts_of_counts(counts, list(within), category)
    parts = []
    for name, drawn in resample.null_tables(counts, "month", "role", category, draws, within).items():
        null = contrasts_of_counts(drawn, [*within, "perm_id"], category)
        parts.append(resample.sided_pvalues(null, real, list(CONTRASTS), within).select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query(_pvalues_sql())
def null_model_pvalues(spark, d):
    """Real contrasts and the shares of draws as far out, by null model, each draw made of all messages."""
    rows = S.stored(_messages(spark, d))
    real = resample.contrasts(dist.curves(rows, "month", "role", "domain"), "month", [], CONTRASTS)
    parts = []
    for name, drawn in {"months": _months_dealt, "roles": _roles_dealt, "volume": _rows_sampled}.items():
        parts.append(resample.sided_pvalues(_null_contrasts(drawn(rows)), real, list(CONTRASTS)).select(F.lit(name).alias("model"), "*"))
    return rounded(reduce(DataFrame.unionByName, parts), *[f"p_{c}" for c in CONTRASTS])


@query(_G + shuffled_sql(SHUFFLES) + " SELECT perm_id, round(avg(f), 6) AS forward, round(avg(b), 6) AS reverse, round(avg(f) - avg(b), 6) AS difference FROM zc GROUP BY perm_id")
def perm_coupling(spark, d):
    x = _order_pairs(spark, d)
    return rounded(resample.shuffled_coupling(x, "month", "domain", "delta_u", "delta_a", SHUFFLES), "forward", "reverse", "difference")


def coupling_pvalues(pairs: DataFrame, period: str, n: int) -> DataFrame:
    """One row: the means, and the shares of n shuffles as large as forward and reverse and as far from 0 as the difference."""
    real = _mean_coupling(pairs, period)
    null = resample.shuffled_coupling(pairs, period, "domain", "delta_u", "delta_a", n)
    names = ["forward", "reverse", "difference"]
    met = null.select(*[F.round(c, 9).alias(f"_{c}") for c in names]).crossJoin(F.broadcast(real))
    p = {c: stats.perm_pvalue(met, f"_{c}", F.round(c, 9), "abs" if c == "difference" else "greater") for c in names}
    return met.agg(*[F.max(c).alias(c) for c in names], *[p[c].alias(f"p_{c}") for c in names])


PVALUES = """, re AS (SELECT avg(f) AS f, avg(b) AS b FROM cs), nl AS (SELECT perm_id, avg(f) AS f, avg(b) AS b FROM zc GROUP BY 1),
pv AS (SELECT max(re.f) AS forward, max(re.b) AS reverse, max(re.f - re.b) AS difference, avg(CASE WHEN round(nl.f, 9) >= round(re.f, 9) THEN 1.0 ELSE 0 END) AS p_forward, avg(CASE WHEN round(nl.b, 9) >= round(re.b, 9) THEN 1.0 ELSE 0 END) AS p_reverse,
avg(CASE WHEN round(abs(nl.f - nl.b), 9) >= round(abs(re.f - re.b), 9) THEN 1.0 ELSE 0 END) AS p_difference FROM nl, re)"""


@query(_G + shuffled_sql(SHUFFLES) + PVALUES + " SELECT round(forward, 6) AS forward, round(reverse, 6) AS reverse, round(difference, 6) AS difference, round(p_forward, 6) AS p_forward, round(p_reverse, 6) AS p_reverse, round(p_difference, 6) AS p_difference FROM pv")
def monthly_coupling_pvalues(spark, d):
    p = coupling_pvalues(_order_pairs(spark, d), "month", SHUFFLES)
    return rounded(p, *p.columns)


@query(_G + """, v AS (SELECT domain, p, du, da2, domain || '|' || p AS row_id FROM pr WHERE du IS NOT NULL AND da2 IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY perm_id, domain ORDER BY row_id) AS pos, row_number() OVER (PARTITION BY perm_id, domain ORDER BY md5(perm_id || '|42|' || row_id), row_id) AS dst FROM v, range(0, N_) q(perm_id)),
nl AS (SELECT a.perm_id, a.domain, corr(a.du, b.da2) AS r FROM k a JOIN k b ON a.perm_id = b.perm_id AND a.domain = b.domain AND a.pos = b.dst GROUP BY 1, 2), re AS (SELECT domain, corr(du, da2) AS r FROM v GROUP BY 1)
SELECT domain, round(any_value(re.r), 6) AS r, round(avg(CASE WHEN round(abs(nl.r), 9) >= round(abs(re.r), 9) THEN 1.0 ELSE 0 END), 6) AS p_abs FROM nl JOIN re USING (domain) GROUP BY domain""".replace("N_", str(SHUFFLES)))
def perm_domain_pearson(spark, d):
    v = _pairs(spark, d).select("domain", F.concat_ws("|", "domain", "month").alias("row_id"), "delta_u", "next_a")
    real = stats.pearson(v, ["domain"], "delta_u", "next_a").select("domain", "r")
    null = stats.pearson(stats.permute(v, "row_id", "next_a", SHUFFLES, within=("domain",)), ["perm_id", "domain"], "delta_u", "next_a_perm").select("domain", F.col("r").alias("_n"))
    far = (F.round(F.abs("_n"), 9) >= F.round(F.abs("r"), 9)).cast("double")
    return rounded(null.join(real, "domain").groupBy("domain").agg(F.max("r").alias("r"), F.avg(far).alias("p_abs")), "r", "p_abs")


@query(f"WITH {EVT}" + """, c AS (SELECT domain, day AS p, count(*) FILTER (role = 'user') AS l, count(*) FILTER (role = 'assistant') AS r FROM e GROUP BY 1, 2),
q AS (SELECT *, count(*) FILTER (l > 0) OVER w AS la, count(*) FILTER (r > 0) OVER w AS ra, count(*) OVER w AS k, l / sum(l) OVER w AS u, r / sum(r) OVER w AS a FROM c WINDOW w AS (PARTITION BY domain)),
n AS (SELECT *, lead(u) OVER w AS u2, lead(a) OVER w AS a2 FROM q WHERE la >= 8 AND ra >= 8 WINDOW w AS (PARTITION BY domain ORDER BY p)), v AS (SELECT *, domain || '|' || p AS row_id FROM n WHERE u2 IS NOT NULL),
re AS (SELECT domain, max(k) AS periods, max(la) AS left_active, max(ra) AS right_active, sum(u * a2) / nullif(sqrt(sum(u * u) * sum(a2 * a2)), 0) AS f, sum(a * u2) / nullif(sqrt(sum(a * a) * sum(u2 * u2)), 0) AS b FROM v GROUP BY domain),
k AS (SELECT *, row_number() OVER (PARTITION BY perm_id, domain ORDER BY row_id) AS pos, row_number() OVER (PARTITION BY perm_id, domain ORDER BY md5(perm_id || '|42|' || row_id), row_id) AS dst FROM v, range(0, N_) z(perm_id)),
nl AS (SELECT x.perm_id, x.domain, sum(x.u * y.a2) / nullif(sqrt(sum(x.u * x.u) * sum(y.a2 * y.a2)), 0) AS f FROM k x JOIN k y ON x.perm_id = y.perm_id AND x.domain = y.domain AND x.pos = y.dst GROUP BY 1, 2)
SELECT re.domain, periods, left_active, right_active, round(re.f, 6) AS forward, round(re.b, 6) AS reverse, round(re.f - re.b, 6) AS difference, round(avg(CASE WHEN round(abs(nl.f - re.b), 9) >= round(abs(re.f - re.b), 9) THEN 1.0 ELSE 0 END), 6) AS p_abs FROM nl JOIN re ON nl.domain = re.domain GROUP BY ALL""".replace("N_", str(SHUFFLES)))
def domain_lead_lag(spark, d):
    return rounded(resample.lead_lag(S.event_facts(spark, d), "day", "domain", "role", n=SHUFFLES), "forward", "reverse", "difference", "p_abs")


# s is materialized: inlined, this DuckDB gives 7 of its 8 rows (U is 7.5 by hand on the smallest tables).
@query(_SERIES + """, s AS MATERIALIZED (SELECT t < 4 AS g, n FROM v WHERE domain = '1-URGENT' AND t < 8), k AS (SELECT row_number() OVER (ORDER BY n, g) - 1 AS i, g, n FROM s), z AS (SELECT count(*) FILTER (g) AS a, count(*) AS c FROM s),
mk AS (SELECT b AS m FROM range(0, 256) q(b), z WHERE bit_count(b) = z.a AND b < (1 << z.c::INTEGER)), uu AS (SELECT m, sum(CASE WHEN x.n > y.n THEN 1.0 WHEN x.n = y.n THEN 0.5 ELSE 0 END) AS u FROM mk, k x, k y WHERE (m >> x.i::INTEGER) & 1 = 1 AND (m >> y.i::INTEGER) & 1 = 0 GROUP BY m),
re AS (SELECT sum(CASE WHEN x.n > y.n THEN 1.0 WHEN x.n = y.n THEN 0.5 ELSE 0 END) AS u FROM k x, k y WHERE x.g AND NOT y.g) SELECT max(z.a) AS n_a, max(z.c - z.a) AS n_b, max(re.u)::DOUBLE AS u, round(avg(CASE WHEN uu.u >= re.u THEN 1.0 ELSE 0 END), 6) AS p_greater FROM uu, re, z""")
def rank_sum_early_late(spark, d):
    s = _series(spark, d).where("domain = '1-URGENT' and t < 8")
    return rounded(resample.rank_sum(s, F.col("t") < 4, "n"), "p_greater")


@query(_SERIES + """, r AS (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY n) + (count(*) OVER (PARTITION BY domain, n) - 1) / 2 AS rx, rank() OVER (PARTITION BY domain ORDER BY t) AS rt FROM v), c AS (SELECT domain, corr(rx, rt) AS rho, count(*)::INTEGER AS n FROM r GROUP BY domain), x AS (SELECT *, abs(rho) AS si, sqrt(1 - rho * rho) AS co, (n - 2) // 2 AS terms, n % 2 = 1 AS odd FROM c)
SELECT domain, n::BIGINT AS n, round(CASE WHEN odd THEN 1 - 2 / pi() * (asin(si) + si * list_sum(list_transform(range(0, terms), lambda k: co ** (2 * k + 1) * sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5))))) ELSE 1 - si * list_sum(list_transform(range(0, terms), lambda k: co ** (2 * k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()))) END, 6) AS p_value FROM x""")
def spearman_pvalue(spark, d):
    r = stats.spearman(_series(spark, d).withColumnRenamed("n", "k"), ["domain"], "k", "t")
    return r.select("domain", "n", F.round(stats.correlation_pvalue(F.col("rho"), F.col("n")), 6).alias("p_value"))


# ---- threads and trees


MAIN_PATH = f"""WITH RECURSIVE {NODES}, walk AS (SELECT conv_id, node_id, 1 AS depth, lpad(CAST(turn AS VARCHAR), 4, '0') AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.conv_id, n.node_id, w.depth + 1, w.path || '/' || lpad(CAST(n.turn AS VARCHAR), 4, '0') FROM n JOIN walk w ON n.conv_id = w.conv_id AND n.parent_id = w.node_id),
best AS (SELECT conv_id, path FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC, path) = 1) SELECT w.conv_id, CAST(w.depth - 1 AS BIGINT) AS pos, w.node_id FROM walk w JOIN best b ON w.conv_id = b.conv_id AND starts_with(b.path, w.path)"""


@query(MAIN_PATH)
def tree_main_path(spark, d):
    return tree.main_path(S.conversations(spark, d), "conv_id", "node_id", "parent_id", "turn")


@query(MAIN_PATH)
def tree_main_path_large(spark, d):
    """The same paths, threads of over four rows walked by joins."""
    return tree.main_path(S.conversations(spark, d), "conv_id", "node_id", "parent_id", "turn", most_rows=4)


@query(f"WITH {NODES} SELECT conv_id, node_id FROM n WHERE parent_id IS NULL")
def tree_roots(spark, d):
    return tree.roots(S.conversations(spark, d), "conv_id", "node_id", "parent_id").select("conv_id", "node_id")


@query("SELECT conv_id, string_agg('[' || upper(role) || '] ' || turn || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def thread_transcripts(spark, d):
    return tree.transcript(S.conversations(spark, d).withColumn("at", F.col("turn").cast("string")), "conv_id", "turn", "role", "at", "text")


@query(f"WITH {MSG}, t AS (SELECT conv_id, min(month) AS month, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role IN ('user', 'assistant')) AS k, sum(length(text)) AS c FROM m GROUP BY conv_id) SELECT month, count(*) AS threads, round(median(c / nullif(k, 0)), 6) AS med_chars_per_msg, round(median(u / nullif(k, 0)), 6) AS med_user_share FROM t GROUP BY month")
def thread_complexity_monthly(spark, d):
    t = S.conversations(spark, d).groupBy("conv_id").agg(F.min("month").alias("month"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role").isin("user", "assistant")).alias("k"), F.sum(F.length("text")).alias("c"))
    t = S.stored(t.select("month", X.share(F.col("c"), F.col("k")).alias("chars"), X.share(F.col("u"), F.col("k")).alias("share")))
    out = t.groupBy("month").agg(F.count("*").alias("threads"))
    for value, name in (("chars", "med_chars_per_msg"), ("share", "med_user_share")):
        out = out.join(quantiles.quantiles(t, ["month"], value, {name: 0.5}), "month", "left")
    return rounded(out, "med_chars_per_msg", "med_user_share")


# ---- vectors


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, i::INTEGER AS i, round(avg(v), 6) AS mean FROM x GROUP BY 1, 2")
def centroid_mean(spark, d):
    e = S.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 5) AS norm FROM embeddings")
def l2_norms(spark, d):
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return S.table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(sq), 5).alias("norm"))


@query("""WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label AS assigned, i, avg(v) AS m FROM x GROUP BY 1, 2),
q AS (SELECT vec_id, assigned, sum((v - m) * (v - m)) AS distance FROM x JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, assigned, round(distance, 5) AS distance FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, assigned) = 1""")
def nearest_centroid_assign(spark, d):
    e = S.table(spark, d, "embeddings")
    return topics.nearest_centroid(e.select("vec_id", "embedding"), "embedding", topics.centroids(e, "label", "embedding"), "label").select("vec_id", "assigned", F.round("distance", 5).alias("distance"))


# ---- topics

STOP = ["the", "of", "and", "to", "in", "is"]
TFIDF = r"""w AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in', 'is')) AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.6::DOUBLE * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT 60000),
x AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS x FROM f JOIN v USING (term)),
g AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM x)"""


@query(f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM g")
def tfidf_weights(spark, d):
    return rounded(topics.tfidf(S.table(spark, d, "documents"), "doc_id", "text", STOP), "weight")


@query(f"WITH {TFIDF}, s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT source, term, round(sum(weight) / any_value(s.n), 6) AS mean FROM g JOIN documents USING (doc_id) JOIN s USING (source) GROUP BY 1, 2) SELECT source, row_number() OVER (PARTITION BY source ORDER BY mean DESC, term)::INTEGER AS rank, term, mean FROM m QUALIFY rank <= 20")
def cluster_top_terms(spark, d):
    docs = S.table(spark, d, "documents")
    return topics.top_terms(topics.tfidf(docs, "doc_id", "text", STOP), docs, "doc_id", "source")


@query()
def topic_holdout(spark, d):
    """Clusters and domains of all documents by a model fitted on those of the first two sources by name."""
    docs = S.table(spark, d, "documents")
    first = F.broadcast(docs.select("source").distinct().orderBy("source").limit(2))
    model = topic_model.fit(docs.join(first, "source", "left_semi"), "text", 60, 8, X.ENGLISH_STOP)
    return model.transform(docs).select("doc_id", "source", "cluster", "domain")


@query(f"WITH {TFIDF}, s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT source, term, round(sum(weight) / any_value(s.n), 6) AS mean FROM g JOIN documents USING (doc_id) JOIN s USING (source) GROUP BY 1, 2), k AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY mean DESC, term) AS rank FROM m QUALIFY rank <= 20), sc AS (SELECT length(source) % 2 AS domain, term, sum(s.n * (21 - rank)) AS score FROM k JOIN s USING (source) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 25) SELECT domain::INTEGER AS domain, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 6) AS auto_label, string_agg(term, ', ' ORDER BY rank) AS top_terms FROM o GROUP BY domain")
def macro_label_terms(spark, d):
    docs = S.table(spark, d, "documents")
    fine = topics.top_terms(topics.tfidf(docs, "doc_id", "text", STOP), docs, "doc_id", "source")
    size = docs.groupBy("source").agg(F.count("*").alias("size"), F.any_value(F.length("source") % 2).alias("domain"))
    return topics.domain_labels(fine, size, "source", "domain")


@query()
def svd_topics(spark, d):
    """Clusters of all documents after a truncated SVD of their weights, rows of length 1, the best of ten starts."""
    models, reduced = svd.fit_texts(S.table(spark, d, "documents"), "doc_id", "text", X.ENGLISH_STOP, [(60, 200)])
    return models[60, 200].assign(reduced, "doc_id")


#: Numbers of clusters and of dimensions, and the messages of each role that a month needs.
GRID, GRID_MONTH_ROWS = ((40, 60, 80), (100, 200)), 50
GRID_NAMES = {"entropy_peak_early": ("entropy_contrast_peak_minus_early", "entropy"), "js_spike": ("js_spike_contrast_sep_oct_minus_may_aug", "js_spike"), "js_recovery": ("js_recovery_contrast_nov_dec_minus_sep_oct", "js_recovery")}
GRID_MODELS = {"months": "month_shuffle", "roles": "role_shuffle", "volume": "volume_control"}


def grid_tests(counts: DataFrame, draws: int) -> DataFrame:
    """A row a setting (k, svd_dims) of counts (k, svd_dims, month, role, cluster, n): its contrasts, nine p-values and the smallest months."""
    keys = ("k", "svd_dims")
    p = S.stored(null_pvalues(counts, draws, keys, "cluster"))
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    real = [F.max(f"real_{c}").alias(name) for c, (name, _) in GRID_NAMES.items()]
    shares = [of(m, f"p_{c}").alias(f"p_{label}_{short}") for m, label in GRID_MODELS.items() for c, (_, short) in GRID_NAMES.items()]
    size = counts.groupBy(*keys, "month", "role").agg(F.sum("n").alias("n")).groupBy(*keys)
    least = size.agg(*[F.min(F.when(F.col("role") == r, F.col("n"))).alias(f"min_{r}_per_month") for r in ("user", "assistant")])
    return p.groupBy(*keys).agg(*real, *shares).join(least, list(keys))


@query()
def robustness_grid(spark, d):
    """The contrasts of periods and their null models for each number of clusters and of dimensions; no rows where no month has enough messages."""
    m = S.conversations(spark, d).where("role in ('user', 'assistant') and length(text) > 0").select("month", "role", "text")
    m = S.stored(dist.qualifying(m, "month", "role", GRID_MONTH_ROWS).select(F.struct("month", "role").alias("side"), "text"))
    models, reduced = svd.fit_texts(m, "side", "text", X.ENGLISH_STOP, [(k, n) for k in GRID[0] for n in GRID[1]])
    parts = []
    for (k, dims), model in models.items():
        told = model.assign(reduced, "side").groupBy("side.month", "side.role", "cluster").agg(F.count("*").alias("n"))
        parts.append(told.select(F.lit(k).alias("k"), F.lit(dims).alias("svd_dims"), "*"))
    return grid_tests(S.stored(reduce(DataFrame.unionByName, parts)), DRAWS)


# ---- cleaning, maps and checks


@query(r"SELECT page_id, CASE WHEN t = '' THEN 'untitled' ELSE substring(t, 1, 120) END AS title FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(url, ''), '[^\p{L}\p{N}_\s\-.()]', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages)")
def safe_titles(spark, d):
    return S.table(spark, d, "pages").select("page_id", X.safe_title(F.col("url")).alias("title"))


@query(r"SELECT conv_id, turn, regexp_replace(text || chr(10) || role, '^\s+|\s+$', '', 'g') AS flat FROM conversations WHERE text IS NOT NULL")
def content_flatten(spark, d):
    c = S.table(spark, d, "conversations").where(F.col("text").isNotNull())
    part = F.to_json(F.struct(F.col("role").alias("text")))
    return c.select("conv_id", "turn", S.content_text(F.concat(F.lit('{"parts":['), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(","), part, F.lit("]}"))).alias("flat"))


@query(f"WITH {EVT}, x AS (SELECT domain, count(*) AS n FROM e WHERE role = 'user' GROUP BY 1), o AS (SELECT domain, count(*) AS n FROM e WHERE role = 'user' AND day >= DATE '2024-01-03' GROUP BY 1) SELECT domain, x.n AS expected, coalesce(o.n, 0) AS observed, coalesce(o.n, 0) - x.n AS diff FROM x LEFT JOIN o USING (domain)")
def repro_check_left_join(spark, d):
    e = S.event_facts(spark, d).where("role = 'user'")
    n = lambda df, name: df.groupBy("domain").agg(F.count("*").alias(name))
    j = n(e, "expected").join(n(e.where("day >= date'2024-01-03'"), "observed"), "domain", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return j.withColumn("diff", F.col("observed") - F.col("expected"))


@query("SELECT label, CASE WHEN label % 5 < 3 THEN label % 5 END AS macro, count(*) AS n FROM embeddings GROUP BY 1, 2")
def fine_to_macro_map(spark, d):
    """Labels by a map whose domains list their labels as text; a label that no domain lists has none."""
    e = S.table(spark, d, "embeddings")
    listed = e.select("label").distinct().where("label % 5 < 3").groupBy((F.col("label") % 5).alias("macro")).agg(F.array_join(F.collect_list(F.col("label").cast("string")), ", ").alias("fine"))
    lookup = listed.select("macro", F.explode(X.int_list(F.col("fine"))).alias("label"))
    return e.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(lookup), "label", "left").select("label", "macro", "n")


# ---- tables behind figures


@query(_SERIES + " SELECT domain, month, round(100.0 * n / first_value(n) OVER (PARTITION BY domain ORDER BY month), 6) AS idx, round((n - min(n) OVER q)::DOUBLE / (max(n) OVER q - min(n) OVER q), 6) AS minmax FROM v WINDOW q AS (PARTITION BY domain)")
def fig_index_and_minmax(spark, d):
    w, q = Window.partitionBy("domain").orderBy("month"), Window.partitionBy("domain")
    s = _series(spark, d)
    return s.select("domain", "month", F.round(F.col("n") * 100.0 / F.first("n").over(w), 6).alias("idx"), F.round((F.col("n") - F.min("n").over(q)) / (F.max("n").over(q) - F.min("n").over(q)), 6).alias("minmax"))


@query(_SERIES + " SELECT domain, month, CASE WHEN count(*) OVER w = 5 THEN round(avg(n) OVER w, 6) END AS rolling FROM v WINDOW w AS (PARTITION BY domain ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def fig_rolling_mean(spark, d):
    w = Window.partitionBy("domain").orderBy("month").rowsBetween(-2, 2)
    return _series(spark, d).select("domain", "month", F.when(F.count("*").over(w) == 5, F.round(F.avg("n").over(w), 6)).alias("rolling"))


@query(f"WITH {sides(MSG, 'm', 'month')}, s AS (SELECT domain, coalesce(l / nullif(ls, 0), 0) AS u, coalesce(r / nullif(rs, 0), 0) AS a FROM (SELECT DISTINCT p FROM c) x1 CROSS JOIN (SELECT DISTINCT domain FROM c) x2 LEFT JOIN c USING (p, domain)) SELECT domain, round(avg(u), 6) AS user_share, round(avg(a), 6) AS assistant_share, round(avg(u) - avg(a), 6) AS lead FROM s GROUP BY domain")
def fig_lead_by_domain(spark, d):
    s = dist.scaffolded(S.conversations(spark, d), "month", "domain", "role", "user", "assistant")
    return s.groupBy("domain").agg(F.round(F.avg("left_share"), 6).alias("user_share"), F.round(F.avg("right_share"), 6).alias("assistant_share"), F.round(F.avg("left_share") - F.avg("right_share"), 6).alias("lead"))


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "not_specified", "5-LOW": "low"}


@query(_SERIES + f", p AS (SELECT domain, month, n / sum(n) OVER (PARTITION BY month) AS share FROM v) SELECT month, {', '.join(f"round(coalesce(sum(share) FILTER (domain = '{v}'), 0), 6) AS {name}" for v, name in PRIORITIES.items())}, arg_max(domain, (share, domain)) AS dominant FROM p GROUP BY month")
def fig_share_pivot(spark, d):
    p = _series(spark, d).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("month")))
    part = lambda v: F.round(F.coalesce(F.sum(F.when(F.col("domain") == v, F.col("share"))), F.lit(0.0)), 6)
    return p.groupBy("month").agg(*[part(v).alias(name) for v, name in PRIORITIES.items()], F.max_by("domain", F.struct("share", "domain")).alias("dominant"))


@query("WITH t AS (SELECT conv_id, count(*) AS msgs, sum(length(text)) / count(*) AS chars FROM conversations GROUP BY 1) SELECT conv_id, msgs, round(greatest(10.0, least(300.0, chars / max(chars) OVER () * 300)), 6) AS size, row_number() OVER (ORDER BY msgs DESC, conv_id) <= 5 AS labelled FROM t")
def fig_thread_scatter(spark, d):
    t = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("msgs"), (F.sum(F.length("text")) / F.count("*")).alias("chars"))
    top = t.orderBy(F.desc("msgs"), "conv_id").limit(5).select("conv_id", F.lit(True).alias("_top"))
    x = t.crossJoin(F.broadcast(t.agg(F.max("chars").alias("_max")))).join(F.broadcast(top), "conv_id", "left")
    return x.select("conv_id", "msgs", F.round(F.greatest(F.lit(10.0), F.least(F.lit(300.0), F.col("chars") / F.col("_max") * 300)), 6).alias("size"), F.coalesce("_top", F.lit(False)).alias("labelled"))


@query(_SERIES + ", q AS (SELECT *, (n - min(n) OVER w)::DOUBLE / nullif(max(n) OVER w - min(n) OVER w, 0) AS z FROM v WINDOW w AS (PARTITION BY domain)) SELECT domain, round(coalesce(arg_min(z, month), 0.5), 6) AS first, round(coalesce(arg_max(z, month), 0.5), 6) AS last, round(arg_max(n, month) / arg_min(n, month)::DOUBLE - 1, 6) AS growth FROM q GROUP BY domain")
def fig_radar(spark, d):
    w = Window.partitionBy("domain")
    q = _series(spark, d).withColumn("z", (F.col("n") - F.min("n").over(w)) / F.nullif(F.max("n").over(w) - F.min("n").over(w), F.lit(0)))
    at = lambda f, x: F.round(F.coalesce(f(x, "month"), F.lit(0.5)), 6)
    return q.groupBy("domain").agg(at(F.min_by, "z").alias("first"), at(F.max_by, "z").alias("last"), F.round(F.max_by("n", "month") / F.min_by("n", "month") - 1, 6).alias("growth"))


from . import more  # noqa: E402, F401  (its queries join the others)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
