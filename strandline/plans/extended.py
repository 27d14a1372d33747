"""Further registered queries: transforms within runs, joins, profiles, graph measures and splits, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import ids
from strandline.operators import blocks as B
from strandline.operators import decoding as M
from strandline.operators import joins as J
from strandline.operators import matching as G
from strandline.operators import occupancy as O
from strandline.operators import profiles as W
from strandline.operators import projections as Z
from strandline.operators import similarity as S
from strandline.operators import splits as P
from strandline.operators import stats as T
from strandline.operators import taxonomy as X
from strandline.operators import transitions as R
from strandline.plans.registry import ORACLE_SQL, QUERIES, _BLOCKS, _CHANGES, _FO, _KINDS, _MEANS, _RUNS, _SEASON, _STATES, _TRANS, _acquired, _blocks, _changes, _fo, _p, _query, _runs, _seasonal
from strandline.sources import fixtures as D

__all__ = ["QUERIES", "ORACLE_SQL"]

_SIGNAL = """
sg as (select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as tr, value::double as x from events)"""
_LN = "ln as (select run, count(*) as n_trs from sg group by run)"


def _signal(spark: SparkSession, d: str) -> DataFrame:
    """(run, tr, x): the values of a run's events in time order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return D.table(spark, d, "events").select(F.col("user_id").alias("run"), place.cast("int").alias("tr"), F.col("value").cast("double").alias("x"))


# transforms within runs


@_query("prj4_zscore", f"with {_SIGNAL}, m as (select run, avg(x) as a, case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end as s from sg group by run) select run, tr, (x - a) / s as z from sg join m using (run)")
def prj4(spark, d):
    return Z.zscored(_signal(spark, d)).select("run", "tr", "z")


@_query("prj7_lag_shift", f"with {_SIGNAL} select run, tr, lag(x, 3, 0.0) over (partition by run order by tr) as x from sg")
def prj7(spark, d):
    return Z.lagged(_signal(spark, d), 3)


@_query("prj8_drop_onsets", f"with {_SIGNAL}, {_RUNS}, {_LN} select sg.run, tr, x from sg join ln using (run) join rn using (run) where not (part = 'a' and n_trs > 33 and tr < 33)")
def prj8(spark, d):
    return Z.without_onsets(D.with_run_fields(_signal(spark, d)), 33, ("a",)).select("run", "tr", "x")


@_query("prj8_drop_first", f"with {_SIGNAL}, {_LN} select sg.run, tr, x from sg join ln using (run) where not (n_trs > 10 and tr < 10)")
def prj8b(spark, d):
    return Z.without_onsets(_signal(spark, d), 10)


@_query(
    "prj10_timing_design",
    f"""with {_SIGNAL}, {_RUNS}, {_LN}, od as (select run, row_number() over (order by season, episode, part, run) - 1 as i from rn), tp as (select max(i) as last from od), ts as (select max(season) as seasons from rn),
    w as (select sg.run, tr, case when n_trs > 1 then tr::double / (n_trs - 1) else 0 end as pos, i, last, season, seasons from sg join ln using (run) join rn using (run) join od using (run), tp, ts)
    select run, tr, case when tr = 0 then 1.0::double else 0 end as onset, pos, pos * pos as pos_sq, pos * pos * pos as pos_cu, case when last > 0 then i::double / last else i end as episode_norm, case when seasons > 0 then season::double / seasons else season end as season_norm from w""",
)
def prj10(spark, d):
    return Z.timing_design(D.with_run_fields(_signal(spark, d)))


@_query("prj11_residual", f"with {_SIGNAL}, f as (select run, regr_slope(x, tr) as b, regr_intercept(x, tr) as a from sg group by run) select run, tr, case when b is null then x else x - a - b * tr end as residual from sg join f using (run)")
def prj11(spark, d):
    return Z.residual(_signal(spark, d), "x", "tr", ("run",)).select("run", "tr", "residual")


@_query("prj12_relabel", f"with {_STATES}, k as (select state, cast(row_number() over (order by state) - 1 as integer) as position from (select state from st group by state having count(*) >= 20)) select run, tr, coalesce(position, -1) as state from st left join k using (state)")
def prj12(spark, d):
    st = D.states(spark, d)
    kept = st.groupBy("state").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return Z.relabelled(st, kept.withColumn("position", (F.row_number().over(Window.orderBy("state")) - 1)))  # one row a state


_DETREND = f"""with {_FO}, {_RUNS}, ix as (select run, k - avg(k) over (partition by subject) as centred from (select run, subject, row_number() over (partition by subject order by run)::double as k from rn)),
sl as (select state, regr_slope(fo, centred) as slope from fo join ix using (run) group by state),
dt as (select run, state, fo - coalesce(slope, 0) * centred as x from fo join ix using (run) join sl using (state))"""


def _detrended(spark, d):
    k = F.row_number().over(Window.partitionBy("subject").orderBy("run")).cast("double")
    index = _runs(spark, d).select("run", "subject", k.alias("k")).select("run", (F.col("k") - F.avg("k").over(Window.partitionBy("subject"))).alias("centred"))
    fo = _fo(spark, d)
    slopes = fo.join(index, "run").groupBy("state").agg(F.regr_slope("fo", "centred").alias("slope"))
    return Z.detrended(fo, slopes, index)


@_query("prj13_detrend", f"{_DETREND} select run, state, greatest(0.0::double, x) as fo from dt")
def prj13(spark, d):
    return _detrended(spark, d).select("run", "state", "fo")


@_query("prj13_clip", f"{_DETREND} select cast(sum(case when x < 0 then 1 else 0 end) as bigint) as n_clipped, greatest(0.0::double, max(-x)) as max_clip, 100.0::double * sum(case when x < 0 then 1 else 0 end) / count(*) as pct_clipped from dt")
def prj13b(spark, d):
    hit = (F.col("clipped") > 0).cast("long")
    return _detrended(spark, d).agg(F.sum(hit).alias("n_clipped"), F.max("clipped").alias("max_clip"), (F.sum(hit) * 100.0 / F.count(F.lit(1))).alias("pct_clipped"))


@_query(
    "prj14_frame_pooling",
    f"""with {_SIGNAL}, {_LN}, sp as (select run, cast(unnest(range(0, cast(n_trs // 3 as bigint) + 1)) as integer) as tr from ln), e as (select run, tr, greatest(0, cast(trunc(tr * 2.98::double - 2.5) as integer)) as lo, cast(trunc((tr + 1) * 2.98::double - 2.5) as integer) as hi from sp),
    p as (select e.run, e.tr, avg(sg.x) as x from e join sg on sg.run = e.run and sg.tr >= lo and sg.tr < hi where hi > lo group by e.run, e.tr)
    select sp.run, sp.tr, coalesce(x, 0.0) as x from sp left join p on p.run = sp.run and p.tr = sp.tr""",
)
def prj14(spark, d):
    sg = _signal(spark, d)
    lengths = sg.groupBy("run").agg((F.floor(F.count(F.lit(1)) / 3) + 1).alias("n_trs"))
    return Z.pooled_frames(sg.withColumnRenamed("tr", "frame"), lengths, rate=2.0, onset=1.25)


@_query(
    "prj15_token_window",
    f"""with {_SIGNAL}, b as (select run, cast(tr // 3 as integer) as tr, cast(max(tr) + 1 as bigint) as n_tokens from sg group by run, tr // 3), s as (select run, tr, n_tokens as hi, greatest(1, coalesce(lag(n_tokens, 4) over (partition by run order by tr), 0)) as lo from b)
    select s.run, s.tr, coalesce(avg(sg.x), 0.0) as x from s left join sg on sg.run = s.run and sg.tr >= lo and sg.tr < hi group by s.run, s.tr""",
)
def prj15(spark, d):
    tokens = _signal(spark, d).withColumnRenamed("tr", "tok")
    bounds = tokens.groupBy("run", F.floor(F.col("tok") / 3).cast("int").alias("tr")).agg((F.max("tok") + 1).cast("long").alias("n_tokens"))
    return Z.trailing_tokens(tokens.withColumn("tok", F.col("tok").cast("long")), bounds, 4)


@_query("prj3_replace_column", f"with {_SIGNAL}, r as (select run, tr, x * 2 as x from sg where run % 2 = 0), n as (select run, tr, x - avg(x) over (partition by run) as y from r) select run, tr, coalesce(y, x) as x from sg left join n using (run, tr)")
def prj3(spark, d):
    sg = _signal(spark, d)
    return Z.replaced(sg, sg.where("run % 2 = 0").withColumn("x", F.col("x") * 2), "x").select("run", "tr", "x")


@_query("prj16_eligible_trs", f"with {_FO}, e as (select state from fo group by state having avg(case when fo > 0.02 then 1.0 else 0.0 end) >= 0.1) select run, count(*) as n from st where state in (from e) group by run")
def prj16(spark, d):
    eligible = O.recurrence(_fo(spark, d)).where("recurrence >= 0.1")
    return J.also_in(D.states(spark, d), eligible).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@_query("prj19_config_grid", "select g::double as gamma, c as covariance, n::integer as n_components, 'g' || g || '_' || c || '_nc' || n as name from (values ('0.1'), ('1.0'), ('10.0')) a(g), (values ('diag'), ('full')) b(c), (values (25), (50)) e(n)")
def prj19(spark, d):
    return Z.config_grid(spark, [0.1, 1.0, 10.0], ["diag", "full"], [25, 50])


# joins


@_query(
    "jn1_state_tables",
    f"""with {_SEASON}, {_BLOCKS.replace(_STATES, '').lstrip(',')}, r as (select state, avg(case when fo > 0.02 then 1.0 else 0.0 end) as recurrence from fo group by state), w as (select state, avg(duration_tr) as mean_dwell from bl group by state), c as (select state, max(recurrence) - min(recurrence) as specificity from sr group by state)
    select state, recurrence, mean_dwell, specificity from r left join w using (state) left join c using (state)""",
)
def jn1(spark, d):
    dwell = B.dwell(_blocks(spark, d)).select("state", "mean_dwell")
    return O.recurrence(_fo(spark, d)).select("state", "recurrence").join(dwell, "state", "left").join(O.specificity(_seasonal(spark, d)), "state", "left")


@_query("jn2_annotate", f"with {_STATES}, c as (select state, 'often' as summary_category from st group by state having count(*) >= 20) select run, tr, state, coalesce(summary_category, 'unknown') as summary_category from st left join c using (state)")
def jn2(spark, d):
    st = D.states(spark, d)
    often = st.groupBy("state").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").withColumn("summary_category", F.lit("often"))
    return X.annotate(st, often)


@_query("jn3_positional", f"with {_STATES}, {_SIGNAL}, h as (select * from sg where tr < 40) select st.run, st.tr, state, x from st join h on h.run = st.run and h.tr = st.tr")
def jn3(spark, d):
    return J.positional(D.states(spark, d), _signal(spark, d).where("tr < 40"))


_TWO = f"{_KINDS}, ea as (select run // 2 as run, tr, state from kd where run % 2 = 0), eb as (select run // 2 as run, tr, state from kd where run % 2 = 1)"


def _two(spark, d):
    rows = D.kinds(spark, d)
    return (rows.where(F.col("run") % 2 == k).withColumn("run", F.floor(F.col("run") / 2)) for k in (0, 1))


@_query("jn4_joint_counts", f"with {_TWO} select ea.state as a, eb.state as b, count(*) as n from ea join eb on ea.run = eb.run and ea.tr = eb.tr group by 1, 2")
def jn4(spark, d):
    return J.joint_counts(*_two(spark, d))


@_query(
    "st16_phi",
    f"""with {_TWO}, j as (select ea.state as x, eb.state as y from ea join eb on ea.run = eb.run and ea.tr = eb.tr), s as (select unnest(range(5))::integer as state),
    c as (select state, count(*)::double as n, sum((x = state)::integer * (y = state)::integer)::double as nab, sum((x = state)::integer)::double as na, sum((y = state)::integer)::double as nb from j, s group by state)
    select state, case when na * (n - na) * nb * (n - nb) > 0 then (n * nab - na * nb) / sqrt(na * (n - na) * nb * (n - nb)) end as phi from c""",
)
def st16(spark, d):
    a, b = _two(spark, d)
    both = J.positional(a.withColumnRenamed("state", "x"), b.withColumnRenamed("state", "y")).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return T.phi(both.withColumn("a", (F.col("x") == F.col("state")).cast("int")).withColumn("b", (F.col("y") == F.col("state")).cast("int")), "a", "b", ("state",))


_PARTS = f"with {_FO}, {_RUNS}, pa as (select distinct state from fo join rn using (run) where part = 'a' and fo > 0.05), pb as (select distinct state from fo join rn using (run) where part = 'b' and fo > 0.05)"


def _of_part(spark, d, part):
    return O.active_states(D.with_run_fields(_fo(spark, d)).where(F.col("part") == part), 0.05)


@_query("jn5_only_in_a", f"{_PARTS} select state from pa where state not in (from pb)")
def jn5(spark, d):
    return J.only_in(_of_part(spark, d, "a"), _of_part(spark, d, "b"))


@_query("set1_active_union", f"{_PARTS} select state from pa union select state from pb")
def set1b(spark, d):
    return _of_part(spark, d, "a").unionByName(_of_part(spark, d, "b")).distinct()


@_query("set1_active_intersection", f"{_PARTS} select state from pa intersect select state from pb")
def set1c(spark, d):
    return _of_part(spark, d, "a").intersect(_of_part(spark, d, "b"))


@_query(
    "jn6_both_stimuli",
    f"""with {_FO}, ea as (select state, count(*)::double / sum(count(*)) over () as p from st where run % 2 = 0 group by state), eb as (select state, count(*)::double / sum(count(*)) over () as p from st where run % 2 = 1 group by state),
    e as (select state from fo group by state having avg(case when fo > 0.02 then 1.0 else 0.0 end) >= 0.1) select ea.state, ea.p as fo_a, eb.p as fo_b from ea join eb using (state) where ea.p >= 0.01 and eb.p >= 0.01 and ea.state in (from e)""",
)
def jn6(spark, d):
    a, b = (O.pooled_occupancy(D.states(spark, d).where(F.col("run") % 2 == k)) for k in (0, 1))
    return J.in_both(a, b, O.recurrence(_fo(spark, d)).where("recurrence >= 0.1"))


@_query(
    "jn10_mismatches",
    f"""with {_STATES}, l as (select state, count(*) as n from st where run % 3 <> 0 group by state), r as (select state, count(*) as n from st where run % 3 <> 1 group by state)
    select state, l.n as left_value, r.n as right_value from l full join r using (state) where l.n is distinct from r.n""",
)
def jn10(spark, d):
    n = lambda k: D.states(spark, d).where(F.col("run") % 3 != k).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return J.mismatches(n(0), n(1), "state", "n")


@_query(
    "jn11_boundary_reset",
    f"""with {_FO}, {_RUNS}, aq as (select user_id as run, epoch(min(ts))::double / 86400 as acq_time from events group by user_id), g as (select run, subject, acq_time, acq_time - lag(acq_time) over (partition by subject order by acq_time, run) > 0.01 as new from rn join aq using (run)),
    ss as (select *, sum(coalesce(new::integer, 0)) over (partition by subject order by acq_time, run) as session from g),
    o as (select *, row_number() over (partition by subject, session order by acq_time, run) as k, row_number() over (partition by subject, session order by acq_time desc, run desc) as r from ss),
    pr as (select l.run as l_run, f.run as f_run from o l join o f on f.subject = l.subject and f.session = l.session + 1 where l.r = 1 and f.k = 1)
    select y.state, avg(y.fo - x.fo) as reset from pr join fo x on x.run = l_run join fo y on y.run = f_run and y.state = x.state group by y.state""",
)
def jn11(spark, d):
    return J.boundary_reset(_fo(spark, d), O.sessions(_acquired(spark, d), gap_days=0.01))


@_query("jn12_mutual_validity", f"with {_STATES} select run, count(*) as n_left, count(*) as n_right from st group by run")
def jn12(spark, d):
    return J.mutually_valid(D.states(spark, d), _signal(spark, d))


# aggregates


@_query("ag31_fo_when_active", f"with {_FO} select state, coalesce(avg(case when fo > 0.02 then fo end), 0.0) as mean_fo_active from fo group by state")
def ag31(spark, d):
    return O.mean_when_active(_fo(spark, d))


@_query(
    "ag24_decile_table",
    f"""with {_STATES}, ln as (select run, count(*) as n from st group by run), c as (select state, cast(least(9, tr * 10 // n) as integer) as decile, count(*) as n from st join ln using (run) group by 1, 2)
    select s.state, e.decile, coalesce(c.n, 0) as n from (select unnest(range(50))::integer as state) s cross join (select unnest(range(10))::integer as decile) e left join c on c.state = s.state and c.decile = e.decile""",
)
def ag24b(spark, d):
    return O.decile_table(D.states(spark, d), D.N_STATES)


@_query(
    "ag8_broadcast_episode",
    f"""with {_STATES}, q as (select distinct run, cast(run % 6 + 1 as integer) as season, cast(run // 24 + 1 as integer) as episode, case (run // 6) % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'd' end as part from st)
    select run, season, episode, part, case when part in ('c', 'd') and max((part = 'c')::integer) over (partition by season, episode) = 1 then episode + 1 else episode end as broadcast_episode from q""",
)
def ag8b(spark, d):
    run = F.col("run")
    rows = D.states(spark, d).select("run").distinct().select("run", (run % 6 + 1).cast("int").alias("season"), (F.floor(run / 24) + 1).cast("int").alias("episode"), F.substring(F.lit("abcd"), (F.floor(run / 6) % 4 + 1).cast("int"), F.lit(1)).alias("part"))
    return O.broadcast_episode(rows)


@_query(
    "ag29_jensen_shannon",
    f"""with {_STATES}, {_RUNS}, sh as (select season % 2 as side, state, count(*)::double / sum(count(*)) over (partition by season % 2) as share from st join rn using (run) group by season % 2, state),
    b as (select coalesce(l.share, 0) as a, coalesce(r.share, 0) as b from (select * from sh where side = 0) l full join (select * from sh where side = 1) r on l.state = r.state)
    select sum(case when a > 0 then a * log2(a / ((a + b) / 2)) else 0 end + case when b > 0 then b * log2(b / ((a + b) / 2)) else 0 end) / 2 as js from b""",
)
def ag29b(spark, d):
    rows = D.with_run_fields(D.states(spark, d))
    return W.jensen_shannon(*(O.pooled_occupancy(rows.where(F.col("season") % 2 == k)).withColumnRenamed("pooled_fo", "share") for k in (0, 1)))


@_query(
    "ag14_state_summary",
    f"""with {_FO}, {_BLOCKS.replace(_STATES, '').lstrip(',')}, {_TRANS.replace(_STATES, '').lstrip().lstrip(',')}, w as (select state, count(*) as n_blocks, avg(duration_tr) as mean_dwell from bl group by state),
    o as (select state, avg(fo) as mean_fo from fo group by state), e as (select i as state, -sum(p * log2(p)) as entropy, coalesce(max(case when i = j then p end), 0) as stay from tp group by i)
    select state, n_blocks, mean_dwell, mean_fo, entropy, stay from o join w using (state) left join e using (state)""",
)
def ag14b(spark, d):
    dwell = B.dwell(_blocks(spark, d)).select("state", "n_blocks", "mean_dwell")
    rows = R.row_entropy(_p(spark, d)).withColumnRenamed("i", "state")
    return O.recurrence(_fo(spark, d)).select("state", "mean_fo").join(dwell, "state").join(rows, "state", "left")


@_query(
    "ag15_positions_by_part",
    f"""with {_BLOCKS}, {_RUNS}, ln as (select run, count(*) as n_trs from st group by run) select part, state, avg(case when start_tr::double / n_trs < 0.2 then 1.0 else 0.0 end) as early_fraction, count(*) as n_blocks from bl join ln using (run) join rn using (run) group by part, state""",
)
def ag15b(spark, d):
    at = D.with_run_fields(_blocks(spark, d)).join(O.run_lengths(D.states(spark, d)), "run")
    return at.groupBy("part", "state").agg(F.avg((F.col("start_tr") / F.col("n_trs") < 0.2).cast("double")).alias("early_fraction"), F.count(F.lit(1)).alias("n_blocks"))


@_query(
    "ag23_likelihoods",
    f"""with {_SIGNAL}, {_RUNS}, r as (select part as type, sum(-x) as ll, count(*) as n from sg join rn using (run) group by sg.run, part)
    select type, count(*) as n_runs, sum(ll) / sum(n) as per_tr, avg(ll / n) as run_mean, stddev_samp(ll / n) as run_sd, stddev_samp(ll / n) / sqrt(count(*)) as run_se, ln(1.0::double / 50) as baseline from r group by rollup (type)""",
)
def ag23(spark, d):
    runs = D.with_run_fields(_signal(spark, d)).groupBy("run", F.col("part").alias("type")).agg(F.sum(-F.col("x")).alias("ll"), F.count(F.lit(1)).alias("n_trs"))
    return W.likelihood_summary(runs, D.N_STATES)


@_query(
    "ag27_fold_consistency",
    f"""with {_SEASON}, f as (select 'mean_fo_spread' as metric, season, max(mean_fo) - min(mean_fo) as value from sr group by season union all select 'mean_recurrence', season, avg(recurrence) from sr group by season)
    select metric, count(*) as n, avg(value) as mean, stddev_samp(value) as sd, min(value) as low, max(value) as high, case when metric <> 'mean_recurrence' and avg(value) <> 0 then stddev_samp(value) / abs(avg(value)) end as cv from f group by metric""",
)
def ag27(spark, d):
    by = _seasonal(spark, d).groupBy("season").agg((F.max("mean_fo") - F.min("mean_fo")).alias("a"), F.avg("recurrence").alias("b"))
    long = by.select(F.lit("mean_fo_spread").alias("metric"), F.col("a").alias("value")).union(by.select(F.lit("mean_recurrence"), "b"))
    return W.fold_consistency(long, "metric", ("mean_recurrence",))


# sequences


@_query(
    "seq9_module_dwell",
    f"""with {_STATES}, md as (select run, tr, case when state // 10 = 4 then -1 else cast((state // 10) // 2 as integer) end as state from st), mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from md),
    ix as (select *, sum(ch) over (partition by run order by tr) as k from mk), b as (select min(state) as state, count(*) as n from ix group by run, k) select state as module, avg(n) as mean_dwell, count(*) as n_blocks from b where state >= 0 group by state""",
)
def seq9(spark, d):
    module = F.when(F.floor(F.col("state") / 10) == 4, -1).otherwise(F.floor(F.col("state") / 20)).cast("int")
    return B.module_dwell(D.states(spark, d).withColumn("state", module))


@_query(
    "seq12_order_keys",
    f"""with {_RUNS}, k as (select *, 's' || season || 'e' || episode || part as run_id from rn)
    select run, run_id, row_number() over (order by season, episode, part, run) as chronological, row_number() over (order by run_id, run) as lexicographic from k""",
)
def seq12(spark, d):
    rows = _runs(spark, d).withColumn("run_id", F.concat(F.lit("s"), F.col("season").cast("string"), F.lit("e"), F.col("episode").cast("string"), F.col("part")))
    rank = lambda *by: F.row_number().over(Window.orderBy(*by))  # noqa: E731  one row a run
    return rows.select("run", "run_id", rank("season", "episode", "part", "run").alias("chronological"), rank("run_id", "run").alias("lexicographic"))


@_query(
    "seq13_switch_windows",
    f"""with {_KINDS}, {_SIGNAL}, mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from kd), ix as (select *, sum(ch) over (partition by run order by tr) as k from mk),
    b as (select run, k, min(state) as state, min(tr) as start_tr from ix group by run, k), h as (select *, lead(state) over (partition by run order by k) as nxt, lead(start_tr) over (partition by run order by k) as t from b),
    w as (select run, greatest(0, t - 2) as lo from h where (state = 1 and nxt = 4) or (state = 4 and nxt = 1))
    select cast(0 as integer) as dim, avg(x) as mean, (select count(*) from w) as n_switches from w join sg on sg.run = w.run and sg.tr >= lo and sg.tr < lo + 5""",
)
def seq13(spark, d):
    series = _signal(spark, d).select("run", "tr", F.lit(0).alias("dim"), "x")
    return J.switch_windows(B.state_blocks(D.kinds(spark, d)), series, 1, 4, 5)


@_query(
    "seq14_block_reference",
    f"""with {_FO}, {_RUNS}, pl as (select run, subject as season, row_number() over (partition by subject order by run) - 1 as place, count(*) over (partition by subject) as m from rn), e as (select fo.*, season, place, m from fo join pl using (run) where m >= 4),
    i as (select season, place as first, state, m, sum(fo) over (partition by season, state order by place rows between current row and 1 following) as s, sum(fo) over (partition by season, state) as t from e)
    select season as subject, first, sum(abs(s / 2 - (t - s) / (m - 2))) as l1 from i where first <= m - 2 group by season, first""",
)
def seq14(spark, d):
    place = F.row_number().over(Window.partitionBy("subject").orderBy("run")) - 1
    runs = _runs(spark, d).select("run", F.col("subject").alias("season"), place.alias("place"))
    return W.block_reference(_fo(spark, d), runs, 2).withColumnRenamed("season", "subject")


@_query("seq15_run_boundaries", f"with {_STATES}, {_RUNS}, n as (select run, count(*) as n from st group by run) select run, subject, cast(sum(n) over (partition by subject order by run) - n as bigint) as first, cast(sum(n) over (partition by subject order by run) as bigint) as past from n join rn using (run)")
def seq15(spark, d):
    return B.run_boundaries(D.with_run_fields(O.run_lengths(D.states(spark, d))), "subject").select("run", "subject", "first", "past")


_GRAM = "with {0}, g as (select run, {1} from cs window w as (partition by run order by pos)) select {2} as gram, count(*) as n, count(distinct run) as n_runs from g where {3} is not null group by 1"


@_query("seq7_bigrams", _GRAM.format(_CHANGES, "state as a, lead(state, 1) over w as b", "a || '>' || b", "b"))
def seq7b(spark, d):
    return R.ngrams(_changes(spark, d), 2)


@_query("seq7_fourgrams", _GRAM.format(_CHANGES, "state as a, lead(state, 1) over w as b, lead(state, 2) over w as c, lead(state, 3) over w as d", "a || '>' || b || '>' || c || '>' || d", "d"))
def seq7d(spark, d):
    return R.ngrams(_changes(spark, d), 4)


# selections and profiles

_PROFILE = _MEANS + ", pf as (select state, cast(dim // 8 as integer) as layer, avg(abs(mean)) as v from sm group by state, dim // 8)"


def _profile(spark, d):
    return D.state_means(spark, d).groupBy("state", F.floor(F.col("dim") / 8).cast("int").alias("layer")).agg(F.avg(F.abs("mean")).alias("v"))


@_query("top1_states", f"with {_FO} select state, avg(fo) as mean_fo from fo group by state order by mean_fo desc, state limit 10")
def top1(spark, d):
    return W.top_n(O.recurrence(_fo(spark, d)).select("state", "mean_fo"), "mean_fo", 10, "state")


@_query("top3_best_layer", f"with {_PROFILE}, r as (select *, row_number() over (partition by state order by v desc, layer) as r from pf where layer not in (0, 7)) select state, layer, v from r where r = 1")
def top3(spark, d):
    return W.best_cell(_profile(spark, d), "v", ("layer",), (0, 7), ("state",))


@_query("top5_pareto_front", f"with {_FO}, c as (select state, max(fo) as gain, cast(sum(case when fo > 0.02 then 1 else 0 end) as bigint) as cost from fo group by state) select * from c where not exists (select 1 from c b where (b.cost < c.cost and b.gain >= c.gain) or (b.cost = c.cost and b.gain > c.gain))")
def top5(spark, d):
    cells = _fo(spark, d).groupBy("state").agg(F.max("fo").alias("gain"), F.sum((F.col("fo") > 0.02).cast("long")).alias("cost"))
    return W.pareto_front(cells, "gain", "cost")


@_query(
    "st6_selectivity",
    f"""with {_PROFILE}, s as (select *, v - min(v) over (partition by state) as s, row_number() over (partition by state order by v desc, layer) as r from pf), t as (select *, sum(s) over (partition by state) as t from s)
    select state, max(case when r = 1 then layer end) as peak, max(v) as peak_value, max(v) - median(v) as max_minus_median, case when max(t) > 0 then -sum(case when s > 0 then s / t * ln(s / t) else 0 end) end as entropy from t group by state having count(*) >= 2""",
)
def st6(spark, d):
    return W.selectivity_profile(_profile(spark, d), "layer", "v", ("state",))


@_query("st6_centroid", f"with {_PROFILE} select state, sum(layer * greatest(v - 0.02, 0)) / nullif(sum(greatest(v - 0.02, 0)), 0) as centroid from pf group by state")
def st6b(spark, d):
    return W.centroid(_profile(spark, d), "layer", "v", ("state",), 0.02)


@_query("st6_effect_size", f"with {_FO}, c as (select run, max(fo) as best, count(*) as k from fo where fo > 0 group by run) select run, case when k >= 2 then (best - 1.0::double / k) / (1 - 1.0::double / k) end as effect from c")
def st6c(spark, d):
    best = _fo(spark, d).where("fo > 0").groupBy("run").agg(F.max("fo").alias("best"), F.count(F.lit(1)).alias("k"))
    return best.select("run", W.effect_size("best", "k").alias("effect"))


@_query(
    "st3_bootstrap_mean",
    f"""with {_FO}, ix as (select state, fo, row_number() over (partition by state order by run) - 1 as i, count(*) over (partition by state) as n from fo), dr as (select ix.state, n, cast(range + 1 as integer) as draw, cast(floor((('0x' || substr(md5('9|' || (range + 1) || '|' || ix.state || '|' || i), 1, 13))::bigint / 4503599627370496.0::double) * n) as bigint) as i from ix cross join range(200)),
    m as (select dr.state, draw, avg(fo) as m from dr join ix on ix.state = dr.state and ix.i = dr.i group by dr.state, draw) select state, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by state""",
)
def st3(spark, d):
    return T.bootstrap_mean_ci(_fo(spark, d), "fo", "run", ("state",), 200, 9)


@_query(
    "st25_recurrence_transfer",
    f"""with {_FO}, a as (select state, avg(case when fo > 0.02 then 1.0 else 0.0 end) as recurrence from fo where run % 2 = 0 group by state), b as (select state, avg(fo) as mean_fo from fo where run % 2 = 1 group by state), j as (select a.state, recurrence, mean_fo from a join b using (state) where recurrence > 0),
    r as (select rank() over (order by recurrence) + (count(*) over (partition by recurrence) - 1) / 2.0::double as x, rank() over (order by mean_fo) + (count(*) over (partition by mean_fo) - 1) / 2.0::double as y from j) select corr(x, y) as rho, count(*) as n from r""",
)
def st25(spark, d):
    fo = _fo(spark, d)
    seen = O.recurrence(fo.where("run % 2 = 0")).where("recurrence > 0").select("state", "recurrence")
    other = fo.where("run % 2 = 1").groupBy("state").agg(F.avg("fo").alias("mean_fo"))
    return T.spearman(seen.join(other, "state").withColumn("all", F.lit(0)), "recurrence", "mean_fo", ("all",)).drop("all")


# similarity and graph

_PAIRS = _MEANS + ", pr as (select x.state as a, y.state as b, corr(x.mean, y.mean) as r, corr(x.var, y.var) as v from sm x join sm y on x.dim = y.dim and x.state < y.state group by 1, 2)"


@_query("la2_combined", f"with {_PAIRS} select a, b, ((1 + r) / 2 + (1 + v) / 2) / 2 as similarity from pr")
def la2b(spark, d):
    means = D.state_means(spark, d)
    return S.combined_similarity(S.pearson_pairs(means), S.pearson_pairs(means, value="var"))


_OUTER = _MEANS + ", mx as (select x.state, x.dim as i, y.dim as j, x.mean * y.mean as c from sm x join sm y on x.state = y.state)"


@_query("la3_rv", f"with {_OUTER}, ow as (select state, sum(c * c) as s from mx group by state), dt as (select x.state as a, y.state as b, sum(x.c * y.c) as d from mx x join mx y on x.i = y.i and x.j = y.j and x.state < y.state group by 1, 2) select a, b, greatest(0.0::double, least(1.0::double, d / sqrt(l.s * r.s))) as rv from dt join ow l on l.state = a join ow r on r.state = b")
def la3(spark, d):
    means = D.state_means(spark, d)
    other = means.select("state", F.col("dim").alias("j"), F.col("mean").alias("other"))
    return W.rv_coefficient(means.join(other, "state").select("state", F.col("dim").alias("i"), "j", (F.col("mean") * F.col("other")).alias("c")))


@_query(
    "la7_blend",
    f"""with {_MEANS}, r as (select corr(s.mean, a.mean) as ra, corr(s.mean, b.mean) as rb, corr(a.mean, b.mean) as rab from sm s join sm a on a.dim = s.dim and a.state = 1 join sm b on b.dim = s.dim and b.state = 2 where s.state = 0),
    w as (select *, (ra - rb * rab) / (1 - rab * rab) as w_a, (rb - ra * rab) / (1 - rab * rab) as w_b from r) select w_a, w_b, w_a * ra + w_b * rb as r2_blend, w_a * ra + w_b * rb - greatest(ra * ra, rb * rb) as delta_r2 from w""",
)
def la7(spark, d):
    return W.blend_fit(D.state_means(spark, d), 0, 1, 2)


@_query("gr1_graph", f"with {_TRANS}, e as (select i, j, p from tp where i <> j and p >= 0.01) select i, j, p, p / sum(p) over (partition by i) as w from e")
def gr1(spark, d):
    return R.graph_edges(_p(spark, d))


@_query(
    "gr4_modularity",
    f"""with {_TRANS}, e as (select i // 10 as a, j // 10 as b, p from tp where i <> j and p >= 0.01), o as (select a as label, sum(p) as o, sum(case when a = b then p else 0 end) as w from e group by a), n as (select b as label, sum(p) as n from e group by b)
    select sum(coalesce(w, 0)) / sum(o) - sum(coalesce(o, 0) * coalesce(n, 0)) / (sum(o) * sum(o)) as q from o full join n using (label)""",
)
def gr4(spark, d):
    labels = spark.range(D.N_STATES).select(F.col("id").cast("int").alias("state"), F.floor(F.col("id") / 10).alias("label"))
    return R.directed_modularity(R.graph_edges(_p(spark, d)), labels)


@_query(
    "ag17_shrunk_correlations",
    f"""with {_MEANS}, ro as (select label as state, vec_id as obs, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings where label is not null), mn as (select state, dim, avg(x) as m from ro group by state, dim),
    ce as (select ro.state, obs, ro.dim, x - m as x from ro join mn on mn.state = ro.state and mn.dim = ro.dim), rl as (select state, obs, sum(x * x) as s from ce group by state, obs), sz as (select state, count(*) as n, sum(s * s) as fourth, sum(s) as trace from rl group by state),
    cv as (select a.state, a.dim as i, b.dim as j, sum(a.x * b.x) / any_value(n) as c from ce a join ce b on a.state = b.state and a.obs = b.obs and a.dim <= b.dim join sz on sz.state = a.state group by a.state, a.dim, b.dim),
    sq as (select state, sum(c * c * case when i = j then 1 else 2 end) as square from cv group by state), dl as (select state, n, trace / n / 64 as mu, (square - 64 * (trace / n / 64) * (trace / n / 64)) / 64 as delta, (fourth / n - square) / (64 * n) as beta from sz join sq using (state)),
    sh as (select *, case when n < 2 then 1.0 when delta <= 1e-18 then 0.0 else greatest(0.0, least(delta, beta)) / delta end as shrinkage from dl), dr as (select cv.state, i, j, n, shrinkage, (1 - shrinkage) * c + case when i = j then shrinkage * mu else 0 end as c from cv join sh on sh.state = cv.state)
    select d.state, cast(d.i as integer) as i, cast(d.j as integer) as j, case when d.i = d.j then 1.0::double when sqrt(a.c * b.c) > 1e-18 then d.c / sqrt(a.c * b.c) else 0 end as r, d.shrinkage, d.n, d.n >= 30 as reliable
    from dr d join dr a on a.state = d.state and a.i = d.i and a.j = d.i join dr b on b.state = d.state and b.i = d.j and b.j = d.j""",
)
def ag17(spark, d):
    rows = D.vectors_long(spark, d).where("label is not null")
    return S.shrunk_correlations(rows.select(F.col("label").alias("state"), F.col("vec_id").alias("obs"), "dim", "x"))


@_query("la6_first_passage")
def la6(spark, d):
    return R.first_passage(_p(spark, d))


_FITS = """
ft as (select cast(l_linenumber % 3 as integer) as gamma, cast((l_suppkey % 4 + 1) * 10 as integer) as nc, cast(l_orderkey % 5 as integer) as seed, -avg(l_extendedprice::double) / 1e4 as train_ll, -avg(l_quantity::double) / 5 as valid_ll,
  cast(count(distinct l_discount) as integer) as k_active, count(*) as n_train from lineitem group by 1, 2, 3),
bv as (select * from (select *, row_number() over (partition by gamma, nc order by valid_ll desc, seed) as k, count(*) over (partition by gamma, nc) as n_seeds from ft) where k = 1),
ws as (select gamma, nc, seed, min(ll) as worst from (select cast(l_linenumber % 3 as integer) as gamma, cast((l_suppkey % 4 + 1) * 10 as integer) as nc, cast(l_orderkey % 5 as integer) as seed, -avg(l_quantity::double) / 5 as ll from lineitem group by 1, 2, 3, l_partkey % 6) group by 1, 2, 3),
bt as (select * from (select *, row_number() over (partition by gamma, nc order by train_ll desc, seed) as k from ft) where k = 1),
mt as (select v.gamma, v.nc, n_seeds, v.k_active as k_valid, t.k_active as k_train, v.valid_ll as m1, case when t.n_train > 1 then t.train_ll - (2 * t.k_active * 8 + t.k_active * (t.k_active - 1) + t.k_active - 1) * ln(t.n_train) / (2 * t.n_train) end as m2,
  2 * v.valid_ll - v.train_ll as m3, v.valid_ll / v.k_active as m4, v.valid_ll - 0.5::double * (v.train_ll - v.valid_ll) as m5, worst as m6 from bv v join bt t on t.gamma = v.gamma and t.nc = v.nc left join ws on ws.gamma = v.gamma and ws.nc = v.nc and ws.seed = v.seed)"""


@_query(
    "ag26_config_metrics",
    f"""with {_FITS}, rk as (select *, {', '.join(f'rank() over (order by m{i} desc nulls last) as r{i}' for i in range(1, 7))} from mt) select *, (r1 + r2 + r3 + r4 + r5 + r6)::double / 6 as mean_rank from rk""",
)
def ag26(spark, d):
    return W.config_metrics(D.fits(spark, d), D.season_fits(spark, d), 8)


@_query(
    "ag26_marginal_gains",
    f"""with {_FITS}, s as (select gamma, nc as nc_from, lead(nc) over w as nc_to, lead(m1) over w - m1 as delta_ll, lead(k_valid) over w - k_valid as delta_k from mt window w as (partition by gamma order by nc))
    select *, case when delta_k > 0 then delta_ll / delta_k end as gain from s where nc_to is not null""",
)
def ag26b(spark, d):
    return W.marginal_gains(W.config_metrics(D.fits(spark, d), D.season_fits(spark, d), 8))


@_query("top4_two_stages", f"with {_FITS}, o as (select * from mt where nc = (select nc from mt order by m1 desc, nc, gamma limit 1)) select gamma, nc, m2 from o order by m2 desc, gamma limit 1")
def top4(spark, d):
    metrics = W.config_metrics(D.fits(spark, d), D.season_fits(spark, d), 8)
    size = W.best_cell(metrics.withColumn("all", F.lit(0)), "m1", ("nc", "gamma"), (), ("all",)).select("nc")
    return W.best_cell(J.also_in(metrics, size, "nc"), "m2", ("gamma",), (), ("nc",)).select("gamma", "nc", "m2")


@_query(
    "ag22_transfer_r2",
    f"""with {_SIGNAL}, {_RUNS}, x as (select part as type, tr % 3 as network, x - 50 as x, avg(x - 50) over (partition by run, tr % 5) as recon from sg join rn using (run)),
    s as (select type, network, count(*) as n, sum((x - recon) * (x - recon)) as sse, sum(x * x) as sst, sum(x) as s from x group by cube (type, network))
    select type, network, n, case when sst > 1e-12 then 1 - sse / sst end as r2, case when sst - s * s / n > 1e-12 then 1 - sse / (sst - s * s / n) end as r2_mean_corrected from s""",
)
def ag22(spark, d):
    x = D.with_run_fields(_signal(spark, d)).withColumn("x", F.col("x") - 50)
    recon = F.avg("x").over(Window.partitionBy("run", F.col("tr") % 5))
    return W.transfer_r2(x.select(F.col("part").alias("type"), (F.col("tr") % 3).alias("network"), "x", recon.alias("recon")))


_DELTA = _OUTER + ", wt as (select label as state, count(*)::double as w from embeddings where label is not null group by label), gm as (select i, j, sum(c * w) / sum(w) as g from mx join wt using (state) group by i, j), dl as (select state, mx.i, mx.j, c - g as delta from mx join gm on gm.i = mx.i and gm.j = mx.j)"


def _delta(spark, d):
    means = D.state_means(spark, d)
    other = means.select("state", F.col("dim").alias("j"), F.col("mean").alias("other"))
    long = means.join(other, "state").select("state", F.col("dim").alias("i"), "j", (F.col("mean") * F.col("other")).alias("c"))
    weights = D.table(spark, d, "embeddings").where("label is not null").groupBy(F.col("label").alias("state")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return W.delta_matrices(long, weights)


@_query("ag18_delta_matrices", f"with {_DELTA} select * from dl where state is not null")
def ag18(spark, d):
    return _delta(spark, d)


@_query("ag19_block_deltas", f"with {_DELTA} select state, cast(i // 4 as integer) as a, cast(j // 4 as integer) as b, avg(delta) as mean from dl group by 1, 2, 3")
def ag19(spark, d):
    return W.block_means(_delta(spark, d), "delta", 4)


@_query("ag19_top_pairs", f"with {_DELTA}, r as (select *, row_number() over (partition by state order by abs(delta) desc, i * 100 + j) as rank from dl where i < j) select state, i, j, delta, rank from r where rank <= 3")
def ag19b(spark, d):
    rows = _delta(spark, d).where("i < j").withColumn("size", F.abs("delta")).withColumn("place", F.col("i") * 100 + F.col("j"))
    return W.top_n(rows, "size", 3, "place", ("state",)).select("state", "i", "j", "delta", "rank")


@_query(
    "st20_markov_order",
    f"""with {_CHANGES}, g as (select state as a, lead(state, 1) over w as b, lead(state, 2) over w as c from cs window w as (partition by run order by pos)),
    tw as (select a, b, count(*) as n, sum(count(*)) over (partition by a) as t from g where b is not null group by a, b), th as (select a, b, c, count(*) as n, sum(count(*)) over (partition by a, b) as t from g where c is not null group by a, b, c),
    bo as (select th.*, ln(tw.n::double / tw.t) as lp1, th.t >= 10 as rich from th join tw on tw.a = th.b and tw.b = th.c), k1 as (select sum(k) as k1 from (select count(*) - 1 as k from tw group by a)), k2 as (select coalesce(sum(k), 0) as k2 from (select count(*) - 1 as k from bo where rich group by a, b)),
    tt as (select sum(n * lp1) as l1, sum(n * case when rich then ln(n::double / t) else lp1 end) as l2, sum(n) as n_obs from bo),
    o as (select 1 as "order", l1 as log_likelihood, cast(k1 as bigint) as n_params, cast(n_obs as bigint) as n_obs from tt, k1 union all select 2, l2, cast(k1 + k2 as bigint), cast(n_obs as bigint) from tt, k1, k2)
    select *, -2 * log_likelihood + n_params * ln(n_obs) as bic, -2 * log_likelihood + 2 * n_params as aic from o""",
)
def st20(spark, d):
    return R.markov_order(_changes(spark, d))


# ids


_IDS = "select distinct 'ses-' || lpad((user_id % 7)::varchar, 3, '0') || '_task-s' || (user_id % 6 + 1) || 'e' || (user_id // 12 + 1) || case when (user_id // 6) % 2 = 0 then 'a' else 'b' end as raw from events"


def _raw_ids(spark, d):
    run = F.col("user_id")
    part = F.when(F.floor(run / 6) % 2 == 0, "a").otherwise("b")
    raw = F.concat(F.lit("ses-"), F.lpad((run % 7).cast("string"), 3, "0"), F.lit("_task-s"), (run % 6 + 1).cast("string"), F.lit("e"), (F.floor(run / 12) + 1).cast("string"), part)
    return D.table(spark, d, "events").select(raw.alias("raw")).distinct()


@_query("rid1_parse", f"with r as ({_IDS}) select raw, regexp_extract(raw, 's(\\d+)e(\\d+)([a-z])$', 1)::integer as season, regexp_extract(raw, 's(\\d+)e(\\d+)([a-z])$', 2)::integer as episode, regexp_extract(raw, 's(\\d+)e(\\d+)([a-z])$', 3) as part from r")
def rid1(spark, d):
    rows = _raw_ids(spark, d)
    return rows.select("raw", *[c.alias(n) for n, c in ids.parsed_run(ids.canonical_run_id(F.col("raw"))).items()])


@_query("rid2_canonical", f"with r as ({_IDS}), e as (select raw, regexp_extract(raw, 's(\\d+)e(\\d+)([a-z])$', ['s', 'e', 'p']) as m from r) select raw, 's' || lpad(m.s, greatest(2, length(m.s))::integer, '0') || 'e' || lpad(m.e, greatest(2, length(m.e))::integer, '0') || m.p as run_id from e")
def rid2(spark, d):
    return _raw_ids(spark, d).select("raw", ids.canonical_run_id(F.col("raw")).alias("run_id"))


@_query("rid4_partition", f"with r as ({_IDS}) select raw, case when regexp_matches(raw, 's[1-3]e') then 'early' else 'late' end as subset from r")
def rid4(spark, d):
    return ids.pattern_partition(_raw_ids(spark, d), "raw", {"early": "task-s[1-3]e", "late": "task-s[4-6]e"})


@_query("rid8_finite", f"with {_FO}, x as (select run, state, case state % 3 when 0 then fo when 1 then 'nan'::double else 'infinity'::double end as v from fo) select run, state, case when not isnan(v) and not isinf(v) then v end as v from x")
def rid8(spark, d):
    odd = F.when(F.col("state") % 3 == 0, F.col("fo")).when(F.col("state") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return _fo(spark, d).select("run", "state", Z.finite(odd).alias("v"))


# models (no SQL: paths and assignments are tested against enumeration)


def _levels_model() -> M.GaussianModel:
    """Five sticky levels of the signal."""
    stay = np.full((5, 5), 0.1) + 0.5 * np.eye(5)
    return M.GaussianModel(np.full(5, 0.2), stay, np.arange(10.0, 100.0, 20.0)[:, None], np.full((5, 1), 200.0))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _signal(spark, d).select("run", "tr", F.array("x").alias("features"))


@_query("ml3_decoded_levels")
def ml3(spark, d):
    return M.decoded(_features(spark, d), _levels_model())


@_query("ml2_posteriors")
def ml2(spark, d):
    return M.scored(_features(spark, d), _levels_model())


@_query("jn8_assignment")
def jn8(spark, d):
    """States of the even against states of the odd vectors, one to one by the correlation of their means."""
    rows = D.vectors_long(spark, d).where("label is not null")
    half = lambda k, name: rows.where(F.col("vec_id") % 2 == k).groupBy(F.col("label").alias(name), "dim").agg(F.avg("x").alias(f"x{k}"))
    r = half(0, "a").join(half(1, "b"), "dim").groupBy("a", "b").agg(F.corr("x0", "x1").alias("r"))
    return G.matched(r.withColumn("pair", F.lit("halves")), "pair")


# splits


@_query("sp3_split_half_validation", f"with {_RUNS}, h as (select season, episode, cast((row_number() over (partition by season order by episode) - 1) % 2 as integer) as half from (select distinct season, episode from rn)), k as (select *, row_number() over (partition by half, season order by md5('42|' || half || '|' || season || '|' || episode), episode) as k, count(*) over (partition by half, season) as n from h) select half, season, episode, case when n > 1 and k <= least(1, round_even(n * 0.2, 0)::integer) then 'valid' else 'train' end as role from k")
def sp3b(spark, d):
    return P.split_half_validation(_runs(spark, d))


@_query("sp4_episode_folds", f"with {_RUNS}, e as (select season, episode, cast(dense_rank() over (order by season, episode) - 1 as integer) as fold from (select distinct season, episode from rn)) select run, rn.season, rn.episode, fold from rn join e on e.season = rn.season and e.episode = rn.episode")
def sp4b(spark, d):
    return P.episode_folds(_runs(spark, d)).select("run", "season", "episode", "fold")


@_query("sp4_group_folds", f"with {_RUNS}, e as (select season, episode, cast((row_number() over (partition by season order by md5('42|' || season || '|' || episode), episode) - 1) % 5 as integer) as fold from (select distinct season, episode from rn)) select run, rn.season, rn.episode, fold from rn join e on e.season = rn.season and e.episode = rn.episode")
def sp4c(spark, d):
    return P.stratified_group_folds(_runs(spark, d), 5).select("run", "season", "episode", "fold")


@_query(
    "sp5_eligible_shift",
    f"""with {_STATES}, el as (select *, cast(row_number() over (partition by run order by tr) - 1 as integer) as k, count(*) over (partition by run) as n from st where state % 2 = 0), x as (select el.*, cast(range + 1 as integer) as draw from el cross join range(3)),
    s as (select *, case when n > 1 then cast(1 + floor((('0x' || substr(md5('42|' || draw || '|' || run), 1, 13))::bigint / 4503599627370496.0::double) * (n - 1)) as integer) else 0 end as sh from x)
    select draw, run, cast((k + sh) % n as integer) as tr, state from s""",
)
def sp5b(spark, d):
    return P.eligible_shift(D.states(spark, d).where("state % 2 = 0"), 3, 42)


@_query("sp6_training_runs", f"with {_RUNS}, e as (select distinct season, episode from rn), k as (select *, row_number() over (partition by season order by md5('42|' || season || '|' || episode), episode) as k, count(*) over (partition by season) as n from e) select run, rn.season, rn.episode from rn join k on k.season = rn.season and k.episode = rn.episode where k.k > 2 * greatest(2, round_even(n * 0.15, 0)::integer)")
def sp6(spark, d):
    return P.of_role(_runs(spark, d), P.stratified_split(_runs(spark, d)), "train").select("run", "season", "episode")
