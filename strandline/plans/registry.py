"""Registered queries of the state-sequence operators, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import blocks as B
from strandline.operators import nulls as N
from strandline.operators import occupancy as O
from strandline.operators import partition as V
from strandline.operators import similarity as S
from strandline.operators import splits as P
from strandline.operators import stats as T
from strandline.operators import taxonomy as X
from strandline.operators import transitions as R
from strandline.sources import fixtures as D
from strandline.sources.working import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_STATES = """
st as (select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as tr,
  cast((case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end) * 10
    + least(9, floor(value / 10)) as integer) as state from events)"""
_RUNS = """
rn as (select distinct user_id as run, cast(user_id % 6 + 1 as integer) as season,
  case when (user_id // 6) % 2 = 0 then 'a' else 'b' end as part, cast(user_id // 12 + 1 as integer) as episode, cast(user_id % 3 as integer) as subject from events)"""
_FO = (
    _STATES
    + """,
ln as (select run, count(*) as n_trs from st group by run),
fo as (select ln.run, s.state, coalesce(c.n, 0) as n, ln.n_trs, coalesce(c.n, 0)::double / ln.n_trs as fo
  from ln cross join (select cast(range as integer) as state from range(50)) s
  left join (select run, state, count(*) as n from st group by run, state) c on c.run = ln.run and c.state = s.state)"""
)
_BLOCKS = (
    _STATES
    + """,
mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from st),
ix as (select *, sum(ch) over (partition by run order by tr) as block_index from mk),
bl as (select run, cast(block_index as bigint) as block_index, min(state) as state, min(tr) as start_tr, max(tr) + 1 as end_tr,
  max(tr) + 1 - min(tr) as duration_tr from ix group by run, block_index)"""
)
_KINDS = _STATES + """,
kd as (select run, tr, cast(state // 10 as integer) as state from st)"""
_CHANGES = (
    _KINDS
    + """,
mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from kd),
ix as (select *, sum(ch) over (partition by run order by tr) as block_index from mk),
bl as (select run, cast(block_index as bigint) as block_index, min(state) as state, count(*) as duration_tr from ix group by run, block_index),
lg as (select *, lag(state) over (partition by run order by block_index) as before from bl where duration_tr >= 2),
cs as (select run, row_number() over (partition by run order by block_index) - 1 as pos, state from lg where before is null or before <> state)"""
)
_TRANS = (
    _STATES
    + """,
nx as (select run, state as i, lead(state) over (partition by run order by tr) as j from st),
tc as (select i, j, count(*) as n from nx where j is not null group by i, j),
tp as (select *, n::double / sum(n) over (partition by i) as p from tc)"""
)
_MEANS = """
vl as (select label as state, vec_id, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings),
sm as (select state, dim, avg(x) as mean, var_pop(x) as var from vl group by state, dim)"""
_SEASON = _FO + "," + _RUNS + """,
sr as (select season, state, avg(case when fo > 0.02 then 1.0 else 0.0 end) as recurrence, avg(fo) as mean_fo from fo join rn using (run) group by season, state)"""


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _fo(spark: SparkSession, d: str) -> DataFrame:
    return O.fractional_occupancy(D.states(spark, d), D.N_STATES)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return D.with_run_fields(D.table(spark, d, "events").select(F.col("user_id").alias("run")).distinct())


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.state_blocks(D.states(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return B.change_sequence(B.state_blocks(D.kinds(spark, d)), 2)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return R.probabilities(R.transition_counts(D.states(spark, d)))


def _acquired(spark: SparkSession, d: str) -> DataFrame:
    first = D.table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg((F.unix_micros(F.min("ts").cast("timestamp")) / 86400e6).alias("acq_time"))
    return D.with_run_fields(first)


def _seasonal(spark: SparkSession, d: str) -> DataFrame:
    return O.recurrence(D.with_run_fields(_fo(spark, d)), by=("season",))


@_query("ag1_occupancy", f"with {_FO} select * from fo")
def ag1(spark, d):
    return _fo(spark, d)


@_query("ag2_recurrence", f"with {_FO} select state, avg(case when fo > 0.02 then 1.0 else 0.0 end) as recurrence, avg(fo) as mean_fo from fo group by state")
def ag2(spark, d):
    return O.recurrence(_fo(spark, d))


@_query("ag3_active_states", f"with {_FO} select distinct state from fo where fo > 0.02")
def ag3(spark, d):
    return O.active_states(_fo(spark, d))


@_query("ag4_presence", f"with {_FO} select state, max(fo) as max_fo, avg(fo) as mean_fo, cast(sum(case when fo > 0.02 then 1 else 0 end) as bigint) as n_active_runs from fo group by state having max(fo) > 0.02")
def ag4(spark, d):
    return O.presence(_fo(spark, d))


@_query("ag5_pooled_occupancy", f"with {_STATES} select state, count(*) as n, count(*)::double / (select count(*) from st) as pooled_fo from st group by state")
def ag5(spark, d):
    return O.pooled_occupancy(D.states(spark, d))


@_query("ag6_season_recurrence", f"with {_SEASON} select * from sr")
def ag6(spark, d):
    return _seasonal(spark, d)


@_query("ag7_specificity", f"with {_SEASON} select state, case when count(*) < 2 then 0.0 else max(recurrence) - min(recurrence) end::double as specificity from sr group by state")
def ag7(spark, d):
    return O.specificity(_seasonal(spark, d))


@_query("ag8_episode_rollup", f"with {_FO}, {_RUNS} select season, episode, state, sum(n)::double / sum(n_trs) as fo, cast(sum(n_trs) as bigint) as n_trs from fo join rn using (run) group by season, episode, state")
def ag8(spark, d):
    return O.rolled_up(D.with_run_fields(_fo(spark, d)), ("season", "episode"))


@_query(
    "ag9_run_metrics",
    f"""with {_FO}, mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from st),
    bk as (select run, state, count(*) as k from (select run, state from (select *, row_number() over (partition by run order by tr) as r from mk) where ch = 1 or r = 1) group by run, state),
    ac as (select run, cast(sum(case when fo > 0.02 then 1 else 0 end) as bigint) as n_active from fo group by run)
    select run, count(*) as n_unique, cast(sum(k) as bigint) as n_blocks, cast(sum(case when k > 1 then 1 else 0 end) as bigint) as n_revisited, cast(sum(k - 1) as bigint) as n_reentries,
      any_value(n_active) as n_active, sum(k)::double / count(*) as blocks_per_state from bk join ac using (run) group by run""",
)
def ag9(spark, d):
    return O.run_metrics(D.states(spark, d), _fo(spark, d), _blocks(spark, d))


@_query(
    "ag10_dwell",
    f"""with {_BLOCKS} select state, count(*) as n_blocks, avg(duration_tr) as mean_dwell, median(duration_tr)::double as median_dwell, coalesce(stddev_samp(duration_tr), 0.0) as sd_dwell,
    avg(case when duration_tr < 3 then 1.0 else 0.0 end) as frac_short, median(duration_tr) < 3 as sub_hrf from bl group by state""",
)
def ag10(spark, d):
    return B.dwell(_blocks(spark, d))


@_query(
    "ag11_block_summary",
    f"with {_BLOCKS} select run, state, count(*) as n_blocks, min(start_tr) as first_tr, max(end_tr) as last_tr, cast(sum(duration_tr) as bigint) as total_tr, avg(duration_tr) as mean_tr from bl group by run, state",
)
def ag11(spark, d):
    return B.run_state_summary(_blocks(spark, d))


@_query(
    "ag12_seasonal_breakdown",
    f"""with {_SEASON}, bd as (select state, coalesce(string_agg(case when recurrence > 0 then season::varchar end, ',' order by season), '') as active_seasons,
    coalesce(string_agg(case when recurrence >= 0.7 then season::varchar end, ',' order by season), '') as recurrent_seasons,
    cast(sum(case when recurrence >= 0.7 then 1 else 0 end) as bigint) as n_recurrent, count(*) as n_seasons from sr group by state)
    select *, n_recurrent = n_seasons as across, n_recurrent > 0 and n_recurrent < n_seasons as seasonal from bd""",
)
def ag12(spark, d):
    return O.seasonal_breakdown(_seasonal(spark, d))


@_query("ag15_positions", f"""with {_BLOCKS}, ln as (select run, count(*) as n_trs from st group by run), ps as (select bl.run, state, start_tr::double / n_trs as p from bl join ln using (run))
    select state, avg(p) as mean_position, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) as iqr_position, avg(case when p < 0.2 then 1.0 else 0.0 end) as early_fraction, count(distinct run) as n_runs from ps group by state""")
def ag15(spark, d):
    return B.position_metrics(_blocks(spark, d), O.run_lengths(D.states(spark, d)))


@_query("ag16_state_means", f"with {_MEANS} select * from sm")
def ag16(spark, d):
    return D.state_means(spark, d)


_COMPOSITION = _MEANS + """,
sc as (select state, cast(dim // 8 as integer) as network, avg(abs(mean)) as score from sm group by state, dim // 8),
nc as (select *, score / sum(score) over (partition by state) as share from sc)"""


@_query("ag20_network_composition", f"with {_COMPOSITION} select * from nc")
def ag20(spark, d):
    return S.network_composition(D.state_means(spark, d))


@_query(
    "ag21_participation",
    f"""with {_COMPOSITION}, rk as (select *, row_number() over (partition by state order by share desc, network) as k from nc)
    select state, -sum(share * ln(share)) / ln(count(*)) as entropy, max(case when k = 1 then share end) as top1, sum(case when k <= 3 then share end) as top3,
    cast(sum(case when share >= 0.1 then 1 else 0 end) as bigint) as n_tenth, max(case when k = 1 then network end) as dominant from rk group by state""",
)
def ag21(spark, d):
    return S.participation(S.network_composition(D.state_means(spark, d)))


@_query(
    "ag24_state_crosstab",
    f"with {_STATES}, {_RUNS} select season, state, count(*) as n from st join rn using (run) group by season, state",
)
def ag24(spark, d):
    return D.with_run_fields(D.states(spark, d)).groupBy("season", "state").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "ag25_third_drift",
    f"""with {_STATES}, ln as (select run, count(*) as n, count(*) // 3 as third from st group by run),
    ct as (select st.run, third, state, sum(case when tr < third then 1 else 0 end) as e, sum(case when tr >= n - third then 1 else 0 end) as l from st join ln using (run) where tr < third or tr >= n - third group by st.run, third, state)
    select run, sum(abs(e - l)::double / third) as drift from ct group by run""",
)
def ag25(spark, d):
    return O.third_drift(D.states(spark, d), D.N_STATES)


_HALVES = _STATES + ", " + _RUNS + """,
sh as (select season % 2 as side, state, count(*)::double / sum(count(*)) over (partition by season % 2) as share from st join rn using (run) group by season % 2, state)"""


@_query(
    "ag29_total_variation",
    f"""with {_HALVES}, l as (select * from sh where side = 0), r as (select * from sh where side = 1)
    select sum(abs(coalesce(l.share, 0) - coalesce(r.share, 0))) / 2 as tv from l full join r on l.state = r.state""",
)
def ag29(spark, d):
    rows = D.with_run_fields(D.states(spark, d))
    return S.total_variation(*(O.pooled_occupancy(rows.where(F.col("season") % 2 == k)).withColumnRenamed("pooled_fo", "share") for k in (0, 1)))


@_query(
    "ag30_adjusted_rand",
    f"""with {_STATES}, lb as (select state // 10 as u, coalesce(lag(state // 10) over (partition by run order by tr), state // 10) as v from st),
    c as (select u, v, count(*)::double as k from lb group by u, v), s as (select sum(k * (k - 1) / 2) as s, sum(k) as n from c),
    a as (select sum(k * (k - 1) / 2) as su from (select sum(k) as k from c group by u)), b as (select sum(k * (k - 1) / 2) as sv from (select sum(k) as k from c group by v)),
    x as (select s, su, sv, su * sv / (n * (n - 1) / 2) as e from s, a, b)
    select (s - e) / ((su + sv) / 2 - e) as ari from x""",
)
def ag30(spark, d):
    from pyspark.sql import Window

    kind = F.floor(F.col("state") / 10)
    before = F.lag(kind).over(Window.partitionBy("run").orderBy("tr"))
    return S.adjusted_rand(D.states(spark, d).select(kind.alias("u"), F.coalesce(before, kind).alias("v")))


@_query("seq1_blocks", f"with {_BLOCKS} select *, start_tr * 1.49::double as start_s, end_tr * 1.49::double as end_s, duration_tr * 1.49::double as duration_s from bl")
def seq1(spark, d):
    return _blocks(spark, d)


@_query("seq2_visits", f"""with {_BLOCKS} select run, block_index, state, lag(state, 1, -1) over w as prev_state, lead(state, 1, -1) over w as next_state from bl window w as (partition by run order by block_index)""")
def seq2(spark, d):
    return B.visits(_blocks(spark, d)).select("run", "block_index", "state", "prev_state", "next_state")


@_query("seq3_change_sequence", f"with {_CHANGES} select * from cs")
def seq3(spark, d):
    return _changes(spark, d)


@_query(
    "seq4_collapse_flicker",
    f"""with recursive {_KINDS}, mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from kd),
    ix as (select *, sum(ch) over (partition by run order by tr) as k from mk), bl as (select run, k, min(state) as state, count(*) as d from ix group by run, k),
    bn as (select *, lead(state) over (partition by run order by k) as nxt from bl),
    fd(run, k, label) as (select run, k, state from bn where k = 0 union all
      select bn.run, bn.k, case when bn.d <= 4 and bn.nxt is not null and fd.label = bn.nxt then fd.label else bn.state end from fd join bn on bn.run = fd.run and bn.k = fd.k + 1)
    select ix.run, ix.tr, cast(fd.label as integer) as state from ix join fd on fd.run = ix.run and fd.k = ix.k""",
)
def seq4(spark, d):
    return B.collapse_flicker(D.kinds(spark, d))


@_query("seq5_transitions", f"with {_TRANS} select * from tp")
def seq5(spark, d):
    return _p(spark, d)


_CHANGE_P = _TRANS + """,
cp as (select tp.i, tp.j, case when 1 - coalesce(s.p, 0) > 1e-12 then tp.p / (1 - coalesce(s.p, 0)) else 0 end as p
  from tp left join (select i, p from tp where i = j) s on s.i = tp.i where tp.i <> tp.j)"""


@_query("seq6_change_probabilities", f"with {_CHANGE_P} select * from cp")
def seq6(spark, d):
    return R.change_probabilities(_p(spark, d))


@_query(
    "seq7_trigrams",
    f"""with {_CHANGES}, g as (select run, state as a, lead(state, 1) over w as b, lead(state, 2) over w as c from cs window w as (partition by run order by pos))
    select a || '>' || b || '>' || c as gram, count(*) as n, count(distinct run) as n_runs from g where c is not null group by 1""",
)
def seq7(spark, d):
    return R.ngrams(_changes(spark, d), 3)


@_query(
    "seq8_reliable_states",
    f"""with {_BLOCKS}, e as (select state, count(nxt) as n_exits from (select state, lead(state) over (partition by run order by block_index) as nxt from bl) group by state),
    t as (select state, count(*) as n_trs from st group by state) select state, n_trs, n_exits from t join e using (state) where n_trs >= 30 and n_exits >= 20""",
)
def seq8(spark, d):
    return R.reliable_states(D.states(spark, d), _blocks(spark, d))


@_query(
    "seq10_sessions",
    f"""with {_RUNS}, aq as (select user_id as run, epoch(min(ts))::double / 86400 as acq_time from events group by user_id), j as (select rn.*, acq_time from rn join aq using (run)),
    g as (select *, acq_time - lag(acq_time) over (partition by subject order by acq_time, run) > 0.01 as new from j)
    select run, subject, cast(sum(coalesce(new::integer, 0)) over (partition by subject order by acq_time, run) as bigint) as session from g""",
)
def seq10(spark, d):
    return O.sessions(_acquired(spark, d), gap_days=0.01).select("run", "subject", "session")


@_query(
    "seq11_lag1",
    f"""with {_FO}, g as (select state, fo, lag(fo) over (partition by state order by run) as before from fo), r as (select state, count(*) as n, corr(fo, before) as r from g group by state)
    select state, n, r, greatest(2.0, least(n::double, n * (1 - r) / (1 + r))) as n_eff from r""",
)
def seq11(spark, d):
    return O.lag1(_fo(spark, d))


@_query("prj9_clr", f"with {_FO} select run, state, ln(fo + 1e-4) - avg(ln(fo + 1e-4)) over (partition by run) as clr from fo")
def prj9(spark, d):
    return O.clr(_fo(spark, d))


@_query(
    "set2_occupancy_overlap",
    f"""with {_FO}, t as (select state, sum(fo) as t from fo where fo > 0 group by state),
    l as (select x.state as a, y.state as b, sum(least(x.fo, y.fo)) as low from fo x join fo y on x.run = y.run and x.state < y.state where x.fo > 0 and y.fo > 0 group by 1, 2)
    select a, b, low / (ta.t + tb.t - low) as overlap from l join t ta on ta.state = a join t tb on tb.state = b""",
)
def set2(spark, d):
    return S.occupancy_overlap(_fo(spark, d))


@_query(
    "set1_run_jaccard",
    f"""with {_FO}, h as (select run, state from fo where fo > 0.02), c as (select state, count(*) as k from h group by state),
    i as (select x.state as a, y.state as b, count(*) as i from h x join h y on x.run = y.run and x.state < y.state group by 1, 2)
    select a, b, i::double / (ca.k + cb.k - i) as jaccard from i join c ca on ca.state = a join c cb on cb.state = b""",
)
def set1(spark, d):
    return S.run_jaccard(_fo(spark, d), 0.02)


_PEARSON = _MEANS + """,
pr as (select x.state as a, y.state as b, corr(x.mean, y.mean) as r, sum(x.mean * y.mean) / sqrt(sum(x.mean * x.mean) * sum(y.mean * y.mean)) as cosine,
  sum((x.mean - y.mean) * (x.mean - y.mean) / ((x.var + y.var) / 2) / 8 + ln((x.var + y.var) / 2 / sqrt(x.var * y.var)) / 2) as bhattacharyya,
  sqrt(sum((x.mean - y.mean) * (x.mean - y.mean) / ((x.var + y.var) / 2))) as mahalanobis
  from sm x join sm y on x.dim = y.dim and x.state < y.state group by 1, 2)"""


@_query("la1_pearson", f"with {_PEARSON} select a, b, r from pr")
def la1(spark, d):
    return S.pearson_pairs(D.state_means(spark, d))


@_query("la2_cosine", f"with {_PEARSON} select a, b, cosine from pr")
def la2(spark, d):
    return S.cosine_pairs(D.state_means(spark, d))


@_query("la5_gaussian_distances", f"with {_PEARSON} select a, b, bhattacharyya, mahalanobis from pr")
def la5(spark, d):
    return S.gaussian_distances(D.state_means(spark, d))


@_query(
    "jn9_nearest",
    f"""with {_PEARSON}, e as (select a, b, r from pr union all select b, a, r from pr), k as (select *, row_number() over (partition by a order by r desc, b) as k from e)
    select a, b, r, count(*) over (partition by b) as chosen_by from k where k = 1""",
)
def jn9(spark, d):
    return S.nearest(S.pearson_pairs(D.state_means(spark, d)))


@_query(
    "top2_selectivity",
    f"""with {_TRANS}, e as (select * from tp where i <> j), a as (select distinct state from st)
    select state, coalesce((select j from e where i = state order by p desc, j desc limit 1), -1) as first, coalesce((select max(p) from e where i = state), 0) as p1,
      coalesce((select j from e where i = state order by p desc, j desc limit 1 offset 1), -1) as second, coalesce((select p from e where i = state order by p desc, j desc limit 1 offset 1), 0) as p2,
      coalesce((select sum(p) from (select p from e where i = state order by p desc limit 2)) / (select sum(p) from e where i = state), 0) as concentration from a""",
)
def top2(spark, d):
    return R.selectivity(_p(spark, d), D.states(spark, d))


@_query("ag14_transition_entropy", f"with {_TRANS} select i, -sum(p * log2(p)) as entropy, coalesce(max(case when i = j then p end), 0) as stay from tp group by i")
def ag14(spark, d):
    return R.row_entropy(_p(spark, d))


@_query(
    "st24_scaled_entropy",
    f"""with {_TRANS}, kp as (select state from st group by state having count(*) >= 30), ins as (select i, j, n::double / sum(n) over (partition by i) as p from tc where i in (from kp) and j in (from kp))
    select i, sum(-p * ln(p)) / (select ln(count(*)) from kp) as entropy from ins group by i""",
)
def st24(spark, d):
    st = D.states(spark, d)
    keep = st.groupBy("state").agg(F.count(F.lit(1)).alias("n")).where("n >= 30").select("state")
    return R.scaled_entropy(R.transition_counts(st), keep)


@_query(
    "gr3_asymmetry",
    f"""with {_TRANS}, b as (select coalesce(x.i, y.j) as i, coalesce(x.j, y.i) as j, coalesce(x.p, 0) as p, coalesce(y.p, 0) as back from tp x full join tp y on x.i = y.j and x.j = y.i)
    select i, j, (p - back) / (p + back) as asymmetry from b where i < j and (p >= 1.0::double / 49 or back >= 1.0::double / 49)""",
)
def gr3(spark, d):
    return R.asymmetry(_p(spark, d), D.N_STATES)


@_query(
    "gr2_strengths",
    f"""with {_TRANS}, e as (select * from tp where i <> j and p >= 0.01), o as (select i as state, count(*) as out_degree, sum(p) as out_strength from e group by i), n as (select j as state, count(*) as in_degree, sum(p) as in_strength from e group by j)
    select coalesce(o.state, n.state) as state, coalesce(out_degree, 0) as out_degree, coalesce(out_strength, 0) as out_strength, coalesce(in_degree, 0) as in_degree, coalesce(in_strength, 0) as in_strength from o full join n on o.state = n.state""",
)
def gr2(spark, d):
    return R.strengths(_p(spark, d))


@_query(
    "gr3_reciprocity",
    f"with {_TRANS}, e as (select i, j from tp where i <> j and p >= 0.01) select count(*) as n_edges, avg(case when b.i is null then 0.0 else 1.0 end) as reciprocity from e left join e b on b.i = e.j and b.j = e.i",
)
def gr3r(spark, d):
    return R.reciprocity(_p(spark, d))


@_query(
    "st19_conditional_entropy",
    f"""with {_CHANGES}, r as (select state as c, lag(state, 1) over w as b, lag(state, 2) over w as a from cs window w as (partition by run order by pos)),
    o1 as (select b, n, sum(n) over (partition by b) as t from (select b, c, count(*) as n from r where b is not null group by b, c)),
    o2 as (select a, b, n, sum(n) over (partition by a, b) as t from (select a, b, c, count(*) as n from r where a is not null group by a, b, c)),
    h1 as (select t, -sum(n::double / t * log2(n::double / t)) + (count(*) - 1) / (2 * t * ln(2)) as h from o1 where t > 1 group by b, t),
    h2 as (select t, -sum(n::double / t * log2(n::double / t)) + (count(*) - 1) / (2 * t * ln(2)) as h from o2 where t > 1 group by a, b, t)
    select 1 as order, sum(t * h) / sum(t) as entropy from h1 union all select 2, sum(t * h) / sum(t) from h2""".replace("as order,", 'as "order",'),
)
def st19(spark, d):
    return R.conditional_entropy(_changes(spark, d))


@_query(
    "st21_chain_preservation",
    f"""with {_CHANGES}, g as (select run, state as a, lead(state, 1) over w as b from cs window w as (partition by run order by pos)),
    k as (select a || '>' || b as gram, count(*) as n, count(distinct run) as n_runs from g where b is not null group by 1), al as (select count(distinct run) as all_runs from st)
    select gram, n, n_runs, all_runs, n_runs::double / all_runs as cps from k, al where n_runs >= 5""",
)
def st21(spark, d):
    return R.preservation(_changes(spark, d), D.states(spark, d), n=2)


_KW = _FO + ", " + _RUNS + """,
rk as (select season, state, rank() over (partition by state order by fo) + (count(*) over (partition by state, fo) - 1) / 2.0::double as r from fo join rn using (run)),
ti as (select state, sum(t * t * t - t) as ties from (select state, count(*)::double as t from fo group by state, fo) group by state),
su as (select state, sum(s * s / m) as ss, sum(m) as n from (select state, season, sum(r) as s, count(*)::double as m from rk group by state, season) group by state)"""


@_query("st13_kruskal", f"with {_KW} select state, case when 1 - ties / (n * n * n - n) > 0 then (12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) else 0 end as h from su join ti using (state)")
def st13(spark, d):
    return T.kruskal_h(D.with_run_fields(_fo(spark, d)), "fo", "season", ("state",))


@_query(
    "st4_spearman",
    f"""with {_FO}, rk as (select state, rank() over (partition by state order by fo) + (count(*) over (partition by state, fo) - 1) / 2.0::double as a, rank() over (partition by state order by n_trs) + (count(*) over (partition by state, n_trs) - 1) / 2.0::double as b from fo)
    select state, corr(a, b) as rho, count(*) as n from rk group by state""",
)
def st4(spark, d):
    return T.spearman(_fo(spark, d), "fo", "n_trs", ("state",))


@_query(
    "st5_auc",
    f"""with {_FO}, {_RUNS}, rk as (select state, season <= 3 as y, rank() over (partition by state order by fo) + (count(*) over (partition by state, fo) - 1) / 2.0::double as r from fo join rn using (run)),
    s as (select state, cast(sum(y::integer) as bigint) as n_pos, cast(count(*) - sum(y::integer) as bigint) as n_neg, sum(case when y then r end) as s from rk group by state)
    select state, n_pos, n_neg, case when n_pos >= 2 and n_neg >= 2 then (s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) end as auc from s""",
)
def st5(spark, d):
    return T.auc_grid(D.with_run_fields(_fo(spark, d)).withColumn("early", F.col("season") <= 3), "fo", "early", ("state",))


@_query(
    "st26_ks",
    f"""with {_SEASON}, x as (select recurrence, sum(case when season <= 3 then 1.0::double else 0 end) as a, sum(case when season <= 3 then 0 else 1.0::double end) as b from sr group by recurrence),
    c as (select abs(sum(a) over (order by recurrence) / sum(a) over () - sum(b) over (order by recurrence) / sum(b) over ()) as gap from x) select max(gap) as ks from c""",
)
def st26(spark, d):
    return T.ks_statistic(_seasonal(spark, d).withColumn("early", F.col("season") <= 3), "recurrence", "early")


_DRAW = "('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double"


#: Draws of the permutation tests.
SEASON_DRAWS, TREND_DRAWS, EARLY_DRAWS = 5000, 1000, 2000

_SEASON_P = _SEASON + f""",
obs as (select state, max(recurrence) - min(recurrence) as specificity from sr group by state),
dr as (select run, cast(range + 1 as integer) as draw from rn cross join range({SEASON_DRAWS})),
sh as (select draw, run, row_number() over (partition by draw order by md5('42|' || draw || '|' || run), run) as k from dr),
lb as (select season, row_number() over (order by season, run) as k from rn),
nr as (select draw, lb.season, state, avg(case when fo > 0.02 then 1.0 else 0.0 end) as recurrence from fo join sh using (run) join lb using (k) group by draw, lb.season, state),
ns as (select draw, state, max(recurrence) - min(recurrence) as s from nr group by draw, state),
sp as (select state, specificity, (sum(case when s >= specificity - 1e-12 then 1 else 0 end) + 1)::double / (count(*) + 1) as p from ns join obs using (state) group by state, specificity),
lc as (select state from st group by state having count(*) < 10),
sl as (select state, case when state in (from lc) then 1.0::double else p end as p from sp)"""


def _bh(name: str, source: str) -> str:
    """SQL of the table `name` (state, p, q) from `source` (state, p)."""
    return f"""{name}r as (select state, p, count(p) over () as n, row_number() over (partition by p is null order by p) as r from {source}),
{name} as (select state, p, case when n = 0 then null when p is null then 1 else least(1, min(p * n / r) over (partition by p is null order by r desc)) end as q from {name}r)"""


def _season_p(spark: SparkSession, d: str) -> DataFrame:
    """p of the seasonal specificity, 1 for the states of low confidence."""
    p = T.season_permutation(_fo(spark, d), _runs(spark, d), O.specificity(_seasonal(spark, d)), SEASON_DRAWS, 42, O.THRESHOLD)
    few = O.low_confidence(D.states(spark, d)).select("state", F.lit(True).alias("few"))
    return p.join(few, "state", "left").select("state", "specificity", F.when(F.col("few"), 1.0).otherwise(F.col("p")).alias("p"))


@_query("ag13_low_confidence", f"with {_STATES} select state, count(*) as n_trs from st group by state having count(*) < 10")
def ag13(spark, d):
    return O.low_confidence(D.states(spark, d))


@_query("st7_season_permutation", f"with {_SEASON_P} select state, specificity, p from sp")
def st7(spark, d):
    return T.season_permutation(_fo(spark, d), _runs(spark, d), O.specificity(_seasonal(spark, d)), SEASON_DRAWS, 42, O.THRESHOLD)


@_query("st1_fdr", f"with {_SEASON_P}, {_bh('fd', 'sl')} select state, p, q from fd")
def st1(spark, d):
    return T.bh_fdr(_season_p(spark, d).select("state", "p"))


def _early(part: str) -> str:
    """SQL of the early-block permutation of one part's runs."""
    x = part
    return f"""b{x} as (select bl.* from bl join rn using (run) where part = '{part}'), n{x} as (select run, sum(duration_tr) as n from b{x} group by run),
o{x} as (select state, count(*) as n_blocks, avg(e) as early_fraction from (select state, case when (sum(duration_tr) over (partition by run order by block_index) - duration_tr)::double / n < 0.2 then 1.0::double else 0 end as e from b{x} join n{x} using (run)) group by state),
d{x} as (select b{x}.*, n, cast(range + 1 as integer) as draw from b{x} join n{x} using (run) cross join range({EARLY_DRAWS})),
z{x} as (select draw, state, case when (sum(duration_tr) over (partition by draw, run order by md5('5|' || draw || '|' || run || '|' || block_index), block_index rows unbounded preceding) - duration_tr)::double / n < 0.2 then 1.0::double else 0 end as e from d{x}),
y{x} as (select draw, state, avg(e) as e from z{x} group by draw, state),
e{x} as (select state, n_blocks, early_fraction, case when n_blocks >= 3 then (sum(case when e >= early_fraction - 1e-12 then 1 else 0 end) + 1)::double / ({EARLY_DRAWS} + 1) end as p from o{x} join y{x} using (state) group by state, n_blocks, early_fraction)"""


def _early_p(spark: SparkSession, d: str, part: str) -> DataFrame:
    blocks = D.with_run_fields(_blocks(spark, d)).where(F.col("part") == part).select("run", "block_index", "state", "duration_tr")
    return T.early_permutation(blocks, EARLY_DRAWS, 5, orders="hashed")


@_query("st9_early_permutation", f"with {_BLOCKS}, {_RUNS}, {_early('a')} select state, n_blocks, early_fraction, p from ea")
def st9(spark, d):
    return _early_p(spark, d, "a")


_TREND = f"""ps as (select run, row_number() over (order by season, episode, part, run) - 1 as position from rn),
td as (select run, cast(range + 1 as integer) as draw from rn cross join range({TREND_DRAWS})),
tv as (select draw, run, row_number() over (partition by draw order by md5('7|' || draw || '|' || run), run) - 1 as position from td union all select 0, run, position from ps),
tm as (select state, count(*)::double as n, sum(fo) as sx, sum(fo * fo) as sxx from fo group by state),
ts as (select state, draw, sum(fo * position) as sxy from fo join tv using (run) group by state, draw),
tr_ as (select state, draw, case when (n * sxx - sx * sx) * (n * ((n - 1) * n * (2 * n - 1) / 6) - (n * (n - 1) / 2) * (n * (n - 1) / 2)) > 1e-24
  then (n * sxy - sx * (n * (n - 1) / 2)) / sqrt((n * sxx - sx * sx) * (n * ((n - 1) * n * (2 * n - 1) / 6) - (n * (n - 1) / 2) * (n * (n - 1) / 2))) else 0 end as r from ts join tm using (state)),
tp_ as (select a.state, b.r, (sum(case when abs(a.r) >= abs(b.r) - 1e-12 then 1 else 0 end) + 1)::double / ({TREND_DRAWS} + 1) as p
  from tr_ a join tr_ b on a.state = b.state and a.draw > 0 and b.draw = 0 group by a.state, b.r)"""


def _trend_p(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    runs = _runs(spark, d).select("run", (F.row_number().over(Window.orderBy("season", "episode", "part", "run")) - 1).alias("position"))  # one row a run
    return T.trend_permutation(_fo(spark, d), runs, TREND_DRAWS, 7)


@_query("st8_global_trend", f"with {_FO}, {_RUNS}, {_TREND} select state, r, p from tp_")
def st8(spark, d):
    return _trend_p(spark, d)


_SPLIT_SIZE = "greatest(2, round_even(n * 0.15, 0)::integer)"


@_query(
    "sp1_stratified_split",
    f"""with {_RUNS}, e as (select distinct season, episode from rn), k as (select *, row_number() over (partition by season order by md5('42|' || season || '|' || episode), episode) as k, count(*) over (partition by season) as n from e)
    select season, episode, case when k <= {_SPLIT_SIZE} then 'test' when k <= 2 * {_SPLIT_SIZE} then 'valid' else 'train' end as role from k""",
)
def sp1(spark, d):
    return P.stratified_split(_runs(spark, d))


@_query(
    "sp2_leave_one_season_out",
    f"""with {_RUNS}, e as (select distinct season, episode from rn), h as (select cast(range + 1 as integer) as held_out, e.* from e cross join range(6)),
    k as (select *, row_number() over (partition by held_out, season order by md5('42|' || held_out || '|' || season || '|' || episode), episode) as k, count(*) over (partition by held_out, season) as n from h)
    select held_out, season, episode, case when season = held_out then 'test' when k <= greatest(1, round_even(n * 0.2, 0)::integer) then 'valid' else 'train' end as role from k""",
)
def sp2(spark, d):
    return P.leave_one_season_out(_runs(spark, d))


@_query("sp3_split_half", f"with {_RUNS} select season, episode, cast((row_number() over (partition by season order by episode) - 1) % 2 as integer) as half from (select distinct season, episode from rn)")
def sp3(spark, d):
    return P.split_half(_runs(spark, d))


@_query("sp4_leave_one_run_out", f"with {_RUNS} select run, season, part, episode, cast(row_number() over (order by run) - 1 as integer) as fold from rn")
def sp4(spark, d):
    return P.leave_one_out_folds(_runs(spark, d)).select("run", "season", "part", "episode", "fold")


@_query(
    "sp5_circular_shift",
    f"""with {_STATES}, n as (select *, count(*) over (partition by run) as n from st), x as (select n.*, cast(range + 1 as integer) as draw from n cross join range(3)),
    s as (select draw, run, state, tr, n, cast(1 + floor({_DRAW.format("'42|' || draw || '|' || run")} * (n - 1)) as integer) as shift from x)
    select draw, run, cast((tr + shift) % n as integer) as tr, state from s""",
)
def sp5(spark, d):
    return P.circular_shift(D.states(spark, d), 3, 42)


#: Draws of the variance partition and of the session slopes.
PARTITION_DRAWS, SLOPE_DRAWS = 200, 200

_SLOPE = """case when {gg} * {ww} - {gw} * {gw} > 1e-12 * {gg} * {ww} then ({yg} * {yg} * {ww} - 2 * {yg} * {yw} * {gw} + {yw} * {yw} * {gg}) / ({gg} * {ww} - {gw} * {gw}) when {gg} > 1e-12 then {yg} * {yg} / {gg} when {ww} > 1e-12 then {yw} * {yw} / {ww} else 0.0::double end"""
_IN, _ALL = ({k: pre + k for k in ("yg", "yw", "gg", "gw", "ww")} for pre in ("", "t"))
_PARTITION = f"""ea_ as (select season, episode, state, sum(n)::double / sum(n_trs) as fo from fo join rn using (run) group by season, episode, state),
aq as (select user_id % 6 + 1 as season, user_id // 12 + 1 as episode, min(epoch_us(ts)) / 86400000000.0::double as position from events group by 1, 2),
un as (select season * 100000 + episode as unit, season, position, case when max(episode) over w > min(episode) over w then (episode - min(episode) over w) / (max(episode) over w - min(episode) over w)::double else 0.5::double end as place from aq window w as (partition by season)),
ub_ as (select unit, season, position - avg(position) over () as g, place - avg(place) over () as w from un), yc_ as (select season * 100000 + episode as unit, state, fo - avg(fo) over (partition by state) as y from ea_),
ud as (select ub_.*, cast(range + 1 as integer) as draw from ub_ cross join range({PARTITION_DRAWS})),
f1 as (select unit, row_number() over (order by md5('46|0|' || unit), unit) as k from ub_), f2 as (select unit, row_number() over (order by md5('47|0|' || unit), unit) as k from ub_), f3 as (select unit, season, row_number() over (partition by season order by md5('48|0|' || unit), unit) as k from ub_),
g1 as (select draw, g, row_number() over (partition by draw order by md5('46|' || draw || '|' || unit), unit) as k from ud), g2 as (select draw, season, row_number() over (partition by draw order by md5('47|' || draw || '|' || unit), unit) as k from ud), g3 as (select draw, season, w, row_number() over (partition by draw, season order by md5('48|' || draw || '|' || unit), unit) as k from ud),
dg as (select 0 as kind, 0 as draw, unit, season, g, w from ub_ union all select 1, draw, unit, ub_.season, g1.g, ub_.w from g1 join f1 using (k) join ub_ using (unit) union all select 2, draw, unit, g2.season, ub_.g, ub_.w from g2 join f2 using (k) join ub_ using (unit)
  union all select 3, draw, f3.unit, f3.season, ub_.g, g3.w from g3 join f3 on f3.k = g3.k and f3.season = g3.season join ub_ on ub_.unit = f3.unit),
cl as (select kind, draw, state, season, count(*) as n, sum(y) as y, sum(g) as g, sum(w) as w, sum(y * y) as yy, sum(y * g) as yg, sum(y * w) as yw, sum(g * g) as gg, sum(g * w) as gw, sum(w * w) as ww from dg join yc_ using (unit) group by kind, draw, state, season),
su_ as (select kind, draw, state, sum(yy - y * y / n) as yy, sum(yg - y * g / n) as yg, sum(yw - y * w / n) as yw, sum(gg - g * g / n) as gg, sum(gw - g * w / n) as gw, sum(ww - w * w / n) as ww, sum(yy) - sum(y) * sum(y) / sum(n) as tyy, sum(yg) - sum(y) * sum(g) / sum(n) as tyg,
  sum(yw) - sum(y) * sum(w) / sum(n) as tyw, sum(gg) - sum(g) * sum(g) / sum(n) as tgg, sum(gw) - sum(g) * sum(w) / sum(n) as tgw, sum(ww) - sum(w) * sum(w) / sum(n) as tww from cl group by kind, draw, state),
fd_ as (select kind, draw, state, case when tyy > 1e-20 then greatest(0, 1 - (yy - {_SLOPE.format(**_IN)}) / tyy) end as r2, case when tyy > 1e-20 then greatest(0, 1 - (yy - case when ww > 1e-12 then yw * yw / ww else 0 end) / tyy) end as ng,
  case when tyy > 1e-20 then greatest(0, 1 - (yy - case when gg > 1e-12 then yg * yg / gg else 0 end) / tyy) end as nw, case when tyy > 1e-20 then greatest(0, {_SLOPE.format(**_ALL)} / tyy) end as ns from su_),
sn as (select state, r2, ng, ns, nw, case when r2 is not null then greatest(0, r2 - ng) end as d1, case when r2 is not null then greatest(0, r2 - ns) end as d2, case when r2 is not null then greatest(0, r2 - nw) end as d3 from fd_ where kind = 0),
vp as (select state, sn.r2, d1 as dr2_global, d2 as dr2_season, d3 as dr2_within, case when sn.r2 is not null then greatest(0, sn.r2 - d1 - d2 - d3) end as shared,
  case when sn.r2 is not null then (sum((kind = 1 and greatest(0, f.r2 - ng) >= d1 - 1e-12)::integer) + 1) / ({PARTITION_DRAWS} + 1.0::double) end as p_global, case when sn.r2 is not null then (sum((kind = 2 and greatest(0, f.r2 - ns) >= d2 - 1e-12)::integer) + 1) / ({PARTITION_DRAWS} + 1.0::double) end as p_season,
  case when sn.r2 is not null then (sum((kind = 3 and greatest(0, f.r2 - nw) >= d3 - 1e-12)::integer) + 1) / ({PARTITION_DRAWS} + 1.0::double) end as p_within
  from (select kind, state, r2 from fd_ where kind > 0) f join sn using (state) group by state, sn.r2, d1, d2, d3)"""


def _partition(spark: SparkSession, d: str) -> DataFrame:
    """Episodes by the time of their first event."""
    from pyspark.sql import Window

    by, season = D.with_run_fields(D.table(spark, d, "events").select(F.col("user_id").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))), Window.partitionBy("season")
    first = by.groupBy("season", "episode").agg((F.min("us") / 86400000000.0).alias("position"))
    unit = (F.col("season") * 100000 + F.col("episode")).alias("unit")
    lo, hi = F.min("episode").over(season), F.max("episode").over(season)
    units = first.select(unit, "season", "position", F.when(hi > lo, (F.col("episode") - lo) / (hi - lo)).otherwise(0.5).alias("place"))
    runs = _runs(spark, d).select("run", "season", "episode")
    fo = _fo(spark, d).join(runs, "run").groupBy("season", "episode", "state").agg((F.sum("n") / F.sum("n_trs")).alias("fo")).select(unit, "state", "fo")
    return V.variance_partition(fo, units, PARTITION_DRAWS, 45)


@_query("st8_variance_partition", f"with {_FO}, {_RUNS}, {_PARTITION} select * from vp")
def st8b(spark, d):
    return _partition(spark, d)


_SLOPES = f"""se as (select distinct run, run // 5 as session from fo), pl as (select run, session, count(*) over (partition by session) as m, row_number() over (partition by session order by run) - 1 - (count(*) over (partition by session) - 1) / 2 as x from se), ok as (select * from pl where m >= 3),
sh_ as (select fo.state, fo.run, fo, session, m, x from fo join ok on ok.run = fo.run), ss_ as (select state, count(*) as n, sum(x * fo) as xy, sum(x * x) as xx from sh_ group by state), sd_ as (select run, session, m, cast(range + 1 as integer) as draw from ok cross join range({SLOPE_DRAWS})),
pm_ as (select draw, run, row_number() over (partition by draw, session order by md5('44|' || draw || '|' || run), run) - 1 - (m - 1) / 2 as px from sd_), sl_ as (select draw, state, sum(px * fo) as pxy from pm_ join sh_ on sh_.run = pm_.run group by draw, state),
st_ as (select state, any_value(xy) / any_value(xx) as slope, (sum((abs(pxy) >= abs(xy) - 1e-12)::integer) + 1) / ({SLOPE_DRAWS} + 1.0::double) as p from sl_ join ss_ using (state) group by state)"""

_TAGS = (
    _FO + ", " + _RUNS
    + """,
mk as (select *, case when state <> lag(state) over (partition by run order by tr) then 1 else 0 end as ch from st),
ix as (select *, sum(ch) over (partition by run order by tr) as block_index from mk),
bl as (select run, block_index, min(state) as state, count(*) as duration_tr from ix group by run, block_index),
rec as (select state, avg(case when fo > 0.02 then 1.0 else 0.0 end) as recurrence from fo group by state),
dw as (select state, median(duration_tr) < 3 as sub_hrf from bl group by state),
"""
    + f"{_PARTITION}, {_SLOPES}, {_bh('fs', '(select state, p_season as p from vp)')}, {_bh('fg', '(select state, p_global as p from vp)')}, {_bh('ft', '(select state, p from st_)')}, {_early('a')}, {_early('b')}, {_bh('qa', 'ea')}, {_bh('qb', 'eb')},"
    + """
fl as (select state, recurrence, coalesce(sub_hrf, false) as sub_hrf, recurrence = 0 as unused, coalesce(qa.q < 0.1, false) and coalesce(qb.q < 0.1, false) as run_onset,
  coalesce(qa.q < 0.1, false) and not coalesce(qb.q < 0.1, false) as a_anchored, coalesce(qb.q < 0.1, false) and not coalesce(qa.q < 0.1, false) as b_anchored,
  coalesce(ft.q < 0.05 and slope < 0, false) as session_trend_down, coalesce(ft.q < 0.05 and slope > 0, false) as session_trend_up,
  coalesce(fs.q < 0.05, false) as season_structured, coalesce(fg.q < 0.05, false) as global_trend
  from rec left join ft using (state) left join st_ using (state) left join dw using (state) left join qa using (state) left join qb using (state) left join fs using (state) left join fg using (state))"""
)


@_query(
    "st12_taxonomy",
    f"""with {_TAGS} select *, case when unused then 'unused' when sub_hrf then 'low_confidence' when run_onset or a_anchored or b_anchored then 'run_onset_anchored'
    when season_structured and global_trend then 'season_temporal' when recurrence >= 0.1 then 'eligible_for_content_analysis' else 'rare' end as summary_category from fl""",
)
def st12(spark, d):
    return X.categories(_flags(spark, d))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Every statistic is written as soon as it is there, a row a state, so that one is made after the other."""
    early = [written(T.bh_fdr(_early_p(spark, d, part)), "taxonomy-early") for part in "ab"]
    parts = written(_partition(spark, d), "taxonomy-partition")
    season, trend = (T.bh_fdr(parts.select("state", F.col(c).alias("p"))) for c in ("p_season", "p_global"))
    fo = _fo(spark, d)
    runs = fo.select("run").distinct().select("run", F.floor(F.col("run") / 5).alias("session"), F.col("run").alias("at"))
    slopes = written(T.bh_fdr(N.session_slopes(fo, runs, SLOPE_DRAWS, 44)), "taxonomy-slopes")
    dwell, recurrence = written(B.dwell(_blocks(spark, d)), "taxonomy-dwell"), written(O.recurrence(fo), "taxonomy-recurrence")
    return X.flags(dwell, recurrence, season, trend, X.anchoring(*early), slopes)


@_query(
    "src_shipments_transitions",
    """with st as (select l_suppkey as run, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) as tr,
      (case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) * 2 + (l_linestatus = 'O')::integer as state from lineitem),
    nx as (select state as i, lead(state) over (partition by run order by tr) as j from st), tc as (select i, j, count(*) as n from nx where j is not null group by i, j)
    select i, j, n, n::double / sum(n) over (partition by i) as p from tc""",
)
def src_shipments(spark, d):
    return R.probabilities(R.transition_counts(D.shipments_as_states(D.table(spark, d, "lineitem"))))
