"""Registered queries of graph modules, their null graphs and the statistics with drawn or exact nulls; with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import compare as V
from strandline.operators import modules as G
from strandline.operators import nulls as N
from strandline.operators import occupancy as O
from strandline.operators import similarity as S
from strandline.operators import stats as T
from strandline.operators import surrogates as Q
from strandline.plans.extended import _PAIRS
from strandline.plans.models import ORACLE_SQL, QUERIES
from strandline.plans.registry import _BLOCKS, _CHANGES, _FO, _RUNS, _STATES, _TRANS, _blocks, _changes, _fo, _p, _query
from strandline.sources import fixtures as D

__all__ = ["QUERIES", "ORACLE_SQL"]


_SEASONS = f"""{_STATES}, {_RUNS}, nx as (select season, state as i, lead(state) over (partition by st.run order by tr) as j from st join rn on rn.run = st.run),
    ct as (select season as graph, i, j, count(*)::double as n from nx where j is not null group by 1, 2, 3), pt as (select *, n / sum(n) over (partition by graph, i) as p from ct),
    eg as (select graph, i, j, p as w from pt where i <> j and p >= 0.01)"""


def _season_graphs(spark: SparkSession, d: str) -> DataFrame:
    """(graph, i, j, w): transition probabilities of at least 0.01 between different states, a graph a season."""
    rows = D.with_run_fields(D.states(spark, d))
    moved = rows.select(F.col("season").cast("long").alias("graph"), F.col("state").alias("i"), F.lead("state").over(Window.partitionBy("run").orderBy("tr")).alias("j")).where("j is not null")
    counts = moved.groupBy("graph", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("graph", "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy("graph", "i"))).alias("w")).where("i <> j and w >= 0.01")


@_query("gr2_betweenness")
def gr2(spark, d):
    return G.node_betweenness(_season_graphs(spark, d))


@_query("gr3_season_reciprocity", f"with {_SEASONS} select graph::bigint as graph, avg(case when exists (select 1 from eg b where b.graph = eg.graph and b.i = eg.j and b.j = eg.i) then 1.0 else 0.0 end) as reciprocity from eg group by graph")
def gr3(spark, d):
    return G.reciprocity(_season_graphs(spark, d))


@_query("gr4_communities")
def gr4(spark, d):
    return G.best_communities(G.community_runs(_season_graphs(spark, d), 10))


@_query("gr4_modularity_test")
def gr4b(spark, d):
    return G.modularity_test(_season_graphs(spark, d), 10, 3, 42)


@_query("gr5_rewired_degrees", f"with {_SEASONS}, e as (select eg.*, cast(range + 1 as integer) as draw from eg, range(3)), o as (select graph, draw, i as node, count(*) as n_out from e group by 1, 2, 3), n as (select graph, draw, j as node, count(*) as n_in from e group by 1, 2, 3) select graph::bigint as graph, draw, node, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in from o full join n using (graph, draw, node)")
def gr5(spark, d):
    """Rewiring keeps every node's edges in and out."""
    made = G.null_graphs(_season_graphs(spark, d), 3, 42)
    out = made.groupBy("graph", "draw", F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = made.groupBy("graph", "draw", F.col("j").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, ["graph", "draw", "node"], "full").fillna(0, ["n_out", "n_in"])


@_query("gr5_rewired_weights", f"with {_SEASONS} select graph::bigint as graph, draw, sum(w) as weight, min(w) as least, max(w) as most, count(*) as n_edges from eg, (select cast(range + 1 as integer) as draw from range(3)) group by 1, 2")
def gr5b(spark, d):
    """Rewiring keeps the weights, whichever way they are dealt."""
    made = G.null_graphs(_season_graphs(spark, d), 3, 42, "permuted")
    return made.groupBy("graph", "draw").agg(F.sum("w").alias("weight"), F.min("w").alias("least"), F.max("w").alias("most"), F.count(F.lit(1)).alias("n_edges"))


@_query(
    "gr5_row_shuffle",
    f"""with {_TRANS}, s as (select distinct state from st), pr as (select a.state as i, b.state as j, coalesce(p, 0.0::double) as p from s a join s b on a.state <> b.state left join tp on tp.i = a.state and tp.j = b.state),
    x as (select pr.*, cast(range + 1 as integer) as draw from pr, range(2)), a as (select draw, i, j, row_number() over (partition by draw, i order by j) as k from x),
    b as (select draw, i, p, row_number() over (partition by draw, i order by md5('11|' || draw || '|' || i || '|' || j), j) as k from x) select draw, i, j, p from a join b using (draw, i, k)""",
)
def gr5c(spark, d):
    return G.row_shuffled(_p(spark, d), D.states(spark, d).select("state").distinct(), 2, 11)


@_query(
    "gr6_segment_shuffle",
    f"""with {_BLOCKS}, x as (select bl.run, block_index, state, duration_tr, cast(range + 1 as integer) as draw from bl, range(3)),
    l as (select draw, state as i, lead(state) over (partition by draw, run order by md5('9|' || draw || '|' || run || '|' || block_index), block_index) as j, duration_tr from x)
    select draw, i, j, cast(sum(n) as bigint) as n from (select draw, i, j, 1 as n from l where j is not null union all select draw, i, i, duration_tr - 1 from l) group by 1, 2, 3 having sum(n) > 0""",
)
def gr6(spark, d):
    return G.segment_shuffled(_blocks(spark, d), 3, 9)


_CHAIN = f"""{_TRANS}, r as (select i, sum(p) as row_, coalesce(max(case when i = j then p end), 0.0::double) as own from tp group by i), s as (select i, least(greatest(own / row_, 0.0::double), 1 - 1e-9) as stay from r),
    n as (select j, sum(p) as s from tp where i <> j and j in (select i from r) group by j), q as (select j, s / (select sum(s) from n) as q from n),
    nc as (select s.i, q.j, (1 - stay) * q.q / (1 - coalesce(o.q, 0)) as p from s join q on q.j <> s.i left join q o on o.j = s.i union all select i, i, stay from s)"""


@_query("gr6_nonmodular_chain", f"with {_CHAIN} select * from nc")
def gr6b(spark, d):
    return G.nonmodular_chain(_p(spark, d))


@_query(
    "gr6_modular_chain",
    f"""with {_CHAIN}, w as (select i, j, p * case when i // 10 = j // 10 then 3.0 else 1.0 end as w from nc where i <> j)
    select w.i, w.j, (1 - stay) * w / sum(w) over (partition by w.i) as p from w join s on s.i = w.i union all select i, i, stay from s""",
)
def gr6c(spark, d):
    labels = D.states(spark, d).select("state").distinct().withColumn("module", F.floor(F.col("state") / 10))
    return G.modular_chain(G.nonmodular_chain(_p(spark, d)), labels, 3.0)


_PREDICTED = f"""{_TRANS}, sd as (select distinct state from st), ro as (select i, ln(greatest(sum(p), 1e-12)) as o from tp where i <> j group by i), rn_ as (select j, ln(greatest(sum(p), 1e-12)) as n from tp where i <> j group by j),
    dy as (select a.state as i, b.state as j, coalesce(o, ln(1e-12)) as x1, coalesce(rn_.n, ln(1e-12)) as x2, abs(a.state % 10 - b.state % 10)::double as x3, ln(p) as y from sd a join sd b on a.state <> b.state left join ro on ro.i = a.state left join rn_ on rn_.j = b.state left join tp on tp.i = a.state and tp.j = b.state),
    mn as (select avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my from dy where y is not null), d0 as (select i, j, y, x1 - m1 as a, x2 - m2 as b, x3 - m3 as c, y - my as e, my from dy, mn),
    k1 as (select sum(a * b) / sum(a * a) as ab, sum(a * c) / sum(a * a) as ac, sum(a * e) / sum(a * a) as ae from d0 where y is not null), d1 as (select *, b - ab * a as b1, c - ac * a as c1 from d0, k1),
    k2 as (select sum(b1 * c1) / sum(b1 * b1) as bc, sum(b1 * e) / sum(b1 * b1) as be from d1 where y is not null), d2 as (select *, c1 - bc * b1 as c2 from d1, k2), k3 as (select sum(c2 * e) / sum(c2 * c2) as ce from d2 where y is not null),
    pw as (select i, j, my + ae * a + be * b1 + ce * c2 as predicted, y - (my + ae * a + be * b1 + ce * c2) as residual from d2, k3)"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Moves by the states' strengths and how far their decades lie apart."""
    states = D.states(spark, d).select("state").distinct()
    dyads = states.select(F.col("state").alias("i")).join(F.broadcast(states.select(F.col("state").alias("j"))), F.col("i") != F.col("j"))  # states by states
    return G.predicted_weights(_p(spark, d), dyads.withColumn("gap", F.abs(F.col("i") % 10 - F.col("j") % 10)), ["gap"])


@_query("gr7_predicted_weights", f"with {_PREDICTED} select * from pw")
def gr7(spark, d):
    return _predicted(spark, d)


@_query(
    "gr7_predicted_nulls",
    f"""with {_PREDICTED}, x as (select i, j, predicted, cast(range + 1 as integer) as draw from pw, range(3)), o as (select draw, i, j, predicted, row_number() over (partition by draw order by md5('21|' || draw || '|' || i || '|' || j), i, j) - 1 as k from x),
    h as (select residual, row_number() over (order by i, j) - 1 as k from pw where residual is not null) select draw, i, j, exp(predicted + residual) as w from o join h on h.k = o.k % (select count(*) from h) where exp(predicted + residual) >= 0.01""",
)
def gr7b(spark, d):
    return G.predicted_null_graphs(_predicted(spark, d), 3, 21)


@_query("gr8_consensus")
def gr8(spark, d):
    return G.consensus(_season_graphs(spark, d), 5)


@_query(
    "la8_merged_states",
    f"""with recursive {_PAIRS}, e as (select a, b from pr where r > 0.1 union all select b, a from pr where r > 0.1), t as (select state, state as r from (select a as state from pr union select b from pr) union select t.state, e.b from t join e on e.a = t.r)
    select state, min(r) as merged from t group by state""",
)
def la8(spark, d):
    return G.merged_states(S.pearson_pairs(D.state_means(spark, d).where("state is not null")), "r", 0.1)


# nulls


@_query(
    "st22_session_null",
    f"""with {_FO}, u as (select cast(run % 10 as integer) as unit, state, sum(fo) as s, count(*) as m from fo group by 1, 2), k as (select range as mask from range(1024) where bit_count(range) = 4),
    g as (select mask, state, sum(case when (mask >> unit) & 1 = 1 then s else 0 end) / sum(case when (mask >> unit) & 1 = 1 then m else 0 end) as a, sum(case when (mask >> unit) & 1 = 0 then s else 0 end) / sum(case when (mask >> unit) & 1 = 0 then m else 0 end) as b from u, k group by 1, 2),
    l as (select mask, sum(abs(a - b)) as l1 from g group by mask), o as (select l1 from l where mask = 15)
    select o.l1, 10 as n_units, 4 as n_units_a, count(*) as n_assignments, avg(case when l.l1 >= o.l1 - 1e-12 then 1.0 else 0.0 end) as p from l, o group by o.l1""",
)
def st22(spark, d):
    """Ten sessions by the runs' last digit, the first four under another label."""
    fo = _fo(spark, d)
    runs = fo.select("run").distinct().withColumn("unit", (F.col("run") % 10).cast("int")).withColumn("a", F.col("unit") < 4)
    return N.session_null(fo, runs)


@_query(
    "st21_chain_test",
    f"""with recursive {_CHANGES}, mv as (select run, state as i, lead(state) over (partition by run order by pos) as j from cs), ct as (select i, j, count(*)::double as n from mv where j is not null group by i, j),
    ss as (select distinct i as s from ct union select j from ct), pq as (select a.s as i, b.s as j, coalesce(n / (select sum(n) from ct where ct.i = a.s), 0) as p from ss a cross join ss b left join ct on ct.i = a.s and ct.j = b.s),
    cu as (select i, j, sum(case when t > 0 then p else (i <> j)::integer end) over (partition by i order by j) as upto, case when t > 0 then 1.0 else (select count(*) - 1 from ss) end as total from (select *, sum(p) over (partition by i) as t from pq)),
    un as (select run, arg_min(state, pos) as state, count(*) as len, cast(range + 1 as integer) as draw from cs, range(15) group by run, range),
    sim as (select draw, run, len, 0::bigint as pos, state from un union all
      select draw, run, len, pos + 1, (select min(j) from cu where cu.i = sim.state and upto > (('0x' || substr(md5('42|' || draw || '|' || run || '|' || (pos + 1)), 1, 13))::bigint / 4503599627370496.0::double) * total) from sim where pos + 1 < len),
    og as (select run, state || '>' || lead(state) over (partition by run order by pos) as gram from cs), ob as (select gram, count(*) as n, count(distinct run) as n_runs from og where gram is not null group by gram having count(distinct run) >= 5),
    sg as (select draw, run, state || '>' || lead(state) over (partition by draw, run order by pos) as gram from sim), nl as (select gram, draw, count(distinct run) as m from sg where gram in (select gram from ob) group by 1, 2),
    mt as (select gram, sum((m >= n_runs)::integer) as beyond, sum(m) as s, sum(m * m) as ss from nl join ob using (gram) group by gram), al as (select count(distinct run) as total from cs),
    pv as (select gram, n, n_runs, n_runs::double / total as cps, coalesce(s, 0) / 15.0::double / total as null_mean, sqrt(greatest(coalesce(ss, 0) / 15.0::double - (coalesce(s, 0) / 15.0::double) ** 2, 0.0)) / total as null_sd, (coalesce(beyond, 0) + 1) / 16.0::double as p from ob left join mt using (gram), al),
    rk as (select *, p * count(*) over () / row_number() over (order by p) as raw, row_number() over (order by p) as r from pv)
    select gram, n, n_runs, cps, null_mean, null_sd, p, least(1.0::double, min(raw) over (order by r desc rows unbounded preceding)) as q from rk""",
)
def st21(spark, d):
    return N.chain_test(_changes(spark, d), 2, 5, 15, 42)


@_query(
    "st14_excess_returns",
    f"""with {_CHANGES}, v as (select run, state, pos as visit, lag(state) over w as a, lead(state) over w as b from cs window w as (partition by run order by pos)), vv as (select * from v where a is not null and b is not null),
    z as (select state, run, count(*) as m from vv group by 1, 2 having count(*) >= 2 and min(b) <> max(b)), h as (select vv.*, m from vv join z on z.state = vv.state and z.run = vv.run),
    s as (select state, count(*) as n, sum((a = b)::integer) as same from h group by state), ca as (select state, run, m, a as x, count(*) as na from h group by 1, 2, 3, 4), cb as (select state, run, b as x, count(*) as nb from h group by 1, 2, 3),
    ch as (select state, sum(na * nb::double / m) as chance from ca join cb using (state, run, x) group by state), x as (select h.*, cast(range + 1 as integer) as draw from h, range(20)),
    l as (select draw, state, run, a, row_number() over (partition by draw, state, run order by visit) as k from x), r as (select draw, state, run, b, row_number() over (partition by draw, state, run order by md5('3|' || draw || '|' || state || '|' || run || '|' || visit), visit) as k from x),
    nl as (select draw, state, sum((a = b)::integer) as m from l join r using (draw, state, run, k) group by 1, 2), mt as (select state, sum((m >= same)::integer) as beyond, min(m) <> max(m) as spread from nl join s using (state) group by state)
    select state, n, same::double / n as share, coalesce(chance, 0) / n as expected, case when n >= 5 and spread then (beyond + 1) / 21.0::double end as p from s join mt using (state) left join ch using (state)""",
)
def st14(spark, d):
    return N.excess_returns(N.visit_neighbours(_changes(spark, d).withColumnRenamed("pos", "block_index")), 20, 3, 5)


def _sessions(fo: DataFrame) -> DataFrame:
    """Sessions of five runs by number; the last is shorter where runs are missing."""
    return fo.select("run").distinct().select("run", F.floor(F.col("run") / 5).alias("session"), F.col("run").alias("at"))


@_query(
    "st10_session_slopes",
    f"""with {_FO}, se as (select distinct run, run // 5 as session from fo), pl as (select run, session, count(*) over (partition by session) as m, row_number() over (partition by session order by run) - 1 - (count(*) over (partition by session) - 1) / 2 as x from se), ok as (select * from pl where m >= 3),
    h as (select fo.state, fo.run, fo, session, m, x from fo join ok on ok.run = fo.run), s as (select state, count(*) as n, sum(x * fo) as xy, sum(x * x) as xx from h group by state), d as (select run, session, m, cast(range + 1 as integer) as draw from ok, range(20)),
    pm as (select draw, run, row_number() over (partition by draw, session order by md5('44|' || draw || '|' || run), run) - 1 - (m - 1) / 2 as px from d), nl as (select draw, state, sum(px * fo) as pxy from pm join h on h.run = pm.run group by 1, 2)
    select state, any_value(n) as n, any_value(xy) / any_value(xx) as slope, (sum((abs(pxy) >= abs(xy) - 1e-12)::integer) + 1) / 21.0::double as p from nl join s using (state) group by state""",
)
def st10(spark, d):
    fo = _fo(spark, d)
    return N.session_slopes(fo, _sessions(fo), 20, 44)


@_query("st10_random_intercepts")
def st10b(spark, d):
    fo = _fo(spark, d)
    return N.random_intercepts(fo, _sessions(fo))


def _relabel(seed: int, draws: int) -> str:
    return f"""nd as (select a as node from pr union select b from pr), dr as (select node, cast(range + 1 as integer) as draw from nd, range({draws})),
    rl as (select a.draw, a.node, b.node as image from (select draw, node, row_number() over (partition by draw order by node) as k from dr) a join (select draw, node, row_number() over (partition by draw order by md5('{seed}|' || draw || '|' || node), node) as k from dr) b using (draw, k) union all select 0, node, node from nd),
    mp as (select x.draw, pr.a as i, pr.b as j, least(x.image, y.image) as p, greatest(x.image, y.image) as q from pr join rl x on x.node = pr.a join rl y on y.node = pr.b and y.draw = x.draw)"""


def _dyads(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, r, v, gap): how the states' means and variances correlate, and how far their numbers lie apart."""
    means = D.state_means(spark, d).where("state is not null")
    both = S.pearson_pairs(means).select("a", "b", "r").join(S.pearson_pairs(means, value="var").select("a", "b", F.col("r").alias("v")), ["a", "b"])
    return both.select(F.col("a").alias("i"), F.col("b").alias("j"), "r", "v", (F.col("b") - F.col("a")).cast("double").alias("gap"))


@_query(
    "st17_mantel",
    f"""with {_PAIRS}, {_relabel(13, 40)}, c as (select draw, corr(y.r, x.v) as r, count(*) as n from mp join pr y on y.a = mp.i and y.b = mp.j join pr x on x.a = mp.p and x.b = mp.q group by draw)
    select o.n, o.r, (sum((abs(c.r) >= abs(o.r) - 1e-12)::integer) + 1) / 41.0::double as p from c, c o where c.draw > 0 and o.draw = 0 group by o.n, o.r""",
)
def st17(spark, d):
    return N.mantel(_dyads(spark, d), "r", "v", 40, 13)


def _partial(own: str, other: str) -> str:
    """t and p of one predictor in SQL, by the two-predictor formula of R squared."""
    return f"""select '{own}' as predictor, any_value(b) as b, any_value(sign(b)) * sqrt(greatest(o.t2, 0)) as t, (sum((t.t2 >= o.t2 * (1 - 1e-12))::integer) + 1) / 41.0::double as p from
    (select draw, ((yo * yo + ye * ye - 2 * yo * ye * oe) / (1 - oe * oe) - yo * yo) / (1 - (yo * yo + ye * ye - 2 * yo * ye * oe) / (1 - oe * oe)) * (n - 3) as t2 from
      (select draw, count(*) as n, corr(y.r, y.{other}) as yo, corr(y.r, e.e) as ye, corr(y.{other}, e.e) as oe from mp join dy y on y.a = mp.i and y.b = mp.j join e_{own} e on e.a = mp.p and e.b = mp.q group by draw)) t,
    (select ((yo * yo + ye * ye - 2 * yo * ye * oe) / (1 - oe * oe) - yo * yo) / (1 - (yo * yo + ye * ye - 2 * yo * ye * oe) / (1 - oe * oe)) * (n - 3) as t2 from
      (select count(*) as n, corr(y.r, y.{other}) as yo, corr(y.r, y.{own}) as ye, corr(y.{other}, y.{own}) as oe from dy y)) o,
    (select regr_slope(r, e) as b from dy join e_{own} using (a, b)) where t.draw > 0 group by o.t2"""


@_query(
    "st18_dyadic_regression",
    f"""with {_PAIRS}, {_relabel(17, 40)}, dy as (select a, b, r, v, (b - a)::double as gap from pr), e_v as (select a, b, v - regr_intercept(v, gap) over () - regr_slope(v, gap) over () * gap as e from dy), e_gap as (select a, b, gap - regr_intercept(gap, v) over () - regr_slope(gap, v) over () * v as e from dy)
    {_partial('v', 'gap')} union all {_partial('gap', 'v')}""",
)
def st18(spark, d):
    return N.dyadic_regression(_dyads(spark, d), "r", ["v", "gap"], 40, 17)


@_query(
    "st20_context_test",
    f"""with {_CHANGES}, t as (select state as a, lead(state, 1) over w as b, lead(state, 2) over w as c from cs window w as (partition by run order by pos)), h3 as (select a, b, c, count(*) as n_c from t where c is not null group by 1, 2, 3),
    h2 as (select a as b, b as c, count(*) as m_c from t where b is not null group by 1, 2), k as (select a, b, cast(sum(n_c) as bigint) as n from h3 group by 1, 2 having sum(n_c) >= 10), m as (select b, sum(m_c) as m from h2 group by b),
    x as (select a, b, c, n, n_c, n_c::double / n as p_context, (m_c - n_c)::double / (m - n) as p_other from h3 join k using (a, b) join m using (b) join h2 using (b, c) where m > n and m_c > n_c),
    p as (select *, p_context / p_other as enrichment, case when p_other >= 1 then 1.0 else list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p_other) + (n - i) * ln(1 - p_other)) for i in range(n_c, n + 1)]) end as p from x),
    r as (select *, least(1.0::double, p) as pp, row_number() over (order by p) as k, count(*) over () as total from p)
    select a, b, c, n, n_c, p_context, p_other, enrichment, pp as p, least(1.0::double, min(pp * total / k) over (order by k desc rows unbounded preceding)) as q from r""",
)
def st20(spark, d):
    return N.context_test(_changes(spark, d))


@_query(
    "st11_motion_partial",
    f"""with {_FO}, m as (select user_id as run, avg(value)::double as motion from events group by 1), x as (select state, run, fo, motion from fo join m using (run)),
    r as (select state, rank() over (partition by state order by fo) + (count(*) over (partition by state, fo) - 1) / 2 as a, rank() over (partition by state order by run) as b, rank() over (partition by state order by motion) + (count(*) over (partition by state, motion) - 1) / 2 as c from x),
    k as (select state, count(*) as n, corr(a, b) as ab, corr(a, c) as ac, corr(b, c) as bc from r group by state), f as (select state, n, case when not isnan(ab) then ab end as ab, case when not isnan(ac) then ac end as ac, case when not isnan(bc) then bc end as bc from k)
    select state, n, ab as rho, case when (1 - ac * ac) * (1 - bc * bc) > 1e-12 then (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) end as partial from f""",
)
def st11(spark, d):
    """The mean value of a run's events stands for its motion."""
    motion = D.table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.avg(F.col("value").cast("double")).alias("motion"))
    return T.partial_spearman(_fo(spark, d).join(motion, "run"), "fo", "run", "motion", ("state",))


@_query(
    "seq11_chronological",
    f"""with {_FO}, {_RUNS}, b as (select state, fo, lag(fo) over (partition by state order by season, episode, part, fo.run) as before from fo join rn on rn.run = fo.run), o as (select state, count(*) as n, corr(fo, before) as r from b group by state),
    c as (select state, n, case when not isnan(r) then r end as r from o), m as (select avg(r) as mean_r from c) select state, n, r, mean_r, case when abs(mean_r) < 1 then n * (1 - mean_r) / (1 + mean_r) end as n_eff from c, m""",
)
def seq11(spark, d):
    return O.chronological_lag1(D.with_run_fields(_fo(spark, d)), ["season", "episode", "part", "run"])


@_query("st15_matching_test")
def st15(spark, d):
    """Three participants by the vectors' numbers, each pair's label means against mixed states."""
    rows = D.vectors_long(spark, d).where("label is not null").groupBy((F.col("vec_id") % 3).cast("int").alias("subject"), F.col("label").alias("state"), "dim").agg(F.avg("x").alias("x"))
    maps = rows.groupBy("subject", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("map"))
    pairs = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 1, 2)], "pair long, a int, b int")
    return Q.matching_test(maps, pairs, 99, 42)


@_query(
    "st20_fourgram_null",
    f"""with {_CHANGES}, s as (select run, state as a, lead(state, 1) over w as b, lead(state, 2) over w as c, lead(state, 3) over w as d from cs window w as (partition by run order by pos)),
    f4 as (select a, b, c, d, count(*) as n from s where d is not null group by all), f3 as (select a as b, b as c, c as d, count(*) as m_d from s where c is not null group by all),
    x as (select a, b, c, d, n, cast(sum(n) over (partition by a, b, c) as bigint) as n_context from f4),
    m as (select b, c, cast(sum(m_d) as bigint) as m from f3 group by all),
    h as (select x.*, m - n_context as n_other, greatest(coalesce(m_d, 0) - n, 0) / (m - n_context) as share from x join m using (b, c) left join f3 using (b, c, d) where n >= 3 and m - n_context >= 5)
    select a || '>' || b || '>' || c || '>' || d as gram, n, n_context, n_other, share, n_context * share as expected, (n - n_context * share) / (n_context * share) as excess, case when n_context * share >= 5 then (n - n_context * share) / sqrt(n_context * share) end as z
    from h where share >= 1e-15 and n_context * share >= 1e-10""",
)
def st20b(spark, d):
    return N.fourgram_null(_changes(spark, d))


@_query("st20_fourgram_test")
def st20c(spark, d):
    return N.fourgram_test(_changes(spark, d))


_WORSE = {"agreement": "lower", "distance": "higher"}
_TWO_SETS = """ft as (select (l_linenumber % 3) * 5 + l_orderkey % 5 as fit, l_partkey % 6 as season, -avg(l_quantity::double) / 5 as v from lineitem where l_linenumber % 3 < 2 and l_suppkey % 4 = 0 group by all),
    pr as (select a.fit as i, b.fit as j, corr(a.v, b.v) as agreement, sum(abs(a.v - b.v)) as distance from ft a join ft b on a.season = b.season and a.fit < b.fit group by all),
    lg as (select i, j, 'agreement' as metric, agreement as value, 1 as s from pr union all select i, j, 'distance', distance, -1 from pr)"""


def _two_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(i, j, agreement, distance) of the seasons' likelihoods of every two fits with the first two gammas at the smallest nc; (fit, a)."""
    rows = D.season_fits(spark, d).where("gamma < 2 and nc = 10").select((F.col("gamma") * 5 + F.col("seed")).alias("fit"), "season", F.col("valid_ll").alias("v"))
    a, b = rows.select(F.col("fit").alias("i"), "season", F.col("v").alias("v")), rows.select(F.col("fit").alias("j"), "season", F.col("v").alias("w"))
    pairs = a.join(b, "season").where("i < j").groupBy("i", "j").agg(F.corr("v", "w").alias("agreement"), F.sum(F.abs(F.col("v") - F.col("w"))).alias("distance"))
    return pairs, rows.select("fit", (F.col("fit") < 5).alias("a")).distinct()


@_query(
    "st23_fit_verdict",
    f"""with {_TWO_SETS}, best as (select fit // 5 as g, fit from (select fit, row_number() over (partition by fit // 5 order by avg(v) desc, fit) as k from ft group by fit) where k = 1),
    cr as (select metric, s, value as cross from lg where i in (select fit from best) and j in (select fit from best)),
    wi as (select metric, min(value) as within_min, median(value) as within_median, max(value) as within_max from lg where i // 5 = j // 5 group by metric),
    o as (select metric, "cross", within_min, within_median, within_max, case when s = 1 then "cross" < within_min else "cross" > within_max end as outside from cr join wi using (metric))
    select *, max(outside) over () as moved from o""",
)
def st23(spark, d):
    """The seed with the best mean likelihood of either gamma against each other."""
    pairs, _ = _two_sets(spark, d)
    means = D.season_fits(spark, d).where("gamma < 2 and nc = 10").groupBy("gamma", "seed").agg(F.avg("valid_ll").alias("m"))
    best = means.groupBy("gamma").agg(F.max_by("seed", F.struct("m", -F.col("seed"))).alias("seed")).select((F.col("gamma") * 5 + F.col("seed")).alias("fit"))
    cross = pairs.join(best.withColumnRenamed("fit", "i"), "i", "left_semi").join(best.withColumnRenamed("fit", "j"), "j", "left_semi")
    return V.moved(cross, pairs.where("floor(i / 5) = floor(j / 5)"), _WORSE)


@_query(
    "st23_split_test",
    f"""with {_TWO_SETS}, mk as (select range as mask from range(1024) where bit_count(range) = 5),
    md as (select mask, metric, any_value(s) as s, median(case when (mask >> i) & 1 = (mask >> j) & 1 then value end) as w, median(case when (mask >> i) & 1 <> (mask >> j) & 1 then value end) as c from lg, mk group by mask, metric),
    ob as (select metric, s * (w - c) as statistic, w, c from md where mask = 31)
    select metric, any_value(statistic) as statistic, any_value(ob.w) as within_median, any_value(ob.c) as cross_median, count(*) as n_splits, true as exact, avg((s * (md.w - md.c) >= statistic - 1e-12)::integer) as p from md join ob using (metric) group by metric""",
)
def st23b(spark, d):
    return V.split_test(*_two_sets(spark, d), _WORSE)
