"""Registered queries of fitted models: moments, components, regressions, hidden Markov fits, decoders; with SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import decoding as M
from strandline.operators import fitting as H
from strandline.operators import linear as L
from strandline.operators import ridge as C
from strandline.plans.extended import ORACLE_SQL, QUERIES
from strandline.plans.registry import _FO, _RUNS, _STATES, _fo, _query
from strandline.sources import fixtures as D

__all__ = ["QUERIES", "ORACLE_SQL"]

_VECTORS = "vc as (select vec_id, vec_id // 50 as run, cast(vec_id % 50 as integer) as tr, label, cast(unnest(range(64)) as integer) as dim, unnest(embedding)::double as x from embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """(run, tr, label, features): the embeddings as recordings of 50 TRs."""
    return D.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("run"), (F.col("vec_id") % 50).cast("int").alias("tr"), "label", F.col("embedding").cast("array<double>").alias("features"))


# components


@_query("la4_covariance", f"with {_VECTORS} select a.dim as i, b.dim as j, covar_samp(a.x, b.x) as c from vc a join vc b on a.vec_id = b.vec_id and a.dim <= b.dim group by 1, 2")
def la4(spark, d):
    return L.covariances(_vectors(spark, d).withColumn("g", F.lit(0)), "g").select("i", "j", "c")


@_query(
    "la4_participation",
    f"""with {_VECTORS}, cv as (select a.dim as i, b.dim as j, covar_samp(a.x, b.x) as c from vc a join vc b on a.vec_id = b.vec_id group by 1, 2)
    select (select count(distinct vec_id) from vc) as n, sum(case when i = j then c else 0 end) as variance, sum(case when i = j then c else 0 end) ** 2 / sum(c * c) as participation_ratio from cv""",
)
def la4b(spark, d):
    fit = L.fit_components(_vectors(spark, d))
    return spark.createDataFrame([(fit.n, float(fit.variances.sum()), fit.participation_ratio)], "n long, variance double, participation_ratio double")


@_query("la4_component_lookup")
def la4c(spark, d):
    """Components needed for shares of the variance."""
    fit = L.fit_components(_vectors(spark, d))
    return spark.createDataFrame([(s, fit.n_components(s)) for s in (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)], "share double, n_components int")


@_query("prj5_projected_norms", f"with {_VECTORS}, m as (select dim, avg(x) as m from vc group by dim) select run, tr, sum((x - m) * (x - m)) as square from vc join m using (dim) group by run, tr")
def prj5(spark, d):
    rows = _vectors(spark, d)
    z = L.projected(rows, L.fit_components(rows), 64)
    return z.select("run", "tr", F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x).alias("square"))


@_query("prj5_reconstruction", f"with {_VECTORS} select run, tr, dim, x from vc")
def prj5b(spark, d):
    rows = _vectors(spark, d)
    fit = L.fit_components(rows)
    return L.unprojected(L.projected(rows, fit, 64), fit).select("run", "tr", F.posexplode("features").alias("dim", "x"))


def _projected_states(spark: SparkSession, d: str) -> tuple[DataFrame, L.Components]:
    """(state, mean, cov) of each label's rows in all components."""
    rows = _vectors(spark, d).where("label is not null")
    fit = L.fit_components(_vectors(spark, d))
    z = L.projected(rows, fit, 64).withColumn("state", F.col("label"))
    half = L.covariances(z, "state")
    both = half.union(half.where("i <> j").select("state", F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    cov = both.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "c"))), lambda r: r["c"]).alias("cov"))
    mean = z.select("state", F.posexplode("features").alias("i", "x")).groupBy("state", "i").agg(F.avg("x").alias("m")).groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("mean"))
    return mean.join(cov, "state"), fit


@_query("prj6_state_means", f"with {_VECTORS} select label as state, dim, avg(x) as mean from vc where label is not null group by 1, 2")
def prj6(spark, d):
    states, fit = _projected_states(spark, d)
    return L.back_projected(states, fit).select(F.col("state").cast("int").alias("state"), F.posexplode("mean").alias("dim", "mean"))


@_query("prj6_state_covariances", f"with {_VECTORS} select a.label as state, a.dim as i, b.dim as j, covar_samp(a.x, b.x) as c from vc a join vc b on a.vec_id = b.vec_id where a.label is not null group by 1, 2, 3")
def prj6b(spark, d):
    states, fit = _projected_states(spark, d)
    long = L.back_projected(states, fit).select(F.col("state").cast("int").alias("state"), F.posexplode("cov").alias("at", "c"))
    return long.select("state", F.floor(F.col("at") / 64).cast("int").alias("i"), (F.col("at") % 64).cast("int").alias("j"), "c")


@_query("ag28_residual_variance")
def ag28(spark, d):
    """Variance of every dimension inside and outside ten components."""
    found = L.residual_variance(L.fit_components(_vectors(spark, d)), 10)
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(found)], "dim int, signal double, residual double, share double")


@_query("ag28_residual_stability")
def ag28b(spark, d):
    """The residual share without each label."""
    return spark.createDataFrame(L.residual_stability(_vectors(spark, d), "label", 10), "dim int, share double, mean double, deviation double, variation double")


@_query("prj1_parcel_means", f"with {_VECTORS}, m as (select run, tr, dim // 9 * 2 as parcel, avg(x) as x from vc where dim % 9 > 0 group by 1, 2, 3), p as (select distinct run, tr, cast(range as integer) as parcel from vc, range(13)) select run, tr, parcel, coalesce(x, 0) as x from p left join m using (run, tr, parcel)")
def prj1(spark, d):
    """Eight or nine dimensions a parcel, every second number unused, each ninth dimension in none."""
    parcels = [i // 9 * 2 if i % 9 else None for i in range(64)]
    return L.parcel_means(_vectors(spark, d), parcels).select("run", "tr", F.posexplode("features").alias("parcel", "x"))


_MAPS = f"{_VECTORS}, mp as (select label as state, dim, avg(x) as value from vc where label is not null group by 1, 2)"


def _maps(spark: SparkSession, d: str) -> DataFrame:
    return D.state_means(spark, d).where("state is not null").select("state", "dim", F.col("mean").alias("value"))


@_query("prj18_collapsed", f"with {_MAPS} select state, dim, avg(value) over (partition by state, dim // 8) as value from mp")
def prj18(spark, d):
    networks = spark.range(64).select(F.col("id").cast("int").alias("dim"), F.floor(F.col("id") / 8).alias("network"))
    return L.collapsed(_maps(spark, d), networks)


@_query("prj18_centred", f"with {_MAPS} select state, dim, value - avg(value) over (partition by dim) as value from mp where dim < 40")
def prj18b(spark, d):
    return L.centred_maps(_maps(spark, d), spark.range(40).select(F.col("id").cast("int").alias("dim")))


# regressions; the SQL makes regressors orthogonal one after the other


@_query(
    "prj2_cleaned",
    f"""with {_VECTORS}, t0 as (select run, tr, dim, x - avg(x) over w as x, tr - avg(tr) over w as t from vc window w as (partition by run, dim)),
    t1 as (select run, tr, dim, x - t * coalesce(sum(x * t) over w / nullif(sum(t * t) over w, 0), 0) as x from t0 window w as (partition by run, dim)),
    c0 as (select run, tr, x as c from t1 where dim = 0), c1 as (select run, tr, x as c from t1 where dim = 1),
    o1 as (select run, tr, c1.c - c0.c * (sum(c1.c * c0.c) over w / sum(c0.c * c0.c) over w) as c from c1 join c0 using (run, tr) window w as (partition by run)),
    r0 as (select run, tr, dim, x - c * (sum(x * c) over w / sum(c * c) over w) as x from t1 join c0 using (run, tr) where dim > 1 window w as (partition by run, dim)),
    r1 as (select run, tr, dim, x - c * (sum(x * c) over w / sum(c * c) over w) as x from r0 join o1 using (run, tr) window w as (partition by run, dim))
    select run, tr, cast(dim - 2 as integer) as dim, x / sqrt(sum(x * x) over w / (count(*) over w - 1)) as x from r1 window w as (partition by run, dim)""",
)
def prj2(spark, d):
    """The first two dimensions stand for confounds of the other 62."""
    rows = _vectors(spark, d).select("run", "tr", F.slice("features", 3, 62).alias("features"), F.slice("features", 1, 2).alias("confounds"))
    return L.cleaned(rows).select("run", "tr", F.posexplode("features").alias("dim", "x"))


_DESIGN = f"""{_FO}, {_RUNS}, ds as (select state, run, fo, season - avg(season) over w as a, episode - avg(episode) over w as b, (part = 'b')::integer - avg((part = 'b')::integer) over w as c, fo - avg(fo) over w as y from fo join rn using (run) window w as (partition by state)),
    s1 as (select *, b - a * (sum(a * b) over w / sum(a * a) over w) as b1, c - a * (sum(a * c) over w / sum(a * a) over w) as c0 from ds window w as (partition by state)),
    s2 as (select *, c0 - b1 * (sum(b1 * c0) over w / sum(b1 * b1) over w) as c1 from s1 window w as (partition by state)),
    s3 as (select *, y - a * (sum(a * y) over w / sum(a * a) over w) - b1 * (sum(b1 * y) over w / sum(b1 * b1) over w) - c1 * (sum(c1 * y) over w / sum(c1 * c1) over w) as residual from s2 window w as (partition by state))"""


def _design(spark: SparkSession, d: str) -> DataFrame:
    runs = D.with_run_fields(D.table(spark, d, "events").select(F.col("user_id").alias("run")).distinct())
    return _fo(spark, d).join(runs, "run").withColumn("late", (F.col("part") == "b").cast("int"))


@_query("prj11_design_residual", f"with {_DESIGN} select state, run, residual from s3")
def prj11(spark, d):
    return L.least_squares_residual(_design(spark, d), "fo", ["season", "episode", "late"], ["state"]).select("state", "run", "residual")


@_query("prj11_design_fit", f"with {_DESIGN} select state, count(*) as n, case when sum(y * y) > 0 then 1 - sum(residual * residual) / sum(y * y) end as r2 from s3 group by state")
def prj11b(spark, d):
    return L.least_squares(_design(spark, d), "fo", ["season", "episode", "late"], ["state"]).select("state", "n", "r2")


# hidden Markov fits (no SQL: steps are tested against plain ones and planted chains)


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, H.Fit]:
    """Five components of the embeddings' recordings and a model of six states fitted to them."""
    rows = _vectors(spark, d)
    z = L.projected(rows, L.fit_components(rows), 5)
    return z, H.fit_hmm(z, 6, H.StickyPrior(1.0, 1.0, 10.0, 0.1), n_iter=10, seed=7)


@_query("ml1_fit_history")
def ml1(spark, d):
    return H.history(_fitted(spark, d)[1], spark)


@_query("ml1_run_likelihoods")
def ml1b(spark, d):
    rows, fit = _fitted(spark, d)
    return H.run_likelihoods(rows, fit.model)


@_query("ml2_fitted_posteriors")
def ml2(spark, d):
    rows, fit = _fitted(spark, d)
    return M.scored(rows, fit.model)


@_query("ml3_fitted_path")
def ml3(spark, d):
    rows, fit = _fitted(spark, d)
    return M.decoded(rows, fit.model)


# decoders


_RIDGE = f"""{_STATES}, rw as (select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as tr, value::double as x, cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as integer) as y from events),
    nn as (select run, count(*) as n from rw group by run),
    lb as (select run, tr, x, y as c, 0 as target, y as q from rw union all
      select a.run, a.tr, a.x, a.y, range + 1, b.y from (select * from rw, range(2)) a join nn using (run)
      join rw b on b.run = a.run and b.tr = (a.tr - (case when n > 1 then cast(1 + floor((('0x' || substr(md5('5|' || (range + 1) || '|' || a.run), 1, 13))::bigint / 4503599627370496.0::double) * (n - 1)) as bigint) else 0 end) + n) % n),
    pr as (select target, run, c, q, count(*)::double as n, sum(x) as sx, sum(x * x) as sxx from lb group by 1, 2, 3, 4),
    ks as (select distinct y as q from rw), ts as (select target, c, q, sum(n) as n, sum(sx) as sx, sum(sxx) as sxx from pr group by 1, 2, 3),
    tr as (select t.target, r.run, t.c, t.q, t.n - coalesce(p.n, 0) as n, t.sx - coalesce(p.sx, 0) as sx, t.sxx - coalesce(p.sxx, 0) as sxx from ts t cross join nn r left join pr p on p.target = t.target and p.run = r.run and p.c = t.c and p.q = t.q),
    wc as (select target, run, c, sum(n) as nc from tr group by 1, 2, 3), wt as (select *, sum(nc) over (partition by target, run) / (count(*) over (partition by target, run) * nc) as w from wc),
    al as (select target, run, sum(w * n) as s0, sum(w * sx) as s1, sum(w * sxx) as s2 from tr join wt using (target, run, c) group by 1, 2),
    tg as (select target, run, q, 2 * sum(w * n) - any_value(s0) as t0, 2 * sum(w * sx) - any_value(s1) as t1 from tr join wt using (target, run, c) join al using (target, run) group by 1, 2, 3),
    cf as (select target, run, q, t0 / s0 as b0, s1 / s0 as m, (t1 - t0 * s1 / s0) / (s2 - s1 * s1 / s0 + 1.0) as b1 from tg join al using (target, run)),
    sc as (select l.target, l.run, l.tr, l.q as label, f.q as state, (l.x - m) * b1 + b0 as score from lb l join cf f on f.target = l.target and f.run = l.run),
    pd as (select target, run, tr, any_value(label) as label, arg_max(state, score) as predicted from sc group by 1, 2, 3)"""


def _kind_rows(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every event and its value as the only feature, with two shifted label vectors."""
    values = D.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts"), F.col("event_id"), F.col("value").cast("double").alias("x"))
    place = F.row_number().over(C.Window.partitionBy("run").orderBy("ts", "event_id")) - 1
    rows = values.withColumn("tr", place.cast("int")).select("run", "tr", F.array("x").alias("features"))
    return C.shifted_labels(rows.join(D.kinds(spark, d).select("run", "tr", F.col("state").alias("label")), ["run", "tr"]), 2, 5)


@_query(
    "ml6_kind_decoding",
    f"""with {_RIDGE}, pc as (select target, label, predicted, count(*) as n from pd group by 1, 2, 3), cl as (select distinct target, q as c from pd, ks),
    cc as (select target, c, (select coalesce(sum(n), 0) from pc where pc.target = cl.target and label = c) as t, (select coalesce(sum(n), 0) from pc where pc.target = cl.target and predicted = c) as s, (select coalesce(sum(n), 0) from pc where pc.target = cl.target and label = c and predicted = c) as h from cl)
    select cast(target as integer) as target, cast(sum(t) as bigint) as n, avg(case when t > 0 then h / t end) as balanced_accuracy, sum(case when t + s > 0 then t * 2 * h / (t + s) else 0 end) / sum(t) as weighted_f1,
    (sum(h) / sum(t) - sum(t::double * s) / (sum(t) * sum(t))) / (1 - sum(t::double * s) / (sum(t) * sum(t))) as kappa from cc group by target""",
)
def ml6(spark, d):
    return C.decoding_metrics(C.leave_one_run_out(_kind_rows(spark, d), ["label", "null_1", "null_2"]))


@_query(
    "ml7_kind_areas",
    f"""with {_RIDGE}, rk as (select target, state, (label = state)::integer as y, rank() over (partition by target, state order by score) + (count(*) over (partition by target, state, score) - 1) / 2 as r from sc)
    select cast(target as integer) as target, cast(state as integer) as state, cast(sum(y) as bigint) as n_pos, cast(sum(1 - y) as bigint) as n_neg, (sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y)::double * sum(1 - y)) as auc from rk group by 1, 2""",
)
def ml7(spark, d):
    return C.state_areas(C.leave_one_run_out(_kind_rows(spark, d), ["label", "null_1", "null_2"]), [0, 1, 2, 3, 4])


@_query("ml6_vector_decoding")
def ml6b(spark, d):
    """Labels of the embeddings from all 64 dimensions, against 20 shifted label vectors."""
    rows = C.shifted_labels(_vectors(spark, d).where("label is not null"), 20, 42)
    return C.decoding_metrics(C.leave_one_run_out(rows, ["label", *[f"null_{i}" for i in range(1, 21)]]))


_TRANSFER = f"""{_STATES}, rw as (select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as tr, value::double as x, cast(case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as integer) as y from events),
    ta as (select * from rw where (run // 6) % 2 = 0), nn as (select run, count(*) as n from ta group by run),
    lb as (select x, 0 as target, y as q from ta union all
      select a.x, range + 1, b.y from (select * from ta, range(20)) a join nn using (run)
      join ta b on b.run = a.run and b.tr = (a.tr - (case when n > 1 then cast(1 + floor((('0x' || substr(md5('6|' || (range + 1) || '|' || a.run), 1, 13))::bigint / 4503599627370496.0::double) * (n - 1)) as bigint) else 0 end) + n) % n),
    wc as (select target, q, count(*)::double as n, sum(x) as sx, sum(x * x) as sxx from lb group by 1, 2), ww as (select *, sum(n) over (partition by target) / (count(*) over (partition by target) * n) as w from wc),
    al as (select target, sum(w * n) as s0, sum(w * sx) as s1, sum(w * sxx) as s2 from ww group by 1),
    cf as (select target, q, (2 * w * n - s0) / s0 as b0, s1 / s0 as m, (2 * w * sx - s1 - (2 * w * n - s0) * s1 / s0) / (s2 - s1 * s1 / s0 + 1.0) as b1 from ww join al using (target)),
    pd as (select target, run, tr, any_value(y) as label, arg_max(q, (x - m) * b1 + b0) as predicted from rw, cf where (run // 6) % 2 = 1 group by 1, 2, 3),
    pg as (select *, (run % 6 + 1)::varchar as subset from pd union all select *, 'all' from pd),
    rc as (select target, subset, label, avg((label = predicted)::integer) as r, count(*) as n from pg group by 1, 2, 3), sc as (select target, subset, avg(r) as a, count(*) as n_present, cast(sum(n) as bigint) as n from rc group by 1, 2 having count(*) > 1)"""


@_query(
    "ml8_kind_transfer",
    f"""with {_TRANSFER} select o.subset, o.n, o.n_present, o.a as balanced_accuracy, (o.a - 0.2) / 0.8 as effect, avg(s.a) as null_mean, count(*) as n_draws, (1 + sum((s.a >= o.a - 1e-12)::integer)) / (count(*) + 1) as p
    from sc o join sc s using (subset) where o.target = 0 and s.target > 0 group by 1, 2, 3, 4, 5""",
)
def ml8(spark, d):
    """Fitted to the runs of part a, tested on those of part b by season, against 20 shifted label vectors."""
    values = D.with_run_fields(D.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts"), F.col("event_id"), F.col("value").cast("double").alias("x")))
    place = F.row_number().over(C.Window.partitionBy("run").orderBy("ts", "event_id")) - 1
    rows = values.withColumn("tr", place.cast("int")).select("run", "tr", "part", "season", F.array("x").alias("features")).join(D.kinds(spark, d).select("run", "tr", F.col("state").alias("label")), ["run", "tr"])
    train, test = C.in_both(rows.where("part = 'a'"), rows.where("part = 'b'"))
    train = C.shifted_labels(train, 20, 6)
    return C.transfer_test(C.transfer(train, test, ["label", *[f"null_{i}" for i in range(1, 21)]], "season"), 5)


@_query("ml8_vector_transfer")
def ml8b(spark, d):
    """Labels of the embeddings from all 64 dimensions: fitted to the even recordings, tested on the odd ones by thirds."""
    rows = _vectors(spark, d).where("label is not null").withColumn("third", F.floor(F.col("tr") * 3 / 50).cast("string"))
    train, test = C.in_both(rows.where("run % 2 = 0"), rows.where("run % 2 = 1"))
    names = ["label", *[f"null_{i}" for i in range(1, 41)]]
    counts = C.transfer(C.shifted_labels(train, 40, 42), test, names, "third")
    return C.transfer_test(counts, train.select("label").distinct().count())
