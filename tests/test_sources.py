"""File scans, writers and comparisons on small files of their own."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.sources import files, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_session_scans(spark, tmp_path):
    a = put(tmp_path / "ses-002_scans.tsv", "filename\trel_acq_time\nfunc/sub-01_task-s01e02a_run-1_bold.nii.gz\t10.5\nanat/sub-01_T1w.nii.gz\t\nfunc/sub-01_task-s01e02b_bold.nii.gz\t9.5\n")
    b = put(tmp_path / "ses-001_scans.tsv", "filename\trel_acq_time\nfunc/sub-01_task-s01e01a_bold.nii.gz\t100\n")
    rows = [tuple(r)[:3] for r in files.session_scans(spark, [a, b]).collect()]
    assert rows == [("s01e01a", "ses-001", 100.0), ("s01e02b", "ses-002", 9.5), ("s01e02a", "ses-002", 10.5)]
    bad = put(tmp_path / "bad" / "ses-003_scans.tsv", "filename\trel_acq_time\nfunc/sub-01_task-s01e03a_bold.nii.gz\t\n")
    with pytest.raises(Exception, match="no rel_acq_time"):
        files.session_scans(spark, bad).collect()
    with pytest.raises(ValueError, match="rel_acq_time"):
        files.session_scans(spark, put(tmp_path / "none.tsv", "filename\nx\n"))


def test_one_session(spark):
    rows = spark.createDataFrame([("p", "r1", "ses-1"), ("p", "r2", "ses-1"), ("p", "r2", "ses-2")], "subject string, run_id string, session_id string")
    pin = lambda *p: spark.createDataFrame(list(p), "subject string, run_id string, pinned string")
    got = files.one_session(rows, pin(("p", "r2", "ses-2"))).collect()
    assert sorted((r["run_id"], r["session_id"]) for r in got) == [("r1", "ses-1"), ("r2", "ses-2")]
    with pytest.raises(Exception, match="none is chosen"):
        files.one_session(rows, pin()).collect()
    with pytest.raises(Exception, match="not exactly one"):
        files.one_session(rows, pin(("p", "r2", "ses-9"))).collect()
    with pytest.raises(Exception, match="not exactly one"):
        files.one_session(rows, pin(("p", "r2", "ses-2"), ("p", "r1", "ses-5"))).collect()


def test_acquisition_times(spark, tmp_path):
    none = spark.createDataFrame([], "subject string, run_id string, pinned string")
    path = put(tmp_path / "a.csv", "run_id,rel_acq_time,filename\nr1,1.5,func/ses-004_x\nr2,2.5,func/none\n")
    assert sorted(map(tuple, files.acquisition_times(spark, path, none, "p").collect())) == [("r1", "ses-004", 1.5), ("r2", None, 2.5)]


def test_confounds(spark, tmp_path):
    one = put(tmp_path / "sub-01_ses-001_task-r1_desc-confounds.tsv", "framewise_displacement\tcsf\tcosine00\tother\nn/a\t1\t2\t9\n0.2\t3\tn/a\t9\n0.4\t5\t6\t9\n")
    two = put(tmp_path / "sub-01_ses-002_task-r2_desc-confounds.tsv", "framewise_displacement\tcsf\tcosine00\tother\n0.1\t7\t1\t9\n")
    assert sorted(map(tuple, files.median_displacement(spark, [one, two]).collect())) == [("r1", "ses-001", pytest.approx(0.3)), ("r2", "ses-002", 0.1)]
    got = files.confounds(spark, [one, two], ["csf"])
    assert got.columns == ["run_id", "tr", "csf", "cosine00"]
    assert sorted(map(tuple, got.collect())) == [("r1", 0, -2.0, -2.0), ("r1", 1, 0.0, 0.0), ("r1", 2, 2.0, 2.0), ("r2", 0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="absent"):
        files.confounds(spark, one, ["absent"])


def test_label_tables(spark, tmp_path):
    path = put(tmp_path / "labels.txt", "17Networks_LH_VisCent_1\n1 120 18 134 255\n17Networks_RH_SomMotA_2\n 2 1 1 1 255\nleft over\n")
    assert sorted(map(tuple, files.paired_labels(spark, path).collect())) == [(1, "17Networks_LH_VisCent_1"), (2, "17Networks_RH_SomMotA_2")]
    table = put(tmp_path / "atlas.tsv", "index\tlabel\tlabel_17network\n1\tp1\tVisCent\n2\tp2\tSomMotA\n3\tthalamus\tn/a\n")
    assert [r["label"] for r in files.atlas_labels(spark, table, 3, 1).orderBy("parcel").collect()] == ["VisCent", "SomMotA", "thalamus"]
    assert [r["label"] for r in files.atlas_labels(spark, table).orderBy("parcel").collect()] == ["VisCent", "SomMotA", "n/a"]
    with pytest.raises(ValueError):
        files.atlas_labels(spark, put(tmp_path / "x.tsv", "index\n1\n"))


def test_run_list(spark, tmp_path):
    assert files.run_list(spark, put(tmp_path / "l.txt", "s01e01a\n\n  s01e01b \n")) == ["s01e01a", "s01e01b"]
    with pytest.raises(ValueError):
        files.run_list(spark, put(tmp_path / "e.txt", "\n"))


def test_dense_runs(spark):
    wide = [0.0] + [float(i) for i in range(156)]
    rows = spark.createDataFrame([(1, 0, wide), (2, 0, [1.0, 2.0])], "run long, tr int, features array<double>")
    got = {r["run"]: r["features"] for r in files.dense_runs(rows).collect()}
    assert got == {1: wide[1:], 2: [1.0, 2.0]}
    odd = spark.createDataFrame([(1, t, [1.0] * 1000 if t else [math.nan, math.inf] + [1.0] * 998) for t in range(4)], "run long, tr int, features array<double>")
    first = files.dense_runs(odd).where("tr = 0").first()["features"]
    assert first[:3] == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="not finite"):
        files.dense_runs(odd, most=0.0004).collect()


def test_transcript(spark):
    words = spark.createDataFrame([("r", 0.1, "a"), ("r", 3.2, "c"), ("r", 1.48, "b"), ("r", 99.0, "late")], "run string, onset double, word string")
    lengths = spark.createDataFrame([("r", 3)], "run string, n_trs long")
    got = [(r["tr"], r["text"], r["so_far"]) for r in files.transcript(words, lengths).orderBy("tr").collect()]
    assert got == [(0, "a b", "a b"), (1, "", "a b"), (2, "c", "a b c")]
    moved = [r["text"] for r in files.transcript(words, lengths, shift=1.49).orderBy("tr").collect()]
    assert moved == ["", "a b", ""]


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x, y", None, 0.5), (2, "", "t", None)], "k long, a string, b string, v double")
    for gz in (False, True):
        path = str(tmp_path / f"out{gz}")
        sinks.write_records(rows, path, compress=gz)
        back = spark.read.csv(path, header=True, schema=rows.schema, emptyValue="")
        assert sorted((r["k"], r["a"] or "", r["v"]) for r in back.collect()) == [(1, "x, y", 0.5), (2, "", None)]
    with pytest.raises(Exception):
        sinks.write_records(rows, path)
    parts = str(tmp_path / "parts")
    sinks.write_by(rows, parts, ["k"])
    sinks.write_by(rows.where("k = 2").withColumn("a", F.lit("new")), parts, ["k"])
    assert sorted((r["k"], r["a"]) for r in spark.read.parquet(parts).collect()) == [(1, "x, y"), (2, "new")]


def test_pending(spark):
    work = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "layer long, setting string").withColumn("fingerprint", sinks.fingerprint("layer", "setting"))
    done = work.where("layer = 1").union(work.where("layer = 2").withColumn("fingerprint", F.lit("stale")))
    assert sorted(r["layer"] for r in sinks.pending(work, done, ["layer"]).collect()) == [2, 3]


def test_differences(spark):
    kind = "k long, s string, n long, x double"
    nan, inf = math.nan, math.inf
    a = spark.createDataFrame([(1, "a", 1, 1.0), (2, "b", 2, nan), (3, "c", 3, inf), (4, "d", 4, 1.0), (5, "e", 5, None)], kind)
    b = spark.createDataFrame([(1, "a", 1, 1.0 + 1e-9), (2, "b", 2, nan), (3, "c", 3, -inf), (5, "E", 6, None), (6, "f", 6, 0.0)], kind)
    got = sorted((r["k"], r["column"], r["kind"]) for r in sinks.differences(a, b, ["k"], atol=1e-8).collect())
    assert got == sorted([(3, "x", "structural"), (5, "s", "structural"), (5, "n", "structural"), *((4, c, "missing") for c in "snx"), *((6, c, "extra") for c in "snx")])
    assert [r["kind"] for r in sinks.differences(a.where("k = 1"), b.where("k = 1"), ["k"], rtol=1e-12).collect()] == ["numeric"]
    with pytest.raises(ValueError):
        sinks.differences(a, b.drop("x"), ["k"])
    with pytest.raises(ValueError):
        sinks.differences(a, b.withColumn("n", F.col("n").cast("double")), ["k"])
