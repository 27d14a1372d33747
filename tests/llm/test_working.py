"""Working tables go once a stage's rows are written; the rows stay."""

import os

from strandline.llm import suffixes
from strandline.llm.common import drop_path, kept_output, written


def folders(spark):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/strandline"
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_working_tables_go(spark):
    df = spark.createDataFrame([(i, f"{i} " + "one passage that stands everywhere " * 12) for i in range(20)], "doc_id long, text string")
    written(df, "warm")
    before, tables = folders(spark), {t.name for t in spark.catalog.listTables()}
    want = sorted((r["doc_id"], bytes(r["kept"])) for r in suffixes.remove_repeats(df).collect())
    more = folders(spark)
    assert len(more) > len(before)
    known = {t.name for t in spark.catalog.listTables()}
    out, path = kept_output(spark, lambda: suffixes.remove_repeats(written(df, "inner")), "stage")
    assert folders(spark) - more == {os.path.basename(path)} and {t.name for t in spark.catalog.listTables()} == known >= tables
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in out.collect()) == want
    drop_path(spark, path)
    assert folders(spark) == more
