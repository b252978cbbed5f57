"""Joins of tables that grow: none sends a side through the driver, however small it looks."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parity_findings", "slide_counts", "parity_text", "min_font", "near_titles", "resolved_titles"])
def test_no_side_is_broadcast(spark, name):
    df = entry.queries()[name](spark, SF)
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_derived_texts_are_not_shuffled(spark):
    """Lines of manuscripts and specifications of slides are made behind the one exchange of their rows."""
    from folioguard.plans import catalogue as C

    for df in (C.lines(spark, SF), C.slides(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("Exchange hashpartitioning") :]
        assert plan.count("Exchange hashpartitioning") == 1 and "concat" not in below


def test_a_line_is_searched_once(spark):
    """Quantities take names, amounts, units and ends of sentences from one search, and lines are made in compiled code."""
    plan = entry.queries()["conflicting_quantities"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "split(" not in plan and "filter(array" not in plan


def test_texts_are_normalised_once(spark):
    """Each side of the parity check normalises its texts below the join: two searches of white space, none in the join's condition."""
    df = entry.queries()["parity_text"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"regexp_replace(regexp_replace(regexp_replace(") == 2 and "regexp_replace" not in plan[plan.index("SortMergeJoin") :].splitlines()[0]


def test_files_share_folders(spark, tmp_path):
    """A file for each key, but no folder for each: folders are listed and moved one by one."""
    from folioguard.sources import readers
    from folioguard.sources.folders import SHARDS, write_files

    write_files(spark.range(300).selectExpr("id AS k", "concat('[\"q', id, '\"]') AS value"), str(tmp_path / "q"))
    assert len(list(tmp_path.rglob("shard=*/*"))) == 300 and len(list((tmp_path / "q").iterdir())) <= SHARDS
    assert sorted(r.query for r in readers.bib_queries(spark, str(tmp_path / "q")).collect()) == sorted(f"q{k}" for k in range(300))


def test_queries_of_files_write_no_folder_for_each_key(spark):
    import glob

    from folioguard.plans.files import _files

    path = _files(spark.range(300).selectExpr("id AS k", "'[]' AS value"), "few").removeprefix("file://")
    assert len(glob.glob(path + "/*=*")) <= 64


def test_bundles_share_folders(spark, tmp_path):
    """A folder for each bundle lies in one of few, which tasks list; the driver moves none."""
    from folioguard.sources import bundles as B
    from folioguard.sources.folders import SHARDS

    rows = spark.range(200).selectExpr("concat('s', id) AS bundle", "'ingest' AS file", "CAST(id AS STRING) AS content")
    B.write_bundles(rows, str(tmp_path / "out"))
    assert len(list(tmp_path.rglob("bundle=*"))) == 200 and len(list((tmp_path / "out").iterdir())) <= SHARDS
    assert {r.bundle: r.content for r in B.read_bundles(spark, str(tmp_path / "out")).collect()} == {f"s{k}": str(k) for k in range(200)}


def test_texts_spread_by_their_number(spark):
    """Partitions follow the rows, so what a task holds does not grow with the table; lines are made behind the one exchange."""
    from folioguard.plans import catalogue as C

    assert C._spread(spark.range(1000), "id", 100).rdd.getNumPartitions() == 10
    plan = entry.queries()["planted_entries"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(doc_id") :]
    assert "explode" not in below and "First." not in below
