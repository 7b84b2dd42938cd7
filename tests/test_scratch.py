from types import SimpleNamespace

import pytest

from paymend.sources import scratch


def session(folder, master="yarn"):
    """What scratch_dir asks a session for; the real setting cannot change at run time."""
    context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: {})
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)


def test_folder_comes_from_the_session():
    one, two = (scratch.scratch_dir(session("/shared/ck/"), "x") for _ in range(2))
    assert one.startswith("/shared/ck/paymend/x-") and one != two


def test_a_cluster_must_name_the_folder():
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(session(None), "x")


def test_materialise_reads_back_what_was_written(spark):
    df = spark.range(7).withColumnRenamed("id", "n")
    copy = scratch.materialise(df, "y")
    assert copy.exceptAll(df).count() == 0 and copy.count() == 7
    assert "Range" not in copy._jdf.queryExecution().optimizedPlan().toString()


def test_an_absolute_label_is_its_own_home(spark):
    assert scratch.home(spark, "/shared/job") == "/shared/job"


def test_the_shipped_archive_holds_the_package(spark):
    import zipfile

    from paymend.session import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "paymend/session.py" in names and "paymend/operators/ledger.py" in names
