import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from corvane.llm import common

ROOT = Path(__file__).resolve().parents[2]


def session(spark, master, found=None):
    conf = SimpleNamespace(get=lambda *a: found)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *a: None)), _jvm=spark._jvm, _jsparkSession=spark._jsparkSession)


def test_clusters_must_name_the_shared_folder(spark):
    for master in ("spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(spark, master))
    local = session(spark, "local[4]")
    assert common.shared_dir(local).startswith("file:///") and common.shared_dir(local) == common.shared_dir(local)
    assert common.shared_dir(session(spark, "spark://host:7077", "hdfs://store/shared/")) == "hdfs://store/shared"


def test_folders_without_a_scheme_are_those_of_sparks_file_system(spark, tmp_path):
    assert common.shared_dir(session(spark, "spark://host:7077", str(tmp_path))) == f"file://{tmp_path}"


def test_a_session_without_the_setting(tmp_path):
    code = """
from corvane.session import local_session
from corvane.llm import exact_dedup
spark = local_session("2", 2)
docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
print("rows", exact_dedup.exact_duplicates(docs).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"})
    assert "rows 3" in done.stdout, done.stderr


def test_settings_hold_inside_the_block_alone(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), common.setting(spark, name, "3"):
        assert spark.conf.get(name) == "3"
        raise RuntimeError
    assert spark.conf.get(name) == before


def test_steps_leave_files_and_no_shuffles(spark):
    df = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    stored = common.materialised(df, "step")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, df.collect())) and stored.dtypes == df.dtypes
    assert "Exchange" not in stored._jdf.queryExecution().toString()
    common.discard(stored)
    with pytest.raises(Exception):
        common.materialised(df, "other").sparkSession.read.parquet(stored.inputFiles()[0]).count()


def test_a_task_ends_with_its_batches():
    assert list(common.released(iter([1, 2, 3]))) == [1, 2, 3] and list(common.released([])) == []
