import os
import shutil
import subprocess
import sys

import __spark_entry__
import pytest

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_queries_and_oracles_belong_together():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(callable(q) for q in queries.values())


@pytest.mark.parametrize("gone", [["llm", "corpus_pipeline.py"], ["llm"]], ids=["with the pipeline", "alone"])
def test_stands_without_the_training_text_folders(tmp_path, gone):
    ignored = shutil.ignore_patterns(".git", *gone, "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "r", ignore=ignored)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'monthly_obs_stats' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_gives_twelve_months(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns[:2] == ["month_num", "month_label"] and found.count() == 12
