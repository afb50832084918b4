"""The driver's entry, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [int(x) for x in out.split()]


def test_the_library_works_without_the_training_data_operators(tmp_path):
    from lexigraf import plans

    for name in ("lexigraf", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "lexigraf/llm", ignore_errors=True)
    assert listed(tmp_path) == [len(plans.QUERIES), len(plans.SQL), 0]
    # a pipeline file that was left behind is not imported either
    (tmp_path / "corpus_pipeline.py").write_text("from lexigraf.llm import mixing\n")
    assert listed(tmp_path) == [len(plans.QUERIES), len(plans.SQL), 0]


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
