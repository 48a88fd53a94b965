import importlib
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    row = entry.entry(spark).first()
    assert row["n_train"] + row["n_test"] > 0 and row["verdict"]


def test_sql_belongs_to_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_corpus_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "veritrail"), tmp_path / "veritrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.corpus is None and 'pipeline' not in e.queries() and len(e.queries()) > 30"
    for more in ([], ["corpus_pipeline.py"]):  # without the pipeline's file, and with it but without what it needs
        for name in more:
            if os.path.exists(os.path.join(ROOT, name)):
                shutil.copy(os.path.join(ROOT, name), tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
