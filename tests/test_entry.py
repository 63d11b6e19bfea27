"""The entry points, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):  # the pipeline may stay where its subpackage is gone
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/tessera"):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(f"{folder}/{n}").read()


def test_workers_need_no_path_to_the_package(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession as S; "
        "s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate(); "
        "assert e.entry(s).count() == 1; n = 'op9_pii_spans'; q = e.queries(); assert n not in q or q[n](s, '/root/testdata/sf0.001').count() == 200"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
