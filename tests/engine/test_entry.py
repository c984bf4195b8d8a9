import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "thoughtloom", tmp_path / "thoughtloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; print(sorted(e.queries()));"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate();"
        "print('rows', e.queries()['role_counts'](spark, '/root/testdata/sf0.001').count())"
    )
    said = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert "keyword_topk" in said and "op1_" not in said and "pipeline" not in said and "rows 3" in said


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "thoughtloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "thoughtloom").parts:
            assert "llm" not in [word for line in path.read_text().splitlines() if line.lstrip().startswith(("import ", "from ")) for word in line.replace(".", " ").split()], path


def test_sql_is_text():
    assert all(isinstance(x, str) for x in entry.oracle_sql().values())
