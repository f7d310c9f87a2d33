import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as registry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    rows = registry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["count"] >= 200
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_without_the_optional_subpackage(tmp_path, gone):
    ignore = shutil.ignore_patterns(*gone, ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "r", ignore=ignore)
    code = "import __spark_entry__ as e; n = e.queries(); print(len(n), any(x.startswith('op') for x in n), 'pipeline' in n, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert out.returncode == 0, out.stderr[-500:]
    assert out.stdout.split()[1:3] == ["False", "False"] and int(out.stdout.split()[0]) >= 40
