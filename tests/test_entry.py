"""The entry file with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


def shown(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return done.stdout.strip()


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline"])
def test_entry_imports_without_the_text_operators(tmp_path, left):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name != "corpus_pipeline.py" or left == "the pipeline":
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "eventfold"), tmp_path / "eventfold", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    if left == "an empty folder":
        (tmp_path / "eventfold" / "llm").mkdir()
    assert shown(tmp_path).endswith("[]")


def test_an_error_inside_the_text_operators_is_not_swallowed(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "eventfold"), tmp_path / "eventfold", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "eventfold" / "llm").mkdir()
    (tmp_path / "eventfold" / "llm" / "__init__.py").write_text("")
    (tmp_path / "eventfold" / "llm" / "registry.py").write_text("import no_such_module_here")
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode != 0 and "no_such_module_here" in done.stderr
