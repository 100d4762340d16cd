"""The entry points, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
SCRIPT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(x.startswith('op') and x[2:3].isdigit() or x == 'pipeline' for x in q))"


def _counts(folder):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, check=True).stdout.split()
    return int(out[0]), int(out[1])


def test_queries_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    bare, _ = _counts(copy)
    assert _counts(copy) == (bare, 0) and bare > 100
    if (ROOT / "tallyforge/llm").is_dir():
        assert _counts(ROOT) == (bare + 11, 11)


def test_a_missing_dependency_is_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    (copy / "tallyforge/llm").mkdir()
    (copy / "tallyforge/llm/__init__.py").write_text("")
    (copy / "tallyforge/llm/queries.py").write_text("import no_such_package\n")
    assert subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True).returncode != 0
