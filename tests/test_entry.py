"""The driver entry with and without the corpus modules."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(set(e.queries())), len(e.queries()), all(isinstance(x, str) for x in e.oracle_sql().values()), any(k.startswith('op') for k in e.queries()))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120)


def copy(to):
    shutil.copytree(ROOT / "tessera", to / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", to)
    return to


def test_without_the_corpus_modules(tmp_path):
    copy(tmp_path)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    out = run(tmp_path).stdout.split()
    assert out[0] == "True" and int(out[1]) > 190 and out[2:] == ["True", "False"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run(tmp_path).stdout.split() == out


def test_a_missing_library_is_no_silence(tmp_path):
    copy(tmp_path)
    (tmp_path / "tessera" / "llm").mkdir(exist_ok=True)
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("import a_library_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("from tessera.llm import queries\n")
    assert "a_library_that_is_not_there" in run(tmp_path).stderr
