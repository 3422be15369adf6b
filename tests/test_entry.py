import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_flagship(spark):
    assert entry.entry(spark).count() == 1


def test_without_the_text_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("terrapart.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        again = importlib.reload(entry)
        assert not any(n.startswith("op") or n == "pipeline" for n in again.queries()) and "landcover_overall" in again.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_with_the_text_folders_deleted(tmp_path):
    """A copy of the library without the text subpackage and the pipeline imports and has all other queries."""
    root, copy = Path(entry.__file__).parent, tmp_path / "copy"
    shutil.copytree(root / "terrapart", copy / "terrapart", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert set(found) == {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
