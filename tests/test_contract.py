import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_everything_but_the_subpackage_imports_without_it(tmp_path):
    script = f"""
import importlib.abc, sys
sys.path.insert(0, {ROOT!r})
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith('lodestrata.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import pkgutil, lodestrata
names = [m.name for m in pkgutil.walk_packages(lodestrata.__path__, 'lodestrata.') if not m.name.startswith('lodestrata.llm')]
for n in names:
    __import__(n)
print(len(names))
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 10


def test_nothing_outside_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "lodestrata")):
        if "llm" in folder.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "lodestrata.llm" not in f.read(), n


def test_the_rest_runs_where_both_folders_are_deleted(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "lodestrata" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    script = "import __spark_entry__ as e; names = set(e.queries()); assert names >= set(e.oracle_sql()) and 'lexical_topk' in names; assert not any(n.startswith('op1') or n == 'pipeline' for n in names); print(len(names))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120, cwd=copy, env=env)
    assert out.returncode == 0 and int(out.stdout) > 90, out.stderr
    tests = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_text.py", "tests/test_diffs.py"], capture_output=True, text=True, timeout=280, cwd=copy, env=env)
    assert tests.returncode == 0, tests.stdout[-2000:]
