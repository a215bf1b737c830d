"""The entry module works without the removable parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
found = e.queries()
assert "pii_detect_summary" in found and set(e.oracle_sql()) <= set(found)
print(sum(k.startswith("op") and k[2].isdigit() for k in found), "pipeline" in found)
"""


def outcome(tmp_path, *gone):
    top = tmp_path / "repo"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        target = top / g
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(ROOT, str(top))}
    return subprocess.run([sys.executable, "-c", CODE], cwd=top, env=env, capture_output=True, text=True, timeout=300)


def test_rest_without_the_removable_parts(tmp_path):
    done = outcome(tmp_path, "larkspur/llm", "tests/llm")
    assert done.returncode == 0 and done.stdout.split() == ["0", "False"], done.stderr


def test_rest_without_the_pipeline_either(tmp_path):
    done = outcome(tmp_path, "larkspur/llm", "tests/llm", "corpus_pipeline.py")
    assert done.returncode == 0 and done.stdout.split() == ["0", "False"], done.stderr
