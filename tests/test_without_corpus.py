"""The integration engine works where the corpus operators are not installed."""

import os
import re
import shutil
import subprocess
import sys

from weftline.plans import driver

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_outside_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "weftline")):
        if os.path.relpath(folder, ROOT).startswith(os.path.join("weftline", "llm")):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"weftline\.llm|corpus_pipeline", f.read()), name


def test_entry_imports_without_them(tmp_path):
    shutil.copytree(os.path.join(ROOT, "weftline"), tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sync_plan' in q and 'pipeline' not in q and set(e.oracle_sql()) == set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.strip() == str(len(driver.queries())), said.stderr
