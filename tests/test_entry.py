"""The driver contract stands without the optional parts."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tapelake.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
PRINTS = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, kept):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "tapelake", copy / "tapelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *kept):
        shutil.copy(ROOT / name, copy / name)
    run = subprocess.run([sys.executable, "-B", "-c", PRINTS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names, sql = (line.split() for line in run.stdout.splitlines())
    assert names == sql == sorted(QUERIES)


def test_entry_does_not_hide_a_broken_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "tapelake", copy / "tapelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    (copy / "tapelake/llm").mkdir()
    (copy / "tapelake/llm/oracle.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", PRINTS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode and "no_such_module" in run.stderr
