"""The entry module lists the subpackage's queries, and does not swallow an import that fails inside it."""

from __future__ import annotations

import subprocess
import sys

import pytest


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], capture_output=True, text=True, timeout=120, check=False)


@pytest.mark.parametrize("wheel", ["xxhash", "pyarrow"])
def test_missing_wheels_are_errors(wheel):
    out = run(f"import sys; sys.modules['{wheel}'] = None; import __spark_entry__")
    assert out.returncode and "ModuleNotFoundError" in out.stderr


def test_all_queries_are_listed():
    out = run("import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())")
    names = out.stdout.split()
    assert out.returncode == 0 and "pipeline" in names and all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 14))
