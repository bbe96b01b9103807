"""The entry point is read before any session exists."""

import subprocess
import sys


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
