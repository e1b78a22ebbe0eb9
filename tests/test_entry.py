import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_catalogue_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 65


def test_core_does_not_need_the_subpackage():
    said = subprocess.run(["grep", "-rlE", r"sedgewren\.llm|from \.llm|import llm", str(REPO / "sedgewren"), "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all("/sedgewren/llm/" in x for x in said), said
    assert sys.version_info >= (3, 10)
