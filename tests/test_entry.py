"""The driver's entry, whole and without what is optional."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

HIDE = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in {names}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print(len(e.queries()), sum(n.startswith("op") and n[2].isdigit() for n in e.queries()), len(e.oracle_sql()))
"""


@pytest.mark.parametrize("names", [("ahocorasick",), ("casewright.llm", "corpus_pipeline"), ("tiktoken", "public_tokenizers")])
def test_library_stands_without_optional_parts(names):
    out = subprocess.run([sys.executable, "-c", HIDE.format(names=names, root=str(ROOT))], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 250 and int(out[1]) == 0 and int(out[2]) > 250
