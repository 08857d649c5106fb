import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"


def names(before: str) -> set[str]:
    done = subprocess.run([sys.executable, "-c", before + SHOW], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"})
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_queries_need_no_files_of_spark():
    hidden = "import pathlib; glob = pathlib.Path.glob; pathlib.Path.glob = lambda self, *a, **k: iter(()) if self.name == 'jars' else glob(self, *a, **k)\n"
    assert {"corpus_stats", "word_freq_top20", "hybrid_rrf"} <= names(hidden)


@pytest.mark.parametrize("missing", ["public_tokenizers", "ahocorasick", "corvane.llm", "corpus_pipeline"])
def test_core_queries_stay_without_the_optional_part(missing):
    blocked = f"""
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing + '.'!r}):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Blocked())
"""
    found = names(blocked)
    assert "hybrid_rrf" in found and not any(n.startswith("op") or n == "pipeline" for n in found)
