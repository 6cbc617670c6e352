"""The library never imports the training-data subpackage, and the driver entry works without it."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_imports_the_training_subpackage():
    for path in (ROOT / "textward").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(encoding="utf-8"), re.MULTILINE), path


def test_entry_without_the_training_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'textward.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_fixed_values_are_complete():
    from textward.sources.default_patterns import PATTERNS

    assert len(PATTERNS) == 101 and all(len(r) == 13 for r in PATTERNS)
