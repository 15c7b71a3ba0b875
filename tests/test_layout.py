"""The optional subpackage stays optional."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "harborlight").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_entry_imports_without_the_optional_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('harborlight.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'worklist' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert e.oracle_sql().keys() <= e.queries().keys()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
