"""The library's queries stay when the optional parts are gone, or cannot be imported."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def ask(folder, before=""):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", before + ASK], cwd=folder, env=env | {"PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, check=True)
    return list(map(int, done.stdout.split()))


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(os.path.join(ROOT, "cytolake"), tmp_path / "cytolake", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_without_the_folders(copy):
    from cytolake.plans import registry

    assert ask(copy) == [len(registry.QUERIES), len(registry.SQL), 0]


def test_with_an_empty_folder_left(copy):
    from cytolake.plans import registry

    (copy / "cytolake" / "llm" / "__pycache__").mkdir(parents=True)
    assert ask(copy) == [len(registry.QUERIES), len(registry.SQL), 0]


def test_without_the_tokenizers():
    from cytolake.plans import registry

    assert ask(ROOT, "import sys; sys.modules['public_tokenizers'] = None; ") == [len(registry.QUERIES), len(registry.SQL), 0]
