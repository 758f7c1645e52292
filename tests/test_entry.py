"""The driver's entry module, with and without the optional package."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=True).stdout
    return [line.split() for line in out.strip().split("\n")]


def test_entry_works_without_the_optional_package(scratch):
    shutil.copytree(os.path.join(ROOT, "marketlens"), scratch + "/marketlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), scratch)
    names, oracles = _names(scratch)
    assert len(names) > 80 and set(oracles) <= set(names) and not any(n.startswith("op") for n in names)
    os.makedirs(scratch + "/marketlens/llm/__pycache__")  # an emptied folder
    open(scratch + "/corpus_pipeline.py", "w").write("from marketlens.llm import minhash\n")
    assert _names(scratch)[0] == names


def test_an_error_inside_the_package_is_not_hidden(scratch):
    shutil.copytree(os.path.join(ROOT, "marketlens"), scratch + "/marketlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), scratch)
    open(scratch + "/corpus_pipeline.py", "w").write("import no_such_module\n")
    code = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=scratch, capture_output=True, timeout=120).returncode
    assert code != 0
