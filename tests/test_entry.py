"""The driver's contract, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.abspath(e.__file__))


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40


def test_without_corpus_operators(tmp_path):
    """The rest imports where the subpackage and the pipeline are missing."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text(open(os.path.join(ROOT, name)).read())
    for folder, _, names in os.walk(os.path.join(ROOT, "skein")):
        if "llm" not in folder.split(os.sep):
            to = tmp_path / os.path.relpath(folder, ROOT)
            to.mkdir(parents=True, exist_ok=True)
            for n in names:
                if n.endswith(".py"):
                    (to / n).write_text(open(os.path.join(folder, n)).read())
    code = "import __spark_entry__ as e; assert 'turbomq' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    assert e.entry(spark).count() == 1
