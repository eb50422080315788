import os
import shutil
import subprocess
import sys

import pytest

from xylem.plans import catalog

from . import oracle

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(oracle.SF):
        pytest.skip("no test tables here")
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, con, name):
    oracle.assert_same(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_query_is_registered_with_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_the_entry_point_works_without_the_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/xylem", tmp_path / "xylem", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(q) == set(e.oracle_sql()) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_only_the_text_operators_may_be_missing(tmp_path):
    """Both folders and the pipeline gone: the rest's tests run. A broken import inside them is an error."""
    shutil.copytree(f"{ROOT}/xylem", tmp_path / "xylem", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_cli.py", "tests/test_conformance.py", "-k", "command_line or expressions"], cwd=tmp_path, check=True, env=env)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert broken.returncode and "no_such_module" in broken.stderr


def test_nothing_outside_imports_the_text_operators():
    for folder, _, names in os.walk(f"{ROOT}/xylem"):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n)).read()
                    assert "llm" not in text and "corpus_pipeline" not in text
