"""The driver's contract, with and without the text-corpus subpackage."""

import os
import subprocess
import sys

import __spark_entry__
from tessera.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "line_no", "line"] and df.count() > 0


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries)


def test_the_rest_stands_alone(tmp_path):
    """Imports of the subpackage fail, and all else is there."""
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tessera.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()), e.queries()\n"
        "assert len(e.queries()) > 80 and len(e.oracle_sql()) > 80\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, check=True)
