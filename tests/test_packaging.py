import os
import subprocess
import sys

from pyspark import cloudpickle

import newsloom  # noqa: F401
from newsloom.functions.highlight import mark_text


def test_task_functions_need_no_installed_package(tmp_path):
    (tmp_path / "function").write_bytes(cloudpickle.dumps(mark_text))
    code = (
        "import pickle; from pyspark import cloudpickle; "
        "f = cloudpickle.loads(open('function', 'rb').read()); "
        "print(f('un été', [(('ete',), False)], '[', ']'))"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, check=True
    )
    assert done.stdout.strip() == "un [été]"


def test_queries_are_listed_without_a_session(tmp_path):
    code = "import __spark_entry__ as e; print(set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 0)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(newsloom.__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "True"
