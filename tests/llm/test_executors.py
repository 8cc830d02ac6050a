"""Every text query where the executors' Python does not find this package."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
sys.path.insert(0, {root!r})
import json
import __spark_entry__ as E
from crossbook.session import local_session
from pyspark.sql import functions as F

spark = local_session(4, shuffle_partitions=4)
found = spark.range(1).select(F.udf(lambda _: __import__("importlib.util").util.find_spec("crossbook") is not None,
                                    "boolean")("id")).first()[0]
rows = {{}}
for name, query in E.queries().items():
    if name == "pipeline" or (name.startswith("op") and name[2:3].isdigit()):
        rows[name] = query(spark, "/root/testdata/sf0.001").count()
print("RESULT", json.dumps([found, rows]))
"""


def test_text_queries_without_the_package_on_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "SPARK_", "PYSPARK_"))}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)
                                        if p and not os.path.exists(f"{p}/crossbook"))
    env["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900)
    line = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert line, done.stderr[-3000:]
    found, rows = json.loads(line[0].removeprefix("RESULT "))
    assert not found and len(rows) >= 14 and all(rows.values()), (found, rows)
