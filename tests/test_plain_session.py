"""The library runs in a session that sets none of its recommended values."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL

PROGRAM = """
import json, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as e
from orderlens.session import check_session
out = {"entry": e.entry(spark).count()}
for key in ("dim_order", "status_distribution", "double_dates"):
    out[key] = e.queries()[key](spark, sys.argv[1]).count()
out["found"] = check_session(spark)
spark.conf.set("spark.sql.adaptive.enabled", "false")
out["off"] = check_session(spark)
print("RESULT " + json.dumps(out))
"""


def test_queries_run_in_a_plain_session():
    run = subprocess.run([sys.executable, "-c", PROGRAM, SF_SMALL], cwd=ROOT, capture_output=True, text=True,
                         timeout=600, env=os.environ | {"PYTHONPATH": ROOT}, check=False)
    assert run.returncode == 0, run.stderr[-3000:]
    out = json.loads(run.stdout.split("RESULT ")[1])
    assert out["entry"] > 0 and out["dim_order"] > 0 and out["status_distribution"] > 0
    # Spark's own default (true) is no finding; a value that is off is one
    assert not any("spark.sql.adaptive.enabled" in x for x in out["found"])
    assert any("spark.sql.adaptive.enabled is false" in x for x in out["off"])
