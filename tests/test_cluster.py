"""What must also hold where executors are processes of their own."""

import json
import os
import subprocess
import sys

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WORK = """
import json, sys
from pyspark.sql import SparkSession
from lodeworks.sources import jdbc
from lodeworks.transfer import read, transfer
jdbc.EMBEDDED_ROWS = 7
spark = SparkSession.builder.master("local-cluster[2,1,1024]").getOrCreate()
df = spark.range(20).selectExpr("id as K", "if(id % 3 = 0, null, concat('n', id)) as NAME").repartition(3)
url, opts = "jdbc:derby:memory:several;create=true", dict(table="T", cursor="K", pk=("K",))
transfer(spark, {"T": df.where("K < 5")}, url, **opts)
transfer(spark, {"T": df}, url, mode="append", **opts)
transfer(spark, {"T": df.selectExpr("K + 10 as K", "upper(NAME) as NAME")}, url, mode="merge", **opts)
rows = sorted(map(tuple, read(spark, url, "T", parallel=2).lazy().collect()))
n = read(spark, url, query="select count(*) as N from T").lazy().first()[0]
print(json.dumps([rows, n, read(spark, url, "T").lazy().where("K < 0").count()]))
"""


def test_an_embedded_database_is_the_drivers(tmp_path):
    home, own = os.path.dirname(pyspark.__file__), tmp_path / "home"
    (own / "work").mkdir(parents=True)  # executors write their logs into Spark's home
    for name in os.listdir(home):
        if name != "work":
            (own / name).symlink_to(os.path.join(home, name))
    conf = {"spark.executor.memory": "600m", "spark.driver.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.sql.shuffle.partitions": "2"}
    env = os.environ | {"SPARK_HOME": str(own), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": " ".join(f"--conf {k}={v}" for k, v in conf.items()) + " pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", WORK], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-3000:]
    rows, n, none = json.loads(run.stdout.strip().splitlines()[-1])
    want = {k: None if k % 3 == 0 else f"n{k}" for k in range(20)} | {k + 10: None if k % 3 == 0 else f"N{k}" for k in range(20) if k + 10 >= 19}
    assert rows == [[k, v] for k, v in sorted(want.items())] and n == len(rows) and none == 0
