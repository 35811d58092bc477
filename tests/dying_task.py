"""Run by a test: a map stage whose Python worker dies half way, under a master that tries tasks again. Prints how often each id was sent."""

import json
import os
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablemill.operators import infer

folder, mode = sys.argv[1:3]


class Dying:
    """Notes every call in a file; the first to be asked about row 23 takes its worker with it."""

    def call(self, messages, model, temperature):
        i = messages[-1]["content"]
        if i == "23" and mode == "once" and not Path(f"{folder}/died").exists():
            Path(f"{folder}/died").touch()
            os._exit(1)
        if i == "23" and mode == "always":
            os._exit(1)
        fd = os.open(f"{folder}/calls", os.O_CREAT | os.O_APPEND | os.O_WRONLY)
        os.write(fd, f"{i}\n".encode())
        os.close(fd)
        return json.dumps({"a": i})


spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = spark.range(0, 60, 1, 2).select("id", F.col("id").cast("string").alias("prompt"))
out = infer.infer(rows, Dying, ["id"], ["a"], retry=infer.Retry(pause=0.0), concurrency=1, journal=f"{folder}/log", journal_rows=1)
try:
    out.write.mode("overwrite").parquet(f"{folder}/out")
    done = {r.id: json.loads(r.reply_json)["a"] for r in spark.read.parquet(f"{folder}/out").collect()}
    assert done == {k: str(k) for k in range(60)}
except Exception as e:
    print("failed", type(e).__name__)
print(json.dumps(Counter(Path(f"{folder}/calls").read_text().split())))
