"""Time one query several times and show its plan: python tests/profile_one.py DIR NAME."""
import sys, time
from axiomloom import build_session
from axiomloom.plans import catalog

spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:]:
    for _ in range(3):
        a = time.time(); df = catalog.QUERIES[name](spark, sys.argv[1]); b = time.time(); n = len(df.collect()); c = time.time()
        print(name, n, f"build {b-a:.2f} run {c-b:.2f}")
    df.explain("formatted" if len(sys.argv) < 5 else "simple")
