"""Run every registered query against its oracle: python tests/check_all.py [sf_dir] [names...]"""
import sys, time
sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])
from harness import compare  # noqa: E402
import __spark_entry__ as E  # noqa: E402
from tokloom.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
import os  # noqa: E402
if os.environ.get("PLAIN_SESSION"):
    from pyspark.sql import SparkSession  # noqa: E402
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    print("ansi", spark.conf.get("spark.sql.ansi.enabled"), flush=True)
else:
    spark = build_session("local[8]", shuffle_partitions=8)
Q, O = E.queries(), E.oracle_sql()
for n in (names or list(Q)):
    t = time.time()
    try:
        if n in O:
            k = compare(spark, n, sf, Q[n], O[n])
            print(f"OK   {n:24s} rows={k:6d} {time.time()-t:6.1f}s", flush=True)
        else:
            k = Q[n](spark, sf).count()
            print(f"ROWS {n:24s} rows={k:6d} {time.time()-t:6.1f}s (no oracle)", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {n:24s} {time.time()-t:6.1f}s {str(e)[:1500]}", flush=True)
