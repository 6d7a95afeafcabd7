"""Compare Spark result types with DuckDB result types for every oracle query."""
import sys
sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])
from harness import duck  # noqa: E402
import __spark_entry__ as E  # noqa: E402
from tokloom.session import build_session  # noqa: E402

MAP = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
       "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT",
       "ShortType()": "SMALLINT", "ByteType()": "TINYINT"}
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
skip = set(sys.argv[2:])
spark = build_session("local[8]", shuffle_partitions=8)
con = duck(sf)
Q, O = E.queries(), E.oracle_sql()
for n, sql in O.items():
    if n in skip:
        continue
    s = {f.name: MAP.get(repr(f.dataType), repr(f.dataType)) for f in Q[n](spark, sf).schema.fields}
    d = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE ({sql})").fetchall()}
    bad = {k: (s.get(k), d.get(k)) for k in set(s) | set(d) if s.get(k) != d.get(k)}
    print("OK  " if not bad else "DIFF", n, bad if bad else "", flush=True)
