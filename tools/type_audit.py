"""List queries whose Spark and DuckDB result column types fall in different families."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import get_session  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402

SPARK = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "str",
         "boolean": "bool", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "hugeint", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str",
        "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "ts"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, q in sorted(load_all().items()):
        if q.sql is None:
            continue
        st = dict(q.fn(spark, sf).dtypes)
        rel = con.sql(q.oracle())
        dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        bad = []
        for c in st:
            a = SPARK.get(st[c].split("(")[0], st[c])
            b = DUCK.get(dt.get(c, "?").split("(")[0], dt.get(c, "?"))
            if a != b or st[c] != {"BIGINT": "bigint", "INTEGER": "int"}.get(dt.get(c), st[c]):
                bad.append(f"{c}:{st[c]}/{dt.get(c)}")
        if bad:
            print(name, " ".join(bad))


if __name__ == "__main__":
    main()
