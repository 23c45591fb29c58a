"""Run catalog queries and their plain SQL side by side.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list):
        return tuple(map(_plain, value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(columns), sorted((tuple(_plain(row[n]) for n in order) for row in rows), key=repr)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    spark_side = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(sql)
    columns = [part[0] for part in result.description]
    return spark_side, rows_of(columns, result.fetchall())


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            ours, plain = both(spark, con, queries[name], sql[name], sf_dir)
        except Exception as error:  # report and go on
            print("ERROR", name, str(error)[:1500], flush=True)
            continue
        same = ours == plain
        print("ok   " if same else "DIFF ", name, len(ours[1]), len(plain[1]), round(time.time() - start, 1), flush=True)
        if not same:
            print("   ", ours[0], plain[0])
            print("    only here", [r for r in ours[1] if r not in set(plain[1])][:3] if len(ours[1]) < 50000 else ours[1][:2])
            print("    only sql ", [r for r in plain[1] if r not in set(ours[1])][:3] if len(plain[1]) < 50000 else plain[1][:2])


if __name__ == "__main__":
    main()
