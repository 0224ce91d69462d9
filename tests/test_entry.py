import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_know_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "quarterloom")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "quarterloom.llm" not in file.read(), name


def test_queries_match_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"create view {name[:-8]} as select * from '{small}/{name}'")
    plain = lambda v: None if v != v else round(v, 6) if isinstance(v, float) else v
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, small)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns), name
        mine = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
        theirs = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=repr)
        assert mine == theirs, name


def test_bench_runs():
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_MEMORY": "2g"}
    if os.path.isdir(env["BENCH_SF_DIR"]) and os.environ.get("RUN_BENCH_TEST"):
        out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, check=True)
        assert '"unit": "sec"' in out.stdout
