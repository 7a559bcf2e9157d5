import importlib
import re

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"random_split"}


def own(names):
    """Without the corpus queries, which have their own tests."""
    return {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_contract_keys():
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert own(q) - own(o) == ROWS_ONLY


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["actual", "predicted", "n"] and len(rows) == 4


def test_oracles_match_at_smoke_scale(spark):
    """Every query with an oracle equals its DuckDB SQL on sf0.001."""
    import sys
    import os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check_oracles import compare, duck

    entry = importlib.import_module("__spark_entry__")
    con = duck(SF)
    bad = []
    for name, fn in entry.queries().items():
        if name not in own({name}):
            continue
        res = compare(spark, con, name, fn, entry.oracle_sql().get(name), SF)
        if res.get("ok") is False:
            bad.append(res)
    assert not bad, bad
