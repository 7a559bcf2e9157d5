"""Same result under 1 and 7 shuffle partitions and input layouts."""

import importlib
import os
import sys

import pytest

from connlearn.sources import adapters

SF = "/root/testdata/sf0.001"
# the sampler's parts depend on the layout; fitted weights are sums of floats
LAYOUT_DEPENDENT = {"random_split", "lr_weights"}


def names():
    catalog = importlib.import_module("connlearn.plans.catalog")
    return [n for n in catalog.QUERIES if n not in LAYOUT_DEPENDENT and not n.startswith("flow_")]


@pytest.mark.parametrize("name", names())
def test_partitioning_does_not_change_results(spark, name, monkeypatch):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check_oracles import bag

    catalog = importlib.import_module("connlearn.plans.catalog")
    read, before, bags = adapters.read_table, spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 7):
            def layout(*args, n=n, **kw):
                return read(*args, **kw).repartition(n)
            monkeypatch.setattr(adapters, "read_table", layout)
            monkeypatch.setattr(catalog, "read_table", layout)
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = catalog.QUERIES[name](spark, SF)
            bags.append(bag(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert bags[0] == bags[1]
