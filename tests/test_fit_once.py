"""Training reads its lines once, whatever number of model tables comes of them."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import ModelSpec
from ledgerlens.operators import scoring

SPEC = ModelSpec(id_col="id", target="cls", categorical=("c",), numeric=("x",), k=3)
ROWS = [(t, "lines", i, f"k{i % 2}", "abc"[i % 3], float(i)) for t in ("a", "b") for i in range(20)]


def lines(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, table_name string, id long, cls string, c string, x double")


@pytest.mark.parametrize("extra", [[], [("a", "lines", 100, "rare", "a", 1.0), (None, "lines", 101, "k0", "a", 1.0), ("one", "lines", 102, "k0", "a", 1.0)]])
def test_lines_are_read_once(spark, extra):
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return True

    rows = ROWS + extra
    train = lines(spark, rows).filter(F.udf(counted, "boolean").asNondeterministic()("id"))
    model = scoring.fit(train, SPEC)
    assert seen.value == len(rows)
    assert sorted(r.id for r in model.ref.filter("tenant_id = 'a'").collect()) == list(range(20))
    assert {(r.tenant_id, r.reason) for r in model.state.collect()} == {("a", None), ("b", None)} | ({(None, "empty"), ("one", "empty")} if extra else set())
    assert model.ref.count() == len(ROWS)
