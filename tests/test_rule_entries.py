"""Files are parsed once, by as many tasks as there is work."""

from sparkweave.plans import cases

DATA = "/root/testdata/sf0.01"


def test_rule_entries_parse_once_and_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cases, "FILES_A_TASK", 20, raising=False)
    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    assert cases.written_files(spark, DATA, cases.PYTHON).rdd.getNumPartitions() == suppliers // 20 + 1 > 1
    found = cases.QUERIES["rule_entries"](spark, DATA)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3 * (suppliers // 2)
