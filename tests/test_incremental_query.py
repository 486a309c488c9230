from collections import Counter

from loomline import queries as Q


def test_two_runs_with_a_failed_one_between(spark, tmp_path):
    """Repeated rows count once, nulls are values, and the failed run puts nothing out."""
    rows = [(i, "a.b", i % 4, [None, "I", "U", "D"][i % 4], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:10], "row_id long, dataset string, row_key long, op string, amount double")
    df.selectExpr("*", *[f"timestamp_ntz'2024-01-01' AS {c}" for c in Q.TIME_COLUMNS]).write.parquet(f"{tmp_path}/source_rows.parquet")
    got = Counter((r.row_id, r.change) for r in Q.QUERIES["p3_runs"](spark, str(tmp_path)).collect())
    assert got == Counter([*((i, "new") for i in range(30)), *((i, "changed") for i in range(30) if i % 3 == 1)])
