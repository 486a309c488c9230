import pytest
from oracle import DATA, same

from loomline import engine_queries, pipeline_queries, queries

#: All of the core's and the engine's queries, and one of each kind that runs the engine; the driver runs every one.
NAMES = [*queries.ORACLE, *engine_queries.ORACLE, "pipeline_revenue_daily", "incremental_two_pass", "merge_task", "multi_statement_task", "latest_status", "topo_layers", "impact", "mermaid_combined", "extract_io_cte", "column_lineage_agg", "join_right_semi", "qualify", "agg_sum", "agg_first", "agg_any_value", "agg_mode", "column_lineage_unread_cte", "column_lineage_scalar_subquery", "extract_io_quoted", "join_asof", "join_range"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    same(spark, name, (queries.QUERIES | pipeline_queries.QUERIES | engine_queries.QUERIES)[name], (queries.ORACLE | pipeline_queries.ORACLE | engine_queries.ORACLE)[name])
