"""A history of threads over the test tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view -> (table it reads, SQL with the table's name in braces)
VIEWS = {
    "h_threads": (
        "orders",
        """select o_orderkey as number, 'org/r' || cast(o_custkey % 4 as varchar(20)) as repo, case when o_orderkey % 3 = 0 then 'issue' else 'pr' end as thread_type,
  'u' || cast(o_custkey % 97 as varchar(20)) as author, case when o_orderstatus = 'O' then 'open' else 'closed' end as state, o_orderdate as created_at,
  case when o_orderkey % 3 <> 0 and o_orderstatus = 'F' then o_orderdate + interval 7 day end as merged_at, o_orderpriority as label from {orders}""",
    ),
    "h_documents": (
        "lineitem",
        """select l_orderkey as number, case l_linenumber % 5 when 0 then 'title' when 1 then 'body' when 2 then 'issue_comment' when 3 then 'review' else 'review_comment' end as source_type,
  l_partkey as source_id, l_linenumber as chunk_index, l_suppkey, l_extendedprice, 'u' || cast(l_suppkey % 97 as varchar(20)) as author,
  case when l_suppkey % 10 = 0 then 'machine' when l_suppkey % 10 <= 3 then 'authoritative' else 'reported' end as trust, l_shipdate as created_at,
  'src/m' || cast(l_partkey % 50 as varchar(20)) || '.py' as path from {lineitem}""",
    ),
    "h_files": (
        "lineitem",
        """select distinct l_orderkey as number, 'src/m' || cast(l_partkey % 50 as varchar(20)) || '.py' as path, case when l_linenumber % 2 = 0 then 'changed' else 'mentioned' end as source from {lineitem}""",
    ),
    "h_symbols": ("lineitem", """select distinct l_orderkey as number, 'mod_' || cast(l_suppkey % 40 as varchar(20)) || '.run' as symbol from {lineitem}"""),
    "h_error_text": (
        "lineitem",
        """select distinct l_orderkey as number, 'ValueError: expected ' || cast(cast(l_quantity as int) as varchar(20)) || ' features, got ' || cast(l_linenumber as varchar(20))
  || case when l_suppkey % 2 = 0 then ' on cuda' else ' on cpu' end as body from {lineitem}""",
    ),
    "h_tests": (
        "lineitem",
        """select distinct l_orderkey as number, 'tests/test_m.py::test_' || cast(l_partkey % 30 as varchar(20)) || '[p' || cast(l_linenumber % 3 as varchar(20)) || ']' as test_id from {lineitem}""",
    ),
    "h_links": ("orders", """select o_orderkey as number, 'closes' as relationship, o_orderkey - (o_orderkey % 7) - 1 as target_number from {orders} where o_orderkey % 3 <> 0"""),
    # the same numbers in two repositories
    "h_twice": (
        "orders",
        """select o_orderkey as number, 'org/one' as repo, case when o_orderkey % 3 = 0 then 'issue' else 'pr' end as thread_type, case when o_orderstatus = 'O' then 'open' else 'closed' end as state,
  o_orderdate as created_at, o_orderkey - (o_orderkey % 7) - 1 as target_number from {orders}
union all select o_orderkey, 'org/two', case when o_orderkey % 3 = 1 then 'issue' else 'pr' end, case when o_orderstatus = 'O' then 'closed' else 'open' end, o_orderdate, o_orderkey - (o_orderkey % 11) - 1 from {orders} where o_orderkey % 2 = 0""",
    ),
    "h_conv": (
        "conversations",
        """select conv_id as number, turn as comment, role as author, case role when 'system' then 'machine' when 'assistant' then 'authoritative' else 'reported' end as trust, text as body_text from {conversations}""",
    ),
    "h_posts": (
        "conversations",
        """select conv_id as number, turn as comment, 'At src/m' || cast(conv_id % 50 as varchar(20)) || '.py see `mod_' || cast(turn as varchar(20)) || '.run()` and `Config_' || cast(conv_id % 9 as varchar(20))
  || '`; tests/test_m' || cast(conv_id % 7 as varchar(20)) || '.py::TestM::test_' || cast(turn as varchar(20)) || '[p' || cast(conv_id % 3 as varchar(20)) || '] fails, same as #' || cast(100 + conv_id % 900 as varchar(20))
  || '. This is by design because it belongs in the core. Fixes #' || cast(conv_id + turn as varchar(20)) || ' and closes: #' || cast(conv_id as varchar(20)) || chr(10) || text as body from {conversations}""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


#: Rows that one task groups, sorts and joins, so that its memory is the same whatever the size of the table.
ROWS_A_TASK = 300_000
_DEALT = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view with its rows dealt by number before anything is made of them, into as many parts as the table's rows need.

    What is distinct, grouped or joined by number, or by number and more, stays where it is. The rows are counted in the footers of the files.
    """
    source, sql = VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source).repartition(parts(spark, sf_dir, source), _DEALT[source])})


def parts(spark: SparkSession, sf_dir: str, source: str) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf_dir, source).count() // ROWS_A_TASK + 1)


def in_repo(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view with the repository of each number."""
    return view(spark, sf_dir, name).join(view(spark, sf_dir, "h_threads").select("repo", "number"), "number")


def with_views(sql: str, *names: str) -> str:
    """The SQL with the views that it names in front, for an engine that has the raw tables only."""
    used = names or [n for n in VIEWS if n in sql]
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1].format(**{VIEWS[n][0]: VIEWS[n][0]})})" for n in used) + ("\n" if sql.lstrip().lower().startswith("select") else ",\n") + sql
