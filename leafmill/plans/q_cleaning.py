"""Queries: table sets and the table cleaner."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import cleaning as C
from leafmill.operators import statistics as S
from leafmill.plans.registry import query, scratch, table
from leafmill.sources import tableset as TS

PIPELINE = [
    {"type": "filter", "logic": "and", "conditions": [
        {"column": "o_totalprice", "operator": ">=", "value_type": "median"},
        {"column": "o_orderstatus", "operator": "==", "value": "F"}]},
    {"type": "drop_nulls", "columns": ["o_orderstatus", "o_custkey"], "logic": "or"},
    {"type": "deduplicate", "columns": ["o_custkey"], "logic": "and"},
]
ORDER = ["o_orderkey"]


def orders(spark, sf):
    return table(spark, sf, "orders")


def holes(spark, sf):
    """Orders with nulls put in: the driver's tables have none."""
    return orders(spark, sf).select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )


HOLES = "select o_orderkey, nullif(o_orderstatus,'P') as status, nullif(o_orderpriority,'5-LOW') as priority from orders"


@query("cleaner_pipeline", """
with f as (select * from orders where o_orderstatus='F' and
             o_totalprice >= (select quantile_cont(o_totalprice, 0.5) from orders)),
     r as (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from f
           where o_orderstatus is not null and o_custkey is not null)
select * exclude (rn) from r where rn=1""")
def cleaner_pipeline(spark, sf):
    return C.run_operations(orders(spark, sf), PIPELINE, ORDER)


@query("filter_comparisons", """
select * from orders where o_totalprice > 1000 and o_totalprice < 400000 and o_custkey >= 10
  and o_custkey <= 100000 and o_orderstatus <> 'P'""")
def filter_comparisons(spark, sf):
    return C.filter_rows(orders(spark, sf), [
        {"column": "o_totalprice", "operator": ">", "value": 1000},
        {"column": "o_totalprice", "operator": "<", "value": 400000},
        {"column": "o_custkey", "operator": ">=", "value": 10},
        {"column": "o_custkey", "operator": "<=", "value": 100000},
        {"column": "o_orderstatus", "operator": "!=", "value": "P"}])


@query("filter_between_or", """
select * from lineitem where l_quantity between 10 and 12 or not (l_extendedprice between 1000 and 90000)""")
def filter_between_or(spark, sf):
    return C.filter_rows(table(spark, sf, "lineitem"), [
        {"column": "l_quantity", "operator": "between", "value": [10, 12]},
        {"column": "l_extendedprice", "operator": "not_between", "value": [1000, 90000]}], "or")


@query("filter_null_three_valued", f"""
with h as ({HOLES}) select * from h where status <> 'F'""")
def filter_null_three_valued(spark, sf):
    return C.filter_rows(holes(spark, sf), [{"column": "status", "operator": "!=", "value": "F"}])


@query("filter_temporal_literals", """
select * from orders where o_orderdate >= timestamp '1997-03-01 00:00:00'
  and o_orderdate between timestamp '1996-01-01' and timestamp '1999-12-31 12:30:00'
  and o_orderdate < to_timestamp(1000000000) at time zone 'UTC'""")
def filter_temporal_literals(spark, sf):
    return C.filter_rows(orders(spark, sf), [
        {"column": "o_orderdate", "operator": ">=", "value": "1997/03/01"},
        {"column": "o_orderdate", "operator": "between", "value": ["19960101", "1999-12-31T12:30:00"]},
        {"column": "o_orderdate", "operator": "<", "value": 1000000000}])


@query("parse_datetime_column", """
with t as (select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d')
   when 1 then strftime(o_orderdate, '%Y/%m/%d') when 2 then strftime(o_orderdate, '%Y%m%d')
   when 3 then strftime(o_orderdate, ' %Y-%m-%dT%H:%M:%S') else 'n/a' end as txt, o_orderdate from orders)
select o_orderkey, txt, case when o_orderkey % 5 < 4 then o_orderdate end as parsed from t""")
def parse_datetime_column(spark, sf):
    d = F.col("o_orderdate")
    txt = (F.when(F.expr("o_orderkey % 5 = 0"), F.date_format(d, "yyyy-MM-dd"))
           .when(F.expr("o_orderkey % 5 = 1"), F.date_format(d, "yyyy/MM/dd"))
           .when(F.expr("o_orderkey % 5 = 2"), F.date_format(d, "yyyyMMdd"))
           .when(F.expr("o_orderkey % 5 = 3"), F.date_format(d, " yyyy-MM-dd'T'HH:mm:ss"))
           .otherwise("n/a"))
    t = orders(spark, sf).select("o_orderkey", txt.alias("txt"))
    return t.withColumn("parsed", C.parse_datetime_column(F.col("txt")))


@query("filter_statistics", """
with s as (select quantile_cont(l_extendedprice,0.25) q1, quantile_cont(l_extendedprice,0.75) q3,
             avg(l_discount) m, quantile_cont(l_quantity,0.5) med from lineitem),
     o as (select l_linenumber from lineitem group by 1 order by count(*) desc, 1 limit 1)
select l_orderkey, l_partkey, l_suppkey, l_extendedprice from lineitem, s
where l_extendedprice > q1 - 1.5*(q3-q1) and l_extendedprice < q3 + 1.5*(q3-q1) and l_discount > m
  and l_quantity <= med and l_linenumber <> (select l_linenumber from o)""")
def filter_statistics(spark, sf):
    return C.filter_rows(table(spark, sf, "lineitem"), [
        {"column": "l_extendedprice", "operator": ">", "value_type": "outlier_lower"},
        {"column": "l_extendedprice", "operator": "<", "value_type": "outlier_upper"},
        {"column": "l_discount", "operator": ">", "value_type": "mean"},
        {"column": "l_quantity", "operator": "<=", "value_type": "median"},
        {"column": "l_linenumber", "operator": "!=", "value_type": "mode"}],
    ).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("filter_other_column_statistic", """
select o_orderkey from orders where o_custkey >= (select quantile_cont(o_orderkey, 0.5) / 10 * 0 + quantile_cont(o_custkey,0.5) from orders)
  and o_totalprice > (select avg(o_custkey) from orders)""")
def filter_other_column_statistic(spark, sf):
    return C.filter_rows(orders(spark, sf), [
        {"column": "o_custkey", "operator": ">=", "value_type": "median"},
        {"column": "o_totalprice", "operator": ">", "value_type": "mean", "value_column": "o_custkey"}],
    ).select("o_orderkey")


@query("column_statistics", """
with q as (select quantile_cont(l_extendedprice,0.25) q1, quantile_cont(l_extendedprice,0.75) q3,
             quantile_cont(l_extendedprice,0.5) med, avg(l_extendedprice) m from lineitem)
select 'median' as kind, round(med,4) as stat from q union all select 'mean', round(m,4) from q
union all select 'mode', cast((select l_quantity from lineitem group by 1 order by count(*) desc, 1 limit 1) as double)
union all select 'outlier_lower', round(q1-1.5*(q3-q1),4) from q
union all select 'outlier_upper', round(q3+1.5*(q3-q1),4) from q
union all select 'outlier_upper_3', round(q3+3.0*(q3-q1),4) from q""")
def column_statistics(spark, sf):
    li = table(spark, sf, "lineitem")
    out = None
    for label, col, kind, method in [
        ("median", "l_extendedprice", "median", "iqr"), ("mean", "l_extendedprice", "mean", "iqr"),
        ("mode", "l_quantity", "mode", "iqr"), ("outlier_lower", "l_extendedprice", "outlier_lower", "iqr"),
        ("outlier_upper", "l_extendedprice", "outlier_upper", "iqr"),
        ("outlier_upper_3", "l_extendedprice", "outlier_upper", "iqr_3")]:
        row = S.statistic(li, col, kind, method).select(F.lit(label).alias("kind"), F.round("stat", 4).alias("stat"))
        out = row if out is None else out.unionAll(row)
    return out


@query("exact_quantiles_distributed", """
select round(quantile_cont(l_extendedprice,0.25),4) as q0, round(quantile_cont(l_extendedprice,0.5),4) as q1,
       round(quantile_cont(l_extendedprice,0.99),4) as q2 from lineitem""")
def exact_quantiles_distributed(spark, sf):
    q = S.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.99])
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


@query("drop_nulls_any", f"with h as ({HOLES}) select * from h where status is not null and priority is not null")
def drop_nulls_any(spark, sf):
    return C.drop_nulls(holes(spark, sf), ["status", "priority"], "or")


@query("drop_nulls_all", f"with h as ({HOLES}) select * from h where status is not null or priority is not null")
def drop_nulls_all(spark, sf):
    return C.drop_nulls(holes(spark, sf), ["status", "priority"], "and")


@query("dedup_combined", f"""
with h as ({HOLES}), r as (select *, row_number() over (partition by status, priority order by o_orderkey) rn from h)
select * exclude (rn) from r where rn=1""")
def dedup_combined(spark, sf):
    return C.deduplicate(holes(spark, sf), ["status", "priority"], "and", ORDER)


@query("dedup_independent", """
with r as (select o_orderkey, o_custkey, o_totalprice,
   row_number() over (partition by o_custkey order by o_orderkey) a,
   row_number() over (partition by o_orderdate order by o_orderkey) b from orders)
select o_orderkey, o_custkey, o_totalprice from r where a=1 and b=1""")
def dedup_independent(spark, sf):
    d = C.deduplicate(orders(spark, sf), ["o_custkey", "o_orderdate"], "or", ORDER)
    return d.select("o_orderkey", "o_custkey", "o_totalprice")


@query("stage_metrics", """
with f as (select * from orders where o_orderstatus='F' and
             o_totalprice >= (select quantile_cont(o_totalprice, 0.5) from orders)),
     c as (select (select count(*) from orders) a, (select count(*) from f) b,
                  (select count(distinct o_custkey) from f) d)
select 1 as stage, 'filter' as operation, a as rows_in, b as rows_out, a-b as removed, round(b*1.0/a*100,1) as retention_pct from c
union all select 2, 'drop_nulls', b, b, 0, 100.0 from c
union all select 3, 'deduplicate', b, d, b-d, round(d*1.0/b*100,1) from c""")
def stage_metrics(spark, sf):
    return C.stage_metrics(orders(spark, sf), PIPELINE, ORDER)


@query("table_preview", """
select * from (
select 'nation' as "table", 'n_nationkey' as "column", 'int' as dtype, (select count(*) from nation) as rows, 3 as columns,
  (select string_agg(s, ', ' order by k) from (select n_nationkey k, cast(n_nationkey as string) s from nation order by 1 limit 3)) as samples
union all select 'nation', 'n_name', 'string', (select count(*) from nation), 3,
  (select string_agg(s, ', ' order by k) from (select n_nationkey k, n_name s from nation order by 1 limit 3))
union all select 'nation', 'n_regionkey', 'int', (select count(*) from nation), 3,
  (select string_agg(s, ', ' order by k) from (select n_nationkey k, cast(n_regionkey as string) s from nation order by 1 limit 3))
union all select 'documents', 'doc_id', 'bigint', (select count(*) from documents), 5,
  (select string_agg(s, ', ' order by k) from (select doc_id k, cast(doc_id as string) s from documents order by 1 limit 3))
union all select 'documents', 'text', 'string', (select count(*) from documents), 5,
  (select string_agg(s, ', ' order by k) from (select doc_id k, left(text,50) s from documents order by 1 limit 3))
union all select 'documents', 'lang', 'string', (select count(*) from documents), 5,
  (select string_agg(s, ', ' order by k) from (select doc_id k, lang s from documents order by 1 limit 3))
union all select 'documents', 'source', 'string', (select count(*) from documents), 5,
  (select string_agg(s, ', ' order by k) from (select doc_id k, source s from documents order by 1 limit 3))
union all select 'documents', 'n_chars', 'bigint', (select count(*) from documents), 5,
  (select string_agg(s, ', ' order by k) from (select doc_id k, cast(n_chars as string) s from documents order by 1 limit 3)))""")
def table_preview(spark, sf):
    tables = TS.scan_tables(spark, sf, only=["nation", "documents"])
    return TS.preview(tables)


@query("table_set_scan", """
select 'nation' as name, count(*) as n from nation union all select 'orders', count(*) from orders
union all select 'region', count(*) from region""")
def table_set_scan(spark, sf):
    tables = TS.scan_tables(spark, sf, skip=["supplier"], only=["region", "nation", "orders", "supplier"])
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("clean_table_set", """
with o as (select *, row_number() over (partition by o_orderpriority order by o_orderkey) rn from orders where o_orderstatus='O')
select 'orders' as name, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from o where rn=1
union all select 'nation', count(*), cast(sum(n_nationkey) as bigint) from nation where n_regionkey <> 2""")
def clean_table_set(spark, sf):
    config = {"sheets": {
        "orders": {"operations": [
            {"type": "filter", "conditions": [{"column": "o_orderstatus", "operator": "==", "value": "O"}]},
            {"type": "deduplicate", "columns": ["o_orderpriority"]}]},
        "nation": {"operations": [
            {"type": "filter", "conditions": [{"column": "n_regionkey", "operator": "!=", "value": 2}]}]}}}
    tables = TS.clean_tables(TS.scan_tables(spark, sf, only=["orders", "nation"]), config, {"orders": ORDER})
    rows = [tables[n].agg(F.count("*").alias("n"), F.sum(k).alias("keys")).select(F.lit(n).alias("name"), "n", "keys")
            for n, k in (("orders", "o_orderkey"), ("nation", "n_nationkey"))]
    return rows[0].unionAll(rows[1])


@query("named_operation_registry", """
select o_orderkey, o_totalprice from orders where o_orderstatus='F' and o_orderkey % 2 = 0""")
def named_operation_registry(spark, sf):
    C.register_operation("keep_even", lambda df, column: df.where(F.col(column) % 2 == 0))
    steps = [{"type": "filter", "conditions": [{"column": "o_orderstatus", "operator": "==", "value": "F"}]},
             {"type": "keep_even", "column": "o_orderkey"}]
    return C.run_operations(orders(spark, sf), steps, ORDER).select("o_orderkey", "o_totalprice")


@query("table_set_sink", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' union all select c_custkey, c_nationkey, c_acctbal from customer")
def table_set_sink(spark, sf):
    path = scratch(spark)
    TS.write_tables({"orders": table(spark, sf, "orders").where("o_orderstatus = 'F'"), "customer": table(spark, sf, "customer")}, path)
    back = TS.scan_tables(spark, path)
    orders = back["orders"].select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.unionAll(back["customer"].selectExpr("c_custkey", "cast(c_nationkey as bigint)", "c_acctbal"))
