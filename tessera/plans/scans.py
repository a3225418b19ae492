"""Scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.operators.scans import by_keys, cursor_pages, since
from tessera.registry import query
from tessera.session import shared_folder
from tessera.sources import sheets
from tessera.sources.cursor import CursorSource
from tessera.sources.versions import Versioned
from tessera.tables import table


@query("select * from orders")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("select c_custkey, c_name from customer")
def scan_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name")


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def scan_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return by_keys(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", keys)


@query("""select c_custkey, cast(r.id as bigint) as id, r.name, n.n_regionkey from (select c_custkey, unnest([{'id': c_nationkey, 'name': c_name}, {'id': c_custkey % 40, 'name': null}, {'id': 3, 'name': c_mktsegment}]) as r from customer)
left join nation n on n.n_nationkey = r.id""")
def scan_recordset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of records, one a customer, as typed rows that join others."""
    records = F.format_string('[{"id": %d, "name": "%s"}, {"id": %d}, {"id": 3, "name": "%s"}]', "c_nationkey", "c_name", F.col("c_custkey") % 40, "c_mktsegment")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.from_json(records, "array<struct<id:bigint,name:string>>")).alias("r")).select("c_custkey", "r.*")
    return rows.join(table(spark, sf_dir, "nation"), F.col("id") == F.col("n_nationkey"), "left").select("c_custkey", "id", "name", "n_regionkey")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as name, unnest([p_size, p_size + 1]) as id from part where len(string_split(p_name, ' ')) = 2 union all select p_partkey, unnest(string_split(p_name, ' ')), null from part where len(string_split(p_name, ' ')) <> 2")
def scan_unnest_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays side by side as rows."""
    words = F.split("p_name", " ")
    sizes = F.when(F.size(words) == 2, F.array("p_size", F.col("p_size") + 1))
    zipped = F.transform(words, lambda w, i: F.struct(w.alias("name"), F.get(sizes, i).alias("id")))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(zipped))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells: a workbook for each segment, five sheets in each, a row for each customer, three columns."""
    n = table(spark, sf_dir, "customer")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("text")) for i, c in enumerate(("c_name", "c_custkey", "c_nationkey"), 1)]))
    return n.select(F.col("c_mktsegment").alias("workbook"), F.concat(F.lit("sheet"), (F.col("c_nationkey") % 5).cast("string")).alias("sheet"), F.col("c_custkey").cast("int").alias("row"), cells.alias("c")).select("workbook", "sheet", "row", "c.col", "c.text")


CELLS = """cells as (select c_mktsegment as workbook, 'sheet' || (c_nationkey % 5) as sheet, cast(c_custkey as integer) as row, c.col, c.text
from customer, unnest([{'col': 1, 'text': c_name}, {'col': 2, 'text': cast(c_custkey as varchar)}, {'col': 3, 'text': cast(c_nationkey as varchar)}]) u(c))"""


@query(f"with {CELLS} select sheet, row, string_agg(text, ' | ' order by col) as text, count(*) as cells from cells group by sheet, row")
def scan_excel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.row_blocks(_cells(spark, sf_dir))


MERGES = [("sheet1", 0, 4, 1, 2), ("sheet2", 8, 12, 1, 1), ("sheet2", 9, 18, 2, 3)]
MERGE_ROWS = ", ".join(f"('{s}', {a}, {b}, {c}, {d})" for s, a, b, c, d in MERGES)


def _merges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MERGES, "sheet string, row0 int, row1 int, col0 int, col1 int")


@query(f"""with {CELLS}, m(sheet, row0, row1, col0, col1) as (values {MERGE_ROWS})
select c.sheet, c.row, c.col, c.text, m.row0, m.row1 from cells c left join m on c.sheet = m.sheet and c.row between m.row0 and m.row1 and c.col between m.col0 and m.col1""")
def scan_merge_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.with_merges(_cells(spark, sf_dir), _merges(spark)).select("sheet", "row", "col", "text", "row0", "row1")


@query(f"""with {CELLS}, m(sheet, row0, row1, col0, col1) as (values {MERGE_ROWS}),
l as (select m.sheet, unnest(generate_series(m.row0, m.row1)) as row, m.row0, m.sheet || ':' || m.row0 as label from m where col0 = 1),
k as (select sheet, row, arg_max(label, row0) as label from l group by sheet, row)
select distinct c.sheet, c.row, k.label from cells c left join k on k.sheet = c.sheet and k.row = c.row""")
def scan_fill_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _merges(spark).withColumn("label", F.concat_ws(":", "sheet", "row0"))
    return sheets.fill_merged(_cells(spark, sf_dir).select("sheet", "row").distinct(), labels)


@query(f"with {CELLS}, r as (select sheet, row, string_agg(text, ' | ' order by col) as text from cells group by sheet, row) select sheet, string_agg(text, chr(10) order by row) as text from r group by sheet")
def scan_render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.render(sheets.row_blocks(_cells(spark, sf_dir)))


@query(f"with {CELLS} select workbook, sheet, row, col, text from cells")
def scan_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as workbooks and read back from the shared folder."""
    return sheets.read_cells(spark, sheets.write_workbooks(_cells(spark, sf_dir), "workbook"))


@query(f"with {CELLS} select workbook, sheet, count(*) as cells, max(row) as last_row from cells group by workbook, sheet")
def sink_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = sheets.read_cells(spark, sheets.write_workbooks(_cells(spark, sf_dir), "workbook"))
    return back.groupBy("workbook", "sheet").agg(F.count(F.lit(1)).alias("cells"), F.max("row").alias("last_row"))


@query("select c_custkey, c_name, cast((row_number() over (order by c_custkey) - 1) // 100 as integer) as page from customer")
def scan_rest_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at most 100 rows after the last id, until a short one; the remote side is a folder of page files, made of a table."""
    base = f"{shared_folder(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    paged = cursor_pages(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey", 100)
    firsts = paged.withColumn("first", F.min("c_custkey").over(Window.partitionBy("page"))).drop("page")
    firsts.repartition("first").write.partitionBy("first").json(f"{base}/customers")
    spark.dataSource.register(CursorSource)
    read = spark.read.format("cursor_pages").schema("c_custkey long, c_name string, _page int").option("base", base if "://" in base else f"file://{base.removeprefix('file:')}")
    return read.option("key", "c_custkey").option("forms", "customers").load().withColumnRenamed("_page", "page")


@query("select o_orderkey, o_orderdate from orders where o_orderdate > (select max(o_orderdate) from orders where o_orderkey % 10 = 0 and o_orderdate < timestamp '1997-01-01')")
def scan_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    logged = o.where("o_orderkey % 10 = 0 and o_orderdate < timestamp_ntz '1997-01-01'")
    return since(o, "o_orderdate", logged.agg(F.max("o_orderdate").alias("start")))


@query("select event_id, ts from events where ts > (select max(ts) - interval 1 day from events)")
def scan_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts")
    return since(e, "ts", e.agg((F.max("ts") - F.expr("interval 1 day")).alias("start")))


OLD = "old as (select c_custkey, c_name, c_mktsegment from customer where c_custkey % 3 <> 0)"
NEW = "new as (select c_custkey, c_name, case when c_custkey % 2 = 0 then 'MOVED' else c_mktsegment end as c_mktsegment from customer where c_custkey % 5 = 0)"


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").where("c_custkey % 3 <> 0")


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").where("c_custkey % 5 = 0")
    return c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "MOVED").otherwise(F.col("c_mktsegment")))


@query(f"with {OLD}, {NEW} select * from new union all select * from old where c_custkey not in (select c_custkey from new)")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a table of 16 buckets: the write is published whole, and the table read back."""
    return _published(spark, sf_dir, None)


def _published(spark: SparkSession, sf_dir: str, guard) -> DataFrame:
    t = Versioned(spark, f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}", ["c_custkey"], buckets=16)
    t.create(_old(spark, sf_dir))
    t.upsert(_new(spark, sf_dir), guard)
    return t.read()


@query(f"""with {OLD}, {NEW} select o.c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_mktsegment, o.c_mktsegment) as c_mktsegment, n.c_custkey is not null and n.c_mktsegment is distinct from o.c_mktsegment as changed
from old o left join new n using (c_custkey) union all select n.*, true from new n where c_custkey not in (select c_custkey from old)""")
def sink_upsert_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old(spark, sf_dir).withColumn("changed", F.lit(False)), _new(spark, sf_dir).withColumn("changed", F.lit(True))
    return dml.upsert(old, new, ["c_custkey"], guard=dml.differs(["c_name", "c_mktsegment"]))


@query(f"""with {OLD}, {NEW} select o.c_custkey, o.c_name, case when n.c_custkey is not null and o.c_mktsegment <> 'BUILDING' then n.c_mktsegment else o.c_mktsegment end as c_mktsegment
from old o left join new n using (c_custkey) union all select * from new where c_custkey not in (select c_custkey from old)""")
def sink_upsert_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, lambda: F.col("t.c_mktsegment") != "BUILDING")


@query(f"with {OLD}, {NEW} select * from old union all select * from new where c_custkey not in (select c_custkey from old)")
def sink_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.insert_ignore(_old(spark, sf_dir), _new(spark, sf_dir), ["c_custkey"])


@query(f"with {OLD}, {NEW} select o.c_custkey, o.c_name, coalesce(n.c_mktsegment, o.c_mktsegment) as c_mktsegment from old o left join new n using (c_custkey)")
def sink_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.update_from(_old(spark, sf_dir), _new(spark, sf_dir), ["c_custkey"], ["c_mktsegment"])


@query("select c_custkey, case c_custkey when 1 then 'A' when 5 then 'B' when 9 then 'C' else c_mktsegment end as c_mktsegment from customer")
def sink_case_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(1, "A"), (5, "B"), (9, "C")], "c_custkey bigint, c_mktsegment string")
    return dml.update_from(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), mapping, ["c_custkey"], ["c_mktsegment"])


@query("select p_partkey, p_size + (select count(*) from lineitem where l_partkey = p_partkey) as usage_count from part")
def sink_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("usage_count"))
    return dml.add_counts(parts, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "usage_count")


@query("select l_orderkey, l_linenumber from lineitem l where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def sink_delete_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.delete_stale(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), keep, ["l_orderkey"])


@query("select 'books' || s_suppkey % 7 as workbook, s_name as shape, cast(s_suppkey + 1 as integer) as row, cast(s_nationkey + 1 as integer) as col, case when s_suppkey % 3 = 0 then s_name else s_name || chr(10) || 'of ' || s_nationkey end as paragraphs from supplier")
def scan_textbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shapes of workbooks, written and read back."""
    s = table(spark, sf_dir, "supplier")
    lines = F.when(F.col("s_suppkey") % 3 == 0, F.array("s_name", F.lit(" "))).otherwise(F.array(F.col("s_name"), F.concat(F.lit("of "), F.col("s_nationkey").cast("string"))))
    book = F.concat(F.lit("books"), (F.col("s_suppkey") % 7).cast("string")).alias("workbook")
    shapes = s.select(book, F.col("s_name").alias("shape"), (F.col("s_suppkey") + 1).cast("int").alias("row"), (F.col("s_nationkey") + 1).cast("int").alias("col"), lines.alias("lines"))
    cells = s.select(book, F.lit("all").alias("sheet"), (F.col("s_suppkey") + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.col("s_name").alias("text"))
    return sheets.read_textboxes(spark, sheets.write_workbooks(cells, "workbook", shapes)).select("workbook", "shape", "row", "col", "paragraphs")
