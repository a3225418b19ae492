"""Numbers, units and domain parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.registry import query
from tessera.tables import table

def _texts(spark: SparkSession, sf_dir: str, *made: Column) -> DataFrame:
    """(p_partkey, t): for each part one of several texts made of its columns, in turn."""
    k = F.pmod("p_partkey", F.lit(len(made)))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*made), (k + 1).cast("int")).alias("t"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""select p_partkey, case k when 3 then 'none' when 1 then 'range' else 'single' end as kind, case when k <> 3 then cast(p_size as varchar) end as first, case k when 1 then (p_size + p_partkey % 7) || '.5' end as second,
case k when 0 then 'MM' when 1 then 'kg/h' when 2 then 'kW' when 4 then 'rpm' end as unit, case k when 2 then p_brand when 4 then 'left' end as rest from (select *, p_partkey % 5 as k from part)""")
def num_unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, more = F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 7
    given = _texts(spark, sf_dir, _text(size, "MM"), _text(size, "-", more, ".5 kg/h"), _text(" ", size, " kW (", F.col("p_brand"), ")"), F.col("p_name"), _text(size, " rpm left"))
    return given.withColumn("p", numbers.number_unit(F.col("t"), ["mm", "m", "kg/h", "kg", "kW"])).select("p_partkey", "p.kind", "p.first", "p.second", "p.unit", F.col("p.trailing").alias("rest"))


@query("select l_orderkey, l_linenumber, least(l_quantity, cast(l_partkey % 40 as double)) as low, greatest(l_quantity, cast(l_partkey % 40 as double)) as high from lineitem")
def num_range_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = numbers.range_bounds(F.col("l_quantity").cast("string"), (F.col("l_partkey") % 40).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"))


@query("""select p_partkey, case when k in (0, 1) then (p_size * 10) || 'V' end as voltage, case when k in (0, 2) then (50 + p_partkey % 2 * 10) || 'Hz' end as frequency, case when k = 0 then '三相' when k = 1 then '单相' end as phase from (select *, p_partkey % 4 as k from part)""")
def num_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = F.col("p_size") * 10, F.col("p_partkey") % 2 * 10 + 50
    given = _texts(spark, sf_dir, _text(v, "V ", f, "hz 三 相"), _text(v, " 伏 1相"), _text(f, "赫兹"), F.col("p_type"))
    return given.withColumn("p", numbers.voltage(F.col("t"))).select("p_partkey", "p.*")


@query("""select p_partkey, case k when 2 then 'A' end as grade, case k when 0 then 'um' when 1 then 'μm' end as unit, case k when 0 then p_size / 10.0::double end as low, case k when 0 then (p_size + 5) / 10.0::double end as high, case k when 1 then '<=' when 3 then '>=' end as bound,
case when k in (1, 2, 3) then p_size / 10.0::double end as value from (select *, p_partkey % 5 as k from part)""")
def num_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenths = lambda c: F.format_string("%d.%d", F.floor(c / 10).cast("int"), (c % 10).cast("int"))
    low, high = tenths(F.col("p_size")), tenths(F.col("p_size") + 5)
    given = _texts(spark, sf_dir, _text("Ra", low, "-", high, "um"), _text("≤", low, " μm"), _text("A级 Ra ", low), _text("不小于 Ra", low), F.lit("光滑"))
    return given.withColumn("p", numbers.roughness(F.col("t"))).select("p_partkey", "p.*")


@query("""with k as (select *, p_partkey % 4 as k, 11 + p_partkey % 9 as n from part), i as (select p_partkey, case k when 0 then '温区' when 1 then '模头' when 2 then '段' else nullif(regexp_extract(replace(p_brand, ' ', ''), '^(.+?)[1-9][0-9]*$', 1), '') end as base,
case when k < 2 then n when k = 2 then p_size else try_cast(nullif(regexp_extract(replace(p_brand, ' ', ''), '^.+?([1-9][0-9]*)$', 1), '') as bigint) end as number from k) select p_partkey, base, cast(number as bigint) as number from i""")
def num_index_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 9 + 1
    wide = F.translate((n + 10).cast("string"), numbers.ASCII_DIGITS, numbers.WIDE_DIGITS)
    teens = F.concat(F.lit(numbers.TEN), F.element_at(F.array(*map(F.lit, numbers.DIGITS)), n.cast("int")))
    given = _texts(spark, sf_dir, _text("温区 ", wide), _text("模头", teens), _text("段", F.col("p_size")), F.col("p_brand"))
    return given.withColumn("p", numbers.index_suffix(F.col("t"))).select("p_partkey", "p.*")


PAIRED = """with f as (select l_orderkey, case l_returnflag when 'A' then 'low' when 'R' then 'high' end as role, l_quantity, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_quantity) as r from lineitem)
select l_orderkey, max(l_quantity) filter (where role = 'low') as low, max(l_quantity) filter (where role = 'high') as high from f where r = 1 and role is not null group by l_orderkey having low is not null and high is not null"""


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "R", "high")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", role.alias("role"), "l_quantity", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("o"))


@query(PAIRED)
def num_range_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.first_pair(_roles(spark, sf_dir), ["l_orderkey"], "role", "l_quantity", "o", ("low", "high"))


@query(f"select l_orderkey, low || ' ' || cast(high as integer) || 'mm' as v from ({PAIRED})".replace("low || ", "cast(low as integer) || "))
def num_unit_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value field and a unit field of one item as one text."""
    pairs = numbers.first_pair(_roles(spark, sf_dir), ["l_orderkey"], "role", "l_quantity", "o", ("low", "high"))
    return pairs.select("l_orderkey", F.concat(F.col("low").cast("int"), F.lit(" "), F.col("high").cast("int"), F.lit("mm")).alias("v"))


@query("select p_partkey, case p_partkey % 6 when 0 then 'unselected' when 1 then 'selected' when 2 then 'selected' when 3 then 'unselected' when 4 then 'selected' end as state from part")
def num_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    given = _texts(spark, sf_dir, _text(name, "(未选 中)"), _text(name, " [ SEL ]"), _text(name, "（选中）"), _text("未【selected】", name), _text(name, "[sel]"), name)
    return given.select("p_partkey", numbers.selection(F.col("t")).alias("state"))


@query("select l_orderkey, l_linenumber, l_partkey, cast(round(greatest(0, least(1, cast(l_discount as decimal(10,4)) * 12 - 0.1)), 3) as double) as score from lineitem")
def num_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = numbers.clamped(F.col("l_discount").cast("decimal(10,4)") * 12 - F.lit("0.1").cast("decimal(2,1)"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.cast("double").alias("score"))


@query("select l_orderkey, l_linenumber, cast(ceil(l_quantity / 7) * 15 as double) as price from lineitem")
def num_step_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.step_price(F.col("l_quantity"), F.lit(7), F.lit(15)).cast("double").alias("price"))
