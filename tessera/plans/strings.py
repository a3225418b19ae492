"""String and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import documents, text
from tessera.operators import aliases, dictionary
from tessera.registry import query
from tessera.tables import table

#: Pieces of text that exercise the functions; each part's names get one of them.
PIECES = [
    "  Ab-C_d (x)　1×2 ", "■ Model：A, B；C", "□未选 ☑已选", "Ａ１２ 毫米/每小时", "100 kg/hour", "KG/每小时", "kg以下/每小时", "KW以内", "°", "°C", "转可调/每分钟", "m³／h", "米", "", "Zhang--San__Li", "a/b|c,d;e  f", "cm² * 3—4",
    "x\x01y", "x\x01y\x02z", "plain", "a||b", "reply ```json\n{\"a\": {\"b\": 1}}\n``` end", "{\"id\": 12345678901234567890, \"n\": 5}", "☑PE □PP [✓] ABS", "hello world & co", "A B  C A b",
]


def _quoted(s: str) -> str:
    out = s.replace("'", "''")
    for c in "\x01\x02\n":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{out}')"


_PIECE = f"[{', '.join(map(_quoted, PIECES))}][p_partkey % {len(PIECES)} + 1]"
S = f"s as (select doc_id as i, text as t from documents union all select -1 - p_partkey, case when p_partkey % 3 = 0 then {_PIECE} else p_name || {_PIECE} || p_type end from part)"
SQL_SPACE = "[\\s\\x{FEFF}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, t): the texts of documents, and the names of parts around a piece, or the piece alone."""
    piece = F.element_at(F.array(*map(F.lit, PIECES)), (F.col("p_partkey") % len(PIECES) + 1).cast("int"))
    names = F.when(F.col("p_partkey") % 3 == 0, piece).otherwise(F.concat("p_name", piece, "p_type"))
    parts = table(spark, sf_dir, "part").select((F.lit(-1) - F.col("p_partkey")).cast("long").alias("i"), names.alias("t"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).unionByName(parts)


def _chain(start: str, *pairs: tuple[str, str]) -> str:
    """Nested regexp_replace calls."""
    for pattern, to in pairs:
        start = f"regexp_replace({start}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return start


TRIMMED = _chain("t", (f"^{SQL_SPACE}+", ""), (f"{SQL_SPACE}+$", ""))
NORMAL = _chain(f"lower({TRIMMED})", ("×", "x"), ("[■□☑✔✓]", ""), (f"{SQL_SPACE}+", ""), ("[()（）\\[\\]【】\\-_：:;；,，、\"“”']", ""))


@query(f"with {S} select i, {NORMAL} as v from s")
def str_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.normalize(F.col("t")).alias("v"))


@query(f"with {S} select i, lower({_chain('trim(t)', ('[■□☑✔✓]', ''), (chr(92) + 's+', ''), ('[()（）' + chr(92) + '[' + chr(92) + ']【】_-]', ''))}) as v from s")
def str_normalize_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.normalize_narrow(F.col("t")).alias("v"))


@query(f"with {S} select i, {_chain(f'lower({TRIMMED})', (f'{SQL_SPACE}+', ''), ('[._' + chr(92) + '-/' + chr(92) * 2 + '|,;:()' + chr(92) + '[' + chr(92) + ']{}<>]', ''))} as v from s")
def str_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.model_key(F.col("t")).alias("v"))


_ATTR = _chain(f"translate(lower({TRIMMED}), '０１２３４５６７８９', '0123456789')", *text.ATTRIBUTE_SPELLINGS, (f"{SQL_SPACE}+", ""), ("[()（）\\[\\]{}<>]", ""))


@query(f"with {S} select i, {_ATTR} as v from s")
def str_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.attribute_key(F.col("t")).alias("v"))


_UNIT = f"lower({_chain(TRIMMED, *text.UNIT_SPELLINGS, (f'{SQL_SPACE}+', ''))})"


@query(f"with {S}, u as (select i, {_UNIT} as u from s) select i, case when u = '米' then 'm' when u in ('°', '°c') then '℃' else u end as v from u")
def str_unit_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.unit_key(F.col("t")).alias("v"))


@query("select p_partkey, case when length(p_name) > 0 and length(p_type) > 0 then cast(greatest(length(p_name), length(p_type)) - levenshtein(p_name, p_type) as double) / greatest(length(p_name), length(p_type)) else 0.0 end as v from part")
def str_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.similarity(F.col("p_name"), F.col("p_type")).alias("v"))


@query(f"with {S} select i, coalesce(nullif({_chain(f'lower({TRIMMED})', ('[^a-z0-9]+', '_'), ('^_+', ''), ('_+$', ''))}, ''), 'custom') as v from s")
def str_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.slug(F.col("t"), "custom").alias("v"))


_PART_NORMAL = NORMAL.replace("(t,", "(p,")


@query(f"""with {S}, p as (select i, k, {NORMAL.replace('(t,', '(p,')} as v from (select i, unnest(regexp_split_to_array({_chain(TRIMMED, ('[,，、;；/|+' + chr(92) + 'n]', ' '))}, '{SQL_SPACE}+')) as p, unnest(range(0, len(regexp_split_to_array({_chain(TRIMMED, ('[,，、;；/|+' + chr(92) + 'n]', ' '))}, '{SQL_SPACE}+')))) as k from s)),
f as (select i, v, min(k) as k from p where v <> '' group by i, v) select i, string_agg(v, ' ' order by k) as v from f group by i""")
def str_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", F.array_join(text.tokens(F.col("t")), " ").alias("v")).where("v <> ''")


@query("""with a as (select distinct split_part(p_name, ' ', 1) as alias from part where p_size % 3 <> 0 and length(split_part(p_name, ' ', 1)) <> 4 union select distinct substr(p_name, 1, 2) from part),
v as (select p_partkey, case when p_partkey % 5 = 0 then substr(p_name, 1, 2) || '板' when p_partkey % 7 = 0 then split_part(p_name, ' ', 1) else replace(p_name, ' ', '') end as v from part),
l as (select p_partkey, v, max(length(alias)) as n from v left join a on starts_with(v, alias) group by all), s as (select p_partkey, v, case when n = length(v) or n >= 3 or contains(substr(v, n + 1), '板') then n end as n from l)
select p_partkey, substr(v, 1, n) as alias, nullif(substr(v, n + 1), '') as suffix, case when n is null then null when n = length(v) then 1.0::double else 0.9::double end as confidence from s""")
def str_prefix_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias that a value begins with, and the rest; short ones only before a rest with Chinese characters."""
    p, first, two = table(spark, sf_dir, "part"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.substring("p_name", 1, 2)
    known = p.where((F.col("p_size") % 3 != 0) & (F.length(first) != 4)).select(first.alias("a")).union(p.select(two.alias("a"))).distinct()
    value = F.when(F.col("p_partkey") % 5 == 0, F.concat(two, F.lit("板"))).when(F.col("p_partkey") % 7 == 0, first).otherwise(F.translate("p_name", " ", ""))
    return aliases.longest_prefixes(p.select("p_partkey", value.alias("v")), known, "v", "a").select("p_partkey", "alias", "suffix", "confidence")


@query("""with a as (select distinct 'position' as kind, split_part(p_name, ' ', 1) as key, length(split_part(p_name, ' ', 1)) * 3 % 7 as sort_order from part where p_size % 2 = 0
union select distinct 'area', split_part(p_name, ' ', 2), 1 from part union select distinct 'layer', p_type, 1 from part union select 'position', 'inner', 0 union select 'area', 'n o', 0),
t as (select p_partkey as id, 0 as place, case p_partkey % 3 when 0 then 'no text' else split_part(p_name, ' ', 2) end as text from part where p_partkey % 2 = 0 union all select p_partkey, 1, p_name || ' ' || p_type from part),
h as (select id, place, kind, key, row_number() over (partition by id, place, kind order by length(replace(key, ' ', '')) desc, sort_order, key) as r from t join a on contains(replace(lower(text), ' ', ''), replace(lower(key), ' ', ''))),
f as (select id, min(place) as place from h group by id)
select h.id as p_partkey, cast(h.place as integer) as place, kind, key from h join f on f.id = h.id and f.place = h.place where r = 1""")
def str_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, area and layer of parts by the longest alias in the first of two texts that has any; the qualifiers are words of the table."""
    p = table(spark, sf_dir, "part")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    of = lambda df, kind, key, order: df.select(F.lit(kind).alias("kind"), key.alias("key"), order.cast("int").alias("sort_order"))
    rows = of(p.where("p_size % 2 = 0"), "position", word(1), F.length(word(1)) * 3 % 7).union(of(p, "area", word(2), F.lit(1))).union(of(p, "layer", F.col("p_type"), F.lit(1))).union(spark.createDataFrame([("position", "inner", 0), ("area", "n o", 0)], "kind string, key string, sort_order int"))
    rows = rows.distinct().select("*", F.col("key").alias("name"), F.array("key").alias("aliases"), F.lit(None).cast("int").alias("specificity"))
    first = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(0).alias("place"), F.when(F.col("p_partkey") % 3 == 0, "no text").otherwise(word(2)).alias("text"))
    texts = first.union(p.select("p_partkey", F.lit(1), F.concat_ws(" ", "p_name", "p_type")))
    return dictionary.qualifiers(texts, rows).select(F.col("id").alias("p_partkey"), "place", "kind", "key")


_UNSAFE = "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


@query(f"with {S} select i, case when len(regexp_extract_all(t, '{_UNSAFE}')) >= 2 then '' else regexp_replace(t, '{_UNSAFE}', '', 'g') end as v from s")
def str_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.sanitize(F.col("t")).alias("v"))


_MARKED = _chain("t", (f"[\\[(（]\\s*[{text.SELECTED}]\\s*[\\])）]", "[SEL]"), (f"[\\[(（]\\s*[{text.UNSELECTED}]\\s*[\\])）]", "[ ]"), (f"[{text.SELECTED}]", "[SEL]"), (f"[{text.UNSELECTED}]", "[ ]"))
_LABEL = _chain("substr(o, case when starts_with(o, '[SEL]') then 6 else 4 end)", (f"^{SQL_SPACE}+", ""), (f"{SQL_SPACE}+$", ""))


@query(f"with {S}, o as (select i, unnest(regexp_extract_all({_MARKED}, '\\[(?:SEL| )\\][^\\[]*')) as o from s) select i, starts_with(o, '[SEL]') as selected, {_LABEL} as label from o where {_LABEL} <> ''")
def str_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", F.explode(text.options(F.col("t"))).alias("o")).select("i", "o.selected", "o.label")


@query(f"with {S} select i, coalesce(nullif(regexp_extract(coalesce(nullif(regexp_extract(t, '(?is)```(?:json)?\\s*(.*?)```', 1), ''), {TRIMMED}), '(?s)(\\{{.*\\}})', 1), ''), coalesce(nullif(regexp_extract(t, '(?is)```(?:json)?\\s*(.*?)```', 1), ''), {TRIMMED})) as v from s")
def str_json_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.fenced_json(F.col("t")).alias("v"))


@query("""with p as (select p_partkey, p_size as a, p_partkey % 17 as b, case when p_partkey % 3 = 0 then greatest(0, 100 - p_size - p_partkey % 17) else p_partkey % 5 + 1 end as c from part), q as (select *, a + b + c as total from p)
select p_partkey, case when total = 100 then a || ',' || b || ',' || c else array_to_string([cast(floor(x::double / total * 100 + 0.5) as integer) for x in [a, b, c]], ',') end as v from q""")
def str_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size"), F.col("p_partkey") % 17
    c = F.when(F.col("p_partkey") % 3 == 0, F.greatest(F.lit(0), 100 - a - b)).otherwise(F.col("p_partkey") % 5 + 1)
    ratios = F.concat_ws(" : ", a.cast("string"), b.cast("string"), c.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.ratio(ratios).cast("array<string>"), ",").alias("v"))


@query("select p_partkey, replace(url_encode(p_name), '+', '%20') || ':' || replace(url_encode(p_type), '+', '%20') || ':' as v from part")
def str_cluster_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.cluster_id(F.col("p_name"), F.col("p_type"), F.lit(None)).alias("v"))


@query(f"with {S} select i, replace(t, '||', '|') || '||' || 'dictionary' || '||' as v from s")
def str_pattern_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.pattern_key(F.col("t"), F.lit("dictionary"), F.lit(None)).alias("v"))


@query(f"with {S} select i, regexp_replace(t, '(:\\s*)([0-9]{{16,}})(\\s*[,}}])', '\\1\"\\2\"\\3', 'g') as v from s")
def str_big_int_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("i", text.quoted_big_integers(F.col("t")).alias("v"))


@query("select n_nationkey, concat_ws('/', nullif(r_name, 'ASIA'), nullif(n_name, '')) as v from nation join region on n_regionkey = r_regionkey")
def str_path_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", text.levels(F.nullif("r_name", F.lit("ASIA")), F.col("n_name")).alias("v"))


@query("select doc_id, sha256(text) as v from documents")
def str_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("v"))


@query("""select l_orderkey, l_linenumber, '{"a":{"flag":"' || l_returnflag || '","n":' || l_linenumber || '},"z":[' || l_linenumber || ',null]}' as v from lineitem""")
def str_stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON with sorted keys, whatever their order in the source."""
    source = F.format_string('{"z": [%d, null], "a": {"n": %d, "flag": "%s"}}', "l_linenumber", "l_linenumber", "l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", documents.stable_json(source).alias("v"))
