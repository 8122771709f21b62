"""Queries over the sample tables, one or more for each operator, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import TagFrame
from .sources.tagger import tag, tag_parquet

#: Tagspecs of the sample tables' columns.
TAGS = {
    "region": {"r_regionkey": "#region+code", "r_name": "#region+name"},
    "nation": {"n_nationkey": "#country+code", "n_name": "#country+name", "n_regionkey": "#region+code"},
    "customer": {"c_custkey": "#contact+id", "c_name": "#contact+name", "c_nationkey": "#country+code", "c_acctbal": "#value+balance", "c_mktsegment": "#sector"},
    "supplier": {"s_suppkey": "#org+id", "s_name": "#org+name", "s_nationkey": "#country+code", "s_acctbal": "#value+balance"},
    "part": {"p_partkey": "#item+id", "p_name": "#item+name", "p_brand": "#item+brand", "p_type": "#item+type", "p_size": "#size", "p_retailprice": "#value+price"},
    "orders": {"o_orderkey": "#meta+id", "o_custkey": "#contact+id", "o_orderstatus": "#status", "o_totalprice": "#value", "o_orderdate": "#date", "o_orderpriority": "#priority"},
    "lineitem": {
        "l_orderkey": "#meta+id+order", "l_partkey": "#item+id", "l_suppkey": "#org+id", "l_linenumber": "#meta+line", "l_quantity": "#quantity", "l_extendedprice": "#value+price",
        "l_discount": "#discount", "l_tax": "#tax", "l_returnflag": "#status+return", "l_linestatus": "#status+line", "l_shipdate": "#date+ship",
    },
    "events": {"event_id": "#meta+id", "ts": "#date", "user_id": "#contact+id", "event_type": "#event+type", "value": "#value", "props": "#meta+json"},
    "documents": {"doc_id": "#meta+id", "text": "#content", "lang": "#meta+lang", "source": "#org+source", "n_chars": "#indicator+num"},
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> TagFrame:
    return tag_parquet(spark, f"{sf_dir}/{name}.parquet", TAGS[name])


def query(table: str, sql: str | None):
    """Register a function of the table's frame under its name."""

    def register(function):
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(read(spark, sf_dir, table), spark, sf_dir)
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("orders", "SELECT * FROM orders WHERE lower(o_orderstatus)='f'")
def with_rows_eq(f, *_):
    return f.with_rows("#status=F").to_df()


@query("lineitem", "SELECT l_orderkey,l_linenumber,l_quantity FROM lineitem WHERE l_quantity>=45")
def with_rows_num(f, *_):
    return f.with_rows("#quantity>=45").with_columns("#meta+order,#meta+line,#quantity").to_df()


@query("orders", "SELECT o_orderkey,strftime(o_orderdate,'%Y-%m-%d') AS order_date FROM orders WHERE CAST(o_orderdate AS DATE)>=DATE '1998-01-01'")
def with_rows_date(f, *_):
    return f.with_rows("#date>=1998-01-01").with_columns("#meta+id,#date").to_df("o_orderkey", "order_date").withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("customer", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment)='building' OR c_acctbal>9000")
def with_rows_or(f, *_):
    return f.with_rows(["#sector=BUILDING", "#value+balance>9000"]).with_columns("#contact+id").to_df()


@query("orders", "SELECT o_orderkey FROM orders WHERE NOT (lower(o_orderpriority)='5-low') OR lower(o_orderstatus)='f'")
def with_rows_mask(f, *_):
    return f.with_rows("#status=F", mask="#priority=5-LOW").with_columns("#meta+id").to_df()


@query("orders", "SELECT o_orderkey FROM orders WHERE NOT (lower(o_orderstatus)='f')")
def without_rows(f, *_):
    return f.without_rows("#status=F").with_columns("#meta+id").to_df()


@query("part", "SELECT p_partkey,p_name FROM part WHERE lower(p_name) LIKE 'red%'")
def with_rows_regex(f, *_):
    return f.with_rows("#item+name~^red").with_columns("#item+id,#item+name").to_df()


@query("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice=(SELECT max(o_totalprice) FROM orders)")
def with_rows_is_max(f, *_):
    return f.with_rows("#value is max").with_columns("#meta+id").to_df()


@query("part", "SELECT p_partkey FROM part WHERE p_size<>(SELECT min(p_size) FROM part)")
def with_rows_not_min(f, *_):
    return f.with_rows("#size is not min").with_columns("#item+id").to_df()


@query("documents", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text)<>''")
def with_rows_is_empty(f, *_):
    return f.with_rows("#content is not empty").with_columns("#meta+id").to_df()


@query("lineitem", "SELECT l_orderkey,l_linenumber FROM lineitem WHERE l_quantity>l_tax*500")
def with_rows_formula(f, *_):
    return f.with_rows("#quantity > {{#tax * 500}}").with_columns("#meta+order,#meta+line").to_df()


@query("customer", "SELECT c_custkey,c_mktsegment FROM customer")
def columns_include(f, *_):
    return f.with_columns("#contact+id,#sector").to_df()


@query("customer", "SELECT c_custkey,c_nationkey,c_acctbal,c_mktsegment FROM customer")
def columns_exclude(f, *_):
    return f.without_columns("#contact+name").to_df()


@query("region", "SELECT r_regionkey,r_name,'TPCH' AS src FROM region")
def add_columns_const(f, *_):
    return f.add_columns("src#meta+source=TPCH").to_df()


@query("part", "SELECT p_partkey,CAST(p_size*2 AS VARCHAR) AS size2 FROM part")
def add_columns_formula(f, *_):
    return f.add_columns("size2#size+double={{#size * 2}}").with_columns("#item+id,#size+double").to_df()


@query("nation", "SELECT n_nationkey AS id,n_name AS country,n_regionkey FROM nation")
def rename_columns(f, *_):
    return f.rename_columns(["#country+code:id#meta+id", "#country+name:country#country"]).to_df()


@query("orders", "SELECT o_orderstatus,count(*) AS n FROM orders GROUP BY 1")
def count_by(f, *_):
    return f.count("#status", "count() as n#meta+count").to_df()


@query("lineitem", "SELECT l_returnflag,l_linestatus,sum(l_quantity) AS qty FROM lineitem GROUP BY 1,2")
def count_sum(f, *_):
    return f.count("#status+return,#status+line", "sum(#quantity) as qty#quantity+sum").to_df()


@query("lineitem", "SELECT l_returnflag,avg(l_quantity) AS avg_qty FROM lineitem GROUP BY 1")
def count_avg(f, *_):
    return f.count("#status+return", "average(#quantity) as avg_qty#quantity+avg").to_df()


@query("orders", "SELECT o_orderpriority,min(o_totalprice) AS lo,max(o_totalprice) AS hi FROM orders GROUP BY 1")
def count_minmax(f, *_):
    return f.count("#priority", ["min(#value) as lo#value+min", "max(#value) as hi#value+max"]).to_df()


@query("orders", "SELECT o_orderpriority,string_agg(DISTINCT o_orderstatus,'|' ORDER BY o_orderstatus) AS st FROM orders GROUP BY 1")
def count_concat(f, *_):
    return f.count("#priority", "concat(#status) as st#status+list").to_df()


@query("events", "SELECT event_type,count(*) AS n FROM events WHERE value>50 GROUP BY 1")
def count_queries(f, *_):
    return f.count("#event+type", "count() as n#meta+count", queries="#value>50").to_df()


@query("events", "SELECT event_id,user_id FROM (SELECT event_id,user_id,row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events) WHERE rn=1")
def dedup_keys(f, *_):
    return f.with_columns("#meta+id,#contact+id").dedup("#contact+id").to_df()


@query("orders", "SELECT o_orderkey,o_totalprice FROM orders ORDER BY o_totalprice DESC,o_orderkey LIMIT 10")
def sort_topk(f, *_):
    return f.with_columns("#meta+id,#value").sort("#value", reverse=True).cache(10).to_df()


@query("customer", "SELECT c_name AS name,c_mktsegment AS seg FROM customer UNION ALL SELECT s_name,'' FROM supplier")
def append(f, spark, sf_dir):
    left = f.with_columns("#contact+name,#sector")
    right = read(spark, sf_dir, "supplier").with_columns("#org+name").rename_columns("#org+name:#contact+name")
    return left.append(right).to_df("name", "seg")


@query("customer", "SELECT c.c_custkey,coalesce(n.n_name,'') AS nation FROM customer c LEFT JOIN nation n ON c.c_nationkey=n.n_nationkey")
def merge_data(f, spark, sf_dir):
    return f.merge_data(read(spark, sf_dir, "nation"), "#country+code", "#country+name").with_columns("#contact+id,#country+name").to_df("c_custkey", "nation")


@query("customer", "SELECT c.c_custkey,coalesce(o.o_orderstatus,'') AS o_orderstatus FROM customer c LEFT JOIN (SELECT o_custkey,arg_max(o_orderstatus,o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) o ON c.c_custkey=o.o_custkey")
def merge_last_wins(f, spark, sf_dir):
    return f.with_columns("#contact+id").merge_data(read(spark, sf_dir, "orders"), "#contact+id", "#status").to_df()


@query("lineitem", "SELECT l_orderkey,l_linenumber,'discount' AS hdr,l_discount AS val FROM lineitem UNION ALL SELECT l_orderkey,l_linenumber,'tax',l_tax FROM lineitem")
def explode_wide(f, *_):
    f = f.with_columns("#meta+order,#meta+line,#discount,#tax").rename_columns(["#discount:discount#rate+label", "#tax:tax#rate+label"])
    return f.explode().to_df("l_orderkey", "l_linenumber", "hdr", "val")


@query("orders", "SELECT o_orderpriority,count(*) FILTER (o_orderstatus='F') AS f,count(*) FILTER (o_orderstatus='O') AS o,count(*) FILTER (o_orderstatus='P') AS p FROM orders GROUP BY 1")
def implode(f, *_):
    wide = f.count("#priority,#status", "count() as n#meta+count").implode("#status", "#meta+count")
    return wide.to_df("o_orderpriority", "f", "o", "p").na.fill(0)


@query("part", "SELECT p_partkey,unnest(string_split(p_name,' ')) AS word FROM part")
def expand_lists(f, *_):
    return f.with_columns("#item+id,#item+name").expand_lists("#item+name", separator=" ").to_df("p_partkey", "word")


@query("part", "SELECT p_partkey,upper(p_name) AS p_name FROM part")
def clean_upper(f, *_):
    return f.with_columns("#item+id,#item+name").clean_data(upper="#item+name").to_df()


@query("documents", r"SELECT doc_id,trim(regexp_replace(text,'\s+',' ','g')) AS t FROM documents")
def clean_ws(f, *_):
    return f.with_columns("#meta+id,#content").clean_data(whitespace="#content").to_df("doc_id", "t")


@query("orders", "SELECT o_orderkey,CASE WHEN lower(o_orderstatus)='f' THEN 'Filled' ELSE o_orderstatus END AS st FROM orders")
def replace_literal(f, *_):
    return f.with_columns("#meta+id,#status").replace_data("F", "Filled", "#status").to_df("o_orderkey", "st")


@query("part", r"SELECT p_partkey,regexp_replace(p_brand,'#(\d+)','-\1','g') AS b FROM part")
def replace_regex(f, *_):
    return f.with_columns("#item+id,#item+brand").replace_data(r"#(\d+)", r"-\1", "#item+brand", use_regex=True).to_df("p_partkey", "b")


@query("orders", "SELECT o_orderkey,CASE lower(o_orderstatus) WHEN 'f' THEN 'Filled' WHEN 'o' THEN 'Open' ELSE o_orderstatus END AS st FROM orders")
def replace_map(f, spark, _):
    rules = TagFrame.from_rows(spark, [["#x_pattern", "#x_substitution", "#x_tag"], ["f", "Filled", "#status"], ["o", "Open", "#status"]])
    return f.with_columns("#meta+id,#status").replace_data_map(rules).to_df("o_orderkey", "st")


@query("events", "SELECT event_id,coalesce(json_extract_string(props,'$.k'),'') AS k FROM events")
def jsonpath(f, *_):
    return f.with_columns("#meta+id,#meta+json").jsonpath("$.k", "#meta+json", native=True).to_df("event_id", "k")


@query("part", "SELECT DISTINCT p_type FROM part")
def value_set(f, *_):
    return f.value_set("#item+type").withColumnRenamed("value", "p_type")


@query("orders", "SELECT min(o_totalprice) AS lo,max(o_totalprice) AS hi FROM orders")
def dataset_minmax(f, *_):
    return f.min("#value").withColumnRenamed("value", "lo").crossJoin(f.max("#value").withColumnRenamed("value", "hi"))


def _typed(f: TagFrame, keep: str, formula: str, name: str) -> DataFrame:
    return f.add_columns(f"{name}#calc+new={{{{{formula}}}}}", typed=True).with_columns(f"{keep},#calc+new").to_df()


@query("lineitem", "SELECT l_orderkey,l_linenumber,least(l_discount,l_tax) AS m FROM lineitem")
def f_minmax_row(f, *_):
    return _typed(f, "#meta+order,#meta+line", "min(#discount, #tax)", "m")


@query("orders", "SELECT o_orderkey,abs(date_diff('day',DATE '1992-01-01',CAST(o_orderdate AS DATE))) AS d FROM orders")
def f_datedif(f, *_):
    return _typed(f, "#meta+id", 'datedif("1992-01-01", #date)', "d")


@query("orders", "SELECT o_orderkey,CAST(round_even(o_totalprice/1000,0) AS BIGINT) AS k FROM orders")
def f_round(f, *_):
    return _typed(f, "#meta+id", "round(#value / 1000)", "k")


@query("lineitem", "SELECT l_orderkey,l_linenumber,l_discount+l_tax AS s,l_quantity*l_tax AS p FROM lineitem")
def f_arithmetic(f, *_):
    return f.add_columns(["s#calc+s={{sum(#discount, #tax)}}", "p#calc+p={{product(#quantity, #tax)}}"], typed=True).with_columns("#meta+order,#meta+line,#calc").to_df()


@query("part", "SELECT p_partkey,upper(p_brand)||'/'||lower(p_type) AS j FROM part")
def f_text(f, *_):
    return _typed(f, "#item+id", 'join("/", toupper(#item+brand), tolower(#item+type))', "j")


@query("part", "SELECT p_partkey,p_size%7 AS m FROM part")
def f_modulo(f, *_):
    return _typed(f, "#item+id", "#size % 7", "m").withColumn("m", F.col("m").cast("int"))


@query("events", "SELECT event_id,coalesce(last_value(CASE WHEN event_type='purchase' THEN CAST(user_id AS VARCHAR) END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING),'') AS last_buyer FROM events")
def fill_data(f, spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).otherwise("").alias("buyer"), F.col("event_id").alias("_row"))
    return tag(df, {"event_id": "#meta+id", "buyer": "#contact"}, match_all=True, order_by=["_row"]).fill_data("#contact").to_df("event_id", "last_buyer")


@query("orders", "SELECT o_orderstatus,count(*) AS n FROM orders WHERE o_totalprice>100000 GROUP BY 1")
def recipe(f, *_):
    from .plans.recipe import from_recipe

    return from_recipe(f, [{"filter": "with_rows", "queries": "#value>100000"}, {"filter": "count", "patterns": "#status", "aggregators": "count() as n#meta+count"}]).to_df()


@query("orders", "SELECT o_orderkey,o_orderstatus FROM orders WHERE lower(o_orderstatus) NOT IN ('f','o')")
def v_enum(f, *_):
    from .validation import EnumerationTest

    return _violating(f, EnumerationTest("#status", ["F", "O"]), "#meta+id,#status")


@query("lineitem", "SELECT l_orderkey,l_linenumber,l_quantity FROM lineitem WHERE l_quantity<5 OR l_quantity>45")
def v_range(f, *_):
    from .validation import RangeTest

    return _violating(f, RangeTest("#quantity", "5", "45"), "#meta+order,#meta+line,#quantity")


@query("orders", "SELECT o_orderkey FROM (SELECT o_orderkey,row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) WHERE rn>1")
def v_unique(f, *_):
    from .validation import UniqueValueTest

    return _violating(f, UniqueValueTest("#contact+id"), "#meta+id")


@query("part", "WITH g AS (SELECT p_brand,p_type,count(*) n,min(p_partkey) f FROM part GROUP BY 1,2), r AS (SELECT p_brand,p_type,row_number() OVER (PARTITION BY p_brand ORDER BY n DESC,f) rn FROM g) SELECT p.p_partkey FROM part p JOIN r USING (p_brand,p_type) WHERE rn>1")
def v_correlation(f, *_):
    from .validation import CorrelationTest

    return _violating(f, CorrelationTest("#item+type", "#item+brand"), "#item+id")


@query("events", "WITH t AS (SELECT value x,row_number() OVER (ORDER BY value) a,count(*) OVER () n FROM events), s AS (SELECT avg(x) m,stddev_pop(x) d FROM t WHERE a>1 AND a<n) SELECT event_id FROM events,s WHERE abs(value-m)>3*d AND d/m<=1")
def v_outliers(f, *_):
    from .validation import OutlierTest

    return _violating(f, OutlierTest("#value"), "#meta+id")


@query("orders", "SELECT count(*) FILTER (lower(o_orderstatus) NOT IN ('f','o')) + count(*) FILTER (o_totalprice<1000) AS n FROM orders")
def v_schema(f, spark, _):
    rules = TagFrame.from_rows(spark, [["#valid_tag", "#valid_value+list", "#valid_value+min"], ["#status", "F|O", ""], ["#value", "", "1000"]])
    return f.validate(rules).issues.agg(F.count(F.lit(1)).alias("n"))


def _derived(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str], tags: dict[str, str]) -> TagFrame:
    """Columns made from a sample table by Spark SQL expressions, tagged; rows in order of the first."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*(F.expr(e).alias(n) for n, e in columns.items()), F.expr(next(iter(columns.values()))).alias("_row"))
    return tag(df, tags, match_all=True, order_by=["_row"])


#: Customers with a blank for the segment BUILDING, and 1 in 50 segments with a letter lost.
_BLANKED = {"id": "c_custkey", "nation": "c_nationkey", "seg": "if(c_mktsegment = 'BUILDING', '', c_mktsegment)"}
_TYPOS = {"id": "c_custkey", "seg": "if(c_custkey % 150 = 7, 'MACHINRY', c_mktsegment)"}
_SEGMENTS = {"id": "#contact+id", "nation": "#country+code", "seg": "#sector"}


@query("nation", "SELECT c_custkey AS id,CASE WHEN c_mktsegment='BUILDING' THEN n_name ELSE c_mktsegment END AS seg FROM customer JOIN nation ON n_nationkey=c_nationkey")
def merge_replace(f, spark, sf_dir):
    left = _derived(spark, sf_dir, "customer", _BLANKED, _SEGMENTS)
    return left.merge_data(f.rename_columns("#country+name:#sector"), "#country+code", "#sector", replace=True).with_columns("#contact,#sector").to_df("id", "seg")


@query("nation", "SELECT c_custkey AS id,coalesce(n_name,c_mktsegment) AS seg FROM customer LEFT JOIN nation ON n_nationkey=c_nationkey AND n_regionkey>1")
def merge_overwrite(f, spark, sf_dir):
    left = read(spark, sf_dir, "customer").with_columns("#contact+id,#country,#sector")
    right = f.with_rows("#region+code>1").rename_columns("#country+name:#sector")
    return left.merge_data(right, "#country+code", "#sector", replace=True, overwrite=True).with_columns("#contact,#sector").to_df("id", "seg")


@query("nation", "SELECT s_suppkey AS id,coalesce(b.n_name,a.n_name,'') AS nation FROM supplier LEFT JOIN nation a ON a.n_nationkey=s_suppkey LEFT JOIN nation b ON b.n_nationkey=s_nationkey")
def merge_candidates(f, spark, sf_dir):
    """Two columns match the key: the last that finds a row counts."""
    left = _derived(spark, sf_dir, "supplier", {"id": "s_suppkey", "a": "s_suppkey", "b": "s_nationkey"}, {"id": "#org+id", "a": "#country+code", "b": "#country+code"})
    return left.merge_data(f.with_columns("#country"), "#country+code", "#country+name").with_columns("#org,#country+name").to_df("id", "nation")


@query("part", "SELECT p_partkey AS id,CASE WHEN v=floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS price FROM (SELECT p_partkey,round(p_retailprice,1) AS v FROM part)")
def clean_number(_, spark, sf_dir):
    return _derived(spark, sf_dir, "part", {"id": "p_partkey", "price": "concat(' ', format_number(round(p_retailprice, 1), 2), ' ')"}, {"id": "#item+id", "price": "#value"}).clean_data(number="#value").to_df()


@query("orders", "SELECT o_orderkey AS id,strftime(o_orderdate,'%Y-%m-%d') AS day FROM orders")
def clean_date(_, spark, sf_dir):
    texts = "element_at(array(date_format(o_orderdate, 'd MMM yyyy'), date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), date_format(o_orderdate, 'MMMM d, yyyy')), cast(o_orderkey % 3 + 1 as int))"
    return _derived(spark, sf_dir, "orders", {"id": "o_orderkey", "day": texts}, {"id": "#meta+id", "day": "#date"}).clean_data(date="#date").to_df()


@query("customer", "SELECT c_custkey AS id,printf('%.4f',(c_custkey%90)+0.25) AS lat,printf('%.4f',-((c_custkey%180)+0.5)) AS lon FROM customer")
def clean_latlon(_, spark, sf_dir):
    made = {"id": "c_custkey", "lat": "concat(c_custkey % 90, 'N 15 00')", "lon": "concat(c_custkey % 180, 'W30')"}
    return _derived(spark, sf_dir, "customer", made, {"id": "#contact+id", "lat": "#geo+lat", "lon": "#geo+lon"}).clean_data(latlon="#geo").to_df()


@query("customer", "SELECT c_custkey,lower(c_mktsegment) AS c_mktsegment FROM customer")
def clean_lower(f, *_):
    return f.with_columns("#contact+id,#sector").clean_data(lower="#sector").to_df()


@query("orders", "SELECT o_orderkey,substr(o_orderpriority,1,1) AS a,CASE WHEN o_orderstatus='F' THEN 'x' ELSE '' END AS b FROM orders UNION ALL SELECT o_orderkey,substr(o_orderpriority,3),CASE WHEN o_orderstatus='F' THEN 'y' ELSE '' END FROM orders")
def expand_correlate(_, spark, sf_dir):
    made = {"id": "o_orderkey", "a": "concat(substr(o_orderpriority, 1, 1), ';', substr(o_orderpriority, 3))", "b": "if(o_orderstatus = 'F', 'x;y', '')"}
    f = _derived(spark, sf_dir, "orders", made, {"id": "#meta+id", "a": "#first+list", "b": "#second+list"})
    return f.expand_lists(separator=";", correlate=True).to_df("o_orderkey", "a", "b")


#: Sizes of parts: numbers, some in words, some dates.
_SIZES = {"id": "p_partkey", "size": "case p_size % 10 when 0 then 'large' when 1 then '2020-01-02' else cast(p_size as string) end"}


@query("part", "SELECT p_partkey AS id FROM part WHERE p_size%10>1")
def with_rows_is_number(_, spark, sf_dir):
    return _derived(spark, sf_dir, "part", _SIZES, {"id": "#item+id", "size": "#size"}).with_rows("#size is number").with_columns("#item").to_df()


@query("part", "SELECT p_partkey AS id FROM part WHERE p_size%10=0")
def with_rows_not_date(_, spark, sf_dir):
    return _derived(spark, sf_dir, "part", _SIZES, {"id": "#item+id", "size": "#size"}).with_rows("#size is not date").with_rows("#size is not number").with_columns("#item").to_df()


@query("part", "SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_type),'brass$')")
def with_rows_not_regex(f, *_):
    return f.with_rows("#item+type!~brass$").with_columns("#item+id").to_df()


@query("lineitem", "SELECT l_orderkey,l_linenumber,greatest(l_discount,l_tax) AS hi,(l_discount+l_tax)/2 AS mid FROM lineitem")
def f_max_average(f, *_):
    return f.add_columns(["hi#calc+hi={{max(#discount, #tax)}}", "mid#calc+mid={{average(#discount, #tax)}}"], typed=True).with_columns("#meta+order,#meta+line,#calc").to_df().withColumn("mid", F.col("mid").cast("double"))


@query("part", "SELECT p_partkey,CAST(-p_size-3 AS DOUBLE) AS a,CASE WHEN p_size=7 THEN NULL ELSE p_size/(p_size-7.0::DOUBLE) END AS b FROM part")
def f_minus_and_zero(f, *_):
    f = f.add_columns(["a#calc+a={{-#size - 3}}", "b#calc+b={{#size / (#size - 7)}}"], typed=True).with_columns("#item+id,#calc")
    return f.to_df().withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})


@query("region", "SELECT r_regionkey,strftime(now(),'%Y')>='2024' AS ok FROM region")
def f_today(f, *_):
    return _typed(f, "#region+code", "today()", "d").select("r_regionkey", (F.substr(F.col("d").cast("string"), F.lit(1), F.lit(4)) >= "2024").alias("ok"))


@query("orders", "SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus)='f'")
def row_counter(f, spark, _):
    counter = f.row_counter("#status=F")
    counter.frame.to_df().count()
    return spark.createDataFrame([(counter.row_count,)], "n long")


@query("customer", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment='BUILDING'")
def v_required(_, spark, sf_dir):
    from .validation import RequiredTest

    return _violating(_derived(spark, sf_dir, "customer", _BLANKED, _SEGMENTS), RequiredTest("#sector"), "#contact+id")


@query("part", "SELECT p_partkey AS id,CASE p_size%10 WHEN 0 THEN 'large' ELSE '2020-01-02' END AS size FROM part WHERE p_size%10<2")
def v_datatype(_, spark, sf_dir):
    from .validation import DatatypeTest

    return _violating(_derived(spark, sf_dir, "part", _SIZES, {"id": "#item+id", "size": "#size"}), DatatypeTest("#size", "number"), "#item+id,#size")


@query("customer", "SELECT c_custkey AS id FROM customer WHERE c_acctbal<=0")
def v_datatype_email(_, spark, sf_dir):
    from .validation import DatatypeTest

    made = {"id": "c_custkey", "mail": "concat('c', c_custkey, if(c_acctbal > 0, '@mail.org', ' at mail.org'))"}
    return _violating(_derived(spark, sf_dir, "customer", made, {"id": "#contact+id", "mail": "#contact+email"}), DatatypeTest("#contact+email", "email"), "#contact+id")


@query("part", "SELECT p_partkey AS id FROM part WHERE p_size%4<3")
def v_whitespace(_, spark, sf_dir):
    from .validation import WhitespaceTest

    made = {"id": "p_partkey", "name": "element_at(array(concat(' ', p_name), concat(p_name, ' '), replace(p_name, ' ', '  '), p_name), cast(p_size % 4 + 1 as int))"}
    return _violating(_derived(spark, sf_dir, "part", made, {"id": "#item+id", "name": "#item+name"}), WhitespaceTest("#item+name"), "#item+id")


@query("part", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_brand,'^Brand#[1-3]')")
def v_regex(f, *_):
    from .validation import RegexTest

    return _violating(f, RegexTest("#item+brand", "^Brand#[1-3]"), "#item+id")


@query("orders", "SELECT o_orderkey FROM (SELECT o_orderkey,row_number() OVER (PARTITION BY o_custkey,lower(o_orderstatus) ORDER BY o_orderkey) rn FROM orders) WHERE rn>1")
def v_unique_row(f, *_):
    from .validation import UniqueRowTest

    return _violating(f, UniqueRowTest("#contact+id,#status"), "#meta+id")


@query("part", "SELECT p_partkey AS id FROM part WHERE p_size%10<2")
def v_consistent(_, spark, sf_dir):
    from .validation import ConsistentDatatypesTest

    return _violating(_derived(spark, sf_dir, "part", _SIZES, {"id": "#item+id", "size": "#size"}), ConsistentDatatypesTest("#size"), "#item+id")


@query("customer", """WITH w AS (SELECT c_custkey AS id,CASE WHEN c_custkey%150=7 THEN 'machinry' ELSE lower(c_mktsegment) END AS seg FROM customer), c AS (SELECT seg,count(*) AS n FROM w GROUP BY 1),
m AS (SELECT avg(n) AS m,stddev_pop(n) AS d FROM c) SELECT id,'machinery' AS suggestion FROM w,m WHERE seg='machinry' AND d/m<=1 AND (SELECT n FROM c WHERE seg='machinry')<=m*0.05""")  # fmt: skip
def v_spelling(_, spark, sf_dir):
    from .validation import SpellingTest

    f = _derived(spark, sf_dir, "customer", _TYPOS, {"id": "#contact+id", "seg": "#sector"})
    return SpellingTest("#sector").violations(f).select(F.col("c0").alias("id"), F.col("_suggestion").alias("suggestion"))


@query("customer", "SELECT c_custkey AS id,CASE WHEN c_custkey%150=7 THEN 'MACHINRY' ELSE 'BUILDING' END AS seg FROM customer WHERE c_custkey%150=7 OR c_mktsegment='BUILDING'")
def v_listed(f, spark, sf_dir):
    from .validation import ListedTest

    allowed = f.without_rows("#sector=BUILDING").value_set("#sector")
    return _violating(_derived(spark, sf_dir, "customer", _TYPOS, {"id": "#contact+id", "seg": "#sector"}), ListedTest("#sector", allowed), "#contact+id,#sector")


@query("part", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,p_name,p_brand FROM part")
def csv_round_trip(f, spark, _):
    """Written as CSV by the executors and read back as a folder of tables."""
    from .sources.readers import read_csv
    from .sources.sinks import write_csv

    path = _new_path(spark, "csv")
    write_csv(f.with_columns("#item+id,#item+name,#item+brand"), path)
    return read_csv(spark, path).to_df()


@query("customer", """SELECT c_custkey AS id,upper(c_mktsegment) AS seg,'new' AS mark FROM customer WHERE lower(c_mktsegment)<>'building' AND c_acctbal>0""")
def recipe_columns(f, *_):
    from .plans.recipe import from_recipe

    steps = [
        {"filter": "without_rows", "queries": "#sector=BUILDING"}, {"filter": "with_rows", "queries": "#value>0"}, {"filter": "without_columns", "excludes": "#value,#country"},
        {"filter": "with_columns", "includes": "#contact+id,#sector"}, {"filter": "clean_data", "upper": "#sector"}, {"filter": "add_columns", "specs": ["mark#meta+mark=old"]},
        {"filter": "replace_data", "original": "old", "replacement": "new", "pattern": "#meta+mark"}, {"filter": "rename_columns", "specs": ["#contact+id:id#meta+id", "#sector:seg#sector"]},
    ]
    return from_recipe(f, steps).to_df()


@query("orders", "SELECT o_custkey,o_orderkey FROM (SELECT o_custkey,o_orderkey,row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) WHERE rn=1 ORDER BY o_custkey LIMIT 20")
def recipe_rows(f, *_):
    from .plans.recipe import from_recipe

    steps = [{"filter": "dedup", "patterns": "#contact+id"}, {"filter": "sort", "keys": "#contact+id"}, {"filter": "cache", "max_rows": 20}, {"filter": "with_columns", "includes": "#contact+id,#meta+id"}]
    return from_recipe(f, steps).to_df().select("o_custkey", "o_orderkey")


@query("nation", "SELECT n_nationkey,n_name,r_name FROM nation JOIN region ON r_regionkey=n_regionkey UNION ALL SELECT 99,'extra','AFRICA'")
def recipe_tables(f, spark, sf_dir):
    from .plans.recipe import from_recipe

    extra = [["code", "name", "region"], ["#country+code", "#country+name", "#region+code"], [99, "extra", 0]]
    regions = [["#region+code", "#region+name"], *([r.r_regionkey, r.r_name] for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect())]  # five rows
    steps = [{"filter": "append", "append_sources": [{"input": extra, "recipe": []}]}, {"filter": "merge_data", "merge_source": regions, "keys": "#region+code", "tags": "#region+name"}, {"filter": "without_columns", "excludes": "#region+code"}]
    return from_recipe(f, steps).to_df("n_nationkey", "n_name", "r_name").withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("lineitem", "SELECT l_returnflag,hdr,round(sum(val),2) AS total FROM (SELECT l_returnflag,'discount' AS hdr,l_discount AS val FROM lineitem UNION ALL SELECT l_returnflag,'tax',l_tax FROM lineitem) GROUP BY 1,2")
def recipe_reshape(f, *_):
    from .plans.recipe import from_recipe

    steps = [
        {"filter": "with_columns", "includes": "#status+return,#discount,#tax"}, {"filter": "rename_columns", "specs": ["#discount:discount#rate+label", "#tax:tax#rate+label"]},
        {"filter": "explode"}, {"filter": "count", "patterns": "#status+return,#rate+header", "aggregators": "sum(#rate+value) as total#rate+sum"},
    ]
    return from_recipe(f, steps).to_df("l_returnflag", "hdr", "total").withColumn("total", F.round(F.col("total").cast("double"), 2))


def _streamed(spark: SparkSession, sf_dir: str, table: str, work, mode: str = "append") -> DataFrame:
    """What work(frame) gives for a stream of a sample table's files, when all of them have been read.

    In append mode the executors write its rows as Parquet; only the groups of complete mode are held by the driver.
    """
    import uuid

    from .streaming import stream_frame

    static = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", f"{table}*.parquet" if not _is_folder(spark, f"{sf_dir}/{table}.parquet") else "*.parquet")
    df = source.parquet(f"{sf_dir}/{table}.parquet" if _is_folder(spark, f"{sf_dir}/{table}.parquet") else sf_dir)
    out = work(stream_frame(df, TAGS[table]))
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        path = _new_path(spark, "stream")
        writer.format("parquet").option("checkpointLocation", f"{path}-log").start(path).awaitTermination()
        return spark.read.schema(out.schema).parquet(path)
    name = f"s{uuid.uuid4().hex}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def _new_path(spark: SparkSession, kind: str) -> str:
    """A path not used before in the folder that driver and executors share."""
    import tempfile
    import uuid

    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/tagloom-{kind}-{uuid.uuid4().hex}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("events", "SELECT event_id,upper(event_type) AS event_type,'live' AS mode FROM events WHERE value>50")
def stream_rows_columns_cells(_, spark, sf_dir):
    work = lambda f: f.with_rows("#value>50").with_columns("#meta+id,#event").clean_data(upper="#event").add_columns("mode#meta+mode=live").to_df()
    return _streamed(spark, sf_dir, "events", work)


@query("events", "SELECT event_type,count(*) AS n FROM events GROUP BY 1")
def stream_count(_, spark, sf_dir):
    return _streamed(spark, sf_dir, "events", lambda f: f.count("#event+type", "count() as n#meta+count").to_df(), "complete")


@query("events", "SELECT DISTINCT event_type FROM events")
def stream_dedup(_, spark, sf_dir):
    from .streaming import dedup

    return _streamed(spark, sf_dir, "events", lambda f: dedup(f.with_columns("#event+type")).to_df())


@query("events", "SELECT event_id,CASE WHEN event_type='purchase' THEN 'bought' ELSE '' END AS kind FROM events UNION ALL SELECT event_id,'again' FROM events")
def stream_merge_append(_, spark, sf_dir):
    kinds = TagFrame.from_rows(spark, [["#event+type", "#event+kind"], ["purchase", "bought"]]).transform(F.broadcast)  # one row

    def work(f):
        slim = f.with_columns("#meta+id,#event")
        merged = slim.merge_data(kinds, "#event+type", "#event+kind").with_columns("#meta+id,#event+kind")
        return merged.append(slim.with_columns("#meta+id").add_columns("#event+kind=again")).to_df("event_id", "kind")

    return _streamed(spark, sf_dir, "events", work)


def _violating(f: TagFrame, test, keep: str) -> DataFrame:
    """Named columns of the rows that a test finds fault with."""
    places = f.places(keep)
    names = [f.columns[i].header for i in places]
    return test.violations(f).select(*(F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)))
