"""Queries of schema inference, encoding, dates and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.scalars import DATE_PARTS, date_part, date_part_names, matches_marker, number_text, parse_date, without_marker
from arborlake.operators import encode
from arborlake.plans.registry import query, table
from arborlake.sources.files import join_many_to_one, numeric_types

_DATE_SQL = {
    "Year": "year(d)", "Month": "month(d)", "Week": "week(d)", "Day": "day(d)", "Dayofweek": "isodow(d) - 1", "Dayofyear": "dayofyear(d)",
    "Is_month_end": "last_day(d) = CAST(d AS DATE)", "Is_month_start": "day(d) = 1", "Is_quarter_end": "last_day(d) = CAST(d AS DATE) AND month(d) % 3 = 0",
    "Is_quarter_start": "day(d) = 1 AND month(d) % 3 = 1", "Is_year_end": "last_day(d) = CAST(d AS DATE) AND month(d) = 12", "Is_year_start": "day(d) = 1 AND month(d) = 1",
    "Hour": "hour(d)", "Minute": "minute(d)", "Second": "second(d)", "Elapsed": "CAST(floor(epoch(d)) AS BIGINT)",
}


def _date_sql(key: str, column: str, source: str) -> str:
    parts = ", ".join(f"CAST({_DATE_SQL[p]} AS BIGINT) AS {n}" for p, n in zip(DATE_PARTS, date_part_names(column), strict=True))
    return f"SELECT {key}, {parts} FROM (SELECT {key}, {column} AS d FROM {source})"


def _date_parts(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, *(date_part(F.col(column), p).alias(n) for p, n in zip(DATE_PARTS, date_part_names(column), strict=True)))


@query("SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, o_orderpriority = '5-LOW' AS missing FROM orders")
def missing_marker_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", without_marker(value, "5-LOW").alias("priority"), matches_marker(value, "5-LOW").alias("missing"))


@query(
    """SELECT marker, count(*) AS n FROM (
        SELECT unnest([CASE WHEN l_linenumber = 3 THEN 'int' END, CASE WHEN l_discount = 0.05 THEN 'float' END, CASE WHEN l_returnflag = 'N' THEN 'text' END, CASE WHEN (l_quantity > 25) THEN 'bool' END]) AS marker FROM lineitem)
    WHERE marker IS NOT NULL GROUP BY marker"""
)
def marker_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"int": (F.col("l_linenumber"), 3), "float": (F.col("l_discount"), 0.05), "text": (F.col("l_returnflag"), "N"), "bool": (F.col("l_quantity") > 25, True)}
    hits = F.array_compact(F.array(*(F.when(matches_marker(c, m), F.lit(name)) for name, (c, m) in tests.items())))
    return table(spark, sf_dir, "lineitem").select(F.explode(hits).alias("marker")).groupBy("marker").agg(F.count("*").alias("n"))


_PROFILED = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "values", count(DISTINCT {c}) AS distinct_values, CAST(count(*) - count({c}) AS BIGINT) AS missing, false AS non_finite,
        {f"coalesce(bool_and({c} = floor({c})), false)" if c[2:] not in ("returnflag", "linestatus") else "false"} AS all_int, '{"lexical" if c[2:] in ("returnflag", "linestatus") else "numeric"}' AS kind FROM lineitem"""
        for c in _PROFILED
    )
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.profile(table(spark, sf_dir, "lineitem", *_PROFILED), list(_PROFILED))


@query(
    """SELECT kind, count(*) AS columns, sum(missing) AS missing, count(*) FILTER (distinct_values <= 2) AS binary_columns, count(*) FILTER (distinct_values > 20) AS high_cardinality FROM (
        SELECT 'numeric' AS kind, count(DISTINCT c_custkey) AS distinct_values, CAST(0 AS BIGINT) AS missing FROM customer UNION ALL SELECT 'lexical', count(DISTINCT c_name), 0 FROM customer
        UNION ALL SELECT 'numeric', count(DISTINCT c_nationkey), 0 FROM customer UNION ALL SELECT 'numeric', count(DISTINCT c_acctbal), count(*) FILTER (c_acctbal < 0) FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)
        UNION ALL SELECT 'lexical', count(DISTINCT c_mktsegment), 0 FROM customer) GROUP BY kind""".replace("count(*) FILTER (c_acctbal < 0)", "count(*) - count(c_acctbal)").replace("sum(missing)", "CAST(sum(missing) AS BIGINT)")
)
def schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    found = encode.profile(customer, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return found.groupBy("kind").agg(
        F.count("*").alias("columns"), F.sum("missing").alias("missing"), F.count_if(F.col("distinct_values") <= 2).alias("binary_columns"), F.count_if(F.col("distinct_values") > 20).alias("high_cardinality")
    )


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS rank, n FROM (SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1)")
def numeric_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.dictionary(table(spark, sf_dir, "lineitem", "l_discount"), "l_discount")


@query("SELECT value, row_number() OVER (ORDER BY value) - 1 AS rank, n FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)")
def text_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.dictionary(table(spark, sf_dir, "part", "p_brand"), "p_brand")


@query("SELECT p_size AS median FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS pl, count(*) OVER () AS n FROM part) WHERE pl = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.upper_median(encode.dictionary(table(spark, sf_dir, "part", "p_size"), "p_size"))


@query("SELECT p_type AS median FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS pl, count(*) OVER () AS n FROM part) WHERE pl = n // 2")
def upper_median_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.upper_median(encode.dictionary(table(spark, sf_dir, "part", "p_type"), "p_type"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN value <= 400 THEN value END AS v FROM events), d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM (SELECT DISTINCT v FROM e WHERE v IS NOT NULL))
    SELECT event_id, coalesce(r, (SELECT count(*) FROM d)) AS rank FROM e LEFT JOIN d ON e.v = d.v"""
)
def missing_rank_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") <= 400, F.col("value")).alias("v"))
    return encode.encode_ranks(events, "v", encode.dictionary(events, "v"), "rank").select("event_id", "rank")


@query("SELECT row_number() OVER (ORDER BY v) - 1 AS rank, coalesce(lag(v) OVER (ORDER BY v), v) AS boundary FROM (SELECT DISTINCT l_quantity AS v FROM lineitem)")
def cutoff_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.cutoffs(encode.dictionary(table(spark, sf_dir, "lineitem", "l_quantity"), "l_quantity"))


@query(
    """WITH d AS (SELECT DISTINCT p_type AS v FROM part), t AS (SELECT DISTINCT p_name AS v FROM part UNION SELECT v FROM d)
    SELECT t.v AS text, (SELECT count(*) FROM d WHERE d.v < t.v) - CASE WHEN t.v IN (SELECT v FROM d) THEN 0.0 ELSE 0.5 END AS position FROM t""".replace("- CASE", "- CAST(CASE").replace("0.5 END AS", "0.5 END AS DOUBLE) AS")
)
def unseen_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = part.select(F.col("p_name").alias("text")).unionByName(part.select(F.col("p_type").alias("text")))
    return encode.text_positions(texts, "text", encode.dictionary(part, "p_type"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN concat(CAST(p_retailprice AS BIGINT), '.0') ELSE CAST(p_retailprice AS VARCHAR) END AS price, concat(p_size, '.0') AS size FROM part")
def number_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", number_text(F.col("p_retailprice")).alias("price"), number_text(F.col("p_size").cast("double")).alias("size"))


@query(
    """WITH t AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS s, strftime(o_orderdate, '%Y%m%d') AS c FROM orders)
    SELECT 's' AS "column", CASE WHEN (SELECT bool_and(try_strptime(s, '%m/%d/%Y') IS NOT NULL) FROM t) THEN '%m/%d/%Y' WHEN (SELECT bool_and(try_strptime(s, '%d/%m/%Y') IS NOT NULL) FROM t) THEN '%d/%m/%Y' END AS format
    UNION ALL SELECT 'c', CASE WHEN (SELECT bool_and(try_strptime(c, '%Y%m%d') IS NOT NULL) FROM t) THEN '%Y%m%d' END"""
)
def date_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("s"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("c"))
    found = encode.detect_dates(orders, ["s", "c"], "o_orderkey")
    return spark.createDataFrame(list(found.items()), "column string, format string")


@query("SELECT o_orderkey, strftime(strptime(strftime(o_orderdate, '%b %d, %Y %H:%M:%S'), '%b %d, %Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS stamp, CAST(NULL AS VARCHAR) AS bad FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "MMM dd, yyyy HH:mm:ss")
    stamps = [parse_date(c, "%b %d, %Y %H:%M:%S") for c in (text, F.concat(text, F.lit("?")))]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(stamps[0], "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.date_format(stamps[1], "yyyy-MM-dd HH:mm:ss").alias("bad"))


@query(_date_sql("o_orderkey", "o_orderdate", "orders"))
def date_parts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _date_parts(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


@query(_date_sql("event_id", "ts", "events"))
def date_parts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _date_parts(table(spark, sf_dir, "events"), "event_id", "ts")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, v, n: (F.col(c) == v).cast("int").alias(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", flag("o_orderstatus", "F", "status_F"), flag("o_orderstatus", "O", "status_O"), flag("o_orderstatus", "P", "status_P"), flag("o_orderpriority", "1-URGENT", "urgent"))


_FLAGS_SQL = "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS status_F, CAST(o_orderstatus = 'O' AS INT) AS status_O, CAST(o_orderstatus = 'P' AS INT) AS status_P, CAST(o_orderpriority = '1-URGENT' AS INT) AS urgent FROM orders"
_NAMES = ["status_F", "status_O", "status_P", "urgent"]


@query(
    f"WITH f AS ({_FLAGS_SQL}) SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST(sum({a} * {b}) AS BIGINT) AS \"both\" FROM f" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :])
    + ') WHERE "both" > 0'
)
def bundle_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.conflicts(_flags(spark, sf_dir), _NAMES)


@query(f"WITH f AS ({_FLAGS_SQL}) SELECT o_orderkey, CAST(CASE WHEN status_F = 1 THEN 1 WHEN status_O = 1 THEN 2 WHEN status_P = 1 THEN 3 ELSE 0 END AS INTEGER) AS code FROM f")
def bundle_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("o_orderkey", encode.bundle_code([F.col(c) for c in _NAMES[:3]]).alias("code"))


@query(
    f"""WITH f AS ({_FLAGS_SQL}), m AS (SELECT name, active, CAST(substr(name, 8) AS VARCHAR) AS s FROM (SELECT unnest(['status_F', 'status_O', 'status_P']) AS name, unnest([sum(status_F), sum(status_O), sum(status_P)]) AS active FROM f))
    SELECT 'status' AS bundle, CAST(row_number() OVER (ORDER BY active, name) - 1 AS INTEGER) AS place, name AS member FROM m"""
)
def bundle_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    rows = [(name, i, m) for name, members in encode.bundles(flags, _NAMES) for i, m in enumerate(members)]
    return spark.createDataFrame(rows, "bundle string, place int, member string")


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS class_id FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def class_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.class_dictionary(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    """SELECT 's_suppkey' AS "column", 'bigint' AS type, CAST(0 AS BIGINT) AS bad UNION ALL SELECT 's_name', 'double', (SELECT count(*) FROM supplier WHERE TRY_CAST(s_name AS DOUBLE) IS NULL)
    UNION ALL SELECT 's_nationkey', 'bigint', 0 UNION ALL SELECT 's_acctbal', 'double', 0"""
)
def convert_numeric_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return numeric_types(supplier.select(*(F.col(c).cast("string").alias(c) for c in supplier.columns)))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_with_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return join_many_to_one(table(spark, sf_dir, "nation"), region, ["n_regionkey"]).select("n_name", "r_name")


@query(f"""WITH f AS ({_FLAGS_SQL}) SELECT unnest(['status_F', 'status_O', 'status_P', 'urgent']) AS flag""")
def binary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir).withColumn("all_zero", F.lit(0)).withColumn("three", F.col("o_orderkey") % 3)
    return spark.createDataFrame([(c,) for c in encode.binary_columns(flags, [*_NAMES, "all_zero", "three"])], "flag string")


@query(
    f"""WITH f AS ({_FLAGS_SQL}), c AS (SELECT CASE WHEN status_F = 1 THEN 1 WHEN status_O = 1 THEN 2 WHEN status_P = 1 THEN 3 ELSE 0 END AS code FROM f),
    g AS (SELECT code, count(*) AS n FROM c GROUP BY 1), r AS (SELECT code, sum(n) OVER (ORDER BY code) AS upto, sum(n) OVER () AS total FROM g)
    SELECT CAST(min(code) AS INTEGER) AS median FROM r WHERE upto > total // 2"""
)
def bundle_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _flags(spark, sf_dir).select(encode.bundle_code([F.col(c) for c in _NAMES[:3]]).alias("code"))
    return encode.upper_median(encode.dictionary(codes, "code"))


@query(
    """SELECT p_partkey, p_type, CAST(p_size AS BIGINT) AS p_size, CASE WHEN p_size % 2 = 1 THEN 'odd_1' ELSE 'odd_2' END AS odd FROM part"""
)
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.operators.forest import Encoder, Feature

    part = table(spark, sf_dir, "part").withColumn("odd_1", F.col("p_size") % 2).withColumn("odd_2", 1 - F.col("p_size") % 2)
    features = [Feature("p_type", "lexical", ["p_type"], []), Feature("p_size", "numeric", ["p_size"], all_int=True), Feature("odd", "bundle", ["odd_1", "odd_2"])]
    return Encoder(["p_type", "p_size", "odd_1", "odd_2"], features, {}, {}, {}).display(part, ["p_partkey"])


@query(
    """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS ordinal FROM orders GROUP BY 1"""
)
def comparison_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.operators.compare import ordinal, target_means

    orders = table(spark, sf_dir, "orders")
    return target_means(orders, "o_orderpriority", "o_totalprice").join(ordinal(orders, "o_orderpriority"), "o_orderpriority").select("o_orderpriority", F.round("mean", 4).alias("mean_price"), "ordinal")
