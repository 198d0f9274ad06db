"""A named query for each operator over the driver's tables, with the SQL that gives the same rows.

The tables are clean, so messy values are derived from them by integer arithmetic that reads the same in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fixed as X
from .functions import names as N
from .functions import values as V
from .functions.refs import index_of, letters_of
from .operators import detect, grid
from .operators.rows import drop_conditions, drop_empty_rows, drop_matching, fill_ratios
from .sources.sniff import delimiter_score, metadata_share

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WS = X.SPACE


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def re2(pattern: str) -> str:
    """A pattern for DuckDB: quotes doubled."""
    return pattern.replace("'", "''")


# --- white space and missing values ---

_messy_text = "concat('  ', replace(text, ' ', CASE WHEN doc_id % 3 = 0 THEN chr(9) || ' ' WHEN doc_id % 3 = 1 THEN chr(160) ELSE '  ' END), chr(10))"


def messy_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    gap = F.when(k == 0, F.lit("\t ")).when(k == 1, F.lit(" ")).otherwise(F.lit("  "))
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), F.replace("text", F.lit(" "), gap), F.lit("\n")).alias("raw"))


@query(f"""SELECT doc_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT doc_id,
regexp_replace(regexp_replace({_messy_text}, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS x FROM documents)""")
def q01_whitespace(spark: SparkSession, d: str) -> DataFrame:
    x = V.clean_whitespace(F.col("raw"))
    return messy_text(spark, d).select("doc_id", F.length(x).cast("long").alias("n_chars"), F.md5(x).alias("digest"))


@query(f"""SELECT doc_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT doc_id,
regexp_replace(regexp_replace({_messy_text}, '[ \\t\\x{{a0}}]+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS x FROM documents)""")
def q02_whitespace_linebreaks(spark: SparkSession, d: str) -> DataFrame:
    x = V.clean_whitespace(F.col("raw"), preserve_linebreaks=True)
    return messy_text(spark, d).select("doc_id", F.length(x).cast("long").alias("n_chars"), F.md5(x).alias("digest"))


_TOKENS = ["NA", "N/A", "null", "None", "NaN", "-", "?", "...", "   ", "", "value", "nil", "missing", "#N/A"]
_token_sql = "CASE o_orderkey % 15 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_TOKENS)) + " ELSE o_orderpriority END"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 15
    token = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(_TOKENS))):
        token = F.when(k == i, v).otherwise(token)
    return t(spark, d, "orders").select("o_orderkey", F.when(k == 14, F.col("o_orderpriority")).otherwise(token).alias("token"))


@query(f"SELECT o_orderkey, CASE WHEN x IN {sql_list(X.MISSING)} THEN NULL ELSE x END AS clean FROM (SELECT o_orderkey, {_token_sql} AS x FROM orders)")
def q03_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("o_orderkey", V.null_missing(F.col("token"), blank=False).alias("clean"))


@query(f"SELECT o_orderkey, CASE WHEN x IN {sql_list(X.MISSING + X.MISSING_EXTENDED)} THEN NULL ELSE x END AS clean FROM (SELECT o_orderkey, {_token_sql} AS x FROM orders)")
def q04_extended_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("o_orderkey", V.null_missing(F.col("token"), extended=True, blank=False).alias("clean"))


@query(f"SELECT o_orderkey, CASE WHEN x IN {sql_list(X.MISSING)} OR regexp_matches(x, '^{WS}*$') THEN NULL ELSE x END AS clean FROM (SELECT o_orderkey, {_token_sql} AS x FROM orders)")
def q05_blank_to_null(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("o_orderkey", V.null_missing(F.col("token")).alias("clean"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS b FROM orders WHERE NOT (o_orderkey % 5 = 0 AND (o_orderkey % 10 = 0 OR o_orderkey % 3 = 0))")
def q06_drop_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select("o_orderkey", F.when(k % 5 != 0, F.col("o_orderstatus")).alias("a"), F.when((k % 10 != 0) & (k % 3 != 0), F.col("o_custkey")).alias("b"))
    return drop_empty_rows(rows, ("o_orderkey",))


@query("""WITH o AS (SELECT o_orderkey AS full_col, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS half_col, CASE WHEN o_orderkey % 20 = 0 THEN o_orderstatus END AS sparse_col, CAST(NULL AS VARCHAR) AS empty_col FROM orders),
a AS (SELECT count(*) AS n, count(full_col) AS a, count(half_col) AS b, count(sparse_col) AS c, count(empty_col) AS e FROM o)
SELECT 'full_col' AS column_name, n AS n_rows, a AS n_filled, a < n * 0.1 AS is_sparse FROM a UNION ALL SELECT 'half_col', n, b, b < n * 0.1 FROM a UNION ALL SELECT 'sparse_col', n, c, c < n * 0.1 FROM a UNION ALL SELECT 'empty_col', n, e, e < n * 0.1 FROM a""")
def q07_sparse_and_empty_columns(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(k.alias("full_col"), F.when(k % 2 == 0, F.col("o_custkey")).alias("half_col"), F.when(k % 20 == 0, F.col("o_orderstatus")).alias("sparse_col"), F.lit(None).cast("string").alias("empty_col"))
    return fill_ratios(rows, rows.columns)


# --- numbers in text ---

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def grouped(group: str, decimal: str) -> Column:
    """The price of priced lines as a text such as 1,234.56, by integer arithmetic."""
    units = F.col("_u")
    n = F.length(units)
    low = F.when(n > 3, F.substring(units, n - 2, F.lit(3))).otherwise(units)
    mid = F.when(n > 6, F.substring(units, n - 5, F.lit(3))).when(n > 3, F.substring(units, F.lit(1), n - 3))
    top = F.when(n > 6, F.substring(units, F.lit(1), n - 6))
    return F.concat(F.concat_ws(group, top, mid, low), F.lit(decimal), F.col("_f"))


def sql_grouped(group: str, decimal: str, cents: str = _CENTS) -> str:
    u = f"CAST({cents} // 100 AS VARCHAR)"
    return f"""(concat_ws('{group}', CASE WHEN length({u}) > 6 THEN substr({u}, 1, length({u}) - 6) END, CASE WHEN length({u}) > 6 THEN substr({u}, length({u}) - 5, 3) WHEN length({u}) > 3 THEN substr({u}, 1, length({u}) - 3) END, CASE WHEN length({u}) > 3 THEN substr({u}, length({u}) - 2, 3) ELSE {u} END) || '{decimal}' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"""


_BY_FLAG = "count(*) AS n, count(v) AS n_numbers, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS cents"


def by_flag(rows: DataFrame) -> DataFrame:
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("v").alias("n_numbers"), F.sum(F.round(F.col("v") * 100).cast("bigint")).alias("cents"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with whole units and cents of the price as texts, each step computed once."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("_c"))
    return rows.select("*", F.expr("_c div 100").cast("string").alias("_u"), F.lpad((F.col("_c") % 100).cast("string"), 2, "0").alias("_f"))


def _strip(x: str, group: str, decimal: str) -> str:
    return f"TRY_CAST(replace(replace({x}, '{group}', ''), '{decimal}', '.') AS DOUBLE)"


@query(f"SELECT l_returnflag, {_BY_FLAG} FROM (SELECT l_returnflag, {_strip(sql_grouped(',', '.'), ',', '.')} AS v FROM lineitem) GROUP BY 1")
def q08_number_us(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("$"), grouped(",", "."))
    return by_flag(lines(spark, d).select("l_returnflag", V.to_number(text).alias("v")))


@query(f"SELECT l_returnflag, {_BY_FLAG} FROM (SELECT l_returnflag, {_strip(sql_grouped('.', ','), '.', ',')} AS v FROM lineitem) GROUP BY 1")
def q09_number_eu(spark: SparkSession, d: str) -> DataFrame:
    return by_flag(lines(spark, d).select("l_returnflag", V.to_number(grouped(".", ","), ",", ".").alias("v")))


@query(f"SELECT l_returnflag, {_BY_FLAG} FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 2 = 0 THEN {_strip(sql_grouped(',', '.'), ',', '.')} ELSE {_strip(sql_grouped('.', ','), '.', ',')} END AS v FROM lineitem) GROUP BY 1")
def q10_number_mixed(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("l_orderkey") % 2 == 0, grouped(",", ".")).otherwise(grouped(".", ","))
    return by_flag(lines(spark, d).select("l_returnflag", V.to_number_mixed(text).alias("v")))


@query(f"SELECT l_returnflag, {_BY_FLAG} FROM (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * {_strip(sql_grouped(',', '.'), ',', '.')} AS v FROM lineitem) GROUP BY 1")
def q11_number_accounting(spark: SparkSession, d: str) -> DataFrame:
    text = grouped(",", ".")
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    return by_flag(lines(spark, d).select("l_returnflag", V.to_number(text).alias("v")))


@query(f"SELECT l_returnflag, {_BY_FLAG} FROM (SELECT l_returnflag, {_strip(sql_grouped(',', '.'), ',', '.')} AS v FROM lineitem) GROUP BY 1")
def q12_number_currencies(spark: SparkSession, d: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, X.CURRENCIES)), (F.col("l_orderkey") % len(X.CURRENCIES)).cast("int") + 1)
    text = F.when(F.col("l_orderkey") % 2 == 0, F.concat(sign, F.lit(" "), grouped(",", "."))).otherwise(F.concat(grouped(",", "."), F.lit(" "), sign))
    return by_flag(lines(spark, d).select("l_returnflag", V.to_number(text).alias("v")))


_LIKE_SQL = f"^[+-]?(?:[0-9,.]|{WS})+$|^\\((?:[0-9,.]|{WS})+\\)$|^[$€£¥₹](?:[0-9,.]|{WS})+$"


@query(f"""WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS a, o_orderpriority AS b, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS c FROM orders ORDER BY o_orderkey LIMIT {X.NUMBER_SAMPLE}),
u AS (SELECT 'a' AS column_name, a AS x FROM s UNION ALL SELECT 'b', b FROM s UNION ALL SELECT 'c', c FROM s)
SELECT column_name, count(*) AS n, count(*) FILTER (WHERE regexp_matches(x, '{re2(_LIKE_SQL)}')) AS n_like, count(*) FILTER (WHERE regexp_matches(x, '{re2(_LIKE_SQL)}')) > count(*) * 0.5 AS is_number FROM u GROUP BY 1""")
def q13_number_gate(spark: SparkSession, d: str) -> DataFrame:
    first = t(spark, d, "orders").orderBy("o_orderkey").limit(X.NUMBER_SAMPLE)
    cust = F.col("o_custkey").cast("string")
    values = F.array(F.struct(F.lit("a").alias("column_name"), cust.alias("x")), F.struct(F.lit("b").alias("column_name"), F.col("o_orderpriority").alias("x")), F.struct(F.lit("c").alias("column_name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(cust).alias("x")))
    like = F.count_if(V.number_like(F.col("x")))
    return first.select(F.inline(values)).groupBy("column_name").agg(F.count("*").alias("n"), like.alias("n_like"), (like > F.count("*") * 0.5).alias("is_number"))


@query(f"""WITH x AS (SELECT {sql_grouped(',', '.')} AS us, {sql_grouped('.', ',')} AS eu FROM lineitem)
SELECT count(*) FILTER (WHERE regexp_matches(us, '[0-9],[0-9]{{2}}$')) AS us_comma_decimal, count(*) FILTER (WHERE regexp_matches(us, '[0-9][.][0-9]{{2}}$')) AS us_dot_decimal, count(*) FILTER (WHERE regexp_matches(us, '[0-9],[0-9]{{3}}')) AS us_comma_group,
count(*) FILTER (WHERE regexp_matches(eu, '[0-9],[0-9]{{2}}$')) AS eu_comma_decimal, count(*) FILTER (WHERE regexp_matches(eu, '[0-9][.][0-9]{{2}}$')) AS eu_dot_decimal, count(*) FILTER (WHERE regexp_matches(eu, '[0-9][.][0-9]{{3}}')) AS eu_dot_group FROM x""")
def q14_separator_votes(spark: SparkSession, d: str) -> DataFrame:
    us, eu = grouped(",", "."), grouped(".", ",")
    votes = [("us_comma_decimal", us, V.COMMA_DECIMAL), ("us_dot_decimal", us, V.DOT_DECIMAL), ("us_comma_group", us, V.COMMA_THOUSANDS), ("eu_comma_decimal", eu, V.COMMA_DECIMAL), ("eu_dot_decimal", eu, V.DOT_DECIMAL), ("eu_dot_group", eu, V.DOT_THOUSANDS)]
    return lines(spark, d).agg(*[F.count_if(x.rlike(p)).alias(n) for n, x, p in votes])


@query("""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS good, CASE WHEN o_orderkey % 1000 = 7 THEN '12d' ELSE CAST(o_custkey AS VARCHAR) END AS poisoned FROM orders),
a AS (SELECT bool_or(TRY_CAST(poisoned AS BIGINT) IS NULL) AS bad FROM o)
SELECT o_orderkey, CAST(good AS DOUBLE) AS good, CASE WHEN bad THEN poisoned END AS poisoned, CASE WHEN NOT bad THEN TRY_CAST(poisoned AS DOUBLE) END AS poisoned_number FROM o, a""")
def q15_all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    cust = F.col("o_custkey").cast("string")
    rows = t(spark, d, "orders").select("o_orderkey", cust.alias("good"), F.when(F.col("o_orderkey") % 1000 == 7, "12d").otherwise(cust).alias("poisoned"))
    good, poisoned = V.to_number(F.col("good")), V.to_number(F.col("poisoned"))
    bad = rows.agg(F.coalesce(F.bool_or(poisoned.isNull() & F.col("poisoned").isNotNull()), F.lit(False))).first()[0]  # the profile
    return rows.select("o_orderkey", good.alias("good"), (F.col("poisoned") if bad else F.lit(None).cast("string")).alias("poisoned"), (F.lit(None).cast("double") if bad else poisoned).alias("poisoned_number"))


# --- dates ---


@query("SELECT o_orderkey, DATE '1899-12-30' + CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER) + INTERVAL (CAST(o_orderkey % 24 AS INTEGER)) HOUR AS at FROM orders")
def q16_serial_dates(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(X.EXCEL_EPOCH).cast("date"))
    return t(spark, d, "orders").select("o_orderkey", V.serial_date(days + (F.col("o_orderkey") % 24) / 24).alias("at"))


@query("""SELECT 'size' AS column_name, count(*) AS n, count(*) FILTER (WHERE p_size BETWEEN 1 AND 60000) AS n_serial FROM part UNION ALL
SELECT 'price', count(*), count(*) FILTER (WHERE p_retailprice BETWEEN 1 AND 60000 AND p_retailprice = floor(p_retailprice)) FROM part UNION ALL
SELECT 'key', count(*), count(*) FILTER (WHERE p_partkey * 100 BETWEEN 1 AND 60000) FROM part""")
def q17_serial_candidates(spark: SparkSession, d: str) -> DataFrame:
    cols = {"size": F.col("p_size"), "price": F.col("p_retailprice"), "key": F.col("p_partkey") * 100}
    one = t(spark, d, "part").agg(F.count("*").alias("n"), *[F.count_if(V.serial_candidate(c)).alias(k) for k, c in cols.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("column_name"), F.col("n").alias("n"), F.col(k).alias("n_serial")) for k in cols])))


_DAY = "CAST(o_orderdate AS DATE)"


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in one of four formats."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd.MM.yyyy")).when(k == 2, F.date_format(day, "MMMM dd, yyyy")).otherwise(F.date_format(day, "yyyy/MM/dd"))
    return t(spark, d, "orders").select("o_orderkey", text.alias("x"))


_DATED = f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime({_DAY}, '%Y-%m-%d') WHEN 1 THEN strftime({_DAY}, '%d.%m.%Y') WHEN 2 THEN strftime({_DAY}, '%B %d, %Y') ELSE strftime({_DAY}, '%Y/%m/%d') END AS x FROM orders"


@query(f"WITH o AS ({_DATED}) " + " UNION ALL ".join(f"SELECT {i} AS format_no, count(try_strptime(x, '{p}')) AS n FROM o" for i, (_, p) in enumerate(X.DATE_FORMATS)))
def q18_date_format_votes(spark: SparkSession, d: str) -> DataFrame:
    one = dated(spark, d).agg(*[F.count(V.as_date(F.col("x"), p)).alias(f"f{i}") for i, (p, _) in enumerate(X.DATE_FORMATS)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("format_no"), F.col(f"f{i}").alias("n")) for i in range(len(X.DATE_FORMATS))])))


@query(f"WITH o AS ({_DATED}) SELECT o_orderkey, coalesce(" + ", ".join(f"try_strptime(x, '{p}')" for _, p in X.DATE_FORMATS) + ") AS at, try_strptime(x, '%d.%m.%Y') AS only_dotted FROM o")
def q19_text_dates(spark: SparkSession, d: str) -> DataFrame:
    return dated(spark, d).select("o_orderkey", V.as_any_date(F.col("x")).alias("at"), V.as_date(F.col("x"), "d.M.yyyy").alias("only_dotted"))


# --- names ---

COLUMN_NAMES = """r_regionkey r_name n_nationkey c_custkey c_acctbal c_mktsegment s_suppkey p_partkey p_brand p_type p_size p_retailprice
o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate l_quantity l_extendedprice l_discount l_tax l_shipdate event_id ts user_id event_type value
doc_id text lang source n_chars embedding label page_id url html item_id conv_id turn role quality toxic year month day fiscal_year birth_date
created_at updated order_date expiration_date page_date start_time invoice_number zip_code account_code unit_price total_count sku phone due_date period""".split()
_NAMES_SQL = "(VALUES " + ", ".join(f"('{n}')" for n in COLUMN_NAMES) + ") AS v(column_name)"


def names(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, COLUMN_NAMES))).alias("column_name"))


@query(f"SELECT column_name, NOT regexp_matches(column_name, '{re2(X.any_of(X.NON_DATE_NAMES))}') AND regexp_matches(column_name, '{re2(X.any_of(X.DATE_NAMES))}') AS suggests_date FROM {_NAMES_SQL}")
def q20_name_suggests_date(spark: SparkSession, d: str) -> DataFrame:
    return names(spark).select("column_name", N.suggests_date_expr(F.col("column_name")).alias("suggests_date"))


_KIND = f"CASE WHEN regexp_matches(column_name, '{X.KIND_TEMPORAL}') THEN 'DECIMAL' " + " ".join(f"WHEN regexp_matches(column_name, '{re2(X.any_of(p))}') THEN '{k}'" for p, k in ((X.KIND_DATES, "TIMESTAMP"), (X.KIND_TEXTS, "VARCHAR"), (X.KIND_NUMBERS, "DECIMAL"))) + " END"


@query(f"SELECT column_name, {_KIND} AS kind FROM {_NAMES_SQL}")
def q21_kind_of_name(spark: SparkSession, d: str) -> DataFrame:
    return names(spark).select("column_name", N.kind_of_name_expr(F.col("column_name")).alias("kind"))


_TYPED = [("o_orderkey", "number"), ("o_orderdate", "date"), ("o_totalprice", "number"), ("l_shipdate", "date"), ("event_type", "text"), ("created_at", "number"), ("unit_price", "date"), ("sku", "number"), ("birth_date", "date")]


@query("SELECT column_name, actual, kind FROM (SELECT column_name, actual, " + _KIND + " AS kind FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TYPED) + ") AS v(column_name, actual)) WHERE (kind = 'DECIMAL' AND actual = 'date') OR (kind IN ('VARCHAR', 'TIMESTAMP') AND actual = 'number')")
def q22_contamination(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("column_name"), F.lit(b).alias("actual")) for a, b in _TYPED])))
    kind = N.kind_of_name_expr(F.col("column_name"))
    return rows.withColumn("kind", kind).where("(kind = 'DECIMAL' and actual = 'date') or (kind in ('VARCHAR', 'TIMESTAMP') and actual = 'number')")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END END AS mixed FROM orders")
def q23_mixed_to_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    cell = F.struct(F.when(k == 1, F.col("o_orderpriority")).alias("s"), F.when(k == 0, F.col("o_custkey").cast("double")).alias("n"), F.when(k == 2, F.col("o_custkey") % 2 == 0).alias("b"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return t(spark, d, "orders").select("o_orderkey", cell.alias("c")).select("o_orderkey", "c.*").select("o_orderkey", grid.text_of().alias("mixed"))


_SAN = "regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_replace(trim(x), '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '/', ''), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query(f"SELECT id, CASE WHEN y = '' THEN 'unnamed' WHEN y IN {sql_list(sorted(X.RESERVED_WORDS))} OR regexp_matches(y, '^[0-9]') THEN 'col_' || y ELSE y END AS name FROM (SELECT id, {_SAN} AS y FROM (SELECT p_partkey AS id, p_name AS x FROM part UNION ALL SELECT -p_partkey - 1, p_type FROM part UNION ALL SELECT 1000000000 + page_id, url FROM pages))")
def q24_sanitize_names(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part")
    x = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x")).union(part.select(-F.col("p_partkey") - 1, "p_type")).union(t(spark, d, "pages").select(F.lit(1000000000) + F.col("page_id"), "url"))
    return x.select("id", N.sanitized(F.col("x")).alias("name"))


@query("SELECT p_partkey, CASE WHEN k = 1 THEN w ELSE w || '_' || CAST(k - 1 AS VARCHAR) END AS name FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_partkey) AS k FROM part)")
def q25_unique_names(spark: SparkSession, d: str) -> DataFrame:
    w = F.split_part("p_name", F.lit(" "), F.lit(1))
    k = F.row_number().over(Window.partitionBy(w).orderBy("p_partkey"))
    return t(spark, d, "part").select("p_partkey", w.alias("w"), k.alias("k")).select("p_partkey", F.when(F.col("k") == 1, F.col("w")).otherwise(F.concat("w", F.lit("_"), (F.col("k") - 1).cast("string"))).alias("name"))


# --- rows and cells ---


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3 AND n_nationkey < (SELECT max(n_nationkey) FROM nation) - 3 AND n_nationkey < 13")
def q26_skip_footer_limit(spark: SparkSession, d: str) -> DataFrame:
    from .operators.rows import keep_rows

    rows = t(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("_ord"), "n_nationkey", "n_name")
    return keep_rows(rows, "_ord", skip=3, footer=4, most=10).drop("_ord")


def customer_cells(spark: SparkSession, d: str) -> DataFrame:
    """customer as cells: rows by key, five columns, the first row number is 1."""
    def cell(col: int, kind: str, value: Column) -> Column:
        parts = {"s": F.lit(None).cast("string"), "n": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean"), "ts": F.lit(None).cast("timestamp_ntz")}
        parts[kind] = value
        return F.struct(F.lit(col).alias("col"), F.lit(kind).alias("ctype"), *[v.alias(k) for k, v in parts.items()])

    cells = F.array(cell(1, "n", F.col("c_custkey").cast("double")), cell(2, "s", F.col("c_name")), cell(3, "n", F.col("c_nationkey").cast("double")), cell(4, "n", F.round(F.col("c_acctbal") * 100)), cell(5, "s", F.col("c_mktsegment")))
    rows = t(spark, d, "customer").select(F.lit("customer").alias("path"), F.lit(0).alias("sheet_index"), F.lit("S").alias("sheet"), (F.col("c_custkey") + 1).cast("int").alias("row"), F.inline(cells))
    return rows.select("path", "sheet_index", "sheet", "row", "col", "ctype", "s", "n", "b", "ts", F.when((F.col("row") % 9 == 0) & (F.col("col") == 4), F.concat(F.lit("A"), F.col("row").cast("string"))).alias("formula"), F.lit("General").alias("number_format"))


_CELL_SQL = """(SELECT CAST(c_custkey + 1 AS INTEGER) AS row, 1 AS col, NULL AS s, CAST(c_custkey AS DOUBLE) AS n FROM customer UNION ALL SELECT CAST(c_custkey + 1 AS INTEGER), 2, c_name, NULL FROM customer
UNION ALL SELECT CAST(c_custkey + 1 AS INTEGER), 3, NULL, CAST(c_nationkey AS DOUBLE) FROM customer UNION ALL SELECT CAST(c_custkey + 1 AS INTEGER), 4, NULL, round(c_acctbal * 100) FROM customer UNION ALL SELECT CAST(c_custkey + 1 AS INTEGER), 5, c_mktsegment, NULL FROM customer) AS cells"""


def plain(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", "s", F.col("n").cast("bigint").alias("n"))


@query(f"SELECT row, col, s, CAST(n AS BIGINT) AS n FROM {_CELL_SQL} WHERE row BETWEEN 5 AND 40 AND col BETWEEN 2 AND 4")
def q27_cell_range(spark: SparkSession, d: str) -> DataFrame:
    return plain(grid.slice_cells(customer_cells(spark, d), 5, 2, 40, 4))


@query(f"""SELECT CAST(row - (SELECT count(*) FROM range(1, 101) h(i) WHERE i % 7 = 0 AND i < row) AS INTEGER) AS row, CAST(col - CASE WHEN col > 3 THEN 1 ELSE 0 END AS INTEGER) AS col, s, CAST(n AS BIGINT) AS n
FROM {_CELL_SQL} WHERE row <= 100 AND row % 7 <> 0 AND col <> 3""")
def q28_drop_hidden(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(1, 101).where("id % 7 = 0").select(F.lit("customer").alias("path"), F.lit("S").alias("sheet"), F.lit("row").alias("axis"), F.col("id").cast("int").alias("idx"), F.lit(True).alias("hidden"))
    cols = spark.range(1).select(F.lit("customer"), F.lit("S"), F.lit("col"), F.lit(3), F.lit(True))
    return plain(grid.drop_hidden(customer_cells(spark, d).where("row <= 100"), rows.union(cols)))


def merges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of ten rows and two columns: 1-10, 11-20, ... in columns 2 and 3."""
    return t(spark, d, "customer").where("c_custkey % 10 = 0").select(F.lit("customer").alias("path"), F.lit("S").alias("sheet"), (F.col("c_custkey") + 1).cast("int").alias("r1"), F.lit(2).alias("c1"), (F.col("c_custkey") + 10).cast("int").alias("r2"), F.lit(3).alias("c2"))


_ANCHOR = "(row - 1) // 10 * 10 + 1"
_MERGED = f"{_ANCHOR} - 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)"


@query(f"""WITH x AS (SELECT * FROM {_CELL_SQL}), m AS (SELECT CAST(c_custkey + 1 AS INTEGER) AS r1 FROM customer WHERE c_custkey % 10 = 0),
p AS (SELECT r1, CAST(r1 + i AS INTEGER) AS row, CAST(j AS INTEGER) AS col FROM m, range(10) a(i), range(2, 4) b(j))
SELECT x.row, x.col, x.s, CAST(x.n AS BIGINT) AS n FROM x LEFT JOIN p ON x.row = p.row AND x.col = p.col WHERE p.row IS NULL
UNION ALL SELECT p.row, p.col, x.s, CAST(x.n AS BIGINT) FROM p JOIN x ON x.row = p.r1 AND x.col = 2""")
def q29_merged_fill(spark: SparkSession, d: str) -> DataFrame:
    return plain(grid.fill_merged(customer_cells(spark, d), merges(spark, d)))


@query(f"SELECT row, col, s, CAST(n AS BIGINT) AS n FROM {_CELL_SQL} WHERE NOT (col IN (2, 3) AND {_MERGED} AND NOT (col = 2 AND row = {_ANCHOR}))")
def q30_merged_first_only(spark: SparkSession, d: str) -> DataFrame:
    return plain(grid.keep_first_of_merged(customer_cells(spark, d), merges(spark, d)))


@query("""SELECT CAST(i AS INTEGER) AS position, a || '__' || b AS two_rows, a AS one_row, 'col_' || CAST(i AS VARCHAR) AS no_rows FROM
(SELECT n_nationkey AS i, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def q31_header_promotion(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("n_name", "r_name").collect()
    top, low = [r["n_name"] for r in rows], [r["r_name"] for r in rows]
    w = len(rows)
    named = zip(grid.header_names([top, low], w), grid.header_names([top], w), grid.header_names([], w))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "position int, two_rows string, one_row string, no_rows string")


@query("SELECT CAST(c_custkey + 1 AS INTEGER) AS row, c_custkey AS a, c_name AS b, CAST(c_nationkey AS BIGINT) AS c, CAST(round(c_acctbal * 100) AS BIGINT) AS e, c_mktsegment AS f FROM customer")
def q32_cells_to_wide(spark: SparkSession, d: str) -> DataFrame:
    w = grid.to_wide(customer_cells(spark, d), [1, 2, 3, 4, 5])
    n = lambda i: F.col(f"c{i}.n").cast("bigint")
    return w.select("row", n(0).alias("a"), F.col("c1.s").alias("b"), n(2).alias("c"), n(3).alias("e"), F.col("c4.s").alias("f"))


# --- structure ---

def event_cells(spark: SparkSession, d: str) -> DataFrame:
    """Sparse sheets, one for each event type: a cell for some of the events, with blank stretches."""
    e = t(spark, d, "events").where("event_id < 5000 and event_id % 11 < 6 and (event_id < 3000 or event_id > 3150)")
    return e.select(F.lit("events").alias("path"), F.lit(0).alias("sheet_index"), F.col("event_type").alias("sheet"), (F.col("event_id") + 1).cast("int").alias("row"), (F.col("user_id") % 7 + 2).cast("int").alias("col"), F.lit("s").alias("ctype"), F.col("event_type").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("formula"), F.lit("General").alias("number_format"))


_EVENTS = "(SELECT event_type AS sheet, CAST(event_id + 1 AS INTEGER) AS row, CAST(user_id % 7 + 2 AS INTEGER) AS col FROM events WHERE event_id < 5000 AND event_id % 11 < 6 AND (event_id < 3000 OR event_id > 3150)) AS cells"


@query(f"""WITH r AS (SELECT sheet, row, min(col) AS lo, max(col) AS hi FROM {_EVENTS} GROUP BY 1, 2), g AS (SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY sheet ORDER BY row) > 101 THEN 1 ELSE 0 END AS gap FROM r),
i AS (SELECT *, sum(gap) OVER (PARTITION BY sheet ORDER BY row) AS island FROM g)
SELECT sheet, min(row) AS start_row, max(row) AS end_row, min(lo) AS start_col, max(hi) AS end_col FROM i WHERE island = 0 GROUP BY 1""")
def q33_data_region(spark: SparkSession, d: str) -> DataFrame:
    return detect.data_region(event_cells(spark, d), ["sheet"])


@query(f"""WITH r AS (SELECT DISTINCT sheet, row FROM {_EVENTS}), n AS (SELECT *, lead(row) OVER (PARTITION BY sheet ORDER BY row) AS nx FROM r), b AS (SELECT sheet, row + 1 AS first, nx - 1 AS last FROM n WHERE nx - row > 1)
SELECT sheet, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(last - first + 1 AS BIGINT) AS length FROM b""")
def q34_blank_runs(spark: SparkSession, d: str) -> DataFrame:
    return detect.consecutive_runs(detect.blank_rows(event_cells(spark, d), ["sheet"]), ["sheet"])


@query(f"""WITH r AS (SELECT DISTINCT sheet, row FROM {_EVENTS}), g AS (SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY sheet ORDER BY row) >= 3 THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY row) + 1 AS table_no FROM g) SELECT sheet, CAST(table_no AS BIGINT) AS table_no, min(row) AS start_row, max(row) AS end_row FROM i GROUP BY 1, 2""")
def q35_tables(spark: SparkSession, d: str) -> DataFrame:
    return detect.tables(event_cells(spark, d), ["sheet"])


def headed_cells(spark: SparkSession, d: str) -> DataFrame:
    """A small sheet for each nation: a title, a header and rows of numbers; every third sheet lacks the numbers."""
    def row(r: int, values: list[Column | None]) -> list[Column]:
        out = []
        for c, v in enumerate(values, 1):
            if v is not None:
                number = isinstance(v, tuple)
                out.append(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit("n" if number else "s").alias("ctype"), (F.lit(None).cast("string") if number else v).alias("s"), (v[0].cast("double") if number else F.lit(None).cast("double")).alias("n")))
        return out

    key = F.col("n_nationkey")
    cells = row(1, [F.concat(F.lit("Report of "), F.col("n_name"))]) + row(2, [F.lit("nation_id"), F.lit("Name"), F.when(key % 2 == 0, "amount").otherwise("Remark!"), F.lit("Region")]) + row(3, [(key,), F.col("n_name"), (key * 10,), F.lit("x y z")]) + row(4, [F.lit("id"), F.lit("note"), None, None])
    rows = t(spark, d, "nation").select(F.lit("nation").alias("path"), F.lit(0).alias("sheet_index"), F.col("n_name").alias("sheet"), "n_nationkey", F.inline(F.array(*cells)))
    rows = rows.where("not (n_nationkey % 3 = 0 and row = 3)")
    return rows.select("path", "sheet_index", "sheet", "row", "col", "ctype", "s", "n", F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.when(F.col("row") == 3, F.lit("A1")).alias("formula"), F.lit("General").alias("number_format"))


_HEADS = "(SELECT n_name AS sheet, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 3 END AS likely, n_nationkey % 3 = 0 AS bare FROM nation)"
_LIKELY2 = "CASE WHEN likely = 4 THEN 4 ELSE 3 END"


@query(f"""SELECT sheet, 1 AS row, 0.3::DOUBLE + 0.1 + 0.0 + CASE WHEN bare THEN 0.0 ELSE 0.2 END + least(0.2, 0.3 * 0.0) + 0.0 AS confidence, CAST(0 AS BIGINT) AS underscores FROM {_HEADS} WHERE false
UNION ALL SELECT sheet, 2, 0.3::DOUBLE + 0.1::DOUBLE + 0.2::DOUBLE + CASE WHEN bare THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END + least(0.2::DOUBLE, 0.3::DOUBLE * (CAST({_LIKELY2} AS DOUBLE) / 4)) + 0.0::DOUBLE, 1 FROM {_HEADS}
UNION ALL SELECT sheet, 4, 0.3::DOUBLE + 0.1::DOUBLE + 0.2::DOUBLE + 0.0::DOUBLE + least(0.2::DOUBLE, 0.3::DOUBLE * (2.0::DOUBLE / 2)) + 0.0::DOUBLE, 0 FROM {_HEADS}""")
def q36_header_scores(spark: SparkSession, d: str) -> DataFrame:
    return detect.header_scores(headed_cells(spark, d), ["sheet"]).select("sheet", "row", "confidence", "underscores")


@query("SELECT n_name AS sheet, 1 AS row FROM nation")
def q37_metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = headed_cells(spark, d)
    rows = detect.row_profile(cells, ["sheet"])
    return detect.metadata_rows(rows, detect.best_header(detect.header_scores(cells, ["sheet"]).where("row = 2"), ["sheet"]), ["sheet"])


_NOTES = ["Prepared by: x", "", "Notes: see above", "plain text", "Source: y", "Confidential", "generated on 2024", ""]
_note_sql = "CASE (o_orderkey * 7 + o_custkey) % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NOTES)) + " ELSE '' END"


@query(f"""WITH l AS (SELECT o_custkey % 50 AS sheet, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey DESC) AS k, trim({_note_sql}) AS t FROM orders),
c AS (SELECT sheet, k, CASE WHEN t = '' THEN 0 WHEN regexp_matches(t, '{re2(X.any_of(X.FOOTERS))}') THEN 1 ELSE 2 END AS kind FROM l WHERE k <= 10),
s AS (SELECT sheet, k, kind, CASE WHEN kind = 0 AND lag(kind, 1) OVER w = 0 AND lag(kind, 2) OVER w = 0 THEN 1 ELSE 0 END AS third FROM c WINDOW w AS (PARTITION BY sheet ORDER BY k)),
e AS (SELECT sheet, least(coalesce(min(k) FILTER (WHERE kind = 2) - 1, 99), coalesce(min(k) FILTER (WHERE third = 1), 99), max(k)) AS n FROM s GROUP BY 1) SELECT sheet, CAST(n AS INTEGER) AS skip_footer FROM e""")
def q38_footer_rows(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 11
    text = F.lit("")
    for i, x in enumerate(_NOTES):
        text = F.when(k == i, x).otherwise(text)
    rows = t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("sheet"), F.col("o_orderkey").alias("row"), text.alias("line"))
    return detect.footer_rows(rows, ["sheet"])


@query(f"""WITH x AS (SELECT 'us' AS k, {sql_grouped(',', '.')} AS x FROM lineitem UNION ALL SELECT 'eu', {sql_grouped('.', ',')} FROM lineitem),
v AS (SELECT k, count(*) FILTER (WHERE regexp_matches(x, '{detect.EU_VOTES[0]}')) + count(*) FILTER (WHERE regexp_matches(x, '{detect.EU_VOTES[1]}')) AS eu, count(*) FILTER (WHERE regexp_matches(x, '{detect.US_VOTES[0]}')) + count(*) FILTER (WHERE regexp_matches(x, '{detect.US_VOTES[1]}')) AS us FROM x GROUP BY 1)
SELECT k, eu AS n_eu, us AS n_us, CASE WHEN eu > us THEN 'de_DE' ELSE 'en_US' END AS locale, CASE WHEN eu > us OR us > 0 THEN least(0.9::DOUBLE, 0.5::DOUBLE + abs(eu - us)::DOUBLE / (eu + us)) ELSE 0.7::DOUBLE END AS confidence FROM v""")
def q39_locale_votes(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("us").alias("k"), grouped(",", ".").alias("x")), F.struct(F.lit("eu").alias("k"), grouped(".", ",").alias("x")))
    eu, us = detect.separator_votes(F.col("x"))
    v = lines(spark, d).select(F.inline(both)).groupBy("k").agg(eu.alias("n_eu"), us.alias("n_us"))
    locale, sure = detect.locale_of(F.col("n_eu"), F.col("n_us"))
    return v.select("k", "n_eu", "n_us", locale.alias("locale"), sure.alias("confidence"))


@query("SELECT n_name AS sheet, 1 AS header_row FROM nation")
def q40_raw_header_row(spark: SparkSession, d: str) -> DataFrame:
    return detect.raw_header_rows(headed_cells(spark, d), ["sheet"])


_PIVOT = X.any_of(X.PIVOT_MARKS)


@query(f"""WITH c AS (SELECT event_type AS sheet, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS row, CASE WHEN event_id % 997 = 0 THEN 'Grand Total' ELSE event_type END AS s FROM events),
a AS (SELECT sheet, count(DISTINCT row) AS n_rows, 1 AS n_cols, bool_or(row <= 20 AND regexp_matches(s, '{_PIVOT}')) AS is_pivot FROM c GROUP BY 1)
SELECT sheet, n_rows, n_cols, is_pivot, CASE WHEN n_rows < 2 THEN 'Too small' WHEN is_pivot THEN 'Pivot table' END AS skip_reason FROM a""")
def q41_triage(spark: SparkSession, d: str) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    cells = t(spark, d, "events").select(F.col("event_type").alias("sheet"), row.alias("row"), F.lit(1).alias("col"), F.when(F.col("event_id") % 997 == 0, "Grand Total").otherwise(F.col("event_type")).alias("s"))
    return detect.triage(cells, ["sheet"], min_rows=2, min_cols=1)


# --- row filters ---


@query("SELECT conv_id, turn, role FROM conversations WHERE NOT (coalesce(regexp_matches(role, '(?i)^sys|error'), false) OR coalesce(regexp_matches(text, '(?i)^sys|error'), false) OR regexp_matches(CAST(conv_id AS VARCHAR), '(?i)^sys|error'))")
def q42_drop_regex(spark: SparkSession, d: str) -> DataFrame:
    return drop_matching(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "(?i)^sys|error").select("conv_id", "turn", "role")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status, o_custkey FROM orders WHERE (o_orderkey % 10 = 0 OR o_orderstatus <> 'F') AND o_custkey <> 7")
def q43_drop_conditions(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("status"), "o_custkey")
    return drop_conditions(rows, [{"column": "status", "value": "F"}, {"column": "o_custkey", "value": 7}, {"column": "unknown", "value": 1}, {"column": "status", "value": None}])


_L = "chr(CAST(65 + (i - 1) % 26 AS INTEGER))"
_L2 = "chr(CAST(65 + ((i - 1) // 26 - 1) % 26 AS INTEGER))"
_L3 = "chr(CAST(65 + (((i - 1) // 26 - 1) // 26 - 1) % 26 AS INTEGER))"


@query(f"SELECT CAST(i AS INTEGER) AS i, CASE WHEN i <= 26 THEN {_L} WHEN i <= 702 THEN {_L2} || {_L} ELSE {_L3} || {_L2} || {_L} END AS letters, CAST(i AS INTEGER) AS back FROM range(1, 16385) r(i)")
def q44_column_letters(spark: SparkSession, d: str) -> DataFrame:
    i = spark.range(1, 16385).select(F.col("id").cast("int").alias("i")).withColumn("letters", letters_of(F.col("i")))
    return i.withColumn("back", index_of(F.col("letters")))


# --- text files ---


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, line): lines of documents in which commas are as they are."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, pos, length(line) - length(replace(line, ',', '')) AS k FROM l)
SELECT doc_id, CASE WHEN arg_min(k, pos) > 0 THEN round(avg(k) / (var_pop(k) + 1), 6) END AS score FROM c GROUP BY 1""")
def q45_delimiter_score(spark: SparkSession, d: str) -> DataFrame:
    return delimiter_score(doc_lines(spark, d), "line", ",", "pos", ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, string_split(unnest(string_split(text, chr(10))), ',') AS f FROM documents)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len(list_filter(f, lambda x: trim(x) <> '')) AS INTEGER) AS filled, round(1 - len(list_filter(f, lambda x: trim(x) <> '')) / len(f), 6) AS empty_share, len(list_filter(f, lambda x: regexp_matches(x, '{re2(X.any_of(X.CSV_METADATA))}'))) > 0 AS metadata FROM l WHERE pos < 15""")
def q46_metadata_rows_of_text(spark: SparkSession, d: str) -> DataFrame:
    filled, share, found = metadata_share(F.split("line", ","))
    return doc_lines(spark, d).where("pos < 15").select("doc_id", "pos", filled.alias("filled"), F.round(share, 6).alias("empty_share"), found.alias("metadata"))


@query(r"SELECT page_id, round(length(regexp_replace(substr(html, 1, 1000), '[^\x20-\x7e\t\n\r]', '', 'g'))::DOUBLE / length(substr(html, 1, 1000)), 6) AS printable FROM pages WHERE length(html) > 0")
def q47_printable_share(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring("html", 1, 1000)
    return t(spark, d, "pages").where("length(html) > 0").select("page_id", F.round(F.length(F.regexp_replace(head, r"[^\x20-\x7e\t\n\r]", "")) / F.length(head), 6).alias("printable"))


_ERR = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(X.EXCEL_ERRORS)) + " ELSE o_orderpriority END"


@query(f"SELECT o_orderkey, CASE WHEN x IN {sql_list(X.EXCEL_ERRORS)} THEN NULL ELSE x END AS clean FROM (SELECT o_orderkey, {_ERR} AS x FROM orders)")
def q48_error_texts(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("o_orderkey") % 10).cast("int")
    x = F.when(k < len(X.EXCEL_ERRORS), F.get(F.array(*map(F.lit, X.EXCEL_ERRORS)), k)).otherwise(F.col("o_orderpriority"))
    return t(spark, d, "orders").select("o_orderkey", V.null_errors(x).alias("clean"))


@query(f"SELECT row, col, CASE WHEN row % 9 = 0 AND col = 4 THEN '=A' || CAST(row AS VARCHAR) ELSE s END AS s, CASE WHEN row % 9 = 0 AND col = 4 THEN NULL ELSE CAST(n AS BIGINT) END AS n FROM {_CELL_SQL}")
def q49_formula_view(spark: SparkSession, d: str) -> DataFrame:
    return plain(grid.formula_view(customer_cells(spark, d)))


@query("SELECT 'region' AS sheet_name, CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS regionkey FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation")
def q50_union_of_sheets(spark: SparkSession, d: str) -> DataFrame:
    from .multisheet import union_all

    region = t(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    nation = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("regionkey"))
    return union_all({"region": region, "nation": nation})


# --- the whole pipeline ---


def messy_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a messy text table: padded flags, currencies and group marks, dates as text, markers of missing values."""
    k = F.col("l_orderkey")
    return lines(spark, d).select(
        F.concat(F.lit("  "), "l_returnflag", F.lit(" \t")).alias("flag"),
        F.concat(F.lit("$"), grouped(",", ".")).alias("price"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd").alias("shipped"),
        F.when(k % 7 == 0, "N/A").when(k % 7 == 1, "").otherwise(F.col("l_linestatus")).alias("status"),
    )


@query("SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (WHERE l_orderkey % 7 > 1) AS n_status, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day FROM lineitem GROUP BY 1")
def q51_clean_table(spark: SparkSession, d: str) -> DataFrame:
    """Profile, decide, project over the messy table, then totals."""
    from .operators.normalize import Normalizer, normalize

    clean, _ = normalize(messy_lines(spark, d), Normalizer(decimal=".", thousands=","))
    return clean.groupBy("flag").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"), F.count("status").alias("n_status"), F.date_format(F.min("shipped"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("shipped"), "yyyy-MM-dd").alias("last_day"))


# --- workbooks and text tables, from bytes to frames; nation and region have a fixed number of rows at every scale ---


def nations(spark: SparkSession, d: str) -> list:
    return t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_regionkey", "n_nationkey").collect()


def workbook(sheets: dict, **more):
    import io

    from .sources.ooxml import write_workbook

    return io.BytesIO(write_workbook(sheets, **more))


def by_region(rows: list) -> dict:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["r_name"], [["Nation Key", "Nation Name"]]).append([r["n_nationkey"], f"  {r['n_name']} "])
    return out


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS region_key FROM nation")
def q52_read_workbook(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with a title above its header and a note below its rows."""
    from .workbook import read_excel

    rows = [[r["n_nationkey"], f" {r['n_name']}  ", r["n_regionkey"]] for r in nations(spark, d)]
    return read_excel(workbook({"Nations": [["Nations and their regions"], ["Generated: 2024-01-15"], [], ["Nation Key", "Nation Name", "Region Key"], *rows, [], ["Prepared by: somebody"]]}))


@query("SELECT n_name AS nation_name, CAST(n_nationkey * 1000 + 0.5 AS DOUBLE) AS amount FROM nation")
def q53_read_text_table(spark: SparkSession, d: str) -> DataFrame:
    """A text table with semicolons, metadata rows, and numbers as 1.000,50."""
    import io

    from .workbook import read_excel

    lines = [f"{r['n_name']};{r['n_nationkey']}.000,50" if r["n_nationkey"] else f"{r['n_name']};0,50" for r in nations(spark, d)]
    return read_excel(io.BytesIO("\n".join(["Nation Name;Amount", *lines]).encode("latin-1")))


@query("SELECT r_name AS sheet_name, n_nationkey AS nation_key, n_name AS nation_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q54_all_sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for each region, read and put under one another; empty and pivot sheets are left out."""
    from .multisheet import read_all_sheets, union_all

    return union_all(read_all_sheets(workbook(by_region(nations(spark, d)) | {"Empty": [], "Pivot": [["Row Labels", "Sum of x"], ["a", 1], ["b", 2]]})))


@query("SELECT r_name AS name, count(*) AS n_rows, false AS is_pivot FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'Pivot', 2, true")
def q55_sheet_triage(spark: SparkSession, d: str) -> DataFrame:
    """What a workbook's sheets are, without reading them into frames; rows without the header."""
    from .multisheet import analyze_excel

    found = analyze_excel(workbook(by_region(nations(spark, d)) | {"Pivot": [["Row Labels", "Sum of x"], ["a", 1], ["b", 2]]}))
    return spark.createDataFrame([(i.name, i.row_count - 1, i.is_pivot) for i in found], "name string, n_rows long, is_pivot boolean")


@query("SELECT n_regionkey AS region, n_name AS nation FROM nation WHERE n_nationkey % 5 <> 0")
def q56_merged_and_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Regions as merged cells beside their nations, every fifth nation hidden."""
    from .workbook import read_excel

    rows = nations(spark, d)
    cells, merges, hidden, begin = [["Region", "Nation"]], [], [], 2
    for i, r in enumerate(rows):
        new = not i or rows[i - 1]["n_regionkey"] != r["n_regionkey"]
        begin = i + 2 if new else begin
        cells.append([r["n_regionkey"] if new else None, r["n_name"]])
        if (i + 1 == len(rows) or rows[i + 1]["n_regionkey"] != r["n_regionkey"]) and i + 2 > begin:
            merges.append(f"A{begin}:A{i + 2}")
        if r["n_nationkey"] % 5 == 0:
            hidden.append(i + 2)
    return read_excel(workbook({"S": cells}, merges={"S": merges}, hidden_rows={"S": hidden}), header_detection_mode="manual")


@query("SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) + 1 AS BIGINT) AS at, n_nationkey AS a, n_name AS b FROM nation")
def q57_cells_and_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range of cells by its address, row by row."""
    from .workbook import GridBook

    rows = nations(spark, d)
    with GridBook(workbook({"My Sheet": [["Key", "Name"], *([r["n_nationkey"], r["n_name"]] for r in rows)]}), spark=spark) as book:
        found = book["My Sheet"][f"$A$2:B{len(rows) + 1}"]
        first = book.get_cell_by_ref("'My Sheet'!B2").value
    assert first == found[0][1]
    return spark.createDataFrame([(i + 2, a, b) for i, (a, b) in enumerate(found)], "at long, a long, b string")


@query("SELECT r_regionkey AS k, CAST(sum(r_regionkey) OVER (ORDER BY r_regionkey) * 10 + 1 AS BIGINT) AS v FROM region")
def q58_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas over ranges, evaluated without cached values."""
    from .workbook import GridBook

    keys = [r["r_regionkey"] for r in t(spark, d, "region").orderBy("r_regionkey").collect()]
    with GridBook(workbook({"F": [["k", "v"], *([k, f"=SUM(A2:A{i + 2})*10+1"] for i, k in enumerate(keys))]}), spark=spark) as book:
        found = [(k, int(book.get_cell("F", i + 2, 2).value)) for i, k in enumerate(keys)]
    return spark.createDataFrame(found, "k long, v long")


@query("SELECT n_name AS sheet, 'de_DE' AS locale FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'en_US' FROM nation WHERE n_nationkey % 2 = 1")
def q59_sheet_locales(spark: SparkSession, d: str) -> DataFrame:
    """Locales by the texts near a region's start, over all sheets at once."""
    rows = t(spark, d, "nation").select(F.col("n_name").alias("sheet"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("row"), (F.col("n_nationkey") % 2 == 0).alias("_eu"))
    text = F.when(F.col("_eu"), F.concat(F.lit("1."), (F.col("row") + 100).cast("string"), F.lit(",50"))).otherwise(F.concat(F.lit("1,"), (F.col("row") + 100).cast("string"), F.lit(".50")))
    cells = rows.select("sheet", "row", F.lit(1).alias("col"), F.lit("s").alias("ctype"), text.alias("s"), F.lit(None).cast("string").alias("number_format"))
    return detect.locales(cells, ["sheet"]).select("sheet", "locale")
