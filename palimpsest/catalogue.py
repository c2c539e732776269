"""The registered queries over the delivered tables, and their SQL twins.

Filters are asked for as sets (`hits`), over whole tables; where order and page are what is shown, they are in both.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Bool, Change, Date, Engine, Enum, Numeric, Query, String, all_of, any_of, between, contains, eq, ge, gt, le, lt, matches, ne, negate
from .operators.deltas import VALUES
from .sources.items import parse_column

ORDERS = {"o_totalprice": Numeric(), "o_custkey": Numeric(), "o_orderdate": Date(), "o_orderstatus": Enum(("F", "O", "P")), "o_orderpriority": String()}
PART = {"p_name": String(term=True), "p_brand": String(), "p_type": String(), "p_size": Numeric(), "p_retailprice": Numeric()}
CUSTOMER = {"c_name": String(), "c_acctbal": Numeric(), "c_mktsegment": Enum(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
DOCUMENTS = {"text": String(term=True), "lang": String(), "source": String(), "n_chars": Numeric()}
LABELS = {"quality": Bool(), "toxic": Bool()}
EVENTS = {"event_type": Enum(("click", "error", "purchase", "signup", "view")), "value": Numeric(), "ts": Date(), "props.k": Numeric()}
CONVERSATIONS = {"role": Enum(("assistant", "system", "user")), "text": String(term=True)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, d: str, gaps: bool = False) -> Engine:
    """gaps: orders of status P lack it, and those up to 10,000 their price."""
    items = read(spark, d, "orders")
    if gaps:
        items = items.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))).withColumn("o_totalprice", F.when(F.col("o_totalprice") > 10000, F.col("o_totalprice")))
    return Engine.with_entities(spark, {"orders": (items, "o_orderkey", ORDERS)})


def part(spark: SparkSession, d: str) -> Engine:
    return Engine.with_entities(spark, {"part": (read(spark, d, "part"), "p_partkey", PART)})


def customer(spark: SparkSession, d: str) -> Engine:
    return Engine.with_entities(spark, {"customer": (read(spark, d, "customer"), "c_custkey", CUSTOMER)})


def documents(spark: SparkSession, d: str) -> Engine:
    return Engine.with_entities(spark, {"documents": (read(spark, d, "documents"), "doc_id", DOCUMENTS)})


def labels(spark: SparkSession, d: str) -> Engine:
    items = read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return Engine.with_entities(spark, {"labels": (items, "doc_id", LABELS)})


def events(spark: SparkSession, d: str) -> Engine:
    items = parse_column(read(spark, d, "events"), "props", "k double")
    return Engine.with_entities(spark, {"events": (items, "event_id", EVENTS)})


def conversations(spark: SparkSession, d: str) -> Engine:
    items = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    return Engine.with_entities(spark, {"conversations": (items, "id", CONVERSATIONS)})


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, dots in names as underscores: alike in any client."""
    return df.select(*[(F.date_format(f"`{c}`", "yyyy-MM-dd") if t in ("date", "timestamp", "timestamp_ntz") else F.col(f"`{c}`")).alias(c.replace(".", "_")) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The columns of each entity in SQL.
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority"
GAPS = "(SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_totalprice > 10000 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
LABEL_COLUMNS = "doc_id, quality = 1 AS quality, toxic = 1 AS toxic"
# Terms of a text, each between spaces.
WHITE = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x0b]+"
TERMS = f"(' ' || array_to_string(list_filter(list_transform(regexp_split_to_array(%s, '{WHITE}'), lambda w: translate(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda w: w <> ''), ' ') || ' ')"


def has(column: str, terms: str) -> str:
    return f"contains({TERMS % column}, ' {terms} ')"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: plain(run(spark, d))
    ORACLES[name] = sql


def hits(name: str, entity: Callable, filter_or_text, sql: str, **how) -> None:
    """All hits of a filter, given as a tree or in the language."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = entity(spark, d, **how)
        q = Query.parse(filter_or_text) if isinstance(filter_or_text, str) else Query(entity.__name__).where(filter_or_text)
        return q.hits(engine)

    add(name, run, sql)


def page(name: str, entity: Callable, text: str, sql: str, **how) -> None:
    add(name, lambda spark, d: Query.parse(text).run(entity(spark, d, **how)), sql)


def order_hits(name: str, filter_or_text, where: str, gaps: bool = False) -> None:
    hits(name, orders, filter_or_text, f"SELECT {ORDER_COLUMNS} FROM {GAPS if gaps else 'orders'} WHERE {where}", gaps=gaps)


# Predicates by type.
hits("num_eq", part, "FROM part WHERE p_size = 10", "SELECT * FROM part WHERE p_size = 10")
hits("num_ne", part, "FROM part WHERE p_size != 10", "SELECT * FROM part WHERE p_size <> 10")
order_hits("num_between", between("o_totalprice", 1000, 50000), "o_totalprice BETWEEN 1000 AND 50000")
order_hits("num_gt", "FROM orders WHERE o_totalprice > 300000", "o_totalprice > 300000")
order_hits("num_ge", ge("o_custkey", 500), "o_custkey >= 500")
order_hits("num_lt", "FROM orders WHERE o_totalprice < 20000.5", "o_totalprice < 20000.5")
order_hits("num_le", le("o_custkey", 500), "o_custkey <= 500")
hits("num_contains_as_eq", part, contains("p_size", 7), "SELECT * FROM part WHERE p_size = 7")
hits("num_match_as_eq", part, matches("p_size", 7.0), "SELECT * FROM part WHERE p_size = 7")
order_hits("date_eq", 'FROM orders WHERE o_orderdate = "1998-03-05"', "CAST(o_orderdate AS DATE) = DATE '1998-03-05'")
order_hits("date_ne", 'FROM orders WHERE o_orderdate != "1998-03-05"', "CAST(o_orderdate AS DATE) <> DATE '1998-03-05'")
order_hits("date_between", between("o_orderdate", "1996-02-01", "1996-04-30"), "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-04-30'")
order_hits("date_ge", 'FROM orders WHERE o_orderdate >= "2000-01-01"', "CAST(o_orderdate AS DATE) >= DATE '2000-01-01'")
order_hits("date_gt", gt("o_orderdate", dt.date(2001, 1, 1)), "CAST(o_orderdate AS DATE) > DATE '2001-01-01'")
order_hits("date_lt", lt("o_orderdate", "1995-06-01"), "CAST(o_orderdate AS DATE) < DATE '1995-06-01'")
order_hits("date_le", le("o_orderdate", "1995-06-01"), "CAST(o_orderdate AS DATE) <= DATE '1995-06-01'")
order_hits("date_contains_as_eq", contains("o_orderdate", "1998-03-05"), "CAST(o_orderdate AS DATE) = DATE '1998-03-05'")
order_hits("str_eq", 'FROM orders WHERE o_orderpriority = "1-URGENT"', "o_orderpriority = '1-URGENT'")
order_hits("str_ne", 'FROM orders WHERE o_orderpriority != "1-URGENT"', "o_orderpriority <> '1-URGENT'")
order_hits("enum_eq", eq("o_orderstatus", "F"), "o_orderstatus = 'F'")
order_hits("enum_match_as_eq", matches("o_orderstatus", "P"), "o_orderstatus = 'P'")
hits("bool_eq", labels, "FROM labels WHERE toxic = TRUE", f"SELECT {LABEL_COLUMNS} FROM labels WHERE toxic = 1")
hits("bool_ne", labels, ne("quality", True), f"SELECT {LABEL_COLUMNS} FROM labels WHERE quality <> 1")

# Logic, two-valued over missing values.
order_hits("and2", 'FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = "O"', "o_totalprice > 100000 AND o_orderstatus = 'O'")
order_hits("or2", 'FROM orders WHERE o_totalprice > 400000 OR o_orderdate <= "1995-02-01"', "o_totalprice > 400000 OR CAST(o_orderdate AS DATE) <= DATE '1995-02-01'")
order_hits("not_missing", 'FROM orders WHERE o_orderstatus != "O"', "o_orderstatus IS NULL OR o_orderstatus <> 'O'", gaps=True)
order_hits("not_range_missing", negate(ge("o_totalprice", 50000)), "o_totalprice IS NULL OR o_totalprice < 50000", gaps=True)
order_hits(
    "not_nested",
    negate(all_of(any_of(eq("o_orderstatus", "F"), negate(between("o_totalprice", 20000, 200000))), ne("o_orderpriority", "5-LOW"))),
    "NOT ((COALESCE(o_orderstatus = 'F', FALSE) OR NOT COALESCE(o_totalprice BETWEEN 20000 AND 200000, FALSE)) AND NOT COALESCE(o_orderpriority = '5-LOW', FALSE))",
    gaps=True,
)
order_hits("right_assoc_chain", 'FROM orders WHERE o_orderstatus = "F" AND o_totalprice > 300000 OR o_orderpriority = "5-LOW"', "o_orderstatus = 'F' AND (o_totalprice > 300000 OR o_orderpriority = '5-LOW')")
order_hits("paren_group", 'FROM orders WHERE (o_orderstatus = "F" AND o_totalprice > 300000) OR o_orderpriority = "5-LOW"', "(o_orderstatus = 'F' AND o_totalprice > 300000) OR o_orderpriority = '5-LOW'")
order_hits("empty_and", all_of(), "FALSE")
order_hits("not_empty_or", negate(any_of()), "TRUE")
order_hits("full_scan", None, "TRUE")

# Text.
hits("doc_contains", documents, contains("text", "Language"), f"SELECT * FROM documents WHERE {has('text', 'language')}")
hits("doc_contains_multiword", documents, contains("text", "open source"), f"SELECT * FROM documents WHERE {has('text', 'opensource')}")
hits("doc_match", documents, 'FROM documents WHERE text MATCH "MIT License"', f"SELECT * FROM documents WHERE {has('text', 'mit license')}")
def scripts(spark: SparkSession, d: str) -> Engine:
    """Documents, every third with Hindi and Thai words before its text; vowel signs are alphabetic, joined words are others."""
    words = F.when(F.col("doc_id") % 3 == 0, "हिन्दी भाषा, นี่ ดี-มาก ").when(F.col("doc_id") % 3 == 1, "हिन्द डी ดีมากนี่ ").otherwise("")
    return Engine.with_entities(spark, {"scripts": (read(spark, d, "documents").select("doc_id", F.concat(words, "text").alias("text")), "doc_id", {"text": String(term=True)})})


SCRIPTS = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'हिन्दी भाषा, นี่ ดี-มาก ' WHEN 1 THEN 'हिन्द डी ดีมากนี่ ' ELSE '' END || text AS text FROM documents WHERE doc_id % 3 = "
hits("term_hindi", scripts, contains("text", "हिन्दी"), SCRIPTS + "0")
hits("term_hindi_phrase", scripts, matches("text", "हिन्दी भाषा นี่"), SCRIPTS + "0")
hits("term_thai", scripts, 'FROM scripts WHERE text CONTAINS "ดีมาก" OR text CONTAINS "ดีมากนี่"', SCRIPTS + "0 UNION ALL " + SCRIPTS + "1")
hits("doc_match_repeat", documents, matches("text", "the the"), f"SELECT * FROM documents WHERE {has('text', 'the the')}")
hits("doc_match_empty", documents, matches("text", " ... "), "SELECT * FROM documents WHERE FALSE")
hits("doc_not_match", documents, negate(matches("text", "public license")), f"SELECT * FROM documents WHERE NOT COALESCE({has('text', 'public license')}, FALSE)")
hits("part_name_match", part, 'FROM part WHERE p_name CONTAINS "1" OR p_name MATCH "part 2"', f"SELECT * FROM part WHERE {has('p_name', '1')} OR {has('p_name', 'part 2')}")
hits("conversation_contains", conversations, all_of(eq("role", "user"), contains("text", "you")), f"SELECT conv_id * 1000 + turn AS id, role, text FROM conversations WHERE role = 'user' AND {has('text', 'you')}")

# Order and page.
page("default_order_limit500", orders, "FROM orders", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderkey LIMIT 500")
page("sort_asc", orders, 'FROM orders WHERE o_orderstatus = "F" ORDER BY o_totalprice ASC LIMIT 100', f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 100")
page("sort_desc", orders, "FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC LIMIT 10", f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
page("sort_string_ties", orders, "FROM orders ORDER BY o_orderpriority DESC LIMIT 700", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 700")
page("sort_date", orders, "FROM orders ORDER BY o_orderdate OFFSET 5 LIMIT 50", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 50 OFFSET 5")
page("sort_missing_last_asc", orders, "FROM orders WHERE o_totalprice < 20000 ORDER BY o_orderstatus LIMIT 400", f"SELECT {ORDER_COLUMNS} FROM {GAPS} WHERE o_totalprice < 20000 ORDER BY o_orderstatus ASC NULLS LAST, o_orderkey LIMIT 400", gaps=True)
page("sort_missing_last_desc", orders, "FROM orders ORDER BY o_orderstatus DESC LIMIT 12000", f"SELECT {ORDER_COLUMNS} FROM {GAPS} ORDER BY o_orderstatus DESC NULLS LAST, o_orderkey LIMIT 12000", gaps=True)
page("sort_enum", events, "FROM events ORDER BY event_type DESC LIMIT 300", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS props_k FROM events ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END DESC, event_id LIMIT 300")
page("sort_bool", labels, "FROM labels ORDER BY toxic DESC LIMIT 50", f"SELECT {LABEL_COLUMNS} FROM labels ORDER BY toxic = 1 DESC, doc_id LIMIT 50")
page("page_offset_limit", customer, "FROM customer ORDER BY c_acctbal OFFSET 40 LIMIT 25", "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25 OFFSET 40")

# Facets.
NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def counted(source: str, hit: str, fields: dict[str, str]) -> str:
    """fields: field -> SQL of its label."""
    return " UNION ALL ".join(f"SELECT '{f}' AS field, {v} AS value, count(*) FILTER (WHERE {hit}) AS count FROM {source} WHERE {v} IS NOT NULL GROUP BY {v}" for f, v in fields.items())


ORDER_FACETS = {"o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus", "o_totalprice": NUMBER.format("o_totalprice")}
PART_FACETS = {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "CAST(p_size AS VARCHAR)", "p_retailprice": NUMBER.format("p_retailprice")}


def options(name: str, entity: Callable, text: str, sql: str, **how) -> None:
    add(name, lambda spark, d: Query.parse(text).options(entity(spark, d, **how)), sql)


options("facet_all", part, "FROM part", counted("part", "TRUE", PART_FACETS))
options("facet_filtered_zero", orders, 'FROM orders WHERE o_orderstatus = "F" AND o_totalprice > 200000', counted("orders", "o_orderstatus = 'F' AND o_totalprice > 200000", ORDER_FACETS))
options("facet_missing", orders, "FROM orders WHERE o_totalprice < 50000", counted(GAPS, "o_totalprice < 50000", ORDER_FACETS), gaps=True)
options("facet_numeric_labels", events, 'FROM events WHERE event_type = "purchase"', counted("(SELECT event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)", "event_type = 'purchase'", {"event_type": "event_type", "value": NUMBER.format("value"), "props.k": NUMBER.format("k")}))
options("facet_bool", labels, "FROM labels WHERE quality = true", counted("labels", "quality = 1", {"quality": "CAST(quality = 1 AS VARCHAR)", "toxic": "CAST(toxic = 1 AS VARCHAR)"}))
options("facet_sort_ignored", customer, 'FROM customer WHERE c_mktsegment = "BUILDING" ORDER BY c_name LIMIT 1', counted("customer", "c_mktsegment = 'BUILDING'", {"c_name": "c_name", "c_mktsegment": "c_mktsegment", "c_acctbal": NUMBER.format("c_acctbal")}))

# Deltas. Each is a rule over whole orders, so that SQL can state the outcome as a CASE.


def delta(items: DataFrame, field: str, after, date, branch: int | None = None, seq: int = 0, where=None, id_shift: int = 0) -> DataFrame:
    """A change of the field to `after` (a Column) for all items, or those where the Column holds."""
    kind = ORDERS[field].kind
    rows = items.where(where) if where is not None else items
    cells = [(after.cast({"v_str": "string", "v_num": "double", "v_date": "date"}[v]) if v == kind else F.lit(None)).alias(v) for v in VALUES]
    return rows.select(F.lit(0 if branch is None else branch + 1).alias("branch_key"), (F.lit(date).cast("date") if isinstance(date, str) else date).alias("as_of"), F.lit(seq).alias("seq"), (F.col("o_orderkey") + id_shift).alias("id"), F.lit(field).alias("field"), *cells)


def changed(name: str, text: str, make: Callable[[DataFrame], list[DataFrame]], sql: str) -> None:
    """A search or, for `facet_` names, facets over orders with deltas."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = orders(spark, d)
        for x in make(engine.entity("orders").items):
            engine.attach_deltas("orders", x)
        q = Query.parse(text)
        return q.options(engine) if name.startswith("facet_") else q.run(engine) if q.sort else q.hits(engine)

    add(name, run, sql)


def overlaid(**fields: str) -> str:
    """Orders with some columns replaced, in the overlay's types."""
    each = {"o_orderkey": "o_orderkey", "o_custkey": "CAST(o_custkey AS DOUBLE)", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice", "o_orderdate": "CAST(o_orderdate AS DATE)", "o_orderpriority": "o_orderpriority"} | fields
    return "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in each.items()) + " FROM orders)"


def seen(where: str = "TRUE", **fields: str) -> str:
    return f"SELECT {ORDER_COLUMNS} FROM {overlaid(**fields)} WHERE {where}"


def urgent():
    return F.col("o_orderpriority") == "1-URGENT"


def low():
    return F.col("o_orderpriority") == "5-LOW"


PRICE_CUT = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 1000 ELSE o_totalprice END"
STATUS = "CASE WHEN o_orderpriority = '5-LOW' THEN 'F' ELSE o_orderstatus END"
changed("delta_main", 'FROM orders WHERE o_totalprice > 200000 AS OF "2020-01-01"', lambda o: [delta(o, "o_totalprice", F.col("o_totalprice") - 1000, "2019-01-01", where=urgent())], seen("o_totalprice > 200000", o_totalprice=PRICE_CUT))
changed("delta_no_scope", "FROM orders WHERE o_totalprice > 200000", lambda o: [delta(o, "o_totalprice", F.lit(0.0), "2019-01-01")], f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_totalprice > 200000")
changed("delta_branch", 'FROM orders WHERE o_orderstatus = "F" BRANCH 1 AS OF "2020-01-01"', lambda o: [delta(o, "o_orderstatus", F.lit("F"), "2019-01-01", branch=1, where=low())], seen("o_orderstatus = 'F'", o_orderstatus=STATUS))
changed(
    "delta_branch_isolated",
    'FROM orders WHERE o_orderstatus = "F" BRANCH 0 AS OF "2020-01-01"',
    lambda o: [delta(o, "o_orderstatus", F.lit("F"), "2019-01-01", branch=1), delta(o, "o_orderstatus", F.lit("F"), "2019-01-01"), delta(o, "o_orderstatus", F.lit("F"), "2019-01-01", branch=0, where=low())],
    seen("o_orderstatus = 'F'", o_orderstatus=STATUS),
)
changed("delta_asof_excludes_future", 'FROM orders WHERE o_orderstatus = "F" AS OF "2019-06-01"', lambda o: [delta(o, "o_orderstatus", F.lit("F"), "2019-06-01", where=low()), delta(o, "o_orderstatus", F.lit("P"), "2019-06-02")], seen("o_orderstatus = 'F'", o_orderstatus=STATUS))
changed(
    "delta_latest_wins",
    'FROM orders WHERE o_totalprice < 100000 AS OF "2020-01-01"',
    lambda o: [delta(o, "o_totalprice", F.col("o_totalprice") - 1000, "2019-03-01", where=urgent()), delta(o, "o_totalprice", F.lit(1.0), "2019-02-01", seq=9, where=urgent()), delta(o, "o_totalprice", F.lit(2.0), "2018-01-01", seq=5)],
    seen("o_totalprice < 100000", o_totalprice="CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 1000 ELSE 2.0 END"),
)
changed(
    "delta_same_day_last_wins",
    'FROM orders WHERE o_totalprice < 100000 AS OF "2019-02-01"',
    lambda o: [delta(o, "o_totalprice", F.col("o_totalprice") - 1000, "2019-02-01", seq=2, where=urgent()), delta(o, "o_totalprice", F.lit(1.0), "2019-02-01", seq=1, where=urgent())],
    seen("o_totalprice < 100000", o_totalprice=PRICE_CUT),
)
changed("delta_text", 'FROM orders WHERE o_orderpriority = "0-NOW" AS OF "2020-01-01"', lambda o: [delta(o, "o_orderpriority", F.lit("0-NOW"), "2019-01-01", where=F.col("o_totalprice") > 300000)], seen("o_orderpriority = '0-NOW'", o_orderpriority="CASE WHEN o_totalprice > 300000 THEN '0-NOW' ELSE o_orderpriority END"))
changed("delta_date", 'FROM orders WHERE o_orderdate >= "2001-07-01" AS OF "2020-01-01"', lambda o: [delta(o, "o_orderdate", F.lit("2002-05-06"), "2019-01-01", where=urgent())], seen("o_orderdate >= DATE '2001-07-01'", o_orderdate="CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '2002-05-06' ELSE CAST(o_orderdate AS DATE) END"))
changed("delta_unknown_id", 'FROM orders WHERE o_totalprice > 400000 AS OF "2020-01-01"', lambda o: [delta(o, "o_totalprice", F.lit(500000.0), "2019-01-01", id_shift=10**12)], seen("o_totalprice > 400000"))
changed("delta_sort", 'FROM orders AS OF "2020-01-01" ORDER BY o_totalprice DESC LIMIT 200', lambda o: [delta(o, "o_totalprice", F.col("o_totalprice") - 1000, "2019-01-01", where=urgent())], seen(o_totalprice=PRICE_CUT) + " ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
changed(
    "delta_filter_multi_field",
    'FROM orders WHERE o_orderstatus = "F" AND o_totalprice > 150000 AND o_custkey < 700 BRANCH 7 AS OF "2020-01-01"',
    lambda o: [delta(o, "o_orderstatus", F.lit("F"), "2019-01-01", branch=7, where=low()), delta(o, "o_totalprice", F.col("o_totalprice") - 1000, "2019-01-02", branch=7, seq=1, where=urgent()), delta(o, "o_custkey", F.col("o_custkey") + 1, "2019-01-03", branch=7, seq=2, where=urgent())],
    seen("o_orderstatus = 'F' AND o_totalprice > 150000 AND o_custkey < 700", o_orderstatus=STATUS, o_totalprice=PRICE_CUT, o_custkey="CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey + 1 AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END"),
)
changed(
    "facet_scoped",
    'FROM orders WHERE o_totalprice > 200000 AS OF "2020-01-01"',
    lambda o: [delta(o, "o_orderstatus", F.lit("F"), "2019-01-01", where=F.col("o_orderstatus") == "P"), delta(o, "o_totalprice", F.col("o_totalprice") - 1000, "2019-01-01", seq=1, where=urgent())],
    counted(overlaid(o_orderstatus="CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END", o_totalprice=PRICE_CUT), "o_totalprice > 200000", ORDER_FACETS | {"o_custkey": NUMBER.format("o_custkey")}),
)

# Writes and the JSON source.


def upserted(spark: SparkSession, d: str) -> DataFrame:
    engine = orders(spark, d)
    items = engine.entity("orders").items
    dearer = items.where("o_totalprice > 300000").withColumn("o_orderstatus", F.lit("P"))
    engine.add("orders", dearer.union(dearer.withColumn("o_orderkey", F.col("o_orderkey") + 10**12)))
    return Query("orders").hits(engine)


def removed(spark: SparkSession, d: str) -> DataFrame:
    from .operators.upsert import remove

    items = read(spark, d, "orders")
    return remove(items, items.where("o_totalprice > 100000"), "o_orderkey")


def cleared(spark: SparkSession, d: str) -> DataFrame:
    engine = customer(spark, d)
    engine.clear("customer")
    return Query("customer").hits(engine)


PRICED = ORDER_COLUMNS.replace("o_orderstatus", "'P' AS o_orderstatus")
add("upsert", upserted, f"SELECT {ORDER_COLUMNS} FROM orders WHERE NOT o_totalprice > 300000 UNION ALL SELECT {PRICED} FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT {PRICED.replace('o_orderkey,', 'o_orderkey + 1000000000000 AS o_orderkey,')} FROM orders WHERE o_totalprice > 300000")
add("remove", removed, f"SELECT {ORDER_COLUMNS} FROM orders WHERE NOT o_totalprice > 100000")
add("clear", cleared, "SELECT CAST(0 AS BIGINT) AS id WHERE FALSE")
add("flatten_props", lambda spark, d: Query("events").where(ge("props.k", 50)).hits(events(spark, d)), "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS props_k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
add("unknown_entity", lambda spark, d: Query.parse("FROM nobody WHERE a = 1").run(orders(spark, d)), "SELECT CAST(0 AS BIGINT) AS id WHERE FALSE")
# 2,000 dates, of which the search sees those up to its own.
changed(
    "delta_many_dates",
    'FROM orders WHERE o_totalprice < 100000 AS OF "2018-06-01"',
    lambda o: [delta(o, "o_totalprice", F.col("o_totalprice") - 1000, F.date_add(F.lit("2015-01-01").cast("date"), F.pmod("o_orderkey", F.lit(2000)).cast("int")))],
    seen("o_totalprice < 100000", o_totalprice="CASE WHEN DATE '2015-01-01' + CAST(o_orderkey % 2000 AS INTEGER) <= DATE '2018-06-01' THEN o_totalprice - 1000 ELSE o_totalprice END"),
)


def store_deltas(spark: SparkSession, d: str) -> DataFrame:
    engine = orders(spark, d)
    engine.store_deltas("orders", "2019-01-01", [Change(1, "o_totalprice", 5), Change(2, "o_totalprice", 6.5), Change(1, "o_totalprice", 7), Change(3, "o_orderstatus", "P")])
    engine.store_deltas("orders", "2019-02-01", [Change(2, "o_totalprice", 8)], branch=4)
    return engine.hits('FROM orders WHERE o_totalprice < 10000 OR o_orderstatus = "P" AS OF "2019-01-15"')


add("store_deltas", store_deltas, seen("o_totalprice < 10000 OR o_orderstatus = 'P'", o_totalprice="CASE o_orderkey WHEN 1 THEN 7.0 WHEN 2 THEN 6.5 ELSE o_totalprice END", o_orderstatus="CASE o_orderkey WHEN 3 THEN 'P' ELSE o_orderstatus END"))


def delta_match(spark: SparkSession, d: str) -> DataFrame:
    """Terms over an overlay: some texts are changed, and are found by their new words only."""
    engine = documents(spark, d)
    cells = [(F.lit("The  new-words, here").alias(v) if v == "v_str" else F.lit(None).alias(v)) for v in VALUES]
    items = engine.entity("documents").items
    engine.attach_deltas("documents", items.where("doc_id % 5 = 0").select(F.lit(0).alias("branch_key"), F.lit("2020-01-01").cast("date").alias("as_of"), F.lit(0).alias("seq"), F.col("doc_id").alias("id"), F.lit("text").alias("field"), *cells))
    return engine.hits('FROM documents WHERE text MATCH "newwords here" OR text CONTAINS "license" AS OF "2020-01-01"')


add("delta_match", delta_match, f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'The  new-words, here' ELSE text END AS text, lang, source, CAST(n_chars AS DOUBLE) AS n_chars FROM documents WHERE doc_id % 5 = 0 OR {has('text', 'license')}")
add("get_items", lambda spark, d: orders(spark, d).get("orders", 7, 3, 3, -1), f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderkey IN (3, 7, -1)")


def option_maps(spark: SparkSession, d: str) -> DataFrame:
    """Facets as maps of each field, dates with an empty one: how many values and what count a field's maps hold."""
    maps = orders(spark, d).option_maps('FROM orders WHERE o_orderstatus = "F"')
    held = maps.select("field", F.size("values").cast("long").alias("n_values"), F.aggregate(F.map_values("values"), F.lit(0).cast("long"), lambda a, x: a + x).alias("hits"))
    return held.groupBy("field").agg(F.sum("n_values").alias("n_values"), F.sum("hits").alias("hits"))


FIELDS = ("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
add("option_maps", option_maps, " UNION ALL ".join(f"SELECT '{f}' AS field, COUNT(DISTINCT {f}) AS n_values, COUNT(*) FILTER (o_orderstatus = 'F' AND {f} IS NOT NULL) AS hits FROM orders" for f in FIELDS) + " UNION ALL SELECT 'o_orderdate', 0, 0")
