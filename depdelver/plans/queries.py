"""Queries for the driver, one or more for each operator of the engine, and their SQL.

All run over whole tables; ``fd_row_limit`` alone limits rows, which is what it is about.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depdelver.functions import bits
from depdelver.operators import agree, lattice, metrics, partitions, validate
from depdelver.operators.codes import encode, written
from depdelver.operators.partitions import name
from depdelver.operators.prefixes import PrefixTables
from depdelver.operators.sample import agree_sets
from depdelver.plans.discover import discover_fds
from depdelver.sources.csv import CsvDescriptor, render_line, write_text
from depdelver.session import cut, drop_cut, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def query(key: str, sql: str | None = None):
    def add(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*COLUMNS[table])


def place(spark: SparkSession) -> tuple[str, str]:
    """A folder of its own for a file that is written and read, and the name in it."""
    return f"{shared_dir(spark)}/queries", uuid.uuid4().hex


# -- Discovery ---------------------------------------------------------------------------------


def fd_sql(source: str, columns: list[str], k: int | None = None) -> str:
    """All minimal dependencies by partition counts: CTEs that end in ``m`` (lhs mask, rhs), and ``a``."""
    n = len(columns)
    full = (1 << n) - 1
    if k is None:
        groups = f"CUBE ({', '.join(columns)})"
    else:
        sets = [s for j in range(k + 2) for s in combinations(columns, j)]
        groups = f"GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in sets)})"
    values = ", ".join(f"({i}, {1 << n - 1 - i}, '{c}')" for i, c in enumerate(columns))
    limit = "" if k is None else f" WHERE bit_count(p.mask) <= {k}"
    return f"""
WITH src AS ({source}),
g AS (SELECT {full} - GROUPING({', '.join(columns)}) AS mask FROM src GROUP BY {groups}),
p AS (SELECT mask, count(*) AS card FROM g GROUP BY mask),
a(pos, bit, name) AS (VALUES {values}),
v AS (SELECT p.mask AS lhs, a.bit AS rhs_bit, a.name AS rhs FROM p JOIN a ON (p.mask & a.bit) = 0
      JOIN p q ON q.mask = (p.mask | a.bit) AND q.card = p.card{limit}),
m AS (SELECT lhs, rhs FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.rhs_bit = v.rhs_bit AND w.lhs <> v.lhs AND (w.lhs & v.lhs) = w.lhs))
"""


FD_SELECT = "SELECT coalesce((SELECT string_agg(a.name, ',' ORDER BY a.pos) FROM a WHERE (a.bit & m.lhs) <> 0), '') AS lhs, rhs FROM m"


def flat(fds: DataFrame) -> DataFrame:
    return fds.select(F.array_join("lhs", ",").alias("lhs"), "rhs")


def _fd(table: str, **options):
    return lambda spark, sf_dir: flat(discover_fds(load(spark, sf_dir, table), **options))


for _t in ("region", "nation", "supplier", "customer", "part", "orders", "events"):
    query(f"fd_{_t}", fd_sql(f"SELECT * FROM {_t}", COLUMNS[_t]) + FD_SELECT)(_fd(_t))
query("fd_lineitem_k2", fd_sql("SELECT * FROM lineitem", COLUMNS["lineitem"], 2) + FD_SELECT)(_fd("lineitem", max_lhs_size=2))
query("fd_lineitem", fd_sql("SELECT * FROM lineitem", COLUMNS["lineitem"]) + FD_SELECT)(_fd("lineitem"))
query("fd_customer_cube", SQL["fd_customer"])(_fd("customer", strategy="cube"))
query("fd_part_k1_cube", fd_sql("SELECT * FROM part", COLUMNS["part"], 1) + FD_SELECT)(_fd("part", strategy="cube", max_lhs_size=1))
query("fd_supplier_groups", SQL["fd_supplier"])(_fd("supplier", strategy="group"))
query("fd_orders_broadcast", SQL["fd_orders"])(_fd("orders", strategy="broadcast"))

query("fd_orders_groups", SQL["fd_orders"])(_fd("orders", strategy="group"))
query("fd_lineitem_groups_k2", SQL["fd_lineitem_k2"])(_fd("lineitem", strategy="group", max_lhs_size=2))

_TYPED = "SELECT o_orderkey, o_orderkey % 500 AS t, CASE WHEN o_orderkey % 3 < 2 THEN 0 ELSE o_custkey END AS v, o_orderdate, o_orderstatus FROM orders"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with times that differ by microseconds in a struct, and arrays with zeros of either sign."""
    key = F.col("o_orderkey")
    t = F.struct(F.timestamp_micros(key % 500).alias("t")).alias("t")
    v = F.array(F.when(key % 3 == 0, F.lit(-0.0)).when(key % 3 == 1, F.lit(0.0)).otherwise(F.col("o_custkey").cast("double"))).alias("v")
    return load(spark, sf_dir, "orders").select("o_orderkey", t, v, "o_orderdate", "o_orderstatus")


for _s in ("broadcast", "group", "auto"):
    query(f"fd_typed_{_s}", fd_sql(_TYPED, ["o_orderkey", "t", "v", "o_orderdate", "o_orderstatus"]) + FD_SELECT)(lambda spark, sf_dir, s=_s: flat(discover_fds(typed(spark, sf_dir), strategy=s)))

_NULLED = "SELECT c_custkey, c_name, NULLIF(c_nationkey, 3) AS c_nationkey, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = {"c_nationkey": F.lit(3), "c_mktsegment": F.lit("BUILDING")}
    return load(spark, sf_dir, "customer").withColumns({c: F.nullif(F.col(c), v) for c, v in gone.items()})


@query("fd_null_eq", fd_sql(_NULLED, COLUMNS["customer"]) + FD_SELECT)
def fd_null_eq(spark, sf_dir):
    return flat(discover_fds(nulled(spark, sf_dir)))


_UNLIKE = ", ".join(f"CASE WHEN {c} IS NULL THEN 'n' || c_custkey ELSE 'v' || {c} END AS {c}" for c in COLUMNS["customer"])


@query("fd_null_neq", fd_sql(f"SELECT {_UNLIKE} FROM ({_NULLED})", COLUMNS["customer"]) + FD_SELECT)
def fd_null_neq(spark, sf_dir):
    return flat(discover_fds(nulled(spark, sf_dir), null_equals_null=False))


@query("fd_null_neq_groups", SQL["fd_null_neq"])
def fd_null_neq_groups(spark, sf_dir):
    return flat(discover_fds(nulled(spark, sf_dir), null_equals_null=False, strategy="group"))


@query("fd_count_by_rhs", fd_sql("SELECT * FROM orders", COLUMNS["orders"]) + "SELECT rhs, count(*) AS n FROM m GROUP BY rhs")
def fd_count_by_rhs(spark, sf_dir):
    return discover_fds(load(spark, sf_dir, "orders")).groupBy("rhs").agg(F.count("*").alias("n"))


_O = COLUMNS["orders"]
_ORDER_SQL = f"o AS (SELECT name, row_number() OVER (ORDER BY k DESC, pos) AS nth FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)}, (SELECT count(DISTINCT {c}) FROM orders))' for i, c in enumerate(_O))}) AS x(pos, name, k))"


@query(
    "fd_text_lines",
    fd_sql("SELECT * FROM orders", _O) + f", {_ORDER_SQL} SELECT '[' || coalesce((SELECT string_agg(a.name, ', ' ORDER BY o.nth) FROM a JOIN o ON o.name = a.name WHERE (a.bit & m.lhs) <> 0), '') || '] --> ' || rhs AS line FROM m",
)
def fd_text_lines(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    order = partitions.attribute_order(orders, _O)
    return discover_fds(orders).select(render_line(order).alias("line"))


@query("fd_results", SQL["fd_orders"])
def fd_results(spark, sf_dir):
    """The dependencies by the table to which each right-hand side was appended when it was final."""
    folder, file = place(spark)
    discover_fds(load(spark, sf_dir, "orders"), strategy="broadcast", results=f"{folder}/{file}")
    return flat(spark.read.parquet(f"{folder}/{file}").where("lhs IS NOT NULL"))


@query("fd_constant", fd_sql("SELECT *, 'same' AS c FROM nation", [*COLUMNS["nation"], "c"]) + FD_SELECT)
def fd_constant(spark, sf_dir):
    return flat(discover_fds(load(spark, sf_dir, "nation").withColumn("c", F.lit("same"))))


@query("fd_row_limit", fd_sql("SELECT * FROM orders ORDER BY o_orderkey LIMIT 500", _O) + FD_SELECT)
def fd_row_limit(spark, sf_dir):
    return flat(discover_fds(load(spark, sf_dir, "orders").orderBy("o_orderkey"), row_limit=500))


@query("csv_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_scan(spark, sf_dir):
    """The nations through a delimited file and back."""
    folder, file = place(spark)
    path = f"{folder}/{file}"
    load(spark, sf_dir, "nation").coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)
    return CsvDescriptor(name=file, path=folder, ending="").read(spark)


@query("csv_multiline", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || c_mktsegment || chr(10) || '\"x\", y' AS note, c_mktsegment FROM customer")
def csv_multiline(spark, sf_dir):
    """The customers, with line feeds, quotes and separators inside of quotes, through a delimited file and back."""
    note = F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit('\n"x", y')).alias("note")
    rows = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), note, "c_mktsegment")
    folder, file = place(spark)
    path = f"{folder}/{file}"
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
    return CsvDescriptor(name=file, path=folder, ending="", escape='"').read(spark)


_NOTE = "l_returnflag || chr(10) || chr(10) || CAST(l_partkey AS VARCHAR) || '\"a\", b' || chr(10) || l_linestatus"


@query("csv_multiline_parts", f"SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, {_NOTE} AS note, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem")
def csv_multiline_parts(spark, sf_dir):
    """The lineitems with line feeds inside of quotes, through many files that are read in small splits, several of them a task."""
    note = F.concat("l_returnflag", F.lit("\n\n"), F.col("l_partkey").cast("string"), F.lit('"a", b\n'), "l_linestatus").alias("note")
    rows = load(spark, sf_dir, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber")], note, F.col("l_suppkey").cast("string").alias("l_suppkey"))
    folder, file = place(spark)
    rows.repartition(9).write.csv(f"{folder}/{file}", header=True, quoteAll=True, escape='"')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return CsvDescriptor(name=file, path=folder, ending="", escape='"').read(spark)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@query(
    "csv_options",
    "SELECT CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey AS VARCHAR) END AS column1, s_name AS column2, CAST(s_nationkey AS VARCHAR) AS column3 FROM supplier WHERE s_suppkey % 5 <> 0",
)
def csv_options(spark, sf_dir):
    """The suppliers by lines of their own: a line to skip, no header, another separator and quote, a
    null string, leading white space, and lines of another width, which are dropped."""
    key = F.when(F.col("s_suppkey") % 7 == 0, "NULL").otherwise(F.col("s_suppkey").cast("string"))
    line = F.concat(F.lit("  "), key, F.lit(";'"), "s_name", F.lit("';"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 5 == 0, ";more").otherwise(""))
    folder, file = place(spark)
    path = f"{folder}/{file}"
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), line.alias("value"))
    first = spark.createDataFrame([(-2, "one line; to skip"), (-1, "a;b;c")], rows.schema)  # the second gives the width and is dropped
    first.unionByName(rows).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
    df = CsvDescriptor(name=file, path=folder, ending="", header=False, separator=";", quote="'", skip_lines=1, null_string="NULL").read(spark)
    return df.where("column2 <> 'b'")


@query("csv_strict_quotes", "SELECT r_name AS a, CAST(NULL AS VARCHAR) AS b, CAST(r_regionkey AS VARCHAR) AS c FROM region")
def csv_strict_quotes(spark, sf_dir):
    """Only what stands in quotes is a value."""
    line = F.concat(F.lit('"'), "r_name", F.lit('",bare,"'), F.col("r_regionkey").cast("string"), F.lit('"'))
    folder, file = place(spark)
    path = f"{folder}/{file}"
    rows = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("k"), line.alias("value"))
    spark.createDataFrame([(-1, '"a","b","c"')], rows.schema).unionByName(rows).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
    return CsvDescriptor(name=file, path=folder, ending="", strict_quotes=True).read(spark)


@query("fd_text_sink", f"SELECT string_split(line, ' --> ')[2] || '.txt' AS file, line || chr(13) AS line FROM ({SQL['fd_text_lines']})")
def fd_text_sink(spark, sf_dir):
    """The dependencies by the text files that they are written to."""
    orders = load(spark, sf_dir, "orders")
    folder, file = place(spark)
    path = f"{folder}/{file}"
    write_text(discover_fds(orders), path, partitions.attribute_order(orders, _O))
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("line"))


# -- Partitions --------------------------------------------------------------------------------

_L = COLUMNS["lineitem"]
_P = COLUMNS["part"]
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS attr, count(*) AS clusters, sum(k) AS records FROM (SELECT count(*) AS k FROM lineitem GROUP BY {c} HAVING count(*) > 1)" for c in _L)


@query("pli_stats", f"SELECT attr, CAST(clusters AS BIGINT) AS clusters, CAST(coalesce(records, 0) AS BIGINT) AS records FROM ({_CELLS})")
def pli_stats(spark, sf_dir):
    return partitions.cluster_stats(load(spark, sf_dir, "lineitem"), _L)


_COLUMNS2 = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "pli_clusters",
    " UNION ALL ".join(f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS val, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS positions FROM orders GROUP BY {c} HAVING count(*) > 1" for c in _COLUMNS2),
)
def pli_clusters(spark, sf_dir):
    return partitions.clusters(load(spark, sf_dir, "orders"), _COLUMNS2, "o_orderkey").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


_NULL_SOURCE = "SELECT *, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer"


@query("pli_null_neq", f"SELECT 'seg' AS attr, seg AS val, count(*) AS k FROM ({_NULL_SOURCE}) WHERE seg IS NOT NULL GROUP BY seg HAVING count(*) > 1")
def pli_null_neq(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return partitions.clusters(rows, ["seg"], "c_custkey", False).select("attr", "val", F.size("positions").cast("long").alias("k"))


@query("pli_intersect", "SELECT l_suppkey, l_quantity, count(*) AS size FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pli_intersect(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("rid", F.monotonically_increasing_id())
    return partitions.intersect(rows, ["l_suppkey", "l_quantity"], "rid").select("l_suppkey", "l_quantity", F.col("size").cast("long").alias("size"))


@query("coded_records", "SELECT p_partkey AS rid, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY {c}) = 1 THEN -1 ELSE min(p_partkey) OVER (PARTITION BY {c}) END AS {c}" for c in _P[1:]) + " FROM part")
def coded_records(spark, sf_dir):
    return partitions.coded(load(spark, sf_dir, "part"), _P[1:], "p_partkey").withColumnRenamed("p_partkey", "rid")


@query("dictionary_codes", "SELECT l_orderkey * 8 + l_linenumber AS rid, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in _L) + " FROM lineitem")
def dictionary_codes(spark, sf_dir):
    """Each attribute's values by their ranks, made by the executors."""
    rows = load(spark, sf_dir, "lineitem")
    found = encode(rows, rid=F.col("l_orderkey") * 8 + F.col("l_linenumber"), ordered=False, ranked=True)
    return found.rows.select("rid", *[F.col(f"c{i}").alias(c) for i, c in enumerate(_L)])


_PREFIXES = [("l_suppkey", "l_quantity"), ("l_partkey", "l_quantity"), ("l_suppkey", "l_shipdate"), ("l_quantity", "l_discount", "l_tax")]


@query(
    "prefix_tables",
    " UNION ALL ".join(f"SELECT '{','.join(p)}' AS prefix, count(*) AS clusters, CAST(coalesce(sum(k), 0) AS BIGINT) AS records FROM (SELECT count(*) AS k FROM lineitem GROUP BY {', '.join(p)} HAVING count(*) > 1)" for p in _PREFIXES),
)
def prefix_tables(spark, sf_dir):
    """Clusters of several sets of attributes, and the rows in them, by one aggregation of coded rows."""
    coded = written(encode(load(spark, sf_dir, "lineitem"), ordered=False, own=True))
    held = PrefixTables(coded.rows, len(_L), coded.n, 1 << 40, coded.widths)
    held.make([tuple(_L.index(c) for c in p) for p in _PREFIXES])
    found = [held.tables[tuple(_L.index(c) for c in p)] for p in _PREFIXES]  # a row a prefix
    held.close()
    drop_cut(coded.rows)
    return spark.createDataFrame([(",".join(p), t.clusters, t.records) for p, t in zip(_PREFIXES, found, strict=True)], "prefix string, clusters long, records long")


@query("unique_records", "SELECT count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY p_name) AS a, count(*) OVER (PARTITION BY p_retailprice) AS b FROM part) WHERE a = 1 OR b = 1")
def unique_records(spark, sf_dir):
    rows = partitions.coded(load(spark, sf_dir, "part"), ["p_name", "p_retailprice"], "p_partkey")
    return rows.where(partitions.unique(["p_name", "p_retailprice"])).agg(F.count("*").alias("n"))


@query("attribute_order", "SELECT attr, CAST(row_number() OVER (ORDER BY k DESC, pos) AS INTEGER) AS nth FROM (VALUES " + ", ".join(f"({i}, '{c}', (SELECT count(DISTINCT {c}) FROM part))" for i, c in enumerate(_P)) + ") AS x(pos, attr, k)")
def attribute_order(spark, sf_dir):
    order = partitions.attribute_order(load(spark, sf_dir, "part"), _P)
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(order)], "attr string, nth int")


@query("distinct_values", " UNION ALL ".join(f"SELECT '{c}' AS attr, count(DISTINCT {c}) AS \"values\" FROM events" for c in COLUMNS["events"]))
def distinct_values(spark, sf_dir):
    return partitions.distinct_counts(load(spark, sf_dir, "events"), COLUMNS["events"])


@query("constant_columns", "SELECT count(DISTINCT n_regionkey) <= 1 AS n_regionkey, true AS c FROM nation")
def constant_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").withColumn("c", F.lit(1))
    return rows.agg(partitions.constant("n_regionkey").alias("n_regionkey"), partitions.constant("c").alias("c"))


# -- Validation --------------------------------------------------------------------------------

_CANDIDATES = [(["o_custkey"], "o_orderstatus"), (["o_orderkey"], "o_totalprice"), (["o_custkey", "o_orderdate"], "o_totalprice"), (["o_totalprice"], "o_orderdate"), (["o_orderstatus", "o_orderpriority"], "o_custkey")]


@query(
    "validate_batch",
    " UNION ALL ".join(f"SELECT '{','.join(x)}' AS lhs, '{a}' AS rhs, NOT EXISTS (SELECT 1 FROM orders GROUP BY {', '.join(x)} HAVING count(DISTINCT {a}) > 1) AS valid" for x, a in _CANDIDATES),
)
def validate_batch(spark, sf_dir):
    return validate.valid_flags(load(spark, sf_dir, "orders"), _CANDIDATES).select("lhs", "rhs", "valid")


_RANKS = "SELECT *, " + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS r_{c}" for c in _O) + " FROM orders"


def _early_sql(lhs: list[str], rhs: str) -> str:
    mixed = " + ".join(f"r_{c} * {31**j % 1_000_003}" for j, c in enumerate(lhs))
    return f"SELECT '{','.join(lhs)}' AS lhs, '{rhs}' AS rhs, min(share) IS NULL AS valid, min(share) AS share FROM (SELECT CAST(any_value(({mixed}) % {validate.SHARES}) AS BIGINT) AS share FROM ranks GROUP BY {', '.join(lhs)} HAVING count(DISTINCT {rhs}) > 1)"


@query("validate_early", f"WITH ranks AS ({_RANKS}) " + " UNION ALL ".join(_early_sql(x, a) for x, a in _CANDIDATES))
def validate_early(spark, sf_dir):
    """Candidates with the first share of their clusters that has a violation: what comes after it need not be read."""
    return validate.valid_flags(load(spark, sf_dir, "orders"), _CANDIDATES, ranked=True)


@query(
    "violating_pairs",
    "SELECT o_custkey, arg_min(o_orderkey, (o_orderstatus, o_orderkey)) AS first, arg_max(o_orderkey, (o_orderstatus, o_orderkey)) AS second FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
)
def violating_pairs(spark, sf_dir):
    return validate.violating_pairs(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey")


def _eq_mask(a: str, b: str, columns: list[str]) -> str:
    return " + ".join(f"CASE WHEN {a}{c} IS NOT DISTINCT FROM {b}{c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(columns))


@query(
    "pair_lookup",
    f"WITH p AS ({SQL['violating_pairs']}) SELECT p.first, p.second, CAST({_eq_mask('x.', 'y.', _O)} AS BIGINT) AS mask FROM p JOIN orders x ON x.o_orderkey = p.first JOIN orders y ON y.o_orderkey = p.second",
)
def pair_lookup(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    pairs = violating_pairs(spark, sf_dir).select(F.col("first").alias("x"), F.col("second").alias("y"))
    found = agree.lookup(orders, pairs, _O, "o_orderkey")
    return found.select(F.col("x").alias("first"), F.col("y").alias("second"), bits.set_of(partitions.matches("a", "b", _O)).alias("mask"))


# -- Sampling ----------------------------------------------------------------------------------

_PO = ["p_partkey", "p_name", "p_retailprice", "p_type", "p_size", "p_brand"]


def _neighbours_sql(table: str, attribute: str, order: list[str], rid: str, d: int) -> str:
    at = order.index(attribute)
    near = [c for c in dict.fromkeys([order[(at + 1) % len(order)], order[at - 1]]) if c != attribute]
    w = f"OVER (PARTITION BY {attribute} ORDER BY {', '.join([*near, rid])})"
    lead = ", ".join(f"lead({c}, {d}) {w} AS b_{c}" for c in order)
    return f"SELECT *, {lead}, lead(true, {d}) {w} AS paired FROM {table}"


def _agree_sql(table: str, attribute: str, order: list[str], rid: str, d: int) -> str:
    mask = " + ".join(f"CASE WHEN {c} IS NOT DISTINCT FROM b_{c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(order))
    return f"SELECT DISTINCT CAST({mask} AS BIGINT) AS mask FROM ({_neighbours_sql(table, attribute, order, rid, d)}) WHERE paired"


def part_masks(spark, sf_dir, attribute: str, d: int) -> DataFrame:
    rows = load(spark, sf_dir, "part")
    return agree.masks(agree.neighbours(rows, attribute, _PO, "p_partkey", d), _PO).distinct()


for _d in (1, 3):
    query(f"agree_sets_d{_d}", _agree_sql("part", "p_brand", _PO, "p_partkey", _d))(lambda spark, sf_dir, d=_d: part_masks(spark, sf_dir, "p_brand", d))

_OO = ["o_orderkey", "o_totalprice", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]


@query(
    "agree_sets_counted",
    _agree_sql("orders", "o_custkey", _OO, "o_orderkey", 1).replace("SELECT DISTINCT", "SELECT").replace(" AS mask", " AS mask, count(*) AS pairs") + " GROUP BY 1",
)
def agree_sets_counted(spark, sf_dir):
    return agree.sample(load(spark, sf_dir, "orders"), "o_custkey", _OO, "o_orderkey").select(F.get("words", 0).alias("mask"), "pairs")


_LO = ["l_orderkey", "l_extendedprice", "l_partkey", "l_shipdate", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
#: Row numbers of lineitem: its key, for rows that are different.
_LINES = "(SELECT *, l_orderkey * 8 + l_linenumber AS rid FROM lineitem)"


def line_masks(spark, sf_dir, attribute: str, d: int) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").withColumn("rid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return agree.masks(agree.neighbours(rows, attribute, _LO, "rid", d), _LO).distinct()


@query("agree_sets_new", f"{_agree_sql(_LINES, 'l_suppkey', _LO, 'rid', 3)} EXCEPT {_agree_sql(_LINES, 'l_suppkey', _LO, 'rid', 1)}")
def agree_sets_new(spark, sf_dir):
    return agree.unseen(line_masks(spark, sf_dir, "l_suppkey", 3), line_masks(spark, sf_dir, "l_suppkey", 1))


@query("agree_sets_union", f"{_agree_sql(_LINES, 'l_partkey', _LO, 'rid', 1)} UNION {_agree_sql(_LINES, 'l_suppkey', _LO, 'rid', 1)}")
def agree_sets_union(spark, sf_dir):
    return agree.merge_seen(line_masks(spark, sf_dir, "l_partkey", 1), line_masks(spark, sf_dir, "l_suppkey", 1))


#: Row numbers of lineitem without two alike: an order has a line number more than once.
_NUMBER = "((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 4096 + CAST(round(l_extendedprice * 100) AS BIGINT) % 4096"
_NUMBERED = f"(SELECT *, {_NUMBER} AS rid FROM lineitem)"


def coded_lines(spark, sf_dir) -> DataFrame:
    return written(encode(load(spark, sf_dir, "lineitem").select(*_LO), rid=F.expr(_NUMBER), ordered=False, ranked=True)).rows


@query(
    "agree_sets_hot",
    _agree_sql(_NUMBERED, "l_returnflag", _LO, "rid", 1).replace("SELECT DISTINCT", "SELECT").replace(" AS mask", " AS mask, count(*) AS pairs") + " GROUP BY 1",
)
def agree_sets_hot(spark, sf_dir):
    """Neighbours among the rows of three values, each in many tasks."""
    return agree_sets(coded_lines(spark, sf_dir), len(_LO), [(_LO.index("l_returnflag"), 1)]).select(F.get("words", 0).alias("mask"), "pairs")


@query("agree_sets_again", SQL["agree_sets_new"].replace(_LINES, _NUMBERED))
def agree_sets_again(spark, sf_dir):
    """A sample that brings only what an earlier one did not have."""
    rows, at = coded_lines(spark, sf_dir), _LO.index("l_suppkey")
    seen = {bits.from_words(r["words"]) for r in agree_sets(rows, len(_LO), [(at, 1)]).collect()}  # sets of 11 attributes
    return agree_sets(rows, len(_LO), [(at, 3)], seen).where("words IS NOT NULL").select(F.get("words", 0).alias("mask"))


#: 71 attributes of lineitem: its own, ever coarser.
_LEVELS = {"l_orderkey": 15, "l_partkey": 11, "l_suppkey": 7, "l_linenumber": 3, "CAST(l_quantity AS INTEGER)": 6, "CAST(floor(l_extendedprice) AS INTEGER)": 17, "{days}": 10}
_WIDE = [f"w{i}" for i in range(71)]


def _coarse(days: str, shift: str) -> list[str]:
    return [shift.format(x=x.format(days=days), k=k) for x, n in _LEVELS.items() for k in range(n)] + ["l_returnflag", "l_linestatus"]


_WIDE_AT = [26, 59]  # the supplier and the day
_DAYS = "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))"
_WIDE_ROWS = f"(SELECT {', '.join(f'{x} AS {w}' for x, w in zip(_coarse(_DAYS, '({x} >> {k})'), _WIDE, strict=True))}, (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey AS rid FROM lineitem)"
_WIDE_SETS = " UNION ".join(_agree_sql(_WIDE_ROWS, _WIDE[a], _WIDE, "rid", 1).replace("AS BIGINT", "AS HUGEINT").replace(" THEN ", " THEN CAST('").replace(" ELSE 0", "' AS HUGEINT) ELSE 0") for a in _WIDE_AT)


@query(
    "maximal_wide",
    f"WITH s AS MATERIALIZED (SELECT DISTINCT mask FROM ({_WIDE_SETS})) SELECT (SELECT string_agg(CAST(r.i AS VARCHAR), ',' ORDER BY r.i) FROM range(71) r(i) WHERE (s.mask >> CAST(r.i AS HUGEINT)) & 1 = 1) AS attributes FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.mask <> s.mask AND (s.mask & t.mask) = s.mask)",
)
def maximal_wide(spark, sf_dir):
    """Agree sets of more attributes than a word has bits, inside no other one."""
    coarse = _coarse("datediff(CAST(l_shipdate AS DATE), DATE '1990-01-01')", "shiftright({x}, {k})")
    rows = load(spark, sf_dir, "lineitem").select(*[F.expr(x).alias(w) for x, w in zip(coarse, _WIDE, strict=True)])
    key, part, line = (F.col(_WIDE[i]).cast("long") for i in (0, 15, 33))  # whole ones
    coded = written(encode(rows, rid=(key * 8 + line) * 1048576 + part, ordered=False, ranked=True, own=True))
    found = lattice.maximal_words(agree_sets(coded.rows, 71, [(a, 1) for a in _WIDE_AT], count=coded.n), 71)
    return found.select(F.array_join(lattice.attributes(F.col("words"), 71).cast("array<string>"), ",").alias("attributes"))


_MASKS = f"({SQL['agree_sets_union']})"


@query("maximal_agree_sets", f"WITH s AS {_MASKS} SELECT mask FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.mask <> s.mask AND (s.mask & t.mask) = s.mask)")
def maximal_agree_sets(spark, sf_dir):
    return agree.maximal(agree_sets_union(spark, sf_dir))


_RHS = f"WITH s AS {_MASKS}, n AS (SELECT s.mask AS lhs, CAST(r.i AS INTEGER) AS rhs FROM s, range(11) r(i) WHERE (s.mask >> r.i) & 1 = 0) "


@query("non_fds", _RHS + "SELECT lhs, rhs FROM n")
def non_fds(spark, sf_dir):
    return agree.non_fds(agree_sets_union(spark, sf_dir), len(_LO))


@query("non_fds_open_rhs", _RHS + "SELECT lhs, rhs FROM n WHERE rhs IN (1, 4)")
def non_fds_open_rhs(spark, sf_dir):
    return agree.non_fds(agree_sets_union(spark, sf_dir), len(_LO), [1, 4])


@query("maximal_by_rhs", _RHS + "SELECT lhs, rhs FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.rhs = n.rhs AND m.lhs <> n.lhs AND (n.lhs & m.lhs) = n.lhs)")
def maximal_by_rhs(spark, sf_dir):
    return agree.maximal_by_rhs(non_fds(spark, sf_dir))


@query("non_fds_by_rhs", _RHS + "SELECT rhs, string_agg(CAST(lhs AS VARCHAR), ',' ORDER BY bit_count(lhs) DESC, lhs) AS lhss FROM n GROUP BY rhs")
def non_fds_by_rhs(spark, sf_dir):
    return agree.by_rhs(non_fds(spark, sf_dir)).withColumn("lhss", F.array_join(F.col("lhss").cast("array<string>"), ","))


@query("largest_agree_sets", f"SELECT mask FROM {_MASKS} ORDER BY bit_count(mask) DESC, mask LIMIT 5")
def largest_agree_sets(spark, sf_dir):
    return agree.largest(agree_sets_union(spark, sf_dir), 5)


@query("large_agree_sets", f"WITH s AS {_MASKS} SELECT mask FROM s WHERE bit_count(mask) > (SELECT avg(bit_count(mask)) FROM s)")
def large_agree_sets(spark, sf_dir):
    return agree.above_average(agree_sets_union(spark, sf_dir))


# -- The lattice -------------------------------------------------------------------------------

#: Stored left-hand sides: pairs of 12 attributes that parts have; agree sets: those of part keys and sizes.
_STORED = "SELECT DISTINCT CAST((1 << (p_partkey % 12)::INTEGER) | (1 << (p_size % 12)::INTEGER) AS BIGINT) AS x FROM part WHERE p_partkey % 12 <> p_size % 12"
_ASKED = "SELECT DISTINCT CAST(p_partkey & 4095 AS BIGINT) AS q FROM part"
_REFUTED = 0b011110110110


def stored(spark, sf_dir) -> DataFrame:
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(c) % 12).cast("int"))
    return load(spark, sf_dir, "part").where("p_partkey % 12 <> p_size % 12").select(bit("p_partkey").bitwiseOR(bit("p_size")).alias("lhs")).distinct()


@query("generalizations", f"WITH s AS ({_STORED}), a AS ({_ASKED}) SELECT q, x AS lhs FROM a JOIN s ON (x & q) = x")
def generalizations(spark, sf_dir):
    asked = load(spark, sf_dir, "part").select(F.col("p_partkey").bitwiseAND(F.lit(4095)).cast("long").alias("q")).distinct()
    return lattice.subsets(asked, stored(spark, sf_dir))


@query(
    "specialize_step",
    f"""WITH s AS ({_STORED}), kept AS (SELECT x FROM s WHERE (x & {_REFUTED}) <> x),
    new AS (SELECT DISTINCT s.x | (1 << b.i) AS x FROM s, range(12) b(i) WHERE (s.x & {_REFUTED}) = s.x AND ({_REFUTED} >> b.i) & 1 = 0),
    every AS (SELECT x FROM kept UNION SELECT x FROM new)
    SELECT CAST(x AS BIGINT) AS lhs FROM every e WHERE NOT EXISTS (SELECT 1 FROM every f WHERE f.x <> e.x AND (f.x & e.x) = f.x)""",
)
def specialize_step(spark, sf_dir):
    rhs = F.lit(12).alias("rhs")
    refuted = spark.range(1).select(rhs, F.lit(_REFUTED).cast("long").alias("lhs"))
    return lattice.induce(stored(spark, sf_dir).select(rhs, "lhs"), refuted, 13).select("lhs")


_EVERY = "every AS (SELECT CAST(r.i AS INTEGER) AS rhs, CAST(m.i AS BIGINT) AS lhs FROM range(11) r(i), range(1, 2048) m(i) WHERE (m.i >> r.i) & 1 = 0)"


@query(
    "induced_covers",
    _RHS.rstrip() + f", {_EVERY}, v AS (SELECT rhs, lhs FROM every e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.rhs = e.rhs AND (e.lhs & n.lhs) = e.lhs)) SELECT rhs, lhs FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.rhs = v.rhs AND w.lhs <> v.lhs AND (w.lhs & v.lhs) = w.lhs)",
)
def induced_covers(spark, sf_dir):
    """The covers of all right-hand sides that the agree sets of a sample leave, from table to table."""
    return lattice.induce(lattice.initial(spark, len(_LO)), non_fds(spark, sf_dir), len(_LO))


# -- Figures -----------------------------------------------------------------------------------


@query(
    "sampling_efficiency",
    f"SELECT comparisons, matches, CASE WHEN comparisons = 0 THEN 0.0 ELSE matches / comparisons END AS efficiency FROM (SELECT count(*) AS comparisons, count(DISTINCT mask) AS matches FROM ({_agree_sql('part', 'p_brand', _PO, 'p_partkey', 1).replace('SELECT DISTINCT', 'SELECT')}))",
)
def sampling_efficiency(spark, sf_dir):
    pairs = agree.masks(agree.neighbours(load(spark, sf_dir, "part"), "p_brand", _PO, "p_partkey"), _PO)
    counts = pairs.agg(F.count("*").alias("comparisons"), F.count_distinct("mask").alias("matches"))
    return counts.withColumn("efficiency", metrics.sampling_efficiency(F.col("matches"), F.col("comparisons")))


@query("validation_efficiency", f"SELECT count(*) AS candidates, count(*) FILTER (NOT valid) AS invalid, (count(*) - count(*) FILTER (NOT valid)) / count(*) AS efficiency FROM ({SQL['validate_batch']})")
def validation_efficiency(spark, sf_dir):
    counts = validate_batch(spark, sf_dir).agg(F.count("*").alias("candidates"), F.count_if(~F.col("valid")).alias("invalid"))
    return counts.withColumn("efficiency", metrics.validation_efficiency(F.col("candidates"), F.col("invalid")))


_SIZES = "SELECT count(*) AS {0}_clusters, sum(k) AS {0}_records FROM (SELECT count(*) AS k FROM orders GROUP BY {1} HAVING count(*) > 1)"


@query(
    "cache_worth",
    f"""SELECT CASE WHEN a_clusters = 0 THEN false WHEN b_clusters = 0 THEN true
    ELSE 1 - (a_records / (b_clusters + a_records - coalesce(b_records, 0))) / (a_records / a_clusters) >= 0.05 END AS worth
    FROM ({_SIZES.format('a', 'o_custkey')}), ({_SIZES.format('b', 'o_custkey, o_orderstatus')})""",
)
def cache_worth(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")

    def sizes(p: str, *by: str) -> DataFrame:
        k = orders.groupBy(*by).agg(F.count("*").alias("k")).where("k > 1")
        return k.agg(F.count("*").alias(f"{p}_clusters"), F.coalesce(F.sum("k"), F.lit(0)).alias(f"{p}_records"))

    both = sizes("a", "o_custkey").join(F.broadcast(sizes("b", "o_custkey", "o_orderstatus")))  # one row each
    return both.select(metrics.worth_caching(*[F.col(c) for c in ("a_records", "a_clusters", "b_records", "b_clusters")]).alias("worth"))


_AB = "SELECT CAST(o_orderkey & 4095 AS BIGINT) AS a, CAST(o_custkey & 4095 AS BIGINT) AS b FROM orders"


@query(
    "bitset_ops",
    f"SELECT a, b, a & b AS both, a | b AS either, xor(a, b) AS one, a & ~b AS rest, (a & b) <> 0 AS meets, (a & b) = a AS inside, CAST(bit_count(a) AS INTEGER) AS size, (a >> 3) & 1 = 1 AS third, xor(a, 8::BIGINT) AS flipped, (SELECT coalesce(string_agg(CAST(r.i AS VARCHAR), ',' ORDER BY r.i), '') FROM range(12) r(i) WHERE (a >> r.i) & 1 = 1) AS members FROM ({_AB})",
)
def bitset_ops(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").bitwiseAND(F.lit(4095)).cast("long").alias("a"), F.col("o_custkey").bitwiseAND(F.lit(4095)).cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "a",
        "b",
        bits.intersection(a, b).alias("both"),
        bits.union(a, b).alias("either"),
        bits.symmetric_difference(a, b).alias("one"),
        bits.difference(a, b).alias("rest"),
        bits.intersects(a, b).alias("meets"),
        bits.subset(a, b).alias("inside"),
        bits.cardinality(a).alias("size"),
        bits.has(a, 3).alias("third"),
        bits.symmetric_difference(a, bits.one(3)).alias("flipped"),
        F.array_join(bits.indices(a, 12).cast("array<string>"), ",").alias("members"),
    )
