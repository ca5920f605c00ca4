"""Input tables of the registered queries, as Spark frames and as SQL.

``P`` turns each order into a process with nulls, placeholders, negatives and
date anomalies; ``PD`` adds exact and incomplete copies. A query names the
columns it reads, and only the joins behind those columns are planned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.scan import load, stored_bytes
from assayer.spec import Spec

LINE_COLUMNS = ("received", "opened", "effective", "n_lines", "n_suppliers", "n_returned", "n_discounted")
P_COLUMNS = (
    "proc_key", "proc_id", "ref_id", "url", "description", "category_code", "state", "mode", "published",
    "received", "opened", "effective", "base_price", "segment", "nation", "tags", "duration",
    "duration_unit", "n_lines", "n_suppliers", "n_returned", "n_discounted",
)

SPEC = Spec(
    id="proc_id", reference="ref_id", portfolio="tags", url="url", description="description",
    category="category_code", price="base_price", price_group="segment", mode="mode", type="segment",
    places=("nation",), state="state", published="published", received="received", opened="opened",
    effective="effective", duration="duration", duration_unit="duration_unit", multi_value="tags",
    direct_responses="n_lines", responses=("n_lines", "n_returned", "n_discounted"), suppliers="n_suppliers",
    ratio_denominator="n_lines", counters=("n_lines", "n_suppliers", "n_returned", "n_discounted"),
    text=("proc_id", "ref_id", "category_code", "segment", "nation", "mode"),
    critical=("ref_id", "published", "description", "base_price", "mode", "segment", "url", "nation"),
    leakage=("state", "effective"), redundant=("proc_key",), traceability=("proc_id", "ref_id", "url"),
    tie_break=("proc_key",), url_pattern=r"^https?://example\.org/p\?id=.+$",
)


DEALT_MOST = 256 << 20


def dealt_out(df: DataFrame, size: int) -> DataFrame:
    """The small fixture files hold one row group each, which Spark cannot split: deal such a table out to all cores.

    Only these queries' inputs are treated so, and only up to DEALT_MOST bytes, so the cost has a fixed bound; ``load`` itself
    reads a table as its splits are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = (1 << 20) <= size <= DEALT_MOST and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


_scans: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table. The (lazy) scan is kept per application, so footers are read once; no data is held."""
    path = f"{sf_dir}/{name}.parquet"
    handle = (spark.sparkContext.applicationId, path)
    if handle not in _scans:
        _scans[handle] = dealt_out(load(spark, path), stored_bytes(spark, path))
    return _scans[handle]


LINES_A_TASK = 500_000

_line_tables: dict[tuple[str, str], tuple[DataFrame, int]] = {}


def lines_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by order before they are aggregated.

    An order has a few lines with a supplier each, so partial aggregates would hold about a row for each line of a file split or
    row group, however many those are. Here a task aggregates the lines of a partition, LINES_A_TASK on average at most.
    """
    path = f"{sf_dir}/lineitem.parquet"
    handle = (spark.sparkContext.applicationId, path)
    if handle not in _line_tables:
        lines = load(spark, path)
        _line_tables[handle] = lines, lines.count()  # from the footers
    lines, rows = _line_tables[handle]
    pieces = -(-rows // LINES_A_TASK)
    if pieces <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return lines.repartition("l_orderkey")
    return lines.repartition(pieces, "l_orderkey")


def _lines(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    def on_line(number: int) -> Column:
        return F.min(F.when(F.col("l_linenumber") == number, F.col("l_shipdate").cast("timestamp")))

    measures = {
        "received": on_line(1),
        "opened": on_line(2),
        "effective": on_line(3),
        "n_lines": F.count(F.lit(1)),
        "n_suppliers": F.count_distinct("l_suppkey"),
        "n_returned": F.count_if(F.col("l_returnflag") == "R"),
        "n_discounted": F.count_if(F.col("l_discount") > 0.08),
    }
    return lines_by_order(spark, sf_dir).groupBy("l_orderkey").agg(
        *[measure.alias(name) for name, measure in measures.items() if name in wanted]
    )


def processes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    names = columns or P_COLUMNS
    wanted = set(names)
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    if wanted & {"description", "segment", "nation"}:
        rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if "nation" in wanted:
        rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if wanted & set(LINE_COLUMNS):
        rows = rows.join(_lines(spark, sf_dir, wanted), key == F.col("l_orderkey"), "left")

    def text(column: Column) -> Column:
        return column.cast("string")

    units = ["Dia(s)", "Mes(es)", "ano", "HORAS", "No especificado"]
    made = {
        "proc_key": key,
        "proc_id": F.concat(F.lit("CO1.REQ."), text(key)),
        "ref_id": F.concat(F.lit("REF-"), text(F.col("o_custkey"))),
        "url": F.when(key % 19 != 0, F.concat(F.lit("https://example.org/p?id="), text(key))),
        "description": F.when(key % 17 == 0, "N/A").when(key % 3 == 0, "Obra menor").otherwise(
            F.concat(F.lit("  Servicio  de  "), F.col("c_name"), F.lit(" "))
        ) if "description" in wanted else None,
        "category_code": F.when(key % 29 != 0, F.concat(F.lit("V1."), text(F.col("o_custkey") % 50))),
        "state": F.col("o_orderstatus"),
        "mode": F.col("o_orderpriority"),
        "published": F.col("o_orderdate").cast("timestamp"),
        "base_price": F.when(key % 97 == 0, -F.col("o_totalprice")).when(key % 23 == 0, 0.0).otherwise(F.col("o_totalprice")),
        "segment": F.when(key % 11 == 0, "No Definido").when(key % 13 == 0, "  no   aplica ").otherwise(
            F.col("c_mktsegment")
        ) if "segment" in wanted else None,
        "nation": F.when(key % 7 != 0, F.col("n_name")) if "nation" in wanted else None,
        "tags": F.when(key % 5 == 0, "[A, B, A]").when(key % 5 == 1, "C"),
        "duration": (key % 41 - 1).cast("double"),
        "duration_unit": reduce(
            lambda chain, pair: chain.when(key % 6 == pair[0], pair[1]), enumerate(units[1:], 1), F.when(key % 6 == 0, units[0])
        ).otherwise("Semana(s)"),
    }
    return rows.select(*[F.col(n) if n in LINE_COLUMNS else made[n].alias(n) for n in names])


def duplicated(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``P`` plus exact copies (key % 37) and copies without a price (key % 43), in one scan."""
    names = columns or P_COLUMNS
    base = processes(spark, sf_dir, *dict.fromkeys((*names, "proc_key")))
    key = F.col("proc_key")
    variants = F.array(F.lit("row"), F.when(key % 37 == 0, "copy"), F.when(key % 43 == 0, "no_price"))
    copied = base.withColumn("variant", F.explode(F.array_compact(variants)))
    if "base_price" in names:
        copied = copied.withColumn("base_price", F.when(F.col("variant") != "no_price", F.col("base_price")))
    return copied.select(*names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    dirty = F.when(key % 9 == 0, "n/a").when(key % 9 == 1, "$1,200").otherwise(F.col("value").cast("string"))
    moment = F.when(key % 10 == 0, "sin fecha").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").withColumns({"value_text": dirty, "ts_text": moment})


P_SQL = """
li AS (
  SELECT l_orderkey,
         min(CASE WHEN l_linenumber = 1 THEN l_shipdate END) AS received,
         min(CASE WHEN l_linenumber = 2 THEN l_shipdate END) AS opened,
         min(CASE WHEN l_linenumber = 3 THEN l_shipdate END) AS effective,
         count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_returned,
         CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS n_discounted
  FROM lineitem GROUP BY l_orderkey),
P AS (
  SELECT o.o_orderkey AS proc_key,
       concat('CO1.REQ.', CAST(o.o_orderkey AS VARCHAR)) AS proc_id,
       concat('REF-', CAST(o.o_custkey AS VARCHAR)) AS ref_id,
       CASE WHEN o.o_orderkey % 19 = 0 THEN NULL
            ELSE concat('https://example.org/p?id=', CAST(o.o_orderkey AS VARCHAR)) END AS url,
       CASE WHEN o.o_orderkey % 17 = 0 THEN 'N/A' WHEN o.o_orderkey % 3 = 0 THEN 'Obra menor'
            ELSE concat('  Servicio  de  ', c.c_name, ' ') END AS description,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL
            ELSE concat('V1.', CAST(o.o_custkey % 50 AS VARCHAR)) END AS category_code,
       o.o_orderstatus AS state, o.o_orderpriority AS mode,
       o.o_orderdate AS published, li.received, li.opened, li.effective,
       CASE WHEN o.o_orderkey % 97 = 0 THEN -o.o_totalprice
            WHEN o.o_orderkey % 23 = 0 THEN CAST(0.0 AS DOUBLE) ELSE o.o_totalprice END AS base_price,
       CASE WHEN o.o_orderkey % 11 = 0 THEN 'No Definido'
            WHEN o.o_orderkey % 13 = 0 THEN '  no   aplica ' ELSE c.c_mktsegment END AS segment,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE n.n_name END AS nation,
       CASE WHEN o.o_orderkey % 5 = 0 THEN '[A, B, A]' WHEN o.o_orderkey % 5 = 1 THEN 'C' END AS tags,
       CAST(o.o_orderkey % 41 - 1 AS DOUBLE) AS duration,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'Dia(s)' WHEN 1 THEN 'Mes(es)' WHEN 2 THEN 'ano'
            WHEN 3 THEN 'HORAS' WHEN 4 THEN 'No especificado' ELSE 'Semana(s)' END AS duration_unit,
       li.n_lines, li.n_suppliers, li.n_returned, li.n_discounted
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey)
"""

PD_SQL = P_SQL + """,
PD AS (
  SELECT * FROM P
  UNION ALL SELECT * FROM P WHERE proc_key % 37 = 0
  UNION ALL SELECT * REPLACE (CAST(NULL AS DOUBLE) AS base_price) FROM P WHERE proc_key % 43 = 0)
"""


def with_p(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([P_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def with_pd(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PD_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body
