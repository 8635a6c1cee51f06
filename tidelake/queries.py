"""Queries over the retail tables, and the same in DuckDB SQL.

The given tables are clean, so each cleaning query reads its table through a view that adds dirt by
arithmetic on the key. The view is one SQL text that both engines run; {name} is a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import EMAIL, slug
from .operators import checks, maintained, sales
from .operators.incremental import drop_existing, last_cursor
from .operators.rules import Above, AtLeast, NotNull, Normalise, checks as rule_checks, clean, exact_distinct, rejects, rule_name
from .plans import clean as clean_layer
from .plans import raw as raw_layer
from .plans.registry import TABLES
from .plans.spec import TableSpec
from .sources import buckets, store

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

CLIENTES = """
select cast(c_custkey as int) as cliente_id,
 case when c_custkey%17=0 then null when c_custkey%2=0 then ' cc ' else 'Ce' end as tipo_documento,
 case when c_custkey%19=0 then '   ' else concat(' ', cast(c_custkey as varchar(20)), ' ') end as numero_documento,
 case when c_custkey%23=0 then null when c_custkey%29=0 then '' else concat('  ', lower(c_name), ' DE la-cruz') end as nombre,
 concat(upper(c_mktsegment), '  x') as apellido,
 case when c_custkey%5=0 then null when c_custkey%5=1 then 'bad@x' when c_custkey%5=2 then ''
      else concat(' C', cast(c_custkey as varchar(20)), '@Mail.CO ') end as correo,
 concat(' 3', cast(c_custkey as varchar(20)), ' ') as telefono,
 case when c_nationkey%3=0 then 'BOGOTÁ' when c_nationkey%3=1 then ' santa  marta ' else null end as ciudad,
 c_custkey%2=0 as activo,
 case when c_custkey%31=0 then null else c_custkey*10 end as updated_at
from {customer}
"""
#: Rows that equal others only after cleaning.
CLIENTES_TWICE = f"""
select * from ({CLIENTES}) a union all
select cliente_id, upper(trim(tipo_documento)) as tipo_documento, numero_documento, nombre, apellido, correo, telefono, ciudad, activo, updated_at
from ({CLIENTES}) b
"""
PRODUCTOS = """
select cast(p_partkey as int) as producto_id,
 case when p_partkey%13=0 then null else concat(' 77', cast(p_partkey as varchar(20)), ' ') end as codigo_barras,
 case when p_partkey%17=0 then null when p_partkey%19=0 then '  ' else concat(' ', upper(p_name), ' ') end as nombre,
 p_type as categoria, cast(null as varchar(20)) as subcategoria, concat(p_brand, '-Cola') as marca,
 cast(case when p_partkey%11=0 then -p_retailprice else p_retailprice end as decimal(12,2)) as precio_venta,
 cast(case when p_partkey%7=0 then null else p_retailprice/2 end as decimal(12,2)) as costo_unitario,
 p_partkey%3<>0 as activo, p_partkey*10 as updated_at
from {part}
"""
INVENTARIO = """
select min(l_orderkey*10+l_linenumber) as inventario_id, cast(l_suppkey as int) as sucursal_id, cast(l_partkey as int) as producto_id,
 cast(sum(l_quantity) as int) - 20 as cantidad_disponible, cast(min(l_quantity) as int) - case when l_partkey%9=0 then 60 else 0 end as stock_minimo,
 case when l_partkey%5=0 then null else cast(max(l_quantity) as int) - case when l_partkey%7=0 then 25 else 0 end end as stock_maximo,
 max(l_shipdate) as fecha_actualizacion
from {lineitem} group by l_suppkey, l_partkey
"""
FACTURAS = """
select o_orderkey as factura_id, case when o_orderkey%37=0 then null else concat(' f-', cast(o_orderkey as varchar(20))) end as numero_factura,
 case when o_orderkey%3=0 then null else o_custkey end as cliente_id, o_custkey%10 as sucursal_id,
 case when o_orderkey%41=0 then null else o_custkey%50 end as vendedor_id, o_orderdate as fecha_hora, concat(lower(o_orderpriority), ' ') as metodo_de_pago,
 cast(o_totalprice as decimal(14,2)) as subtotal, cast(case when o_orderkey%11=0 then -1 else 0 end as decimal(14,2)) as descuento_total,
 cast(case when o_orderkey%13=0 then null else 1 end as decimal(14,2)) as impuesto_total, cast(o_totalprice as decimal(14,2)) as total,
 concat(' ', lower(o_orderstatus)) as estado
from {orders}
"""
LINEAS = """
select l_orderkey*10+l_linenumber as detalle_id, l_orderkey as factura_id, l_partkey as producto_id,
 cast(l_quantity as int) as cantidad, cast(l_extendedprice as decimal(12,2)) as precio_unitario, cast(l_discount as decimal(4,2)) as descuento
from {lineitem}
"""
DETALLES = """
select l_orderkey*10+l_linenumber as detalle_id, case when l_orderkey%43=0 then null else l_orderkey end as factura_id, l_partkey as producto_id,
 cast(case when l_partkey%10=0 then 0 when l_partkey%10=1 then -1 else l_quantity end as int) as cantidad,
 cast(case when l_partkey%12=5 then null else l_extendedprice end as decimal(12,2)) as precio_unitario,
 cast(l_discount as decimal(12,2)) as descuento_unitario, cast(case when l_suppkey%8=0 then -l_tax-1 else l_tax end as decimal(12,2)) as impuesto_unitario,
 cast(l_extendedprice as decimal(12,2)) as total_linea
from {lineitem}
"""
SUCURSALES = """
select n_nationkey as sucursal_id, case when n_nationkey%6=5 then null else concat('  ', n_name, ' ') end as nombre,
 case when n_nationkey%7=6 then null else 'SANTA marta' end as ciudad, concat(' calle ', cast(n_nationkey as varchar(20)), ' ') as direccion
from {nation}
"""
VENDEDORES = """
select s_suppkey as vendedor_id, s_nationkey as sucursal_id, concat(' ', cast(s_suppkey as varchar(20))) as documento,
 case when s_suppkey%9=0 then null else concat(' ', upper(s_name)) end as nombre, ' pérez LÓPEZ ' as apellidos,
 case when s_suppkey%4=0 then null else ' José@X.co ' end as correo
from {supplier}
"""
#: Events as a table that changes, with a text column to clean.
EVENTOS = """
select event_id as evento_id, ts, case when event_id%15=0 then null else concat(' ', upper(event_type), ' x ') end as tipo, value as valor from {events}
"""
EVENTOS_DESPUES = """
select event_id as evento_id, ts + interval '40' day as ts, concat(' late ', event_type) as tipo, value + 1 as valor from {events} where event_id%10=0
"""

EVENT_RULES = (NotNull("evento_id"), NotNull("tipo"), Normalise("title", "tipo"), AtLeast("valor", 0), Above("valor", 0))
EVENT_SPEC = TableSpec("eventos", ("evento_id",), "incremental_timestamp", EVENT_RULES, cursor="ts", clean_cursor="ts")
BUCKET_SPEC = TableSpec("eventos", ("evento_id",), "incremental_timestamp", EVENT_RULES, cursor="ts", clean_cursor="ts", buckets=8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(trim({x})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cleaned_sql(view_sql: str, columns: dict[str, str], where: str) -> str:
    """DISTINCT normalised columns of a view; columns maps those that change (or are new) to SQL."""
    change = ", ".join(f"{v} AS {k}" for k, v in columns.items() if k != "apellido" or "apellidos" not in v)
    new = ", ".join(f"{v} AS {k}" for k, v in columns.items() if k == "apellido" and "apellidos" in v)
    star = f"* REPLACE ({change})" if change else "*"
    return f"SELECT DISTINCT * FROM (SELECT {star}{', ' + new if new else ''} FROM ({duck(view_sql)})) WHERE {where}"


_CLIENTES = ({"tipo_documento": "upper(trim(tipo_documento))", "nombre": title("nombre"), "apellido": title("apellido"), "ciudad": title("ciudad"),
              "correo": "lower(trim(correo))", "numero_documento": "trim(numero_documento)", "telefono": "trim(telefono)"},
             "cliente_id IS NOT NULL AND tipo_documento IS NOT NULL AND numero_documento IS NOT NULL AND nombre IS NOT NULL AND apellido IS NOT NULL "
             "AND updated_at IS NOT NULL AND length(numero_documento) > 0 AND length(nombre) > 0 AND length(apellido) > 0 "
             f"AND (correo IS NULL OR regexp_matches(correo, '{EMAIL}'))")


@query(cleaned_sql(CLIENTES_TWICE, *_CLIENTES))
def clean_clientes(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, CLIENTES_TWICE), TABLES["clientes"].rules))


@query(cleaned_sql(PRODUCTOS, {"nombre": title("nombre"), "categoria": title("categoria"), "subcategoria": title("subcategoria"), "marca": title("marca"),
                               "codigo_barras": "trim(codigo_barras)"},
                   "producto_id IS NOT NULL AND codigo_barras IS NOT NULL AND nombre IS NOT NULL AND updated_at IS NOT NULL AND precio_venta >= 0 AND costo_unitario >= 0"))
def clean_productos(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, PRODUCTOS), TABLES["productos"].rules))


@query(cleaned_sql(INVENTARIO, {}, "sucursal_id IS NOT NULL AND producto_id IS NOT NULL AND fecha_actualizacion IS NOT NULL "
                                   "AND cantidad_disponible >= 0 AND stock_minimo >= 0 AND stock_maximo >= 0 AND stock_maximo >= stock_minimo"))
def clean_inventario(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, INVENTARIO), TABLES["inventario"].rules))


@query(cleaned_sql(FACTURAS, {c: f"upper(trim({c}))" for c in ("numero_factura", "metodo_de_pago", "estado")},
                   "factura_id IS NOT NULL AND numero_factura IS NOT NULL AND sucursal_id IS NOT NULL AND vendedor_id IS NOT NULL AND fecha_hora IS NOT NULL "
                   "AND subtotal >= 0 AND descuento_total >= 0 AND impuesto_total >= 0 AND total >= 0"))
def clean_facturas(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, FACTURAS), TABLES["facturas"].rules))


@query(cleaned_sql(DETALLES, {}, "detalle_id IS NOT NULL AND factura_id IS NOT NULL AND producto_id IS NOT NULL AND cantidad > 0 AND precio_unitario >= 0 "
                                 "AND descuento_unitario >= 0 AND impuesto_unitario >= 0 AND total_linea >= 0"))
def clean_detalles(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, DETALLES), TABLES["detalles_factura"].rules))


@query(cleaned_sql(SUCURSALES, {"nombre": title("nombre"), "ciudad": title("ciudad"), "direccion": "trim(direccion)"},
                   "sucursal_id IS NOT NULL AND nombre IS NOT NULL AND ciudad IS NOT NULL"))
def clean_sucursales(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, SUCURSALES), TABLES["sucursales"].rules))


@query(cleaned_sql(VENDEDORES, {"nombre": title("nombre"), "apellido": title("apellidos"), "correo": "lower(trim(correo))", "documento": "trim(documento)"},
                   "vendedor_id IS NOT NULL AND sucursal_id IS NOT NULL AND documento IS NOT NULL AND nombre IS NOT NULL AND apellidos IS NOT NULL"))
def clean_vendedores(spark, sf_dir):
    return exact_distinct(clean(view(spark, sf_dir, VENDEDORES), TABLES["vendedores"].rules))


def _reject_sql() -> str:
    sql = {"NotNull": "{c} IS NULL", "NonBlank": "NOT coalesce(length({c}) > 0, false)",
           "Matches": f"NOT ({{c}} IS NULL OR regexp_matches({{c}}, '{EMAIL.replace('{', '{{').replace('}', '}}')}'))"}
    cases = " ".join(f"WHEN {sql[type(c).__name__].format(c=c.column)} THEN '{rule_name(c)}'" for c in rule_checks(TABLES["clientes"].rules))
    change = ", ".join(f"{v} AS {k}" for k, v in _CLIENTES[0].items())
    return (f"SELECT failed_rule, count(*) AS n_rows FROM (SELECT CASE {cases} END AS failed_rule FROM (SELECT * REPLACE ({change}) FROM ({duck(CLIENTES)}))) "
            "WHERE failed_rule IS NOT NULL GROUP BY 1")


@query(_reject_sql())
def reject_report(spark, sf_dir):
    return rejects(view(spark, sf_dir, CLIENTES), TABLES["clientes"].rules).groupBy("failed_rule").agg(F.count("*").alias("n_rows"))


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return exact_distinct(docs.unionByName(docs))


_OLD = "select o_orderkey, case when o_orderkey%2=0 then null else o_custkey end as o_custkey, o_orderstatus from {orders}"
_NEW = "select o_orderkey, case when o_orderkey%4=0 then null else o_custkey end as o_custkey, o_orderstatus from {orders}"


@query(f"SELECT n.* FROM ({duck(_NEW)}) n WHERE NOT EXISTS (SELECT 1 FROM ({duck(_OLD)}) o WHERE n.o_orderkey IS NOT DISTINCT FROM o.o_orderkey "
       "AND n.o_custkey IS NOT DISTINCT FROM o.o_custkey AND n.o_orderstatus IS NOT DISTINCT FROM o.o_orderstatus)")
def anti_join_existing(spark, sf_dir):
    return drop_existing(view(spark, sf_dir, _NEW), view(spark, sf_dir, _OLD))


@query("SELECT 'events' AS table_name, CAST(epoch_us(max(ts)) AS BIGINT) AS last_value FROM events UNION ALL SELECT 'orders', max(o_orderkey) FROM orders")
def last_cursor_values(spark, sf_dir):
    events = table(spark, sf_dir, "events").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_value"))
    orders = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last_value"))
    return events.select(F.lit("events").alias("table_name"), "last_value").unionByName(orders.select(F.lit("orders").alias("table_name"), "last_value"))


def _raw(spark, name, spec, slices):
    path = store.scratch(spark, name)
    for part in slices:
        raw_layer.load_table(spark, spec, part, path)
    return store.read(spark, path)


@query("SELECT * FROM nation")
def bronze_full_reload(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return _raw(spark, "raw-nation", TableSpec("nation", ("n_nationkey",), "full_reload", ()), [nation, nation])


@query("SELECT * FROM orders")
def bronze_incremental_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    top = int(last_cursor(orders, "o_orderkey"))
    slices = [orders.filter(F.col("o_orderkey") <= top // 3), orders.filter(F.col("o_orderkey") <= 2 * top // 3), orders, orders]
    return _raw(spark, "raw-orders", TableSpec("orders", ("o_orderkey",), "incremental_id", (), cursor="o_orderkey"), slices)


@query(f"{duck(EVENTOS)} UNION ALL {duck(EVENTOS_DESPUES)}")
def bronze_incremental_ts(spark, sf_dir):
    first, later = view(spark, sf_dir, EVENTOS), view(spark, sf_dir, EVENTOS_DESPUES)
    return _raw(spark, "raw-events", EVENT_SPEC, [first, first.unionByName(later), later])


_HOURS = "select event_id, date_trunc('hour', ts) as ts from {events}"
_BEFORE = "event_id <= (select max(event_id) / 2 from events)"


@query(f"WITH h AS ({duck(_HOURS)}) SELECT * FROM h WHERE {_BEFORE} UNION ALL SELECT * FROM h WHERE ts > (SELECT max(ts) FROM h WHERE {_BEFORE})")
def bronze_ts_strict_boundary(spark, sf_dir):
    hours = table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    top = int(last_cursor(hours, "event_id"))
    first = hours.filter(F.col("event_id") <= top / 2)
    return _raw(spark, "raw-hours", TableSpec("events", ("event_id",), "incremental_timestamp", (), cursor="ts"), [first, hours])


_EVENT_CLEAN = f"SELECT * REPLACE ({title('tipo')} AS tipo)"
_EVENT_OK = "evento_id IS NOT NULL AND tipo IS NOT NULL AND valor > 0"


def _clean_runs(spark, name, spec, runs):
    path = store.scratch(spark, name)
    for raw in runs:
        clean_layer.load_table(spark, spec, raw, path)
    return clean_layer.read_table(spark, spec, path)


@query(f"SELECT DISTINCT * FROM ({_EVENT_CLEAN} FROM ({duck(EVENTOS)})) WHERE {_EVENT_OK}")
def silver_initial(spark, sf_dir):
    return _clean_runs(spark, "clean-events", EVENT_SPEC, [view(spark, sf_dir, EVENTOS)])


@query(f"WITH a AS (SELECT DISTINCT * FROM ({_EVENT_CLEAN} FROM ({duck(EVENTOS)})) WHERE {_EVENT_OK}), "
       f"b AS (SELECT DISTINCT * FROM ({_EVENT_CLEAN} FROM ({duck(EVENTOS_DESPUES)})) WHERE {_EVENT_OK}) "
       "SELECT * FROM a UNION ALL SELECT * FROM b WHERE ts > (SELECT max(ts) FROM a)")
def silver_incremental(spark, sf_dir):
    first = view(spark, sf_dir, EVENTOS)
    both = first.unionByName(view(spark, sf_dir, EVENTOS_DESPUES))
    return _clean_runs(spark, "clean-events", EVENT_SPEC, [first, both, both])


@query(f"SELECT DISTINCT * FROM ({_EVENT_CLEAN} FROM ({duck(EVENTOS)})) WHERE {_EVENT_OK}")
def silver_lookback(spark, sf_dir):
    """Every third event comes a run late, with a cursor below the greatest."""
    events = view(spark, sf_dir, EVENTOS)
    spec = TableSpec("eventos", ("evento_id",), "incremental_timestamp", EVENT_RULES, cursor="ts", clean_cursor="ts", lookback="interval 400 days")
    return _clean_runs(spark, "clean-events", spec, [events.filter("evento_id % 3 <> 0"), events, events])


@query(f"SELECT * FROM ({_EVENT_CLEAN} FROM ({duck(EVENTOS)} UNION ALL {duck(EVENTOS_DESPUES)})) WHERE {_EVENT_OK} AND evento_id = 10 ORDER BY ts")
def version_history(spark, sf_dir):
    return sales.version_history(silver_incremental(spark, sf_dir), "evento_id", 10, ["evento_id", "ts", "tipo", "valor"], "ts")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 2")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").filter("c_custkey = 2")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES))
def table_counts(spark, sf_dir):
    return store.counts({n: table(spark, sf_dir, n) for n in NAMES})


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def profile_head(spark, sf_dir):
    return store.profile(table(spark, sf_dir, "orders"), "o_orderkey")[2]


@query("SELECT n_nationkey FROM nation ORDER BY 1")
def ordered_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey")


_REQUIRED = ("factura_id", "numero_factura", "cliente_id", "vendedor_id", "impuesto_total", "estado")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS violations FROM ({duck(FACTURAS)})" for c in _REQUIRED))
def dq_not_null(spark, sf_dir):
    return checks.not_null(view(spark, sf_dir, FACTURAS), list(_REQUIRED))


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, sf_dir):
    return checks.unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_REFS = "select o_orderkey, case when o_custkey%7=0 then null when o_custkey%11=0 then -o_custkey-1 else o_custkey end as o_custkey from {orders}"


@query(f"SELECT * FROM ({duck(_REFS)}) o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)")
def dq_foreign_key(spark, sf_dir):
    return checks.orphans(view(spark, sf_dir, _REFS), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query(f"SELECT sucursal_id, producto_id, stock_minimo, stock_maximo FROM ({duck(INVENTARIO)}) WHERE NOT (stock_minimo >= 0 AND stock_maximo >= stock_minimo)")
def dq_check(spark, sf_dir):
    bad = checks.check(view(spark, sf_dir, INVENTARIO), "stock_minimo >= 0 and stock_maximo >= stock_minimo")
    return bad.select("sucursal_id", "producto_id", "stock_minimo", "stock_maximo")


@query("SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE NOT (o_orderstatus IN ('F', 'O')) GROUP BY 1")
def dq_domain(spark, sf_dir):
    return checks.domain(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


_PRICED = f"""
SELECT *, CAST(precio_unitario * cantidad - descuento_unitario * cantidad + impuesto_unitario * cantidad AS DECIMAL(14,2)) AS total_linea FROM (
 SELECT *, CAST(round_even((precio_unitario - descuento_unitario) * CAST(0.19 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS impuesto_unitario FROM (
  SELECT *, CAST(round_even(precio_unitario * descuento, 2) AS DECIMAL(12,2)) AS descuento_unitario FROM ({duck(LINEAS)})))
"""
_SUMS = f"""
SELECT factura_id, CAST(sum(precio_unitario * cantidad) AS DECIMAL(14,2)) AS subtotal, CAST(sum(descuento_unitario * cantidad) AS DECIMAL(14,2)) AS descuento_total,
 CAST(sum(impuesto_unitario * cantidad) AS DECIMAL(14,2)) AS impuesto_total, CAST(sum(total_linea) AS DECIMAL(14,2)) AS total FROM ({_PRICED}) GROUP BY 1
"""
_HEADERS = """
select o_orderkey as factura_id, cast(o_totalprice as decimal(14,2)) as subtotal, cast(0 as decimal(14,2)) as descuento_total,
 cast(0 as decimal(14,2)) as impuesto_total, cast(o_totalprice as decimal(14,2)) as total from {orders}
"""


def _lines(spark, sf_dir):
    return sales.price_lines(view(spark, sf_dir, LINEAS))


@query(_PRICED)
def line_pricing(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(_SUMS)
def invoice_rollup(spark, sf_dir):
    return sales.roll_up(_lines(spark, sf_dir))


@query(f"SELECT h.factura_id, {', '.join(f'coalesce(s.{a}, h.{a}) AS {a}' for a in sales.AMOUNTS)} FROM ({duck(_HEADERS)}) h LEFT JOIN ({_SUMS}) s ON h.factura_id = s.factura_id")
def header_update(spark, sf_dir):
    return sales.update_headers(view(spark, sf_dir, _HEADERS), sales.roll_up(_lines(spark, sf_dir)))


@query(f"SELECT coalesce(h.factura_id, s.factura_id) AS factura_id, h.total AS stored_total, s.total AS line_total FROM ({duck(_HEADERS)}) h "
       f"FULL JOIN ({_SUMS}) s ON h.factura_id = s.factura_id WHERE h.total IS DISTINCT FROM s.total")
def header_reconcile(spark, sf_dir):
    return sales.reconcile(view(spark, sf_dir, _HEADERS), sales.roll_up(_lines(spark, sf_dir)))


@query(f"SELECT producto_id, precio_venta FROM ({duck(PRODUCTOS)}) WHERE activo")
def active_price_list(spark, sf_dir):
    return sales.active_prices(view(spark, sf_dir, PRODUCTOS))


@query("SELECT s_nationkey AS sucursal_id, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS vendedores FROM supplier GROUP BY 1")
def sellers_by_store(spark, sf_dir):
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sucursal_id"), F.col("s_suppkey").alias("vendedor_id"))
    return sales.sellers_by_store(sellers).select("sucursal_id", F.array_join(F.transform("vendedores", lambda x: x.cast("string")), ",").alias("vendedores"))


_NOMBRES = "select c_custkey, concat('José ÑANDÚ Ýåř O''', c_name, ' \"', c_mktsegment, '\"') as nombre from {customer}"


@query(f"SELECT c_custkey, replace(replace(lower(strip_accents(nombre)), ' ', ''), '''', '') AS slug FROM ({duck(_NOMBRES)})")
def email_slug(spark, sf_dir):
    return view(spark, sf_dir, _NOMBRES).select("c_custkey", slug(F.col("nombre")).alias("slug"))


@query("SELECT l_orderkey AS factura_id, l_linenumber, l_quantity, l_extendedprice, o_custkey, o_orderstatus, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fact_sales(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("factura_id"), "l_linenumber", "l_quantity", "l_extendedprice")
    headers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("factura_id"), "o_custkey", "o_orderstatus", "o_orderdate")
    return sales.fact_sales(lines, headers)


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS r FROM events) WHERE r = 1")
def current_version(spark, sf_dir):
    return sales.current_version(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts")


@query("SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM events")
def scd2_ranges(spark, sf_dir):
    return sales.validity(table(spark, sf_dir, "events"), ["user_id"], "ts").select("user_id", "event_id", "valid_from", "valid_to")


@query(f"SELECT DISTINCT * FROM ({_EVENT_CLEAN} FROM ({duck(EVENTOS)})) WHERE {_EVENT_OK}")
def streaming_incremental(spark, sf_dir):
    """The files of a raw table, in two runs of a stream."""
    from .streaming.files import load_new_files

    events = view(spark, sf_dir, EVENTOS)
    folder, path, checkpoint = (store.scratch(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    for part in (events.filter("evento_id % 2 = 0"), events.filter("evento_id % 2 = 1")):
        part.write.mode("append").parquet(folder)
        load_new_files(spark, EVENT_SPEC, folder, events.schema, path, checkpoint)
    return store.read(spark, path)


@query(ORACLE_SQL["silver_incremental"])
def streaming_same_hop(spark, sf_dir):
    """The batch load's runs as files of a stream: the first rows, then both parts, so the first come again; the last batch is
    given twice."""
    from .streaming.files import add_batch, load_new_files

    first = view(spark, sf_dir, EVENTOS)
    both = first.unionByName(view(spark, sf_dir, EVENTOS_DESPUES))
    folder, path, checkpoint = (store.scratch(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    for part in (first, both):
        part.write.mode("append").parquet(folder)
        load_new_files(spark, BUCKET_SPEC, folder, first.schema, path, checkpoint)
    add_batch(spark, BUCKET_SPEC, both, path)
    return clean_layer.read_table(spark, BUCKET_SPEC, path)


@query(ORACLE_SQL["silver_incremental"])
def silver_bucketed(spark, sf_dir):
    """silver_incremental into a table whose buckets are looked up without a shuffle."""
    first = view(spark, sf_dir, EVENTOS)
    both = first.unionByName(view(spark, sf_dir, EVENTOS_DESPUES))
    return _clean_runs(spark, "clean-buckets", BUCKET_SPEC, [first, both, both])


@query(ORACLE_SQL["anti_join_existing"])
def anti_join_bucketed(spark, sf_dir):
    """anti_join_existing against a stored table in buckets."""
    path = store.scratch(spark, "old-orders")
    buckets.create(view(spark, sf_dir, _OLD), path, 8)
    new = view(spark, sf_dir, _NEW)
    return drop_existing(new, buckets.same_rows(new, path))


#: The source of each of the seven tables.
SOURCES = {"clientes": CLIENTES_TWICE, "productos": PRODUCTOS, "inventario": INVENTARIO, "facturas": FACTURAS, "detalles_factura": DETALLES,
           "sucursales": SUCURSALES, "vendedores": VENDEDORES}


def _sources(spark, sf_dir):
    return {n: view(spark, sf_dir, sql) for n, sql in SOURCES.items()}


def _all_raw(spark, sf_dir):
    """The seven tables loaded by their specs, twice from the same source: outcomes of both runs, and where the tables are."""
    sources, root = _sources(spark, sf_dir), store.scratch(spark, "raw")
    return [raw_layer.load_all(spark, list(TABLES.values()), sources.__getitem__, root) for _ in range(2)], root


_RAW_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM ({duck(sql)})" for n, sql in SOURCES.items())
_FULL = "('sucursales', 'vendedores')"


@query(f"SELECT table_name, 'full' AS first_run, CASE WHEN table_name IN {_FULL} THEN 'full' ELSE 'unchanged' END AS second_run, n_rows FROM ({_RAW_COUNTS})")
def raw_load_all(spark, sf_dir):
    """All raw tables, two runs: a table that did not change is left alone, and none grows."""
    (first, second), root = _all_raw(spark, sf_dir)
    counts = store.counts({n: store.read(spark, f"{root}/{n}") for n in TABLES})
    said = lambda run: F.create_map(*[F.lit(x) for pair in run.items() for x in pair])[F.col("table_name")]
    return counts.select("table_name", said(first).alias("first_run"), said(second).alias("second_run"), "n_rows")


@query("SELECT 'nation' AS table_name, true AS refused, count(*) AS n_rows FROM nation")
def raw_format_guard(spark, sf_dir):
    """A load in another format than the table's is refused, and the table stays."""
    nation, path = table(spark, sf_dir, "nation"), store.scratch(spark, "raw-nation")
    raw_layer.load_table(spark, TableSpec("nation", ("n_nationkey",), "full_reload", ()), nation, path)
    try:
        raw_layer.load_table(spark, TableSpec("nation", ("n_nationkey",), "full_reload", (), fmt="delta"), nation, path)
        refused = False
    except RuntimeError:
        refused = True
    return store.read(spark, path).agg(F.count("*").alias("n_rows")).select(F.lit("nation").alias("table_name"), F.lit(refused).alias("refused"), "n_rows")


_CLEAN = {"clientes": "clean_clientes", "productos": "clean_productos", "inventario": "clean_inventario", "facturas": "clean_facturas",
          "detalles_factura": "clean_detalles", "sucursales": "clean_sucursales", "vendedores": "clean_vendedores"}
_CLEAN_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, (SELECT count(*) FROM ({duck(SOURCES[n])})) AS read, count(*) AS inserted FROM (SELECT DISTINCT * FROM ({ORACLE_SQL[q]}))"
    for n, q in _CLEAN.items())


def _clean_twice(spark, sf_dir):
    _, raw_root = _all_raw(spark, sf_dir)
    clean_root = store.scratch(spark, "clean")
    runs = [clean_layer.load_all(spark, list(TABLES.values()), raw_root, clean_root) for _ in range(2)]
    return runs, clean_root


@query(f"SELECT table_name, 'full' AS mode, read, inserted, inserted AS n_rows FROM ({_CLEAN_COUNTS})")
def clean_load_all(spark, sf_dir):
    """All clean tables from all raw ones, two runs: what the first one reports, and the rows after the second."""
    (first, _), root = _clean_twice(spark, sf_dir)
    counts = store.counts({n: store.read(spark, f"{root}/{n}") for n in TABLES})
    return first.join(counts, "table_name").select("table_name", "mode", "read", "inserted", "n_rows")


@query(f"SELECT table_name, 'unchanged' AS mode, CAST(0 AS BIGINT) AS inserted FROM ({_RAW_COUNTS})")
def clean_load_metrics(spark, sf_dir):
    """What the second run over unchanged tables reports."""
    (_, second), _ = _clean_twice(spark, sf_dir)
    return second.select("table_name", "mode", "inserted")


# ---- declared constraints

def _report_sql() -> str:
    """Each constraint of the registry as a statement of its own, for columns that the views have."""
    parts = []
    for table_name, spec in TABLES.items():
        src, c, has = f"({duck(SOURCES[table_name])})", spec.constraints, set(re.findall(r"\bas (\w+)", SOURCES[table_name]))
        say = lambda name, kind, sql: parts.append(f"SELECT '{table_name}' AS table_name, '{name}' AS name, '{kind}' AS kind, CAST(({sql}) AS BIGINT) AS violations")  # noqa: B023, E731
        twice = lambda key: (f"SELECT count(*) FROM (SELECT 1 FROM {src} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in key)} "  # noqa: B023, E731
                             f"GROUP BY {', '.join(key)} HAVING count(*) > 1)")
        for x in dict.fromkeys((*spec.key, *c.not_null)):
            if x in has:
                say(f"nn_{x}", "not null", f"SELECT count(*) FROM {src} WHERE {x} IS NULL")
        for name, predicate in c.checks:
            say(f"chk_{name}", "check", f"SELECT count(*) FROM {src} WHERE NOT ({predicate})")
        for x, values in c.domains:
            say(f"dom_{x}", "domain", f"SELECT count(*) FROM {src} WHERE NOT ({x} IN {values})")
        say("pk_" + "_".join(spec.key), "primary key", twice(spec.key))
        for u in c.unique:
            say("uq_" + "_".join(u), "unique", twice(u))
        for r in c.references:
            say(f"fk_{r.column}", "reference", f"SELECT count(*) FROM {src} c WHERE {r.column} IS NOT NULL AND NOT EXISTS "
                                               f"(SELECT 1 FROM ({duck(SOURCES[r.table])}) p WHERE p.{r.key} = c.{r.column})")
    return " UNION ALL ".join(parts)


@query(_report_sql())
def dq_report(spark, sf_dir):
    """All constraints of the seven tables, the eight references among them."""
    return checks.report(spark, _sources(spark, sf_dir), {n: (s.key, s.constraints) for n, s in TABLES.items()})


_BROKEN = " UNION ALL ".join(
    f"SELECT factura_id, '{name}' AS name FROM ({duck(FACTURAS)}) WHERE {test}" for name, test in
    [(f"nn_{x}", f"{x} IS NULL") for x in ("factura_id", *(x for x in TABLES["facturas"].constraints.not_null if x != "created_at"))]
    + [(f"chk_{n}", f"NOT ({p})") for n, p in TABLES["facturas"].constraints.checks] + [("dom_estado", "NOT (estado IN ('PAGADA', 'NULA', 'DEVUELTA'))")])


@query(f"SELECT factura_id, string_agg(name, ',' ORDER BY name) AS broken FROM ({_BROKEN}) GROUP BY 1")
def dq_broken_rows(spark, sf_dir):
    """The invoices that break a constraint, with all that each breaks."""
    spec = TABLES["facturas"]
    bad = checks.flagged(view(spark, sf_dir, FACTURAS), spec.key, spec.constraints)
    return bad.select("factura_id", F.array_join(F.array_sort("broken"), ",").alias("broken"))


# ---- stored results that new rows change

_STORED_HEADERS = """
select o_orderkey as factura_id, cast(o_totalprice as decimal(14,2)) as subtotal, cast(0 as decimal(14,2)) as descuento_total,
 cast(0 as decimal(14,2)) as impuesto_total, cast(o_totalprice as decimal(14,2)) as total, year(o_orderdate) as anio from {orders}
"""


@query(ORACLE_SQL["header_update"])
def header_write_back(spark, sf_dir):
    """header_update written back to a stored table, partitioned by year, in two runs; the second finds nothing to change."""
    path = store.scratch(spark, "headers")
    view(spark, sf_dir, _STORED_HEADERS).write.partitionBy("anio").parquet(path)
    sums = sales.roll_up(_lines(spark, sf_dir))
    maintained.write_back_headers(spark, path, sums, "anio")
    if maintained.write_back_headers(spark, path, sums, "anio"):
        raise RuntimeError("a header changed twice")
    return spark.read.parquet(path).drop("anio")


@query(ORACLE_SQL["invoice_rollup"])
def rollup_maintained(spark, sf_dir):
    """invoice_rollup from three batches of lines; every fifth line first comes with another price, and is retracted later."""
    lines, path = _lines(spark, sf_dir), store.scratch(spark, "sums")
    wrong = sales.price_lines(view(spark, sf_dir, LINEAS).withColumn("precio_unitario", (F.col("precio_unitario") + 1).cast("decimal(12,2)")))
    bad = wrong.filter("detalle_id % 5 = 0")
    for k in range(3):
        good = lines.filter(f"detalle_id % 3 = {k} and detalle_id % 5 <> 0")
        maintained.maintain_roll_up(spark, path, good.unionByName(bad.filter(f"detalle_id % 3 = {k}")), parts=8)
    maintained.maintain_roll_up(spark, path, lines.filter("detalle_id % 5 = 0"), bad, parts=8)
    return maintained.sums_of(spark, path)


@query("SELECT user_id, event_id, ts, valid_from, valid_to FROM (SELECT user_id, event_id, ts, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM events)")
def ranges_maintained(spark, sf_dir):
    """scd2_ranges from batches in which versions come late, and some of them twice."""
    events, path = table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), store.scratch(spark, "ranges")
    for batch in (events.filter("event_id % 4 = 1"), events.filter("event_id % 4 in (0, 3)"), events.filter("event_id % 4 in (1, 2) and event_id % 3 <> 0"),
                  events.filter("event_id % 4 in (1, 2)")):
        maintained.maintain_ranges(spark, path, batch, ["user_id"], "ts", parts=8)
    return maintained.ranges_of(spark, path)


_OUTCOMES = f"""
SELECT 'first' AS run, table_name, 'loaded' AS status, inserted FROM ({_CLEAN_COUNTS})
UNION ALL SELECT 'second', table_name, CASE WHEN table_name = 'productos' THEN 'failed' WHEN table_name IN ('inventario', 'detalles_factura') THEN 'skipped' ELSE 'loaded' END,
 CASE WHEN table_name NOT IN ('productos', 'inventario', 'detalles_factura') THEN 0 END FROM ({_CLEAN_COUNTS})
"""


@query(_OUTCOMES)
def run_ledger(spark, sf_dir):
    """Two runs over all tables, side by side. In the second the raw products cannot be read: that load fails, the two tables that
    refer to products are skipped, and the others go on."""
    from .plans import runs

    sources, specs = _sources(spark, sf_dir), list(TABLES.values())
    raw_root, clean_root, ledger = (store.scratch(spark, n) for n in ("raw", "clean", "ledger"))
    runs.run_raw(spark, specs, sources.__getitem__, raw_root, ledger, run_id="raw")
    runs.run_clean(spark, specs, raw_root, clean_root, ledger, run_id="first")
    store.delete(spark, f"{raw_root}/productos")
    runs.run_clean(spark, specs, raw_root, clean_root, ledger, run_id="second")
    return runs.last_runs(spark, ledger).select("run", "table_name", "status", "inserted")
