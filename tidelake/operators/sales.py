"""Invoice arithmetic, roll-ups, facts and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cents

# Fixed value: the tax rate of an invoice line.
TAX = "0.19"
AMOUNTS = ("subtotal", "descuento_total", "impuesto_total", "total")


def price_lines(lines: DataFrame) -> DataFrame:
    """Adds descuento_unitario, impuesto_unitario, total_linea.

    Needs cantidad, precio_unitario decimal(12,2) and descuento decimal(4,2), a share.
    """
    price, q = F.col("precio_unitario"), F.col("cantidad")
    off = cents(price * F.col("descuento")).cast("decimal(12,2)")
    df = lines.withColumn("descuento_unitario", off)
    tax = cents((price - F.col("descuento_unitario")) * F.lit(TAX).cast("decimal(3,2)")).cast("decimal(12,2)")
    df = df.withColumn("impuesto_unitario", tax)
    total = price * q - F.col("descuento_unitario") * q + F.col("impuesto_unitario") * q
    return df.withColumn("total_linea", total.cast("decimal(14,2)"))


def roll_up(lines: DataFrame) -> DataFrame:
    """Four sums for each invoice."""
    q = F.col("cantidad")
    sums = (F.col("precio_unitario") * q, F.col("descuento_unitario") * q, F.col("impuesto_unitario") * q, F.col("total_linea"))
    return lines.groupBy("factura_id").agg(*[F.sum(s).cast("decimal(14,2)").alias(a) for s, a in zip(sums, AMOUNTS)])


def update_headers(headers: DataFrame, sums: DataFrame) -> DataFrame:
    """Headers with the sums of their lines; headers without lines stay as they are."""
    new = sums.select("factura_id", *[F.col(a).alias(f"new_{a}") for a in AMOUNTS])
    joined = headers.join(new, "factura_id", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).cast("decimal(14,2)").alias(c) if c in AMOUNTS else F.col(c) for c in headers.columns])


def reconcile(headers: DataFrame, sums: DataFrame) -> DataFrame:
    """Invoices whose stored total is not the sum of their lines, or that one side lacks."""
    a = headers.select("factura_id", F.col("total").alias("stored_total"))
    b = sums.select("factura_id", F.col("total").alias("line_total"))
    return a.join(b, "factura_id", "full").filter(~F.col("stored_total").eqNullSafe(F.col("line_total")))


def active_prices(products: DataFrame) -> DataFrame:
    return products.filter("activo").select("producto_id", "precio_venta")


def sellers_by_store(sellers: DataFrame) -> DataFrame:
    """The sorted seller ids of each store."""
    return sellers.groupBy("sucursal_id").agg(F.sort_array(F.collect_list("vendedor_id")).alias("vendedores"))


def fact_sales(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """One row for each invoice line, with its header."""
    return lines.join(headers, "factura_id")


def current_version(df: DataFrame, key: list[str], cursor: str) -> DataFrame:
    """The newest row of each key. An aggregate, so that a key's versions need no sort and combine early."""
    row = F.max_by(F.struct(*df.columns), F.struct(cursor, *[c for c in df.columns if c not in key and c != cursor]))
    return df.groupBy(*key).agg(row.alias("_row")).select("_row.*")


def validity(df: DataFrame, key: list[str], cursor: str) -> DataFrame:
    """Versions with valid_from and valid_to, which is null for the newest."""
    w = Window.partitionBy(*key).orderBy(cursor)
    return df.withColumns({"valid_from": F.col(cursor), "valid_to": F.lead(cursor).over(w)})


def version_history(df: DataFrame, key: str, value: int, columns: list[str], cursor: str) -> DataFrame:
    """The versions of one key, the oldest first."""
    return df.filter(F.col(key) == value).select(*columns).orderBy(cursor)
