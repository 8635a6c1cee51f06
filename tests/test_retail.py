"""Rules, loads, checks and sales on small fixtures."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelake.functions.text import NORMALISE, cents, slug
from tidelake.operators import checks, sales
from tidelake.operators.incremental import drop_existing, last_cursor, newer_than
from tidelake.operators.rules import AtLeast, NotNull, Normalise, clean, exact_distinct, rejects
from tidelake.plans import clean as clean_layer
from tidelake.plans import raw as raw_layer
from tidelake.plans.registry import TABLES
from tidelake.plans.spec import TableSpec
from tidelake.sources import store
from tidelake.sources.jdbc import JdbcSource


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_normal_forms(spark):
    df = column(spark, ["Coca-Cola", "  o'NEIL mc  donald ", "áNGEL ñu", None])
    assert [r[0] for r in df.select(NORMALISE["title"](F.col("x"))).collect()] == ["Coca-cola", "O'neil Mc  Donald", "Ángel Ñu", None]
    assert column(spark, [" \ta\t "]).select(NORMALISE["trim"](F.col("x"))).first()[0] == "\ta\t"
    assert column(spark, ["José Ñandú O'Neil"]).select(slug(F.col("x"))).first()[0] == "josenanduoneil"
    odd = {"Ýåř \"x\"": 'yar"x"', "İstanbul ŠÁ": "istanbulsa", "e\u0301": "e", "ﬁn ½": "fin1⁄2", "Ǆ": "dz", "한글": "\u1112\u1161\u11ab\u1100\u1173\u11af", "𝐀": "a", "Ÿ": "y"}
    assert {r.x: r.s for r in column(spark, list(odd)).select("x", slug(F.col("x")).alias("s")).collect()} == odd
    df = column(spark, [Decimal("0.125"), Decimal("0.135"), Decimal("2.345")], "decimal(10,3)")
    assert [r[0] for r in df.select(cents(F.col("x"))).collect()] == [Decimal("0.12"), Decimal("0.14"), Decimal("2.34")]


def clientes(spark, **change):
    base = {"cliente_id": 1, "tipo_documento": " cc", "numero_documento": " 9 ", "nombre": "ANA", "apellido": "x", "correo": None,
            "telefono": None, "ciudad": None, "updated_at": 5}
    return {**base, **change}


CLIENTES = "cliente_id int, tipo_documento string, numero_documento string, nombre string, apellido string, correo string, telefono string, ciudad string, updated_at long"


def frame(spark, records, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], schema)


def test_email_rule(spark):
    mails = [None, "", "a@b..co", "josé@b.co", "bad@x", "a@b.co\n", " Ana@B.co "]
    df = frame(spark, [clientes(spark, cliente_id=i, correo=m) for i, m in enumerate(mails)], CLIENTES)
    kept = {r.cliente_id: r.correo for r in clean(df, TABLES["clientes"].rules).collect()}
    assert kept == {0: None, 2: "a@b..co", 5: "a@b.co\n", 6: "ana@b.co"}


def test_clean_is_idempotent_and_complete(spark):
    changes = [{}, {"nombre": "  "}, {"apellido": None}, {"updated_at": None}, {"numero_documento": "\t"}, {}]
    df = frame(spark, [clientes(spark, cliente_id=i, **c) for i, c in enumerate(changes)], CLIENTES)
    rules = TABLES["clientes"].rules
    once = clean(df, rules)
    assert rows(clean(once, rules)) == rows(once)
    assert once.count() + rejects(df, rules).count() == df.count()
    assert {(r.cliente_id, r.failed_rule) for r in rejects(df, rules).collect()} == {
        (1, "NonBlank(nombre)"), (2, "NotNull(apellido)"), (3, "NotNull(updated_at)")}


def test_stock_rules_and_sql_checks(spark):
    df = spark.createDataFrame([(1, 5, 2, 9), (2, 5, 2, None), (3, 5, 9, 2), (4, -1, 0, 9), (5, 0, 0, 0)],
                               "producto_id int, cantidad_disponible int, stock_minimo int, stock_maximo int")
    df = df.withColumns({"sucursal_id": F.lit(1), "fecha_actualizacion": F.lit(1)})
    assert [r.producto_id for r in clean(df, TABLES["inventario"].rules).orderBy("producto_id").collect()] == [1, 5]
    bad = checks.check(df, "cantidad_disponible >= 0 and stock_minimo >= 0 and (stock_maximo is null or stock_maximo >= stock_minimo)")
    assert sorted(r.producto_id for r in bad.collect()) == [3, 4]


def test_sellers_keep_the_raw_surname(spark):
    df = spark.createDataFrame([(1, 1, "d", "ANA", " pérez LÓPEZ ", None)],
                               "vendedor_id int, sucursal_id int, documento string, nombre string, apellidos string, correo string")
    r = clean(df, TABLES["vendedores"].rules).first()
    assert (r.apellidos, r.apellido, r.nombre) == (" pérez LÓPEZ ", "Pérez López", "Ana")


def test_anti_join_keeps_duplicates_and_matches_nulls(spark):
    s = "a int, b string, c string"
    new = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (2, "b", "x")], s)
    old = spark.createDataFrame([(1, "a", None)], s)
    assert rows(drop_existing(new, old)) == [(2, "b", "x"), (2, "b", "x")]
    assert drop_existing(new, new).isEmpty()


def test_dedup_of_doubles(spark):
    assert exact_distinct(column(spark, [0.0, -0.0, float("nan"), float("nan")], "double")).count() == 2


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_cursor_under_a_foreign_session_zone(spark, kind):
    spark.conf.set("spark.sql.session.timeZone", "America/Bogota")
    try:
        df = spark.sql(f"select cast(x as {kind}) as ts from values ('2024-01-01 12:00:00.000001'), ('2024-01-01 11:00:00') t(x)")
        last = last_cursor(df, "ts")
        assert newer_than(df, "ts", last).count() == 0
        assert newer_than(df, "ts", last, "interval 0 seconds").count() == 1
        assert newer_than(df, "ts", None).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cursor_filter_reaches_the_files(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    df = newer_than(spark.read.parquet(f"{tmp_path}/t"), "id", "5")
    assert "GreaterThan(id,5)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 4


SPEC = TableSpec("t", ("id",), "incremental_id", (NotNull("id"), Normalise("upper", "x"), AtLeast("n")), cursor="id", clean_cursor="id")
SCHEMA = "id int, x string, n int"


def test_raw_loads(spark, tmp_path):
    path = f"{tmp_path}/t"
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    b = a.unionByName(spark.createDataFrame([(3, "c", 1), (2, "changed", 1)], SCHEMA))
    assert [raw_layer.load_table(spark, SPEC, d, path) for d in (a, b, b)] == ["full", "appended", "unchanged"]
    assert sorted(r.id for r in store.read(spark, path).collect()) == [1, 2, 3]
    full = TableSpec("t", ("id",), "full_reload", ())
    assert raw_layer.load_table(spark, full, a, path) == "full" and store.read(spark, path).count() == 2


def test_raw_load_into_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    a = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    store.overwrite(a.limit(0), path)
    assert raw_layer.load_table(spark, SPEC, a, path) == "appended" and store.read(spark, path).count() == 1


def test_ties_load_with_lookback_only(spark, tmp_path):
    a = spark.createDataFrame([(5, "a", 1)], SCHEMA)
    b = a.unionByName(spark.createDataFrame([(5, "tie", 1), (4, "late", 1)], SCHEMA))
    for lookback, n in ((None, 1), ("1", 3)):
        spec = TableSpec("t", ("id",), "incremental_id", SPEC.rules, cursor="id", clean_cursor="id", lookback=lookback)
        path = f"{tmp_path}/{n}"
        for d in (a, b, b):
            last = clean_layer.load_table(spark, spec, d, path)
        assert store.read(spark, path).count() == n and last.mode == "unchanged"


def test_clean_loads_and_metrics(spark, tmp_path):
    path = f"{tmp_path}/c"
    a = spark.createDataFrame([(1, " a", 1), (1, "A", 1), (2, "b", -1)], SCHEMA)
    m = clean_layer.load_table(spark, SPEC, a, path)
    assert (m.mode, m.read, m.accepted, m.inserted) == ("full", 3, 2, 1)
    b = a.unionByName(spark.createDataFrame([(3, "c", 1), (4, "d", None)], SCHEMA))
    m = clean_layer.load_table(spark, SPEC, b, path)
    assert (m.mode, m.last_cursor, m.read, m.accepted, m.inserted) == ("appended", "1", 3, 1, 1)
    assert clean_layer.load_table(spark, SPEC, b, path).mode == "unchanged"
    assert rows(store.read(spark, path)) == [(1, "A", 1), (3, "C", 1)]


def test_batches_equal_one_load(spark, tmp_path):
    df = spark.range(30).selectExpr("cast(id as int) as id", "cast(id as string) as x", "1 as n")
    for i in (9, 19, 29):
        raw_layer.load_table(spark, SPEC, df.filter(f"id <= {i}"), f"{tmp_path}/k")
    raw_layer.load_table(spark, SPEC, df, f"{tmp_path}/one")
    assert rows(store.read(spark, f"{tmp_path}/k")) == rows(store.read(spark, f"{tmp_path}/one"))


def test_all_tables(spark, tmp_path):
    specs = [SPEC, TableSpec("u", ("id",), "full_reload", SPEC.rules, clean_cursor="id", clean_mode="replace")]
    source = {s.name: spark.createDataFrame([(1, "a", 1)], SCHEMA) for s in specs}
    assert raw_layer.load_all(spark, specs, source.get, f"{tmp_path}/raw") == {"t": "full", "u": "full"}
    out = clean_layer.load_all(spark, specs, f"{tmp_path}/raw", f"{tmp_path}/clean").collect()
    assert [(r.table_name, r.inserted) for r in out] == [("t", 1), ("u", 1)]


def test_store_refuses_other_schemas_and_formats(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(3)
    store.overwrite(df, path)
    with pytest.raises(ValueError):
        store.append(df.withColumn("y", F.lit(1)), path)
    with pytest.raises(ValueError):
        store.overwrite(df.withColumn("y", F.lit(1)), path, replace_schema=False)
    with pytest.raises(RuntimeError):
        store.append(df, path, "delta")
    assert store.format_of(spark, path) == "parquet" and store.format_of(spark, f"{path}-no") is None


def test_staged_overwrite_of_what_is_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    store.staged_overwrite(store.read(spark, path).filter("id > 2"), path)
    assert rows(store.read(spark, path)) == [(3,), (4,)]


def test_convert_and_profile(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    assert store.convert(spark, f"{tmp_path}/a", f"{tmp_path}/b", "parquet", "orc") == 5
    schema, n, head = store.profile(spark.range(20), "id")
    assert "id: long" in schema and n == 20 and [r.id for r in head.collect()] == list(range(10))


def test_specs_are_validated():
    with pytest.raises(ValueError):
        TableSpec("t", ("id",), "upsert", ())
    with pytest.raises(ValueError):
        TableSpec("t", ("id",), "incremental_id", ())


def test_constraint_reports(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 7), (None, 7)], "k int, v int")
    assert rows(checks.not_null(df, ["k", "v"])) == [("k", 1), ("v", 2)]
    assert rows(checks.unique(df, ["k"])) == [(1, 2)]
    assert rows(checks.unique(df, ["k"], primary=True)) == [(1, 2), (None, 1)]
    assert rows(checks.orphans(df, "k", spark.createDataFrame([(1,)], "id int"), "id")) == [(2, 7)]
    assert rows(checks.domain(df, "v", [8])) == [(2, 7), (None, 7)]


def test_pricing_and_headers(spark):
    lines = spark.createDataFrame([(1, 3, Decimal("19999.99"), Decimal("0.00")), (1, 2, Decimal("0.50"), Decimal("0.25"))],
                                  "factura_id int, cantidad int, precio_unitario decimal(12,2), descuento decimal(4,2)")
    priced = sales.price_lines(lines)
    a, b = priced.orderBy("precio_unitario").collect()
    assert (b.impuesto_unitario, b.total_linea) == (Decimal("3800.00"), Decimal("71399.97"))
    assert (a.descuento_unitario, a.impuesto_unitario) == (Decimal("0.12"), Decimal("0.07"))
    heads = spark.createDataFrame([(i, *[Decimal("1.00")] * 4) for i in (1, 2)],
                                  "factura_id int, " + ", ".join(f"{c} decimal(14,2)" for c in sales.AMOUNTS))
    new = {r.factura_id: r.total for r in sales.update_headers(heads, sales.roll_up(priced)).collect()}
    assert new == {1: b.total_linea + a.total_linea, 2: Decimal("1.00")}
    assert sorted(r.factura_id for r in sales.reconcile(heads, sales.roll_up(priced)).collect()) == [1, 2]


def test_versions(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, None)], "id int, at int, x string")
    assert rows(sales.current_version(df, ["id"], "at")) == [(1, 20, "b"), (2, 5, None)]
    assert rows(sales.validity(df, ["id"], "at").select("id", "valid_from", "valid_to")) == [(1, 10, 20), (1, 20, None), (2, 5, None)]
    assert [tuple(r) for r in sales.version_history(df, "id", 1, ["at", "x"], "at").collect()] == [(10, "a"), (20, "b")]


def test_stream_reads_each_file_once(spark, tmp_path):
    from tidelake.streaming.files import load_new_files

    for part in range(2):
        spark.createDataFrame([(part, "a", 1), (part, "A ", 1)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        load_new_files(spark, SPEC, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert rows(store.read(spark, f"{tmp_path}/out")) == [(0, "A", 1), (1, "A", 1)]


def test_jdbc(spark):
    source = JdbcSource("jdbc:derby:memory:tide;create=true", "org.apache.derby.jdbc.EmbeddedDriver")
    df = spark.createDataFrame([(i, datetime(2024, 1, 1, 0, 0, i, 5)) for i in range(9)], "ID int, TS timestamp")
    df.write.format("jdbc").options(url=source.url, driver=source.driver, dbtable="T").save()
    assert source.table(spark, "T").count() == 9
    split = source.table(spark, "T", split_by="ID", partitions=3)
    assert split.rdd.getNumPartitions() == 3 and split.count() == 9
    new = source.newer(spark, "T", "TS", "2024-01-01 00:00:06.000005")
    assert sorted(r.ID for r in new.collect()) == [7, 8]
    assert "GreaterThan(TS" in new._jdf.queryExecution().executedPlan().toString()
    assert JdbcSource.postgres("h", 1, "d", "u", "p").url == "jdbc:postgresql://h:1/d"


def test_cursor_where_clocks_go_back(spark):
    """An hour that comes twice in the session's zone: nothing is loaded again, later rows are."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        seconds = [1730614000, 1730615400, 1730615400 + 1800, 1730619000]  # on both sides of 2024-11-03T06:00Z
        df = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "id int, s long").select("id", F.timestamp_seconds("s").alias("ts"))
        for k in range(len(seconds)):
            last = last_cursor(df.filter(F.col("id") <= k), "ts")
            assert [r.id for r in newer_than(df, "ts", last).orderBy("id").collect()] == list(range(k + 1, len(seconds)))
        assert newer_than(df, "ts", last_cursor(df, "ts"), "interval 1 hour").count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_full_load_that_fails_leaves_the_table(spark, tmp_path):
    path, spec = f"{tmp_path}/t", TableSpec("t", ("id",), "full_reload", ())
    raw_layer.load_table(spark, spec, spark.range(5), path)
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        raw_layer.load_table(spark, spec, broken, path)
    assert store.read(spark, path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_conversion_in_place(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(7).write.parquet(path)
    assert [store.convert(spark, path, path, "parquet", "orc") for _ in range(2)] == [7, 7]
    assert store.format_of(spark, path) == "orc" and store.read(spark, path, "orc").count() == 7


def test_a_run_without_news_says_what_it_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    spec = TableSpec("t", ("id",), "incremental_id", (NotNull("x"),), cursor="id", clean_cursor="id", lookback="10")
    runs = [clean_layer.load_table(spark, spec, df, f"{tmp_path}/t") for _ in range(2)]
    assert [(r.mode, r.read, r.accepted, r.inserted) for r in runs] == [("full", 2, 1, 1), ("unchanged", 2, 1, 0)]
