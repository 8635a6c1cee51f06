"""The seven retail tables."""

from __future__ import annotations

from ..functions.text import EMAIL
from ..operators.checks import Constraints, Reference
from ..operators.rules import Above, AtLeast, Matches, NonBlank, Normalise, NotBelow, NotNull, Rule
from .spec import TableSpec

# The states that an invoice can have.
INVOICE_STATES = ("PAGADA", "NULA", "DEVUELTA")


def required(*columns: str) -> list[Rule]:
    return [NotNull(c) for c in columns]


def normal(kind: str, *columns: str) -> list[Rule]:
    return [Normalise(kind, c) for c in columns]


TABLES = {t.name: t for t in (
    TableSpec("clientes", ("cliente_id",), "incremental_timestamp", cursor="updated_at", clean_cursor="updated_at", rules=(
        *required("cliente_id", "tipo_documento", "numero_documento", "nombre", "apellido", "updated_at"),
        *normal("upper", "tipo_documento"), *normal("title", "nombre", "apellido", "ciudad"),
        *normal("lower", "correo"), *normal("trim", "numero_documento", "telefono"),
        NonBlank("numero_documento"), NonBlank("nombre"), NonBlank("apellido"), Matches("correo", EMAIL)),
        constraints=Constraints(not_null=("fecha_registro", "activo", "updated_at"), unique=(("numero_documento",),))),
    TableSpec("productos", ("producto_id",), "incremental_timestamp", cursor="updated_at", clean_cursor="updated_at", rules=(
        *required("producto_id", "codigo_barras", "nombre", "updated_at"),
        *normal("title", "nombre", "categoria", "subcategoria", "marca"), *normal("trim", "codigo_barras"),
        AtLeast("precio_venta"), AtLeast("costo_unitario")),
        constraints=Constraints(
            not_null=("codigo_barras", "nombre", "categoria", "precio_venta", "costo_unitario", "activo", "created_at", "updated_at"), unique=(("codigo_barras",),),
            checks=(("precio_venta", "precio_venta >= 0"), ("costo_unitario", "costo_unitario >= 0")))),
    TableSpec("inventario", ("inventario_id",), "incremental_timestamp", cursor="fecha_actualizacion", clean_cursor="fecha_actualizacion", rules=(
        *required("sucursal_id", "producto_id", "fecha_actualizacion"),
        AtLeast("cantidad_disponible"), AtLeast("stock_minimo"), AtLeast("stock_maximo"), NotBelow("stock_maximo", "stock_minimo")),
        constraints=Constraints(
            not_null=("sucursal_id", "producto_id", "cantidad_disponible", "stock_minimo", "fecha_actualizacion"), unique=(("sucursal_id", "producto_id"),),
            references=(Reference("sucursal_id", "sucursales", "sucursal_id"), Reference("producto_id", "productos", "producto_id")),
            checks=(("cantidad", "cantidad_disponible >= 0"), ("minimo", "stock_minimo >= 0"), ("maximo", "stock_maximo is null or stock_maximo >= stock_minimo")))),
    TableSpec("facturas", ("factura_id",), "incremental_id", cursor="factura_id", clean_cursor="factura_id", rules=(
        *required("factura_id", "numero_factura", "sucursal_id", "vendedor_id", "fecha_hora"),
        *normal("upper", "numero_factura", "metodo_de_pago", "estado"),
        AtLeast("subtotal"), AtLeast("descuento_total"), AtLeast("impuesto_total"), AtLeast("total")),
        constraints=Constraints(
            not_null=("numero_factura", "sucursal_id", "vendedor_id", "fecha_hora", "metodo_de_pago", "subtotal", "descuento_total", "impuesto_total", "total", "estado", "created_at"),
            unique=(("numero_factura",),),
            references=(Reference("cliente_id", "clientes", "cliente_id"), Reference("sucursal_id", "sucursales", "sucursal_id"),
                        Reference("vendedor_id", "vendedores", "vendedor_id")),
            checks=(("subtotal", "subtotal >= 0"), ("descuento", "descuento_total >= 0"), ("impuesto", "impuesto_total >= 0"), ("total", "total >= 0")),
            domains=(("estado", INVOICE_STATES),))),
    TableSpec("detalles_factura", ("detalle_id",), "incremental_id", cursor="detalle_id", clean_cursor="detalle_id", rules=(
        *required("detalle_id", "factura_id", "producto_id"), Above("cantidad"),
        AtLeast("precio_unitario"), AtLeast("descuento_unitario"), AtLeast("impuesto_unitario"), AtLeast("total_linea")),
        constraints=Constraints(
            not_null=("factura_id", "producto_id", "cantidad", "precio_unitario", "descuento_unitario", "impuesto_unitario", "total_linea", "created_ad"),
            unique=(("factura_id", "producto_id"),),
            references=(Reference("factura_id", "facturas", "factura_id"), Reference("producto_id", "productos", "producto_id")),
            checks=(("cantidad", "cantidad > 0"), ("precio", "precio_unitario >= 0"), ("descuento", "descuento_unitario >= 0"),
                    ("impuesto", "impuesto_unitario >= 0"), ("total", "total_linea >= 0")))),
    TableSpec("sucursales", ("sucursal_id",), "full_reload", clean_cursor="sucursal_id", rules=(
        *required("sucursal_id", "nombre", "ciudad"), *normal("title", "nombre", "ciudad"), *normal("trim", "direccion")),
        constraints=Constraints(not_null=("nombre", "ciudad", "activa", "create_at"))),
    TableSpec("vendedores", ("vendedor_id",), "full_reload", clean_cursor="vendedor_id", rules=(
        *required("vendedor_id", "sucursal_id", "documento", "nombre", "apellidos"),
        *normal("title", "nombre"), Normalise("title", "apellidos", into="apellido"),
        *normal("lower", "correo"), *normal("trim", "documento")),
        constraints=Constraints(not_null=("sucursal_id", "documento", "nombre", "apellidos", "fecha_de_contratacion", "activo", "create_at"), unique=(("documento",),),
                                references=(Reference("sucursal_id", "sucursales", "sucursal_id"),))),
)}
