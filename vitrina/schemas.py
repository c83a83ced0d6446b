"""Declared table schemas as DDL. Input is cast to these once, at ingest; nothing is inferred."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    # field operations
    "actividad": (
        "cliente_id BIGINT, usuario_id BIGINT, cuadrilla_id BIGINT, punto_venta_id BIGINT,"
        " fecha_planeada DATE, fecha_real_inicio TIMESTAMP_NTZ, fecha_real_final TIMESTAMP_NTZ,"
        " is_tarea BOOLEAN, is_no_planeada BOOLEAN, latitude_check_in DOUBLE,"
        " longitude_check_in DOUBLE, latitude_pdv DOUBLE, longitude_pdv DOUBLE"
    ),
    "jornada_diaria": (
        "id BIGINT, usuario_id BIGINT, cuadrilla_id BIGINT, cliente_id BIGINT, fecha TIMESTAMP_NTZ,"
        " incidencia STRING, tipo INT, ausencia_id BIGINT, fecha_creacion TIMESTAMP_NTZ,"
        " fecha_actualizacion TIMESTAMP_NTZ, status BOOLEAN"
    ),
    "user": (
        "id BIGINT, username STRING, user_real_name STRING, email STRING, perfil INT,"
        " cuadrilla_id BIGINT, cliente_id BIGINT, telefono STRING, last_login TIMESTAMP_NTZ,"
        " fecha_creacion TIMESTAMP_NTZ, enabled BOOLEAN, status BOOLEAN"
    ),
    "cuadrilla": (
        "id BIGINT, nombre STRING, entidad STRING, puesto STRING, agencia STRING, region STRING,"
        " plaza STRING, ruta STRING, tipo INT, fecha_creacion TIMESTAMP_NTZ,"
        " fecha_actualizacion TIMESTAMP_NTZ, status BOOLEAN"
    ),
    "ausencia": "id BIGINT, nombre STRING, is_justificada BOOLEAN, status BOOLEAN",
    "servicio": (
        "id BIGINT, clave STRING, descripcion STRING, productividad DECIMAL(19,5), tiempo INT,"
        " pdv BOOLEAN, requiere_autorizacion BOOLEAN, cliente_id BIGINT,"
        " fecha_creacion TIMESTAMP_NTZ, fecha_actualizacion TIMESTAMP_NTZ, status BOOLEAN"
    ),
    "punto_venta": (
        "id BIGINT, nombre STRING, sucursal STRING, cadena_str STRING, estado_str STRING,"
        " municipio_str STRING"
    ),
    "cadena": "id BIGINT, nombre STRING",
    "actividad_geo": (
        "cliente_id BIGINT, usuario_id BIGINT, cuadrilla_id BIGINT, dia DATE, punto_venta_id BIGINT,"
        " hora_checkin TIMESTAMP_NTZ, lat_checkin DOUBLE, lon_checkin DOUBLE, lat_pdv DOUBLE,"
        " lon_pdv DOUBLE, es_fuera_ruta INT, sucursal STRING, cadena STRING, estado STRING,"
        " municipio STRING, ruta STRING, entidad STRING, region STRING, plaza STRING"
    ),
    # shelf execution
    "reporte_marca_pdv": (
        "pdv_id BIGINT, fecha DATE, marca STRING, cadena STRING, punto_venta STRING,"
        " municipio STRING, estado STRING, anio_mes STRING, total_visitas INT, cant_sku INT,"
        " cumple_planograma INT, visitas_con_agotados INT, cant_sku_agotados INT,"
        " visitas_con_preagotados INT, cant_sku_preagotados INT, pct_planograma DECIMAL(5,1),"
        " pct_visitas_agotados DECIMAL(5,1), pct_sku_agotados DECIMAL(5,1),"
        " pct_visitas_preagotados DECIMAL(5,1), pct_sku_preagotados DECIMAL(5,1)"
    ),
    "venta_cero": (
        "punto_venta_id BIGINT, producto STRING, punto_venta STRING, municipio STRING,"
        " estado STRING, cadena STRING, marca STRING, inventario DECIMAL(19,2), ejecutada BOOLEAN,"
        " fecha TIMESTAMP_NTZ, anio_mes STRING, promotor STRING, supervisor STRING, upc STRING"
    ),
    "precios": (
        "id BIGINT, promotor STRING, supervisor STRING, fecha TIMESTAMP_NTZ, anio_mes STRING,"
        " producto STRING, upc STRING, categoria STRING, presentacion STRING, cadena STRING,"
        " punto_venta STRING, estado STRING, precio DECIMAL(19,2), is_propio INT,"
        " producto_id BIGINT, punto_venta_id BIGINT, cadena_id BIGINT, status BOOLEAN"
    ),
    "agotados_con_producto": (
        "ejecucion_id BIGINT, marca STRING, punto_venta_id BIGINT, producto_en_riesgo STRING,"
        " punto_venta STRING, estado STRING, cadena STRING, fecha DATE, cant_agotados INT,"
        " cant_preagotados INT, inventario DECIMAL(19,2), marca_producto STRING"
    ),
    "agotados": (
        "anio_mes STRING, marca STRING, cadena STRING, punto_venta STRING, municipio STRING,"
        " estado STRING, total_agotados INT, total_preagotados INT, total_sku INT, visitas INT,"
        " pct_quiebre DOUBLE"
    ),
    "ejecucion": (
        "id BIGINT, fecha TIMESTAMP_NTZ, promotor STRING, punto_venta_id BIGINT, cadena_id BIGINT,"
        " nombre_marca STRING, cadena STRING, punto_venta STRING, municipio STRING, estado STRING,"
        " cant_sku INT, cant_agotados INT, cant_preagotados INT, con_agotados BOOLEAN,"
        " con_preagotados BOOLEAN, planograma BOOLEAN, negocicacion BOOLEAN,"
        " is_degustacion BOOLEAN, status BOOLEAN"
    ),
    "operacion_promotores": (
        "fecha TIMESTAMP_NTZ, inicio_jornada TIMESTAMP_NTZ, fin_jornada TIMESTAMP_NTZ,"
        " horas_laboradas DOUBLE, pct_cumplimiento_plan DOUBLE, pct_cumplimiento_visitas DOUBLE,"
        " puesto STRING, agencia STRING, supervisor STRING, entidad STRING, incidencia STRING"
    ),
    # sell-out
    "detalle_sell_out": (
        "cliente_id BIGINT, anio INT, mes INT, canal_id BIGINT, cadena_id BIGINT,"
        " punto_venta_id BIGINT, producto_id BIGINT, region STRING, venta DECIMAL(18,4),"
        " monto DECIMAL(18,2), piezas BIGINT, precio DECIMAL(18,2)"
    ),
    "sell_out_mes": (
        "cliente_id BIGINT, canal_id BIGINT, cadena_id BIGINT, producto_id BIGINT,"
        " monto DECIMAL(28,2), piezas BIGINT, pdvs BIGINT, anio INT, mes INT"
    ),
    "detalle_inventario": (
        "id BIGINT, punto_venta_id BIGINT, producto_id BIGINT, region STRING, anio INT, mes INT,"
        " existencia DECIMAL(18,2), venta DECIMAL(18,2), dias_inventario INT,"
        " is_sobre_inventario INT, is_sobre_inventario4sem INT"
    ),
    "producto": (
        "id BIGINT, nombre STRING, marca STRING, status INT, precio DECIMAL(18,2), canal_id BIGINT"
    ),
    "canal": "id BIGINT, nombre STRING, segmento STRING",
}
