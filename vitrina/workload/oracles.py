"""Independent SQL for every query, over the same benchmark tables."""

from __future__ import annotations

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelled(names: dict[str, str | None]) -> str:
    """A table of raw and clean spellings."""
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v) if v is not None else 'NULL'})" for k, v in names.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(raw, clean)"


def _even(value: str, digits: int) -> str:
    return f"round_even({value}, {digits})"


def _pct(num: str, den: str, digits: int = 1, empty: str | None = None) -> str:
    value = _even(f"CAST({num} AS DOUBLE) / NULLIF({den}, 0) * 100", digits)
    return f"COALESCE({value}, {empty})" if empty else value


def _hhmm(seconds: str) -> str:
    m = f"CAST(FLOOR(({seconds}) / 60) AS BIGINT)"
    return f"printf('%02d:%02d', {m} // 60, {m} % 60)"


def _minutes(text: str) -> str:
    return f"(CAST(split_part({text}, ':', 1) AS INT) * 60 + CAST(split_part({text}, ':', 2) AS INT))"


def _mean_hhmm(text: str) -> str:
    return _hhmm(f"60 * FLOOR(AVG({_minutes(text)}))")


def _cycle(key: str, values: list[str | None]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {_quoted(v) if v is not None else 'NULL'}" for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {whens} END"


_USUAL = "us_jornada BETWEEN 1 AND 57600000000"


def _share(condition: str) -> str:
    return f"ROUND(100.0 * COUNT(*) FILTER ({condition}) / NULLIF(COUNT(*) FILTER (realizadas > 0), 0), 0)"


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

CTES: dict[str, str] = {
    # field operations
    "visits": f"""
        SELECT CASE WHEN event_id % 211 <> 0 THEN user_id % 4 END AS cliente_id,
               CASE WHEN event_id % 97 <> 0 THEN user_id END AS usuario_id,
               (user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) % 26 AS cuadrilla_id,
               CASE WHEN event_id % 53 <> 0 THEN {_K} END AS punto_venta_id,
               CAST(ts AS DATE) + CASE WHEN event_id % 499 = 0 THEN 1096 ELSE 0 END AS dia,
               CASE WHEN event_type <> 'error' THEN ts END AS inicio,
               CASE WHEN event_type <> 'error' THEN ts + to_microseconds(1000000 * CAST(
                   CASE WHEN event_id % 41 = 0 THEN -600 WHEN event_id % 307 = 0 THEN 432000 ELSE floor(value * 60) END AS BIGINT)) END AS fin,
               event_type = 'signup' AS is_tarea,
               event_type = 'view' AS is_no_planeada,
               CASE WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE
                    WHEN event_type <> 'error' THEN {_K} / 100.0::DOUBLE + 19 + value / 100000.0::DOUBLE END AS lat_checkin,
               CASE WHEN event_type <> 'error' THEN -{_K} / 100.0::DOUBLE - 99 + value / 100000.0::DOUBLE END AS lon_checkin,
               CASE WHEN event_id % 83 <> 0 THEN {_K} / 100.0::DOUBLE + 19 END AS lat_pdv,
               CASE WHEN event_id % 79 = 0 THEN 'nan'::DOUBLE ELSE -{_K} / 100.0::DOUBLE - 99 END AS lon_pdv
        FROM events""",
    "users": """
        SELECT DISTINCT user_id AS id,
               CASE WHEN user_id % 15 = 7 THEN 'aud.' || user_id
                    WHEN user_id % 29 <> 5 THEN 'PRC' || LPAD(CAST(user_id AS VARCHAR), 3, '0') END AS username,
               'Rep ' || user_id AS user_real_name, 'rep' || user_id || '@example.com' AS email,
               user_id % 4 AS cliente_id
        FROM events""",
    "teams": """
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               CASE WHEN n_nationkey % 11 = 3 THEN '  ' ELSE n_name END AS entidad,
               'Ruta ' || (n_nationkey % 10) AS ruta, 'R' || n_regionkey AS region,
               CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'Plaza ' || (n_nationkey % 6) END AS plaza
        FROM nation
        UNION ALL
        SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 2 THEN 'ZZ ' || n_name END, 'Ruta X', 'RX', 'Plaza X'
        FROM nation""",
    "team_names": """
        SELECT id, MIN(entidad) AS entidad FROM teams
        WHERE entidad IS NOT NULL AND TRIM(entidad) <> '' GROUP BY id""",
    "stores": f"""
        SELECT id, 'Suc ' || id AS sucursal,
               {_cycle("id", [" walmart ", "SAMS", "7 eleven", "nan", "", None, "Super", "la comer"])} AS cadena_str,
               {_cycle("id", ["CDMX", "Nuevo LeÃ³n", "S/A", "09", "12345", "YUCATAN", "MÃ©xico", " Puebla ", None, "QuerÃ©taro"])} AS estado_str,
               {_cycle("id", ["BENITO JUAREZ", "CuauhtÃ©moc", "S/A", "nan", "Cancun", "LeÃ³n", None, "Ãlvaro ObregÃ³n"])} AS municipio_str
        FROM (SELECT DISTINCT {_K} AS id FROM events)""",
    "per_day": """
        SELECT cliente_id, usuario_id, dia, COUNT(*) AS n FROM visits
        WHERE usuario_id IS NOT NULL GROUP BY cliente_id, usuario_id, dia""",
    "excluded": """
        SELECT DISTINCT cliente_id, usuario_id FROM per_day WHERE n > 6
        UNION
        SELECT cliente_id, id FROM users WHERE contains(username, '.')""",
    "stays": """
        SELECT v.*, epoch_us(v.inicio) AS a, epoch_us(v.fin) AS b
        FROM visits v ANTI JOIN excluded x
          ON x.usuario_id = v.usuario_id AND x.cliente_id IS NOT DISTINCT FROM v.cliente_id
        WHERE v.usuario_id IS NOT NULL""",
    "clean": """
        SELECT s.*, u.username, u.user_real_name, t.entidad
        FROM stays s LEFT JOIN users u ON u.id = s.usuario_id LEFT JOIN team_names t ON t.id = s.cuadrilla_id""",
    "spans": """
        SELECT cliente_id, usuario_id, username, user_real_name, entidad, dia, COUNT(*) AS visitas, COUNT(a) AS hechas,
               COUNT(*) FILTER (is_tarea) AS tareas, COUNT(*) FILTER (is_tarea AND a IS NOT NULL) AS tareas_hechas,
               MIN(a % 86400000000) AS desde, MAX(b % 86400000000) AS hasta,
               NULLIF(GREATEST(MAX(b) - MIN(a), 0), 0) AS largo, COALESCE(SUM(b - a) FILTER (b > a), 0)::BIGINT AS dentro
        FROM clean GROUP BY ALL""",
    "days": """
        SELECT cliente_id, usuario_id, username, user_real_name, entidad, dia, visitas AS planeadas, hechas AS realizadas,
               tareas_hechas AS tareas_realizadas, tareas AS tareas_planeadas, desde AS us_inicio, hasta AS us_fin,
               largo AS us_jornada, LEAST(dentro, largo) AS us_en_pdv FROM spans""",
    "day_facts": """
        SELECT * EXCLUDE (us_inicio, us_fin, us_jornada, us_en_pdv), us_inicio / 1e6 AS seg_inicio, us_fin / 1e6 AS seg_fin,
               us_jornada / 3.6e9 AS horas_jornada, us_en_pdv / 3.6e9 AS horas_en_pdv
        FROM days""",
    "reps": f"""
        SELECT cliente_id, usuario_id, username, user_real_name, COALESCE(d.entidad, 'Sin entidad') AS entidad,
               COUNT(*) FILTER (realizadas > 0) AS dias_activos, COUNT(*) FILTER (realizadas = 0) AS ausencias,
               SUM(tareas_realizadas)::BIGINT AS tareas_realizadas, SUM(tareas_planeadas)::BIGINT AS tareas_planeadas,
               {_hhmm("AVG(us_inicio) FILTER (realizadas > 0) / 1e6")} AS hora_inicio,
               {_share("us_inicio <= 28800000000 AND realizadas > 0")} AS pct_inicio,
               {_hhmm("AVG(us_fin) FILTER (realizadas > 0) / 1e6")} AS hora_fin,
               {_share("us_jornada >= 28800000000")} AS pct_fin,
               {_hhmm(f"AVG(us_jornada) FILTER ({_USUAL}) / 1e6")} AS t_laborado,
               {_hhmm(f"AVG(us_jornada - us_en_pdv) FILTER ({_USUAL}) / 1e6")} AS t_traslado,
               ROUND(AVG((us_jornada - us_en_pdv)::DOUBLE / us_jornada * 100) FILTER ({_USUAL}), 0) AS pct_traslado,
               {_hhmm("AVG(us_en_pdv) FILTER (us_en_pdv > 0) / 1e6")} AS t_pdv,
               ROUND(AVG(us_en_pdv::DOUBLE / us_jornada * 100) FILTER ({_USUAL}), 0) AS pct_pdv,
               ROUND(AVG(realizadas) FILTER (realizadas > 0), 1) AS visitas_prom,
               SUM(planeadas)::BIGINT AS plan, SUM(realizadas)::BIGINT AS realizadas_total,
               ROUND(100.0 * SUM(realizadas) / SUM(planeadas), 0) AS pct_visitas
        FROM days d GROUP BY cliente_id, usuario_id, username, user_real_name, d.entidad""",
    "itin": f"""
        SELECT dia AS fecha, cliente_id, usuario_id, username, user_real_name AS promotor,
               COALESCE(c.entidad, 'Sin entidad') AS entidad,
               {_hhmm("MIN(a % 86400000000) / 1e6")} AS hora_entrada, {_hhmm("MAX(b % 86400000000) / 1e6")} AS hora_salida,
               COUNT(*) AS visitas_planeadas, COUNT(a) AS visitas_realizadas,
               COUNT(DISTINCT punto_venta_id) AS pdvs_visitados, COUNT(*) FILTER (is_no_planeada) AS fuera_de_ruta
        FROM clean c GROUP BY dia, cliente_id, usuario_id, username, user_real_name, c.entidad""",
    # The spellings that the adapters put in, and what each must become.
    "chain_names": _spelled(
        {" walmart ": "Walmart", "SAMS": "Sam's Club", "7 eleven": "7-Eleven", "nan": None, "": None, "Super": "Super", "la comer": "La Comer"}
    ),
    "state_names": _spelled(
        {
            "CDMX": "Ciudad de México",
            "Nuevo LeÃ³n": "Nuevo León",
            "S/A": None,
            "09": None,
            "12345": None,
            "YUCATAN": "Yucatán",
            "MÃ©xico": "Estado de México",
            " Puebla ": "Puebla",
            "QuerÃ©taro": "Querétaro",
        }
    ),
    "municipality_names": _spelled(
        {
            "BENITO JUAREZ": "Benito Juárez",
            "CuauhtÃ©moc": "Cuauhtémoc",
            "S/A": None,
            "nan": None,
            "Cancun": "Cancún",
            "LeÃ³n": "León",
            "Ãlvaro ObregÃ³n": "Álvaro Obregón",
        }
    ),
    "report_chains": _spelled({" walmart ": "Walmart", "SAMS CLUB": "Sam's Club", "NAN": "Sin cadena", "": "Sin cadena"}),
    "team_rows": """
        SELECT id, ruta, entidad, region, plaza FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY id
                ORDER BY entidad IS NULL, entidad, COALESCE(ruta, ''), COALESCE(region, ''), COALESCE(plaza, '')) AS rn
            FROM (SELECT id, NULLIF(TRIM(entidad), '') AS entidad, NULLIF(TRIM(ruta), '') AS ruta,
                         NULLIF(TRIM(region), '') AS region, NULLIF(TRIM(plaza), '') AS plaza FROM teams))
        WHERE rn = 1""",
    "geo": f"""
        SELECT v.cliente_id, v.usuario_id, v.cuadrilla_id, v.dia, v.punto_venta_id,
               v.inicio AS hora_checkin, v.lat_checkin, v.lon_checkin, v.lat_pdv,
               CASE WHEN NOT isnan(v.lon_pdv) THEN v.lon_pdv END AS lon_pdv,
               CAST(v.is_no_planeada AS INT) AS es_fuera_ruta, s.sucursal,
               c.clean AS cadena, e.clean AS estado, m.clean AS municipio,
               t.ruta, t.entidad, t.region, t.plaza
        FROM visits v
        LEFT JOIN stores s ON s.id = v.punto_venta_id
        LEFT JOIN chain_names c ON c.raw = s.cadena_str
        LEFT JOIN state_names e ON e.raw = s.estado_str
        LEFT JOIN municipality_names m ON m.raw = s.municipio_str
        LEFT JOIN team_rows t ON t.id = v.cuadrilla_id
        WHERE v.cliente_id IN (0, 1, 2, 3) AND v.inicio IS NOT NULL AND v.dia IS NOT NULL
          AND v.lat_checkin IS NOT NULL AND NOT isnan(v.lat_checkin)
          AND v.lon_checkin IS NOT NULL AND NOT isnan(v.lon_checkin)
          AND v.lat_pdv IS NOT NULL AND v.lon_pdv IS NOT NULL""",
    "dist": """
        SELECT g.cliente_id, g.usuario_id, u.user_real_name AS promotor, g.dia AS fecha,
               g.punto_venta_id, g.sucursal AS punto_venta, g.cadena, g.estado, g.municipio, g.ruta,
               g.lat_pdv, g.lon_pdv, g.lat_checkin AS lat_promotor, g.lon_checkin AS lon_promotor,
               g.es_fuera_ruta, g.hora_checkin,
               ROUND(111320 * SQRT(POWER(g.lat_checkin - g.lat_pdv, 2)
                   + POWER((g.lon_checkin - g.lon_pdv) * COS(RADIANS(g.lat_pdv)), 2)), 0) AS distancia_metros
        FROM geo g LEFT JOIN users u ON u.id = g.usuario_id""",
    "classed": """
        SELECT *, CASE WHEN distancia_metros IS NULL THEN 'Sin dato' WHEN distancia_metros <= 300 THEN 'En rango'
                       WHEN distancia_metros <= 1000 THEN 'Alerta' ELSE 'Crítico' END AS estado_geo
        FROM dist""",
    # shelf execution
    "lines": """
        SELECT *, CASE WHEN l_suppkey <> 13 THEN l_suppkey END AS x_pdv,
               CASE WHEN p_brand <> 'Brand#25' THEN p_brand END AS x_brand,
               CASE WHEN n_nationkey <> 24 THEN n_name END AS x_chain,
               CAST(CASE WHEN l_returnflag = 'R' THEN floor(l_quantity / 4) ELSE 0 END AS INT) AS x_out,
               CAST(l_quantity <= 5 AS INT) AS x_near,
               CASE WHEN l_orderkey % 50 <> 49 THEN 'P' || (l_orderkey % 50) END AS x_rep,
               l_orderkey * 10 + l_linenumber AS x_id,
               CASE WHEN l_tax <> 0 THEN l_linestatus = 'O' END AS x_done
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "report": """
        SELECT x_pdv AS pdv_id, CAST(l_shipdate AS DATE) AS fecha, x_brand AS marca, x_chain AS cadena,
               s_name AS punto_venta, 'M' || (s_nationkey % 7) AS municipio, r_name AS estado,
               1 AS total_visitas, CAST(l_quantity AS INT) AS cant_sku,
               CAST(l_linestatus = 'O' AS INT) AS cumple_planograma,
               CAST(l_returnflag = 'R' AS INT) AS visitas_con_agotados, x_out AS cant_sku_agotados,
               x_near AS visitas_con_preagotados, x_near AS cant_sku_preagotados
        FROM lines""",
    "store_brand": f"""
        SELECT COALESCE(cadena, '') AS cadena, pdv_id, COALESCE(marca, '') AS marca,
               COALESCE(MAX(punto_venta), '') AS punto_venta, COALESCE(MAX(municipio), '') AS municipio,
               COALESCE(MAX(estado), '') AS estado,
               CAST(SUM(total_visitas) AS BIGINT) AS total_visitas, CAST(SUM(cant_sku) AS BIGINT) AS cant_sku,
               CAST(SUM(cumple_planograma) AS BIGINT) AS cumple_planograma,
               CAST(SUM(visitas_con_agotados) AS BIGINT) AS visitas_con_agotados,
               CAST(SUM(cant_sku_agotados) AS BIGINT) AS cant_sku_agotados,
               CAST(SUM(visitas_con_preagotados) AS BIGINT) AS visitas_con_preagotados,
               CAST(SUM(cant_sku_preagotados) AS BIGINT) AS cant_sku_preagotados,
               {_pct("SUM(cumple_planograma)", "SUM(total_visitas)", 1, "0")} AS pct_planograma,
               {_pct("SUM(visitas_con_agotados)", "SUM(total_visitas)", 1, "0")} AS pct_visitas_agotados,
               {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)", 1, "0")} AS pct_sku_agotados,
               {_pct("SUM(visitas_con_preagotados)", "SUM(total_visitas)", 1, "0")} AS pct_visitas_preagotados,
               {_pct("SUM(cant_sku_preagotados)", "SUM(cant_sku)", 1, "0")} AS pct_sku_preagotados
        FROM report GROUP BY report.cadena, pdv_id, report.marca""",
    "risky": """
        SELECT x_pdv AS punto_venta_id, x_brand AS marca, p_name AS producto,
               MAX(CASE WHEN l_tax <> 0 AND x_out > 0 THEN 1 ELSE 0 END) AS fuera,
               MAX(CASE WHEN x_near > 0 THEN 1 ELSE 0 END) AS cerca
        FROM lines WHERE x_pdv IS NOT NULL AND x_brand IS NOT NULL GROUP BY 1, 2, 3""",
    "risk_lists": """
        SELECT punto_venta_id, marca,
               array_to_string(list_slice(list(producto ORDER BY producto) FILTER (fuera = 1), 1, 4), ', ') AS agotados,
               GREATEST(CAST(SUM(fuera) AS INT) - 4, 0)::BIGINT AS agotados_mas,
               array_to_string(list_slice(list(producto ORDER BY producto) FILTER (cerca = 1), 1, 4), ', ') AS preagotados,
               GREATEST(CAST(SUM(cerca) AS INT) - 4, 0)::BIGINT AS preagotados_mas
        FROM risky WHERE fuera = 1 OR cerca = 1 GROUP BY punto_venta_id, marca""",
    "exec": """
        SELECT x_id AS id, x_rep AS promotor, x_pdv AS punto_venta_id, x_chain AS cadena,
               s_nationkey + 2 AS cadena_id, CAST(l_quantity AS INT) AS cant_sku, x_out AS cant_agotados,
               x_near AS cant_preagotados, CAST(x_done AS INT) AS planograma
        FROM lines""",
    "managed": """
        SELECT COALESCE(n.n_name, 'ID: ' || e.cadena_id) AS nombre_cadena,
               COALESCE(s.s_name, 'ID: ' || COALESCE(CAST(e.punto_venta_id AS VARCHAR), 'None')) AS nombre_pdv, e.*
        FROM exec e LEFT JOIN nation n ON n.n_nationkey = e.cadena_id
        LEFT JOIN supplier s ON s.s_suppkey = e.punto_venta_id""",
    "alerts": """
        SELECT x_pdv AS punto_venta_id, p_name AS producto, s_name AS punto_venta, r_name AS estado,
               x_chain AS cadena, x_brand AS marca, l_quantity AS inventario, x_done AS ejecutada,
               l_shipdate AS fecha, x_rep AS promotor
        FROM lines""",
    "prices": """
        SELECT p_name AS producto, CASE WHEN p_type <> 'PROMO' THEN p_type END AS categoria, x_chain AS cadena,
               CAST(l_extendedprice AS DECIMAL(19, 2)) AS precio,
               CASE WHEN l_discount <> 0.1::DOUBLE THEN CAST(CAST(substr(p_brand, 7) AS INT) <= 12 AS INT) END AS is_propio,
               l_shipdate AS fecha, x_rep AS promotor, l_linestatus = 'O' AS status
        FROM lines""",
    "kinds": "SELECT *, CASE WHEN is_propio = 1 THEN 'Propio' ELSE 'Competencia' END AS tipo FROM prices",
    # sell-out
    "sales": """
        SELECT CAST(ascii(l_returnflag) AS BIGINT) AS cliente_id, CAST(year(l_shipdate) AS INT) AS anio,
               CAST(month(l_shipdate) AS INT) AS mes, CAST(ascii(c_mktsegment) AS BIGINT) AS canal_id,
               CAST(c_nationkey + 2 AS BIGINT) AS cadena_id, o_custkey AS punto_venta_id,
               l_partkey + 5 AS producto_id, CASE WHEN c_nationkey <> 24 THEN r_name END AS region,
               CAST(l_extendedprice AS DECIMAL(18, 2)) AS monto, CAST(l_quantity AS BIGINT) AS piezas,
               CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(1 - l_discount AS DECIMAL(4, 2)) AS DECIMAL(18, 4)) AS venta,
               CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(16, 0)) * 0.01 AS precio
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "rollup_month": """
        SELECT cliente_id, anio, mes, canal_id, cadena_id, producto_id, SUM(monto) AS monto,
               CAST(SUM(piezas) AS BIGINT) AS piezas, COUNT(DISTINCT punto_venta_id) AS pdvs
        FROM sales GROUP BY ALL""",
    "channels": """
        SELECT DISTINCT CAST(ascii(c_mktsegment) AS BIGINT) AS id,
               CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS nombre,
               CASE WHEN c_mktsegment < 'C' THEN 'Moderno' WHEN c_mktsegment <> 'MACHINERY' THEN 'Tradicional' END AS segmento
        FROM customer""",
    "chains": """
        SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN ' walmart ' WHEN 1 THEN 'SAMS CLUB'
               WHEN 2 THEN 'NAN' WHEN 3 THEN n_name ELSE '' END AS nombre FROM nation""",
    "named_chains": """
        SELECT c.id, COALESCE(n.clean, c.nombre) AS cadena FROM chains c LEFT JOIN report_chains n ON n.raw = c.nombre""",
    "products": """
        SELECT p_partkey AS id, CASE WHEN p_size <> 13 THEN p_name END AS nombre,
               CASE WHEN p_brand <> 'Brand#25' THEN p_brand END AS marca, p_size % 2 AS status,
               CAST(p_retailprice AS DECIMAL(18, 2)) AS precio,
               CASE WHEN p_type <> 'PROMO' THEN ascii(p_type) END AS canal_id
        FROM part""",
    "stock": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS punto_venta_id, l_partkey AS producto_id,
               CASE WHEN n_nationkey <> 24 THEN r_name END AS region, CAST(year(l_shipdate) AS INT) AS anio,
               CAST(month(l_shipdate) AS INT) AS mes, CAST(l_quantity AS DECIMAL(18, 2)) AS existencia,
               CASE WHEN l_partkey % 37 = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END AS venta,
               CASE WHEN l_tax <> 0 THEN abs(date_diff('day', o_orderdate, l_shipdate)) % 90 END AS dias,
               CAST(abs(date_diff('day', o_orderdate, l_shipdate)) % 90 > 60 AS INT) AS sobre
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # exported views
    "dirty": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS clave,
               CASE WHEN l_linenumber <> 3 THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS fecha,
               CAST(l_shipdate AS DATE) + INTERVAL 495 MINUTE AS inicio_jornada,
               CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS DATE) END AS anio_mes,
               CAST(l_quantity AS INT) AS q,
               {_cycle("l_partkey", ["0x00", "0x01", "1", "0", "true", "x", "False"])} AS bit0,
               {_cycle("(l_partkey + 1)", ["0x00", "0x01", "1", "0", "true", "x", "False"])} AS bit1,
               {_cycle("(l_partkey + 2)", ["0x00", "0x01", "1", "0", "true", "x", "False"])} AS bit2,
               {_cycle("(l_partkey + 3)", ["0x00", "0x01", "1", "0", "true", "x", "False"])} AS bit3,
               TRY_CAST({_cycle("l_partkey", ["0", "5", "15", "100", "101", None, "-1", "0.5", "50"])} AS DOUBLE) AS pct_quiebre,
               TRY_CAST({_cycle("l_partkey", ["49", "79", "100", "0", "101", None, "49.5", "80", "x"])} AS DOUBLE) AS pct_planograma,
               CASE WHEN l_linenumber <> 2 THEN l_returnflag ELSE 'Sin dato' END AS marca,
               CASE WHEN l_linenumber <> 4 THEN l_linestatus ELSE 'Sin dato' END AS cadena,
               CASE WHEN l_linenumber <> 6 THEN l_linestatus ELSE 'Sin dato' END AS otro
        FROM lineitem""",
}

# Which CTEs each one reads.
_NEEDS = {
    "team_names": ["teams"],
    "per_day": ["visits"],
    "excluded": ["per_day", "users"],
    "stays": ["visits", "excluded"],
    "clean": ["stays", "users", "team_names"],
    "spans": ["clean"],
    "days": ["spans"],
    "day_facts": ["days"],
    "reps": ["days"],
    "itin": ["clean"],
    "team_rows": ["teams"],
    "geo": ["visits", "stores", "team_rows", "chain_names", "state_names", "municipality_names"],
    "dist": ["geo", "users"],
    "classed": ["dist"],
    "report": ["lines"],
    "store_brand": ["report"],
    "risky": ["lines"],
    "risk_lists": ["risky"],
    "exec": ["lines"],
    "managed": ["exec"],
    "alerts": ["lines"],
    "prices": ["lines"],
    "kinds": ["prices"],
    "rollup_month": ["sales"],
    "named_chains": ["chains", "report_chains"],
}


def _sql(needs: str, body: str) -> str:
    """``body`` behind the CTEs it needs, each after the ones it reads."""
    order: list[str] = []

    def add(name: str) -> None:
        for inner in _NEEDS.get(name, []):
            add(inner)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    prefix = ", ".join(f"{name} AS ({CTES[name]})" for name in order)
    return f"WITH {prefix} {body}" if prefix else body


_VISIT_COLUMNS = (
    "cliente_id, usuario_id, promotor, fecha, punto_venta_id, punto_venta, cadena, estado, municipio, ruta,"
    " lat_pdv, lon_pdv, lat_promotor, lon_promotor, es_fuera_ruta"
)
_DETAIL = (
    "fecha, promotor, ruta, estado, municipio, punto_venta, cadena,"
    " strftime(hora_checkin, '%H:%M') AS hora_checkin, distancia_metros, estado_geo, es_fuera_ruta"
)
_MEANS = (
    f"{_mean_hhmm('hora_inicio')} AS hora_inicio, {_mean_hhmm('hora_fin')} AS hora_fin,"
    f" {_mean_hhmm('t_laborado')} AS t_laborado, {_mean_hhmm('t_traslado')} AS t_traslado,"
    f" {_mean_hhmm('t_pdv')} AS t_pdv"
)
_TENTHS = _even("CAST(SUM(CAST(visitas_prom AS DECIMAL(10, 1))) AS DOUBLE) / COUNT(visitas_prom)", 1)


def _big(expression: str) -> str:
    return f"CAST(COALESCE(SUM({expression}), 0) AS BIGINT)"


def _dbl(expression: str) -> str:
    return f"COALESCE(CAST(SUM({expression}) AS DOUBLE), 0)"


def _mean(expression: str, digits: int) -> str:
    return _even(f"CAST(SUM({expression}) AS DOUBLE) / COUNT({expression})", digits)


def _bit(c: str) -> str:
    return f"CASE WHEN {c} IN ('1', '0x01', 'True', 'true') THEN true WHEN {c} IN ('0', '0x00', 'False', 'false') THEN false END"


def _num(c: str) -> str:
    return f"CASE WHEN ({c}) % 11 <> 0 THEN CAST({c} AS DOUBLE) END"


_SUMS = f"{_dbl('venta')} AS venta, {_dbl('monto')} AS monto, {_big('piezas')} AS piezas"
_YM = "CAST(year(fecha) AS INT) AS anio, CAST(month(fecha) AS INT) AS mes"
_WEEK = "CAST(weekofyear(fecha) AS INT) AS semana"
_RANKED = f"ROUND({_dbl('r.monto')}, 0) AS monto_total, ROUND({_dbl('r.piezas')}, 0) AS piezas_total"



def _searched(columns: str | None, condition: str) -> str:
    picked = f"{columns}, " if columns else ""
    return _sql(
        "lines",
        f"""SELECT * FROM (SELECT x_id AS id, {picked}x_rep AS user_real_name, 'Sup ' || (l_suppkey % 7) AS supervisor FROM lines)
        WHERE {condition} ORDER BY id DESC LIMIT 50""",
    )


ORACLES: dict[str, str] = {
    "scan_by_name": "SELECT o_orderkey, o_custkey, o_orderdate, strftime(o_orderdate, '%d/%m/%Y') AS fecha_texto FROM orders",
    "roundtrip_parquet": "SELECT * FROM orders",
    "dump_route_tables": """SELECT 'part' AS tabla, COUNT(DISTINCT p_partkey // 50) AS sentencias FROM part
        UNION ALL SELECT 'nation', COUNT(DISTINCT n_nationkey // 10) FROM nation""",
    "dump_load_rows": """SELECT p_partkey AS id, p_name || ' (O''Hara, 50%) \\' AS nombre,
        CASE WHEN p_brand <> 'Brand#25' THEN p_brand END AS marca, p_size % 2 = 1 AS activo,
        p_retailprice AS precio FROM part WHERE p_size <> 50""",
    "dump_rejected_rows": """SELECT COUNT(*) AS leidas, COUNT(CASE WHEN p_size = 50 THEN 1 END) AS descartadas FROM part""",
    "profile_nulls": _sql(
        "alerts",
        " UNION ALL ".join(
            f"SELECT COUNT(*) AS filas, '{c}' AS columna, COUNT(*) - COUNT({c}) AS nulos FROM alerts"
            for c in (
                "punto_venta_id producto punto_venta estado cadena marca inventario ejecutada fecha promotor".split()
            )
        ),
    ),
    "profile_period": _sql(
        "alerts",
        "SELECT COUNT(*) AS filas, CAST(MIN(fecha) AS DATE) AS dia_min, CAST(MAX(fecha) AS DATE) AS dia_max,"
        " CAST(10 AS BIGINT) AS columnas FROM alerts",
    ),
    "profile_top_chain": _sql(
        "geo",
        "SELECT cadena, COUNT(*) AS visitas FROM geo WHERE cadena IS NOT NULL GROUP BY cadena"
        " ORDER BY visitas DESC, cadena LIMIT 15",
    ),
    "profile_state_visits": _sql(
        "geo", "SELECT estado, COUNT(*) AS visitas FROM geo WHERE estado IS NOT NULL GROUP BY estado"
    ),
    "profile_broken_encoding": _sql(
        "stores",
        "SELECT COUNT(*) AS rotos FROM (SELECT DISTINCT municipio_str FROM stores) WHERE municipio_str LIKE '%Ã%'",
    ),
    "repaired_text": "SELECT doc_id, lang, text AS texto FROM documents",
    # field operations
    "excluded_users": _sql("excluded", "SELECT * FROM excluded"),
    "clean_visits": _sql(
        "clean",
        "SELECT cliente_id, usuario_id, username, user_real_name, entidad, dia, inicio, fin, is_tarea,"
        " (b - a) / 6e7 AS min_en_pdv FROM clean",
    ),
    "rep_day_facts": _sql("day_facts", "SELECT * FROM day_facts"),
    "rep_kpis": _sql("reps", "SELECT * FROM reps"),
    "absences_period": """SELECT user_id % 4 AS cliente_id, COUNT(*) AS ausencias FROM events
        WHERE event_type = 'error' AND CAST(ts AS DATE) BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY 1""",
    "ops_summary": _sql(
        "reps",
        f"""SELECT cliente_id, COUNT(DISTINCT usuario_id) AS promotores, CAST(SUM(plan) AS BIGINT) AS plan,
        CAST(SUM(realizadas_total) AS BIGINT) AS realizadas,
        {_pct("SUM(realizadas_total)", "SUM(plan)", 0, "0")} AS pct_visitas, {_MEANS},
        COALESCE({_even("AVG(pct_inicio)", 0)}, 0) AS pct_inicio, COALESCE({_even("AVG(pct_fin)", 0)}, 0) AS pct_fin,
        CAST(COALESCE(FLOOR(AVG(pct_traslado)), 0) AS BIGINT) AS pct_traslado,
        CAST(COALESCE(FLOOR(AVG(pct_pdv)), 0) AS BIGINT) AS pct_pdv, {_TENTHS} AS visitas_prom
        FROM reps GROUP BY cliente_id""",
    ),
    "team_kpis": _sql(
        "reps",
        f"""SELECT *, CASE WHEN COALESCE(pct_inicio, 0) >= 70 THEN 'green' WHEN COALESCE(pct_inicio, 0) >= 40 THEN 'yellow' ELSE 'red' END AS nivel_inicio,
        CASE WHEN COALESCE(pct_fin, 0) >= 50 THEN 'green' WHEN COALESCE(pct_fin, 0) >= 25 THEN 'yellow' ELSE 'red' END AS nivel_fin
        FROM (SELECT cliente_id, entidad, COUNT(DISTINCT usuario_id) AS promotores, CAST(SUM(plan) AS BIGINT) AS plan,
        CAST(SUM(realizadas_total) AS BIGINT) AS realizadas,
        CAST(SUM(tareas_realizadas) AS BIGINT) AS tareas_realizadas,
        CAST(SUM(tareas_planeadas) AS BIGINT) AS tareas_planeadas, CAST(SUM(ausencias) AS BIGINT) AS ausencias,
        {_pct("SUM(realizadas_total)", "SUM(plan)", 0)} AS pct_visitas, {_MEANS},
        {_even("AVG(pct_inicio)", 0)} AS pct_inicio, {_even("AVG(pct_fin)", 0)} AS pct_fin,
        {_even("AVG(pct_traslado)", 0)} AS pct_traslado, {_even("AVG(pct_pdv)", 0)} AS pct_pdv,
        {_TENTHS} AS visitas_prom FROM reps GROUP BY cliente_id, entidad)""",
    ),
    "rep_status": _sql(
        "reps",
        f"""SELECT r.cliente_id, r.usuario_id, r.username, r.entidad,
        CASE WHEN regexp_matches(r.username, '^PRC0[0-9][0-9]$') THEN 'S' ELSE '—' END AS puesto,
        r.pct_visitas, t.promotores, t.pct_equipo,
        CASE WHEN t.pct_equipo >= 80 THEN 'green' WHEN t.pct_equipo >= 60 THEN 'yellow' ELSE 'red' END AS nivel_equipo
        FROM reps r JOIN (SELECT cliente_id, entidad, COUNT(*) AS promotores,
            {_pct("SUM(realizadas_total)", "SUM(plan)", 0, "0")} AS pct_equipo FROM reps GROUP BY 1, 2) t
        ON t.cliente_id IS NOT DISTINCT FROM r.cliente_id AND t.entidad = r.entidad""",
    ),
    "daily_trend": _sql(
        "clean",
        """SELECT cliente_id, dia, COUNT(DISTINCT usuario_id) AS promotores, COUNT(*) AS planeadas,
        COUNT(inicio) AS realizadas, ROUND(COUNT(inicio) * 100.0 / NULLIF(COUNT(*), 0), 1) AS pct_cumplimiento
        FROM clean GROUP BY cliente_id, dia""",
    ),
    "itinerary": _sql("itin", "SELECT * FROM itin"),
    "itinerary_totals": _sql(
        "itin",
        f"SELECT COUNT(*) AS dias, {_big('visitas_planeadas')} AS visitas_planeadas,"
        f" {_big('visitas_realizadas')} AS visitas_realizadas, {_big('fuera_de_ruta')} AS fuera_de_ruta FROM itin",
    ),
    "last_activity_day": _sql(
        "visits",
        "SELECT cliente_id, MAX(dia) AS ultima, CAST(date_trunc('month', MAX(dia)) AS DATE) AS desde FROM visits"
        " GROUP BY cliente_id",
    ),
    # geofence
    "geo_enriched_visits": _sql("geo", "SELECT * FROM geo"),
    "geo_refreshed": _sql("geo", "SELECT * FROM geo"),
    "rep_day_facts_refreshed": _sql("day_facts", "SELECT * FROM day_facts"),
    "geo_visits": _sql("classed", f"SELECT {_VISIT_COLUMNS}, distancia_metros, estado_geo FROM classed"),
    "geo_period": _sql(
        "geo", "SELECT cliente_id, MIN(dia) AS dia_min, MAX(dia) AS dia_max FROM geo GROUP BY cliente_id"
    ),
    "geo_options_state": _sql("geo", "SELECT DISTINCT estado FROM geo WHERE estado IS NOT NULL"),
    "geo_options_municipality": _sql(
        "geo", "SELECT DISTINCT municipio FROM geo WHERE municipio IS NOT NULL AND estado = 'Ciudad de México'"
    ),
    "geo_options_chain": _sql(
        "geo", "SELECT DISTINCT cadena FROM geo WHERE cadena IS NOT NULL AND estado = 'Nuevo León'"
    ),
    "geo_options_route": _sql(
        "geo",
        "SELECT DISTINCT ruta FROM geo WHERE ruta IS NOT NULL AND dia BETWEEN '2024-01-01' AND '2024-01-30'",
    ),
    "geo_kpis": _sql(
        "classed",
        f"""SELECT *, {_pct("en_rango", "total", 1, "0")} AS pct_en_rango FROM (
        SELECT cliente_id, COUNT(*) AS total, COUNT(*) FILTER (estado_geo = 'En rango') AS en_rango,
        COUNT(*) FILTER (estado_geo = 'Alerta') AS alerta, COUNT(*) FILTER (estado_geo = 'Crítico') AS critico
        FROM classed GROUP BY cliente_id)""",
    ),
    "geo_center": _sql(
        "classed",
        "SELECT cliente_id, quantile_cont(lat_pdv, 0.5) AS lat, quantile_cont(lon_pdv, 0.5) AS lon FROM classed"
        " WHERE lat_pdv IS NOT NULL AND lon_pdv IS NOT NULL GROUP BY cliente_id",
    ),
    "geo_by_rep": _sql(
        "classed",
        f"""SELECT *, {_pct("criticas + alertas", "visitas")} AS pct_anomalas FROM (
        SELECT cliente_id, promotor, COUNT(usuario_id) AS visitas, COUNT(*) FILTER (estado_geo = 'Crítico') AS criticas,
        COUNT(*) FILTER (estado_geo = 'Alerta') AS alertas, AVG(distancia_metros) AS dist_promedio
        FROM classed WHERE promotor IS NOT NULL GROUP BY cliente_id, promotor)""",
    ),
    "geo_by_route": _sql(
        "classed",
        """SELECT cliente_id, ruta, COUNT(usuario_id) AS visitas, COUNT(*) FILTER (estado_geo = 'Crítico') AS criticas,
        COUNT(*) FILTER (estado_geo = 'Alerta') AS alertas FROM classed WHERE ruta IS NOT NULL GROUP BY cliente_id, ruta""",
    ),
    "geo_critical": _sql(
        "classed",
        "SELECT fecha, promotor, ruta, punto_venta, cadena, estado, municipio, distancia_metros, estado_geo"
        " FROM classed WHERE estado_geo IN ('Crítico', 'Alerta')",
    ),
    "geo_detail": _sql("classed", f"SELECT {_DETAIL} FROM classed"),
    "geo_detail_anomalies": _sql(
        "classed", f"SELECT {_DETAIL} FROM classed WHERE estado_geo IN ('Crítico', 'Alerta')"
    ),
    # shelf execution
    "shelf_kpis": _sql(
        "report",
        f"""SELECT COUNT(DISTINCT punto_venta) AS pdvs_unicos, {_big("total_visitas")} AS total_visitas,
        {_big("cant_sku")} AS total_sku, {_big("cant_sku_agotados")} AS total_agotados,
        {_big("cant_sku_preagotados")} AS total_preagotados,
        {_pct("SUM(cumple_planograma)", "SUM(total_visitas)", 1, "0")} AS pct_planograma,
        {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)", 1, "0")} AS pct_agotados,
        {_pct("SUM(cant_sku_preagotados)", "SUM(cant_sku)", 1, "0")} AS pct_preagotados FROM report""",
    ),
    "visits_by_brand": _sql(
        "report",
        f"SELECT marca, {_big('total_visitas')} AS total_visitas FROM report WHERE marca IS NOT NULL GROUP BY marca",
    ),
    "planogram_by_brand": _sql(
        "report",
        f"""SELECT *, CASE WHEN pct_planograma >= 80 THEN 'green' WHEN pct_planograma >= 50 THEN 'yellow' ELSE 'red' END AS nivel
        FROM (SELECT marca, {_big("cumple_planograma")} AS planograma, {_big("total_visitas")} AS visitas,
        {_pct("SUM(cumple_planograma)", "SUM(total_visitas)")} AS pct_planograma
        FROM report WHERE marca IS NOT NULL GROUP BY marca)""",
    ),
    "top_stores_visits": _sql(
        "report",
        f"""SELECT cadena, punto_venta, estado, {_big("total_visitas")} AS total_visitas FROM report
        WHERE cadena IS NOT NULL AND punto_venta IS NOT NULL AND estado IS NOT NULL GROUP BY cadena, punto_venta, estado
        ORDER BY total_visitas DESC, cadena, punto_venta, estado LIMIT 10""",
    ),
    "stockouts_by_brand": _sql(
        "report",
        f"""SELECT *, CASE WHEN pct_agotados > 10 THEN 'red' WHEN pct_agotados > 5 THEN 'yellow' ELSE 'green' END AS nivel
        FROM (SELECT marca, {_big("cant_sku_agotados")} AS sku_agotados, {_big("cant_sku_preagotados")} AS sku_preagotados,
        {_big("cant_sku")} AS sku, {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)")} AS pct_agotados,
        {_pct("SUM(cant_sku_preagotados)", "SUM(cant_sku)")} AS pct_preagotados
        FROM report WHERE marca IS NOT NULL GROUP BY marca)""",
    ),
    "stockouts_by_brand_long": _sql(
        "report",
        f"""SELECT marca, 'Agotados' AS tipo, {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)")} AS pct
        FROM report WHERE marca IS NOT NULL GROUP BY marca UNION ALL
        SELECT marca, 'Preagotados', {_pct("SUM(cant_sku_preagotados)", "SUM(cant_sku)")}
        FROM report WHERE marca IS NOT NULL GROUP BY marca""",
    ),
    "top_stores_stockouts": _sql(
        "report",
        f"""SELECT punto_venta, {_big("cant_sku_agotados")} AS cant_sku_agotados FROM report
        WHERE punto_venta IS NOT NULL GROUP BY punto_venta ORDER BY cant_sku_agotados DESC, punto_venta LIMIT 10""",
    ),
    "brand_options": _sql("report", "SELECT DISTINCT marca FROM report WHERE marca IS NOT NULL"),
    "chain_options": _sql("report", "SELECT DISTINCT cadena FROM report WHERE cadena IS NOT NULL"),
    "store_brand_report": _sql("store_brand", "SELECT * FROM store_brand"),
    "store_brand_totals": _sql(
        "store_brand",
        f"""SELECT {_big("total_visitas")} AS total_visitas, {_big("cant_sku")} AS total_sku,
        {_big("cant_sku_agotados")} AS total_agotados, {_big("cant_sku_preagotados")} AS total_preagotados,
        COUNT(DISTINCT pdv_id) + MAX(CAST(pdv_id IS NULL AS INT)) AS pdvs_unicos,
        {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)", 1, "0")} AS pct_agotados_gral,
        {_pct("SUM(cant_sku_preagotados)", "SUM(cant_sku)", 1, "0")} AS pct_pre_gral FROM store_brand""",
    ),
    "risk_products": _sql("risk_lists", "SELECT * FROM risk_lists"),
    "store_brand_report_risk": _sql(
        "store_brand risk_lists",
        """SELECT s.cadena, s.pdv_id, s.marca, r.agotados, r.agotados_mas, r.preagotados, r.preagotados_mas
        FROM store_brand s LEFT JOIN risk_lists r ON r.punto_venta_id = s.pdv_id AND r.marca = s.marca""",
    ),
    "execution_by_rep": _sql(
        "exec",
        f"""SELECT promotor, COUNT(punto_venta_id) AS visitas, {_big("cant_agotados")} AS agotados,
        {_big("cant_preagotados")} AS preagotados, {_big("cant_sku")} AS sku, {_big("planograma")} AS con_planograma
        FROM exec WHERE promotor IS NOT NULL GROUP BY promotor""",
    ),
    "execution_by_chain": _sql(
        "exec",
        f"""SELECT cadena, COUNT(punto_venta_id) AS visitas, COUNT(DISTINCT punto_venta_id) AS pdvs,
        {_big("cant_agotados")} AS agotados, {_big("cant_sku")} AS sku
        FROM exec WHERE cadena IS NOT NULL GROUP BY cadena""",
    ),
    "stockout_rate_by_brand": _sql(
        "report",
        f"""SELECT marca, {_big("cant_sku_agotados")} AS total_agotados, {_big("cant_sku")} AS total_sku,
        {_big("total_visitas")} AS visitas, {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)")} AS pct_quiebre
        FROM report WHERE marca IS NOT NULL GROUP BY marca""",
    ),
    "top_stores_stockout_rate": _sql(
        "report",
        f"""SELECT punto_venta, cadena, estado, {_big("cant_sku_agotados")} AS total_agotados, {_big("cant_sku")} AS total_sku,
        {_pct("SUM(cant_sku_agotados)", "SUM(cant_sku)")} AS pct_quiebre FROM report
        WHERE punto_venta IS NOT NULL AND cadena IS NOT NULL AND estado IS NOT NULL GROUP BY punto_venta, cadena, estado
        ORDER BY pct_quiebre DESC, punto_venta, cadena, estado LIMIT 10""",
    ),
    "managerial_totals": _sql(
        "exec",
        f"""SELECT COUNT(*) AS visitas, {_pct("SUM(COALESCE(planograma, 0))", "COUNT(*)", 2, "0")} AS cumplimiento,
        {_pct("SUM(cant_agotados)", "SUM(cant_sku)", 2, "0")} AS agotados FROM exec""",
    ),
    # zero sales and prices
    "zero_sales_kpis": _sql(
        "alerts",
        f"""SELECT COUNT(*) AS total_registros, COUNT(*) FILTER (ejecutada) AS ejecutadas,
        COUNT(*) FILTER (NOT ejecutada) AS pendientes, COUNT(DISTINCT marca) AS marcas_afectadas,
        COUNT(DISTINCT punto_venta) AS pdvs_afectados,
        {_pct("COUNT(*) FILTER (ejecutada)", "COUNT(*)", 1, "0")} AS pct_ejecutado FROM alerts""",
    ),
    "zero_sales_by_brand": _sql(
        "alerts", "SELECT marca, COUNT(*) AS registros FROM alerts WHERE marca IS NOT NULL GROUP BY marca"
    ),
    "zero_sales_status": _sql(
        "alerts",
        "SELECT COUNT(*) FILTER (ejecutada) AS ejecutada, COUNT(*) FILTER (NOT ejecutada) AS pendiente FROM alerts",
    ),
    "zero_sales_totals": _sql(
        "alerts",
        f"""SELECT COUNT(*) AS total_productos, COUNT(*) FILTER (ejecutada) AS ejecutados,
        COUNT(*) - COUNT(*) FILTER (ejecutada) AS pendientes, {_dbl("inventario")} AS inv_total,
        COUNT(DISTINCT punto_venta_id) + MAX(CAST(punto_venta_id IS NULL AS INT)) AS pdvs_afectados FROM alerts""",
    ),
    "zero_sales_sections": _sql(
        "alerts",
        f"""SELECT COALESCE(marca, 'OTRA') AS marca, COUNT(*) AS total_productos, COUNT(*) FILTER (ejecutada) AS ejecutados,
        COUNT(*) - COUNT(*) FILTER (ejecutada) AS pendientes, {_dbl("inventario")} AS inv_total,
        COUNT(DISTINCT producto) AS productos,
        CASE COALESCE(marca, 'OTRA') WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 WHEN 'OTRA' THEN 2 ELSE 3 END AS orden
        FROM alerts GROUP BY COALESCE(marca, 'OTRA')""",
    ),
    "zero_sales_listing": _sql(
        "alerts",
        """SELECT marca, producto, cadena, punto_venta, estado, inventario, ejecutada, fecha, promotor FROM alerts
        ORDER BY marca NULLS LAST, producto NULLS LAST, cadena NULLS LAST, punto_venta NULLS LAST, estado NULLS LAST,
        inventario NULLS LAST, ejecutada NULLS LAST, fecha NULLS LAST, promotor NULLS LAST""",
    ),
    "price_kpis": _sql(
        "prices",
        f"""SELECT COUNT(*) AS total_registros,
        COALESCE({_mean("CASE WHEN is_propio = 1 THEN precio END", 2)}, 0) AS precio_promedio_propio,
        COALESCE({_mean("CASE WHEN is_propio = 0 THEN precio END", 2)}, 0) AS precio_promedio_competencia,
        COUNT(DISTINCT CASE WHEN is_propio = 1 THEN producto END) AS productos_propios,
        COUNT(DISTINCT CASE WHEN is_propio = 0 THEN producto END) AS productos_competencia,
        COUNT(DISTINCT cadena) AS cadenas_monitoreadas FROM prices""",
    ),
    "price_by_type": _sql("kinds", f"SELECT tipo, {_mean('precio', 2)} AS precio FROM kinds GROUP BY tipo"),
    "price_by_category": _sql(
        "kinds",
        f"SELECT categoria, tipo, {_mean('precio', 2)} AS precio FROM kinds WHERE categoria IS NOT NULL GROUP BY categoria, tipo",
    ),
    "price_distribution": _sql(
        "kinds",
        """SELECT tipo, CAST(MIN(precio) AS DOUBLE) AS minimo, CAST(MAX(precio) AS DOUBLE) AS maximo,
        quantile_cont(CAST(precio AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(precio AS DOUBLE), 0.5) AS mediana,
        quantile_cont(CAST(precio AS DOUBLE), 0.75) AS q3 FROM kinds GROUP BY tipo""",
    ),
    "price_listing": _sql(
        "kinds",
        """SELECT producto, categoria, cadena, CAST(precio AS DOUBLE) AS precio, tipo, fecha, promotor FROM kinds
        WHERE status AND producto ILIKE '%RING%' AND is_propio = 1
        ORDER BY producto NULLS LAST, cadena NULLS LAST, fecha DESC NULLS LAST, categoria NULLS LAST,
        kinds.precio NULLS LAST, tipo, promotor NULLS LAST""",
    ),
    "price_listing_counts": _sql(
        "kinds",
        """SELECT COUNT(*) AS total, COUNT(*) FILTER (tipo = 'Propio') AS propios,
        COUNT(*) FILTER (tipo = 'Competencia') AS competencia FROM kinds WHERE status""",
    ),
    # sell-out
    "sellout_kpis": _sql(
        "sales",
        f"""SELECT {_even(_dbl("venta"), 2)} AS total_venta, {_even(_dbl("monto"), 2)} AS total_monto,
        {_big("piezas")} AS total_piezas, COUNT(DISTINCT punto_venta_id) AS pdvs_activos,
        COUNT(DISTINCT producto_id) AS productos, COALESCE({_mean("precio", 2)}, 0) AS precio_promedio FROM sales""",
    ),
    "sales_by_region": _sql(
        "sales",
        f"SELECT region, {_SUMS}, COUNT(DISTINCT punto_venta_id) AS pdvs FROM sales WHERE region IS NOT NULL GROUP BY region",
    ),
    "sales_by_channel": _sql("sales", f"SELECT canal_id, {_SUMS} FROM sales GROUP BY canal_id"),
    "top_products_sales": _sql(
        "sales",
        f"SELECT producto_id, {_SUMS} FROM sales GROUP BY producto_id ORDER BY venta DESC, producto_id LIMIT 10",
    ),
    "top_stores_sales": _sql(
        "sales",
        f"SELECT punto_venta_id, {_SUMS} FROM sales GROUP BY punto_venta_id ORDER BY venta DESC, punto_venta_id LIMIT 10",
    ),
    "sales_monthly_trend": _sql(
        "sales",
        f"SELECT anio, mes, {_SUMS}, anio || '-' || LPAD(CAST(mes AS VARCHAR), 2, '0') AS periodo FROM sales GROUP BY anio, mes",
    ),
    "last_period": _sql(
        "sales",
        """SELECT cliente_id, CAST(MAX(anio * 100 + mes) // 100 AS INT) AS anio, CAST(MAX(anio * 100 + mes) % 100 AS INT) AS mes
        FROM sales GROUP BY cliente_id""",
    ),
    "monthly_rollup": _sql(
        "rollup_month",
        "SELECT cliente_id, anio, mes, canal_id, cadena_id, producto_id, CAST(monto AS DOUBLE) AS monto, piezas, pdvs FROM rollup_month",
    ),
    "rollup_kpis": _sql(
        "rollup_month",
        f"""SELECT k.*, e.pdv_distinct, ROUND(e.monto / e.pdv_distinct, 0) AS ticket_exacto FROM (
        SELECT cliente_id, ROUND({_dbl("monto")}, 0) AS monto_total, ROUND({_dbl("piezas")}, 0) AS piezas_total,
        {_big("pdvs")} AS pdv_activos, COUNT(DISTINCT producto_id) AS productos_activos,
        ROUND({_dbl("monto")} / NULLIF({_big("pdvs")}, 0), 0) AS ticket_promedio FROM rollup_month GROUP BY cliente_id) k
        JOIN (SELECT cliente_id, COUNT(DISTINCT punto_venta_id) AS pdv_distinct, {_dbl("monto")} AS monto
              FROM sales GROUP BY cliente_id) e USING (cliente_id)""",
    ),
    "rollup_kpis_channel": _sql(
        "rollup_month channels",
        f"""SELECT cliente_id, ROUND({_dbl("monto")}, 0) AS monto_total, ROUND({_dbl("piezas")}, 0) AS piezas_total,
        {_big("pdvs")} AS pdv_activos, COUNT(DISTINCT producto_id) AS productos_activos,
        ROUND({_dbl("monto")} / NULLIF({_big("pdvs")}, 0), 0) AS ticket_promedio
        FROM rollup_month WHERE canal_id IN (SELECT id FROM channels WHERE nombre = 'BUILDING') GROUP BY cliente_id""",
    ),
    "rollup_trend": _sql(
        "rollup_month",
        f"""SELECT * FROM (
        SELECT cliente_id, anio, mes, ROUND({_dbl("monto")}, 0) AS monto, ROUND({_dbl("piezas")}, 0) AS piezas,
        {_big("pdvs")} AS pdv, anio || '-' || LPAD(CAST(mes AS VARCHAR), 2, '0') AS periodo
        FROM rollup_month GROUP BY cliente_id, anio, mes)
        JOIN (SELECT cliente_id, anio, mes, COUNT(DISTINCT punto_venta_id) AS pdv_distinct FROM sales GROUP BY ALL)
        USING (cliente_id, anio, mes)""",
    ),
    "rollup_yoy_month": _sql(
        "rollup_month",
        f"""SELECT anio, ROUND({_dbl("monto")}, 0) AS monto, ROUND({_dbl("piezas")}, 0) AS piezas
        FROM rollup_month WHERE mes = 5 GROUP BY anio""",
    ),
    "rollup_top_products": _sql(
        "rollup_month products",
        f"""SELECT COALESCE(r.nombre, 'Sin nombre') AS producto, r.marca, monto_total, piezas_total, pdv, pdv_distinct FROM (
          SELECT p.nombre, p.marca, {_RANKED}, {_big("r.pdvs")} AS pdv
          FROM rollup_month r LEFT JOIN products p ON p.id = r.producto_id GROUP BY p.nombre, p.marca) r
        JOIN (SELECT p.nombre, p.marca, COUNT(DISTINCT s.punto_venta_id) AS pdv_distinct
          FROM sales s LEFT JOIN products p ON p.id = s.producto_id GROUP BY p.nombre, p.marca) e
        ON e.nombre IS NOT DISTINCT FROM r.nombre AND e.marca IS NOT DISTINCT FROM r.marca
        ORDER BY monto_total DESC, producto, r.marca NULLS LAST LIMIT 15""",
    ),
    "rollup_top_chains": _sql(
        "rollup_month named_chains",
        f"""SELECT * FROM (
          SELECT COALESCE(c.cadena, 'Sin cadena') AS cadena, {_RANKED}, {_big("r.pdvs")} AS pdv
          FROM rollup_month r LEFT JOIN named_chains c ON c.id = r.cadena_id GROUP BY 1)
        JOIN (SELECT COALESCE(c.cadena, 'Sin cadena') AS cadena, COUNT(DISTINCT s.punto_venta_id) AS pdv_distinct
          FROM sales s LEFT JOIN named_chains c ON c.id = s.cadena_id GROUP BY 1) USING (cadena)
        ORDER BY monto_total DESC, cadena LIMIT 15""",
    ),
    "rollup_channel_mix": _sql(
        "rollup_month channels",
        f"""SELECT COALESCE(c.nombre, 'Sin canal') AS canal, COALESCE(c.segmento, 'Sin segmento') AS segmento, {_RANKED}
        FROM rollup_month r LEFT JOIN channels c ON c.id = r.canal_id GROUP BY c.nombre, c.segmento""",
    ),
    "channel_options": _sql(
        "rollup_month channels",
        """SELECT DISTINCT r.cliente_id, c.nombre FROM rollup_month r JOIN channels c ON c.id = r.canal_id
        WHERE c.nombre IS NOT NULL""",
    ),
    # inventory and catalogue
    "inventory_kpis": _sql(
        "stock",
        f"""SELECT {_even(_dbl("existencia"), 2)} AS existencia_total, {_mean("dias", 1)} AS dias_inventario_prom,
        {_big("sobre")} AS sobre_inventario, {_pct("SUM(sobre)", "COUNT(*)", 1, "0")} AS pct_sobre_inventario,
        COUNT(DISTINCT punto_venta_id) AS pdvs_monitoreados, COUNT(DISTINCT producto_id) AS productos_monitoreados,
        {_even(_dbl("venta"), 2)} AS venta_total FROM stock""",
    ),
    "inventory_by_region": _sql(
        "stock",
        f"""SELECT region, {_dbl("existencia")} AS existencia, {_mean("dias", 1)} AS dias_inventario_prom,
        {_big("sobre")} AS sobre_inventario, COUNT(DISTINCT punto_venta_id) AS pdvs
        FROM stock WHERE region IS NOT NULL GROUP BY region""",
    ),
    "overstock_products": _sql(
        "stock",
        f"""SELECT producto_id, COUNT(id) AS casos, {_dbl("existencia")} AS existencia_total, {_mean("dias", 1)} AS dias_inventario_prom
        FROM stock WHERE sobre = 1 GROUP BY producto_id ORDER BY casos DESC, producto_id LIMIT 10""",
    ),
    "stock_vs_sales": _sql(
        "stock",
        f"""SELECT producto_id, {_dbl("existencia")} AS existencia, {_dbl("venta")} AS venta,
        {_mean("dias", 1)} AS dias_inventario_prom,
        {_even(_dbl("existencia") + " / NULLIF(" + _dbl("venta") + ", 0)", 2)} AS ratio_inv_venta
        FROM stock GROUP BY producto_id""",
    ),
    "inventory_monthly_trend": _sql(
        "stock",
        f"""SELECT anio, mes, {_dbl("existencia")} AS existencia, {_mean("dias", 1)} AS dias_inventario_prom,
        {_big("sobre")} AS sobre_inventario, anio || '-' || LPAD(CAST(mes AS VARCHAR), 2, '0') AS periodo
        FROM stock GROUP BY anio, mes""",
    ),
    "catalog_summary": _sql(
        "products",
        f"""SELECT COUNT(*) AS total_productos, COUNT(*) FILTER (status = 1) AS activos, COUNT(DISTINCT marca) AS marcas,
        COUNT(DISTINCT canal_id) AS canales, COALESCE({_mean("precio", 2)}, 0) AS precio_promedio FROM products""",
    ),
    "products_by_brand": _sql(
        "products",
        f"""SELECT marca, COUNT(id) AS total, {_big("status")} AS activos, {_mean("precio", 2)} AS precio_promedio
        FROM products WHERE marca IS NOT NULL GROUP BY marca""",
    ),
    "catalog_search_page": _sql(
        "users",
        """SELECT * FROM users WHERE user_real_name ILIKE '%rep 1%' OR username ILIKE '%rep 1%' OR email ILIKE '%rep 1%'
        ORDER BY id DESC LIMIT 3 OFFSET 3""",
    ),
    "catalog_search_count": _sql(
        "users",
        """SELECT COUNT(*) AS total, CAST(2 AS BIGINT) AS page, CAST(3 AS BIGINT) AS page_size,
        CAST(GREATEST(1, CEIL(COUNT(*) / 3.0)) AS BIGINT) AS total_pages FROM users
        WHERE user_real_name ILIKE '%rep 1%' OR username ILIKE '%rep 1%' OR email ILIKE '%rep 1%'""",
    ),
    "record_by_id": _sql("users", "SELECT * FROM users WHERE id = 7"),
    "catalog_search_teams": _sql(
        "teams",
        """SELECT * FROM teams WHERE entidad ILIKE '%nation_%' AND (entidad ILIKE '%r1%' OR region ILIKE '%r1%')
        ORDER BY id DESC LIMIT 50""",
    ),
    "catalog_search_workdays": """SELECT event_id AS id, user_id AS usuario_id, ts AS fecha, strftime(ts, '%H:%M') AS hora,
        CAST(date_trunc('month', ts) AS DATE) AS mes_desde, 'Falta ' AS incidencia,
        CASE event_id % 3 WHEN 0 THEN 'Check-in' WHEN 1 THEN 'Check-out' ELSE CAST(event_id % 3 AS VARCHAR) END AS tipo
        FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) <= '2024-01-30' ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "catalog_search_brand_execution": _searched(
        "x_brand AS nombre_marca",
        "nombre_marca ILIKE '%brand#1%' AND (nombre_marca ILIKE '%p1%' OR user_real_name ILIKE '%p1%' OR supervisor ILIKE '%p1%')",
    ),
    "catalog_search_brand_audit": _searched("x_brand AS nombre_marca", "supervisor ILIKE '%sup 3%'"),
    "catalog_search_store_execution": _searched(
        "CASE WHEN l_returnflag = 'R' THEN 'Falta de producto' ELSE 'Sin novedad' END AS incidencias",
        "user_real_name ILIKE '%falta%' OR supervisor ILIKE '%falta%' OR incidencias ILIKE '%falta%'",
    ),
    "catalog_search_competition": _searched(
        "x_brand AS marca, CASE WHEN l_discount > 0.05::DOUBLE THEN 'Promo 2x1' ELSE 'Descuento' END AS tipo_promo",
        "marca ILIKE '%brand#2%' AND tipo_promo ILIKE '%2x1%'",
    ),
    "catalog_search_prices": _searched(None, "supervisor ILIKE '%sup 1%' OR user_real_name ILIKE '%sup 1%'"),
    "catalog_search_absences": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS nombre FROM nation
        WHERE n_name ILIKE '%nation_1%' ORDER BY id DESC LIMIT 50""",
    "catalog_search_services": """SELECT p_partkey AS id, p_brand AS clave, p_type AS descripcion FROM part
        WHERE p_brand ILIKE '%promo%' OR p_type ILIKE '%promo%' ORDER BY id DESC LIMIT 50""",
    "catalog_search_after": _sql(
        "users",
        """SELECT * FROM users WHERE id < 15 AND
        (user_real_name ILIKE '%rep 1%' OR username ILIKE '%rep 1%' OR email ILIKE '%rep 1%') ORDER BY id DESC LIMIT 3""",
    ),
    # stored tables
    "rollup_range": _sql(
        "rollup_month",
        f"""SELECT anio, mes, {_dbl("monto")} AS monto, COUNT(*) AS filas FROM rollup_month
        WHERE anio * 12 + mes >= (SELECT MAX(anio * 12 + mes) - 2 FROM rollup_month) GROUP BY anio, mes""",
    ),
    "rollup_refreshed": _sql(
        "rollup_month",
        f"""SELECT anio, mes, {_dbl("monto")} AS monto,
        CAST(SUM(CASE WHEN anio * 12 + mes = last THEN 2 ELSE 1 END * piezas) AS BIGINT) AS piezas, COUNT(*) AS filas
        FROM rollup_month, (SELECT MAX(anio * 12 + mes) AS last FROM rollup_month)
        WHERE anio * 12 + mes <> last - 1 GROUP BY anio, mes""",
    ),
    "itinerary_display": _sql(
        "itin",
        """SELECT fecha AS "Fecha", username AS "Usuario", promotor AS "Promotor", entidad AS "Entidad",
        hora_entrada AS "Entrada", hora_salida AS "Salida", visitas_planeadas AS "Planeadas",
        visitas_realizadas AS "Realizadas", pdvs_visitados AS "PDVs", fuera_de_ruta AS "Fuera ruta" FROM itin""",
    ),
    "report_bundle": _sql(
        "reps",
        f"""SELECT 'promotores' AS informe, COUNT(*) AS filas, {_big("plan")} AS plan FROM reps
        UNION ALL SELECT 'equipos', COUNT(*), {_big("plan")} FROM (SELECT cliente_id, entidad, SUM(plan) AS plan FROM reps GROUP BY 1, 2)
        UNION ALL SELECT 'resumen', COUNT(*), {_big("plan")} FROM (SELECT cliente_id, SUM(plan) AS plan FROM reps GROUP BY 1)""",
    ),
    "products_at_risk": _sql(
        "lines",
        """SELECT x_pdv AS punto_venta_id, x_brand AS marca, p_name AS producto_en_riesgo,
        MAX(CASE WHEN l_tax <> 0 THEN x_out ELSE 0 END) AS agotados, MAX(x_near) AS preagotados
        FROM lines GROUP BY ALL HAVING MAX(CASE WHEN l_tax <> 0 THEN x_out ELSE 0 END) > 0 OR MAX(x_near) > 0""",
    ),
    "dump_file_rows": """SELECT s_suppkey AS id, s_name AS nombre, CASE WHEN s_suppkey % 2 = 0 THEN
        'uno' || chr(10) || 'dos' || chr(9) || '"tres" \\n; ' || s_suppkey END AS nota FROM supplier""",
    "dump_tuple_rows": """SELECT p_partkey AS id, p_name || ' (O''Hara, 50%) \\' AS nombre,
        CASE WHEN p_brand <> 'Brand#25' THEN p_brand END AS marca, p_size % 2 = 1 AS activo,
        p_retailprice AS precio FROM part WHERE p_size <> 50""",
    "dump_tuple_tables": """SELECT 'fila' AS tipo, 'supplier' AS tabla, CASE WHEN s_suppkey % 2 = 0 THEN 'nota,id,nombre' END AS columnas,
        COUNT(*) AS filas FROM supplier GROUP BY ALL
        UNION ALL SELECT 'fila', 'nation', NULL, COUNT(*) FROM nation
        UNION ALL SELECT 'tabla', 'supplier', 'id,nombre,nota', 1""",
    "dump_file_merged": "SELECT * FROM (VALUES ('otro fin de linea', true), ('su fin de linea', false)) t(lectura, varias)",
    "ingest_csv": """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS nombre, 'dijo "si",' || chr(10) || p_brand AS nota,
        CAST(NULL AS VARCHAR) AS ausente FROM part""",
    "ingest_csv_corrupt": "SELECT COUNT(*) AS leidas, COUNT(*) FILTER (p_partkey % 5 = 0) AS corruptas FROM part",
    # cleaning
    "clean_operations": _sql(
        "dirty",
        f"""SELECT clave, fecha, inicio_jornada, fecha AS fin_jornada, {_YM}, {_WEEK}, dayname(fecha) AS dia_semana,
        {_num("q")} AS horas_laboradas, {_num("q * 2")} AS pct_cumplimiento_plan, {_num("q")} AS pct_cumplimiento_visitas,
        COALESCE({_num("q * 2")} >= 80, false) AS cumple_plan, otro AS entidad FROM dirty""",
    ),
    "clean_execution": _sql(
        "dirty",
        f"""SELECT clave, fecha, {_bit("bit3")} AS con_agotados, {_bit("bit2")} AS planograma, {_bit("bit1")} AS status,
        {_YM}, {_WEEK}, {_even(_num("q % 9") + " / NULLIF(" + _num("q % 5") + ", 0) * 100", 2)} AS pct_sku_agotados,
        marca AS nombre_marca, cadena FROM dirty""",
    ),
    "clean_stockouts": _sql(
        "dirty",
        """SELECT clave, CAST(year(anio_mes) AS INT) AS anio, CAST(month(anio_mes) AS INT) AS mes, marca, cadena,
        CASE WHEN p <= -1 THEN NULL WHEN p <= 0 THEN 'Sin quiebre' WHEN p <= 5 THEN 'Bajo' WHEN p <= 15 THEN 'Medio'
             WHEN p <= 100 THEN 'Alto' END AS nivel_quiebre FROM (SELECT *, COALESCE(pct_quiebre, 0) AS p FROM dirty)""",
    ),
    "clean_risk_products": _sql(
        "dirty", "SELECT clave, fecha, marca, cadena, otro AS producto_en_riesgo FROM dirty"
    ),
    "clean_zero_sales": _sql(
        "dirty",
        f"""SELECT clave, fecha, {_bit("bit0")} AS ejecutada, {_YM}, {_num("q")} AS inventario, marca, cadena,
        otro AS promotor FROM dirty""",
    ),
    "clean_prices": _sql(
        "dirty",
        f"""SELECT clave, fecha, {_bit("bit0")} AS is_propio, {_bit("bit1")} AS status, {_YM}, {_num("q + 3")} AS precio,
        CASE {_bit("bit0")} WHEN true THEN 'Propio' WHEN false THEN 'Competencia' ELSE 'Sin dato' END AS tipo_precio,
        otro AS categoria, cadena, otro AS promotor FROM dirty""",
    ),
    "clean_brand_report": _sql(
        "dirty",
        f"""SELECT clave, fecha, {_YM}, {_WEEK}, pct_planograma, {_num("q")} AS pct_visitas_agotados,
        CASE WHEN p <= -1 THEN NULL WHEN p <= 49 THEN 'Bajo' WHEN p <= 79 THEN 'Medio' WHEN p <= 100 THEN 'Alto' END AS nivel_planograma,
        cadena, marca FROM (SELECT *, COALESCE(pct_planograma, 0) AS p FROM dirty)""",
    ),
}

_SUMMARY = """SELECT cadena, punto_venta, municipio, estado, marca, CAST(SUM(total_visitas) AS BIGINT) AS visitas,
    CAST(SUM(cant_sku) AS BIGINT) AS sku, CAST(SUM(cumple_planograma) AS BIGINT) AS planograma,
    CAST(SUM(visitas_con_agotados) AS BIGINT) AS vis_agotados, CAST(SUM(cant_sku_agotados) AS BIGINT) AS sku_agotados,
    CAST(SUM(visitas_con_preagotados) AS BIGINT) AS vis_preagotados,
    CAST(SUM(cant_sku_preagotados) AS BIGINT) AS sku_preagotados
    FROM report GROUP BY cadena, punto_venta, municipio, estado, marca"""
ORACLES["execution_summary"] = _sql(
    "report",
    f"{_SUMMARY} ORDER BY cadena NULLS LAST, punto_venta NULLS LAST, marca NULLS LAST, municipio, estado",
)
ORACLES["execution_detail_pct"] = _sql(
    "report",
    f"""SELECT *, {_pct("planograma", "visitas")} AS pct_planograma, {_pct("sku_agotados", "sku")} AS pct_agotados,
    {_pct("sku_preagotados", "sku")} AS pct_preagotados FROM ({_SUMMARY})""",
)
for _name, _keys in (("managerial_by_store", "nombre_cadena, nombre_pdv"), ("managerial_by_chain", "nombre_cadena")):
    ORACLES[_name] = _sql(
        "managed",
        f"""SELECT {_keys}, COUNT(id) AS visitas, {_big("planograma")} AS cumple_planograma,
        {_big("cant_agotados")} AS sku_agotados, {_big("cant_sku")} AS total_sku,
        {_pct("COALESCE(SUM(planograma), 0)", "COUNT(id)", 2)} AS pct_cumplimiento,
        {_pct("SUM(cant_agotados)", "SUM(cant_sku)", 2, "0")} AS pct_agotados FROM managed GROUP BY {_keys}""",
    )

ORACLES["managerial_levels"] = f"""SELECT nombre_cadena, nombre_pdv,
    CASE WHEN pct_cumplimiento >= 85 THEN 'green' WHEN pct_cumplimiento >= 70 THEN 'yellow' ELSE 'red' END AS nivel_cumplimiento,
    CASE WHEN pct_agotados > 15 THEN 'red' ELSE 'green' END AS nivel_agotados
    FROM ({ORACLES["managerial_by_store"]})"""


def _light(pct: str) -> str:
    return f"CASE WHEN {pct} > 10 THEN 'red' WHEN {pct} > 5 THEN 'yellow' ELSE 'green' END"


ORACLES["store_brand_levels"] = _sql(
    "store_brand",
    f"""SELECT cadena, pdv_id, marca,
    CASE WHEN pct_planograma >= 80 THEN 'green' WHEN pct_planograma >= 50 THEN 'yellow' ELSE 'red' END AS nivel_planograma,
    {_light("pct_visitas_agotados")} AS nivel_visitas_agotados, {_light("pct_sku_agotados")} AS nivel_sku_agotados,
    CASE WHEN pct_visitas_preagotados > 5 THEN 'yellow' ELSE 'green' END AS nivel_visitas_preagotados,
    CASE WHEN pct_sku_preagotados > 5 THEN 'yellow' ELSE 'green' END AS nivel_sku_preagotados FROM store_brand""",
)

# Through an index: what the scan finds.
_INDEXED = (
    "brand_execution store_execution brand_audit competition prices absences services teams page workdays".split()
)
ORACLES |= {f"indexed_search_{name}": ORACLES[f"catalog_search_{name}"] for name in _INDEXED}
ORACLES["page_by_number"] = """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
    ORDER BY o_orderkey DESC LIMIT 50 OFFSET 4950"""
