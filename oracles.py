"""SQL that each registered query must agree with, over the same tables in another engine.

Written for plain correctness, not speed: joins fan out and windows are direct, so that the Spark
plans are checked against the obvious formulation.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"
AS_OF_LAST = "TIMESTAMP '2001-08-01 00:00:00'"
AS_OF_EVENTS = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "DATE '1998-05-20'"


def pick(key: str, *choices: str) -> str:
    return "[" + ", ".join(f"'{c}'" for c in choices) + f"][CAST({key} % {len(choices)} AS INTEGER) + 1]"


def pad(prefix: str, key: str, width: int) -> str:
    return f"'{prefix}' || lpad(CAST({key} AS VARCHAR), {width}, '0')"


def exact(numerator: str, denominator: str, scale: int) -> str:
    """numerator / denominator rounded half up at ``scale`` digits in whole numbers; the numerator comes
    already multiplied by 10^scale. NULL when the denominator is 0."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return f"(CASE WHEN {denominator} = 0 THEN NULL ELSE CAST(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) AS DOUBLE) / 1e{scale} END)"


def rounded(value: str, scale: int) -> str:
    """A value known to six digits, rounded half up to fewer without passing through a double's tie."""
    return exact(f"round({value} * 1000000)", str(10 ** (6 - scale)), scale)


def money(sum_: str) -> str:
    return f"CAST({sum_} * 100 AS HUGEINT)"


BASE = f"""
WITH ports AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id,
    chr(65 + n_regionkey) || chr(65 + n_nationkey) || {pad('N', 'n_nationkey', 2)} AS un_locode, '' AS iata_code, n_name AS port_name,
    chr(65 + n_regionkey) || chr(65 + n_nationkey) AS country_code, {pick('n_nationkey', 'SEA', 'AIR', 'DRY', 'MULTI')} AS port_type,
    CAST(n_nationkey * 7 - 80 AS DOUBLE) AS latitude, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS longitude, 'UTC' AS timezone,
    n_nationkey % 8 <> 7 AS is_active
  FROM nation),
companies AS (
  SELECT c_custkey AS id, c_name AS legal_name, '' AS trade_name, {pick('c_custkey', 'SHIPPER', 'CONSIGNEE', 'FF', 'CB', '3PL')} AS company_type,
    {pad('TAX', 'c_custkey', 10)} AS tax_id, '' AS duns_number, p.country_code, c_acctbal >= 0 AS is_active, '{{}}' AS metadata
  FROM customer LEFT JOIN ports p ON p.id = c_nationkey),
carriers AS (
  SELECT s_suppkey AS id, s_suppkey AS company_id, {pad('C', 's_suppkey', 7)} AS carrier_code, s_name AS carrier_name,
    {pick('s_suppkey', 'SEA', 'AIR', 'RAIL', 'ROAD', 'MULTI')} AS mode,
    CASE WHEN s_suppkey % 5 = 0 THEN CAST(9000000 + s_suppkey AS VARCHAR) ELSE '' END AS imo_number,
    s_suppkey % 10 <> 9 AS is_active, [p.un_locode, 'AAN00'] AS hub_ports,
    '{{"webhook_secret":"key-' || s_suppkey || '"}}' AS service_metadata
  FROM supplier LEFT JOIN ports p ON p.id = s_nationkey),
lane AS (SELECT l_orderkey, min(l_suppkey) AS carrier_id FROM lineitem GROUP BY 1),
keyed AS (
  SELECT o.*, lane.carrier_id, CAST(s_nationkey AS BIGINT) AS origin_port_id, CAST(c_nationkey AS BIGINT) AS destination_port_id,
    CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'IN_TRANSIT'
      ELSE {pick('o_orderkey', 'BOOKED', 'AT_PORT', 'EXCEPTION', 'CANCELLED', 'CUSTOMS_HOLD')} END AS status,
    o_orderdate + to_days(CAST(14 + o_orderkey % 15 AS INTEGER)) AS eta
  FROM orders o JOIN lane ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = lane.carrier_id JOIN customer ON c_custkey = o_custkey),
shipments AS (
  SELECT o_orderkey AS id, o_custkey AS shipper_id, o_custkey // 2 AS consignee_id, CAST(NULL AS BIGINT) AS notify_party_id, carrier_id,
    origin_port_id * 25 + destination_port_id AS route_id, origin_port_id, destination_port_id,
    {pad('GT-', 'o_orderkey', 10)} AS tracking_number,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {pad('BL', 'o_orderkey // 2', 10)} END AS bill_of_lading, '' AS house_bill_of_lading,
    {pad('PO', 'o_orderkey', 10)} AS purchase_order_refs, status, CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS booking_date,
    o_orderdate AS departure_date, eta AS estimated_arrival,
    CASE WHEN status = 'DELIVERED' THEN eta + to_days(CAST(o_orderkey % 8 - 2 AS INTEGER)) END AS actual_arrival,
    CASE WHEN o_orderkey % 37 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS declared_value,
    CAST(o_orderkey % 25000 + 800 AS DECIMAL(14,2)) AS freight_cost, 'USD' AS currency_code,
    {pick('o_orderkey', 'FOB', 'CIF', 'CFR', 'DAP', 'EXW', 'DDP')} AS incoterms, '8471.30,8473.30' AS hs_codes,
    CASE WHEN o_orderkey % 10 = 0 THEN 'seed' ELSE '' END AS tags,
    '{{"idempotency_key":"' || {pad('key-', 'o_orderkey', 10)} || '"}}' AS custom_attributes, '' AS notes,
    o_orderdate - INTERVAL 7 DAY AS created_at, o_orderdate AS updated_at
  FROM keyed),
routes AS (
  SELECT route_id AS id, min(carrier_id) AS carrier_id, route_id // 25 AS origin_port_id, route_id % 25 AS destination_port_id,
    {pad('LANE-', 'route_id', 4)} AS route_code, {pick('route_id', 'ACTIVE', 'ACTIVE', 'SEASONAL', 'SUSPENDED')} AS status,
    CAST(14 AS BIGINT) AS transit_days_min, CAST(28 AS BIGINT) AS transit_days_max, '' AS transshipment_ports,
    CAST(route_id % 23 AS BIGINT) AS weekly_frequency, DATE '1995-01-01' AS effective_from,
    CASE WHEN route_id % 9 = 0 THEN DATE '2000-01-01' END AS effective_until
  FROM shipments GROUP BY route_id),
cargo AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_orderkey AS shipment_id,
    {pick('l_partkey', 'GENERAL', 'BULK', 'CONTAINER', 'BREAKBULK', 'REEFER', 'HAZMAT', 'OVERSIZED', 'LIQUID')} AS cargo_type, '' AS description,
    {pad('CONT', 'l_partkey % 1000', 7)} AS container_number, '' AS seal_number, CAST(l_quantity AS DECIMAL(12,3)) AS gross_weight_kg,
    CAST(l_quantity - l_partkey % 4 + 1 AS DECIMAL(12,3)) AS net_weight_kg, CAST(l_quantity * 2 AS DECIMAL(10,4)) AS volume_cbm,
    CAST(l_quantity AS BIGINT) AS package_count, 'CT' AS package_type, l_tax >= 0.07 AS is_hazmat,
    CASE WHEN l_tax >= 0.07 AND l_partkey % 11 <> 0 THEN {pad('1', 'l_partkey % 1000', 3)} ELSE '' END AS un_number, '' AS imdg_class,
    CASE WHEN l_partkey % 8 = 4 THEN CAST(-(l_partkey % 20) AS DECIMAL(5,2)) END AS temperature_min_c,
    CASE WHEN l_partkey % 8 = 4 THEN CAST(l_partkey % 9 - 12 AS DECIMAL(5,2)) END AS temperature_max_c, '{{}}' AS custom_attributes
  FROM lineitem),
tracking_events AS (
  SELECT event_id AS id, event_id // 3 AS shipment_id, user_id % 25 AS port_id, CASE WHEN event_id % 40 = 39 THEN event_id - 1 END AS supersedes_id,
    CASE event_type WHEN 'error' THEN 'EXCEPTION' WHEN 'view' THEN 'ARRIVAL' WHEN 'click' THEN 'DEPARTURE' WHEN 'purchase' THEN 'DELAY'
      ELSE 'DOC_RECEIVED' END AS event_type,
    ts AS event_time, ts + to_hours(event_id % 30) AS recorded_at, '' AS location_description, '' AS description, event_type = 'error' AS is_exception,
    event_id % 3 = 0 AS exception_resolved, 'FEED' AS source_system, '{{"webhook_id":"w' || event_id || '"}}' AS raw_payload
  FROM events),
port_calls AS (
  SELECT event_id AS id, event_id % 625 AS route_id, user_id % 25 AS port_id, event_id // 625 + 1 AS call_sequence, '' AS vessel_name, '' AS voyage_number,
    ts AS scheduled_arrival, ts + to_minutes(CAST(floor(value - 50) AS BIGINT)) AS actual_arrival, ts + INTERVAL 1 DAY AS scheduled_departure,
    ts + to_minutes(CAST(floor(value - 50) AS BIGINT)) + to_days(CAST(event_id % 3 - 1 AS INTEGER)) AS actual_departure,
    CAST(value - 50 AS DECIMAL(7,2)) AS arrival_delay_hours
  FROM events WHERE event_type = 'view'),
cargo_sum AS (SELECT shipment_id, sum(gross_weight_kg) AS weight, CAST(sum(package_count) AS BIGINT) AS packages, count(*) AS lines FROM cargo GROUP BY 1),
event_sum AS (SELECT shipment_id, count(*) AS n, count(*) FILTER (WHERE is_exception) AS bad FROM tracking_events GROUP BY 1)
"""

LATE = f"(estimated_arrival < {AS_OF} AND status NOT IN ('DELIVERED', 'CANCELLED'))"
LATE_SNAP = "(estimated_arrival < {at} AND status IN ('IN_TRANSIT', 'AT_PORT', 'EXCEPTION'))"
LIST = "id, status, CAST(declared_value AS DOUBLE) AS declared_value"
STATUS_LABELS = (
    "CASE status WHEN 'DRAFT' THEN 'Draft' WHEN 'BOOKED' THEN 'Booked' WHEN 'IN_TRANSIT' THEN 'In Transit' WHEN 'AT_PORT' THEN 'At Port' "
    "WHEN 'CUSTOMS_HOLD' THEN 'Customs Hold' WHEN 'DELIVERED' THEN 'Delivered' WHEN 'CANCELLED' THEN 'Cancelled' WHEN 'EXCEPTION' THEN 'Exception' END"
)
MODE_LABELS = (
    "CASE mode WHEN 'SEA' THEN 'Sea Freight' WHEN 'AIR' THEN 'Air Freight' WHEN 'RAIL' THEN 'Rail Freight' WHEN 'ROAD' THEN 'Road Freight' "
    "WHEN 'MULTI' THEN 'Multimodal' END"
)
CARGO_LABELS = (
    "CASE cargo_type WHEN 'GENERAL' THEN 'General Cargo' WHEN 'BULK' THEN 'Bulk' WHEN 'CONTAINER' THEN 'Containerized' "
    "WHEN 'BREAKBULK' THEN 'Break Bulk' WHEN 'REEFER' THEN 'Refrigerated' WHEN 'HAZMAT' THEN 'Hazardous Material' "
    "WHEN 'OVERSIZED' THEN 'Oversized / OOG' WHEN 'LIQUID' THEN 'Liquid / Tanker' END"
)
EVENT_LABELS = (
    "CASE event_type WHEN 'EXCEPTION' THEN 'Exception' WHEN 'ARRIVAL' THEN 'Arrival' WHEN 'DEPARTURE' THEN 'Departure' "
    "WHEN 'DELAY' THEN 'Delay' WHEN 'DOC_RECEIVED' THEN 'Document Received' END"
)
EVENT_OF = (
    "CASE {s} WHEN 'BOOKED' THEN 'DOC_RECEIVED' WHEN 'IN_TRANSIT' THEN 'DEPARTURE' WHEN 'AT_PORT' THEN 'ARRIVAL' WHEN 'DELIVERED' THEN 'DELIVERED' "
    "WHEN 'CUSTOMS_HOLD' THEN 'CUSTOMS_HOLD' ELSE 'EXCEPTION' END"
)
# legal moves, written once for the status checks
MOVES = [
    ("DRAFT", "BOOKED"), ("DRAFT", "CANCELLED"),
    ("BOOKED", "IN_TRANSIT"), ("BOOKED", "CANCELLED"), ("BOOKED", "EXCEPTION"),
    ("IN_TRANSIT", "AT_PORT"), ("IN_TRANSIT", "DELIVERED"), ("IN_TRANSIT", "CANCELLED"), ("IN_TRANSIT", "EXCEPTION"),
    ("AT_PORT", "IN_TRANSIT"), ("AT_PORT", "DELIVERED"), ("AT_PORT", "CANCELLED"), ("AT_PORT", "EXCEPTION"),
    ("CUSTOMS_HOLD", "IN_TRANSIT"), ("CUSTOMS_HOLD", "AT_PORT"), ("CUSTOMS_HOLD", "DELIVERED"), ("CUSTOMS_HOLD", "CANCELLED"), ("CUSTOMS_HOLD", "EXCEPTION"),
    ("EXCEPTION", "IN_TRANSIT"), ("EXCEPTION", "AT_PORT"), ("EXCEPTION", "DELIVERED"), ("EXCEPTION", "CANCELLED"),
]
LEGAL = "(" + " OR ".join(f"({{a}} = '{a}' AND {{b}} = '{b}')" for a, b in MOVES) + " OR {a} = {b})"

_SQL: dict[str, str] = {}


def sql(name: str, body: str, ctes: str = "") -> None:
    _SQL[name] = BASE + (f", {ctes}" if ctes else "") + body


def statements() -> dict[str, str]:
    return dict(_SQL)


# scans and writes

sql("a1_scan_companies", "SELECT * FROM companies")
sql("a1_scan_ports", "SELECT * FROM ports")
sql("a1_scan_carriers", "SELECT * EXCLUDE (hub_ports), array_to_string(hub_ports, ',') AS hub_ports FROM carriers")
sql("a1_scan_routes", "SELECT * FROM routes")
sql("a1_scan_shipments", "SELECT * REPLACE (CAST(declared_value AS DOUBLE) AS declared_value, CAST(freight_cost AS DOUBLE) AS freight_cost) FROM shipments")
CARGO_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("gross_weight_kg", "net_weight_kg", "volume_cbm", "temperature_min_c", "temperature_max_c"))
sql("a1_scan_cargo", f"SELECT * REPLACE ({CARGO_DOUBLES}) FROM cargo")
sql("a1_scan_tracking_events", "SELECT * FROM tracking_events")
sql("a1_scan_port_calls", "SELECT * REPLACE (CAST(arrival_delay_hours AS DOUBLE) AS arrival_delay_hours) FROM port_calls")
sql("a2_port_calls_default_order", "SELECT id, route_id, call_sequence, port_id FROM port_calls ORDER BY route_id, call_sequence, id")
sql("a3_append_ignoring_conflicts", "SELECT id + 1000000000000 AS id, shipment_id, event_type, event_time FROM tracking_events WHERE id % 2 = 1")
sql(
    "a4_get_or_create_ports",
    """SELECT p.un_locode, p.port_name, p.id AS rank, false AS created FROM ports p WHERE p.un_locode IN (SELECT un_locode FROM wanted)
    UNION ALL SELECT un_locode, arg_min(port_name, id), min(id), true FROM wanted WHERE un_locode NOT IN (SELECT un_locode FROM ports) GROUP BY un_locode""",
    "wanted AS (SELECT substr(un_locode, 1, 4) || (id % 3) AS un_locode, port_name, id FROM ports)",
)
sql(
    "c19_nested_containment",
    """SELECT s.id FROM shipments s WHERE origin_port_id = 3 AND EXISTS (SELECT 1 FROM cargo c WHERE c.shipment_id = s.id AND is_hazmat)
    AND EXISTS (SELECT 1 FROM cargo c WHERE c.shipment_id = s.id AND cargo_type = 'REEFER')""",
)
sql(
    "c19_similar_names",
    """SELECT query, key, similarity FROM (
      SELECT q.id AS query, n.id AS key, len(list_intersect(q.g, n.g)) / (len(q.g) + len(n.g) - len(list_intersect(q.g, n.g))) AS similarity
      FROM grams q JOIN grams n ON q.asked AND NOT n.asked)
    WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) <= 3""",
    """texts AS (
      SELECT id, true AS asked, replace(legal_name, 'Customer', 'Custmer') || ' & ' || tax_id AS text FROM companies WHERE id % 100 = 0
      UNION ALL SELECT id, false, legal_name || ' ' || tax_id FROM companies),
    words AS (SELECT id, asked, '  ' || unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) || ' ' AS w FROM texts),
    cut AS (SELECT id, asked, w, unnest(range(1, length(w) - 1)) AS i FROM words),
    grams AS (SELECT id, asked, list(DISTINCT substr(w, i, 3)) AS g FROM cut GROUP BY id, asked)""",
)
sql("a5_delete_tagged", "SELECT id, status, tracking_number FROM shipments WHERE tags <> 'seed'")

SEA = "['XAP00', 'XAP01', 'XAP02', 'XAP03', 'XAP04', 'XAP05', 'XAP06', 'XAP07']"


def draw(purpose: str, low: int, high: int, *key: str) -> str:
    text = " || '/' || ".join([f"'0/{purpose}'", *[f"CAST({k} AS VARCHAR)" for k in key]])
    return f"({low} + CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {high - low + 1})"


GENERATED = f"""
slots AS (SELECT o_orderkey AS n, {draw('lane', 0, 19, 'o_orderkey')} AS lane, {draw('status', 0, 99, 'o_orderkey')} AS share,
    {AS_OF} - to_days(CAST({draw('age', 3, 180, 'o_orderkey')} AS INTEGER)) AS departure_date FROM orders),
lanes AS (SELECT n, share, departure_date, ['DMO0', 'DMO1', 'DMO2', 'DMO3', 'DMO4'][lane // 4 + 1] AS carrier_id, {SEA}[lane % 4 + 1] AS origin_port_id,
    {SEA}[lane % 4 + 3] AS destination_port_id FROM slots),
routed AS (SELECT *, origin_port_id || '-' || destination_port_id || '-' || carrier_id AS route_id,
    CASE WHEN share < 40 THEN 'DELIVERED' WHEN share < 70 THEN 'IN_TRANSIT' WHEN share < 85 THEN 'BOOKED' WHEN share < 93 THEN 'AT_PORT'
      WHEN share < 97 THEN 'EXCEPTION' ELSE 'CANCELLED' END AS status FROM lanes),
timed AS (SELECT *, departure_date + to_days(CAST({draw('transit_min', 14, 18, 'route_id')}
    + {draw('transit', 0, 99999, 'n')} % ({draw('transit_max', 19, 28, 'route_id')} - {draw('transit_min', 14, 18, 'route_id')} + 1) AS INTEGER)) AS estimated_arrival
    FROM routed),
made AS (SELECT 'GT-SEED' || lpad(CAST(n AS VARCHAR), 12, '0') AS id,
    ['XA000000000', 'XA000000003', 'XA000000006'][{draw('shipper', 0, 2, 'n')} + 1] AS shipper_id,
    ['XA000000001', 'XA000000004', 'XA000000007'][{draw('consignee', 0, 2, 'n')} + 1] AS consignee_id,
    carrier_id, route_id, origin_port_id, destination_port_id,
    'GT-SEED' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS tracking_number, status,
    CAST(departure_date - to_days(CAST({draw('booked', 3, 14, 'n')} AS INTEGER)) AS DATE) AS booking_date, departure_date, estimated_arrival,
    CASE WHEN status = 'DELIVERED' THEN estimated_arrival + to_days(CAST({draw('delay', -2, 5, 'n')} AS INTEGER)) END AS actual_arrival,
    CAST({draw('value', 5000, 500000, 'n')} AS DOUBLE) AS declared_value, CAST({draw('freight', 800, 25000, 'n')} AS DOUBLE) AS freight_cost,
    'USD' AS currency_code, ['FOB', 'CIF', 'CFR', 'DAP', 'EXW', 'DDP'][{draw('incoterms', 0, 5, 'n')} + 1] AS incoterms,
    '{{"seed":true}}' AS custom_attributes FROM timed)
"""
sql("a6_generated_shipments", "SELECT * FROM made", GENERATED)
sql(
    "a6_generated_cargo",
    f"""SELECT shipment_id || '-' || item AS id, shipment_id, ['CONTAINER', 'GENERAL', 'BREAKBULK'][{draw('kind', 0, 2, 'shipment_id', 'item')} + 1] AS cargo_type,
    '[SEED] Goods of kind ' || {draw('goods', 0, 4, 'shipment_id', 'item')} AS description,
    'SEED' || {draw('container', 1000000, 9999999, 'shipment_id', 'item')} AS container_number,
    CAST({draw('gross', 500, 25000, 'shipment_id', 'item')} AS DOUBLE) AS gross_weight_kg,
    CAST({draw('gross', 500, 25000, 'shipment_id', 'item')} * 92 AS DOUBLE) / 100 AS net_weight_kg,
    CAST({draw('volume', 20, 67, 'shipment_id', 'item')} AS DOUBLE) AS volume_cbm, {draw('packages', 10, 500, 'shipment_id', 'item')} AS package_count,
    'CT' AS package_type, false AS is_hazmat, '' AS un_number,
    CAST(NULL AS DOUBLE) AS temperature_min_c, CAST(NULL AS DOUBLE) AS temperature_max_c FROM (SELECT id AS shipment_id, unnest(range(1, {draw('items', 1, 3, 'id')} + 1)) AS item FROM made)""",
    GENERATED,
)
sql(
    "a6_generated_events",
    """SELECT shipment_id || '-' || event_type AS id, *, false AS exception_resolved, 'SEED' AS source_system, '{}' AS raw_payload FROM (
    SELECT id AS shipment_id, NULL AS port_id, 'DOC_RECEIVED' AS event_type, departure_date - INTERVAL 1 DAY AS event_time, 'Booking confirmed.' AS description, false AS is_exception
      FROM made WHERE status = 'BOOKED'
    UNION ALL SELECT id, origin_port_id, 'DEPARTURE', departure_date, 'Vessel departed origin port.', false FROM made WHERE status IN ('IN_TRANSIT', 'AT_PORT', 'DELIVERED', 'EXCEPTION')
    UNION ALL SELECT id, destination_port_id, 'ARRIVAL', coalesce(actual_arrival, estimated_arrival), 'Vessel arrived at destination port.', false FROM made WHERE status IN ('AT_PORT', 'DELIVERED')
    UNION ALL SELECT id, NULL, 'DELIVERED', actual_arrival, 'Shipment delivered to consignee.', false FROM made WHERE status = 'DELIVERED'
    UNION ALL SELECT id, NULL, 'EXCEPTION', departure_date + INTERVAL 3 DAY, '[SEED] Exception: customs documentation incomplete.', true FROM made WHERE status = 'EXCEPTION')""",
    GENERATED,
)


def global_rows(at: str) -> str:
    late = LATE_SNAP.format(at=at)
    return f"""SELECT 'GLOBAL' AS entity_type, CAST(NULL AS VARCHAR) AS entity_id, {DAY} AS snapshot_date, 'DAILY' AS granularity, unnest(m).k AS metric_key,
      unnest(m).v AS metric_value, '{{}}' AS dimensions FROM (SELECT [
        {{'k': 'platform.shipments.total', 'v': CAST(count(*) AS DOUBLE)}},
        {{'k': 'platform.shipments.active', 'v': CAST(count(*) FILTER (WHERE status IN ('BOOKED', 'IN_TRANSIT', 'AT_PORT')) AS DOUBLE)}},
        {{'k': 'platform.shipments.delayed', 'v': CAST(count(*) FILTER (WHERE {late}) AS DOUBLE)}},
        {{'k': 'platform.declared_value.total', 'v': CAST(coalesce(sum(declared_value), 0) AS DOUBLE)}}] AS m
      FROM shipments WHERE CAST(departure_date AS DATE) = {DAY})"""


def carrier_rows(at: str) -> str:
    late = LATE_SNAP.format(at=at)
    return f"""SELECT 'CARRIER' AS entity_type, CAST(carrier_id AS VARCHAR) AS entity_id, {DAY} AS snapshot_date, 'DAILY' AS granularity, unnest(m).k AS metric_key,
      unnest(m).v AS metric_value, '{{}}' AS dimensions FROM (SELECT carrier_id, [
        {{'k': 'shipments.count', 'v': CAST(count(*) AS DOUBLE)}},
        {{'k': 'shipments.delay_count', 'v': CAST(count(*) FILTER (WHERE {late}) AS DOUBLE)}},
        {{'k': 'shipments.avg_declared_value', 'v': coalesce({exact(money('sum(declared_value)') + ' * 10000', 'count(declared_value)', 6)}, 0)}}] AS m
      FROM shipments WHERE CAST(departure_date AS DATE) = {DAY} AND carrier_id IN (SELECT id FROM carriers WHERE is_active) GROUP BY carrier_id)"""


sql("a7_upserted_snapshots", f"{global_rows(AS_OF)} UNION ALL {carrier_rows(chr(84) + 'IMESTAMP ' + chr(39) + '1998-06-30' + chr(39))}")
sql("a1_scan_analytics_snapshots", f"{global_rows(AS_OF)} UNION ALL {carrier_rows(AS_OF)}")
sql(
    "e1_e3_snapshot_violations",
    f"""SELECT 'analytics_snapshots' AS "table", CASE WHEN metric_key = 'shipments.count' THEN 'metric_unique' ELSE 'granularity_valid' END AS rule_name, count(*) AS n
    FROM ({carrier_rows(AS_OF)}) WHERE metric_key IN ('shipments.count', 'shipments.delay_count') GROUP BY ALL""",
)
sql("a8_view_keys_unique", "SELECT count(*) AS rows, 1 AS most FROM (SELECT DISTINCT carrier_id, CAST(departure_date AS DATE) FROM shipments)")

sql(
    "a8_refreshed_months",
    """SELECT route_id, CAST(date_trunc('month', departure_date) AS DATE) AS stat_month, count(*) AS shipment_count, CAST(coalesce(sum(declared_value), 0) AS DOUBLE) AS total_declared_value
    FROM shipments WHERE departure_date IS NOT NULL AND (year(departure_date) IN (1996, 1997) OR id % 3 > 0) GROUP BY 1, 2""",
)

# projections

sql(
    "b1_shipment_list",
    f"""SELECT s.id, tracking_number, s.status, {STATUS_LABELS.replace('CASE status', 'CASE s.status')} AS status_display, carrier_name, {MODE_LABELS} AS carrier_mode,
    CAST(declared_value AS DOUBLE) AS declared_value, currency_code, departure_date, estimated_arrival,
    CASE WHEN estimated_arrival < {AS_OF} AND s.status NOT IN ('DELIVERED', 'CANCELLED') THEN 1 ELSE 0 END AS is_delayed,
    o.un_locode AS origin_locode, o.port_name AS origin_name, d.un_locode AS destination_locode, d.port_name AS destination_name
    FROM shipments s JOIN carriers c ON c.id = s.carrier_id JOIN routes r ON r.id = s.route_id
    JOIN ports o ON o.id = r.origin_port_id JOIN ports d ON d.id = r.destination_port_id""",
)
sql(
    "b2_shipment_detail",
    f"""SELECT s.id, tracking_number, bill_of_lading, house_bill_of_lading, s.status, {STATUS_LABELS.replace('CASE status', 'CASE s.status')} AS status_display,
    carrier_name, {MODE_LABELS} AS carrier_mode, sh.legal_name AS shipper_name, co.legal_name AS consignee_name, origin_port_id, destination_port_id,
    CAST(declared_value AS DOUBLE) AS declared_value, CAST(freight_cost AS DOUBLE) AS freight_cost, currency_code, incoterms, booking_date, departure_date,
    estimated_arrival, actual_arrival, CAST(date_diff('second', departure_date, coalesce(actual_arrival, {AS_OF})) AS BIGINT) AS transit_duration_seconds,
    e.latest AS latest_event_time, hs_codes, tags, notes, coalesce(g.items, 0) AS cargo_count, created_at, updated_at
    FROM shipments s JOIN carriers c ON c.id = s.carrier_id JOIN companies sh ON sh.id = s.shipper_id JOIN companies co ON co.id = s.consignee_id
    LEFT JOIN (SELECT shipment_id, max(event_time) AS latest FROM tracking_events GROUP BY 1) e ON e.shipment_id = s.id
    LEFT JOIN (SELECT shipment_id, count(*) AS items FROM cargo GROUP BY 1) g ON g.shipment_id = s.id""",
)
sql(
    "b2_detail_cargo",
    f"""SELECT id, shipment_id, (row_number() OVER (PARTITION BY shipment_id ORDER BY id) - 1) // 500 AS cargo_page, cargo_type, {CARGO_LABELS} AS cargo_type_display, description,
    container_number, {CARGO_DOUBLES}, package_count, package_type, is_hazmat, un_number FROM cargo""",
)
sql(
    "b3_cargo_view",
    f"""SELECT id, shipment_id, cargo_type, {CARGO_LABELS} AS cargo_type_display, description, container_number, {CARGO_DOUBLES}, package_count, package_type,
    is_hazmat, un_number FROM cargo""",
)
sql(
    "b4_event_timeline",
    f"""SELECT e.id, shipment_id, event_type, {EVENT_LABELS} AS event_type_display, event_time, recorded_at, port_name, location_description, description,
    is_exception, exception_resolved FROM tracking_events e LEFT JOIN ports p ON p.id = e.port_id""",
)
sql("b5_status_labels", f"SELECT status, {STATUS_LABELS} AS label, count(*) AS n FROM shipments GROUP BY 1")

# filters

sql("c1_active", f"SELECT {LIST} FROM shipments WHERE status IN ('BOOKED', 'IN_TRANSIT', 'AT_PORT')")
sql("c2_delayed", f"SELECT {LIST} FROM shipments WHERE {LATE}")
sql("c3_high_value", f"SELECT {LIST} FROM shipments WHERE declared_value >= 250000.00")
sql("c4_by_carrier", f"SELECT {LIST} FROM shipments WHERE carrier_id = 7")
sql("c5_in_date_range", f"SELECT {LIST} FROM shipments WHERE departure_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
sql("c6_for_shipment", "SELECT id, event_type, event_time FROM tracking_events WHERE shipment_id = 40 ORDER BY event_time, id")
sql("c7_unresolved_exceptions", "SELECT id, shipment_id FROM tracking_events WHERE is_exception AND NOT exception_resolved")
sql("c8_events_in_time_range", "SELECT id, event_time FROM tracking_events WHERE event_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00'")
sql("c9_active_carriers_by_mode", "SELECT id, carrier_name FROM carriers WHERE is_active AND mode = 'AIR'")
sql("c10_hubbing_through", "SELECT id, carrier_code FROM carriers WHERE list_contains(hub_ports, 'AAN00')")
sql("c10_hubbing_through_both", "SELECT id, carrier_code FROM carriers WHERE list_has_all(hub_ports, ['AAN00', 'APN15'])")
sql(
    "c11_ports",
    """SELECT id, 'active sea' AS test FROM ports WHERE is_active AND port_type = 'SEA' UNION ALL SELECT id, 'country' FROM ports WHERE country_code = 'BB'
    UNION ALL SELECT id, 'locode' FROM ports WHERE un_locode = 'AAN00'""",
)
sql("c12_tagged", f"SELECT {LIST} FROM shipments WHERE tags = 'seed'")
sql(
    "c13_json_key",
    """SELECT id, 'equals' AS test FROM shipments WHERE json_extract_string(custom_attributes, '$.idempotency_key') = 'key-0000000123'
    UNION ALL SELECT id, 'has' FROM tracking_events WHERE json_exists(raw_payload, '$.webhook_id')""",
)
sql(
    "c14_list_filters",
    f"""SELECT {LIST} FROM shipments WHERE status IN ('IN_TRANSIT', 'AT_PORT') AND departure_date >= TIMESTAMP '1997-01-01' AND departure_date <= TIMESTAMP '1998-12-31'
    AND declared_value >= 50000 AND declared_value <= 400000 AND {LATE}""",
)
sql("c14_list_filters_carrier", f"SELECT {LIST} FROM shipments WHERE carrier_id = 3 AND NOT {LATE} AND carrier_id IN (SELECT id FROM carriers WHERE is_active)")
sql("c15_last_90_days", f"SELECT {LIST} FROM shipments WHERE departure_date >= {AS_OF_LAST} - INTERVAL 90 DAY")
sql("c16_company_scope", f"SELECT {LIST} FROM shipments WHERE shipper_id = 30 OR consignee_id = 30")
sql("c17_carrier_scope", f"SELECT {LIST} FROM shipments WHERE carrier_id = 5")
OVERDUE = "status IN ('IN_TRANSIT', 'AT_PORT') AND actual_arrival IS NULL AND estimated_arrival < {at} - INTERVAL 2 HOUR"
TOLD = "id IN (SELECT shipment_id FROM tracking_events WHERE event_type = 'DELAY' AND CAST(event_time AS DATE) = CAST({at} AS DATE))"
sql(
    "c18_no_delay_today",
    f"SELECT id AS shipment_id, 'DELAY' AS event_type FROM shipments WHERE {OVERDUE.format(at=AS_OF_EVENTS)} AND NOT {TOLD.format(at=AS_OF_EVENTS)}",
)
sql(
    "c19_json_and_codes",
    """SELECT 'json' AS test, id FROM shipments WHERE 'key-' || lpad(CAST(id AS VARCHAR), 10, '0') = 'key-0000000040'
    UNION ALL SELECT 'codes', id FROM shipments WHERE hs_codes LIKE '%8471.30%' AND hs_codes LIKE '%8473.30%'""",
)
sql(
    "c19_lookups",
    """SELECT 'tracking' AS test, CAST(id AS VARCHAR) AS id FROM shipments WHERE tracking_number IN ('GT-0000000007', 'GT-0000000008')
    UNION ALL SELECT 'bill of lading', CAST(id AS VARCHAR) FROM shipments WHERE bill_of_lading = 'BL0000000050'
    UNION ALL SELECT 'container', id FROM cargo WHERE container_number = 'CONT0000616'
    UNION ALL SELECT 'voyage', CAST(id AS VARCHAR) FROM port_calls WHERE vessel_name = '' AND voyage_number = ''
    UNION ALL SELECT 'late call', CAST(id AS VARCHAR) FROM port_calls WHERE arrival_delay_hours > 100
    UNION ALL SELECT 'hazmat', id FROM cargo WHERE is_hazmat AND shipment_id IN (SELECT id FROM shipments WHERE status = 'IN_TRANSIT')
    UNION ALL SELECT 'reefer', id FROM cargo WHERE cargo_type = 'REEFER' AND temperature_min_c < -10
    UNION ALL SELECT 'lane', CAST(id AS VARCHAR) FROM shipments WHERE origin_port_id = 3 AND destination_port_id = 4
    UNION ALL SELECT 'valid route', CAST(id AS VARCHAR) FROM routes WHERE effective_from <= DATE '2000-06-01' AND (effective_until IS NULL OR effective_until >= DATE '2000-06-01')
    UNION ALL SELECT 'name', CAST(id AS VARCHAR) FROM companies WHERE legal_name ILIKE '%customer#00000001%'""",
)

# joins

sql(
    "d1_with_carrier",
    """SELECT s.id, carrier_name, mode AS carrier_mode, legal_name AS carrier_company_legal_name FROM shipments s JOIN carriers c ON c.id = s.carrier_id
    JOIN companies k ON k.id = c.company_id""",
)
sql(
    "d2_with_route",
    """SELECT s.id, route_code, o.port_name AS route_origin_port_name, d.un_locode AS route_destination_un_locode FROM shipments s
    JOIN routes r ON r.id = s.route_id JOIN ports o ON o.id = r.origin_port_id JOIN ports d ON d.id = r.destination_port_id""",
)
sql(
    "d3_with_shipment",
    """SELECT e.id, tracking_number, carrier_name, port_name FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id
    JOIN carriers c ON c.id = s.carrier_id LEFT JOIN ports p ON p.id = e.port_id""",
)
sql("d4_with_company", "SELECT c.id, legal_name AS company_legal_name, country_code AS company_country_code FROM carriers c JOIN companies k ON k.id = c.company_id")
sql(
    "d6_with_latest_event",
    "SELECT s.id, (SELECT max(event_time) FROM tracking_events e WHERE e.shipment_id = s.id) AS latest_event_time FROM shipments s",
)
LATEST_CALL = """(SELECT * FROM (SELECT route_id, arrival_delay_hours, scheduled_arrival, row_number() OVER (PARTITION BY route_id ORDER BY scheduled_arrival DESC, id DESC) AS rn
    FROM port_calls WHERE scheduled_arrival IS NOT NULL) WHERE rn = 1)"""
sql(
    "d7_latest_port_call",
    f"""SELECT r.id AS route_id, CAST(arrival_delay_hours AS DOUBLE) AS latest_delay_hours, scheduled_arrival AS latest_scheduled_arrival
    FROM routes r LEFT JOIN {LATEST_CALL} p ON p.route_id = r.id""",
)
CASCADE = f"""SELECT te1.shipment_id, s1.tracking_number, s1.route_id, count(te2.id) AS cascade_exception_count, min(te1.event_time) AS first_exception_time,
    max(te2.event_time) AS last_cascade_time
    FROM tracking_events te1 JOIN shipments s1 ON s1.id = te1.shipment_id
    JOIN shipments s2 ON s2.route_id = s1.route_id JOIN tracking_events te2 ON te2.shipment_id = s2.id AND te2.shipment_id <> te1.shipment_id AND te2.is_exception
      AND te2.event_time > te1.event_time AND te2.event_time <= te1.event_time + INTERVAL 48 HOUR
    WHERE te1.is_exception AND te1.event_time >= {AS_OF_EVENTS} - INTERVAL 30 DAY GROUP BY 1, 2, 3"""
sql("d8_later_exceptions_per_shipment", f"SELECT * EXCLUDE (tracking_number) FROM ({CASCADE})")
sql(
    "d9_events_around_calls",
    """SELECT pc.port_id, scheduled_arrival, count(te.id) AS n_events, count(te.id) FILTER (WHERE te.is_exception) AS n_exceptions
    FROM (SELECT DISTINCT port_id, scheduled_arrival FROM port_calls) pc LEFT JOIN tracking_events te ON te.port_id = pc.port_id
      AND te.event_time BETWEEN scheduled_arrival - INTERVAL 2 DAY AND scheduled_arrival + INTERVAL 2 DAY GROUP BY 1, 2""",
)
sql("d10_cargo_totals", "SELECT shipment_id, CAST(weight AS DOUBLE) AS total_gross_weight_kg, packages AS total_packages, lines AS cargo_rows FROM cargo_sum")
sql(
    "d13_cargo_pages",
    """SELECT shipment_id, (pos - 1) // 3 AS cargo_page, string_agg(id, ',' ORDER BY id) AS items
    FROM (SELECT shipment_id, id, row_number() OVER (PARTITION BY shipment_id ORDER BY id) AS pos FROM cargo) GROUP BY 1, 2""",
)

# quality

ROW_RULES = {
    "companies": {"company_type_valid": "company_type IN ('SHIPPER', 'CONSIGNEE', 'FF', 'CB', '3PL')", "country_code_iso2": "regexp_full_match(country_code, '[A-Z]{2}')"},
    "ports": {
        "latitude_range": "latitude BETWEEN -90 AND 90",
        "longitude_range": "longitude BETWEEN -180 AND 180",
        "country_code_iso2": "regexp_full_match(country_code, '[A-Z]{2}')",
    },
    "carriers": {"mode_valid": "mode IN ('SEA', 'AIR', 'RAIL', 'ROAD', 'MULTI')", "imo_number_format": "imo_number = '' OR regexp_full_match(imo_number, '[0-9]{7}')"},
    "routes": {
        "transit_days_min_positive": "transit_days_min > 0",
        "transit_days_max_gte_min": "transit_days_max >= transit_days_min",
        "weekly_frequency_range": "weekly_frequency BETWEEN 1 AND 21",
        "effective_dates_ordered": "effective_until > effective_from",
    },
    "shipments": {
        "status_valid": "status IN ('DRAFT', 'BOOKED', 'IN_TRANSIT', 'AT_PORT', 'CUSTOMS_HOLD', 'DELIVERED', 'CANCELLED', 'EXCEPTION')",
        "declared_value_non_negative": "declared_value >= 0",
        "freight_cost_non_negative": "freight_cost >= 0",
        "arrival_after_departure": "estimated_arrival > departure_date",
        "actual_arrival_after_departure": "actual_arrival >= departure_date",
        "currency_code_iso4217": "regexp_full_match(currency_code, '[A-Z]{3}')",
    },
    "cargo": {
        "gross_weight_positive": "gross_weight_kg > 0",
        "net_weight_positive": "net_weight_kg > 0",
        "net_weight_lte_gross": "net_weight_kg <= gross_weight_kg",
        "volume_positive": "volume_cbm > 0",
        "package_count_positive": "package_count > 0",
        "hazmat_requires_un_number": "NOT is_hazmat OR un_number <> ''",
        "temperature_range_ordered": "temperature_max_c >= temperature_min_c",
        "un_number_format": "un_number = '' OR regexp_full_match(un_number, '[0-9]{4}')",
    },
    "tracking_events": {
        "event_type_valid": "event_type IN ('DEPARTURE', 'ARRIVAL', 'CUSTOMS_CLEARED', 'CUSTOMS_HOLD', 'TRANSSHIPMENT', 'DELAY', 'EXCEPTION', 'DELIVERED', 'DOC_RECEIVED', 'VESSEL_CHANGE')",
        "resolved_requires_exception": "NOT exception_resolved OR is_exception",
    },
    "port_calls": {
        "call_sequence_positive": "call_sequence >= 1",
        "scheduled_departure_after_arrival": "scheduled_departure >= scheduled_arrival",
        "actual_departure_after_arrival": "actual_departure >= actual_arrival",
    },
}
sql(
    "e1_e2_row_violations",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", CAST(id AS VARCHAR) AS key, '{rule}' AS rule_name FROM {t} WHERE NOT ({ok})""" for t, rules in ROW_RULES.items() for rule, ok in rules.items()
    ),
)
UNIQUE = [
    ("companies", "tax_id_unique", "tax_id", "tax_id IS NOT NULL"),
    ("ports", "un_locode_unique", "un_locode", "true"),
    ("carriers", "carrier_code_unique", "carrier_code", "true"),
    ("routes", "route_code_unique", "route_code", "true"),
    ("routes", "active_lane_unique", "carrier_id || '|' || origin_port_id || '|' || destination_port_id", "status = 'ACTIVE'"),
    ("shipments", "tracking_number_unique", "tracking_number", "true"),
    ("shipments", "bill_of_lading_unique", "bill_of_lading", "bill_of_lading <> ''"),
    ("port_calls", "route_sequence_unique", "route_id || '|' || call_sequence", "true"),
]
sql(
    "e3_unique_violations",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", {key} AS key, '{rule}' AS rule_name FROM {t} WHERE {where} GROUP BY {key} HAVING count(*) > 1""" for t, rule, key, where in UNIQUE
    ),
)
REFERENCES = [
    ("carriers", "company_id", "companies"), ("routes", "carrier_id", "carriers"), ("routes", "origin_port_id", "ports"), ("routes", "destination_port_id", "ports"),
    ("shipments", "shipper_id", "companies"), ("shipments", "consignee_id", "companies"), ("shipments", "notify_party_id", "companies"),
    ("shipments", "carrier_id", "carriers"), ("shipments", "route_id", "routes"), ("shipments", "origin_port_id", "ports"), ("shipments", "destination_port_id", "ports"),
    ("cargo", "shipment_id", "shipments"), ("tracking_events", "shipment_id", "shipments"), ("tracking_events", "port_id", "ports"),
    ("tracking_events", "supersedes_id", "tracking_events"), ("port_calls", "route_id", "routes"), ("port_calls", "port_id", "ports"),
]
sql(
    "e3_reference_violations",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", CAST(t.id AS VARCHAR) AS key, '{c}_exists' AS rule_name FROM {t} t
        WHERE t.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.id = t.{c})"""
        for t, c, p in REFERENCES
    ),
)
ASKED = pick("id", "BOOKED", "IN_TRANSIT", "AT_PORT", "EXCEPTION", "DELIVERED", "IN_TRANSIT", "CUSTOMS_HOLD")
sql(
    "e4_illegal_moves",
    f"""SELECT shipment_id, id, changed_at, from_status, to_status, from_status IN ('DELIVERED', 'CANCELLED') AS terminal FROM (
      SELECT id, shipment_id, event_time AS changed_at, {ASKED} AS to_status, lag({ASKED}) OVER (PARTITION BY shipment_id ORDER BY event_time, id) AS from_status
      FROM tracking_events) WHERE from_status IS NOT NULL AND NOT {LEGAL.format(a='from_status', b='to_status')}""",
)
BOOKINGS = """
bookings AS (SELECT 'bk-' || (id // 2) AS idempotency_key, shipper_id, consignee_id,
    CASE WHEN id % 29 = 1 THEN -1 ELSE carrier_id END AS carrier_id, CASE WHEN id % 31 = 2 THEN -1 ELSE route_id END AS route_id,
    CASE WHEN id % 17 = 3 THEN origin_port_id + 1 ELSE origin_port_id END AS origin_port_id,
    CASE WHEN id % 19 = 4 THEN NULL ELSE destination_port_id END AS destination_port_id, departure_date,
    CASE WHEN id % 23 = 5 THEN departure_date ELSE estimated_arrival END AS estimated_arrival,
    CASE WHEN id % 41 = 6 THEN -declared_value ELSE declared_value END AS declared_value, freight_cost,
    CASE WHEN id % 13 = 7 THEN 'U5D' WHEN id % 13 = 8 THEN 'eur' ELSE currency_code END AS currency_code FROM shipments),
checked AS (SELECT b.* REPLACE (upper(b.currency_code) AS currency_code),
    CASE WHEN departure_date <= AS_OF THEN 'departure_in_past' WHEN declared_value < 0 THEN 'declared_value_negative' WHEN freight_cost < 0 THEN 'freight_cost_negative'
      WHEN NOT regexp_full_match(b.currency_code, '[A-Za-z]{3}') THEN 'currency_not_3_letters' WHEN c.id IS NULL THEN 'carrier_missing'
      WHEN NOT c.is_active THEN 'carrier_inactive' WHEN r.id IS NULL THEN 'route_missing' WHEN r.carrier_id <> b.carrier_id THEN 'route_of_other_carrier'
      WHEN r.status NOT IN ('ACTIVE', 'SEASONAL') THEN 'route_not_bookable' WHEN r.origin_port_id <> b.origin_port_id THEN 'origin_not_on_route'
      WHEN r.destination_port_id <> b.destination_port_id THEN 'destination_not_on_route'
      WHEN estimated_arrival <= departure_date THEN 'arrival_not_after_departure' END AS error
    FROM bookings b LEFT JOIN carriers c ON c.id = b.carrier_id LEFT JOIN routes r ON r.id = b.route_id)
""".replace("AS_OF", AS_OF)
sql("e5_checked_bookings", "SELECT error, currency_code, count(*) AS n, CAST(sum(shipper_id) AS BIGINT) AS shippers FROM checked GROUP BY 1, 2", BOOKINGS)
sql("e5_bookings_by_row", "SELECT idempotency_key, shipper_id, carrier_id, route_id, departure_date, CAST(declared_value AS DOUBLE) AS declared_value, currency_code, error FROM checked", BOOKINGS)
sql(
    "e6_checked_cargo",
    """SELECT id, CASE WHEN gross_weight_kg <= 0 THEN 'gross_weight_not_positive' WHEN un_number <> '' AND NOT regexp_full_match(un_number, '[0-9]{4}') THEN 'un_number_not_4_digits'
      WHEN net_weight_kg > gross_weight_kg THEN 'net_weight_above_gross' WHEN is_hazmat AND un_number = '' THEN 'hazmat_without_un_number'
      WHEN cargo_type = 'REEFER' AND temperature_min_c IS NULL THEN 'reefer_without_temperature' WHEN temperature_max_c < temperature_min_c THEN 'temperature_range_reversed' END AS error
    FROM cargo""",
)
ALLOWED = {
    "BOOKED": ["DOC_RECEIVED", "VESSEL_CHANGE"],
    "IN_TRANSIT": ["DEPARTURE", "ARRIVAL", "TRANSSHIPMENT", "DELAY", "EXCEPTION", "VESSEL_CHANGE", "DOC_RECEIVED"],
    "AT_PORT": ["ARRIVAL", "CUSTOMS_CLEARED", "CUSTOMS_HOLD", "EXCEPTION", "DOC_RECEIVED"],
    "CUSTOMS_HOLD": ["CUSTOMS_CLEARED", "EXCEPTION", "DOC_RECEIVED"],
    "EXCEPTION": ["DEPARTURE", "ARRIVAL", "EXCEPTION", "DOC_RECEIVED"],
}
IS_ALLOWED = " OR ".join(f"(s.status = '{s}' AND event_type IN ({', '.join(repr(t) for t in types)}))" for s, types in ALLOWED.items())
sql(
    "e7_checked_events",
    f"""SELECT e.id, CASE WHEN is_exception AND e.id % 4 < 3 THEN '[EXCEPTION] crane broke' || CASE WHEN e.id % 2 = 0 THEN chr(10) || 'at berth' ELSE '' END
        WHEN e.id % 2 = 0 THEN 'at berth' ELSE '' END AS description,
      CASE WHEN s.id IS NULL THEN 'shipment_missing' WHEN s.status IN ('DELIVERED', 'CANCELLED') THEN 'shipment_closed'
        WHEN event_time > TIMESTAMP '2024-01-20' THEN 'event_in_future' WHEN NOT ({IS_ALLOWED}) THEN 'event_type_not_allowed'
        WHEN is_exception AND e.id % 4 = 3 THEN 'exception_without_description' END AS error
    FROM tracking_events e LEFT JOIN shipments s ON s.id = e.shipment_id""",
)
sql(
    "e8_e9_message_outcomes",
    """SELECT CASE WHEN e.id % 19 = 0 OR NOT c.is_active THEN 'unknown_carrier' WHEN e.id % 17 = 0 THEN 'bad_signature' WHEN e.id % 13 = 0 THEN 'malformed' END AS reason,
      count(*) AS n, min(event_time) AS first_at, max(event_time) AS last_at
    FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id JOIN carriers c ON c.id = s.carrier_id GROUP BY 1""",
)

sql(
    "e8_messages_by_row",
    """SELECT CASE WHEN e.id % 19 = 0 THEN 'NOBODY' ELSE c.carrier_code END AS carrier_code, event_time AS received_at,
      CASE WHEN NOT (e.id % 19 = 0 OR NOT c.is_active OR e.id % 17 = 0 OR e.id % 13 = 0) THEN 'm' || (e.id // 2) END AS webhook_id,
      CASE WHEN e.id % 19 = 0 OR NOT c.is_active THEN 'unknown_carrier' WHEN e.id % 17 = 0 THEN 'bad_signature' WHEN e.id % 13 = 0 THEN 'malformed' END AS reason
    FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id JOIN carriers c ON c.id = s.carrier_id""",
)

# derived columns

sql("f1_transit_duration", f"SELECT id, CAST(date_diff('second', departure_date, coalesce(actual_arrival, {AS_OF})) AS BIGINT) AS transit_seconds FROM shipments")
sql("f2_delay_flag", f"SELECT id, CASE WHEN {LATE} THEN 1 ELSE 0 END AS is_delayed FROM shipments")
sql(
    "f3_value_tier",
    "SELECT id, CASE WHEN declared_value >= 500000 THEN 'platinum' WHEN declared_value >= 100000 THEN 'gold' WHEN declared_value >= 10000 THEN 'silver' ELSE 'standard' END AS value_tier FROM shipments",
)
sql(
    "f5_cargo_summary",
    "SELECT s.id, CAST(coalesce(weight, 0) AS DOUBLE) AS total_gross_weight_kg, coalesce(packages, 0) AS total_packages FROM shipments s LEFT JOIN cargo_sum c ON c.shipment_id = s.id",
)
sql("f6_hours_overdue", f"SELECT id, CAST(epoch({AS_OF} - estimated_arrival) // 3600 AS BIGINT) AS hours_overdue FROM shipments WHERE {LATE}")
sql("f7_tracking_numbers", "SELECT id, 'GT-' || upper(substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS tracking_number FROM shipments")
sql("f8_event_for_status", f"SELECT status, {EVENT_OF.format(s='status')} AS event_type, count(*) AS n FROM shipments GROUP BY 1, 2")
sql("f9_month_bounds", "SELECT id, CAST(date_trunc('month', departure_date) AS DATE) AS month_start, last_day(departure_date) AS month_end FROM shipments")

# windows

sql("g1_running_total_value", "SELECT id, CAST(sum(coalesce(declared_value, 0)) OVER (ORDER BY departure_date) AS DOUBLE) AS running_total_value FROM shipments")
sql(
    "g2_carrier_rank_by_volume",
    """SELECT id, carrier_shipment_count, dense_rank() OVER (ORDER BY carrier_shipment_count DESC) AS carrier_volume_rank
    FROM (SELECT id, count(*) OVER (PARTITION BY carrier_id) AS carrier_shipment_count FROM shipments)""",
)
sql("g3_row_number_by_carrier", "SELECT id, row_number() OVER (PARTITION BY carrier_id ORDER BY departure_date, id) AS carrier_row_num FROM shipments")
sql(
    "g3_first_two_per_carrier",
    "SELECT * FROM (SELECT id, carrier_id, row_number() OVER (PARTITION BY carrier_id ORDER BY departure_date, id) AS carrier_row_num FROM shipments) WHERE carrier_row_num <= 2",
)
sql("g4_lag_arrival", "SELECT id, lag(actual_arrival) OVER (PARTITION BY carrier_id ORDER BY departure_date, id) AS prev_arrival FROM shipments")
sql(
    "g5_percentile_rank_by_weight",
    "SELECT s.id, percent_rank() OVER (ORDER BY coalesce(weight, 0)) AS weight_percentile_rank FROM shipments s LEFT JOIN cargo_sum c ON c.shipment_id = s.id",
)
sql("g6_quartile_by_value", "SELECT id, ntile(4) OVER (ORDER BY declared_value ASC NULLS LAST, id) AS value_quartile FROM shipments")
G7 = "SELECT id, {ratio} AS moving_avg_value FROM (SELECT id, sum(coalesce(declared_value, 0)) OVER w AS v, count(*) OVER w AS n FROM shipments WINDOW w AS (ORDER BY departure_date {frame}))"
sql("g7_moving_avg_value", G7.format(ratio=exact(money("v") + " * 10000", "n", 6), frame=""))
sql("g7_moving_avg_value_30_days", G7.format(ratio=exact(money("v") + " * 10000", "n", 6), frame="RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW"))

# reports

PERFORMANCE = f"""SELECT s.carrier_id, carrier_name, count(s.id) AS shipment_count, CAST(count(*) FILTER (WHERE late) // count(s.id) * 100 AS DOUBLE) AS delay_rate_pct,
    coalesce({exact(money('sum(declared_value)'), 'count(declared_value)', 2)}, 0) AS avg_declared_value,
    CAST(coalesce(sum(gross_weight_kg), 0) AS DOUBLE) AS total_gross_weight_kg
    FROM (SELECT *, {LATE} AS late FROM shipments) s JOIN carriers c ON c.id = s.carrier_id LEFT JOIN cargo g ON g.shipment_id = s.id GROUP BY 1, 2"""
CORRECTED = f"""SELECT s.carrier_id, carrier_name, count(s.id) AS shipment_count, {exact('count(*) FILTER (WHERE late) * 10000', 'count(s.id)', 2)} AS delay_rate_pct,
    coalesce({exact(money('sum(declared_value)'), 'count(declared_value)', 2)}, 0) AS avg_declared_value,
    CAST(coalesce(sum(weight), 0) AS DOUBLE) AS total_gross_weight_kg
    FROM (SELECT *, {LATE} AS late FROM shipments) s JOIN carriers c ON c.id = s.carrier_id LEFT JOIN cargo_sum g ON g.shipment_id = s.id GROUP BY 1, 2"""
sql("h1_carrier_performance", PERFORMANCE)
sql("h1_carrier_performance_corrected", CORRECTED)
TREND = """SELECT CAST(date_trunc('month', departure_date) AS DATE) AS month, count(*) AS shipment_count, CAST(coalesce(sum(declared_value), 0) AS DOUBLE) AS total_declared_value
    FROM shipments WHERE departure_date IS NOT NULL {more} GROUP BY 1 ORDER BY 1"""
sql("h2_monthly_volume_trend", TREND.format(more=""))
sql("h2_recent_volume_trend", TREND.format(more=f"AND departure_date >= {AS_OF} - INTERVAL 360 DAY"))
UTILIZATION = """SELECT s.route_id, route_code, count(*) AS shipment_count, CAST(count(*) FILTER (WHERE {late}) AS BIGINT) AS delay_count,
    coalesce({avg}, 0) AS avg_transit_seconds FROM shipments s JOIN routes r ON r.id = s.route_id WHERE {where} GROUP BY 1, 2"""
AVG_TRANSIT = exact("sum(date_diff('microsecond', departure_date, actual_arrival))", "count(actual_arrival)", 6)
LATE_S = LATE.replace("status", "s.status")
sql("h3_route_utilization", UTILIZATION.format(late=LATE_S, avg=AVG_TRANSIT, where="true"))
sql(
    "h9_top_routes",
    UTILIZATION.format(late=LATE_S.replace(AS_OF, AS_OF_LAST), avg=AVG_TRANSIT, where=f"departure_date >= {AS_OF_LAST} - INTERVAL 90 DAY") + " ORDER BY shipment_count DESC, route_id LIMIT 10",
)
sql(
    "h4_exception_rate_by_carrier",
    f"""SELECT s.carrier_id, carrier_name, count(*) AS total_events, count(*) FILTER (WHERE is_exception) AS exception_count,
    {exact('count(*) FILTER (WHERE is_exception) * 10000', 'count(*)', 2)} AS exception_rate_pct
    FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id JOIN carriers c ON c.id = s.carrier_id GROUP BY 1, 2""",
)
sql(
    "h5_on_time_rate",
    f"SELECT carrier_id, {exact(chr(99) + 'ount(*) FILTER (WHERE actual_arrival <= estimated_arrival AND status = ' + repr('DELIVERED') + ') * 10000', 'count(*)', 2)} AS on_time_rate FROM shipments GROUP BY 1",
)
sql("h6_carriers_with_counts", "SELECT c.id, count(DISTINCT s.id) AS shipment_count FROM carriers c LEFT JOIN shipments s ON s.carrier_id = c.id GROUP BY 1")
sql("h7_ports_with_counts", "SELECT p.id, count(DISTINCT pc.id) AS port_call_count FROM ports p LEFT JOIN port_calls pc ON pc.port_id = p.id GROUP BY 1")
sql(
    "h8_dashboard_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('BOOKED', 'IN_TRANSIT', 'AT_PORT')) AS active, count(*) FILTER (WHERE {LATE}) AS delayed,
    CAST(coalesce(sum(declared_value), 0) AS DOUBLE) AS total_declared_value FROM shipments""",
)
RANKED = "SELECT *, row_number() OVER (ORDER BY shipment_count DESC, carrier_id) AS volume_rank FROM ({report})"
sql("h10_carrier_leaderboard", RANKED.format(report=PERFORMANCE))
sql("b6_report_types", RANKED.format(report=PERFORMANCE))
sql("h10_carrier_leaderboard_corrected", RANKED.format(report=CORRECTED))
BY_CARRIER = """SELECT c.id, legal_name AS company_legal_name, count(DISTINCT s.id) AS shipment_count FROM carriers c JOIN companies k ON k.id = c.company_id
    LEFT JOIN shipments s ON s.carrier_id = c.id WHERE c.is_active AND {where} GROUP BY 1, 2"""
sql("h11_active_by_mode", BY_CARRIER.format(where="mode = 'SEA'"))
sql("h12_hub_coverage", BY_CARRIER.format(where="list_contains(hub_ports, 'APN15')"))
PERCENTILES = """SELECT carrier_id, nullif(quantile_cont(d, 0.5), 0) AS median_days, nullif(quantile_cont(d, 0.95), 0) AS p95_days, count(*) AS sample_size
    FROM (SELECT carrier_id, date_diff('microsecond', departure_date, actual_arrival) / 86400000000.0 AS d FROM shipments
      WHERE status = 'DELIVERED' AND actual_arrival IS NOT NULL AND departure_date IS NOT NULL {more}) GROUP BY 1"""
sql("h13_transit_percentiles", PERCENTILES.format(more=""))
sql("h13_transit_percentiles_one_carrier", PERCENTILES.format(more="AND carrier_id = 7"))
sql("h13_transit_percentiles_corrected", PERCENTILES.format(more="").replace("nullif(quantile_cont(d, 0.5), 0)", "quantile_cont(d, 0.5)").replace("nullif(quantile_cont(d, 0.95), 0)", "quantile_cont(d, 0.95)"))
sql(
    "h2_recent_trend_corrected",
    f"""SELECT CAST(date_trunc('month', departure_date) AS DATE) AS month, count(*) AS shipment_count, CAST(coalesce(sum(declared_value), 0) AS DOUBLE) AS total_declared_value
    FROM shipments WHERE departure_date >= date_trunc('month', {AS_OF}) - INTERVAL 6 MONTH GROUP BY 1 ORDER BY 1""",
)
sql("c14_departed_through", "SELECT id, departure_date FROM shipments WHERE departure_date >= TIMESTAMP '1997-01-01' AND departure_date < TIMESTAMP '1997-04-01'")
sql(
    "h13_percentiles_from_sketches",
    """SELECT carrier_id, count(*) AS sample_size, true AS median_near, true AS p95_near, true AS customers_near FROM shipments
    WHERE status = 'DELIVERED' AND departure_date IS NOT NULL AND year(actual_arrival) = 1996 GROUP BY 1""",
)
sql(
    "h13_percentiles_of_two_carriers",
    f"""SELECT carrier_id, median_days, p95_days, coalesce(sample_size, 0) AS sample_size FROM (SELECT unnest([7, -1])::BIGINT AS carrier_id)
    LEFT JOIN ({PERCENTILES.format(more="")}) USING (carrier_id)""",
)
sql(
    "h14_top_lanes",
    f"""SELECT s.route_id, route_code, count(s.id) AS shipment_count, CAST(sum(declared_value) AS DOUBLE) AS total_value, CAST(p.arrival_delay_hours AS DOUBLE) AS latest_delay_hours,
    p.scheduled_arrival AS latest_scheduled_arrival FROM shipments s JOIN routes r ON r.id = s.route_id LEFT JOIN {LATEST_CALL} p ON p.route_id = s.route_id
    WHERE departure_date >= {AS_OF_LAST} - INTERVAL 90 DAY GROUP BY s.route_id, route_code, p.arrival_delay_hours, p.scheduled_arrival ORDER BY shipment_count DESC, s.route_id LIMIT 10""",
)
sql("h15_exception_cascades", f"SELECT * FROM ({CASCADE}) WHERE cascade_exception_count >= 2 ORDER BY cascade_exception_count DESC, shipment_id LIMIT 100")
DAILY = f"""SELECT s.carrier_id, CAST(departure_date AS DATE) AS stat_date, count(s.id) AS shipment_count, count(s.id) FILTER (WHERE {LATE}) AS delay_count,
    {exact(money('sum(declared_value)') + ' * 10000', 'count(declared_value)', 6)} AS avg_declared_value, CAST(coalesce(sum(c.weight), 0) AS DOUBLE) AS total_weight_kg,
    count(te.id) FILTER (WHERE te.is_exception) AS exception_count
    FROM shipments s LEFT JOIN cargo_sum c ON c.shipment_id = s.id LEFT JOIN tracking_events te ON te.shipment_id = s.id WHERE departure_date IS NOT NULL GROUP BY 1, 2"""
sql(
    "h16_read_carrier_stats",
    f"""SELECT carrier_id, stat_date, shipment_count, delay_count, {rounded('avg_declared_value', 2)} AS avg_declared_value, round(total_weight_kg, 3) AS total_weight_kg, exception_count,
    {exact('delay_count * 10000', 'shipment_count', 2)} AS delay_rate_pct FROM ({DAILY}) WHERE carrier_id = 7 AND stat_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY stat_date""",
)
CONGESTION = f"""SELECT pc.port_id, CAST(date_trunc('week', scheduled_arrival) AS DATE) AS stat_week, count(pc.id) AS arrival_count,
    {exact(money('sum(arrival_delay_hours)') + ' * 10000', 'count(arrival_delay_hours)', 6)} AS avg_delay_hours,
    {exact('count(te.id) FILTER (WHERE te.is_exception) * 100000000', 'count(te.id)', 6)} AS exception_rate_pct
    FROM port_calls pc LEFT JOIN tracking_events te ON te.port_id = pc.port_id
      AND te.event_time BETWEEN scheduled_arrival - INTERVAL 2 DAY AND scheduled_arrival + INTERVAL 2 DAY WHERE scheduled_arrival IS NOT NULL GROUP BY 1, 2"""
READ_CONGESTION = f"""SELECT port_id, stat_week, arrival_count, {rounded('avg_delay_hours', 2)} AS avg_delay_hours, {rounded('exception_rate_pct', 2)} AS exception_rate_pct
    FROM ({CONGESTION}) WHERE stat_week >= date_trunc('week', {AS_OF_EVENTS} - INTERVAL 28 DAY)"""
sql("h17_read_port_congestion", f"{READ_CONGESTION} ORDER BY avg_delay_hours DESC NULLS LAST, port_id, stat_week LIMIT 20")
sql("h17_read_port_congestion_one_port", f"{READ_CONGESTION} AND port_id = 8 ORDER BY stat_week DESC")

# materialized views

sql("i1_carrier_daily_stats", DAILY)
sql(
    "i1_carrier_daily_stats_corrected",
    f"""SELECT s.carrier_id, CAST(departure_date AS DATE) AS stat_date, count(*) AS shipment_count, count(*) FILTER (WHERE {LATE}) AS delay_count,
    {exact(money('sum(declared_value)') + ' * 10000', 'count(declared_value)', 6)} AS avg_declared_value, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS total_weight_kg,
    CAST(coalesce(sum(bad), 0) AS BIGINT) AS exception_count FROM shipments s LEFT JOIN cargo_sum c ON c.shipment_id = s.id LEFT JOIN event_sum e ON e.shipment_id = s.id GROUP BY 1, 2""",
)
sql(
    "i1_carrier_stats_after_changes",
    DAILY.replace("shipments", "changed"),
    """changed AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END * declared_value AS declared_value,
      departure_date + CASE WHEN id % 10 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS departure_date) FROM shipments WHERE id % 15 <> 0)""",
)
sql(
    "i2_route_monthly_performance",
    f"""SELECT route_id, CAST(date_trunc('month', departure_date) AS DATE) AS stat_month, count(*) AS shipment_count,
    {exact("sum(date_diff('microsecond', departure_date, actual_arrival))", "count(actual_arrival) * 86400", 6)} AS avg_transit_days,
    {exact("count(*) FILTER (WHERE actual_arrival <= estimated_arrival AND status = 'DELIVERED') * 100000000", "count(*) FILTER (WHERE status = 'DELIVERED')", 6)} AS on_time_rate_pct,
    CAST(coalesce(sum(declared_value), 0) AS DOUBLE) AS total_declared_value FROM shipments WHERE departure_date IS NOT NULL GROUP BY 1, 2""",
)
sql("i3_port_congestion", CONGESTION)
sql(
    "i3_port_congestion_corrected",
    f"""SELECT port_id, stat_week, count(*) AS arrival_count, {exact(money('sum(delay)') + ' * 10000', 'count(delay)', 6)} AS avg_delay_hours,
    {exact('sum(bad) * 100000000', 'sum(n)', 6)} AS exception_rate_pct FROM (
      SELECT pc.id, pc.port_id, CAST(date_trunc('week', scheduled_arrival) AS DATE) AS stat_week, any_value(arrival_delay_hours) AS delay, count(te.id) AS n,
        count(te.id) FILTER (WHERE te.is_exception) AS bad
      FROM port_calls pc LEFT JOIN tracking_events te ON te.port_id = pc.port_id
        AND te.event_time BETWEEN scheduled_arrival - INTERVAL 2 DAY AND scheduled_arrival + INTERVAL 2 DAY GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)

# snapshots and jobs

sql("j1_carrier_snapshots", carrier_rows(AS_OF))
sql(
    "j2_route_snapshots",
    """SELECT 'ROUTE' AS entity_type, CAST(route_id AS VARCHAR) AS entity_id, DATE '1998-05-01' AS snapshot_date, 'MONTHLY' AS granularity, 'shipments.count' AS metric_key,
    CAST(count(*) AS DOUBLE) AS metric_value, '{}' AS dimensions FROM shipments
    WHERE CAST(departure_date AS DATE) BETWEEN DATE '1998-05-01' AND DATE '1998-05-31' AND route_id IN (SELECT id FROM routes WHERE status = 'ACTIVE') GROUP BY route_id""",
)
sql("j3_global_snapshots", global_rows(AS_OF))


def hashed(*parts: str) -> str:
    digest = "md5(" + " || '|' || ".join(parts) + ")"
    return " || '-' || ".join(f"substr({digest}, {start}, {length})" for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


HOURS = f"CAST(epoch({AS_OF} - estimated_arrival) // 3600 AS BIGINT)"
sql(
    "j4_delay_events",
    f"""SELECT {hashed("'delay'", 'CAST(id AS VARCHAR)', "'1998-06-01'")} AS id, id AS shipment_id, 'DELAY' AS event_type, {AS_OF} AS event_time, {AS_OF} AS recorded_at,
    '' AS location_description, 'Shipment is ' || {HOURS} || 'h past estimated arrival. ETA was ' || strftime(estimated_arrival, '%Y-%m-%d %H:%M') || ' UTC.' AS description,
    false AS is_exception, false AS exception_resolved, 'CELERY:delay_notifications' AS source_system,
    '{{"hours_overdue":' || {HOURS} || ',"threshold_hours":2,"eta":"' || strftime(estimated_arrival, '%Y-%m-%dT%H:%M:%S') || '+00:00","detected_at":"1998-06-01T00:00:00+00:00"}}' AS raw_payload
    FROM shipments WHERE {OVERDUE.format(at=AS_OF)} AND NOT {TOLD.format(at=AS_OF)}""",
)
NOON = "TIMESTAMP '2024-01-12 12:00:00'"
sql(
    "j4_delay_counts",
    f"SELECT count(*) FILTER (WHERE NOT {TOLD.format(at=NOON)}) AS notified, count(*) FILTER (WHERE {TOLD.format(at=NOON)}) AS skipped FROM shipments WHERE {OVERDUE.format(at=NOON)}",
)
sql(
    "j5_match_messages",
    """SELECT m.webhook_id, m.carrier_code, m.shipment_reference, CASE WHEN c.id IS NULL THEN NULL ELSE s.id END AS shipment_id,
    CASE WHEN m.webhook_id IN (SELECT json_extract_string(raw_payload, '$.webhook_id') FROM tracking_events) THEN 'already_processed' WHEN c.id IS NULL THEN 'carrier_not_found'
      WHEN s.id IS NOT NULL THEN 'matched' WHEN TIMESTAMP '2024-01-20' - received_at > INTERVAL 24 HOUR THEN 'expired' ELSE 'retry' END AS status
    FROM batch m LEFT JOIN carriers c ON c.carrier_code = m.carrier_code AND c.is_active LEFT JOIN shipments s ON s.tracking_number = m.shipment_reference AND s.carrier_id = c.id""",
    """messages AS (SELECT 'w' || CASE WHEN e.id % 5 = 0 THEN e.id ELSE e.id // 2 + 1000000000000 END AS webhook_id, CASE WHEN e.id % 19 = 0 THEN 'NOBODY' ELSE c.carrier_code END AS carrier_code,
      CASE WHEN e.id % 11 = 0 THEN 'LOST-' || e.id ELSE tracking_number END AS shipment_reference, event_time AS received_at
      FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id JOIN carriers c ON c.id = s.carrier_id),
    batch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY webhook_id ORDER BY received_at, carrier_code, shipment_reference) AS rn FROM messages) WHERE rn = 1)""",
)
STEP = f"CASE WHEN {LEGAL.format(a='w.state', b='c.new_status')} THEN c.new_status ELSE w.state END"
REPLAY = f"""changes AS (SELECT id, shipment_id, event_time AS changed_at, {ASKED} AS new_status, row_number() OVER (PARTITION BY shipment_id ORDER BY event_time, id) AS pos
    FROM tracking_events),
walk AS (SELECT s.id AS shipment_id, CAST(0 AS BIGINT) AS pos, s.status AS met, s.status AS state FROM shipments s WHERE s.id IN (SELECT shipment_id FROM tracking_events)
    UNION ALL SELECT w.shipment_id, c.pos, w.state, {STEP} FROM walk w JOIN changes c ON c.shipment_id = w.shipment_id AND c.pos = w.pos + 1),
resolved AS (SELECT c.id, c.shipment_id, c.changed_at, c.pos, w.met AS old_status, c.new_status,
    CASE WHEN w.met IS NULL THEN 'shipment_missing' WHEN w.met = c.new_status THEN 'unchanged' WHEN w.state = c.new_status THEN 'applied' ELSE 'rejected' END AS outcome
    FROM changes c LEFT JOIN walk w ON w.shipment_id = c.shipment_id AND w.pos = c.pos)"""
sql("j6_resolved_changes", "SELECT id, shipment_id, old_status, new_status, outcome FROM resolved", REPLAY)
sql(
    "j6_next_shipments",
    """SELECT s.id, coalesce(a.status, s.status) AS status, coalesce(a.arrived, actual_arrival) AS actual_arrival, coalesce(a.updated, updated_at) AS updated_at FROM shipments s
    LEFT JOIN (SELECT shipment_id, arg_max(new_status, pos) AS status, max(changed_at) FILTER (WHERE new_status = 'DELIVERED') AS arrived, max(changed_at) AS updated
      FROM resolved WHERE outcome = 'applied' GROUP BY 1) a ON a.shipment_id = s.id""",
    REPLAY,
)
sql(
    "j6_change_events",
    f"""SELECT shipment_id, {EVENT_OF.format(s='new_status')} AS event_type, changed_at AS event_time, changed_at AS recorded_at, '' AS location_description,
    CASE WHEN id % 9 = 0 THEN 'by phone' ELSE 'Status changed from ' || old_status || ' to ' || new_status || '.' END AS description, new_status = 'EXCEPTION' AS is_exception,
    false AS exception_resolved, 'API' AS source_system, '{{}}' AS raw_payload FROM resolved WHERE outcome = 'applied'""",
    REPLAY,
)
ACCEPTED = (
    BOOKINGS
    + """, accepted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY departure_date, shipper_id, consignee_id, route_id) AS rn
    FROM checked WHERE error IS NULL) WHERE rn = 1)"""
)
sql(
    "j7_accepted_bookings",
    """SELECT shipper_id, route_id, 'GT-' || upper(substr(sha256(idempotency_key), 1, 8)) AS tracking_number, 'DRAFT' AS status, departure_date,
    CAST(declared_value AS DOUBLE) AS declared_value, currency_code, '{"idempotency_key":"' || idempotency_key || '"}' AS custom_attributes FROM accepted""",
    ACCEPTED,
)
sql(
    "j7_booking_events",
    f"SELECT 'DOC_RECEIVED' AS event_type, 'Shipment booking created via API.' AS description, {AS_OF} AS event_time, count(*) AS n FROM accepted HAVING count(*) > 0",
    ACCEPTED,
)
sql("j8_current_events", "SELECT id, event_type FROM tracking_events WHERE id NOT IN (SELECT supersedes_id FROM tracking_events WHERE supersedes_id IS NOT NULL)")

sql(
    "j8_correction_chains",
    """SELECT e.id, fact_id, depth, NOT EXISTS (SELECT 1 FROM links c WHERE c.up = e.id) AS is_latest,
    EXISTS (SELECT 1 FROM walked f JOIN links c ON c.up = f.id WHERE f.fact_id = e.fact_id GROUP BY f.id HAVING count(*) > 1) AS is_forked, false AS in_cycle FROM walked e""",
    """named AS (SELECT id, CASE WHEN id % 8 > 0 THEN id - CASE WHEN id % 24 = 5 THEN 2 ELSE 1 END END AS up FROM tracking_events),
    links AS (SELECT l.id, l.up FROM named l JOIN tracking_events t ON t.id = l.up),
    walked AS (
      SELECT id, id AS fact_id, 0::BIGINT AS depth FROM tracking_events WHERE id NOT IN (SELECT id FROM links)
      UNION ALL SELECT l.id, w.fact_id, w.depth + 1 FROM walked w JOIN links l ON l.up = w.id)""",
)

# streaming operators in batch form, and pages

sql(
    "k2_exception_windows_by_port",
    """SELECT port_id, date_trunc('day', event_time) AS window_start, date_trunc('day', event_time) + INTERVAL 1 DAY AS window_end, count(*) AS total_events,
    count(*) FILTER (WHERE is_exception) AS exception_count FROM tracking_events GROUP BY ALL""",
)
sql(
    "k2_exception_windows_by_carrier",
    """SELECT carrier_id, CAST(date_trunc('week', event_time) AS TIMESTAMP) AS window_start, CAST(date_trunc('week', event_time) AS TIMESTAMP) + INTERVAL 7 DAY AS window_end,
    count(*) AS total_events, count(*) FILTER (WHERE is_exception) AS exception_count
    FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id GROUP BY 1, 2, 3""",
)
for _name in ("k1_ingested_events", "k1_two_batches"):
    sql(
        _name,
        f"""SELECT s.id AS shipment_id, 'DOC_RECEIVED' AS event_type, sent_at AS event_time, {AS_OF_EVENTS} AS recorded_at, 'Carrier webhook: ' || kind AS description,
    'WEBHOOK:' || m.carrier_code AS source_system FROM kept m JOIN shipments s ON s.tracking_number = m.reference AND s.carrier_id = m.carrier_id WHERE rn = 1""",
        """kept AS (SELECT *, row_number() OVER (PARTITION BY webhook_id ORDER BY sent_at, carrier_code, reference) AS rn FROM (
      SELECT 'm' || (e.id // 2) AS webhook_id, c.carrier_code, c.id AS carrier_id, CASE WHEN e.id % 11 = 0 THEN 'LOST-' || e.id ELSE tracking_number END AS reference,
        e.event_type AS kind, e.event_time AS sent_at
      FROM tracking_events e JOIN shipments s ON s.id = e.shipment_id JOIN carriers c ON c.id = s.carrier_id
      WHERE c.is_active AND e.id % 19 <> 0 AND e.id % 17 <> 0 AND e.id % 13 <> 0))""",
    )
sql("k1_keyed_events", "SELECT * EXCLUDE (recorded_at) FROM (" + _SQL["k1_ingested_events"].removeprefix(BASE).split("))", 1)[1] + ")", _SQL["k1_ingested_events"].removeprefix(BASE).removeprefix(", ").rsplit("))", 1)[0] + "))")
sql("k3_merged_cascades", "SELECT * EXCLUDE (tracking_number) FROM (" + CASCADE.replace(f" AND te1.event_time >= {AS_OF_EVENTS} - INTERVAL 30 DAY", "") + ")")
sql(
    "k4_late_events",
    """SELECT id, CAST(date_diff('second', event_time, recorded_at) AS BIGINT) AS lag_seconds, CASE WHEN recorded_at > event_time + INTERVAL 24 HOUR THEN 'late' ELSE 'in time' END AS kind
    FROM tracking_events""",
)
sql("l4_first_page", "SELECT id, carrier_id, departure_date FROM shipments ORDER BY departure_date DESC NULLS FIRST, id LIMIT 50")
sql(
    "l4_next_page",
    """SELECT id, carrier_id, departure_date FROM shipments WHERE departure_date < TIMESTAMP '1999-01-01' OR (departure_date = TIMESTAMP '1999-01-01' AND id > 5000)
    ORDER BY departure_date DESC NULLS FIRST, id LIMIT 200""",
)
for _name, _body in list(_SQL.items()):
    if "walk AS (" in _body or "walked AS (" in _body:
        _SQL[_name] = _body.replace("WITH ports", "WITH RECURSIVE ports", 1)
