"""Schemas of the nine tables, as DDL text. Money and weights are decimals, instants are UTC timestamps."""

from __future__ import annotations

_STAMPS = "created_at timestamp, updated_at timestamp"

_DDL = {
    "companies": "id string, legal_name string, trade_name string, company_type string, tax_id string, duns_number string, "
    "country_code string, is_active boolean, metadata string",
    "ports": "id string, un_locode string, iata_code string, port_name string, country_code string, port_type string, "
    "latitude decimal(9,6), longitude decimal(9,6), timezone string, is_active boolean",
    "carriers": "id string, company_id string, carrier_code string, carrier_name string, mode string, imo_number string, "
    "is_active boolean, hub_ports array<string>, service_metadata string",
    "routes": "id string, carrier_id string, origin_port_id string, destination_port_id string, route_code string, status string, "
    "transit_days_min short, transit_days_max short, transshipment_ports array<string>, weekly_frequency short, "
    "effective_from date, effective_until date",
    "shipments": "id string, shipper_id string, consignee_id string, notify_party_id string, carrier_id string, route_id string, "
    "origin_port_id string, destination_port_id string, tracking_number string, bill_of_lading string, "
    "house_bill_of_lading string, purchase_order_refs array<string>, status string, booking_date date, "
    "departure_date timestamp, estimated_arrival timestamp, actual_arrival timestamp, declared_value decimal(18,2), "
    "freight_cost decimal(14,2), currency_code string, incoterms string, hs_codes array<string>, tags array<string>, "
    "custom_attributes string, notes string",
    "cargo": "id string, shipment_id string, cargo_type string, description string, container_number string, seal_number string, "
    "gross_weight_kg decimal(12,3), net_weight_kg decimal(12,3), volume_cbm decimal(10,4), package_count int, "
    "package_type string, is_hazmat boolean, un_number string, imdg_class string, temperature_min_c decimal(5,2), "
    "temperature_max_c decimal(5,2), custom_attributes string",
    "tracking_events": "id string, shipment_id string, port_id string, supersedes_id string, event_type string, "
    "event_time timestamp, recorded_at timestamp, location_description string, description string, is_exception boolean, "
    "exception_resolved boolean, source_system string, raw_payload string",
    "port_calls": "id string, route_id string, port_id string, call_sequence short, vessel_name string, voyage_number string, "
    "scheduled_arrival timestamp, actual_arrival timestamp, scheduled_departure timestamp, actual_departure timestamp, "
    "arrival_delay_hours decimal(7,2)",
    "analytics_snapshots": "id string, entity_type string, entity_id string, snapshot_date date, granularity string, "
    "metric_key string, metric_value decimal(20,6), dimensions string",
}

TABLES: dict[str, str] = {name: f"{ddl}, {_STAMPS}" for name, ddl in _DDL.items()}

# table -> (column, ascending) pairs of its default listing order; cargo has none
DEFAULT_ORDER: dict[str, list[tuple[str, bool]]] = {
    "companies": [("legal_name", True)],
    "ports": [("port_name", True)],
    "carriers": [("carrier_name", True)],
    "routes": [("carrier_id", True), ("route_code", True)],
    "shipments": [("created_at", False)],
    "cargo": [],
    "tracking_events": [("shipment_id", True), ("event_time", False)],
    "port_calls": [("route_id", True), ("call_sequence", True)],
    "analytics_snapshots": [("snapshot_date", False)],
}

MESSAGE = "carrier_code string, raw_body binary, signature string, received_at timestamp"

ENVELOPE = (
    "webhook_id string, event_type string, shipment_reference string, event_timestamp timestamp, payload map<string,string>"
)

BOOKING = (
    "idempotency_key string, shipper_id string, consignee_id string, notify_party_id string, carrier_id string, route_id string, "
    "origin_port_id string, destination_port_id string, departure_date timestamp, estimated_arrival timestamp, "
    "declared_value decimal(18,2), freight_cost decimal(14,2), currency_code string, incoterms string, "
    "purchase_order_refs array<string>, hs_codes array<string>, tags array<string>, notes string"
)
