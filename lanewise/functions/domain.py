"""Fixed values of the freight domain: codes, labels and the status machine.

These must equal the values other systems already store, so they are listed plainly.
"""

from __future__ import annotations

COMPANY_TYPES = {
    "SHIPPER": "Shipper",
    "CONSIGNEE": "Consignee",
    "FF": "Freight Forwarder",
    "CB": "Customs Broker",
    "3PL": "3PL Provider",
}

CARRIER_MODES = {
    "SEA": "Sea Freight",
    "AIR": "Air Freight",
    "RAIL": "Rail Freight",
    "ROAD": "Road Freight",
    "MULTI": "Multimodal",
}

SHIPMENT_STATUSES = {
    "DRAFT": "Draft",
    "BOOKED": "Booked",
    "IN_TRANSIT": "In Transit",
    "AT_PORT": "At Port",
    "CUSTOMS_HOLD": "Customs Hold",
    "DELIVERED": "Delivered",
    "CANCELLED": "Cancelled",
    "EXCEPTION": "Exception",
}

EVENT_TYPES = {
    "DEPARTURE": "Departure",
    "ARRIVAL": "Arrival",
    "CUSTOMS_CLEARED": "Customs Cleared",
    "CUSTOMS_HOLD": "Customs Hold",
    "TRANSSHIPMENT": "Transshipment",
    "DELAY": "Delay",
    "EXCEPTION": "Exception",
    "DELIVERED": "Delivered",
    "DOC_RECEIVED": "Document Received",
    "VESSEL_CHANGE": "Vessel Change",
}

CARGO_TYPES = {
    "GENERAL": "General Cargo",
    "BULK": "Bulk",
    "CONTAINER": "Containerized",
    "BREAKBULK": "Break Bulk",
    "REEFER": "Refrigerated",
    "HAZMAT": "Hazardous Material",
    "OVERSIZED": "Oversized / OOG",
    "LIQUID": "Liquid / Tanker",
}

PORT_TYPES = {
    "SEA": "Seaport",
    "AIR": "Airport",
    "DRY": "Dry Port / ICD",
    "MULTI": "Multimodal Hub",
}

ROUTE_STATUSES = {
    "ACTIVE": "Active",
    "SEASONAL": "Seasonal",
    "SUSPENDED": "Suspended",
    "DISCONTINUED": "Discontinued",
}

SNAPSHOT_ENTITIES = ["CARRIER", "ROUTE", "PORT", "SHIPPER", "CONSIGNEE", "GLOBAL"]
SNAPSHOT_GRANULARITIES = ["DAILY", "WEEKLY", "MONTHLY"]

ACTIVE_STATUSES = ["BOOKED", "IN_TRANSIT", "AT_PORT"]
TERMINAL_STATUSES = ["DELIVERED", "CANCELLED"]
# statuses the metric snapshots count as delayed once the ETA has passed
LATE_IN_SNAPSHOTS = ["IN_TRANSIT", "AT_PORT", "EXCEPTION"]
# statuses the delay-notification job looks at
LATE_IN_NOTIFICATIONS = ["IN_TRANSIT", "AT_PORT"]
BOOKABLE_ROUTE_STATUSES = ["ACTIVE", "SEASONAL"]

# Legal next statuses; staying in the same status is always legal.
STATUS_MOVES = {
    "DRAFT": ["BOOKED", "CANCELLED"],
    "BOOKED": ["IN_TRANSIT", "CANCELLED", "EXCEPTION"],
    "IN_TRANSIT": ["AT_PORT", "DELIVERED", "CANCELLED", "EXCEPTION"],
    "AT_PORT": ["IN_TRANSIT", "DELIVERED", "CANCELLED", "EXCEPTION"],
    "CUSTOMS_HOLD": ["IN_TRANSIT", "AT_PORT", "DELIVERED", "CANCELLED", "EXCEPTION"],
    "EXCEPTION": ["IN_TRANSIT", "AT_PORT", "DELIVERED", "CANCELLED"],
    "DELIVERED": [],
    "CANCELLED": [],
}

# Event types that may be recorded while a shipment is in a status.
EVENTS_ALLOWED = {
    "DRAFT": ["DOC_RECEIVED"],
    "BOOKED": ["DOC_RECEIVED", "VESSEL_CHANGE"],
    "IN_TRANSIT": ["DEPARTURE", "ARRIVAL", "TRANSSHIPMENT", "DELAY", "EXCEPTION", "VESSEL_CHANGE", "DOC_RECEIVED"],
    "AT_PORT": ["ARRIVAL", "CUSTOMS_CLEARED", "CUSTOMS_HOLD", "EXCEPTION", "DOC_RECEIVED"],
    "CUSTOMS_HOLD": ["CUSTOMS_CLEARED", "EXCEPTION", "DOC_RECEIVED"],
    "EXCEPTION": ["DEPARTURE", "ARRIVAL", "EXCEPTION", "DOC_RECEIVED"],
    "DELIVERED": ["DELIVERED", "DOC_RECEIVED"],
    "CANCELLED": [],
}

# Event written when a shipment enters a status.
EVENT_FOR_STATUS = {
    "BOOKED": "DOC_RECEIVED",
    "IN_TRANSIT": "DEPARTURE",
    "AT_PORT": "ARRIVAL",
    "DELIVERED": "DELIVERED",
    "CANCELLED": "EXCEPTION",
    "EXCEPTION": "EXCEPTION",
    "CUSTOMS_HOLD": "CUSTOMS_HOLD",
}

# Value tiers, highest first; anything below (or NULL) is "standard".
VALUE_TIERS = [("platinum", "500000"), ("gold", "100000"), ("silver", "10000")]
