from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lanewise.session import local_session  # noqa: E402
from lanewise.sources.schemas import TABLES  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "shipments": {
        "shipper_id": "co1",
        "consignee_id": "co2",
        "carrier_id": "ca1",
        "route_id": "r1",
        "origin_port_id": "p1",
        "destination_port_id": "p2",
        "bill_of_lading": "",
        "status": "IN_TRANSIT",
        "departure_date": "2024-02-23 12:00:00",
        "estimated_arrival": "2024-03-15 12:00:00",
        "declared_value": Decimal("10000.00"),
        "currency_code": "USD",
        "tags": [],
        "custom_attributes": "{}",
        "notes": "",
    },
    "cargo": {
        "shipment_id": "s1",
        "cargo_type": "CONTAINER",
        "gross_weight_kg": Decimal("1000.000"),
        "net_weight_kg": Decimal("920.000"),
        "volume_cbm": Decimal("20.0000"),
        "package_count": 10,
        "is_hazmat": False,
        "un_number": "",
    },
    "tracking_events": {
        "shipment_id": "s1",
        "event_type": "DEPARTURE",
        "event_time": "2024-02-25 12:00:00",
        "is_exception": False,
        "exception_resolved": False,
        "raw_payload": "{}",
    },
    "carriers": {"company_id": "co1", "carrier_name": "Line", "mode": "SEA", "imo_number": "", "is_active": True, "hub_ports": [], "service_metadata": '{"webhook_secret":"k"}'},
    "routes": {"carrier_id": "ca1", "origin_port_id": "p1", "destination_port_id": "p2", "status": "ACTIVE", "transit_days_min": 14, "transit_days_max": 21, "weekly_frequency": 2},
    "ports": {"country_code": "CN", "port_type": "SEA", "is_active": True},
    "companies": {"company_type": "SHIPPER", "country_code": "US", "is_active": True},
    "port_calls": {"route_id": "r1", "port_id": "p1", "call_sequence": 1, "scheduled_arrival": "2024-02-20 00:00:00", "arrival_delay_hours": Decimal("1.00")},
}
UNIQUE = {"shipments": "tracking_number", "carriers": "carrier_code", "routes": "route_code", "ports": "un_locode", "companies": "tax_id"}


@pytest.fixture(scope="session")
def table(spark):
    """table("shipments", {...}, {...}) -> a typed frame; ids and unique keys default to s1, s2, ..."""

    def build(name: str, *rows: dict, drop: tuple[str, ...] = ()):
        columns = [part.split()[0] for part in _split(TABLES[name])]
        full = []
        for n, given in enumerate(rows, 1):
            row = {"id": f"{name[0]}{n}", **DEFAULTS.get(name, {})}
            if name in UNIQUE:
                row[UNIQUE[name]] = given.get("id", f"{name[0]}{n}").upper()
            row |= given
            full.append([row.get(c) for c in columns])
        loose = ", ".join(part.replace(" timestamp", " string").replace(" date", " string") if part.split()[1] in ("timestamp", "date") else part for part in _split(TABLES[name]))
        df = spark.createDataFrame(full, loose)
        typed = [f"cast({p.split()[0]} as {p.split(maxsplit=1)[1]}) as {p.split()[0]}" for p in _split(TABLES[name])]
        return df.selectExpr(*typed).drop(*drop)

    return build


def _split(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += ch in "(<"
        depth -= ch in ")>"
        if ch == "," and depth == 0:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return [*parts, ddl[start:].strip()]
