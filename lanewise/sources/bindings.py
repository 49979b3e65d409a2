"""The freight tables, derived from a TPC-H-like star schema plus an event stream.

Every table is a lazy projection of the given parquet tables, so a query over it scans and prunes
those files. Keys stay bigint here; the operators accept any key type.

    supplier -> carriers      customer -> companies      nation -> ports
    orders x lineitem -> shipments, lineitem -> cargo, events -> tracking_events, port_calls
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lanewise.session import pin_utc

# stated, so that opening a table needs no job to read footers
_GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_PORTS = 25
_ROUTES = _PORTS * _PORTS


def _pick(key: str, *choices: str) -> str:
    """The choice at position key mod n."""
    return f"element_at(array({', '.join(repr(c) for c in choices)}), cast(pmod({key}, {len(choices)}) + 1 as int))"


def _padded(prefix: str, key: str, width: int) -> str:
    return f"concat('{prefix}', lpad(cast({key} as string), {width}, '0'))"


def _days(n: str) -> str:
    return f"make_dt_interval(cast({n} as int))"


_COUNTRY = "concat(char(65 + n_regionkey), char(65 + n_nationkey))"
_LOCODE = f"concat({_COUNTRY}, {_padded('N', 'n_nationkey', 2)})"


class Bindings:
    """Freight tables over one directory of the given tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = pin_utc(spark)
        self.directory = directory

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(_GIVEN[name]).parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def ports(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "cast(n_nationkey as bigint) as id",
            f"{_LOCODE} as un_locode",
            "'' as iata_code",
            "n_name as port_name",
            f"{_COUNTRY} as country_code",
            f"{_pick('n_nationkey', 'SEA', 'AIR', 'DRY', 'MULTI')} as port_type",
            "cast(n_nationkey * 7 - 80 as decimal(9,6)) as latitude",
            "cast(n_nationkey * 14 - 170 as decimal(9,6)) as longitude",
            "'UTC' as timezone",
            "pmod(n_nationkey, 8) <> 7 as is_active",
        )

    @cached_property
    def companies(self) -> DataFrame:
        nation = self.raw("nation").selectExpr("n_nationkey as c_nationkey", f"{_COUNTRY} as country_code")
        return self.raw("customer").join(nation, "c_nationkey", "left").selectExpr(
            "c_custkey as id",
            "c_name as legal_name",
            "'' as trade_name",
            f"{_pick('c_custkey', 'SHIPPER', 'CONSIGNEE', 'FF', 'CB', '3PL')} as company_type",
            f"{_padded('TAX', 'c_custkey', 10)} as tax_id",
            "'' as duns_number",
            "country_code",
            "c_acctbal >= 0 as is_active",
            "'{}' as metadata",
        )

    @cached_property
    def carriers(self) -> DataFrame:
        locode = self.raw("nation").selectExpr("n_nationkey as s_nationkey", f"{_LOCODE} as locode")
        mode = _pick("s_suppkey", "SEA", "AIR", "RAIL", "ROAD", "MULTI")
        return self.raw("supplier").join(locode, "s_nationkey", "left").selectExpr(
            "s_suppkey as id",
            "s_suppkey as company_id",
            f"{_padded('C', 's_suppkey', 7)} as carrier_code",
            "s_name as carrier_name",
            f"{mode} as mode",
            f"if({mode} = 'SEA', cast(s_suppkey + 9000000 as string), '') as imo_number",
            "pmod(s_suppkey, 10) <> 9 as is_active",
            "array(locode, 'AAN00') as hub_ports",
            "to_json(struct(concat('key-', cast(s_suppkey as string)) as webhook_secret)) as service_metadata",
        )

    @cached_property
    def shipments(self) -> DataFrame:
        lane = self.raw("lineitem").groupBy("l_orderkey").agg({"l_suppkey": "min"}).toDF("o_orderkey", "carrier_id")
        origin = self.raw("supplier").selectExpr("s_suppkey as carrier_id", "cast(s_nationkey as bigint) as origin_port_id")
        target = self.raw("customer").selectExpr("c_custkey as o_custkey", "cast(c_nationkey as bigint) as destination_port_id")
        open_status = _pick("o_orderkey", "BOOKED", "AT_PORT", "EXCEPTION", "CANCELLED", "CUSTOMS_HOLD")
        known = (
            self.raw("orders")
            .join(lane, "o_orderkey")
            .join(origin, "carrier_id")
            .join(target, "o_custkey")
            .selectExpr(
                "*",
                f"case o_orderstatus when 'F' then 'DELIVERED' when 'O' then 'IN_TRANSIT' else {open_status} end as status",
                "cast(o_orderdate as timestamp) as departure_date",
                f"cast(o_orderdate as timestamp) + {_days('14 + pmod(o_orderkey, 15)')} as estimated_arrival",
            )
        )
        return known.selectExpr(
            "o_orderkey as id",
            "o_custkey as shipper_id",
            "o_custkey div 2 as consignee_id",
            "cast(null as bigint) as notify_party_id",
            "carrier_id",
            f"origin_port_id * {_PORTS} + destination_port_id as route_id",
            "origin_port_id",
            "destination_port_id",
            f"{_padded('GT-', 'o_orderkey', 10)} as tracking_number",
            f"if(pmod(o_orderkey, 3) = 0, '', {_padded('BL', 'o_orderkey div 2', 10)}) as bill_of_lading",
            "'' as house_bill_of_lading",
            f"array({_padded('PO', 'o_orderkey', 10)}) as purchase_order_refs",
            "status",
            f"cast(departure_date - {_days('7')} as date) as booking_date",
            "departure_date",
            "estimated_arrival",
            f"if(status = 'DELIVERED', estimated_arrival + {_days('pmod(o_orderkey, 8) - 2')}, null) as actual_arrival",
            "if(pmod(o_orderkey, 37) <> 0, cast(o_totalprice as decimal(18,2)), null) as declared_value",
            "cast(pmod(o_orderkey, 25000) + 800 as decimal(14,2)) as freight_cost",
            "'USD' as currency_code",
            f"{_pick('o_orderkey', 'FOB', 'CIF', 'CFR', 'DAP', 'EXW', 'DDP')} as incoterms",
            "array('8471.30', '8473.30') as hs_codes",
            "if(pmod(o_orderkey, 10) = 0, array('seed'), cast(array() as array<string>)) as tags",
            f"to_json(struct({_padded('key-', 'o_orderkey', 10)} as idempotency_key)) as custom_attributes",
            "'' as notes",
            f"departure_date - {_days('7')} as created_at",
            "departure_date as updated_at",
        )

    @cached_property
    def routes(self) -> DataFrame:
        lanes = self.shipments.groupBy("route_id").agg({"carrier_id": "min"}).toDF("id", "carrier_id")
        return lanes.selectExpr(
            "id",
            "carrier_id",
            f"id div {_PORTS} as origin_port_id",
            f"pmod(id, {_PORTS}) as destination_port_id",
            f"{_padded('LANE-', 'id', 4)} as route_code",
            f"{_pick('id', 'ACTIVE', 'ACTIVE', 'SEASONAL', 'SUSPENDED')} as status",
            "14S as transit_days_min",
            "28S as transit_days_max",
            "cast(array() as array<string>) as transshipment_ports",
            "cast(pmod(id, 23) as smallint) as weekly_frequency",
            "date'1995-01-01' as effective_from",
            "if(pmod(id, 9) = 0, date'2000-01-01', null) as effective_until",
        )

    @cached_property
    def cargo(self) -> DataFrame:
        kind = _pick("l_partkey", "GENERAL", "BULK", "CONTAINER", "BREAKBULK", "REEFER", "HAZMAT", "OVERSIZED", "LIQUID")
        gross = "cast(l_quantity as decimal(12,3))"
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(round(l_extendedprice * 100) as bigint)"]
        return self.raw("lineitem").selectExpr(
            f"concat_ws('-', {', '.join(f'cast({k} as string)' for k in keys)}) as id",
            "l_orderkey as shipment_id",
            f"{kind} as cargo_type",
            "'' as description",
            f"{_padded('CONT', 'pmod(l_partkey, 1000)', 7)} as container_number",
            "'' as seal_number",
            f"{gross} as gross_weight_kg",
            f"cast({gross} - pmod(l_partkey, 4) + 1 as decimal(12,3)) as net_weight_kg",
            f"cast({gross} * 2 as decimal(10,4)) as volume_cbm",
            "cast(l_quantity as int) as package_count",
            "'CT' as package_type",
            "l_tax >= 0.07D as is_hazmat",
            f"if(l_tax >= 0.07D and pmod(l_partkey, 11) <> 0, {_padded('1', 'pmod(l_partkey, 1000)', 3)}, '') as un_number",
            "'' as imdg_class",
            f"if({kind} = 'REEFER', cast(-pmod(l_partkey, 20) as decimal(5,2)), null) as temperature_min_c",
            f"if({kind} = 'REEFER', cast(pmod(l_partkey, 9) - 12 as decimal(5,2)), null) as temperature_max_c",
            "'{}' as custom_attributes",
        )

    @cached_property
    def tracking_events(self) -> DataFrame:
        kinds = "when 'error' then 'EXCEPTION' when 'view' then 'ARRIVAL' when 'click' then 'DEPARTURE' when 'purchase' then 'DELAY'"
        return self.raw("events").selectExpr(
            "event_id as id",
            "event_id div 3 as shipment_id",
            f"pmod(user_id, {_PORTS}) as port_id",
            "if(pmod(event_id, 40) = 39, event_id - 1, null) as supersedes_id",
            f"case event_type {kinds} else 'DOC_RECEIVED' end as event_type",
            "cast(ts as timestamp) as event_time",
            "cast(ts as timestamp) + make_dt_interval(0, cast(pmod(event_id, 30) as int)) as recorded_at",
            "'' as location_description",
            "'' as description",
            "event_type = 'error' as is_exception",
            "pmod(event_id, 3) = 0 as exception_resolved",
            "'FEED' as source_system",
            """concat('{"webhook_id":"w', cast(event_id as string), '"}') as raw_payload""",
        )

    @cached_property
    def port_calls(self) -> DataFrame:
        late = "make_dt_interval(0, 0, cast(floor(value - 50) as int))"
        return self.raw("events").filter("event_type = 'view'").selectExpr(
            "event_id as id",
            f"pmod(event_id, {_ROUTES}) as route_id",
            f"pmod(user_id, {_PORTS}) as port_id",
            # increasing and unique within the route, without a window over the whole route
            f"cast(event_id div {_ROUTES} + 1 as int) as call_sequence",
            "'' as vessel_name",
            "'' as voyage_number",
            "cast(ts as timestamp) as scheduled_arrival",
            f"cast(ts as timestamp) + {late} as actual_arrival",
            f"cast(ts as timestamp) + {_days('1')} as scheduled_departure",
            f"cast(ts as timestamp) + {late} + {_days('pmod(event_id, 3) - 1')} as actual_departure",
            "cast(value - 50 as decimal(7,2)) as arrival_delay_hours",
        )
