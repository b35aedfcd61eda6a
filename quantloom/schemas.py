"""Fixed schemas of landed tables and files, and of the tables that the library writes."""

from __future__ import annotations

#: The landed star-schema tables. Columns beyond these are not read.
LANDED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}
POSITION_JSON = "array<struct<symbol:string,shares:double,buy_price:double>>"
#: Stored daily bars; month (yyyymm) is the folder.
BARS = "symbol long, d date, open double, high double, low double, close double, volume double, month int"
#: Positions as lots; a lot's key is all that a trade tells of it.
LOTS = "portfolio_id long, symbol long, order_id long, line long, paid double, shares double, buy_price double"
LOT_KEYS = ("portfolio_id", "symbol", "order_id", "line", "paid", "shares")
