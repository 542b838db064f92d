"""Table schemas. CHECK and FOREIGN KEY rules are data, applied by ``operators.market.validate_constraints``."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "price": T.DecimalType(18, 4), "indicator": T.DecimalType(18, 6), "value": T.DecimalType(24, 2),
}


def _struct(keys: str, **columns: str) -> T.StructType:
    """Columns by type; ``keys`` are not null. Decimals are for sinks: computation is in doubles."""
    required = keys.split()
    return T.StructType([T.StructField(n, _TYPES[kind], n not in required) for kind, names in columns.items() for n in names.split()])


SYMBOLS = _struct("ticker", string="ticker name_vi name_en exchange market", long="current_listed_shares")
DAILY_RAW = _struct(
    "ticker trading_date",
    string="ticker anomaly_reason",
    date="trading_date",
    price="ref_price ceiling_price floor_price open_price high_price low_price close_price avg_price adj_close_price price_change",
    indicator="price_change_pct",
    boolean="anomaly_ref_zero anomaly_ceiling_zero anomaly_floor_zero",
    long="matched_volume put_through_volume total_volume foreign_buy_vol foreign_sell_vol foreign_room_left total_buy_orders total_buy_vol total_sell_orders total_sell_vol foreign_net_vol",
    value="matched_value put_through_value total_value foreign_buy_value foreign_sell_value foreign_net_value",
    timestamp="returned_at",
)
FEATURES = _struct(
    "ticker trading_date", string="ticker formula_version", date="trading_date", long="snapshot_listed_shares", value="market_cap", indicator="ma20 ma50 ma200 rsi_14 macd macd_signal", boolean="flag_above_ma50 flag_overbought flag_oversold"
)
INTRADAY = _struct("ticker timestamp", string="ticker", timestamp="timestamp", date="trading_date", price="open high low close", long="volume", value="api_intraday_value")
DOCUMENT_STATE = _struct(
    "doc_id",
    string="doc_id ticker period report_type report_family scope source source_url raw_path markdown_path json_path collection status error_message",
    int="fiscal_year quarter",
    timestamp="created_at updated_at",
)
DOCUMENT_EVENT = _struct("doc_id", string="doc_id event_type old_status new_status message error_detail", timestamp="created_at")
#: As DDL text: it is parsed where a session is at hand.
CHUNK = (
    "chunk_id string, retrieval_id string, chunk_type string, doc_id string, ticker string, year int, fiscal_year int, quarter int, period string, report_type string, report_family string, scope string, page int, page_start int, "
    "page_end int, section_title string, raw_content string, content_for_embedding string, source_ids array<string>, table_id string, parent_table_id string, row_index int, row_label string, "
    "row_values array<struct<key:string,value:string>>, focus_row_text string, window_text string, linked_row_id string, linked_window_id string, vector array<float>"
)

#: Ranks of document statuses. A status moves to an equal or higher rank only.
STATUS_RANK = {"DISCOVERED": 10, "DOWNLOADED": 20, "PARSED": 30, "CHUNKED": 40, "EMBEDDED": 50, "FAILED": 100}
