"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {
        "s": T.StringType(),
        "d": T.DateType(),
        "t": T.TimestampType(),
        "f": T.DoubleType(),
        "l": T.LongType(),
        "i": T.IntegerType(),
    }
    fields = [f.split(":") for f in spec.split()]
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields])


PRICES = _schema("ticker:s date:d open:f high:f low:f close:f adj_close:f volume:l")
BENCHMARKS = _schema("ticker:s date:d close:f adj_close:f")
META = _schema("ticker:s company_name:s sector:s industry:s market_cap:f updated_at:t")
FUNDAMENTALS = _schema(
    "ticker:s date:d pe_ratio:f pb_ratio:f ps_ratio:f roe:f roa:f debt_to_equity:f profit_margin:f "
    "revenue_growth:f earnings_growth:f dividend_yield:f peg_ratio:f ev_to_ebitda:f operating_margin:f "
    "gross_margin:f current_ratio:f quick_ratio:f free_cash_flow:l payout_ratio:f"
)
PREDICTIONS = _schema(
    "ticker:s prediction_date:d target_date:d probability:f predicted_return:f actual_return:f was_correct:i model_version:s"
)
NEWS = _schema("ticker:s published_at:t title:s label:s sentiment:f confidence:f relevance:f")
UNIVERSE_DOCUMENT = T.StructType(
    [
        T.StructField("universe_by_date", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("ticker_aliases", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("sectors", T.MapType(T.StringType(), T.StringType())),
        T.StructField("survivorship_bias_stocks", T.ArrayType(T.StringType())),
    ]
)
VENDOR_RECORD = T.StructType(
    [
        T.StructField(n, T.DoubleType())
        for n in "trailingPE priceToBook priceToSalesTrailing12Months returnOnEquity returnOnAssets debtToEquity "
        "profitMargins revenueGrowth earningsGrowth dividendYield marketCap".split()
    ]
    + [T.StructField(n, T.StringType()) for n in "symbol longName sector industry".split()]
)
