"""From raw bars to the aligned continuous series the features are built on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators.align import align_htf, join_cross_asset
from tidebar.operators.contracts import continuous_series
from tidebar.operators.sessions import TZ, build_streams, primary_freq
from tidebar.sources.dimensions import market_dim, with_multiplier


def aligned_continuous(raw: DataFrame, freqs: Sequence[str] = ("1m", "1h", "1d"), tz: str = TZ, markets: DataFrame | None = None,
                       cross_symbols: Sequence[str] = (), daily: str = "calendar", match: str = "asof") -> DataFrame:
    """Session bars, higher-timeframe columns, roll-adjusted prices and optional cross-asset returns.

    Each stage measures its input; write and re-read the result before feature work on large data.
    """
    markets = markets if markets is not None else market_dim(raw.sparkSession)
    streams = build_streams(raw, freqs, tz, daily)
    base = streams[primary_freq(streams)]
    aligned = align_htf(base, streams.get("1h"), streams.get("1d"))
    priced = with_multiplier(aligned, markets)
    out = continuous_series(priced, F.col("contract_multiplier"), match=match)
    return join_cross_asset(out, base, cross_symbols) if cross_symbols else out
