"""First rows of the list queries, as client start pages show them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from tapewright.plans.economy import indicator_page
from tapewright.plans.news import recent_news
from tapewright.plans.stocks import stock_page

# Rows shown per list.
WEB = {"stocks": 12, "indicators": 6, "news": 9}
MOBILE = {"stocks": 6, "indicators": 3, "news": 3}


def dashboard(
    summaries: DataFrame,
    indicators: DataFrame,
    metadata: DataFrame,
    news: DataFrame,
    as_of: datetime | str,
    rows: dict[str, int] = WEB,
) -> dict[str, DataFrame]:
    return {
        "stocks": stock_page(summaries, 0, rows["stocks"]),
        "indicators": indicator_page(indicators, metadata, as_of, 0, rows["indicators"]),
        "news": recent_news(news, as_of, limit=rows["news"]),
    }
