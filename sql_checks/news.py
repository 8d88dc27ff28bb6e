"""News sentiment, ids and queries."""

from pyspark.sql import functions as F

from sql_checks import base
from sql_checks.base import AS_OF, NEGATIVE, POSITIVE, check
from tapewright.functions.text import NEGATIVE_TERMS, POSITIVE_TERMS, distinct_term_hits, sentiment
from tapewright.plans import news

_ITEM = "id, headline, summary, sentiment, ts, source, related_symbol"


@check("news_sentiment", " SELECT id, sentiment FROM news", "news")
def news_sentiment(spark, folder):
    return base.news(spark, folder).select("id", "sentiment")


@check("news_ids", " SELECT id, headline, date_bucket, related_symbol FROM news", "news")
def news_ids(spark, folder):
    return base.news(spark, folder).select("id", "headline", "date_bucket", "related_symbol")


_MARKET = """
    SELECT doc_id, CASE WHEN lead >= 2 THEN 'POSITIVE' WHEN lead <= -2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment
    FROM (SELECT doc_id, ({}) - ({}) AS lead FROM documents)"""


def _hits(terms) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in terms)


@check(
    "term_hits",
    f"""SELECT doc_id, {_hits(POSITIVE_TERMS)} AS positive_hits, {_hits(NEGATIVE_TERMS)} AS negative_hits,
      {_hits(POSITIVE)} AS first_hits, {_hits(NEGATIVE)} AS second_hits FROM documents""",
)
def term_hits(spark, folder):
    """Distinct terms found in whole texts, with the market lexicon and with the check lexicon."""
    text = F.lower("text")
    lists = {"positive_hits": POSITIVE_TERMS, "negative_hits": NEGATIVE_TERMS, "first_hits": POSITIVE, "second_hits": NEGATIVE}
    hits = [distinct_term_hits(text, terms).alias(name) for name, terms in lists.items()]
    return base.table(spark, folder, "documents").select("doc_id", *hits)


@check("news_sentiment_market", _MARKET.format(_hits(POSITIVE_TERMS), _hits(NEGATIVE_TERMS)))
def news_sentiment_market(spark, folder):
    """Labels of whole texts with the market lexicon."""
    label = sentiment(F.lit(""), F.col("text"), POSITIVE_TERMS, NEGATIVE_TERMS)
    return base.table(spark, folder, "documents").select("doc_id", label.alias("sentiment"))


def _recent(hours: int, limit: int, where: str = "true") -> str:
    return f"""(SELECT {_ITEM} FROM news
      WHERE date_bucket <= '2024-01-31' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOURS AND {where}
      ORDER BY ts DESC, id LIMIT {limit})"""


@check("recent_news", f" SELECT * FROM {_recent(24, 50)}", "news")
def recent_news(spark, folder):
    return news.recent_news(base.news(spark, folder), AS_OF)


@check("recent_news_week", f" SELECT * FROM {_recent(150, 120)}", "news")
def recent_news_week(spark, folder):
    return news.recent_news(base.news(spark, folder), AS_OF, hours=150, limit=120)


@check("news_month", f" SELECT * FROM {_recent(720, 1000)}", "news")
def news_month(spark, folder):
    return news.recent_news(base.news(spark, folder), AS_OF, hours=720, limit=1000)


@check("news_by_sentiment", f" SELECT * FROM {_recent(120, 20, "lower(sentiment) = 'negative'")}", "news")
def news_by_sentiment(spark, folder):
    return news.news_by_sentiment(base.news(spark, folder), "negative", AS_OF, hours=120)


@check("news_for_symbol", f" SELECT * FROM {_recent(168, 100, "lower(related_symbol) = 'sym0021'")}", "news")
def news_for_symbol(spark, folder):
    return news.news_for_symbol(base.news(spark, folder), "sym0021", AS_OF, hours=168, limit=100)


@check("news_for_symbol_month", f" SELECT * FROM {_recent(720, 100, "lower(related_symbol) = 'sym0021'")}", "news")
def news_for_symbol_month(spark, folder):
    return news.news_for_symbol(base.news(spark, folder), "sym0021", AS_OF, hours=720, limit=100)


@check(
    "news_bucket_topn",
    f" SELECT {_ITEM}, date_bucket FROM news QUALIFY row_number() OVER (PARTITION BY date_bucket ORDER BY ts DESC, id) <= 5",
    "news",
)
def news_bucket_topn(spark, folder):
    top = news.bucket_top(base.news(spark, folder), 5)
    return top.select("id", "headline", "summary", "sentiment", "ts", "source", "related_symbol", "date_bucket")


@check(
    "news_bucket_page",
    f" SELECT {_ITEM} FROM news WHERE date_bucket = '2024-01-03' ORDER BY ts DESC, id LIMIT 25",
    "news",
)
def news_bucket_page(spark, folder):
    top = news.bucket_page(base.news(spark, folder), "2024-01-03", 25)
    return top.select("id", "headline", "summary", "sentiment", "ts", "source", "related_symbol")
