"""Schemas of the stored tables and of the feeds, as Spark DDL."""

ARTICLES = "id LONG NOT NULL, external_id STRING, url STRING NOT NULL, headline STRING NOT NULL, summary STRING, body STRING, source STRING, published_at TIMESTAMP NOT NULL, ingested_at TIMESTAMP, raw_payload STRING"
ARTICLE_TICKERS = "article_id LONG NOT NULL, ticker STRING NOT NULL"
SENTIMENT_SCORES = "id LONG, article_id LONG NOT NULL, ticker STRING, model STRING, score_positive DECIMAL(5,4), score_negative DECIMAL(5,4), score_neutral DECIMAL(5,4), compound DECIMAL(6,4), label STRING, scored_at TIMESTAMP"
PRICE_LABELS = "ticker STRING, date DATE, close_price DECIMAL(12,4), forward_return_5d DECIMAL(10,6), label STRING, fetched_at TIMESTAMP"
EARNINGS_EVENTS = "ticker STRING, report_date TIMESTAMP, fiscal_date_ending STRING, estimated_eps DECIMAL(12,4), actual_eps DECIMAL(12,4), surprise_pct DECIMAL(10,4), ingested_at TIMESTAMP"
SEC_FILINGS = "ticker STRING, cik STRING, accession_number STRING, form_type STRING, filed_at TIMESTAMP, description STRING, filing_url STRING, article_id LONG, ingested_at TIMESTAMP"
PREDICTIONS = "id LONG, ticker STRING, predicted_at TIMESTAMP, recommendation STRING, confidence DECIMAL(5,4), sentiment_score DECIMAL(6,4), price_rsi DECIMAL(6,2), feature_importances MAP<STRING,DOUBLE>, horizon_days INT"
BARS = "ticker STRING, timestamp TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
TICKERS = "symbol STRING, name STRING"
NEWS_EVENT = "T STRING, id STRING, url STRING, headline STRING, summary STRING, source STRING, created_at STRING, published_at STRING, symbols ARRAY<STRING>"
TABLES = {
    "articles": ARTICLES, "article_tickers": ARTICLE_TICKERS, "sentiment_scores": SENTIMENT_SCORES, "price_labels": PRICE_LABELS,
    "earnings_events": EARNINGS_EVENTS, "sec_filings": SEC_FILINGS, "predictions": PREDICTIONS, "bars": BARS, "tickers": TICKERS,
}
