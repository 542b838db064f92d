"""Spark operators for market, news, document and question tables."""
