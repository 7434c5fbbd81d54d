"""Composite analytics: index, search, link graph, crawl."""
