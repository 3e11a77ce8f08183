"""brookmill: a Spark-first engine for web-content extraction, crawl planning and corpus building."""

__version__ = "0.1.0"
