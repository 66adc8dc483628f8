"""postmill: a PySpark engine that turns raw mail into tables and Markdown notes."""

VERSION = "0.1.0"
