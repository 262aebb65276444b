"""Code-quality analytics on Spark: scan source files, relate the findings, report on them."""
