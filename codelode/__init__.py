"""Code-repository analytics on Spark: tables in, tables out."""
