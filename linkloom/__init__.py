"""Web indexing on Spark: pages in, tags, link tables and searches out."""
