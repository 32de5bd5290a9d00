"""Record schemas, and the ``fixedrec`` data source that reads and writes fixed-width binary records."""
