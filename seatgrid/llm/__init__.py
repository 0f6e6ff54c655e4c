"""Training-data operators: dedup, filters, scans, chat formatting, mixing, sharding, classifiers."""
