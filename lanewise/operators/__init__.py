"""DataFrame-to-DataFrame operators: standardizing, region look-up, deduplication, quality checks."""
