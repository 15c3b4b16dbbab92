"""Operations of a training-data pipeline: formatting, scans, extraction, deduplication, filters, packing."""
