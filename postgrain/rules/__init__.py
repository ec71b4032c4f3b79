"""Rule tables: fixed vocabularies and thresholds, all replaceable by the caller."""
