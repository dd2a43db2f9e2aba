"""DataFrame operators over ``cells(sample_id, variant_id, value)`` and ``labels(sample_id, label)``."""
