"""Operators for preparing training data: encoding, screening, mixing and de-duplicating document tables."""
