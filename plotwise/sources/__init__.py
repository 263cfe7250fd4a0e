"""Readers of the parcel lake, the name list, village centroids, captured payloads and project rows; writers of derived tables."""
