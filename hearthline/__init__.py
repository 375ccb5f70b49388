"""Listing intelligence on Spark: set-based DataFrame jobs over listings, pages, events and documents."""
