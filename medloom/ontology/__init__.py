"""The declarative catalogue of extraction categories, and site lookups."""
