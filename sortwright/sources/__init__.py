"""Listings, file previews and stored tables."""
