"""Landed pages, stores, and result tables."""
