"""Readers of guides, calendars and provider pages, and tables of snapshots."""
