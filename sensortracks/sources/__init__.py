"""Feeds and formats: every source produces the normalized detection schema."""
