"""Registered queries: each module gives QUERIES (name -> callable) and SQL (name -> oracle text)."""
