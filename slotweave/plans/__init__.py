"""Registered queries, one per job, each with the SQL that must give the same rows."""
