"""Operators chained into the runs a user starts: sync, triage, drafts."""
