"""Spark-native triage of opportunity alerts: sync, extract, clean, score, list, draft."""
