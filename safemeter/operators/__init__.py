"""Relational operators: staging, facts, metrics, comparison, gate, checks, detection."""
