"""Scans, generators and write semantics."""
