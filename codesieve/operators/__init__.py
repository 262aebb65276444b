"""Relational operators over files, issues, scans and review answers."""
