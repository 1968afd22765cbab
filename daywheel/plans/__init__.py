"""Registered queries, their SQL twins, sweeps and reports."""
