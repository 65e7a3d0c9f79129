"""Binds the TPC-H-like driver tables to retail roles, for the checks and the benchmark."""
