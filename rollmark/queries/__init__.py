"""Registered queries: the operators over the shared tables, each beside its SQL."""
