"""Compositions of operators: SQL suite, batch run, registered queries."""
