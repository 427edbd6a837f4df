"""Queries over the test tables: each one uses the operators of `pairloom`, with the SQL that checks it."""
