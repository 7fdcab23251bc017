"""Registered queries over the given tables, with their DuckDB SQL, by area."""
