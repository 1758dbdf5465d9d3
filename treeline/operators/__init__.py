"""Relational operators behind the rules: each takes DataFrames and gives the rows that break one."""
