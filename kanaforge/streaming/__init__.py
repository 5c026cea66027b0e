"""Stateless scoring over streaming DataFrames."""
