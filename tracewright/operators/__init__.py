"""Operators: each module takes and returns DataFrames, holds no session and registers nothing."""
