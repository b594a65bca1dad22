"""Operators: each is ``f(df, ...) -> DataFrame`` built from DataFrame / SQL expressions."""
