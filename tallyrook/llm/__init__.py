"""Operators of a training-data pipeline: each module holds one operator with
its own general interface; `queries` holds the thin queries over the tables."""
