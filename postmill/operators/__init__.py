"""Dataflow operators of the mailbox engine: DataFrames in, DataFrames out."""
