"""Inputs of the queries: the broadcast view of the event table, and what follows from it."""
