"""Registered queries, each with its SQL counterpart where SQL can express it."""
