"""Registered queries by area, each with its SQL counterpart where SQL can express it."""
