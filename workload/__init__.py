"""Registered queries over the supplied tables, each with its comparison SQL where SQL can say it."""
