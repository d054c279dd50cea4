"""Queries over the tables of one folder, each with SQL for the same rows where SQL can express it."""
