"""Registered queries over the driver tables and their reference SQL."""
