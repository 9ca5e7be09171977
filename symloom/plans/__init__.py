"""Registered queries and the graph that they run on."""
