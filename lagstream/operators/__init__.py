"""Distributed operators on trajectory tables, and the models they fit."""
