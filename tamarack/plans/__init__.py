"""Registered queries: each module of this package adds its own to the catalogue."""

from tamarack.plans import business as business
