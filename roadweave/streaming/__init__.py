"""Stateful operators on streams of ticks; each has a batch form among the queries."""
