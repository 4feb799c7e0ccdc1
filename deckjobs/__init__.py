"""Spark jobs that turn large collections of laid-out documents into structured slide decks."""
