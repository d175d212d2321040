"""Reads, joins, keyed changes and postings over keyed datasets."""
