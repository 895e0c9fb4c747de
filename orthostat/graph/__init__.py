"""Assertions as RDF triples: mapping, validation and serialisation."""
