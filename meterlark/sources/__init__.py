"""Readers, codecs and adapters that give the domain tables."""
