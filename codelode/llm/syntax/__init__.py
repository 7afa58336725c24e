"""Syntax of six languages as grammars for parsing with derivatives."""
