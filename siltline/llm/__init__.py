"""Operators for text that feeds language models. Nothing outside this subpackage imports it."""
