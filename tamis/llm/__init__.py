"""Operators that prepare text for language models; nothing outside this subpackage imports it."""
