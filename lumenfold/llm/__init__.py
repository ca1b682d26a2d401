"""Operators for preparing large training corpora; nothing outside this folder imports it."""
