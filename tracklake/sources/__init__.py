"""Readers of provider formats, file round trips and a table catalog."""
