"""Streaming of the site-screening library."""
