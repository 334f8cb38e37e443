"""Functions of the site-screening library."""
