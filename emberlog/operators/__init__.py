"""DataFrame-to-DataFrame operators, all usable with ``DataFrame.transform``."""
