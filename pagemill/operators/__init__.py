"""DataFrame operators over pages and corpora."""
