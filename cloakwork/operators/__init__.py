"""DataFrame operators: candidates, overlap resolution, numbering, rewriting, review, rule pairs."""
