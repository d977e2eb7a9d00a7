"""DataFrame-to-DataFrame operators: detection, enrichment, response, reports."""
