"""Settlement assurance on Spark: ingest, link, verify, triage and report as DataFrame plans."""
