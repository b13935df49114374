from mailpolicy.sources import counts, querylog, reports, scans, summary

__all__ = ["counts", "querylog", "reports", "scans", "summary"]
