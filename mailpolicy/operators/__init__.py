from mailpolicy.operators import curves, deployment, probes, reports, terms

__all__ = ["curves", "deployment", "probes", "reports", "terms"]
