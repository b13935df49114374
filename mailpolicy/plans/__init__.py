"""The four reports, each from paths to written results. Run one with ``spark-submit`` or ``python -m``."""
