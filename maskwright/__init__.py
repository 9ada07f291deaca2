"""maskwright: reversible PII detection and anonymisation as Spark DataFrame plans."""

__version__ = "0.1.0"
