"""factfold: trust-weighted fact consensus and hybrid retrieval as Spark DataFrame operators."""

__version__ = "0.1.0"
