"""runlens: DataFrame operators over inference-run and evaluation-sample tables.

Every operator is a plain function ``DataFrame -> DataFrame`` (or ``Column ->
Column`` for scalar helpers) so that Catalyst sees one declarative plan.
"""

__all__ = ["session", "schemas"]
