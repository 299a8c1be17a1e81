"""axiomloom: ontology axiom analytics as Spark DataFrame operators."""

from .session import build_session

__all__ = ["build_session"]
