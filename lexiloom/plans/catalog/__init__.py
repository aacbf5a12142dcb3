"""Every operator as a query on the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("sources", "preparation", "joins", "text", "encoders", "topics", "reduction", "evaluation", "models",
            "streams")



def _merged(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"{__name__}.{family}"), attribute)
        twice = out.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
