"""Texts scanned as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.rules import Rule, scan_text


def scan_stream(texts: DataFrame, id_col: str, text_col: str, rules: list[Rule] | None = None) -> DataFrame:
    """The findings of a stream of texts, in append mode.

    The scan is one projection without state, so each text is scanned once, in the
    batch in which it arrives; the checkpoint of the query is the place up to which
    texts are scanned."""
    return scan_text(texts, id_col, text_col, rules)
