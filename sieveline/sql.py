"""The scalar functions of the engine as SQL functions.

They are temporary SQL functions made of the same column expressions, so a query
that uses them stays native: ``select is_aadhaar(text), mask_value(text) from t``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import checks, fit, text

#: name -> (function of one text column, SQL type).
FUNCTIONS: dict[str, tuple[Callable[[Column], Column], str]] = {
    **{f.__name__: (f, "BOOLEAN") for f in (
        checks.is_aadhaar, checks.is_aadhaar_vid, checks.is_payment_card, checks.is_pan, checks.is_gstin, checks.is_ifsc, checks.is_known_ifsc, checks.is_indian_mobile,
        checks.is_indian_landline, checks.is_international_phone, checks.is_indian_passport, checks.is_voter_id, checks.is_vehicle_number, checks.is_ssn, checks.is_iban, checks.is_mrz_line,
        checks.is_obfuscated_email, text.is_address,
    )},
    **{f.__name__: (f, "STRING") for f in (checks.card_brand, text.site_of, text.classify_task, text.injection, text.normalise_url, text.fold, text.preview, text.normalise_digits, fit.iso_date, fit.iso_time, fit.iso_month, fit.plain_number)},
    "mask_value": (text.mask, "STRING"), "verhoeff_check": (checks.verhoeff, "BOOLEAN"), "tokens_in": (text.tokens_in, "ARRAY<STRING>"),
}


#: A string, or an operator that is written as a function.
_OPERATOR = re.compile(r"('(?:\\.|[^'\\])*')|(?<![\w`])(<=>|<=|>=|!=|==|<|>|=|!|\+|-|\*|/|%|and|or|not)(?=\()")


def sql_of(column: Column) -> str:
    """A column expression as SQL; operators become quoted function names."""
    return _OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`", column._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(raw STRING) RETURNS {kind} RETURN {sql_of(function(F.col('raw')))}")
    return sorted(FUNCTIONS)
