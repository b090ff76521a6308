"""Personal data that form fields declare: autocomplete, input type, or their name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask_short
from .spans import ascii_borders

#: What a field holds by its autocomplete token; fixed values.
AUTOCOMPLETE = {
    "name": "person_name", "given-name": "person_name", "additional-name": "person_name", "family-name": "person_name", "nickname": "person_name",
    "honorific-prefix": "person_name", "honorific-suffix": "person_name", "organization": "org_name", "street-address": "postal_address",
    "address-line1": "postal_address", "address-line2": "postal_address", "address-line3": "postal_address", "address-level1": "postal_address",
    "address-level2": "postal_address", "postal-code": "pincode", "country": "postal_address", "country-name": "postal_address", "email": "email",
    "tel": "phone", "tel-national": "phone", "tel-local": "phone", "bday": "date_of_birth", "bday-day": "date_of_birth", "bday-month": "date_of_birth",
    "bday-year": "date_of_birth", "cc-number": "payment_field", "cc-name": "payment_field", "cc-exp": "payment_field", "cc-exp-month": "payment_field",
    "cc-exp-year": "payment_field", "cc-csc": "payment_field", "cc-type": "payment_field", "current-password": "credential_field",
    "new-password": "credential_field", "one-time-code": "credential_field", "username": "identity_field",
}
INPUT_TYPES = {"password": "credential_field", "email": "email", "tel": "phone"}
#: What a field's names say, in the order in which they are tried; fixed values.
KEYWORDS = [
    (r"\b(aadhaar|aadhar|uidai|आधार)\b", "aadhaar", "high"),
    (r"\bpan[\s_-]?(card|no|number)\b|\bpermanent account\b", "pan", "high"),
    (r"\bgstin?\b", "gstin", "high"),
    (r"\bifsc\b", "ifsc", "high"),
    (r"\b(account[\s_-]?(no|number)|acct[\s_-]?no)\b", "bank_account", "high"),
    (r"\b(upi|vpa)[\s_-]?(id)?\b", "upi_id", "high"),
    (r"\bpassport\b", "passport", "high"),
    (r"\b(voter|epic)[\s_-]?(id|no)\b", "voter_id", "high"),
    (r"\b(cvv|cvc|card[\s_-]?(no|number)|expiry)\b", "payment_field", "high"),
    (r"\b(pin[\s_-]?code|postal[\s_-]?code|zip(?:[\s_-]?code)?)\b", "pincode", "high"),
    (r"\b(password|passcode|m?pin|atm[\s_-]?pin|upi[\s_-]?pin|transaction[\s_-]?pin|t[\s_-]?pin)\b(?![\s_-]?code)", "credential_field", "high"),
    (r"\b(otp|one[\s_-]?time)\b", "credential_field", "high"),
    (r"\b(api[\s_-]?key|secret|access[\s_-]?token|auth[\s_-]?token|bearer|private[\s_-]?key)\b", "credential_field", "medium"),
    (r"\b(dob|date[\s_-]?of[\s_-]?birth|birth[\s_-]?date)\b", "date_of_birth", "high"),
    (
        r"\b(full[\s_-]?name|first[\s_-]?name|last[\s_-]?name|surname|given[\s_-]?name|family[\s_-]?name|display[\s_-]?name|account[\s_-]?name|profile[\s_-]?name|"
        r"screen[\s_-]?name|user[\s_-]?name|nick[\s_-]?name|your[\s_-]?name|name[\s_-]?on[\s_-]?(card|account))\b",
        "person_name", "medium",
    ),
    (r"\b(address|street|locality)\b", "postal_address", "medium"),
    (r"\b(mobile|phone|contact[\s_-]?(no|number))\b", "phone", "medium"),
]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def field_findings(nodes: DataFrame, not_names: list[str] | None = None) -> DataFrame:
    """One row per form field that declares personal data, by projection alone.

    ``nodes`` has node_id, tag, role, label, value and attrs (map); further columns
    go along.  Adds kind, confidence, field, value, masked and action
    (replace-field, seal-field, none).  Values of credentials and payments are not
    recorded.  ``not_names``: single words that are no name of a person or firm."""
    attr = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    words = F.split(F.lower(F.trim(attr("autocomplete"))), r"\s+")
    declared = F.try_element_at(F.filter(F.transform(words, lambda t: F.try_element_at(_map(AUTOCOMPLETE), t)), lambda k: k.isNotNull()), F.lit(1))
    by_type = F.try_element_at(_map(INPUT_TYPES), F.lower(attr("type")))
    named = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (F.col("label"), attr("name"), attr("id"), attr("placeholder"))])
    nothing = F.lit(None).cast("struct<kind:string,confidence:string>")
    word = nothing
    for pattern, kind, confidence in reversed(KEYWORDS):
        word = F.when(named.rlike(f"(?i){ascii_borders(pattern)}"), F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))).otherwise(word)
    sure = lambda k: F.when(k.isNotNull(), F.struct(k.alias("kind"), F.lit("certain").alias("confidence")))
    fields = nodes.where(F.col("role").isin("textbox", "password", "select") | F.col("tag").isin("input", "textarea"))
    hit = fields.withColumn("_hit", F.coalesce(sure(declared), sure(by_type), word)).where("_hit is not null")
    hit = hit.withColumn("kind", F.col("_hit.kind")).withColumn("confidence", F.col("_hit.confidence")).drop("_hit")
    filled = F.col("value").isNotNull() | (attr("filled") == "true")
    common = F.col("kind").isin("person_name", "org_name") & ~F.trim("value").rlike(r"\s") & F.regexp_replace(F.lower("value"), r"[^\p{L}]", "").isin(not_names or [""])
    hit = hit.withColumn("_filled", filled).withColumn("value", F.when(~F.col("kind").isin("credential_field", "payment_field") & ~common & (F.col("value") != ""), F.col("value")))
    action = F.when(F.col("value").isNotNull(), "replace-field").when(F.col("_filled"), "seal-field").otherwise("none")
    masked = F.when(F.col("value").isNotNull(), mask_short(F.col("value"))).when(F.col("_filled"), "«filled, never captured»").otherwise("«empty field»")
    return hit.withColumn("action", action).withColumn("masked", masked).withColumn("field", F.when(F.col("action") == "none", "label").otherwise("value")).drop("_filled")
