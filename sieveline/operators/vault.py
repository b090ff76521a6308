"""Tokens in place of values: minting, rewriting and the way back.

A session is any column that groups rows; one token stands for one value of one
kind within it.  Of a sealed kind the vault keeps no value: it holds a
fingerprint, by which the same text gets the same token, and nothing leads back
from it.  A sealing without a text (a filled field that was never read) gets a
token of its own each time.  Values never leave through ``vault_view``; only
``mint_tokens`` and ``restore_texts`` handle them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, escape_tokens, preview, tokens_in

#: Prefix of the tokens of a kind; kinds that share one share its numbers.  Fixed values.
PREFIX = {
    "aadhaar": "AADHAAR", "pan": "PAN", "gstin": "GSTIN", "payment_card": "CARD", "ifsc": "IFSC", "bank_account": "ACCT", "upi_id": "UPI", "passport": "PASSPORT",
    "voter_id": "VOTERID", "vehicle_number": "VEHICLE", "driving_licence": "DL", "ssn": "SSN", "otp": "OTP", "secret": "SECRET", "phone": "PHONE", "email": "EMAIL",
    "ip_address": "IP", "pincode": "PIN", "date_of_birth": "DOB", "person_name": "NAME", "org_name": "ORG", "postal_address": "ADDR", "credential_field": "SECRET",
    "payment_field": "PAYMENT", "identity_field": "USERID", "face_or_photo": "PHOTO", "signature": "SIGNATURE", "scanned_document": "DOCUMENT", "qr_code": "QRCODE",
    "unverified_region": "FRAME",
}
#: Kinds whose value is not kept: a token stands for them, nothing resolves it.
SEALED = ["otp", "secret", "credential_field"]


def prefix_of(kind: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])
    return F.try_element_at(pairs, kind)


def fingerprint(value: Column) -> Column:
    """What stands for a sealed value: equal for equal values, no way back."""
    return F.when(value.isNotNull(), F.concat(F.sha2(value, 256), F.lit("-"), F.length(value).cast("string")))


def is_sealed(kind: Column) -> Column:
    return kind.isin(SEALED)


def mint_tokens(found: DataFrame, session: str, order: list[str]) -> DataFrame:
    """(session, kind, value, fingerprint, token): one token a distinct value, numbered
    within a session and prefix by first appearance in ``order``.  ``value`` is null
    for sealed kinds, ``fingerprint`` for all others.  Where ``found`` has a column
    ``sealed``, its true rows are sealings without a text, one token each; such a
    token carries its place in ``order`` as the fingerprint.

    Values are grouped before they are numbered, so a value that recurs crosses
    the wire once a task; the numbering sorts one session's distinct values.  A
    finding of a kind without a prefix is an error."""
    rows = found.withColumn("prefix", F.coalesce(prefix_of(F.col("kind")), F.raise_error(F.concat(F.lit("no token for kind "), F.col("kind")))))
    secret = is_sealed(F.col("kind"))
    print_of = F.when(secret, fingerprint(F.col("value")))
    if "sealed" in found.columns:
        print_of = F.when(F.col("sealed"), F.to_json(F.struct(*order))).otherwise(print_of)
        rows = rows.where(F.col("sealed") | F.col("value").isNotNull()).withColumn("value", F.when(~F.col("sealed"), F.col("value")))
    else:
        rows = rows.where(F.col("value").isNotNull())
    rows = rows.withColumn("fingerprint", print_of).withColumn("value", F.when(~secret, F.col("value")))
    first = rows.groupBy(session, "kind", "value", "fingerprint", "prefix").agg(F.min(F.struct(*order)).alias("first"))
    number = F.row_number().over(Window.partitionBy(session, "prefix").orderBy("first", "kind", "value", "fingerprint"))
    return first.select(session, "kind", "value", "fingerprint", F.concat(F.lit("<"), F.col("prefix"), F.lit("_"), number.cast("string"), F.lit(">")).alias("token"))


def forget(vault: DataFrame, ended: DataFrame, session: str) -> DataFrame:
    """The vault without the sessions that have ended: their tokens become unknown."""
    return vault.join(ended.select(session).distinct(), session, "left_anti")


def vault_view(vault: DataFrame) -> DataFrame:
    """The vault without its values; sealed kinds show nothing."""
    return vault.select(*[c for c in vault.columns if c not in ("value", "fingerprint")], preview(F.col("value")).alias("preview"))


def with_tokens(found: DataFrame, vault: DataFrame, session: str) -> DataFrame:
    """``found`` with the token of each finding that has a value."""
    keys = found.withColumn("_v", F.when(is_sealed(F.col("kind")), fingerprint(F.col("value"))).otherwise(F.col("value")))
    known = vault.select(session, "kind", F.coalesce("value", "fingerprint").alias("_v"), "token")
    by = list(dict.fromkeys([session, "kind", "_v"]))
    return keys.join(known, by).drop("_v")


def splice(text: Column, pieces: Column) -> Column:
    """struct<text, replaced>: ``text`` with each of ``pieces`` (structs of start, end, value, token) replaced
    by its token, taken from left to right; a piece that overlaps the one before,
    lies outside or differs from the text is skipped, and not counted.  Kept text is
    escaped."""
    fits = lambda acc, x: (x["start"] >= acc["at"]) & (x["start"] < x["end"]) & (x["end"] <= F.length(text)) & (F.substring(text, x["start"] + 1, x["end"] - x["start"]) == x["value"])
    kept = lambda acc, x: escape_tokens(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]))

    def step(acc: Column, x: Column) -> Column:
        put = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(kept(acc, x), x["token"])).alias("out"))
        return F.when(fits(acc, x), put).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), escape_tokens(F.substring(text, acc["at"] + 1, F.length(text))))
    end = lambda acc: F.struct(rest(acc).alias("text"), (F.size(acc["out"]) / 2).cast("int").alias("replaced"))
    return F.aggregate(F.array_sort(pieces), start, step, end)


def rewrite_texts(df: DataFrame, found: DataFrame, vault: DataFrame, key: list[str], session: str, text_col: str) -> DataFrame:
    """``df`` with the findings in ``text_col`` replaced by tokens.  ``key`` identifies
    a row of ``df`` and of ``found``; rows without findings are escaped alone."""
    pieces = with_tokens(found, vault, session).groupBy(*key).agg(F.collect_list(F.struct("start", "end", "value", "token")).alias("_pieces"))
    joined = df.join(pieces, key, "left")
    text = F.col(text_col)
    out = F.when(F.col("_pieces").isNull(), escape_tokens(text)).otherwise(splice(text, F.col("_pieces"))["text"])
    return joined.withColumn(text_col, out).drop("_pieces")


def restore_texts(df: DataFrame, vault: DataFrame, session: str, text_col: str) -> DataFrame:
    """``df`` with known tokens replaced by their values, in one pass so that values
    that look like tokens stay, and ``sealed`` and ``unknown``: the tokens left.

    What a text becomes depends on its session and its characters alone.  So the tokens
    of each distinct text meet the vault in a join by session and token, and what they
    say comes back to the rows by session and digest of the text: rows get no number,
    which a second computation could give to others."""
    text = F.col(text_col)
    asked = df.select(F.col(session).alias("_of"), F.sha2(text, 256).alias("_digest"), F.explode(tokens_in(text)).alias("_token")).distinct()
    known = vault.select(F.col(session).alias("_s"), F.col("token").alias("_t"), F.col("value").alias("_value"), F.lit(True).alias("_known"))
    told = asked.join(known, (F.col("_of") == F.col("_s")) & (F.col("_token") == F.col("_t")), "left")
    per_text = told.groupBy("_of", "_digest").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("_token", "_value")))).alias("_values"),
        F.array_sort(F.collect_list(F.when(F.col("_known") & F.col("_value").isNull(), F.col("_token")))).alias("_sealed"),
        F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.col("_token")))).alias("_unknown"),
    )
    joined = df.withColumn("_own", F.sha2(text, 256)).join(per_text, F.col(session).eqNullSafe(F.col("_of")) & (F.col("_own") == F.col("_digest")), "left")
    # what stands between tokens, and the tokens; the former are one more
    gaps, tokens = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    put = lambda gap, token: F.concat(gap, F.coalesce(F.try_element_at(F.col("_values"), token), token, F.lit("")))
    restored = F.when(F.col("_values").isNull(), text).otherwise(F.array_join(F.zip_with(gaps, tokens, put), ""))
    no = F.when(text.isNotNull(), F.array().cast("array<string>"))
    out = joined.withColumn("sealed", F.coalesce("_sealed", no)).withColumn("unknown", F.coalesce("_unknown", no)).withColumn(text_col, restored)
    return out.drop("_of", "_digest", "_own", "_values", "_sealed", "_unknown")
