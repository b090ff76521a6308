"""Captures and texts without their personal data, and what is left behind.

detect -> vault -> rewritten nodes -> residual, each a DataFrame; the vault's
values stay with the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..store import stored
from .capture import FIELDS, detect, field_rows, text_nodes
from .vault import mint_tokens, splice, with_tokens

ORDER = ["capture_id", "node_id", "ord", "start"]


def origin(url: Column) -> Column:
    """Scheme and host of a URL; the rest may carry an id."""
    return F.nullif(F.regexp_extract(url, r"^((?i:[a-z][a-z0-9+.-]*)://[^/?#]*)", 1), F.lit(""))


def planned(found: DataFrame) -> DataFrame:
    """Findings that rewrite a field: the first whole-field one, or else all spans."""
    order = F.create_map(*[x for i, f in enumerate(FIELDS) for x in (F.lit(f), F.lit(i))])
    rows = found.where("shape = 'text' and field is not null and action in ('replace-span', 'replace-field', 'seal-field')").withColumn("ord", order[F.col("field")])
    whole = F.col("action") != "replace-span"
    first = rows.where(whole).groupBy("capture_id", "node_id", "field").agg(F.min(F.struct("tier", "rule", "kind")).alias("_first"))
    joined = rows.join(first, ["capture_id", "node_id", "field"], "left")
    keep = F.col("_first").isNull() | (whole & (F.struct("tier", "rule", "kind").eqNullSafe(F.col("_first"))))
    return joined.where(keep).drop("_first").withColumn("sealed", F.col("action") == "seal-field")


def rewrite_fields(nodes: DataFrame, plan: DataFrame, vault: DataFrame, session: str) -> DataFrame:
    """(capture_id, node_id, ord, field, text, replaced, skipped, whole): each field with tokens in place."""
    spans = with_tokens(plan.where("action = 'replace-span'"), vault, session).groupBy("capture_id", "node_id", "field").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "token"))).alias("_p"))
    values = with_tokens(plan.where("action = 'replace-field'"), vault, session).select("capture_id", "node_id", "field", F.col("token").alias("_t"), F.lit("replaced").alias("_how"))
    order = F.to_json(F.struct(*[F.col(c) for c in ORDER]))
    seals = plan.where("sealed").withColumn("fingerprint", order).join(vault.select(session, "kind", "fingerprint", F.col("token").alias("_t")), [session, "kind", "fingerprint"])
    seals = seals.select("capture_id", "node_id", "field", "_t", F.lit("sealed").alias("_how"))
    keys = ["capture_id", "node_id", "field"]
    whole = values.unionByName(seals).groupBy(*keys).agg(F.min("_t").alias("_t"), F.min("_how").alias("_how"))
    rows = field_rows(nodes).drop("tag").join(spans, keys, "left").join(whole, keys, "full")
    none = F.array().cast("array<struct<start:int,end:int,value:string,token:string>>")
    rows = rows.withColumn("_p", F.coalesce("_p", none)).withColumn("_s", splice(F.col("text"), F.col("_p")))
    kept = F.col("_t").isNull()
    replaced = F.when(kept, F.col("_s.replaced")).otherwise(0)
    return rows.select(*keys, F.coalesce("_t", "_s.text").alias("text"), replaced.alias("replaced"), (F.when(kept, F.size("_p")).otherwise(0) - replaced).alias("skipped"), F.col("_how").alias("whole"))


def sanitize(nodes: DataFrame, found: DataFrame | None = None, session: str = "capture_id", *, aggressive: bool = False, burn_unverified: bool = True) -> dict[str, DataFrame]:
    """``nodes`` rewritten, the ``vault``, the ``report`` of each capture, the ``findings``.

    The policy: ``aggressive`` takes bare capitalised words for names; without
    ``burn_unverified`` frames that nobody can look into are told but not burned.

    A session that spans captures is a column of ``nodes``; tokens are numbered in it
    by capture, node, field and place."""
    found = detect(nodes, aggressive=aggressive) if found is None else found
    if not burn_unverified:
        found = found.withColumn("action", F.when(F.col("kind") == "unverified_region", "none").otherwise(F.col("action")))
    if session != "capture_id":
        found = found.join(nodes.select("capture_id", session).distinct(), "capture_id")
    plan = stored(planned(found), "plan")
    vault = stored(mint_tokens(plan, session, ORDER), "vault")
    fields = stored(rewrite_fields(nodes, plan, vault, session), "fields")
    per_node = fields.groupBy("capture_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("_f"))
    joined = nodes.join(per_node, ["capture_id", "node_id"], "left")
    new = lambda f: F.try_element_at("_f", F.lit(f))
    attrs = F.transform_values("attrs", lambda k, v: F.coalesce(F.try_element_at("_f", F.concat(F.lit("attr:"), k)), v))
    out = joined.withColumn("text", new("text")).withColumn("value", new("value")).withColumn("label", F.coalesce(new("label"), F.lit(""))).withColumn("attrs", attrs).select(*nodes.columns)
    report = fields.groupBy("capture_id").agg(
        F.sum("replaced").alias("spans_replaced"), F.sum("skipped").alias("spans_skipped"), F.count_if(F.col("whole") == "replaced").alias("fields_replaced"), F.count_if(F.col("whole") == "sealed").alias("fields_sealed")
    )
    return {"nodes": out, "vault": vault, "report": report, "findings": found}


def titles(nodes: DataFrame) -> DataFrame:
    """(capture_id, title): the rewritten label of a capture's first node, never the raw title."""
    return nodes.groupBy("capture_id").agg(F.min_by("label", "node_id").alias("title"))


def residual(nodes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """What detection still finds in rewritten nodes, and in ``heads`` (capture_id, text:
    a URL or title): findings in text, other than what form fields declare, and other
    than tokens (a token behind "Password:" is no password)."""
    left = detect(nodes)
    if heads is not None:
        left = left.unionByName(detect(text_nodes(heads, "capture_id", "text")))
    return left.where("shape = 'text' and tier <> 1").where(~F.col("value").rlike(rf"^{TOKEN}\W*$"))


def sanitize_texts(df: DataFrame, id_col: str, text_col: str) -> dict[str, DataFrame]:
    """The same for plain texts: ``texts`` (id, text), vault, report, findings.  Blank texts stay as they are."""
    out = sanitize(text_nodes(df, id_col, text_col))
    safe = out["nodes"].select(F.col("capture_id").alias(id_col), F.col("text").alias("_safe"))
    texts = df.join(safe, id_col, "left").withColumn(text_col, F.coalesce("_safe", text_col)).drop("_safe")
    return {**out, "texts": texts}


def burn_report(burns: DataFrame, key: str) -> DataFrame:
    """Per key: regions_burned, regions_outside, regions_skipped and pixels_burned of ``burns``
    (fate, w, h), as ``burn_box`` tells them; pixels under several burns count for each."""
    of = lambda fate: F.count_if(F.col("fate") == fate)
    return burns.groupBy(key).agg(of("burned").alias("regions_burned"), of("outside").alias("regions_outside"), of("skipped").alias("regions_skipped"), F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0)).alias("pixels_burned"))
