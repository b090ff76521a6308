"""Detection over captures: rows of nodes with texts, values, labels and attributes.

A node row has capture_id, node_id, tag, role, label, text, value and attrs (map),
and optionally bbox (struct of x, y, w, h) and visible.  A finding row has
capture_id, node_id, field, tier (1 form fields, 2 patterns, 3 names and pixels),
shape (text, pixel), kind, confidence, rule, start, end, value, masked, action.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mask
from ..store import stored
from .entities import declared_names, entity_findings, name_cells
from .fields import field_findings
from .rules import RANK, rejected, scan_text
from .spans import ascii_borders

_ATTRIBUTES = "alt title placeholder email data-email data-hovercard-id name aria-label data-name data-user-name data-sender".split()
#: Fields in the order in which they are rewritten, and so numbered; fixed values.
FIELDS = ["text", "value", "label", *(f"attr:{a}" for a in _ATTRIBUTES)]
#: Fields in which names are sought; fixed values.
NAME_FIELDS = ["text", "value", "label", "attr:alt", "attr:title", "attr:name", "attr:aria-label"]
FINDING = ["capture_id", "node_id", "field", "tier", "shape", "kind", "confidence", "rule", "start", "end", "value", "masked", "action"]


def field_text(field: str) -> Column:
    """A field of a node; '' where it has none."""
    value = F.try_element_at("attrs", F.lit(field[5:])) if field.startswith("attr:") else F.col(field)
    return F.coalesce(value, F.lit(""))


def field_rows(nodes: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(capture_id, node_id, tag, ord, field, text): one row of each field that is not empty."""
    parts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), field_text(f).alias("text")) for i, f in enumerate(fields)])
    return nodes.select("capture_id", "node_id", "tag", F.explode(F.filter(parts, lambda x: x["text"] != "")).alias("x")).select("capture_id", "node_id", "tag", "x.*")


def _finding(df: DataFrame, tier: int, shape: str = "text", action: str = "replace-span") -> DataFrame:
    out = df.withColumn("tier", F.lit(tier)).withColumn("shape", F.lit(shape))
    for name, value in (("masked", mask(F.col("value"))), ("action", F.lit(action)), ("rule", F.lit(None)), ("start", F.lit(None)), ("end", F.lit(None))):
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out.select(*[F.col(c).cast("int") if c in ("rule", "start", "end") else F.col(c) for c in FINDING])


def pattern_findings(nodes: DataFrame) -> DataFrame:
    """Tier 2: the rules over every field."""
    rows = field_rows(nodes).select(F.struct("capture_id", "node_id", "field").alias("k"), "text")
    return _finding(scan_text(rows, "k", "text").select("k.*", "kind", "confidence", "rule", "start", "end", "value"), 2)


def name_findings(nodes: DataFrame, prior: DataFrame, aggressive: bool = False) -> DataFrame:
    """Tier 3: names and addresses.  Spans of ``prior`` findings are taken, also of
    those that will be suppressed."""
    spans = prior.where("shape = 'text' and start is not null").groupBy("capture_id", "node_id", "field").agg(F.collect_list(F.struct("start", "end")).alias("claimed"))
    rows = field_rows(nodes, NAME_FIELDS).join(spans, ["capture_id", "node_id", "field"], "left").join(declared_names(nodes, prior), "capture_id", "left")
    rows = rows.withColumn("whole", (F.col("tag") == "address") & (F.col("field") == "text"))
    if "bbox" in nodes.columns:
        cells = name_cells(nodes).withColumn("field", F.lit("text"))
        rows = rows.withColumn("node_id", F.col("node_id").cast("long")).join(cells, ["capture_id", "node_id", "field"], "left")
    found = entity_findings(rows, ["capture_id", "node_id", "field"], aggressive=aggressive)
    return _finding(found.withColumn("node_id", F.col("node_id").cast(nodes.schema["node_id"].dataType)), 3)


# What paints an image, hosts of profile pictures, what labels say of a picture; fixed values.
_AVATARS = (
    r"(?i)(gravatar|ui-avatars|avatars\.githubusercontent|lh[3-6]\.googleusercontent|ggpht|pbs\.twimg|abs\.twimg|fbcdn|media\.licdn|licdn\.com/dms/image|graph\.facebook|dicebear|robohash|"
    r"secure\.gravatar|avatars\.slack-edge|ca\.slack-edge|cdn\.discordapp\.com/avatars)"
)
_PICTURES = "img canvas svg video picture object embed iframe frame".split()
_SAID = [
    (r"\b(signature|sign here|e-?sign|autograph)\b", "signature", "high"),
    (r"\b(aadhaar|aadhar|pan card|passport|licence|license|voter id|id ?card|kyc)\b", "scanned_document", "high"),
    (r"\b(qr|barcode)\b", "qr_code", "high"),
    (r"\b(photo|photograph|selfie|portrait|headshot|profile ?(pic|picture|photo)|avatar|dp)\b", "face_or_photo", "medium"),
    (r"\b(scan|scanned|upload(ed)? document|proof)\b", "scanned_document", "low"),
]
LEAST_SIDE, AVATAR_SIDE = 24, 160
Classifier = Callable[[DataFrame], Column]


def pixel_findings(nodes: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Tier 3: pictures that may show a person or a document, by what stands around
    them, and frames, which nobody can look into.  ``classifier`` gives a struct of
    kind and confidence, or null, and goes first."""
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    w, h, host = F.col("bbox.w"), F.col("bbox.h"), F.coalesce(attr("srcHost"), attr("bgHost"))
    said = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (F.col("label"), attr("alt"), attr("title"), attr("id"), attr("data-testid"), attr("aria-label"), host)])
    verdict = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    square = (F.col("tag").isin("img") | (F.coalesce(attr("bgHost"), F.lit("")) != "")) & (w / h > 0.8) & (w / h < 1.25) & (w < AVATAR_SIDE)
    out = F.when(host.rlike(_AVATARS), verdict("face_or_photo", "high")).when(F.col("tag") == "canvas", verdict("scanned_document", "low")).when(square, verdict("face_or_photo", "low"))
    for pattern, kind, confidence in reversed(_SAID):
        out = F.when(said.rlike(f"(?i){ascii_borders(pattern)}"), verdict(kind, confidence)).otherwise(out)
    out = F.when(F.col("tag").isin("iframe", "frame"), verdict("unverified_region", "certain")).otherwise(out)
    out = F.when((w >= LEAST_SIDE) & (h >= LEAST_SIDE), out)
    rows = nodes.where(F.col("tag").isin(_PICTURES) | (F.coalesce(attr("bgHost"), F.lit("")) != ""))
    rows = rows.withColumn("v", F.coalesce(classifier(nodes), out) if classifier else out).where("v is not null")
    rows = rows.select("capture_id", "node_id", F.lit(None).cast("string").alias("field"), "v.*", F.lit(None).cast("string").alias("value"), F.concat(F.lit("«"), F.replace("v.kind", F.lit("_"), F.lit(" ")), F.lit("»")).alias("masked"))
    return _finding(rows, 3, "pixel", "burn-region")


def suppress_covered(found: DataFrame) -> DataFrame:
    """Without tier-2 findings in a field that tier 1 is certain of, unless certain themselves."""
    sure = found.where("tier = 1 and confidence = 'certain' and field is not null").select("capture_id", "node_id", "field", F.lit(True).alias("_sure")).distinct()
    joined = found.join(sure, ["capture_id", "node_id", "field"], "left")
    return joined.where("_sure is null or tier <> 2 or confidence = 'certain'").select(*found.columns)


#: Takes nodes and the findings so far, gives further findings (the columns of FINDING).
Detector = Callable[[DataFrame, DataFrame], DataFrame]


def detect(nodes: DataFrame, *, aggressive: bool = False, classifier: Classifier | None = None, detectors: list[Detector] | None = None) -> DataFrame:
    """All findings of captures.  Each tier sees what the earlier ones found, and
    ``detectors`` of the caller's see them all; what tier 1 covers is dropped only at
    the end, so it has claimed its span and named its names before."""
    told = field_findings(nodes).select("capture_id", "node_id", "field", "kind", "confidence", "value", "masked", "action")
    prior = stored(_finding(told, 1).unionByName(pattern_findings(nodes)), "prior")
    found = prior.unionByName(name_findings(nodes, prior, aggressive))
    if "bbox" in nodes.columns:
        found = found.unionByName(pixel_findings(nodes, classifier))
    for more in detectors or []:
        found = found.unionByName(more(nodes, found).select(*FINDING))
    return suppress_covered(stored(found, "findings"))


def ranked(found: DataFrame) -> DataFrame:
    """In order: the surest first, then by tier, node and place."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return found.orderBy("capture_id", rank[F.col("confidence")], "tier", "node_id", "start")


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes named by (capture_id, node_id) pairs; ids that are not there name nothing."""
    return nodes.join(ids.select("capture_id", "node_id").distinct(), ["capture_id", "node_id"], "left_semi")


def is_visible(viewport_height: Column) -> Column:
    """Whether a node's box meets the screen, of which it holds the top and height."""
    return (F.col("bbox.y") < viewport_height) & (F.col("bbox.y") + F.col("bbox.h") > 0)


def covered_values(found: DataFrame) -> DataFrame:
    """(capture_id, n): distinct values by kind that were read from pictures and covered."""
    return found.groupBy("capture_id").agg(F.count_distinct("kind", "value").alias("n"))


def text_nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Plain texts as captures of one paragraph each; blank ones are left out."""
    return df.where(F.regexp_replace(text_col, ascii_borders(r"\s+"), "") != "").select(
        F.col(id_col).alias("capture_id"), F.lit(1).alias("node_id"), F.lit("p").alias("tag"), F.lit("paragraph").alias("role"), F.lit("").alias("label"), F.col(text_col).alias("text"),
        F.lit(None).cast("string").alias("value"), F.create_map().cast("map<string,string>").alias("attrs"),
    )


def detection_stats(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Per capture: nodes_scanned, chars_scanned, checksum_rejected, and findings by tier and shape."""
    chars = sum((F.length(field_text(f)) for f in ("text", "value", "label")), F.lit(0))
    size = nodes.groupBy("capture_id").agg(F.count(F.lit(1)).alias("nodes_scanned"), F.sum(chars).alias("chars_scanned"))
    refused = field_rows(nodes).select("capture_id", rejected(F.col("text")).alias("n")).groupBy("capture_id").agg(F.sum("n").cast("long").alias("checksum_rejected"))
    by = [F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)] + [F.count_if(F.col("shape") == s).alias(f"{s}_shape") for s in ("text", "pixel")]
    counts = found.groupBy("capture_id").agg(*by)
    joined = size.join(refused, "capture_id", "left").join(counts, "capture_id", "left")
    return joined.na.fill(0, ["checksum_rejected", "tier_1", "tier_2", "tier_3", "text_shape", "pixel_shape"])


__all__ = ["detect", "detection_stats", "field_rows", "field_text", "name_findings", "pattern_findings", "pixel_findings", "ranked", "suppress_covered", "text_nodes"]
