"""Whether an action on a page may go ahead: allow, confirm or refuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.spans import ascii_borders
from .text import let, spaced, strip

# Words of fields for credentials, fields for identifiers, and controls with consequences; fixed values.
CREDENTIALS = r"\b(?:password|passcode|cvv|cvc|card\s*number|credit\s*card|debit\s*card|expiry|one[-\s]?time\s*(?:code|password)|otp|api[-\s]?key|secret|security\s*(?:code|answer))\b"
IDENTIFIERS = (
    r"\b(?:aadhaar|aadhar|pan\s*(?:card|number)|permanent\s*account|passport|ssn|social\s*security|ifsc|account\s*number|voter\s*(?:id|card)|driving\s*licen[cs]e|gstin?)\b"
)
IRREVERSIBLE = (
    r"\b(?:buy|purchase|place\s*order|checkout|pay|payment|send|reply|forward|post|publish|tweet|share|delete|remove|discard|erase|deactivate|close\s*account|confirm|submit|book\s*now|"
    r"reserve|apply\s*now|transfer|withdraw|donate|subscribe|upgrade|sign\s*up|create\s*account|register|accept|agree)\b"
)
_SENDS = r"\b(?:message|messages|chat|comment|reply|post|tweet|send|respond)\b"
_ORDINARY = r"recipient|subject|body|compose|note|description|title|\btags?\b"
_RESTRICTED = ["chrome://", "chrome-extension://", "edge://", "about:", "devtools://", "https://chromewebstore.google.com"]
_ENTRY_ROLES, _ENTRY_TYPES = "textbox searchbox combobox password".split(), ["", *"text search email url tel number password".split()]
#: Spellings of keys; fixed values.
KEYS = {
    "enter": "Enter", "return": "Enter", "esc": "Escape", "escape": "Escape", "tab": "Tab", "space": " ", "spacebar": " ", "backspace": "Backspace", "delete": "Delete", "del": "Delete",
    "up": "ArrowUp", "down": "ArrowDown", "left": "ArrowLeft", "right": "ArrowRight", "arrowup": "ArrowUp", "arrowdown": "ArrowDown", "arrowleft": "ArrowLeft", "arrowright": "ArrowRight",
    "home": "Home", "end": "End", "pageup": "PageUp", "pagedown": "PageDown",
}


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){ascii_borders(pattern)}")


def _attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def describe(node: Column) -> Column:
    """The words a page uses for an element."""
    return F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (node["label"], node["text"], _attr(node, "name"), _attr(node, "placeholder"), _attr(node, "aria-label"))])


def looks_credential(node: Column) -> Column:
    kind = F.lower(_attr(node, "type"))
    told = (node["role"] == "password") | (kind == "password") | _says(F.concat_ws(" ", describe(node), _attr(node, "type")), CREDENTIALS)
    return F.coalesce(node.isNotNull() & told, F.lit(False))


def looks_identifier(node: Column) -> Column:
    return F.coalesce(node.isNotNull() & _says(describe(node), IDENTIFIERS), F.lit(False))


def is_restricted(url: Column) -> Column:
    """Pages on which nothing can run; also no page at all."""
    out = F.coalesce(url, F.lit("")) == ""
    for start in _RESTRICTED:
        out = out | url.startswith(start)
    return F.coalesce(out, F.lit(True))


def parse_key(raw: Column) -> Column:
    """struct<key, ctrl, shift, alt, meta> of a combination such as "ctrl+shift+Enter";
    blanks are the space key, also after a plus."""
    blank = (F.length(raw) > 0) & (strip(raw) == "")
    parts = F.filter(F.transform(F.split(raw, r"\+"), strip), lambda p: p != "")
    parts = F.when(blank, F.array(F.lit(" "))).when(raw.rlike(spaced(r"\+\s+$")), F.concat(parts, F.array(F.lit(" ")))).otherwise(parts)
    names = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])

    def told(p: Column) -> Column:
        last = F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(""))
        mods = F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.lower)
        has = lambda *words: F.arrays_overlap(mods, F.array(*map(F.lit, words)))
        return F.struct(
            F.coalesce(F.try_element_at(names, F.lower(last)), last).alias("key"), has("ctrl", "control").alias("ctrl"), has("shift").alias("shift"), has("alt", "option").alias("alt"),
            has("meta", "cmd", "command").alias("meta"),
        )

    return let(parts, told)


def is_text_entry(node: Column) -> Column:
    return node["role"].isin(_ENTRY_ROLES) | (node["tag"] == "textarea") | ((node["tag"] == "input") & _attr(node, "type").isin(_ENTRY_TYPES))


def _verdict(name: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("verdict"), (text if text is not None else F.lit(None)).cast("string").alias("reason"))


def _quoted(node: Column, most: int) -> Column:
    words = F.when(node.isNotNull(), F.left(describe(node), F.lit(most)))
    return F.coalesce(F.concat(F.lit('"'), F.replace(words, F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("this field"))


def enter_in_field(node: Column, title: Column, verb: str) -> Column:
    """Null where Enter in this field does no harm, else what to confirm."""
    words = F.concat_ws(" ", describe(node), node["role"])
    sends = _says(words, _SENDS) & ~_says(words, r"\bbody\b")
    heading = F.coalesce(F.nullif(node["label"], F.lit("")), describe(node)).rlike(f"(?i){ascii_borders(r'^\s*(?:to|cc|bcc)\b')}")
    searches = _says(words, "search|query|find|filter") | (node["role"] == "searchbox")
    ordinary = ~sends & (_says(words, _ORDINARY) | heading | (node["role"] == "combobox"))
    ask = F.concat(F.lit(f"{verb} "), _quoted(node, 40), F.when(sends, " and press Enter on ").otherwise(" and submit the form on "), title, F.lit("?"), F.when(sends, " In a chat or comment box, Enter sends it.").otherwise(""))
    return F.when(~searches & ~ordinary, _verdict("confirm", ask))


def gate(name: Column, node: Column, focused: Column, *, text: Column, key: Column, submit: Column, confirm_risky: Column, title: Column) -> Column:
    """struct<verdict, reason> of an action ``name`` on ``node`` while ``focused`` has the focus.

    In this order: an identifier is confirmed, a credential field and a key-like or
    card-like text refused, whatever the user's setting; then, with ``confirm_risky``,
    clicks on words with consequences, typing that submits, and keys that send."""
    title = F.coalesce(title, F.lit("this page"))
    typed = F.coalesce(text, F.lit(""))
    keyish = typed.rlike(r"^(sk-|ghp_|xox[baprs]-|AKIA)") | F.regexp_replace(typed, spaced(r"[\s-]"), "").rlike(ascii_borders(r"\b\d{13,19}\b"))
    typing = (
        F.when(looks_identifier(node), _verdict("confirm", F.concat(F.lit("Fill "), _quoted(node, 40), F.lit(" with the identifier it asks for?"))))
        .when(looks_credential(node), _verdict("refuse", F.concat(_quoted(node, 40), F.lit(" looks like a field for a credential or a payment; the user should fill it in."))))
        .when(keyish, _verdict("refuse", F.lit("The text looks like an API key or a card number; the user should enter it.")))
    )
    risky = lambda n: n.isNotNull() & _says(F.concat_ws(" ", describe(n), n["role"]), IRREVERSIBLE)
    click = F.when(risky(node), _verdict("confirm", F.concat(F.lit("Click "), _quoted(node, 60), F.lit(" on "), title, F.lit("?"))))
    fill = F.when(F.coalesce(submit, F.lit(False)) & node.isNotNull(), enter_in_field(node, title, "Fill"))

    def pressed(combo: Column) -> Column:
        enter = combo["key"] == "Enter"
        send = F.concat(F.lit("Press "), key, F.lit(" on "), title, F.lit("? In most apps this sends or submits what is being written."))
        on = F.concat(F.lit("Press "), F.when(enter, "Enter").otherwise("Space"), F.lit(" on "), _quoted(focused, 60), F.lit(" on "), title, F.lit("?"))
        entry = focused.isNotNull() & is_text_entry(focused)
        return (
            F.when(enter & (combo["ctrl"] | combo["meta"]), _verdict("confirm", send)).when(enter & entry, enter_in_field(focused, title, "Press Enter in"))
            .when((enter | (combo["key"] == " ")) & ~entry & risky(focused), _verdict("confirm", on))
        )

    risk = F.when(name == "click", click).when(name == "type", fill).when(name == "key", let(parse_key(F.coalesce(key, F.lit(""))), pressed))
    return F.coalesce(F.when(name == "type", typing), F.when(confirm_risky, risk), _verdict("allow"))
