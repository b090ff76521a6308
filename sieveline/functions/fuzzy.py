"""Values that were read with mistakes: folding, approximate search, slots of identifiers."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks
from .text import let, spaced

#: Letters that an image shows like a digit, and where a digit stands for a letter; fixed values.
FOLDED = {"o": "0", "i": "1", "l": "1", "|": "1", "s": "5", "b": "8", "z": "2"}
AS_DIGIT = {"O": "0", "o": "0", "Q": "0", "D": "0", "I": "1", "l": "1", "i": "1", "|": "1", "!": "1", "L": "1", "Z": "2", "z": "2", "E": "3", "A": "4", "S": "5", "s": "5", "G": "6", "b": "6", "T": "7", "Y": "7", "B": "8", "g": "9", "q": "9"}
AS_LETTER = {"0": "O", "1": "I", "2": "Z", "3": "E", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B", "9": "G", "|": "I", "!": "I"}
DOUBTFUL = {"O": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "G": "6", "B": "8"}
ALIKE = ["0OoQD", "1Iil|!", "2Zz", "3E", "4A", "5Ss", "6Gb", "7TY", "8B", "9gq"]
#: Identifiers by slots (D digit, L letter, 0 a zero, Z the letter, X either, B either but all digits if they can be), with the most corrections; fixed values.
TEMPLATES = [
    ("aadhaar", "D" * 12, 12, checks.is_aadhaar), ("aadhaar", "D" * 16, 16, checks.is_aadhaar_vid), ("gstin", "DDLLLLLDDDDLXZX", 15, checks.is_gstin), ("pan", "LLLLLDDDDL", 2, checks.is_pan),
    ("ifsc", "LLLL0BBBBBB", 6, checks.is_known_ifsc),
]
PROVEN = ["aadhaar", "gstin", "payment_card"]
IDENTIFIERS = "aadhaar pan gstin ifsc payment_card passport voter_id vehicle_number bank_account upi_id".split()
_SOLID = regex.compile(r"[\p{L}\p{N}]")


def slack(length: int) -> int:
    """Edits by which a folded value of this length may differ."""
    return 0 if length < 8 else min(2, length // 8)


@lru_cache(maxsize=65536)
def _fold_one(c: str) -> str:
    return "".join(x for x in (FOLDED.get(y, y) for y in c.lower()) if _SOLID.match(x))


@lru_cache(maxsize=65536)
def _solid(c: str) -> bool:
    return bool(_SOLID.match(c))


def _folded(text: str) -> tuple[str, list[int]]:
    """The folded form and where each of its characters stands."""
    kept = [_fold_one(c) for c in text]
    return "".join(kept), [i for i, x in enumerate(kept) for _ in x]


def folded_value(value: str) -> str:
    return _folded(value)[0]


class FoldedLine:
    """A line's folded form, where its characters stand, and at which of them a whole word may start or end."""

    def __init__(self, text: str):
        self.hay, self.places = _folded(text)
        self.starts = [i == 0 or not _solid(text[i - 1]) for i in self.places]
        self.ends = [i + 1 == len(text) or not _solid(text[i + 1]) for i in self.places]

    def windows(self, least: int, most: int):
        """The stretches of whole words of ``least`` to ``most`` characters."""
        ends = [i + 1 for i, ok in enumerate(self.ends) if ok]
        for a, ok in enumerate(self.starts):
            if ok:
                for b in ends[bisect_left(ends, a + least) : bisect_right(ends, a + most)]:
                    yield self.hay[a:b]


def _ends(needle: str, hay: str, most: int):
    """Yield (cost, start, end) of the cheapest match that ends at each place of ``hay``,
    where it costs ``most`` edits or less; a match may start anywhere."""
    letters = np.frombuffer(needle.encode("utf-32-le"), np.uint32)
    cost, start = list(range(len(needle) + 1)), [0] * (len(needle) + 1)
    for end, c in enumerate(hay, 1):
        differs = (letters != ord(c)).tolist()
        row, begin = [0], [end]
        for i, other in enumerate(differs):
            # in this order on ties: exchange, leave out, insert
            best = min((cost[i] + other, 0, start[i]), (cost[i + 1] + 1, 1, start[i + 1]), (row[i] + 1, 2, begin[i]), key=lambda x: x[:2])
            row.append(best[0])
            begin.append(best[2])
        cost, start = row, begin
        if cost[-1] <= most:
            yield cost[-1], start[-1], end


def approximate_spans(text: str, value: str) -> list[tuple[int, int]]:
    """Where ``value`` stands in ``text`` within its slack, as whole words; matches that end
    at neighbouring places are one, the cheapest and then the longest."""
    needle, (hay, places) = _folded(value)[0], _folded(text)
    most = slack(len(needle))
    if len(needle) < 4 or len(hay) < len(needle) - most:
        return []
    out: list[tuple[int, int]] = []

    def take(start: int, end: int) -> bool:
        if start >= end:
            return False
        a, b = places[start], places[end - 1] + 1
        touches = (a > 0 and _SOLID.match(text[a - 1])) or (b < len(text) and _SOLID.match(text[b]))
        if touches or (out and a < out[-1][1]):
            return False
        out.append((a, b))
        return True

    if most == 0:
        at = hay.find(needle)
        while at >= 0:
            take(at, at + len(needle))
            at = hay.find(needle, at + len(needle))
        return out
    run: list[tuple[int, int, int]] = []
    for found in [*_ends(needle, hay, most), (0, 0, len(hay) + 2)]:
        if run and found[2] != run[-1][2] + 1:
            any(take(start, end) for _, start, end in sorted(run, key=lambda x: (x[0], x[1] - x[2])))
            run = []
        run.append(found)
    return out


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row a text, with zeros behind; and the lengths."""
    lengths = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out, lengths


def near_strings(windows: list[tuple[int, str]], values: list[tuple[int, str]], most: int, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all windows and values of one group, both (group, text) without
    repeats, that differ by ``most`` edits or less.

    The values' tree of prefixes is walked level by level for all windows together,
    with the costs of the prefix against those of a window of nearly its length; a
    branch ends where all of them exceed ``most``.  So what is walked follows what is
    found, also where all values begin alike."""
    none = np.zeros(0, np.int64)
    if not windows or not values:
        return none, none
    codes, lengths = _matrix([x for _, x in values])
    groups = np.array([g for g, _ in values], np.int64)
    order = np.lexsort((*codes.T[::-1], groups))
    codes, lengths, groups = codes[order], lengths[order], groups[order]
    shared = np.zeros((len(values), codes.shape[1] + 1), bool)
    shared[1:, 0] = groups[1:] == groups[:-1]
    shared[1:, 1:] = shared[1:, :1] & np.logical_and.accumulate(codes[1:] == codes[:-1], axis=1)
    roots, before = np.unique(groups, return_inverse=True)
    levels, size = [], len(roots)
    for depth in range(1, codes.shape[1] + 1):
        first = np.flatnonzero((lengths >= depth) & ~shared[:, depth])
        node = np.cumsum((lengths >= depth) & ~shared[:, depth]) - 1
        count = np.bincount(before[first], minlength=size)
        whole = np.full(len(first), -1)
        last = np.flatnonzero(lengths == depth)
        whole[node[last]] = order[last]
        levels.append((np.cumsum(count) - count, count, codes[first, depth - 1], whole))
        before, size = node, len(first)
    found = [(none, none)]
    for lo in range(0, len(windows), at_once):
        some = windows[lo : lo + at_once]
        text, m = _matrix([x for _, x in some])
        own = np.array([g for g, _ in some], np.int64)
        node = np.minimum(np.searchsorted(roots, own), len(roots) - 1)
        w = np.flatnonzero(roots[node] == own)
        node = node[w]
        costs = [np.where(k <= m[w], max(k, 0) if k >= 0 else most + 1, most + 1).astype(np.uint8) for k in range(-most, most + 1)]
        for depth, (start, count, char, whole) in enumerate(levels, 1):
            n = count[node]
            up = np.repeat(np.arange(len(node)), n)
            child = np.arange(len(up)) - np.repeat(np.cumsum(n) - n - start[node], n)
            w, c, old = w[up], char[child], [x[up] for x in costs]
            costs, ends = [], m[w]
            for at, k in enumerate(range(-most, most + 1)):
                j = depth + k  # how much of the window stands against the prefix
                new = np.full(len(w), most + 1, np.uint8)
                if 1 <= j <= text.shape[1]:
                    new = old[at] + (text[w, j - 1] != c)
                if k < most:
                    new = np.minimum(new, old[at + 1] + 1)
                if costs and j >= 1:
                    new = np.minimum(new, costs[-1] + 1)
                costs.append(np.where((j >= 0) & (j <= ends), np.minimum(new, most + 1), most + 1).astype(np.uint8))
            keep = np.minimum.reduce(costs) <= most
            w, node, costs = w[keep], child[keep], [x[keep] for x in costs]
            if not len(w):
                break
            for at, k in enumerate(range(-most, most + 1)):
                hit = np.flatnonzero((whole[node] >= 0) & (m[w] == depth + k) & (costs[at] <= most))
                found.append((w[hit] + lo, whole[node[hit]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: A cell holds its cost, then which step led to it, then where its match starts.
_COST, _STEP = 1 << 34, 1 << 32
#: Cells of the search that are held at once.
_CELLS = 1 << 20


def approximate_spans_of(lines: list[FoldedLine], line: np.ndarray, needles: list[str], needle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, start, end): what ``approximate_spans`` finds for each pair of a line and a
    folded value that may differ, by places in both lists; pairs of equal length go together."""
    out = [(np.zeros(0, np.int64),) * 3]
    sizes = np.array([len(x) for x in needles], np.int64)[needle]
    width = np.array([len(x.hay) for x in lines], np.int64)[line]
    for size in np.unique(sizes).tolist():
        # long lines apart from short ones
        same = np.flatnonzero(sizes == size)
        same = same[np.argsort(width[same], kind="stable")]
        at = 0
        while at < len(same):
            n = max(1, _CELLS // max(1, int(width[same[at]])))
            part = same[at : at + n]
            part = part[: np.searchsorted(width[part], 2 * width[part[0]] + 16, side="right")]
            at += len(part)
            rows, own = np.unique(line[part], return_inverse=True)
            have, mine = np.unique(needle[part], return_inverse=True)
            out.append(_settled(part, [lines[i] for i in rows.tolist()], own, _matrix([needles[i] for i in have.tolist()])[0][mine].T, slack(size)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _settled(pairs: np.ndarray, rows: list[FoldedLine], own: np.ndarray, letters: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, count = letters.shape
    text, lengths = _matrix([x.hay for x in rows])
    n = text.shape[1]
    padded = lambda xs, kind: np.array([x + [0] * (n - len(x)) for x in xs], kind).reshape(len(rows), n)
    places, starts, ends = padded([x.places for x in rows], np.int64), padded([x.starts for x in rows], bool), padded([x.ends for x in rows], bool)
    text = np.ascontiguousarray(text[own].T)
    cells = [np.full(count, i * _COST) for i in range(size + 1)]
    last = np.zeros((n, count), np.int64)
    for j in range(n):
        left, diagonal = np.full(count, j + 1), cells[0]
        cells[0] = left
        for i in range(size):
            here = diagonal + np.where(letters[i] != text[j], _COST, 0)
            diagonal = cells[i + 1]
            np.minimum(here, diagonal + (_COST + _STEP), out=here)
            np.minimum(here, left + (_COST + 2 * _STEP), out=here)
            here &= ~(3 * _STEP)
            cells[i + 1] = left = here
        last[j] = left
    cost, start = last >> 34, last & (_STEP - 1)
    end = np.arange(1, n + 1)[:, None]
    hit = (cost <= most) & (end <= lengths[own])
    run = np.cumsum(hit & ~np.concatenate((np.zeros((1, count), bool), hit[:-1])), axis=0)
    first = np.minimum(start, n - 1)
    good = hit & (start < end) & starts[own, first] & ends[own].T
    a, b = places[own, first], places[own].T + 1
    rank = np.where(good, (cost << 32) + start - end, np.iinfo(np.int64).max)
    told, until = [], np.zeros(count, np.int64)
    for k in range(1, int(run.max(initial=0)) + 1):
        here = np.where((run == k) & (a >= until), rank, np.iinfo(np.int64).max)
        best = here.argmin(axis=0)
        some = np.flatnonzero(here[best, np.arange(count)] < np.iinfo(np.int64).max)
        told.append((pairs[some], a[best[some], some], b[best[some], some]))
        until[some] = told[-1][2]
    return tuple(np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64),) * 3


def could_misread(read: Column, truth: Column) -> Column:
    """Whether every character of ``read`` is that of ``truth`` or looks like it."""
    shape = [(c, str(i)) for i, group in enumerate(ALIKE) for c in group]
    # G and b, B and 8: each look-alike is in one group, so a group's number stands for it
    by = lambda t: F.translate(t, "".join(c for c, _ in shape), "".join(n for _, n in shape))
    same = F.zip_with(F.split(read, ""), F.split(truth, ""), lambda r, t: (F.upper(r) == F.upper(t)) | ((by(r) == by(t)) & by(r).rlike("^[0-9]$")))
    # cheap, and true of all that pass: alike when whatever is linked by look-alikes and case is one
    loose = lambda t: F.translate(F.upper(t), "OQD68BG9ILZ|!EASTY", "000000001121134577")
    return (F.length(read) == F.length(truth)) & (loose(read) == loose(truth)) & F.forall(same, lambda x: x)


def _class(characters: object) -> str:
    return "[" + "".join(sorted(characters)) + "]"


#: Of each slot: the characters that fit it, and what they become in upper case (letter slots) or as they are.
_DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ANY = "A-Za-z0-9"
_FITS = {"D": _class({*_DIGITS, *AS_DIGIT}), "L": f"[A-Za-z{''.join(AS_LETTER)}]", "0": _class({"0", *(c for c, d in AS_DIGIT.items() if d == "0")}), "Z": "[Zz27]", "X": f"[{_ANY}]", "B": f"[{_ANY}]"}


def fit_slots(raw: Column, slots: str) -> Column:
    """struct<value, corrections>: ``raw`` with each character as its slot wants it, and
    how many were changed; null where one fits nowhere."""
    runs = [(m.group()[0], m.start(), len(m.group())) for m in re.finditer(r"(.)\1*", slots)]
    up = F.upper(raw)

    def part(kind: str, start: int, n: int) -> Column:
        read, upper = F.substring(raw, start + 1, n), F.substring(up, start + 1, n)
        if kind == "D":
            return F.translate(read, "".join(AS_DIGIT), "".join(AS_DIGIT.values()))
        if kind == "L":
            return F.translate(upper, "".join(AS_LETTER), "".join(AS_LETTER.values()))
        if kind == "B":
            return F.when(upper.rlike(f"^[0-9{''.join(DOUBTFUL)}]+$"), F.translate(upper, "".join(DOUBTFUL), "".join(DOUBTFUL.values()))).otherwise(upper)
        return F.lit(kind * n) if kind in "0Z" else upper

    at = lambda t, i: F.substring(t, i + 1, 1)
    value = F.concat(*[part(*r) for r in runs])
    told = lambda v: F.struct(v.alias("value"), sum(((at(v, i) != at(up, i)).cast("int") for i in range(len(slots))), F.lit(0)).alias("corrections"))
    return F.when(raw.rlike("^" + "".join(_FITS[c] for c in slots) + r"\z"), let(value, told))


def fit_card(raw: Column) -> Column:
    """struct<value, corrections>: a card number in which a quarter of the digits at most
    were read as letters; null for all else."""
    value = F.translate(raw, "".join(AS_DIGIT), "".join(AS_DIGIT.values()))
    wrong = F.length(F.regexp_replace(raw, "[0-9]", ""))
    ok = F.length(raw).between(13, 19) & value.rlike("^[0-9]+$") & (wrong <= F.length(raw) / 4) & checks.is_payment_card(value) & checks.card_brand(value).isNotNull()
    return F.when(ok, F.struct(value.alias("value"), wrong.alias("corrections")))


def corrected_identifiers(text: Column, known: Column) -> Column:
    """array<struct<start, end, kind, value, read, corrections, proven>>: identifiers in a
    line that an image was read as, over runs of up to four words.  A run that may be
    just one of ``known`` (array of structs value, kind) is that; else the template
    with the fewest corrections counts, then a card.  Amounts are never corrected."""
    bare = lambda t: F.regexp_replace(t, spaced(r"[\s\-.:,;()]+"), "")
    truths = F.filter(F.transform(F.filter(known, lambda k: k["kind"].isin(IDENTIFIERS)), lambda k: F.struct(F.upper(bare(k["value"])).alias("bare"), k["value"].alias("value"), k["kind"].alias("kind"))), lambda k: F.length(k["bare"]) >= 8)
    from ..operators.spans import settle_spans, spans

    # whatever is named more than once is computed once, as each name in a lambda computes anew
    words = F.transform(spans(text, r"\S+"), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), bare(w["value"]).alias("bare"), w["value"].rlike(r"\d,\d").alias("amount")))

    def run(words: Column, i: Column, n: Column) -> Column:
        part = lambda p: F.struct(i.alias("i"), (-n).alias("n"), F.element_at(p, 1)["start"].alias("start"), F.element_at(p, -1)["end"].alias("end"), F.array_join(F.transform(p, lambda w: w["bare"]), "").alias("read"), F.exists(p, lambda w: w["amount"]).alias("amount"))
        return let(F.slice(words, i, n), part)

    every = lambda words: F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(words) - i + 1)), lambda n: run(words, i, n))))
    runs = F.filter(let(words, lambda w: F.when(F.size(w) > 0, every(w)).otherwise(F.array())), lambda r: F.length(r["read"]).between(10, 19))

    def best(r: Column, truths: Column) -> Column:
        return let(F.filter(truths, lambda t: could_misread(r["read"], t["bare"])), lambda snapped: of_run(r, snapped))

    def of_run(r: Column, snapped: Column) -> Column:
        first = F.get(snapped, F.lit(0))
        differ = F.size(F.filter(F.zip_with(F.split(r["read"], ""), F.split(first["bare"], ""), lambda a, b: F.upper(a) != b), lambda x: x))
        item = lambda kind, value, n, proven: F.struct(kind.alias("kind"), value.alias("value"), n.cast("int").alias("corrections"), F.lit(proven).alias("proven"))
        snap = F.when(F.size(snapped) == 1, item(first["kind"], first["value"], differ, True))

        def of_template(order: int, kind: str, slots: str, most: int, valid: Callable[[Column], Column]) -> Column:
            ranked = lambda f: F.struct(f["corrections"].alias("c"), F.lit(order).alias("o"), item(F.lit(kind), f["value"], f["corrections"], kind in PROVEN).alias("x"))
            return let(fit_slots(r["read"], slots), lambda f: F.when((f["corrections"] <= most) & valid(f["value"]), ranked(f)))

        template = F.array_min(F.array_compact(F.array(*[of_template(i, *t) for i, t in enumerate(TEMPLATES)])))["x"]
        card = let(fit_card(r["read"]), lambda f: F.when(f.isNotNull(), item(F.lit("payment_card"), f["value"], f["corrections"], True)))
        return F.coalesce(snap, F.when(~r["amount"], F.coalesce(template, card)))

    def told(r: Column, b: Column) -> Column:
        return F.when(b.isNotNull(), F.struct(r["i"].alias("i"), r["n"].alias("n"), r["start"].alias("start"), r["end"].alias("end"), b["kind"].alias("kind"), b["value"].alias("value"), r["read"].alias("read"), b["corrections"].alias("corrections"), b["proven"].alias("proven")))

    chosen = let(truths, lambda known: F.transform(runs, lambda r: let(best(r, known), lambda b: told(r, b))))
    settled = let(F.filter(chosen, lambda x: x.isNotNull()), lambda found: settle_spans(found))
    return F.transform(settled, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "kind", "value", "read", "corrections", "proven")]))


#: Labels that must be read right, as they introduce a value; fixed values.
LABELS = "Surname Given Names Father's Mother's Husband's Spouse Holder Address Elector's Applicant Nominee Guardian Beneficiary Customer Account Passport Birth Signature".split()


def _shapes(word: Column) -> Column:
    """Letter shapes that run together or fall apart: rn and m, cl and d, vv and w, i l 1."""
    out = F.replace(F.replace(F.replace(word, F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d")), F.lit("vv"), F.lit("w"))
    return F.regexp_replace(out, "[il1|]", "i")


def label_of(word: Column) -> Column:
    """The label that a misread word stands for, in the word's case; null for labels
    themselves and for all other words."""
    lower = F.replace(F.lower(word), F.lit("’"), F.lit("'"))
    near = [F.when((F.left(lower, F.lit(1)) == x[0].lower()) & (F.abs(F.length(lower) - len(x)) <= 2) & (F.levenshtein(_shapes(lower), _shapes(F.lit(x.lower()))) <= 1),
                   F.struct(F.levenshtein(_shapes(lower), _shapes(F.lit(x.lower()))).alias("d"), F.lit(i).alias("i"), F.lit(x).alias("label"))) for i, x in enumerate(LABELS)]
    best = F.array_min(F.array_compact(F.array(*near)))["label"]
    return F.when(~lower.isin([x.lower() for x in LABELS]), F.when(word == F.upper(word), F.upper(best)).otherwise(best))


def repair_labels(text: Column) -> Column:
    """struct<text, pieces>: ``text`` with misread labels spelt right; a piece (start, end,
    at, to) says that start..end of the new text was at..to."""
    from ..operators.spans import spans

    words = F.filter(F.transform(spans(text, r"[\p{L}'’]{5,}"), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), label_of(w["value"]).alias("label"))), lambda w: w["label"].isNotNull())
    piece = "array<struct<start:int,end:int,at:int,to:int>>"
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast(piece).alias("pieces"))

    def put(acc: Column, until: Column, new: Column, to: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, until - acc["at"])
        n = F.length(acc["text"])
        one = F.struct(n.alias("start"), (n + F.length(kept)).alias("end"), acc["at"].alias("at"), until.alias("to"))
        two = F.struct((n + F.length(kept)).alias("start"), (n + F.length(kept) + F.length(new)).alias("end"), until.alias("at"), to.alias("to"))
        return F.struct(F.concat(acc["text"], kept, new).alias("text"), to.alias("at"), F.concat(acc["pieces"], F.array(one, two)).alias("pieces"))

    end = lambda acc: let(put(acc, F.length(text), F.lit(""), F.length(text)), lambda x: F.struct(x["text"].alias("text"), F.filter(x["pieces"], lambda p: p["start"] < p["end"]).alias("pieces")))
    return F.aggregate(words, start, lambda acc, w: put(acc, w["start"], w["label"], w["end"]), end)


def original_place(pieces: Column, place: Column) -> Column:
    """Where the character at ``place`` of a repaired text stood."""
    p = F.get(F.filter(pieces, lambda x: (place >= x["start"]) & (place < x["end"])), F.lit(0))
    return p["at"] + F.least(place - p["start"], p["to"] - p["at"] - 1)


def repair_case(text: Column) -> Column:
    """"l" or "|" at the head of a word after a capitalised one is "I"; the length stays."""
    return F.regexp_replace(text, spaced(r"(?<=\p{Lu}[\p{L}'’.-]{0,40}[^\S\n]{1,8})[l|](?=[a-z]{2,}(?![A-Za-z0-9_]))"), "I")


def mrz_names(line: Column) -> Column:
    """array<string>: surname and given names in the first line of a machine-readable zone."""
    body = F.regexp_extract(F.regexp_replace(line, spaced(r"\s"), ""), r"^[PIVAC][A-Z<«KL]([A-Z]{3})(.+)$", 2)
    fill = F.regexp_replace(F.regexp_replace(body, "«", "<"), r"<(?:[KL]?<)+", "<")
    names = F.transform(F.split(F.regexp_replace(fill, r"(?:<[KL]+|[KL]{4,}[KL<]*)$", ""), "<+"), lambda x: F.regexp_replace(x, "[KL]{3,}$", ""))
    return F.when(body != "", F.filter(names, lambda x: x.rlike("^[A-Z]{3,}$"))).otherwise(F.array().cast("array<string>"))
