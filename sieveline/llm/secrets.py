"""Secret scans through an inverted index of trigrams; native throughout.

Each rule is a regular expression.  From its syntax tree follows a Boolean query
over trigrams (``trigram_query``): an OR of alternatives, each an AND of the
trigrams that any match of that alternative must hold, in lower case.  A rule
with an alternative that holds none lacks mandatory trigrams and scans fully.

1. ``postings`` reads each text once and lists, for the trigrams that the rules'
   queries name, the documents that hold them: (gram, id, text_hash), kept in the
   shared folder in the order of the grams.
2. ``candidates`` meets the postings with the queries (a table as long as the rules
   are many, so it is broadcast) and intersects them: an alternative is met where
   as many distinct grams were found as it names.
3. ``scan`` joins candidates to texts by id and hash of the text, and verifies: a
   rule's expression runs on its candidates alone, rules without trigrams on all.

Matches are leftmost and non-overlapping for each kind; a match that fails a
rule's length is dropped after matching, as it still hides what it covers.
Offsets count code points.

Defined edge cases: a null text is empty and holds nothing; ids may be null or
repeat, and each row has a result (rows that share id and text share
candidates); an empty table gives an empty result; extra columns are ignored.  Texts
with the same id and hash of the text but different texts would only share
candidates, and verification decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: Alternatives of a query, and characters of a class, that are told apart.
ALTERNATIVES, CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """``pattern`` has the secret as its last group, if that has a length of its own."""

    kind: str
    pattern: str
    #: Fewest characters of group ``group`` (0: the whole match); others are dropped.
    least: int = 0
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    # runs are matched whole, so the length may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    # published formats of credentials
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # no scheme is longer; without a bound, a long run of letters would be tried from each of its places
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives of a pattern, each the lower-case trigrams that its matches hold;
    None if some alternative holds none.  Optional and repeated parts and classes of more
    than CLASS characters hold nothing for certain, and nothing stands across them."""
    #: An alternative: closed literals, and the literal that is still growing.
    paths: list[tuple[tuple[str, ...], str]] = [((), "")]

    def broken(x):
        return (*x[0], x[1]), ""

    def sequence(items, paths):
        for op, value in items:
            if op is C.LITERAL:
                paths = [(done, open_ + chr(value).lower()) for done, open_ in paths]
            elif op is C.IN and (few := _few(value)) and len(few) * len(paths) <= ALTERNATIVES:
                paths = [(done, open_ + c) for done, open_ in paths for c in few]
            elif op is C.SUBPATTERN:
                paths = sequence(value[3], paths)
            elif op is C.BRANCH:
                every = list(dict.fromkeys(y for branch in value[1] for y in sequence(branch, paths)))
                paths = every if len(every) <= ALTERNATIVES else [broken(x) for x in paths]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                least, most, inner = value
                if (least, most) == (0, 1) and len(inner) == 1 and inner[0][0] is C.LITERAL and 2 * len(paths) <= ALTERNATIVES:
                    paths = paths + sequence(inner, paths)
                elif least and least == most and len(inner) == 1 and inner[0][0] is C.LITERAL:
                    paths = sequence(list(inner) * least, paths)
                elif least:
                    # once for certain, wherever its borders lie
                    paths = [broken(x) for x in sequence(inner, [broken(x) for x in paths])]
                else:
                    paths = [broken(x) for x in paths]
            elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):  # those take no characters
                paths = [broken(x) for x in paths]
        return paths

    found = {frozenset(x[i : i + 3] for x in broken(path)[0] for i in range(len(x) - 2)) for path in sequence(_parser.parse(pattern), paths)}
    if not all(found):
        return None
    # an alternative that asks for more than another adds nothing
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def _few(items) -> list[str] | None:
    """The lower-case characters of a small class."""
    chars: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < CLASS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return sorted(chars) if len(chars) <= CLASS else None


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, id, text_hash): which documents hold which of ``grams``, in any case."""
    lowered = _keyed(docs, id_col, text_col).withColumn("text", F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("text"), F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select(F.explode(held).alias("gram"), "id", "text_hash")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, text_hash, kinds): for which rules a document is to be verified."""
    terms = [(kind, i, gram, len(grams)) for kind, query in queries.items() for i, grams in enumerate(query) for gram in sorted(grams)]
    asked = index.sparkSession.createDataFrame(terms, "kind string, alternative int, gram string, wanted int")
    met = index.join(F.broadcast(asked), "gram")  # as long as the rules are many
    whole = met.groupBy("id", "text_hash", "kind", "alternative", "wanted").agg(F.size(F.collect_set("gram")).alias("n")).where("n = wanted")
    return whole.groupBy("id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where matches start: sums of the gaps up to each and of the matches before it, in
    runs of about the root of their number, so that no sum is over all that stands before."""
    n = F.size(lengths)
    steps = F.transform(F.slice(gaps, F.lit(1), n), lambda g, i: F.length(g) + F.when(i > 0, F.get(lengths, i - 1)).otherwise(0))
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    run = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

    def within(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), (n - 1).cast("int"), run), lambda at: add(F.slice(steps, at + 1, run)))
        before = lambda runs: F.transform(runs, lambda _, r: add(F.slice(runs, F.lit(1), r)))
        return _let(_let(runs, before), lambda sums: F.transform(steps, lambda _, i: _run_start(sums, i, run) + add(F.slice(steps, i - i % run + 1, i % run + 1))))

    return F.when(n > 0, _let(steps, within)).otherwise(F.array().cast("array<int>"))


def _run_start(sums: Column, i: Column, run: Column) -> Column:
    return F.get(sums, F.floor(i / run).cast("int"))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def _matches(text: Column, rule: Rule, rank: int, asked: Column) -> Column:
    """array<struct<start, rank, kind, stop>> of a rule's matches; empty where it is not asked."""
    own = lambda k: F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(k))
    gaps = F.split(text, rule.pattern, -1)

    def told(found: Column) -> Column:
        lengths = F.transform(found, F.length)
        spans = F.transform(F.arrays_zip(_starts(gaps, lengths).alias("s"), lengths.alias("n")), lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (x["s"] + x["n"]).alias("stop")))
        if rule.group:  # group numbers count from the added outer one
            return _let(own(1 + rule.group), lambda secret: F.filter(spans, lambda _, i: F.length(F.get(secret, i)) >= rule.least))
        return F.filter(spans, lambda x: x["stop"] - x["start"] >= rule.least)

    return F.when(asked & F.rlike(text, F.lit(rule.pattern)), _let(own(1), told)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, found (array of start, rank, kind, stop in the order of start and rule)."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    some = {kind: q for kind, q in queries.items() if q is not None}
    rows = _keyed(docs, id_col, text_col)
    if some:
        grams = sorted({g for q in some.values() for a in q for g in a})
        index = settle(postings(docs, grams, id_col, text_col).sortWithinPartitions("gram"), "postings")
        # written first, so that its size is known when the join with the texts is planned
        verify = settle(candidates(index, some), "candidates").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "kinds")
        rows = rows.join(verify, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    asked = lambda r: F.lit(True) if queries[r.kind] is None else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
    every = F.concat(*[_matches(F.col("text"), r, k, asked(r)) for k, r in enumerate(rules)])
    return rows.select(F.col("id").alias(id_col), F.array_sort(every).alias("found"))


def _named(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_ of each base kind, base_sha256, spans."""
    base = [r.kind for r in rules if r.base]
    told = scan(docs, rules, id_col, text_col)
    of = lambda kinds: F.filter("found", lambda x: x["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(F.encode(_named(of(base)), "UTF-8"), 256)
    return told.select(id_col, *counts, digest.alias("base_sha256"), _named(F.col("found")).alias("spans"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Every pattern over every text, without index, queries or candidates."""
    patterns = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[""'']?\x20*[:=]\x20*[""'']?([A-Za-z0-9+/_.=-]+)""".replace('""', '"'),
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
        "github": r"gh[oprsu]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "google": r"AIza[A-Za-z0-9_-]{35}", "stripe": r"[rs]k_live_[A-Za-z0-9]{16,}",
        "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        "url_login": r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@",
    }
    group, least = {"assign": 2}, {"assign": 12, "access": 18, "hex": 16}
    parts = [
        f"SELECT r, {k} AS rank, '{kind}' AS kind, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group.get(kind, 0)}) AS gs, {least.get(kind, 0)} AS least FROM d WHERE regexp_matches(t, '{p}')"
        for k, (kind, p) in enumerate(patterns.items())
    ]
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT r, rank, kind, least, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[:len(ms)]) AS gap FROM m),
p AS (SELECT r, rank, kind, least, length(m) AS n, length(g) AS gn, sum(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS stop FROM u),
s AS (SELECT r, rank, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE gn >= least),
j AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


OP12_SQL = _sql()
