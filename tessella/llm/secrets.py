"""Secret scans by a trigram inverted index: Boolean trigram queries derived from each rule, postings intersected, candidates verified.

A posting list holds the rows of one block that have a trigram, so no list grows with the table; only row ids are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stage, table

#: Rows of a block: 2 to this power. Rows between sums that are kept while placing spans.
BLOCK_BITS, CHUNK = 12, 64
#: Broadcast at most so many candidate rows (an id and a few rule numbers each), by their count; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; pattern: regex without inline flags; ignore_case; value: group that must have `least` characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    value: int = 0
    least: int = 0


#: Base rules, in the order in which equal starts are listed. A maximal run of 32 or more is one match of {32,}, and the
#: same for 16 or more characters from AKIA on, so these limits stand in the pattern; that of assign is checked after matching.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further rules, whose spans are added.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"://[A-Za-z0-9._-]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE


def mandatory(pattern: str) -> list[set[str]]:
    """The Boolean trigram query of a regex as alternatives (or) of sets (and) of lower-case trigrams; [set()]: scan fully.

    Runs of literals are kept as sets of possible strings; what is not literal ends a run. Every trigram of a run is needed.
    """
    
    def walk(items) -> list[list[str]]:
        """Alternatives, each the list of literal runs that every match of it holds; "" parts runs that are not adjacent."""
        ways: list[list[str]] = [[""]]

        def times(options: list[list[str]]) -> None:
            nonlocal ways
            ways = [a[:-1] + [a[-1] + o[0]] + o[1:] for a in ways for o in options]

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                times([[chr(arg).lower()]])
            elif name == "SUBPATTERN":
                times(walk(arg[3]))
            elif name == "BRANCH":
                times([w for branch in arg[1] for w in walk(branch)])
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                times([[""], *walk(arg[2])])
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                times([[*w, ""] for w in walk(arg[2])])
            else:
                times([["", ""]])
        return ways

    sets = [{r[i : i + 3] for r in runs for i in range(len(r) - 2)} for runs in walk(_parser.parse(pattern))]
    if not all(sets):
        return [set()]
    return [s for i, s in enumerate(sets) if not any(o < s or (o == s and j < i) for j, o in enumerate(sets))]


def trigrams(rules=RULES) -> list[str]:
    return sorted({t for rule in rules for way in mandatory(rule.pattern) for t in way})


def build_index(rows: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """(block, trigram, rows): the posting lists of rows (_row, text) for the rules' trigrams, in either case; null texts hold none."""
    lowered = rows.filter(F.col(text).isNotNull()).select("_row", F.lower(F.col(text)).alias("_lower"))
    has = [F.when(F.contains(F.col("_lower"), F.lit(t)), F.lit(t)) for t in trigrams(rules)]
    held = lowered.select("_row", F.explode(F.array_compact(F.array(*has)) if has else F.array().cast("array<string>")).alias("trigram"))
    return held.groupBy(F.shiftright("_row", BLOCK_BITS).alias("block"), "trigram").agg(F.collect_list("_row").alias("rows"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(_row, rules): the rows that satisfy the Boolean query of some rules, by number; rules that scan fully are left out."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("of"))
    none = F.array().cast("array<long>")
    posted = lambda t: F.coalesce(F.try_element_at("of", F.lit(t)), none)
    found = []
    for i, rule in enumerate(rules):
        ways = [reduce(F.array_intersect, [posted(t) for t in sorted(way)]) for way in mandatory(rule.pattern) if way]
        if ways:
            found.append(F.struct(F.lit(i).alias("rule"), reduce(F.array_union, ways).alias("rows")))
    if not found:
        return lists.select(F.lit(0).cast("long").alias("_row"), F.array(F.lit(0)).alias("rules")).limit(0)
    rows = lists.select(F.inline(F.array(*found))).select("rule", F.explode("rows").alias("_row"))
    return rows.groupBy("_row").agg(F.collect_set("rule").alias("rules"))


def _let(value, f):
    """f(value) with value computed once, though f uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(rule: Rule, order: int, text):
    """Array of (start, order, end, kind) of the rule's leftmost non-overlapping matches, in code points, end exclusive.

    What stands between matches and the matches themselves have lengths whose running sums are the positions; sums of
    CHUNK matches are made first, so that time hardly grows faster than the number of matches.
    """
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    fits = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.value)) if rule.value else found
    zipped = F.arrays_zip(F.transform(between, F.length), F.transform(found, F.length), F.transform(fits, F.length))
    zipped = F.filter(zipped.cast("array<struct<gap:int,long:int,value:int>>"), lambda m: m["long"].isNotNull())
    kind = "struct<start:int,place:int,end:int,kind:string,value:int>"

    def placed(chunk, offset):
        def step(done, item):
            start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], offset) + item["gap"]
            one = F.struct(start.alias("start"), F.lit(order).alias("place"), (start + item["long"]).alias("end"), F.lit(rule.kind).alias("kind"), item["value"].alias("value"))
            return F.concat(done, F.array(one.cast(kind)))

        return F.aggregate(chunk, F.array().cast(f"array<{kind}>"), step)

    def all_placed(chunks):
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, m: a + m["gap"] + m["long"]))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(offsets, F.lit(1), F.size(chunks)), placed))

    def cut(matches):
        starts = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda i: F.slice(matches, i, F.lit(CHUNK)))

    return F.filter(_let(_let(zipped, cut), all_placed), lambda s: s["value"] >= rule.least)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(key, spans): every span of every rule, an array of (start, place, end, kind, value) by start and place of the rule.

    Rules are run on the rows that the index gives for them; hex has no mandatory trigram and is run on all. Null texts are
    empty; texts of any length and number of secrets are read whole; repeated rows are scanned each; extra columns are
    ignored; an empty table gives no rows.
    """
    rows = numbered(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))).select("_row", "doc.*")
    known = stage(candidates(build_index(rows, rules), rules), "candidates")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = rows.join(known, "_row", "left")
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,value:int>>")
    found = []
    for i, rule in enumerate(rules):
        pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern
        asked = F.coalesce(F.array_contains("rules", F.lit(i)), F.lit(False)) if mandatory(rule.pattern)[0] else F.lit(True)
        found.append(F.when(asked & F.rlike(F.col("text"), F.lit(pattern)), spans(rule, i, F.col("text"))).otherwise(none))
    return rows.select(F.col("key").alias(key), F.array_sort(F.concat(*found)).alias("spans"))


def listed(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    of = lambda i: F.size(F.filter("spans", lambda s: s["place"] == i))
    counts = [of(i).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_rule(i: int, rule: Rule) -> str:
    pattern = (("(?i)" if rule.ignore_case else "") + rule.pattern).replace("'", "''").replace(r"\x09-\x0D", r"\t\n\v\f\r")
    return f"""
  SELECT doc_id, row, {i} AS place, '{rule.kind}' AS kind, list_sum(list_transform(gaps[:n], lambda g: length(g))) + coalesce(list_sum(list_transform(found[:n - 1], lambda g: length(g))), 0) AS start, length(found[n]) AS long
  FROM (SELECT doc_id, row, unnest(range(1, len(found) + 1)) AS n, found, gaps, value FROM (
    SELECT doc_id, row, regexp_extract_all(body, '{pattern}') AS found, string_split_regex(body, '{pattern}') AS gaps, regexp_extract_all(body, '{pattern}', {rule.value}) AS value FROM d
    WHERE regexp_matches(body, '{pattern}')))
  WHERE length(value[n]) >= {rule.least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS body FROM documents),
s AS ({' UNION ALL '.join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
g AS (SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + long AS BIGINT), ',' ORDER BY start, place) FILTER (WHERE place < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + long AS BIGINT), ',' ORDER BY start, place) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
"""
