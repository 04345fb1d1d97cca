"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: an OR
over alternatives of an AND over the trigrams that every match of the
alternative contains. The index holds, for every trigram that some rule asks
for, the texts (by hash) that contain it. A rule's candidates are the texts
whose number of postings for one alternative equals the number of its
trigrams; only they are verified with the regular expression. Rules without
mandatory trigrams scan every text.

Equal texts share their postings; a collision of hashes can only add
candidates. DataFrame functions only. Postings are never gathered by trigram:
they are counted by text, with counts combined before the shuffle. Candidates
meet the texts in a join that Spark broadcasts if their table is small and
otherwise shuffles.

Null and empty texts have no spans. Repeated rows, null ids and extra columns
stay as they are. An empty table gives no rows. Offsets are code points, ends
exclusive. A text is read a few times a rule, however many matches it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.native import let, renamed
from boxwright.session import cut


SPANS = "array<struct<start:int,rank:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``least`` characters are needed in ``group`` of a match, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The three base kinds as they are defined, then public formats.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]


#: Characters of a class that is written out, and alternatives of a query.
SMALL, MOST = 8, 256


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that all occur in its matches; None if one has none.

    Literals that must stand next to each other form runs, and a class of up to SMALL
    characters stands for each of them; a larger class, the rest of a repeat or an
    optional part ends a run. Branches and small classes multiply the alternatives;
    past MOST, a class ends its run instead, which asks for less and stays right.
    """

    def small(items) -> list[str] | None:
        chars: set[str] = set()
        for op, arg in items:
            if op is sre.LITERAL:
                chars.add(chr(arg).lower())
            elif op is sre.RANGE and arg[1] - arg[0] < SMALL:
                chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return sorted(chars) if len(chars) <= SMALL else None

    def walk(parsed, before: list[list[str]]) -> list[list[str]]:
        """``before``: alternatives as runs, of which the last is still open."""
        out = before
        for op, arg in parsed:
            if op is sre.LITERAL:
                out = [[*runs[:-1], runs[-1] + chr(arg)] for runs in out]
            elif op is sre.SUBPATTERN:
                out = walk(arg[-1], out)
            elif op is sre.BRANCH:
                out = [x for branch in arg[1] for x in walk(branch, out)]
            elif op is sre.IN and (chars := small(arg)) and len(out) * len(chars) <= MOST:
                out = [[*runs[:-1], runs[-1] + c] for runs in out for c in chars]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                times = min(arg[0], 3)
                for _ in range(times):
                    out = walk(arg[2], out)
                if arg[1] != times:
                    out = [[*runs, ""] for runs in out]
            else:
                out = [[*runs, ""] for runs in out]
        return out

    found = [frozenset(run.lower()[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs in walk(_parser.parse(pattern), [[""]])]
    return list(dict.fromkeys(found)) if all(found) else None


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, text_key) of the given trigrams, written to the shared folder."""
    texts = docs.select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("low")).filter("low is not null")
    has = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)))
    return cut(texts.select("text_key", F.explode(has).alias("trigram")), "postings")


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """text_key, rules: the indexed rules that a text may match. Intersections are counts by text."""
    rows = [(r.kind, k, t, len(query)) for r in rules for k, query in enumerate(trigram_query(r.pattern) or []) for t in sorted(query)]
    asked = postings.sparkSession.createDataFrame(rows, "kind string, alternative int, trigram string, needed int")
    # The rules' own trigrams: as many as the rules spell out.
    met = postings.distinct().join(F.broadcast(asked), "trigram").groupBy("text_key", "kind", "alternative", "needed").agg(F.count("*").alias("n"))
    return met.filter("n = needed").groupBy("text_key").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """(start, rank, end) of a rule's leftmost non-overlapping matches that pass its length.

    The matches and what lies between them make up the text, so their lengths tell the places.
    """
    # No rule looks around, so a match alone falls into groups as it does in its text.
    size = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)

    def spans(ms: Column, gaps: Column) -> Column:
        sized = F.transform(ms, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("own"), (size(m) >= rule.least).alias("keep")))

        def step(acc: Column, x: Column) -> Column:
            start = acc["next"] + x["gap"]
            span = F.when(x["keep"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["own"]).alias("end")))).otherwise(none)
            return F.struct((start + x["own"]).alias("next"), F.concat(acc["at"], span).alias("at"))

        return F.aggregate(sized, F.struct(F.lit(0).alias("next"), none.alias("at")), step, lambda acc: acc["at"])

    none = F.array().cast(SPANS)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return let(found, lambda ms: F.when(F.size(ms) > 0, let(F.split(text, rule.pattern, -1), lambda gaps: spans(ms, gaps))).otherwise(none))


def find(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank of the rule, end), sorted. A column of that name gives way."""
    rules, names = rules or RULES, docs.columns
    docs = renamed(docs, "doc_id", "text", "spans")
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in asked.values() for alt in q or [] for t in alt})
    may = cut(candidates(index(docs, trigrams), rules), "candidates").withColumnRenamed("text_key", "__key").withColumnRenamed("rules", "__rules")
    rows = docs.withColumn("__text_key", F.xxhash64("text"))
    rows = rows.join(may, F.col("__text_key") == F.col("__key"), "left")
    none = F.array().cast(SPANS)

    def gated(r: Rule, rank: int) -> Column:
        spans = _spans(F.col("text"), r, rank)
        return spans if asked[r.kind] is None else F.when(F.array_contains("__rules", r.kind), spans)

    found = F.sort_array(F.concat(*(F.coalesce(gated(r, k), none) for k, r in enumerate(rules))))
    kept = [F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True) if c != "spans"]
    return rows.select(*kept, F.when(F.col("text").isNull(), none).otherwise(found).alias("spans"))


def _joined(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = {r.kind: k for k, r in enumerate(RULES) if r.base}
    counts = [F.size(F.array_remove("spans.rank", k)).cast("long") for k in base.values()]
    counts = [(F.size("spans").cast("long") - n).alias(f"n_{kind}") for kind, n in zip(base, counts, strict=True)]
    found = find(docs.select("doc_id", "text")).select("doc_id", "spans")
    base_spans = F.filter("spans", lambda s: s["rank"] < len(base))
    return found.select("doc_id", *counts, F.sha2(_joined(base_spans, RULES), 256).alias("base_sha256"), _joined(F.col("spans"), RULES).alias("spans"))
