"""Quality rules on documents, the main one by line frequency across documents.

Lines are normalised (lower case, digits as 0, white space as one space) and
hashed; for each host (``source``) the distinct documents that have a line are
counted. A line in more than MIN_DOCS documents goes if it is in more than
MAX_SHARE of the host's documents, or in more than MAX_DOCS whatever the host's
size. A document that loses so much that under MIN_WORDS words or under MIN_LEFT
of its words are left is rejected; the others go on without the lines.

A document is told apart by its id and text: copies under ids of their own count
each, a row that stands twice counts once. Texts are read once for the measures and hashes,
which are kept as narrow rows; all counts and joins are on those. Texts meet
only the verdicts, which a count of them lets go to each task, or else in a shuffle join.

DataFrame functions only. Counts are combined before each shuffle, frequent
lines meet the line rows in a join that Spark can split by size, and no line's
documents are ever gathered.

Null and empty texts have no words and fail the base rules. A null source is a
host of its own. Repeated rows, null ids and extra columns stay as they are.
Documents, lines and, within one text, windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.native import let, renamed
from boxwright.llm.verdicts import few
from boxwright.session import cut

MIN_DOCS = 10
MAX_SHARE = 0.05
MAX_DOCS = 10_000
MIN_WORDS = 10
MIN_LEFT = 0.3
WINDOW = 5

_SPACE = r"[\x20\x09-\x0D]+"
_A_WORD = r"[^\x20\x09-\x0D]"
# White space within a line that is not one plain space already.
_WIDE_SPACE = r"(?:[\x09\x0B-\x0D]|\x20(?=[\x20\x09\x0B-\x0D]))[\x20\x09\x0B-\x0D]*"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _windows(words: Column) -> Column:
    """Hash of the WINDOW words from each place on."""
    n = F.size(words)
    at = F.sequence(F.lit(0), n - WINDOW)
    return F.when(n >= WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words that windows with equal hashes cover: sorted by hash, equals stand together."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeats(s: Column) -> Column:
        twin = lambda x, k: F.get(s, k)["h"] == x["h"]
        found = F.transform(s, lambda x, k: F.when(F.coalesce(twin(x, k - 1), F.lit(False)) | F.coalesce(twin(x, k + 1), F.lit(False)), x["i"]))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        own = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda n, x: n + x)

    return let(placed, lambda s: let(repeats(s), total))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_A_WORD))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    repeat = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(_windows(w), repeat).cast("long").alias("n_repeat_words"),
        )

    base = let(words_of(text), of)
    return F.struct(base["n_words"].alias("n_words"), base["word_chars"].alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup_lines.cast("long").alias("n_dup_lines"), base["n_repeat_words"].alias("n_repeat_words"))


def _lines(text: Column, host: Column) -> Column:
    """Array of (line, words), one for each line of a text: its hash with its host, null without a word."""
    low = F.translate(F.lower(text), "123456789", "000000000")
    plain = F.transform(F.split(F.regexp_replace(low, _WIDE_SPACE, " "), "\n"), lambda x: F.trim(x))
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(plain, lambda x: F.struct(F.when(x != "", F.xxhash64(host, x)).alias("line"), n_words(x).alias("words")))


def key(docs: DataFrame) -> Column:
    """What tells documents apart."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def examined(docs: DataFrame) -> DataFrame:
    """doc_id, key, host, the measures, base_failed and lines of each row, written to the shared folder."""
    m = F.col("m")
    rows = docs.select("doc_id", key(docs).alias("key"), F.xxhash64("source").alias("host"), measures(F.col("text")).alias("m"), _lines(F.col("text"), F.col("source")).alias("lines"))
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return cut(rows.select("doc_id", "key", "host", "m.*", failed.alias("base_failed"), "lines"), "examined")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """line: those over the limits, from rows of ``examined``."""
    hosts = rows.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    seen = rows.select("host", "key", F.explode(F.array_distinct("lines.line")).alias("line")).filter("line is not null").distinct()
    docs = seen.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    return docs.join(hosts, "host").filter((F.col("docs") > F.col("host_docs") * max_share) | (F.col("docs") > max_docs)).select("line")


def lost(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """For each document that has frequent lines: key, places of those lines, removed (their words), depleted."""
    placed = rows.select("key", "n_words", F.posexplode("lines").alias("at", "x")).select("key", "n_words", "at", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    hits = placed.filter("line is not null").join(frequent, "line")
    # A row that stands twice has its lines twice: the set has each once, and no more than one document's lines.
    found = hits.groupBy("key").agg(F.max("n_words").alias("n"), F.collect_set(F.struct("at", "words")).alias("found"))
    removed = F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    left = F.col("n") - F.col("removed")
    return found.select("key", "n", F.col("found.at").alias("places"), removed.alias("removed")).select("key", "places", "removed", ((left < MIN_WORDS) | (left < F.col("n") * MIN_LEFT)).alias("depleted"))


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, the measures, base_failed, n_removed_words and kept of each row."""
    rows = examined(docs)
    gone = lost(rows, frequent_lines(rows, min_docs, max_share, max_docs)).select("key", "removed", "depleted")
    rows = rows.drop("host", "lines").join(gone, "key", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    return rows.select(*(c for c in rows.columns if c not in ("key", "removed", "depleted")), F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed_words"), kept.alias("kept"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept."""
    return judged(docs)


def _without(text: Column, places: Column) -> Column:
    """A text without the lines at these places."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), rest)


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """Documents that pass, with all their columns, their texts without the frequent lines.

    Where a text loses lines, ``n_chars`` (if there is one) is counted anew.
    """
    names, docs = docs.columns, renamed(docs, "doc_id", "text", "source", "n_chars")
    rows = examined(docs)
    gone = lost(rows.filter("not base_failed"), frequent_lines(rows, min_docs, max_share, max_docs))
    failed = rows.filter("base_failed").select("key").distinct()
    verdicts = failed.select("key", F.lit(True).alias("out"), F.lit(None).cast("array<int>").alias("places")).union(gone.select("key", "depleted", "places"))
    verdicts = few(cut(verdicts, "verdicts"), more=4 * F.coalesce(F.size("places"), F.lit(0))).select(F.col("key").alias("__key"), F.col("out").alias("__out"), F.col("places").alias("__places"))
    kept = docs.withColumn("__of", key(docs)).join(verdicts, F.col("__of") == F.col("__key"), "left").filter(~F.coalesce("__out", F.lit(False)))
    changed = F.col("__places").isNotNull()
    text = F.when(changed, _without(F.col("text"), F.col("__places"))).otherwise(F.col("text"))
    count = lambda c: F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return kept.select(*(text.alias(c) if c == "text" else count(c) if c == "n_chars" else F.col(c) for c in docs.columns)).toDF(*names)
