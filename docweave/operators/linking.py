"""Link inference between symbols and documentation sections.

Inputs: symbols (symbol_id, name, location), sections (doc_id, file, anchor, content) and references
(doc_id, ref, ref_type).  No plan compares every symbol with every section: each rule has a blocking
key, and what a key proposes is verified by the rule itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, contains_ignore_case, file_stem, fuzzy_match, is_code_like, normalize

WORD = r"([A-Za-z0-9_]+)"
#: Length of the substrings that two fuzzily equal names must share.
GRAM = 4


def words(text: Column) -> Column:
    """Distinct lower-case words of ``[A-Za-z0-9_]``."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1)))


def _names(symbols: DataFrame) -> DataFrame:
    return symbols.select("symbol_id", "name", "location").withColumn("clean", clean_name(F.col("name"))).filter(F.length("clean") > 0)


def word_matches(symbols: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(symbol_id, doc_id): the cleaned name stands as a word of the text, case apart.

    A name of word characters alone equals a word: an equi-join on words.  Any other name is looked
    up by its rarest-looking part, its longest run of word characters, and then verified whole.
    """
    names = _names(symbols).select("symbol_id", F.lower("clean").alias("clean"))
    tokens = texts.select("doc_id", F.lower(F.coalesce(text, F.lit(""))).alias("text")).withColumn("word", F.explode(words(F.col("text"))))
    plain = names.filter(F.col("clean").rlike("^[a-z0-9_]+$"))
    equal = plain.join(tokens.select("doc_id", "word"), F.col("clean") == F.col("word")).select("symbol_id", "doc_id")
    parts = F.regexp_extract_all("clean", F.lit(WORD), F.lit(1))
    longest = F.element_at(F.array_sort(parts, lambda a, b: F.length(b) - F.length(a)), 1)
    odd = names.filter(~F.col("clean").rlike("^[a-z0-9_]+$")).withColumn("part", F.when(F.size(parts) > 0, longest)).filter("part IS NOT NULL")
    near = odd.join(tokens, (F.col("part") == F.col("word")) & F.contains("text", "clean"))
    # A boundary is asked for only next to a word character, or at the text's ends.
    at = F.regexp_replace("clean", r"([.*+?^${}()|\[\]\\/-])", r"\\$1")
    pattern = F.concat(F.when(F.col("clean").rlike("^[a-z0-9_]"), r"(?<![a-z0-9_])").otherwise(r"(^|(?<=[a-z0-9_]))"), at, F.when(F.col("clean").rlike("[a-z0-9_]$"), r"(?![a-z0-9_])").otherwise(r"($|(?=[a-z0-9_]))"))
    verified = near.filter(F.regexp_like(F.col("text"), pattern)).select("symbol_id", "doc_id")
    return equal.unionByName(verified).distinct()


def ref_matches(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, doc_id, ref_type): a reference equals the name, with or without call suffixes."""
    names = _names(symbols)
    forms = names.select("symbol_id", F.explode(F.array_distinct(F.array("name", "clean"))).alias("form"))
    ref_forms = refs.select("doc_id", "ref_type", F.explode(F.array_distinct(F.array("ref", clean_name(F.col("ref"))))).alias("form"))
    return forms.join(ref_forms, "form").select("symbol_id", "doc_id", "ref_type").distinct()


def _grams(text: Column) -> Column:
    n = F.length(text)
    starts = F.when(n >= GRAM, F.sequence(F.lit(1), n - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))


def fuzzy_matches(symbols: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(symbol_id, doc_id) with ``fuzzy_match(name, text)``, by shared substrings of four characters.

    Containment of a normalised string of four or more, a common prefix and a common substring all
    need at least one such substring in common.  Names and texts are compared by their distinct
    normalised values, so a frequent name or heading is one row.  Shorter values match only by
    containment: a short name is looked up among all substrings of its own length.
    """
    names = _names(symbols).select("symbol_id", "clean").withColumn("n", normalize(F.col("clean"))).filter("n <> ''")
    heads = texts.select("doc_id", F.col(text).alias("h0")).filter(F.length("h0") > 0).withColumn("h", normalize(F.col("h0"))).filter("h <> ''")
    n_values, h_values = names.select("n").distinct(), heads.select("h").distinct()
    by_gram = n_values.withColumn("g", F.explode(_grams(F.col("n")))).join(h_values.withColumn("g", F.explode(_grams(F.col("h")))), "g").select("n", "h").distinct()

    def substrings(c: Column) -> Column:  # of one to three characters
        n = F.length(c)
        of = lambda k: F.transform(F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(k)))
        return F.array_distinct(F.concat(of(1), of(2), of(3)))

    short = lambda a, b, x, y: a.filter(F.length(x) < GRAM).join(b.withColumn("g", F.explode(substrings(F.col(y)))), F.col(x) == F.col("g")).select("n", "h")
    pairs = by_gram.unionByName(short(n_values, h_values, "n", "h")).unionByName(short(h_values, n_values, "h", "n")).distinct()
    verified = pairs.filter(fuzzy_match(F.col("n"), F.col("h")))
    return names.join(verified, "n").join(heads.select("doc_id", "h"), "h").select("symbol_id", "doc_id").distinct()


def substring_matches(symbols: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(symbol_id, doc_id): a name of three or more characters is part of the text, case apart."""
    gram = lambda c: F.array_distinct(F.transform(F.when(F.length(c) >= 3, F.sequence(F.lit(1), F.length(c) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(3))))
    names = _names(symbols).select("symbol_id", F.lower("clean").alias("low")).filter(F.length("low") >= 3)
    values = names.select("low").distinct().withColumn("g", F.substring("low", 1, 3))
    heads = texts.select(F.lower(F.coalesce(text, F.lit(""))).alias("h")).distinct()
    hit = values.join(heads.withColumn("g", F.explode(gram(F.col("h")))), "g").filter(contains_ignore_case(F.col("low"), F.col("h"))).select("low", "h").distinct()
    return names.join(hit, "low").join(texts.select("doc_id", F.lower(text).alias("h")), "h").select("symbol_id", "doc_id").distinct()


def autolink_pass1(symbols: DataFrame, sections: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, doc_id, confidence): 1.0 for a word of the heading, else 0.9 for a backtick reference.

    The least confidence that pass 2 asks for plays no part here.
    """
    heading = word_matches(symbols, sections, "anchor").withColumn("confidence", F.lit(1.0))
    ticks = ref_matches(symbols, refs.filter(F.col("ref_type") == "backtick")).select("symbol_id", "doc_id", F.lit(0.9).alias("confidence"))
    return heading.unionByName(ticks).groupBy("symbol_id", "doc_id").agg(F.max("confidence").alias("confidence"))


def score_pairs(symbols: DataFrame, sections: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol_id, doc_id, confidence): the strongest rule, plus 0.1 where file stems agree.

    Heading word 1.0; part of the heading 0.7; backtick 0.9; code block 0.7; heading reference,
    equal or fuzzily so, 0.6; fuzzy heading 0.6; body reference 0.4; a code-like name of four or
    more characters as a word of body or heading 0.4.  Links never score.
    """
    weigh = F.element_at(F.create_map(*(F.lit(x) for p in (("backtick", 0.9), ("codeblock", 0.7), ("heading", 0.6), ("bodytext", 0.4)) for x in p)), F.col("ref_type"))
    rule = lambda df, value: df.select("symbol_id", "doc_id", F.lit(value).alias("confidence"))
    code_like = symbols.filter((F.length(clean_name(F.col("name"))) >= 4) & is_code_like(clean_name(F.col("name"))))
    heading_refs = refs.filter(F.col("ref_type") == "heading")
    parts = [
        rule(word_matches(symbols, sections, "anchor"), 1.0),
        rule(substring_matches(symbols, sections, "anchor"), 0.7),
        ref_matches(symbols, refs).select("symbol_id", "doc_id", weigh.alias("confidence")).filter("confidence IS NOT NULL"),
        rule(fuzzy_matches(symbols, heading_refs, "ref"), 0.6),
        rule(fuzzy_matches(symbols, sections, "anchor"), 0.6),
        rule(word_matches(code_like, sections, "content"), 0.4),
    ]
    best = reduce(DataFrame.unionByName, parts).groupBy("symbol_id", "doc_id").agg(F.max("confidence").alias("best"))
    stems = best.join(symbols.select("symbol_id", file_stem(F.col("location")).alias("s")), "symbol_id").join(sections.select("doc_id", file_stem(F.col("file")).alias("d")), "doc_id")
    same = (F.length("s") > 0) & (F.col("s") == F.col("d"))
    return stems.select("symbol_id", "doc_id", F.round(F.when(same, F.least(F.lit(1.0), F.col("best") + 0.1)).otherwise(F.col("best")), 6).alias("confidence"))


def new_links(scored: DataFrame, existing: DataFrame) -> DataFrame:
    """Scored pairs that are not mapped as ``describes`` yet."""
    held = existing.filter(F.col("rel_type") == "describes").select("symbol_id", "doc_id")
    return scored.join(held, ["symbol_id", "doc_id"], "left_anti")


def autolink_pass2(symbols: DataFrame, sections: DataFrame, refs: DataFrame, first: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """All rules, for symbols without a new link from pass 1 (``first``: its new links).

    A symbol all of whose pass 1 pairs existed before is not among those, so it is scored here.
    """
    rest = symbols.join(first.select("symbol_id").distinct(), "symbol_id", "left_anti")
    return score_pairs(rest, sections, refs).filter(F.col("confidence") >= min_confidence)


def autolink(symbols: DataFrame, sections: DataFrame, refs: DataFrame, existing: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(symbol_id, doc_id, confidence, pass) of all new links of both passes."""
    one = new_links(autolink_pass1(symbols, sections, refs), existing)
    two = new_links(autolink_pass2(symbols, sections, refs, one, min_confidence), existing)
    return one.withColumn("pass", F.lit(1)).unionByName(two.withColumn("pass", F.lit(2)))


def autolink_summary(links: DataFrame) -> DataFrame:
    """One row: how many links are of high (0.8), medium (0.5) and low confidence."""
    c = F.col("confidence")
    return links.agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), F.count("*").alias("total"))


def ingest_links(symbols: DataFrame, sections: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, ref, symbol_id): references of any type whose name is one symbol's.

    A name of several symbols links only if the source file stem of exactly one equals the doc's.
    """
    # Names are counted before they meet the references: a frequent name is one row, not one a symbol.
    stem = file_stem(F.col("location"))
    named = symbols.groupBy(F.col("name").alias("form")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("only"))
    placed = symbols.withColumn("d", stem).filter(F.length("d") > 0).groupBy(F.col("name").alias("form"), "d").agg(F.count("*").alias("k"), F.min("symbol_id").alias("same"))
    uses = refs.select("doc_id", "ref").distinct().join(sections.select("doc_id", file_stem(F.col("file")).alias("d")), "doc_id")
    forms = uses.withColumn("form", F.explode(F.array_distinct(F.array("ref", clean_name(F.col("ref"))))))
    hits = forms.join(named, "form").join(placed, ["form", "d"], "left")
    found = hits.groupBy("doc_id", "ref").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("only").alias("only"), F.min("same").alias("same"))
    return found.filter("n = 1 OR k = 1").select("doc_id", "ref", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("same")).alias("symbol_id"))


def ingest_counts(links: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: references that link (what an ingest reports) and mappings that are really new."""
    new = links.select("symbol_id", "doc_id").distinct().join(existing.filter(F.col("rel_type") == "references").select("symbol_id", "doc_id"), ["symbol_id", "doc_id"], "left_anti")
    return links.agg(F.count("*").alias("linked_refs")).crossJoin(new.agg(F.count("*").alias("new_mappings")))  # single rows


def review_implied(symbols: DataFrame, sections: DataFrame, existing: DataFrame) -> DataFrame:
    """(symbol_id, doc_id): a name of two or more characters stands in the text but is not mapped.

    Sections without a heading (preambles) are never searched.
    """
    named = symbols.filter(F.length("name") >= 2)
    hits = word_matches(named, sections.filter(F.length("anchor") > 0), "content")
    return hits.join(existing.select("symbol_id", "doc_id"), ["symbol_id", "doc_id"], "left_anti")
