"""Benchmark decontamination by a positional inverted index: which documents hold passages of test items, word for word or nearly so.

The index is a table of postings (term, text key, place), spread by term. Of every window of an item the two rarest terms are
looked up. Their lists are shifted by the terms' offsets and intersected, which leaves diagonals: a text, an item, and the
place of the text at which the item would have to start. Neighbouring windows mostly share their rarest terms, so an item has
a few diagonals, not one for each window. Only texts with a diagonal are compared with the item itself.

Texts are known by two 64-bit hashes, so copies share postings and are looked up once. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import broadcast_if_small, cut, let

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before A-Z are lower-cased: all of ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEY = ["k1", "k2"]


def lower_word(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are; only words beyond ASCII need the slower way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def cased_words(text: Column) -> Column:
    """Words in order, case kept: an array, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def text_key(text: Column) -> list[Column]:
    """128 bits that equal texts share."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(11), text).alias("k2")]


def _wanted(terms: DataFrame) -> DataFrame:
    """Distinct terms, stored; they go to all tasks if they are few enough, so words that no item has are never shuffled."""
    return broadcast_if_small(cut(terms.select("term").distinct()), F.octet_length("term") + 32)


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how often each of the distinct terms occurs in all documents; terms that never do have no row."""
    words = docs.select(F.explode(cased_words(F.col(text))).alias("w")).select(lower_word(F.col("w")).alias("term"))
    return words.join(_wanted(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The index (term, k1, k2, place from 0) of all terms or of the given ones; copies of a text have one posting.

    Postings are combined before they are shuffled, so a text that a third of all rows repeat is no hot key.
    """
    words = docs.select(*text_key(F.col(text)), F.posexplode(cased_words(F.col(text))).alias("place", "w"))
    words = words.select(lower_word(F.col("w")).alias("term"), *_KEY, "place")
    if terms is not None:
        words = words.join(_wanted(terms), "term", "left_semi")
    return words.distinct()


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, ids): each distinct word sequence of the items that have words, with the distinct non-null ids of its items
    as sorted strings. item is a number for the sequence: a hash of its text."""
    words = F.transform(cased_words(F.col(text)), lower_word)
    rows = items.select(F.col(item_id).cast("string").alias("id"), words.alias("words")).where(F.size("words") > 0)
    per = rows.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return per.select(F.sha2(F.concat_ws(" ", "words"), 256).alias("item"), "words", "ids")


def rare_places(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, a, term_a, b, term_b): places and terms of the rarest and the second rarest word of every window that can occur.

    A window with a term that the corpus lacks can't, and has no row. Equally rare terms are told apart by their place in
    a grid as wide as a window, so a run of one word is looked up once a grid cell. A window of one word has it twice.
    """
    at = items.select("item", F.posexplode("words").alias("place", "term")).join(counts, "term", "left")
    cell = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (F.col("place") % window).alias("grid"), "place", "term")
    per = at.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", cell.alias("cell")))).alias("cells"))
    cells, wide = F.col("cells.cell"), F.least(F.lit(window), F.size("cells"))

    def of(part: Column) -> Column:
        low = F.array_min(part)
        second = F.array_min(F.filter(part, lambda c: c["place"] != low["place"]))
        return F.struct(low.alias("a"), F.coalesce(second, low).alias("b"))

    starts = F.sequence(F.lit(1), F.size("cells") - wide + 1)
    found = per.select("item", F.explode(F.array_distinct(F.transform(starts, lambda s: of(F.slice(cells, s, wide))))).alias("x")).where("x.a.n > 0")
    return found.select("item", F.col("x.a.place").alias("a"), F.col("x.a.term").alias("term_a"), F.col("x.b.place").alias("b"), F.col("x.b.term").alias("term_b"))


def diagonals(index: DataFrame, rare: DataFrame, slack: int = 0) -> DataFrame:
    """(k1, k2, item, start, a, b, gap): texts in which both rare terms stand as far from each other as in the item, give or take
    slack words (gap). start: the place of the item's first word by term_a, below 0 where the text starts within the item.

    The list of the rarest term comes first, so what meets the second list is as short as can be.
    """
    first = index.join(rare, index["term"] == rare["term_a"]).select(*_KEY, "item", "a", "b", "term_b", (F.col("place") - F.col("a")).alias("start"))
    first = first.withColumn("gap", F.explode(F.sequence(F.lit(-slack), F.lit(slack)))).where("CASE WHEN a = b THEN gap = 0 ELSE b + gap <> a END")
    first = first.withColumn("place", F.col("start") + F.col("b") + F.col("gap")).withColumnRenamed("term_b", "term")
    return first.join(index, ["term", *_KEY, "place"], "left_semi").select(*_KEY, "item", "start", "a", "b", "gap")


@dataclass
class Index:
    """Postings of the terms that a set of items looks up, and the items' words and rare places. Both tables are stored in the
    checkpoint folder, so later searches don't read the corpus again."""

    items: DataFrame
    rare: DataFrame
    lists: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> Index:
        words = item_words(items, item_id, item_text)
        counts = term_counts(docs, words.select(F.explode("words").alias("term")), text)
        rare = cut(rare_places(words, counts, window))
        terms = rare.select(F.explode(F.array("term_a", "term_b")).alias("term"))
        return cls(words, rare, cut(postings(docs, terms, text)))

    def near(self, slack: int) -> DataFrame:
        """Proximity matches (k1, k2, item, start, gap): the two rarest terms of a window at their distance, give or take slack words."""
        return diagonals(self.lists, self.rare, slack).select(*_KEY, "item", "start", "gap").distinct()

    def candidates(self) -> DataFrame:
        """(k1, k2, found): for each text with a diagonal its items, their words and ids, and where they would start."""
        lines = diagonals(self.lists, self.rare).groupBy(*_KEY, "item").agg(F.collect_set("start").alias("starts"))
        found = cut(lines.join(self.items, "item").groupBy(*_KEY).agg(F.collect_list(F.struct("words", "ids", "starts")).alias("found")))
        letters = lambda f: F.octet_length(F.concat_ws(" ", f["words"], f["ids"])) + 8 * (F.size(f["words"]) + F.size(f["ids"]) + F.size(f["starts"])) + 64
        return broadcast_if_small(found, F.aggregate("found", F.lit(64), lambda n, f: n + letters(f)))


def _phrases(found: Column, words: Column, window: int) -> Column:
    """Array of (ids, at, wide): places of the document's words at which windows of an item start. words are lower-cased."""

    def of(f: Column) -> Column:
        wide = F.least(F.lit(window), F.size(f["words"]))
        inside = lambda at: (at >= 0) & (at + wide <= F.size(words))
        same = lambda start, s: inside(start + s) & (F.slice(words, F.greatest(start + s, F.lit(0)) + 1, wide) == F.slice(f["words"], s + 1, wide))
        offsets = F.sequence(F.lit(0), F.size(f["words"]) - wide)
        along = lambda start: F.transform(F.filter(offsets, lambda s: same(start, s)), lambda s: start + s)
        return F.struct(f["ids"].alias("ids"), F.array_distinct(F.flatten(F.transform(f["starts"], along))).alias("at"), wide.alias("wide"))

    return F.filter(F.transform(found, of), lambda m: F.size(m["at"]) > 0)


def phrase_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words long and matches array<ids, at, wide>: for each item text with an occurring window its ids, the word places
    (from 0) at which its windows start, and the words of a window.

    A window is `window` consecutive words of an item, or all of a shorter item. Null or wordless texts and items match
    nothing. Ids count once however many items share them; a null id has no name but its words are found. Repeated rows of
    docs have a row each. Empty tables give no rows, or rows without matches. Columns of docs that clash with n_words or
    matches are replaced.
    """
    index = Index.build(docs, items, text, item_id, item_text, window)
    own = [c for c in docs.columns if c not in ("n_words", "matches")]
    rows = docs.select(F.struct(*own).alias("row"), *text_key(F.col(text))).join(index.candidates(), _KEY, "left")
    whole = F.col("row").getField(text)
    words = F.transform(cased_words(whole), lower_word)
    none = "array<struct<ids:array<string>,at:array<int>,wide:int>>"
    matches = F.when(F.col("found").isNotNull(), let(words, lambda w: _phrases(F.col("found"), w, window))).otherwise(F.array().cast(none))
    return rows.select("row.*", F.size(cased_words(whole)).cast("long").alias("n_words"), matches.alias("matches"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurring window), items (distinct ids of the items found, sorted strings) and
    contaminated (n_hit > 0). See phrase_matches for awkward rows."""
    found = phrase_matches(docs, items, text, item_id, item_text, window)
    places = lambda m: F.flatten(F.transform(m["at"], lambda p: F.sequence(p, p + m["wide"] - 1)))
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", places)))).cast("long")
    ids = F.array_sort(F.array_distinct(F.flatten(F.col("matches.ids"))))
    return found.withColumns({"n_hit": hit, "items": ids}).withColumn("contaminated", F.col("n_hit") > 0).drop("matches")
