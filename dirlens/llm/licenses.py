"""Licences named or quoted in texts, by ordered signature rules.

The words of a text are lower-cased and joined by one space; its keywords are those of its words that some rule asks for. Only
rules whose keyword is there are applied, and most of them only beside the word "license" itself.
Where a rule matches, marks are put around the match and the words cut apart again; the marked words' numbers are its
place, in time linear in the text.

Detections that overlap are resolved by containment and priority: a detection goes if the interval of another one contains
it whose tier is the same or a better one; of equal intervals the earlier rule stays. Detections that merely overlap both stay. All of it
is DataFrame expressions. One window over the detections of the texts that have any finds what is contained; a text is a
group of its own, however many texts are alike.

Defined results: a null text is empty; an empty text has no words, no detections and the score 0; a null id stays null;
repeated rows are scanned each; other columns are not looked at; without documents there are no rows. Words are counted
from 0, the end of a detection is exclusive. Detections of the base phrases ("mit license", "apache license", "general public license") are
counted, and keep their labels, even if a longer detection contains them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlens.llm.common import texts
from dirlens.llm.license_rules import CERTAINTY, KEYWORDS, RULES, Rule, needs_licence

# Fixed value: what isn't part of a word, after A-Z was lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around a match. No word has them.
_OPEN, _CLOSE = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "struct<first:int,last:int,rule:int>"


def normalised(text: Column) -> Column:
    """The words of a text, lower-cased and joined by one space."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BETWEEN, " "))


def _whole_words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def _constants(rules: list[Rule]) -> Column:
    """The rules as an array of constants."""
    return F.array(*(
        F.struct(F.lit(n).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(_whole_words(r.pattern)).alias("pattern"), F.lit(needs_licence(r.pattern)).alias("needs"))
        for n, r in enumerate(rules)
    ))


def _places(norm: Column, rule: Column) -> Column:
    """Word intervals of all matches of a rule."""
    marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}")), " ")

    def numbers(is_marked) -> Column:
        return F.filter(F.transform(marked, lambda w, i: F.when(is_marked(w), i)), lambda i: i.isNotNull())

    firsts, lasts = numbers(lambda w: F.startswith(w, F.lit(_OPEN))), numbers(lambda w: F.endswith(w, F.lit(_CLOSE)))
    both = F.arrays_zip(firsts.alias("first"), lasts.alias("last"))
    return F.transform(both, lambda x: F.struct(x["first"].alias("first"), (x["last"] + 1).alias("last"), rule["rule"].alias("rule")))


def _detections(norm: Column, present: Column, rules: list[Rule]) -> Column:
    """All matches of all rules whose keywords are among the words."""
    licence = F.array_contains(present, "license") | F.array_contains(present, "licence")
    some = F.filter(_constants(rules), lambda r: F.array_contains(present, r["keyword"]) & (~r["needs"] | licence))
    return F.flatten(F.transform(some, lambda r: _places(norm, r)))


def _of_rule(rules: list[Rule], value, rule: Column) -> Column:
    """A property of a rule, by its number."""
    return F.element_at(F.array(*(F.lit(value(r)) for r in rules)), rule + 1)


def _contained(rules: list[Rule]) -> Column:
    """An interval of the same or a better tier contains this one: it came before, in the order of starts, and ends as late or later."""
    order = Window.partitionBy("uid").orderBy(F.asc("s.first"), F.desc("s.last"), F.asc("s.rule")).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.max(F.when(F.col("tier") <= tier, F.col("s.last"))).over(order) for tier in sorted(CERTAINTY)]
    return F.coalesce(F.element_at(F.array(*ends), F.col("tier")) >= F.col("s.last"), F.lit(False))


def find(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): the number of words, and all detections by start, a longer one first.

    A span has first, last, rule (its number in ``rules``), label, tier, base, and kept: no other detection contains it.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    rows = texts(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    words = F.split("norm", " ")
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.size(words)).cast("long"))
    rows = rows.withColumn("present", F.array_intersect(words, F.array(*map(F.lit, sorted({*KEYWORDS, *(r.keyword for r in rules)})))))
    found = F.when(F.size("present") > 0, _detections(F.col("norm"), F.col("present"), rules)).otherwise(none)
    # Texts are numbered where they are read: a repeated task reads the same ones
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_words", found.alias("found"))
    each = rows.select("uid", "doc_id", "n_words", F.explode_outer("found").alias("s")).withColumn("tier", _of_rule(rules, lambda r: r.tier, F.col("s.rule")))
    rule = F.col("s.rule")
    span = F.when(rule.isNotNull(), F.struct(
        "s.first", "s.last", "s.rule", _of_rule(rules, lambda r: r.label, rule).alias("label"), "tier",
        _of_rule(rules, lambda r: r.base, rule).alias("base"), (~F.col("contained")).alias("kept"),
    ))
    marked = each.withColumn("contained", _contained(rules)).select("uid", "doc_id", "n_words", span.alias("span"))
    by_place = F.array_sort(F.collect_list("span"), lambda a, b: (
        F.when(a["first"] != b["first"], a["first"] - b["first"]).when(a["last"] != b["last"], b["last"] - a["last"]).otherwise(a["rule"] - b["rule"])
    ))
    return marked.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), by_place.alias("spans")).drop("uid")


def labels(spans: Column) -> Column:
    """The distinct labels of the detections that stay and of the base phrases, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s["kept"] | s["base"]), lambda s: s["label"])))


def score(spans: Column) -> Column:
    """How sure it is that a text has a licence: 1 minus the product of the doubts of its distinct rules; 0 without detections."""
    certainty = F.create_map(*(F.lit(x) for pair in CERTAINTY.items() for x in pair))
    rules = F.array_distinct(F.transform(F.filter(spans, lambda s: s["kept"] | s["base"]), lambda s: F.struct(s["rule"], s["tier"])))
    return 1 - F.aggregate(rules, F.lit(1.0), lambda doubt, r: doubt * (1 - certainty[r["tier"]]))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, the base phrases' number, smallest and largest start and labels, all labels, the score, and the detections that stay."""
    spans = F.col("spans")
    base = F.transform(F.filter(spans, lambda s: s["base"]), lambda s: s["first"])
    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s["base"]), lambda s: s["label"])))
    stay = F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.concat_ws(":", s["label"], s["first"], s["last"]))
    return find(docs, RULES, id_col, text_col).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels(spans), ",").alias("labels"), score(spans).alias("score"), F.array_join(stay, ",").alias("spans"),
    )
