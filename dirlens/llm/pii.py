"""Personal data in texts, and the words beside it that reveal it.

Four kinds of protected entities are found by pattern: e-mail addresses, IP addresses, payment cards and phone
numbers. Words of the same documents may disclose as much as the entities do. How much a word t tells about an
entity c is estimated from the corpus: with document frequencies df and N documents,

    PMI(c; t) = log(joint(c, t) N / (df(c) df(t)))        IC(c) = log(N / df(c))

and t discloses the share PMI / IC of the information in c. Words that reach ``THRESHOLD``, and meet the entity in at least
``SUPPORT`` documents, get a span of their own; those that disclose everything are removed from a text, the others are generalised. All of it is DataFrame
expressions; frequencies are counted over all documents, and only documents with entities carry their text further.

With ``window=None`` joint(c, t) counts whole documents, as df does, and every occurrence of a disclosing word in a
document with the entity gets a span. As joint is at most df(c), no word with df(t) over df(c)^threshold N^(1-threshold)
can reach the threshold; such pairs are dropped before anything is shuffled. With a window, joint counts documents
with t within so many code points of c, and only these occurrences get spans: less than the whole method.

Defined results: a null text is empty; a null id stays null; repeated rows are documents of their own and count as such;
offsets count code points, the end is exclusive; an entity that every document has discloses nothing;
a word that overlaps an entity gets no span; without documents there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlens.llm.common import texts, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
THRESHOLD = 0.9
#: Documents in which an entity and a word must meet before the word can disclose the entity: a meeting alone is chance.
SUPPORT = 2
#: At most so many frequent words, and as many frequent entities, are broadcast to drop pairs early.
FREQUENT = 1 << 16

# The patterns asked for. Quantifiers are possessive where no other cut can match, and a match starts at
# the start of a run: this finds the same, reads long runs once and needs no stack for long repetitions.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"[\p{L}\p{N}]+"
#: Pieces of a text that no word crosses.
_CHUNK = r"(?s).{1,1024}+[\p{L}\p{N}]*+"

_SPAN = "struct<kind:string,first:bigint,last:bigint,hit:string>"


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches; their places are the lengths of what lies between them, added up."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    none = F.array().cast(f"array<{_SPAN}>")

    def add(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["piece"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), (first + F.length(x["hit"])).alias("last"), x["hit"].alias("hit"))
        return F.struct(span["last"].alias("at"), F.array_append(acc["spans"], span).cast(f"array<{_SPAN}>").alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    both = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))
    return F.when(F.regexp(text, F.lit(pattern)), F.aggregate(both, start, add, lambda acc: acc["spans"])).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """The digits from the right, every second one doubled and its digits added, sum to a multiple of ten."""

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    digits = F.filter(F.split(F.reverse(_digits(hit)), ""), lambda c: c != "")
    return F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, d: a + d) % 10 == 0


def _small(part: Column) -> Column:
    kept = F.regexp_replace(part, "^0+", "")
    return (F.length(kept) < 3) | ((F.length(kept) == 3) & (kept <= "255"))


def entities(text: Column) -> Column:
    """Spans of the protected entities of a text, by kind as listed, then start."""
    length = lambda hit: F.length(_digits(hit))
    return F.concat(
        _placed(text, _EMAIL, "email"),
        F.filter(_placed(text, _IP, "ip"), lambda s: F.forall(F.split(s["hit"], r"\."), _small)),
        F.filter(_placed(text, _CARD, "card"), lambda s: length(s["hit"]).between(13, 19) & _luhn(s["hit"])),
        F.filter(_placed(text, _PHONE, "phone"), lambda s: length(s["hit"]).between(9, 15)),
    )


def _entity(span: Column) -> Column:
    """One name for all ways to write an entity."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["hit"])).otherwise(F.lower(span["hit"]))
    return F.concat_ws(":", span["kind"], value)


def _nearby(found: DataFrame, window: int) -> DataFrame:
    """(uid, entity, term, first, last): whole words within the window of an entity, clear of all entities."""
    spans = found.select("uid", "text", "spans", F.explode("spans").alias("s"))
    left, right = F.greatest(F.col("s.first") - window, F.lit(0)), F.least(F.col("s.last") + window, F.length("text"))
    # a character more on either side shows whether a word goes on
    start = F.greatest(left - 1, F.lit(0))
    view = F.substring(F.col("text"), (start + 1).cast("int"), (right + 1 - start).cast("int"))
    words = spans.select(
        "uid", _entity(F.col("s")).alias("entity"), "spans", left.alias("left"), right.alias("right"), start.alias("start"),
        F.explode(_placed(view, _WORD, TERM)).alias("w"),
    ).select("uid", "entity", "spans", "left", "right", F.lower("w.hit").alias("term"),
             (F.col("w.first") + F.col("start")).alias("first"), (F.col("w.last") + F.col("start")).alias("last"))
    clear = ~F.exists("spans", lambda s: (s["first"] < F.col("last")) & (F.col("first") < s["last"]))
    return words.filter((F.col("first") >= F.col("left")) & (F.col("last") <= F.col("right")) & clear).drop("spans", "left", "right")


def _words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), lambda w: F.lower(w)))


def _places(found: DataFrame, passed: DataFrame) -> DataFrame:
    """(uid, term, first, last): the words of whole texts that are clear of all entities, without the terms of ``passed``."""
    none = F.array().cast("array<struct<start:bigint,chunk:string>>")

    def add(acc: Column, chunk: Column) -> Column:
        cut = F.array_append(acc["cut"], F.struct(acc["at"].alias("start"), chunk.alias("chunk")))
        return F.struct((acc["at"] + F.length(chunk)).alias("at"), cut.cast("array<struct<start:bigint,chunk:string>>").alias("cut"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("cut"))
    chunks = F.aggregate(F.regexp_extract_all(F.col("text"), F.lit(_CHUNK), F.lit(0)), zero, add, lambda acc: acc["cut"])
    words = found.select("uid", "spans", F.explode(chunks).alias("c")).select(
        "uid", "spans", "c.start", F.explode(_placed(F.col("c.chunk"), _WORD, TERM)).alias("w")
    ).select("uid", "spans", F.lower("w.hit").alias("term"), (F.col("w.first") + F.col("start")).alias("first"), (F.col("w.last") + F.col("start")).alias("last"))
    words = words.join(F.broadcast(passed.select("term")), "term", "left_anti")
    clear = ~F.exists("spans", lambda s: (s["first"] < F.col("last")) & (F.col("first") < s["last"]))
    return words.filter(clear).select("uid", "term", "first", "last")


def _sum(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def _met(found: DataFrame, holders: DataFrame, counts: DataFrame, total: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(uid, entity, term) of whole documents, without pairs too frequent to reach the threshold; and terms that reach it with no entity.

    What is dropped is decided by exact counts of the frequent words and entities; those not broadcast are taken as rare
    and stay, so nothing is lost, and the threshold itself is applied to what is left.
    """

    def limit(df_c: Column) -> Column:
        # a little more, against rounding
        return F.pow(df_c.cast("double"), F.lit(threshold)) * float(total) ** (1 - threshold) * (1 + 1e-9)

    # more than the share 1 / FREQUENT of all: fewer than FREQUENT rows
    words = counts.filter((F.col("df_t") > _sum(counts, "df_t") / FREQUENT) & (F.col("df_t") > limit(F.lit(1))))
    least = max(_sum(holders, "df_c") / FREQUENT, 1.0)
    known = holders.filter(F.col("df_c") > least)
    pairs = found.select("uid", F.array_distinct(F.transform("spans", _entity)).alias("entities"), _words(F.col("text")).alias("terms"))
    pairs = pairs.select("uid", "terms", F.explode("entities").alias("entity")).join(F.broadcast(known), "entity", "left")
    pairs = pairs.select("uid", "entity", limit(F.coalesce("df_c", F.lit(least))).alias("limit"), F.explode("terms").alias("term"))
    pairs = pairs.join(F.broadcast(words), "term", "left").filter(F.col("df_t").isNull() | (F.col("df_t") <= F.col("limit")))
    most = holders.filter(F.col("df_c") < total).agg(F.max("df_c")).first()[0] or 1
    return written(pairs.select("uid", "entity", "term"), "pii-met"), words.filter(F.col("df_t") > limit(F.lit(most)))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None, threshold: float = THRESHOLD,
          support: int = SUPPORT) -> DataFrame:
    """(doc_id, text, spans): entities and disclosing terms of every document, by kind as listed, then start.

    ``text`` is null where there are no spans. A term's ``hit`` says what becomes of it: removed or generalised.
    Whole documents count; a ``window`` of so many code points on either side of an entity counts and marks less.
    """
    rows = texts(docs, id_col, text_col)
    base = rows.select("doc_id", "text", entities(F.col("text")).alias("spans"))
    base = written(
        base.select("doc_id", F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans").withColumn("uid", F.monotonically_increasing_id()), "pii-base"
    )
    with_any = base.filter(F.size("spans") > 0)
    total = base.count()
    holders = with_any.select("uid", F.explode("spans").alias("s")).select("uid", _entity(F.col("s")).alias("entity")).distinct()
    holders = written(holders.groupBy("entity").agg(F.count("*").alias("df_c")), "pii-holders")
    near = None if window is None else written(_nearby(with_any, window).distinct(), "pii-near")
    wanted = (with_any.select(F.explode(_words(F.col("text"))).alias("term")) if near is None else near.select("term")).distinct()
    vocabulary = rows.select(F.explode(_words(F.col("text"))).alias("term"))
    counts = written(vocabulary.groupBy("term").agg(F.count("*").alias("df_t")).join(wanted, "term", "left_semi"), "pii-words")
    if near is None:
        met, passed = _met(with_any, holders, counts, total, threshold)
    else:
        met = near.select("uid", "entity", "term").distinct()
    held = met.groupBy("entity", "term").agg(F.count("*").alias("joint")).filter(F.col("joint") >= support)
    n = F.lit(float(total))
    told = F.col("joint") * n / (F.col("df_c") * F.col("df_t"))
    all_of_it = n / F.col("df_c")
    pairs = held.join(holders, "entity").join(counts, "term").filter((all_of_it > 1) & (told >= F.pow(all_of_it, F.lit(threshold))))
    pairs = written(pairs.select("entity", "term", F.when(told >= all_of_it, "removed").otherwise("generalised").alias("fate")), "pii-pairs")
    if near is None:
        fates = met.join(pairs, ["entity", "term"]).groupBy("uid", "term").agg(F.max("fate").alias("hit"))
        terms = _places(with_any, passed).join(fates, ["uid", "term"]).select("uid", "first", "last", "hit")
    else:
        terms = near.join(pairs, ["entity", "term"]).groupBy("uid", "first", "last").agg(F.max("fate").alias("hit"))
    terms = terms.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct(F.lit(TERM).alias("kind"), "first", "last", "hit"))).cast(f"array<{_SPAN}>").alias("terms")
    )
    whole = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.concat("spans", "terms"))
    return base.join(terms, "uid", "left").select("doc_id", "text", whole.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities replaced by their kind, removed terms cut and generalised ones reduced to their sort."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))))

    def mark(s: Column) -> Column:
        word = F.substring(text, (s["first"] + 1).cast("int"), (-s["end"] - s["first"]).cast("int"))
        sort = F.when(word.rlike(r"^\p{N}+$"), "[number]").when(word.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
        return F.when(s["kind"] != TERM, F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["hit"] == "removed", "").otherwise(sort)

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["first"] - acc["at"]).cast("int"))
        fresh = s["first"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], -s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, mark(s))).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = F.length(text)
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), rest)))
