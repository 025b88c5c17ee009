"""Personal data: patterns with check digits, and terms that reveal it, in DataFrame operations only.

The base finds emails, addresses, cards and phone numbers. The method then asks which other words
would still give them away: a word near a protected value reveals it if seeing the word makes the
value likely. Over the whole corpus, with n(e, t) the times that term t stands near value e, the
pointwise mutual information log(n(e, t) N / (n(e) n(t))) is compared with the value's information
log(N / n(e)); their ratio is 1 if the term stands nowhere else. Above a first threshold a term is
generalised (replaced by what it is), above a second one removed. A term counts only if it stands
near the value in several different contexts, so words of one text, however often copied, do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import chars, sums_before
from corpuskit.llm.common import quoted, stored, text_key

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
_HOST = "[A-Za-z0-9-]++"
# The four shapes. Repeats are possessive where nothing behind them could need a
# shorter one, and a match begins at the start of its run or where the last one ended, so no run of
# characters is read twice.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_HOST}(?:\.{_HOST})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "(?:0++(?![0-9])|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"
IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
TERM = r"\p{L}+"
CONTEXT = 100


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    doubled = F.transform(chars(F.reverse(digits)), lambda c, i: F.when(
        i % 2 == 0, F.ascii(c) - 48
    ).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """What a match must satisfy beyond its shape."""
    if kind == "ip":
        return match.rlike(IP)
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


SPAN = (
    "array<struct<start:int,rank:int,stop:int,kind:string,value:string,before:string,after:string,"
    "cut_before:boolean,cut_after:boolean>>"
)


def _span(kind: str):
    gaps, at = F.col(f"_gaps_{kind}"), F.col(f"_at_{kind}")

    def span(match: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        start = (F.get(at, i) + F.length(before)).cast("int")
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(match)).alias("stop"),
            F.lit(kind).alias("kind"), match.alias("value"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
            (F.length(before) > CONTEXT).alias("cut_before"), (F.length(after) > CONTEXT).alias("cut_after"),
        )

    return span


def _holding(kind: str):
    return lambda s: holds(kind, s["value"])


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: the spans of all kinds by start, then kind, with their surroundings."""
    c = F.coalesce(quoted(text), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs
    for kind, pattern in PATTERNS.items():
        some = c.contains(NEEDS[kind]) if NEEDS[kind] else c.rlike("[0-9]")
        out = out.withColumn(
            f"_found_{kind}", F.when(some, F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(none)
        )
    for kind, pattern in PATTERNS.items():
        found = F.col(f"_found_{kind}")
        out = out.withColumn(f"_gaps_{kind}", F.when(F.size(found) > 0, F.split(c, pattern, -1)).otherwise(none))
    for kind in PATTERNS:
        steps = F.zip_with(
            F.slice(f"_gaps_{kind}", 1, F.size(f"_found_{kind}")), f"_found_{kind}",
            lambda gap, match: F.length(gap) + F.length(match),
        )
        out = out.withColumn(f"_steps_{kind}", steps)
    for kind in PATTERNS:
        out = out.withColumn(f"_at_{kind}", sums_before(F.col(f"_steps_{kind}")))
    spans = [F.filter(F.transform(f"_found_{kind}", _span(kind)), _holding(kind)).cast(SPAN) for kind in KINDS]
    return out.withColumn("base", F.array_sort(F.concat(*spans))).select(
        *[quoted(x) for x in docs.columns if x.lower() != "base"], "base"
    )


def context_terms(found: DataFrame) -> DataFrame:
    """(doc_id, key, kind, value, context, term, start, stop): the words near each base span."""
    spans = found.filter(F.size("base") > 0).select("doc_id", "key", F.explode("base").alias("s")).select(
        "doc_id", "key", "s.*"
    ).withColumn("value", F.lower("value")).withColumn("context", F.xxhash64("before", "after"))
    sides = spans.select(
        "doc_id", "key", "kind", "value", "context", F.explode(F.array(
            F.struct((F.col("start") - F.length("before")).alias("at"), F.col("before").alias("words"),
                     F.col("cut_before").alias("cut_left"), F.lit(False).alias("cut_right")),
            F.struct(F.col("stop").alias("at"), F.col("after").alias("words"),
                     F.lit(False).alias("cut_left"), F.col("cut_after").alias("cut_right")),
        )).alias("side")
    ).select("doc_id", "key", "kind", "value", "context", "side.*")
    cut = sides.withColumn("found", F.regexp_extract_all("words", F.lit(TERM), F.lit(0))).withColumn(
        "gaps", F.split("words", TERM, -1)
    ).withColumn("before", sums_before(F.zip_with(
        F.slice("gaps", 1, F.size("found")), "found", lambda gap, word: F.length(gap) + F.length(word)
    )))
    n = F.size("found")
    return cut.select(
        "doc_id", "key", "kind", "value", "context", "at", "cut_left", "cut_right", "gaps", "before",
        n.alias("n"), F.posexplode_outer("found").alias("i", "term"),
    ).filter(
        # a word cut by the edge of the context is no word
        ~(F.col("cut_left") & (F.col("i") == 0) & (F.get("gaps", F.lit(0)) == ""))
        & ~(F.col("cut_right") & (F.col("i") == F.col("n") - 1) & (F.get("gaps", F.col("n")) == ""))
    ).withColumn("start", F.col("at") + F.get("before", F.col("i")) + F.length(F.get("gaps", F.col("i")))).select(
        "doc_id", "key", "kind", "value", "context", F.lower("term").alias("term"), "start",
        (F.col("start") + F.length("term")).alias("stop"),
    )


def disclosing_terms(docs: DataFrame, found: DataFrame, near: DataFrame, generalise: float, remove: float,
                     contexts: int) -> DataFrame:
    """(kind, value, term, disclosure, action) of the terms at or above the first threshold.

    Term counts are taken over every word of every document.
    """
    # explode_outer: the plain one would first filter by the array's size and so run the pattern twice
    words = docs.select(
        F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term")
    ).filter("term is not null")
    counts = stored(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "terms")
    total = counts.agg(F.sum("n_term")).first()[0] or 0
    values = found.filter(F.size("base") > 0).select(F.explode("base").alias("s")).groupBy(
        F.col("s.kind").alias("kind"), F.lower("s.value").alias("value")
    ).agg(F.count(F.lit(1)).alias("n_value"))
    pairs = near.groupBy("kind", "value", "term", "context").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "kind", "value", "term"
    ).agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= contexts)
    known = pairs.join(values, ["kind", "value"]).join(counts, "term")
    # a term near two mentions of one value counts for each; it cannot reveal more than all
    share = F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))
    information = F.log(F.lit(float(max(total, 1))) / F.col("n_value"))
    shared = F.log(share) + information
    disclosure = F.when(information > 0, shared / information)
    return known.withColumn("disclosure", disclosure).filter(F.col("disclosure") >= generalise).select(
        "kind", "value", "term", "disclosure",
        F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"),
    )


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: float = 0.9, remove: float = 0.97,
         contexts: int = 3) -> DataFrame:
    """(doc_id, key, base, terms) per row: base spans, and terms (start, stop, action) that disclose them.

    ``key`` tells texts of one id apart; rows alike in both get the same spans. A term span never
    overlaps a base span. Null and empty texts have no spans; other columns are ignored; no rows
    give none.
    """
    slim = docs.select(quoted(doc_id).alias("doc_id"), text_key(text).alias("key"), quoted(text).alias("text"))
    found = stored(with_base_spans(slim).drop("text"), "spans")
    near = stored(context_terms(found), "contexts")
    telling = stored(disclosing_terms(slim, found, near, generalise, remove, contexts), "disclosing")
    marked = near.join(telling, ["kind", "value", "term"]).groupBy("doc_id", "key", "start", "stop").agg(
        F.max("action").alias("action")  # remove is the stronger and the later word
    ).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "action"))).alias("terms")
    )
    out = found.join(
        marked.withColumnsRenamed({"doc_id": "m_id", "key": "m_key"}),
        F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left",
    )
    clear = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return out.select(
        "doc_id", "key", "base",
        F.coalesce(clear, F.array().cast("array<struct<start:int,stop:int,action:string>>")).alias("terms"),
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    ), ",")


def _all_spans() -> Column:
    """Base spans and terms by start, then kind, terms last."""
    plain = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")
    ))
    terms = F.transform("terms", lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["stop"].alias("stop"),
        F.when(s["action"] == "remove", "removed_term").otherwise("term").alias("kind"),
    ))
    return F.array_sort(F.concat(plain, terms))


def personal_data(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per document: doc_id, counts per kind, base_sha256 and all spans as text."""
    found = find(docs, **thresholds)
    return found.select(
        "doc_id",
        *[_count(k) for k in KINDS],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(_all_spans()).alias("spans"),
    )


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """The documents with ``text`` sanitised: values become [KIND], terms become [term] or nothing.

    Where base spans overlap, the one that starts first (then by kind) is written and the others
    are swallowed up to their ends. Other columns stay; a null text stays null.
    """
    found = find(docs, doc_id, text, **thresholds).select(
        F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), _all_spans().alias("f_spans")
    ).filter(F.size("f_spans") > 0).dropDuplicates(["f_id", "f_key"])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[quoted(c).alias(n) for c, n in at.items()]).withColumn("key", text_key(at[text]))
    joined = own.join(found, F.col(at[doc_id]).eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left")
    body = F.col(at[text])
    mark = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        name = F.when(s["kind"] == "removed_term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        plain = F.substr(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.concat(acc["out"], plain, F.when(s["start"] >= acc["at"], name).otherwise("")).alias("out"),
        )

    made = F.aggregate("f_spans", mark, step, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)))
    return joined.withColumn(at[text], F.when(F.col("f_spans").isNull(), body).otherwise(made)).select(
        *[F.col(n).alias(c) for c, n in at.items()]
    )
