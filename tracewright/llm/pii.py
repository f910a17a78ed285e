"""Personal data by bootstrapped contextual extraction, in built-in functions only.

*Base.* E-mail and IP addresses, card and phone numbers are the leftmost non-overlapping
matches of one expression a kind, less those that fail a numeric test. ``split`` gives the
gaps between matches, so offsets are running sums of lengths (code points, end exclusive).
The expressions are the plain ones with possessive loops and a bar against starting inside
a run, which leaves their matches as they are and their time linear.

*Instances.* Tokens with a digit or an @, and runs of numbers, that no base span touches, are unknown
instances. Seeds are the base spans and the ``secret`` ones among the instances: cloud access keys of the
published form, and what is assigned to a word of ``CREDENTIALS``.

*Patterns.* An occurrence has lexical patterns (the one to three words before it, the word after it; lower
case, numbers as 0, cut at punctuation), and two to back off to: the operator (= or :) that assigns it, and its own shape.
A pattern is of the kind with most known distinct instances, ``SUPPORT`` at least. The confidence of a lexical one is the share of
known instances in all its occurrences in the corpus, whatever stands in the slot; that of the others the share of
known ones in its distinct instances.

*Graph.* Patterns and instances score each other in rounds. An unknown instance is accepted, for a kind, by a lexical
pattern of confidence ``CONFIDENT`` at least, or by an operator and a shape of ``AGREE`` each, if the chance
that all of them err, ``1 - prod(1 - confidence)`` over the best of each sort, leaves ``ACCEPT``. Accepted
instances are known from then on, until none is added. Spans are the occurrences of accepted instances; those shorter than
``SPECIFIC`` only where a trusted lexical pattern stands.

Defined cases: null or empty text has no spans; null and repeated ids are rows of their own
(rows equal in id and text share one result); ties of score go to the kind listed first; spans of several kinds may overlap, all
are listed; an empty table gives an empty table; very long texts are taken whole; only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import let

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Punctuation that ends a word of the context, and is no part of a token.
MARKS = r"\"'`=,;:<>(){}\[\]|#!?*&$%"
TOKEN = rf"(?<![^{common.SPACE}{MARKS}])[^0-9@{common.SPACE}{MARKS}]*+[0-9@][^{common.SPACE}{MARKS}]*+"
NUMBERS = r"(?<![0-9A-Za-z+(])[+(]?[0-9]++(?:[\x20().-]{1,2}+[0-9]++)++"
#: Words whose values are secrets, and the published form of access key ids.
CREDENTIALS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "access_token", "auth_token", "api_key", "apikey", "api-key", "secret_key", "access_key", "client_secret")
ACCESS_KEY = "^(?:AKIA|ASIA)[A-Z0-9]{16}$"
SHORTEST, SPECIFIC = 4, 8
SUPPORT, CONFIDENT, AGREE, ACCEPT = 3, 0.5, 0.25, 0.6
#: Words of the context before an instance.
CONTEXT = 3
#: Bytes up to which the patterns to be counted are broadcast.
COUNTED_BYTES = 64 << 20
_CHUNK = 256


def running_sums(steps: Column) -> Column:
    """Exclusive running sums of an int array: by chunks, so that appending stays cheap on long arrays."""
    inner, outer = "struct<total:int,out:array<int>>", "struct<total:int,out:array<array<int>>>"
    start = lambda kind, item: F.struct(F.lit(0).alias("total"), F.array().cast(item).alias("out")).cast(kind)
    add = lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out")).cast(inner)
    join = lambda a, x: F.struct((a["total"] + x["total"]).alias("total"), F.concat(a["out"], F.array(F.transform(x["out"], lambda v: v + a["total"]))).alias("out")).cast(outer)
    chunks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int")), lambda c: F.aggregate(F.slice(s, c * _CHUNK + 1, _CHUNK), start(inner, "array<int>"), add))
    return let(steps, lambda s: F.when(F.size(s) > 0, F.flatten(F.aggregate(chunks(s), start(outer, "array<array<int>>"), join)["out"])).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """``start, end, value, before, after`` of each match; the last two are the gaps around it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    with_starts = lambda x: let(
        running_sums(F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: F.length(m) + F.length(g))),
        lambda s: F.transform(x["m"], lambda m, i: _match(F.get(s, i) + F.length(F.get(x["g"], i)), m, F.get(x["g"], i), F.get(x["g"], i + 1))),
    )
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), with_starts)))


def _match(start: Column, value: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), before.alias("before"), after.alias("after"))


def _luhn(digits: Column) -> Column:
    at = lambda r, i: F.substr(r, i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    weigh = lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda t, i: t + F.when(i % 2 == 0, doubled(at(r, i))).otherwise(at(r, i)))
    return let(F.reverse(digits), weigh) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if KINDS[kind] == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if KINDS[kind] == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if KINDS[kind] == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def context_words(text: Column) -> Column:
    """Lower-case words, numbers as 0, cut at blanks and behind each of MARKS."""
    plain = F.regexp_replace(common.lower_ascii(text), "[0-9]+", "0")
    return F.filter(F.split(F.regexp_replace(plain, f"([{MARKS}])", "$1 "), f"[{common.SPACE}]+"), lambda w: w != "")


def shape_of(value: Column) -> Column:
    """Numbers digit by digit; long mixtures of letters and digits as such; else runs of letters and of digits."""
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    return F.when(~value.rlike("[A-Za-z]"), F.translate(value, "123456789", "0" * 9)).when(value.rlike("^[a-z0-9]{16,}$"), "x16").when(value.rlike("^[A-Z0-9]{16,}$"), "X16").otherwise(runs)


_FEATURE = "struct<sort:string,name:string,gram:bigint>"
_SPAN = f"struct<start:int,kind:int,end:int,value:string,features:array<{_FEATURE}>>"


def _features(m: Column) -> Column:
    """``words, after`` of a match -> its patterns; ``gram`` is the key of a lexical one's words."""

    def feature(sort: str, name: Column, *words: Column) -> Column:
        gram = F.xxhash64(*words) if words else F.lit(None).cast("long")
        return F.struct(F.lit(sort).alias("sort"), name.alias("name"), gram.alias("gram")).cast(_FEATURE)

    w = lambda i: F.element_at(m["words"], F.lit(i))
    some = lambda x: x.rlike("[^\\x00-`{-\\x7F]")  # a letter
    out = []
    for k in range(1, CONTEXT + 1):
        words = [w(i) for i in range(-k, 0)]
        name = F.concat_ws(" ", *words)
        out.append(F.when((F.size(m["words"]) >= k) & some(name), feature(f"b{k}", name, *words)))
    out.append(F.when(some(m["after"]), feature("a1", m["after"], m["after"])))
    operator = F.regexp_extract(F.concat_ws(" ", m["words"]), r"([=:])(?: [\"'`])?$", 1)
    out.append(F.when(operator != "", feature("operator", operator)))
    out.append(feature("shape", shape_of(m["value"])))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _described(m: Column, kind: int) -> Column:
    """A match with its patterns; a candidate's kind tells seeds of secrets from unknown ones (-1)."""
    last = lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT, F.lit(0)) + 1, CONTEXT + 1)
    parts = F.struct(m["start"].alias("start"), m["value"].alias("value"), let(context_words(m["before"]), last).alias("words"), F.coalesce(F.get(context_words(F.regexp_extract(m["after"], f"^[{common.SPACE}]*[^{common.SPACE}]*", 0)), F.lit(0)), F.lit("")).alias("after"))

    def span(x: Column) -> Column:
        known = F.lit(kind)
        if kind < 0:
            key = F.regexp_extract(F.concat_ws(" ", x["words"]), r"([a-z_-]+) ?[=:](?: [\"'`])?$", 1)
            known = F.when(x["value"].rlike(ACCESS_KEY) | key.isin(*CREDENTIALS), KINDS.index("secret")).otherwise(-1)
        return F.struct(x["start"].alias("start"), known.alias("kind"), (x["start"] + F.length(x["value"])).alias("end"), F.lower(x["value"]).alias("value"), _features(x).alias("features")).cast(_SPAN)

    return let(parts, span)


def _spans(text: Column, kind: int) -> Column:
    """Spans of one base kind, validated, with their patterns."""
    found = F.when(F.contains(text, F.lit("@")) if KINDS[kind] == "email" else text.rlike("[0-9]"), matches(text, PATTERNS[kind]))
    kept = found if KINDS[kind] == "email" else F.filter(found, lambda m: _valid(kind, m["value"]))
    return F.coalesce(F.transform(kept, lambda m: _described(m, kind)), F.array().cast(f"array<{_SPAN}>"))


def _candidates(text: Column) -> Column:
    trimmed = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_replace(m["value"], "[./+_~-]+$", "").alias("value"), m["before"].alias("before"), m["after"].alias("after"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    one = F.transform(matches(text, TOKEN), trimmed)
    more = F.filter(matches(text, NUMBERS), lambda m: m["value"].rlike(r"[\x20()]"))
    both = F.filter(F.concat(F.coalesce(one, none), F.coalesce(more, none)), lambda m: F.length(m["value"]) >= SHORTEST)
    return F.coalesce(F.when(text.rlike("[0-9@]"), F.transform(both, lambda m: _described(m, -1))), F.array().cast(f"array<{_SPAN}>"))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, text_hash, base, candidates`` of every row, checkpointed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = rows.select("doc_id", "text_hash", F.array_sort(F.concat(*(_spans(text, k) for k in range(BASE)))).alias("base"), _candidates(text).alias("candidates"))
    return common.checkpoint(found.withColumn("row", F.monotonically_increasing_id()))


def gram_counts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``gram, total``: how often each of the ``wanted(gram)`` runs of words occurs in all texts."""
    grams = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))
    each = let(context_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.concat(*(grams(w, k) for k in range(1, CONTEXT + 1))))
    wanted = common.broadcast_if_small(common.checkpoint(wanted), 24, COUNTED_BYTES)
    return docs.select(F.explode(each).alias("gram")).join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("total"))


def discover(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame | None:
    """``row, added``: further spans from the pattern-instance graph; None if there are none."""
    spans = found.where(F.size("candidates") > 0).select("row", F.explode(F.concat(F.transform("base", lambda s: F.struct(F.lit(True).alias("base"), s.alias("s"))), F.transform("candidates", lambda s: F.struct(F.lit(False).alias("base"), s.alias("s"))))).alias("x"))
    spans = spans.select("row", "x.base", "x.s.*")
    by_place = W.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rowsBetween(1, W.unboundedFollowing))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    free = common.checkpoint(spans.withColumn("touched", touched).where("NOT base AND NOT touched").select("row", "start", "end", "kind", "value", "features"))
    if free.isEmpty():
        return None
    every = found.select(F.explode("base").alias("s")).select("s.kind", "s.value", "s.features").unionByName(free.select("kind", "value", "features"))
    #: The graph: how often a pattern stands at an instance.
    edges = every.select("kind", "value", F.explode("features").alias("f")).groupBy("f.sort", "f.name", "f.gram", "kind", "value").agg(F.count("*").alias("n"))
    edges = common.checkpoint(edges)
    lexical = F.col("gram").isNotNull()
    wanted = edges.where(lexical).groupBy("sort", "name", "gram").agg(F.count_distinct("value").alias("d")).where(F.col("d") >= SUPPORT).select("gram").distinct()
    totals = common.checkpoint(gram_counts(docs, text_col, wanted))
    edges = common.checkpoint(edges.join(totals.hint("merge"), "gram", "left"))
    unknown, accepted = edges.where("kind < 0").drop("kind"), edges.where("kind >= 0").select("value", "kind").distinct().limit(0)
    known = edges.where("kind >= 0")
    # A round takes what it accepts out of ``unknown``, so there is a last one.
    while True:
        patterns = common.checkpoint(trusted(known, unknown))
        fresh = common.checkpoint(scored(unknown, patterns))
        if fresh.isEmpty():
            break
        accepted = common.checkpoint(accepted.unionByName(fresh))
        known = common.checkpoint(known.unionByName(unknown.join(fresh, "value")))
        unknown = common.checkpoint(unknown.join(fresh.select("value"), "value", "left_anti"))
    # Seeds of secrets are known by what they are; the others by their value, in a trusted place if it is short.
    places = patterns.where(lexical & (F.col("confidence") >= CONFIDENT)).select("sort", "name", F.lit(True).alias("place")).distinct()
    met = free.where("kind < 0").join(common.broadcast_if_small(accepted.withColumnRenamed("kind", "found"), 40 + F.length("value")), "value")
    short = met.where(F.length("value") < SPECIFIC).select("row", "start", "end", "found", "value", F.explode("features").alias("f")).select("row", "start", "end", "found", "value", "f.sort", "f.name")
    short = short.join(common.broadcast_if_small(common.checkpoint(places), 64 + F.length("name")), ["sort", "name"]).select("row", "start", "end", "found", "value").distinct()
    added = met.where(F.length("value") >= SPECIFIC).select("row", "start", "end", "found", "value").unionByName(short).unionByName(free.where("kind >= 0").select("row", "start", "end", F.col("kind").alias("found"), "value"))
    return added.groupBy("row").agg(F.collect_list(F.struct("start", F.col("found").alias("kind"), "end", "value", F.array().cast(f"array<{_FEATURE}>").alias("features")).cast(_SPAN)).alias("added"))


def trusted(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """``sort, name, gram, kind, confidence`` of each pattern with SUPPORT known instances or more."""
    by_kind = known.groupBy("sort", "name", "gram", "total", "kind").agg(F.count_distinct("value").alias("values"), F.sum("n").alias("n"))
    best = by_kind.groupBy("sort", "name", "gram", "total").agg(F.max(F.struct("values", (-F.col("kind")).alias("k"), "n")).alias("best"), F.sum("values").alias("values"), F.sum("n").alias("n")).where(F.col("best.values") >= SUPPORT)
    other = unknown.groupBy(F.col("sort").alias("_sort"), F.col("name").alias("_name")).agg(F.count_distinct("value").alias("others"), F.sum("n").alias("more"))
    both = best.join(other, (F.col("sort") == F.col("_sort")) & (F.col("name") == F.col("_name")), "left").fillna(0, ["others", "more"])
    occurrences = F.greatest(F.coalesce("total", F.lit(0)), F.col("n") + F.col("more"))
    confidence = F.when(F.col("gram").isNotNull(), F.col("best.n") / occurrences).otherwise(F.col("best.values") / (F.col("values") + F.col("others")))
    return both.select("sort", "name", "gram", (-F.col("best.k")).alias("kind"), confidence.alias("confidence"))


def scored(unknown: DataFrame, patterns: DataFrame) -> DataFrame:
    """``value, kind`` of the unknown instances that the patterns accept."""
    useful = common.broadcast_if_small(common.checkpoint(patterns.where(F.col("confidence") >= AGREE).drop("gram")), 64 + F.length("name"))
    met = unknown.select("value", "sort", "name").join(useful, ["sort", "name"])
    best = lambda *sorts: F.coalesce(F.max(F.when(F.col("sort").isin(*sorts), F.col("confidence"))), F.lit(0.0))
    views = met.groupBy("value", "kind").agg(best("b1", "b2", "b3", "a1").alias("lexical"), best("operator").alias("operator"), best("shape").alias("shape"))
    by_word = F.when(F.col("lexical") >= CONFIDENT, 1 - (1 - F.col("lexical")) * (1 - F.col("shape"))).otherwise(0.0)
    by_form = F.when((F.col("operator") >= AGREE) & (F.col("shape") >= AGREE), 1 - (1 - F.col("operator")) * (1 - F.col("shape"))).otherwise(0.0)
    score = F.greatest(by_word, by_form)
    return views.withColumn("score", score).where(F.col("score") >= ACCEPT).groupBy("value").agg((-F.max(F.struct("score", (-F.col("kind")).alias("k")))["k"]).alias("kind"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, base, spans`` of every row; spans hold start, kind (index in KINDS), end and value."""
    found = base(docs, id_col, text_col)
    more = discover(docs, found, text_col)
    bare = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    rows = found.select("row", "doc_id", "text_hash", bare("base").alias("base"))
    if more is None:
        return rows.select("doc_id", "text_hash", "base", F.col("base").alias("spans"))
    more = more.select("row", bare("added").alias("added"))
    more = common.broadcast_if_small(common.checkpoint(more), 64 + 96 * F.size("added"))
    return rows.join(more, "row", "left").select("doc_id", "text_hash", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by the kind in angle brackets; overlapping spans give one, of the first's kind."""
    found = extract(docs, id_col, text_col).where(F.size("spans") > 0)
    found = found.select("doc_id", "text_hash", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
    found = common.broadcast_if_small(common.checkpoint(found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))), 40 + 12 * F.size("spans"))
    text, spans = docs[text_col], found["spans"]
    tag = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(">"))
    upto = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"])), F.lit(0))
    piece = lambda s, i: let(upto(i), lambda e: F.when(s["start"] >= e, F.concat(F.substr(text, e + 1, s["start"] - e), tag(s))).otherwise(""))
    last = let(F.array_max(F.transform(spans, lambda s: s["end"])), lambda e: F.substr(text, e + 1, F.length(text)))
    clean = F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(F.transform(spans, piece), ""), last))
    joined = docs.join(found, docs[id_col].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs[text_col]) == found["text_hash"]), "left")
    return joined.select(*(clean.alias(c) if c == text_col else docs[c] for c in docs.columns))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return digest(extract(common.table(spark, sf_dir, "documents")))
