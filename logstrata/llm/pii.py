"""Personal data in texts, with DataFrame functions only: fixed patterns, and bootstrapped contextual extraction.

What the fixed patterns find seeds a graph of contexts and instances. A context is what stands before and after an
identifier, an instance is an identifier-like word that no pattern explains. Scores go back and forth between them: a
context is as good as the instances it holds are known to be of one kind, an instance is as good as its contexts. Words in
contexts that end up with high confidence are added as spans of that kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract, written so that no text makes them backtrack: a run is entered at its start, or where the
#: last match ended, and what no later part can take up again is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: A word that holds a digit or an at sign, whole.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Code points on each side in which a context's words are looked for.
REACH = 64
ROUNDS = 3
#: A context counts if so many known instances are in it, and is trusted from this confidence on.
LEAST_SUPPORT = 3
CONFIDENT = 0.9

_SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Starts are summed up inside blocks of so many matches, and over blocks, as each append copies an array.
_SUMMED = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once even where then uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _starts(widths: Column) -> Column:
    """Running sums of an array before each item, block by block."""
    at = "struct<at:int,out:array<int>>"
    zero = lambda x: F.struct(x.alias("at"), F.array().cast("array<int>").alias("out")).cast(at)
    step = lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / _SUMMED).cast("int")),
        lambda k: F.slice(widths, k * _SUMMED + 1, _SUMMED),
    )
    total = lambda b: F.aggregate(b, F.lit(0), lambda x, w: x + w)
    return _let(
        blocks,
        lambda bs: _let(
            F.aggregate(F.transform(bs, total), zero(F.lit(0)), step)["out"],
            lambda begin: F.flatten(F.zip_with(bs, begin, lambda b, x: F.aggregate(b, zero(x), step)["out"])),
        ),
    )


def _end_word(gap: Column, last: bool) -> Column:
    """The last or the first word of a gap, looked for in REACH code points."""
    near = F.translate(F.right(gap, F.lit(REACH)) if last else F.left(gap, F.lit(REACH)), "\t\n\x0b\x0c\r", "     ")
    return F.substring_index(F.rtrim(near), " ", -1) if last else F.substring_index(F.ltrim(near), " ", 1)


def _matches(text: Column, pattern: str, words: bool = False) -> Column:
    """Array of (start, match), and with words the (before, after) next to it, with starts in code points.

    What is between matches tells where they are. The arrays hold no more than the text, however many matches it has.
    """
    gaps = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(
            F.char_length(p).alias("size"), *([_end_word(p, False).alias("first"), _end_word(p, True).alias("last")] if words else [])
        ),
    )
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x: Column) -> Column:
        # A match starts after all before it, and the gap before it.
        widths = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda p, f: p["size"] + F.char_length(f))
        ends = _let(widths, lambda w: F.zip_with(_starts(w), w, lambda s, n: s + n))

        def one(e: Column, f: Column, i: Column) -> Column:
            around = [F.get(x["gaps"], i)["last"].alias("before"), F.get(x["gaps"], i + 1)["first"].alias("after")] if words else []
            return F.struct((F.get(e, i) - F.char_length(f)).alias("start"), f.alias("match"), *around)

        return F.when(F.size(x["found"]) > 0, _let(ends, lambda e: F.transform(x["found"], lambda f, i: one(e, f, i))))

    return _let(F.struct(gaps.alias("gaps"), found.alias("found")), placed)


def _sound(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(OCTETS)
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return n.between(14, 19) & F.call_function("luhn_check", digits) if kind == "card" else n.between(10, 15)


def _spans_of(text: Column, kind: str) -> Column:
    """Array of (start, kind, end) of the matches that pass the kind's test."""
    need = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    good = F.filter(_matches(text, PATTERNS[kind]), lambda m: _sound(kind, m["match"]))
    spans = F.transform(
        good,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.char_length(m["match"])).alias("end")
        ),
    )
    return F.coalesce(F.when(need, spans), F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans_of(text, k) for k in KINDS]))


def write_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _occurrences(rows: DataFrame) -> DataFrame:
    """Identifier-like words of texts with their contexts, and the kind of a base span that touches them, if any.

    rows: row, text, base. A context is the last word before and the first after; words that are identifier-like
    themselves take part by a sign.
    """
    some = rows.where(F.col("text").rlike("[0-9@]"))
    tokens = some.select("row", F.explode(_matches(F.col("text"), TOKEN, True)).alias("m"))
    match = F.col("m.match")
    # Marks around an identifier belong to its context, not to it.
    lead = F.regexp_extract(match, r"^[^0-9A-Za-z+@]*+", 0)
    core = F.regexp_replace(F.substr(match, F.char_length(lead) + 1), r"[^0-9A-Za-z]++$", "")
    sign = lambda w: F.when(w.rlike("[0-9@]"), "#").otherwise(F.lower(w))
    start = F.col("m.start") + F.char_length(lead)
    none = lambda kind: F.lit(None).cast(kind)
    tokens = tokens.select(
        "row",
        start.alias("start"),
        (start + F.char_length(core)).alias("end"),
        none("int").alias("kind"),
        F.lower(core).alias("instance"),
        F.concat_ws(" _ ", sign(F.col("m.before")), sign(F.col("m.after"))).alias("context"),
    ).where("end > start")
    spans = some.select("row", F.explode("base").alias("b")).select(
        "row", "b.start", "b.end", "b.kind", none("string").alias("instance"), none("string").alias("context")
    )
    # Of the spans that start no later the one that reaches farthest, and the first that starts later.
    # Both frames end at the row itself, so each is one pass.
    onward = Window.partitionBy("row").orderBy("start", F.col("kind").isNull())
    backward = Window.partitionBy("row").orderBy(F.desc("start"), F.col("kind").isNull().desc())
    span = F.col("kind").isNotNull()
    reach = F.max(F.when(span, F.struct("end", "kind"))).over(onward.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(span, F.struct("start", "kind"))).over(backward.rowsBetween(Window.unboundedPreceding, 0))
    seen = tokens.unionByName(spans).withColumn("reach", reach).withColumn("ahead", ahead).where(F.col("instance").isNotNull())
    kind = F.when(F.col("reach.end") > F.col("start"), F.col("reach.kind")).when(F.col("ahead.start") < F.col("end"), F.col("ahead.kind"))
    return seen.select("row", "start", "end", "instance", "context", kind.alias("kind"))


def _bootstrap(seen: DataFrame) -> DataFrame:
    """(instance, context, found kind) of unseen identifiers, from (instance, context, kind or null) occurrences.

    A confident instance counts only in contexts that are trusted for its kind: the same word elsewhere, as a year that also
    stands where card numbers do, is left alone.

    Edges are counted with partial aggregation before they are dealt by context or instance, so a frequent one is
    a few rows. Scores are sums over edges; each round's are written out.
    """
    edges = materialize(
        seen.groupBy("instance", "context").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")), "edges"
    )
    known = edges.select("instance", "context", *[F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"s{k}") for k in range(len(KINDS))])
    seeds, scores = known, None
    columns = [f"s{k}" for k in range(len(KINDS))]
    for _ in range(ROUNDS):
        # A context's confidence: the share of its distinct instances that are known to be of a kind.
        held = seeds if scores is None else (
            edges.where(F.col("kind").isNull()).join(scores, "instance").select("instance", "context", *columns).unionByName(
                known.join(edges.where(F.col("kind").isNotNull()).select("instance", "context"), ["instance", "context"], "left_semi")
            )
        )
        total = edges.groupBy("context").agg(F.count(F.lit(1)).alias("all"))
        sums = held.groupBy("context").agg(*[F.sum(c).alias(c) for c in columns])
        contexts = sums.join(total, "context").where(F.greatest(*columns) >= LEAST_SUPPORT)
        contexts = contexts.select("context", *[(F.col(c) / F.col("all")).alias(c) for c in columns])
        contexts = materialize(contexts.where(F.greatest(*columns) > 0.5), "contexts")
        # An unknown instance's: what its contexts leave open together, as if each were right by itself.
        open_ = edges.where(F.col("kind").isNull()).join(broadcast_if_small(contexts), "context")
        miss = lambda c: F.exp(F.sum(F.log(1 - F.least(F.col(c), F.lit(0.999)))))
        scores = materialize(open_.groupBy("instance").agg(*[(1 - miss(c)).alias(c) for c in columns]), "scores")
    best = F.greatest(*columns)
    kind = F.coalesce(*[F.when(F.col(c) == best, k) for k, c in enumerate(columns)])
    found = scores.where(best >= CONFIDENT).select("instance", kind.alias("found"))
    trusted = F.get(F.array(*columns), F.col("found")) > 0.5
    return open_.join(found, "instance").where(trusted).select("instance", "context", "found")


def find_pii(docs: DataFrame) -> DataFrame:
    """Find personal data in every whole text of docs, and add what contexts tell to be of the same kinds.

    Adds to the columns of docs: base and spans, arrays of (start, kind, end) in code points, end exclusive, kind an index
    of KINDS; columns of docs with these names, row or added are replaced. spans holds all of base and, where no base span is,
    the words that trusted contexts name, where these contexts are around them. A context is the word before and the word after, looked
    for in REACH code points; scores go through ROUNDS rounds. A null text is empty; rows that repeat are searched each; an empty
    table gives an empty result. Texts pass through no shuffle: only identifier-like words with their contexts do.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans", "row", "added")]
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    text = F.coalesce("text", F.lit(""))
    searched = docs.select(key.alias("row"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    seen = materialize(_occurrences(searched), "occurrences")
    named = broadcast_if_small(materialize(_bootstrap(seen.select("instance", "context", "kind")), "named"))
    more = (
        seen.where(F.col("kind").isNull())
        .join(named, ["instance", "context"])
        .groupBy("row")
        .agg(F.collect_set(F.struct(F.col("start").cast("int"), F.col("found").cast("int").alias("kind"), F.col("end").cast("int"))).alias("added"))
    )
    more = broadcast_if_small(materialize(more, "added"), 10_000)
    whole = docs.select(*rest, key.alias("row"), base_spans(text).alias("base")).join(more, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("added").cast(_SPAN), F.array().cast(_SPAN))))
    return whole.select(*rest, "base", spans.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with each span, and what overlaps it, replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(walk["out"], text.substr(walk["at"] + 1, F.char_length(text)))).otherwise(text)
