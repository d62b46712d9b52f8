"""Personal data by patterns and by bootstrapped contexts, with DataFrame functions only.

Base matches (email, ip, card, phone) come from regular expressions and their checks.  They are also the seeds of a bootstrapping, together
with secrets: long values assigned to a key such as ``token`` or ``api_key``.  The words before an identifier, or the key it is assigned to,
are a lexical pattern, and patterns and instances form a bipartite graph.  In each round a
pattern scores the share of its instances that are known for a kind, and an unknown instance scores by the trusted patterns around
it; instances above a bound count as known in the next round.  The last round's instances and the seed secrets are added as spans of
their kind, wherever they occur outside base matches.

Positions are code points.  Spark gives matches but not where they are, so a text is split by the same pattern:
the lengths of the gaps and of the matches add up to the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.sources.tables import stored

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"  # only added, never a base match
ALL_KINDS = (*KINDS, SECRET)

#: The base patterns in a form without backtracking over long runs; a match cannot begin inside a run that has already failed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MAYBE = {"email": "@", "ip": ".", "phone": "+"}  # a text without this character has no match
_OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})\z"
_ENDS = r"(?=[\"'>\]},;:!?]*+(?:[\x20\x09-\x0D]|\z))"
#: Tokens that look like an identifier: bounded by white space, with a digit or @ in it.
TOKEN = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]++|[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]{4,}+)"
_NUMBER = r"[0-9][0-9().-]*+(?=[\"'>\]},;:!?]*+(?:[\x20\x09-\x0D]|\z))"
#: Digits over several tokens, with the separators that the base patterns allow.  Possessive, and it ends before a token that is none of digits, so
#: that a long run is read once.
RUN = r"(?<![^\x20\x09-\x0D])[\"'(<\[{+.-]*+" + _NUMBER + r"(?:(?:\x20++[().-]++(?=\x20))*+\x20++[(.-]*+" + _NUMBER + r")++"
#: An assignment up to its value: ``key = ``, ``"key": `` or, for the words that name a secret, ``key: ``.
_ASSIGNED = r"([\p{L}_][\p{L}0-9_.-]*+)(?:[\"']?[\x20\x09-\x0D]*+=|[\"'][\x20\x09-\x0D]*+:|(?<=token|secret|password|passwd|pwd|key)[\x20\x09-\x0D]*+:)[\x20\x09-\x0D]*+[\"'(<\[{]*$"
#: The same inside one token; the value has four characters at least, so that the padding of an encoded value is not a sign of assignment.
_LEAD = r"^[\x20\"'(<\[{]*(?:[\p{L}_][\p{L}0-9_.-]*+(?:[\"']?=|[\"']:|(?<=token|secret|password|passwd|pwd|key):)(?=[^=]{4})[\"'(<\[{]*)?"
#: Keys whose values are secrets, and what such a value looks like: a long run of letters and digits.
_SECRET_KEY = r"(?:^|[._-])(?:token|secret|password|passwd|pwd|api[._-]?key|access[._-]?key|private[._-]?key) =$"
_SECRET_VALUE = r"^(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}$"
_CONTEXT = 80  # characters before an identifier in which its pattern is looked for
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a card number: from the right, every second digit doubled and its digits added."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(_OCTET))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda span: _valid(kind, span.match)


def is_kind(kind: str):
    return lambda span: span.kind == kind


def _before(lengths: Column) -> Column:
    """Sum of the entries before each entry, in blocks, so that very many matches stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    starts = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
    return F.transform(lengths, lambda _, i: F.element_at(starts, F.floor(i / _BLOCK).cast("int") + 1) + total(F.slice(lengths, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK)))


def _located(df: DataFrame, kind: str, pattern: str, maybe: Column) -> DataFrame:
    """Add ``_<kind>``: start, end, match and the characters before it, of every match of a pattern in ``_text``."""
    text = F.when(maybe, F.col("_text"))
    hits, gaps = f"_hits_{kind}", f"_gaps_{kind}"
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split("_text", pattern, -1)))
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
    df = df.withColumn("_lengths", F.when(F.size(hits) > 0, lengths))
    df = df.withColumn("_starts", F.when(F.size(hits) > 0, _before(F.col("_lengths"))))

    def span(h: Column, i: Column) -> Column:
        gap = F.element_at(F.col(gaps), i + 1)
        start = F.element_at(F.col("_starts"), i + 1) + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), F.lit(kind).alias("kind"), h.alias("match"))

    # a null array (no match) stays null; empty arrays are made null too, so that every later step passes over them
    return df.withColumn(f"_{kind}", F.when(F.size(hits) > 0, F.transform(F.col(hits), span))).drop(hits, gaps, "_lengths", "_starts")


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``base``: the valid base matches of ``text`` (start, end, kind, match), by start and then kind as listed.

    Null text is empty.  Matches of one kind are leftmost and do not overlap; those of different kinds may.
    """
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        maybe = F.col("_text").contains(_MAYBE[kind]) if kind in _MAYBE else F.col("_text").rlike("[0-9]")
        df = _located(df, kind, BASE[kind], maybe)
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", _check(kind)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,match:string>>")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    listed = F.concat(*[F.coalesce(f"_{k}", none) for k in KINDS])
    ordered = F.array_sort(F.transform(listed, lambda s: F.struct(s.start, rank[s.kind].alias("rank"), s.end, s.kind, s.match)))
    df = df.withColumn("base", F.when(F.size(listed) > 0, F.transform(ordered, lambda s: F.struct(s.start, s.end, s.kind, s.match))).otherwise(none))
    return df.drop(*[f"_{k}" for k in KINDS])


def _tokens(df: DataFrame) -> DataFrame:
    """Add ``tokens``: identifier-like tokens and runs of digits that no base match overlaps, without the punctuation around them.

    Of a run that a base match overlaps, the whole tokens before and after the match stay.  The tokens of a run are listed too, as the same
    number may stand alone elsewhere; the first of them is of kind ``inner``, as its context is that of the run.
    """
    df = _located(df, "token", TOKEN, F.col("_text").rlike("[0-9@]"))
    df = _located(df, "run", RUN, F.col("_text").rlike("[0-9]"))

    def trimmed(start: Column, match: Column) -> Column:
        before = F.regexp_extract(match, _LEAD, 0)
        lead = F.length(before)
        rest = F.substring(match, lead + 1, F.length(match))
        # a quoted value ends at its quote
        inside = F.when(before.rlike("[\"']$"), F.regexp_replace(rest, r"[\"'][\s\S]*\z", "")).otherwise(rest)
        core = F.regexp_replace(inside, r"[\x20\"')>\]}.,;:!?]+$", "")
        return F.struct((start + lead).alias("start"), (start + lead + F.length(core)).alias("end"), F.lit("token").alias("kind"), core.alias("match"))

    def overlapped(s: Column) -> Column:
        return F.struct(s.start.alias("start"), s.end.alias("end"), s.match.alias("match"), F.filter("base", lambda b: (b.start < s.end) & (s.start < b.end)).alias("hits"))

    def between(s: Column) -> Column:
        begins = F.concat(F.array(s.start), F.transform(s.hits, lambda _, i: F.array_max(F.transform(F.slice(s.hits, F.lit(1), i + 1), lambda b: b.end))))
        ends = F.concat(F.transform(s.hits, lambda b: b.start), F.array(s.end))

        def part(begin: Column, i: Column) -> Column:
            size = F.greatest(F.element_at(ends, i + 1) - begin, F.lit(0))
            whole = F.substring(s.match, (begin - s.start + 1).cast("int"), size.cast("int"))
            later = F.when(i > 0, F.regexp_replace(whole, r"^[^\x20]+", "")).otherwise(whole)
            kept = F.when(i < F.size(s.hits), F.regexp_replace(later, r"[^\x20]+$", "")).otherwise(later)
            return trimmed(begin + F.length(whole) - F.length(later), kept)

        return F.when(F.size(s.hits) > 0, F.transform(begins, part)).otherwise(F.array(trimmed(s.start, s.match)))

    def alike(s: Column) -> Column:
        return (F.length(_digits(s.match)) >= 5) | s.match.rlike("@.")

    def stays(s: Column) -> Column:
        return alike(s) & ~F.exists(F.col("base"), lambda b: (b.start < s.end) & (s.start < b.end))

    def named(s: Column) -> Column:
        inner = F.array_contains("_begins", s.start)
        return F.struct(s.start.alias("start"), s.end.alias("end"), F.when(inner, "inner").otherwise("token").alias("kind"), s.match.alias("match"))

    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,match:string>>")
    runs = F.filter(F.flatten(F.transform(F.transform("_run", overlapped), between)), lambda s: s.match.contains(" ") & alike(s))
    df = df.withColumn("_run", F.coalesce(runs, none)).withColumn("_begins", F.transform("_run", lambda s: s.start))
    single = F.filter(F.transform("_token", lambda s: trimmed(s.start, s.match)), stays)
    df = df.withColumn("tokens", F.concat("_run", F.coalesce(F.transform(single, named), none)))
    return df.drop("_token", "_run", "_begins")


def _pattern(text: Column, start: Column) -> Column:
    """Lexical pattern of a place, lower-cased: the key it is assigned to (``key =``), else the two words before it; null if there are not two, or neither has a letter."""
    tail = F.lower(F.substring(text, F.greatest(F.lit(1), start - _CONTEXT + 1).cast("int"), F.least(start, F.lit(_CONTEXT)).cast("int")))
    words = r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[\"'(<\[{]*$"
    clean = F.regexp_replace(F.concat_ws(" ", F.regexp_extract(tail, words, 1), F.regexp_extract(tail, words, 2)), "[0-9]", "0")
    key = F.regexp_replace(F.regexp_extract(tail, _ASSIGNED, 1), "[0-9]", "0")
    return F.when(key != "", F.concat(key, F.lit(" ="))).when(clean.rlike(r"\p{L}"), clean)


def _discovered(seen: DataFrame, rounds: int, support: int, trust: float) -> DataFrame:
    """Instances that the trusted patterns give a kind: ``instance``, ``kind``.  ``seen``: pattern, instance, kind (null: unknown)."""
    edges = stored(seen.where("pattern is not null").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree"))
    seeds = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known = seeds
    for _ in range(rounds):
        told = (
            edges.select("pattern", "instance").join(known, "instance")
            .groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= support).join(degree, "pattern")
            .select("pattern", F.col("kind").alias("told"), (F.col("mass") / F.col("degree")).alias("weight")).where(F.col("weight") >= trust)
        )
        unknown = edges.where("kind is null").join(told, "pattern")
        # patterns vouch independently: an instance fails only if all of them are wrong
        scored = unknown.groupBy("instance", "told").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("weight"), F.lit(1e-6)))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max(F.struct("score", "told")).alias("best")).select("instance", F.col("best.told").alias("kind"), F.col("best.score").alias("score"))
        known = stored(seeds.unionByName(best.join(seeds.select("instance"), "instance", "left_anti")), "known")
    # scores of well vouched instances round to 1, so seeds are told by name only
    return known.where(F.col("score") >= trust).join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind")


def personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, trust: float = 0.75) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``added``: arrays of spans (start, end, kind, match).

    Kinds are those of ``KINDS`` and, among the added ones, ``secret``.  A pattern is trusted for a kind if it precedes at least ``support`` known identifiers of it and these are the share ``trust`` of all
    identifier-like tokens it precedes.  Null text is empty; repeated rows are found alike; an empty table gives no row.
    Columns called ``base`` or ``added`` are replaced.
    """
    docs = docs.drop("base", "added")
    # other columns travel in one struct, so that none can clash with a name used here
    others = [c for c in docs.columns if c != "text"]
    docs, names = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), "text"), docs.columns
    texts = stored(_tokens(base_spans(docs)).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "spans")
    both = F.concat(F.col("base"), F.coalesce("tokens", F.array().cast("array<struct<start:bigint,end:bigint,kind:string,match:string>>")))
    spans = texts.where(F.size(both) > 0).select("_row", "text", F.explode(both).alias("s"))
    instance = F.lower(F.col("s.match"))
    occurring = stored(
        spans.select("_row", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.match").alias("match"), F.xxhash64(instance).alias("instance"),
                     F.when(~F.col("s.kind").isin("token", "inner"), F.col("s.kind")).alias("kind"),
                    F.when(F.col("s.kind") != "inner", _pattern(F.col("text"), F.col("s.start"))).alias("pattern")),
        "occurring",
    )
    secret = F.col("pattern").rlike(_SECRET_KEY) & F.col("match").rlike(_SECRET_VALUE)
    known = F.coalesce("kind", F.when(secret, F.lit(SECRET)))
    seen = occurring.select("pattern", "instance", known.alias("kind"))
    secrets = seen.where(F.col("kind") == SECRET).select("instance", "kind").distinct()
    found = _discovered(seen, rounds, support, trust).unionByName(secrets)
    new = occurring.where("kind is null").drop("kind", "pattern").join(found, "instance")
    # stored: where little is added, its size is known to be small and the texts stay where they are
    added = new.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "match"))).alias("added"))
    added = stored(added, "added")
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,match:string>>")
    whole = [F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in names]
    return texts.join(added, "_row", "left").select(*whole, "base", F.coalesce("added", none).alias("added"))


def _by_place(spans: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start and then kind, comma-joined."""
    return F.array_join(F.transform(_by_place(spans), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    ordered = _by_place(spans)

    def piece(s: Column, i: Column) -> Column:
        reached = F.coalesce(F.array_max(F.transform(F.slice(ordered, F.lit(1), i), lambda x: x.end)), F.lit(0).cast("long"))
        gap = F.substring(text, (reached + 1).cast("int"), F.greatest(s.start - reached, F.lit(0)).cast("int"))
        return F.when(s.start >= reached, F.concat(gap, F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(F.lit(""))

    last = F.array_max(F.transform(spans, lambda s: s.end))
    tail = F.substring(text, (last + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(ordered, piece), ""), tail)).otherwise(text)
