"""Personal data in free text: candidate gradient boosting.

High-recall generators propose spans, which may overlap, in a few passes over
the text. Each candidate gets format features (digits, groups, lengths of the
first and the last group, checksum) and context features (cue words before it,
neighbouring characters). Boosted regression trees, learned here, score the
candidates, and a threshold calibrated for each kind on texts that the trees
did not see selects those that are added to the base spans. Only DataFrame
operations are used; the trees score the combinations of features that occur,
whose number is bounded, and candidates are joined with those that pass.

Base spans (always kept) are the leftmost non-overlapping matches of one fixed
pattern for each kind, less those that fail its check (octets up to 255; 13 to
19 digits and the Luhn check; 9 to 15 digits). Patterns are written with
possessive parts so that no text makes them backtrack far or recurse.

Labels need no outside data: they are taken from one view of a candidate and
learned on another. What defines a base span, and the wide forms lack, is masked:
the plus (and the country's group) of a phone number, the single blanks and
hyphens of a card, the "@" and dots of an address; no feature sees it. Base
spans are the positive examples, each with a copy re-written as the wide form
would have it. A secret's view is what is said before it (``token = ``), which
no feature of its kind sees. Negative examples are candidates apart from all
base spans that are something else on their face: dates, prices, versions,
numbers of a wrong length or checksum, hosts without a dot, and long strings
that nothing names a secret. Beside each positive example, its features with
one of them changed weigh as a few negative ones, so what was never seen like
it scores low, also where no negative example occurs. All candidates of the
corpus are counted by their features, copies of a text once, a table bounded
by the product of the features' values, and the trees are fit to that table.

The kinds ``email``, ``ip``, ``card``, ``phone`` can gain spans beside the base
ones: addresses written with (at), (dot) or [.], cards with other separators,
phone numbers without a plus. ``secret`` has added spans only. An added span
never overlaps a base span of any kind, nor another added one.

All steps are linear in a text's length and in its number of matches, but for
short blocks of ``BLOCK``.

Defined cases: a null text counts as empty; texts of any length are read whole;
repeated rows give repeated rows; without positive examples of a kind nothing
is added to it. An empty table gives an empty result. Columns that are not
named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_small

KINDS = ("email", "ip", "card", "phone")
#: All kinds, those that have base spans first.
ALL_KINDS = (*KINDS, "secret")
# The base patterns, with possessive quantifiers where nothing can be given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be in it.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Generators: wider forms of each kind.
_AT, _DOT = r"\x20?[(\[]at[)\]]\x20?", r"\x20?[(\[](?:dot|\.)[)\]]\x20?"
WIDE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+",
    "ip": rf"(?:\G|(?<![0-9.]))[0-9]++(?:(?:\.|{_DOT})[0-9]++){{2,7}}+",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20./_-]{0,2}+[0-9]{2,7}+){2,5}+",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20./()-]{1,3}+[0-9]{2,6}+){2,5}+",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+",
}
WIDE_GUARD = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\x20?[.(\[]", "card": r"[0-9]{3}", "phone": r"[0-9][\x20./()-]+[0-9]", "secret": r"[A-Za-z0-9_+/-]{16}"}
CUES = r"(?i)(?:phone|tel|call|mobile|fax|mail|card|visa|credit|iban|ip|host|address|contact)[^\x20]{0,3}\x20?$"
NAMED_SECRET = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key)[\"']?\x20?[:=]{1,2}\x20?[\"']?$"
# What is something else on its face: dates, prices, shares and versions.
DATES = r"^(?:(?:19|20)[0-9]{2}[./\x20-][0-9]{1,2}[./\x20-][0-9]{1,2}|[0-9]{1,2}[./\x20-][0-9]{1,2}[./\x20-](?:19|20)[0-9]{2})"
OTHER_BEFORE, OTHER_AFTER = r"(?:[$€£#=]|\bv|(?i:version)|(?i:no\.?))\x20?$", r"^\x20?(?:[%$€£:]|EUR|USD)"
#: The features of a candidate and the number of their values.
FEATURES = {"digits": 5, "groups": 4, "first": 4, "last": 4, "cue": 2, "before": 3, "after": 3, "checksum": 2}
ROUNDS, RATE, DEPTH = 40, 0.5, 2
#: Weight of a changed positive example as a negative one.
CHANGED = 0.05
#: Share of true candidates among those that a threshold lets pass, at least.
PRECISION = 0.98
#: Places of an array that are gone through one by one in a row.
BLOCK = 128
SPANS = "array<struct<start:int,end:int,from:int,until:int,value:string,before:string,after:string,gap:int>>"
SPAN = "struct<rank:int,start:int,end:int,kind:string,from:int,until:int>"

Tree = tuple


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's base pattern passes its check."""
    d = digits_of(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(OCTETS),
        "card": F.length(d).between(13, 19) & _luhn(d),
        "phone": F.length(d).between(9, 15),
    }[kind]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The values of type ``kind`` that a walk through an array gives: ``step``
    maps a number, ``first`` at the start, and an item to the next number and
    the array of values given here. An array is never copied item by item: it
    is walked in blocks, whose results are put together."""
    none = F.array().cast(f"array<{kind}>")

    def walk(block: Column, at: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            now, out = step(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], out).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), one)

    def whole(x: Column) -> Column:
        def many(acc: Column, i: Column) -> Column:
            return let(walk(F.slice(x, i, BLOCK), acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

        zero = F.struct(first.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = F.aggregate(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), zero, many, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(x) == 0, none).otherwise(blocks)

    return let(items, whole)


def before_each(lengths: Column) -> Column:
    """The sum of all lengths before each one."""
    return running(lengths, F.lit(0), lambda at, x: (at + x, F.array(at)), "int")


def spans(text: Column, pattern: str, guard: str) -> Column:
    """All matches of ``pattern``: array of (start, end, from, until, value,
    before, after, gap): places in characters and in bytes, the match, what
    stands before and after it up to the next match, the characters before it."""
    def placed(p: Column, at: Column) -> Column:
        start, begin = at["c"] + F.length(p["g"]), at["b"] + F.octet_length(p["g"])
        return F.struct(
            start.alias("start"),
            (start + F.length(p["v"])).alias("end"),
            begin.alias("from"),
            (begin + F.octet_length(p["v"])).alias("until"),
            p["v"].alias("value"),
            F.right(p["g"], F.lit(24)).alias("before"),
            F.left(p["n"], F.lit(4)).alias("after"),
            F.length(p["g"]).alias("gap"),
        )

    def located(p: Column) -> Column:
        at = F.arrays_zip(before_each(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["v"]))).alias("c"), before_each(F.transform(p, lambda x: F.octet_length(x["g"]) + F.octet_length(x["v"]))).alias("b"))
        return F.zip_with(p, at, placed)

    def paired(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            n = F.size(found)
            pairs = F.zip_with(F.slice(gaps, 1, n), found, lambda g, v: F.struct(g.alias("g"), v.alias("v")))
            return let(F.zip_with(pairs, F.slice(gaps, 2, n), lambda p, n: F.struct(p["g"].alias("g"), p["v"].alias("v"), n.alias("n"))), located)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_gaps))

    # every regex is run once, and only where the guard finds something
    matches = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)
    return F.coalesce(F.when(text.rlike(guard), matches), F.array().cast(SPANS))


def _masked(kind: Column, value: Column) -> Column:
    """The value without what tells base spans from wide ones."""
    plain = F.regexp_replace(value, rf"{_AT}|{_DOT}|@", ".")
    return F.when(kind == "phone", F.regexp_replace(value, r"^(?:\+|00)", "")).when(kind.isin("email", "ip"), plain).otherwise(value)


def _features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """The features of a masked value and its context."""
    d = F.length(digits_of(value))
    size = lambda x: F.when(x <= 1, 0).when(x == 2, 1).when(x == 3, 2).otherwise(3)
    head, tail = F.length(F.regexp_extract(value, r"^[^0-9A-Za-z]*([0-9A-Za-z]*)", 1)), F.length(F.regexp_extract(value, r"([0-9A-Za-z]*)[^0-9A-Za-z]*$", 1))
    few = F.when(d == 0, 0).when(d < 4, 1).when(d < 8, 2).when(d < 16, 3).otherwise(4)
    host = value.rlike(r"[.][A-Za-z]{2,}$")
    return {
        "digits": F.when(kind.isin("email", "ip"), 0).when(kind == "secret", few).when(d < 9, 0).when(d < 12, 1).when(d < 13, 2).when(d < 16, 3).otherwise(4),
        "groups": F.least(F.lit(3), F.regexp_count(value, F.lit("[0-9A-Za-z]+")) - 1),
        "first": F.when(kind == "phone", size(head)).when(kind == "secret", F.when(F.length(value) < 24, 0).when(F.length(value) < 36, 1).when(F.length(value) < 64, 2).otherwise(3)).otherwise(0),
        "last": F.when(kind == "phone", size(tail - 1)).when(kind == "secret", F.when(~value.rlike("[A-Za-z]"), 0).when(value.rlike("^[0-9A-Fa-f]+$"), 1).when(value.rlike("^[0-9A-Za-z]+$"), 2).otherwise(3)).otherwise(0),
        "cue": F.when(kind == "secret", 0).otherwise(before.rlike(CUES).cast("int")),
        "before": F.when(kind == "secret", 0).when(before.rlike(r"[A-Za-z0-9_]$"), 2).when(before.rlike(r"[=:/.#$-]$"), 1).otherwise(0),
        "after": F.when(kind == "secret", 0).when(after.rlike("^[A-Za-z0-9_]"), 2).when(after.rlike("^[-/:%]"), 1).otherwise(0),
        "checksum": F.when(kind == "card", F.coalesce(_luhn(digits_of(value)), F.lit(False))).when(kind == "email", host).when(kind == "ip", value.rlike(OCTETS)).otherwise(F.lit(False)).cast("int"),
    }


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "from", "until", "value", "before", "after")])


def _ranked(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["from"].alias("from"), s["until"].alias("until"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda s: passes(kind, s["value"])


def _covered(kind: str) -> Callable[[Column], Column]:
    """A match and the gap before it as dots, or as marks where it is a base span."""
    return lambda s: F.concat(F.repeat(F.lit("."), s["gap"]), F.repeat(F.when(passes(kind, s["value"]), "x").otherwise("."), s["end"] - s["start"]))


def candidates(texts: DataFrame) -> DataFrame:
    """One row for each proposed span and each base span of ``texts`` (``_row``,
    ``_text`` and the ``_raw`` matches of each base pattern): kind, place,
    features, ``_free`` (a proposed span apart from all base spans) and ``_y``,
    its label, if any. A base span has a second row as the wide form has it."""
    covers = [F.array_join(F.transform(f"_raw_{k}", _covered(k)), "").cast("binary").alias(f"_cover_{k}") for k in KINDS]
    wide = F.concat(*[F.transform(spans(F.col("_text"), WIDE[k], WIDE_GUARD[k]), _of_kind(k)) for k in ALL_KINDS])
    # the covers are made below the rows of spans, once a text; the outer form has no spans computed again for a filter on their number
    proposed = texts.select("_row", *covers, wide.alias("_w")).select("_row", *[f"_cover_{k}" for k in KINDS], F.explode_outer("_w").alias("c")).where("c IS NOT NULL").select("_row", *[f"_cover_{k}" for k in KINDS], "c.*")
    touch = F.lit(False)
    for k in KINDS:
        touch = touch | F.contains(F.substring(F.col(f"_cover_{k}"), F.col("start") + 1, F.col("end") - F.col("start")), F.lit(b"x"))
    kind, value, d = F.col("kind"), F.col("value"), F.length(digits_of(F.col("value")))
    face = value.rlike(DATES) | F.col("before").rlike(OTHER_BEFORE) | F.col("after").rlike(OTHER_AFTER)
    wrong = (
        F.when(kind == "email", ~value.rlike(rf"\.|{_DOT}"))
        .when(kind == "ip", ~_masked(kind, value).rlike(OCTETS))
        .when(kind == "card", ~(d.between(13, 19) & F.coalesce(_luhn(digits_of(value)), F.lit(False))))
        .when(kind == "secret", ~F.col("before").rlike(NAMED_SECRET))
        .otherwise(~d.between(9, 15) | face)
    )
    named = (kind == "secret") & F.col("before").rlike(NAMED_SECRET) & value.rlike("[0-9]")
    proposed = proposed.where(~touch).select("_row", "kind", "start", "end", "from", "until", _masked(kind, value).alias("_m"), "before", "after", F.lit(True).alias("_free"), F.when(named, 1).when(wrong, 0).alias("_y"))
    base = F.concat(*[F.transform(F.filter(f"_raw_{k}", _passing(k)), _of_kind(k)) for k in KINDS])
    known = texts.select("_row", F.explode_outer(base).alias("c")).where("c IS NOT NULL").select("_row", "c.*")
    # a number's country and a card's layout are not in all wide forms: they are learned with and without, and with a trunk 0
    grouped = F.regexp_replace(digits_of(value), "([0-9]{4})(?=[0-9])", "$1.")
    own = _masked(kind, value)
    national = F.regexp_replace(own, r"^[0-9]{1,3}[^0-9]+(?=[0-9])", "")
    views = F.explode(F.when(kind == "phone", F.array(own, national, F.concat(F.lit("0"), national))).when(kind == "card", F.array(own, grouped)).otherwise(F.array(own))).alias("_m")
    known = known.select("_row", "kind", "start", "end", "from", "until", views, "before", "after", F.lit(False).alias("_free"), F.lit(1).alias("_y"))
    rows = proposed.unionByName(known)
    shown = _features(F.col("kind"), F.col("_m"), F.col("before"), F.col("after"))
    return rows.select("_row", "kind", "start", "end", "from", "until", "_free", "_y", *[v.cast("int").alias(k) for k, v in shown.items()])


def _tree(cells: list[tuple[tuple[int, ...], float, float]], depth: int) -> Tree:
    """A regression tree on (features, gradient, weight) by the gain in squared
    gradient over weight: (value,) or (feature, cut, below or equal, above)."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, gain = None, 1e-6
    for f, n in enumerate(FEATURES.values() if depth else ()):
        for cut in range(n - 1):
            left = [c for c in cells if c[0][f] <= cut]
            gl, hl = sum(c[1] for c in left), sum(c[2] for c in left)
            gr, hr = g - gl, h - hl
            if hl <= 0 or hr <= 0:
                continue
            new = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g * g / (h + 1)
            if new > gain:
                best, gain = (f, cut), new
    if best is None:
        return (RATE * g / (h + 1),)
    f, cut = best
    return (f, cut, _tree([c for c in cells if c[0][f] <= cut], depth - 1), _tree([c for c in cells if c[0][f] > cut], depth - 1))


def _value(tree: Tree, x: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


Table = list[tuple[tuple[int, ...], int, float]]


def changed(table: Table, seen: set[tuple[int, ...]]) -> Table:
    """The table and, as negative examples of little weight, its positive ones
    with one feature changed, but for those in ``seen``."""
    more: dict[tuple[int, ...], float] = {}
    for x, y, n in table:
        for f, many in enumerate(FEATURES.values() if y else ()):
            for v in range(many):
                z = (*x[:f], v, *x[f + 1 :])
                if z not in seen:
                    more[z] = more.get(z, 0.0) + n * CHANGED / (many - 1)
    return table + [(x, 0, n) for x, n in sorted(more.items())]


def boost(learned: Table, held: Table) -> tuple[list[Tree], float | None]:
    """Trees and the threshold for one kind, from (features, label, count) of the
    texts to learn from and of the others.

    The threshold is the smallest score whose candidates among ``held`` are true
    in a share of ``PRECISION`` at least, by isotonic reading of the scores from
    the top; ``learned`` stands in where ``held`` has no positive example. None
    (add nothing) without positive examples or where no score reaches it.
    """
    if not any(y for _, y, _ in learned):
        return [], None
    seen = {x for x, y, _ in (*learned, *held) if y}
    held = changed(held if any(y for _, y, _ in held) else learned, seen)
    learned = changed(learned, seen)
    score = {x: 0.0 for x, _, _ in (*learned, *held)}
    trees = []
    for _ in range(ROUNDS):
        cells = []
        for x, y, n in learned:
            p = 1 / (1 + exp(-score[x]))
            cells.append((x, n * (y - p), n * p * (1 - p)))
        tree = _tree(cells, DEPTH)
        trees.append(tree)
        for x in score:
            score[x] += _value(tree, x)
    hits = misses = 0.0
    threshold = None
    by_score: dict[float, list[float]] = {}
    for x, y, n in held:
        by_score.setdefault(round(score[x], 9), [0.0, 0.0])[1 - y] += n
    for s, (true, false) in sorted(by_score.items(), reverse=True):
        hits, misses = hits + true, misses + false
        if hits and hits >= PRECISION * (hits + misses):
            threshold = s
    return trees, None if threshold is None else max(threshold - 1e-6, log(3))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id, the text, ``base`` and ``added``,
    arrays of spans (rank, start, end, kind, and the places in bytes ``from``
    and ``until``) in the order of kinds and places."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    some = F.col("_text").rlike(r"[0-9@]|[(\[]at[)\]]")
    # only these texts are looked into, and only these are joined
    maybe = rows.where(some).withColumn("_row", F.md5("_text"))
    for k in KINDS:
        maybe = maybe.withColumn(f"_raw_{k}", spans(F.col("_text"), BASE[k], GUARD[k]))
    # candidates without their texts, once for all copies of a text
    found = durable(candidates(maybe).distinct())
    held = F.substring("_row", 1, 1).isin("c", "d", "e", "f")
    tables: dict[tuple[str, bool], Table] = {(k, h): [] for k in ALL_KINDS for h in (False, True)}
    # a row for each combination of features and label, whose number is bounded by FEATURES
    seen: dict[str, set[tuple[int, ...]]] = {k: set() for k in ALL_KINDS}
    for r in found.groupBy("kind", held.alias("_held"), *FEATURES, "_y").agg(F.count(F.lit(1)).alias("n")).collect():
        x = tuple(r[f] for f in FEATURES)
        seen[r["kind"]].add(x)
        if r["_y"] is not None:
            tables[r["kind"], r["_held"]].append((x, r["_y"], float(r["n"])))
    passing = []
    for k in ALL_KINDS:
        trees, cut = boost(sorted(tables[k, False]), sorted(tables[k, True]))
        for x in sorted(seen[k]) if cut is not None else ():
            score = sum(_value(t, x) for t in trees)
            if score >= cut:
                passing.append((k, ALL_KINDS.index(k), score, *x))
    # the combinations that pass, of the bounded number that there can be
    kinds = f"array<struct<kind:string,rank:int,_s:double,{','.join(f'{f}:int' for f in FEATURES)}>>"
    listed = ", ".join(f"('{k}', {i}, {s!r}D, {', '.join(map(str, x))})" for k, i, s, *x in passing)
    cells = df.sparkSession.range(1).select(F.inline(F.expr(f"CAST(array({listed}) AS {kinds})")))
    chosen = found.where("_free").join(F.broadcast(cells), ["kind", *FEATURES])
    chosen = chosen.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), (-F.col("_s")).alias("s"), F.col("rank"), F.col("end"), F.col("kind"), F.col("from"), F.col("until")))).alias("_c"))

    def apart(at: Column, x: Column) -> tuple[Column, Column]:
        fits = x["start"] >= at
        one = F.array(F.struct(*[x[c].alias(c) for c in ("rank", "start", "end", "kind", "from", "until")]))
        return F.when(fits, x["end"]).otherwise(at), F.when(fits, one).otherwise(F.array().cast(f"array<{SPAN}>"))

    added = durable(chosen.select("_row", running(F.col("_c"), F.lit(-1), apart, SPAN).alias("_added")))
    none = F.array().cast(f"array<{SPAN}>")
    base = F.concat(*[F.transform(F.filter(f"_raw_{k}", _passing(k)), _ranked(i, k)) for i, k in enumerate(KINDS)])
    joined = join_small(maybe.select("_id", "_text", "_row", base.alias("_base")), added, ["_row"], "left").select("_id", "_text", "_base", F.coalesce("_added", none).alias("_added"))
    both = joined.unionByName(rows.where(~some).withColumn("_base", none).withColumn("_added", none))
    return both.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.col("_base").alias("base"), F.array_sort("_added").alias("added"))


def span_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas, by kind and place."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base spans, digest and list of the spans of each row, and
    how many there are, ``n_spans``, of which ``n_added`` are not base spans."""
    found = detect(df, id_col, text_col)
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [(F.size("base") + F.size("added")).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added")]
    return found.select(id_col, *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat("base", "added")).alias("spans"), *more)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of each text replaced by its kind in brackets;
    overlapping spans are replaced together, by the first one's kind. All
    columns are kept, in their order, and null texts stay null."""
    names = df.columns
    keyed = df.withColumn("_pii_row", F.struct(*[F.col(c) for c in names]))
    keyed = keyed.select(F.col("_pii_row"), F.col(text_col).alias("_pii_text"))
    found = detect(keyed, "_pii_row", "_pii_text")
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["from"].alias("from"), s["until"].alias("until"), s["kind"].alias("kind"))))
    found = found.select("_pii_row", F.col("_pii_text").alias("_t"), F.when(F.size("base") + F.size("added") > 0, ordered).alias("_o"))

    def piece(at: Column, s: Column) -> tuple[Column, Column]:
        # what stands since the last span, as places in bytes, and this span's kind
        gap = F.struct(at.alias("since"), s["from"].alias("until"), s["kind"].alias("kind"))
        return F.greatest(at, s["until"]), F.when(s["from"] >= at, F.array(gap)).otherwise(F.array().cast("array<struct<since:int,until:int,kind:string>>"))

    raw = F.col("_t").cast("binary")
    cut = running(F.col("_o"), F.lit(0), piece, "struct<since:int,until:int,kind:string>")
    parts = F.transform(cut, lambda c: F.concat(F.substring(F.col("_b"), c["since"] + 1, c["until"] - c["since"]).cast("string"), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    last = F.array_max(F.transform("_o", lambda s: s["until"]))
    found = found.withColumn("_b", F.when(F.col("_o").isNotNull(), raw))
    new = F.when(F.col("_o").isNull(), F.col("_t")).otherwise(F.concat(F.array_join(parts, ""), F.substring(F.col("_b"), last + 1, F.octet_length("_b")).cast("string")))
    kept = F.when(F.col("_pii_row")[text_col].isNull(), F.lit(None).cast("string")).otherwise(new)
    return found.select(*[(kept if c == text_col else F.col("_pii_row")[c]).alias(c) for c in names])
