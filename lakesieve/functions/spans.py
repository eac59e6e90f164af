"""Spans as array columns: finding them with offsets, ranking, arbitration, splitting and rebuilding text. All of it is built
from Spark's own functions, row by row, so nothing here shuffles or leaves the JVM.

Offsets are 0-based, half-open and count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesieve import fixed

SPAN = "struct<start:int,end:int,pii_type:string,text:string,detector:string,confidence:double,priority:int,metadata:map<string,string>>"
SPANS = f"array<{SPAN}>"
MATCH = "array<struct<start:int,end:int,text:string>>"
_OPEN, _CLOSE = "\x01", "\x02"


def pattern(core: str, ignore_case: bool = False, plain: bool = False) -> str:
    """The pattern with Unicode character classes, as in Python, and case folding where asked for. plain: classes of ASCII alone."""
    flags = "i" * ignore_case + "U" * (not plain)
    return f"(?{flags}){core}" if flags else core


def find_all(text: Column, core: str, ignore_case: bool = False, plain: bool = False) -> Column:
    """All leftmost, non-overlapping matches with their offsets: matches are put between two control characters, the text is
    split there, and every second piece is a match. Control characters of the text's own become spaces beforehand."""
    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    pieces = F.split(F.regexp_replace(clean, pattern(core, ignore_case, plain), f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit(None).cast(MATCH).alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        after = acc["at"] + F.length(piece)
        one = F.array(F.struct(acc["at"].alias("start"), after.alias("end"), piece.alias("text")))
        found = F.when(acc["inside"], F.concat(F.coalesce(acc["found"], F.array().cast(MATCH)), one)).otherwise(acc["found"])
        return F.struct(after.alias("at"), (~acc["inside"]).alias("inside"), found.alias("found"))

    return F.coalesce(F.aggregate(pieces, start, step, lambda a: a["found"]), F.array().cast(MATCH))


def before(text: Column, start: Column, size: int) -> Column:
    """At most `size` characters before an offset."""
    return F.substring(text, F.greatest(F.lit(1), start - size + 1), F.least(F.lit(size), start))


def after(text: Column, end: Column, size: int) -> Column:
    return F.substring(text, end + 1, F.lit(size))


def matches(value: Column, core: str, ignore_case: bool = True) -> Column:
    return F.coalesce(value.rlike(pattern(core, ignore_case)), F.lit(False))


def as_spans(found: Column, pii_type: str, detector: str, confidence: float, metadata: dict[str, Column] | None = None) -> Column:
    entries = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v)]
    extra = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(pii_type).alias("pii_type"), m["text"].alias("text"), F.lit(detector).alias("detector"),
        F.lit(confidence).alias("confidence"), F.lit(fixed.PRIORITIES[pii_type]).alias("priority"), extra.alias("metadata"),
    )).cast(SPANS)


def none() -> Column:
    return F.array().cast(SPANS)


def dedupe(spans: Column) -> Column:
    """Of spans with one start, end and type the one of the highest priority and confidence; the first of equals. They are sorted
    by place and neighbours compared, so the work grows with n log n."""

    def firsts(keys: Column) -> Column:
        last = lambda i: F.get(keys, i - 1)
        new = lambda k, i: (i == 0) | ~k["a"].eqNullSafe(last(i)["a"]) | ~k["b"].eqNullSafe(last(i)["b"]) | ~k["c"].eqNullSafe(last(i)["c"])
        return F.array_sort(F.transform(F.filter(keys, new), lambda k: k["i"]))

    def chosen(all_: Column) -> Column:
        key = F.transform(all_, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["pii_type"].alias("c"), (-s["priority"]).alias("d"), (-s["confidence"]).alias("e"), i.alias("i")))
        return F.transform(once(F.array_sort(key), firsts), lambda i: F.get(all_, i))

    return once(spans, chosen)


def once(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with the value computed once however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sorted(spans: Column, *fields) -> Column:  # noqa: ANN002
    def put(all_: Column) -> Column:
        key = F.transform(all_, lambda s, i: F.struct(*(f(s).alias(f"k{n}") for n, f in enumerate(fields)), i.alias("i")))
        return F.transform(F.array_sort(key), lambda k: F.get(all_, k["i"]))

    return once(spans, put)


def ranked(spans: Column) -> Column:
    """By priority, confidence and length, the highest first, then by start and type."""
    return _sorted(spans, lambda s: -s["priority"], lambda s: -s["confidence"], lambda s: s["start"] - s["end"], lambda s: s["start"], lambda s: s["pii_type"])


def _runs(spans: Column) -> Column:
    """Spans in order of start, cut into runs where one begins after all before it have ended; none overlaps one of another run."""
    start = F.struct(F.array().cast(f"array<{SPANS}>").alias("done"), none().alias("run"), F.lit(-1).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["end"]
        done = F.when(new & (F.size(acc["run"]) > 0), F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(new, F.array(s)).otherwise(F.concat(acc["run"], F.array(s))).alias("run"), F.greatest(acc["end"], s["end"]).alias("end"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.array(a["run"])))


def resolve(spans: Column) -> Column:
    """The winners: spans in rank order, each kept if it overlaps none kept before; a loser blocks nobody. In order of start. Only
    spans of one run of overlaps are compared with each other."""
    winners = lambda run: F.aggregate(ranked(run), none(), lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return in_order(F.flatten(F.transform(_runs(in_order(dedupe(spans))), lambda run: F.when(F.size(run) < 2, run).otherwise(winners(run)))))


def in_order(spans: Column) -> Column:
    """By start, then end."""
    return _sorted(spans, lambda s: s["start"], lambda s: s["end"])


def rebuild(text: Column, replacements: Column) -> Column:
    """The text with replacements (start, end, replacement; non-overlapping, in order) put in: each with the gap before it, in
    the text's own offsets, so nothing drifts; the rest of the text follows the last."""
    end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(replacements, i - 1)["end"])
    parts = F.transform(replacements, lambda r, i: F.concat(F.substring(text, end_before(i) + 1, r["start"] - end_before(i)), r["replacement"]))
    last = F.coalesce(F.try_element_at(replacements, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))


def crosses(span: Column, boundaries: Column) -> Column:
    """Whether a hard boundary (tab or line break of the layout) lies in a span."""
    return F.exists(F.coalesce(boundaries, F.array().cast("array<struct<start:int,end:int>>")), lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def split_names(text: Column, spans: Column, boundaries: Column) -> Column:
    """People and companies that cross hard boundaries become one span for each trimmed segment between them; with fewer than
    two segments they stay as they are (and cannot be written). Others pass."""

    def segments(s: Column) -> Column:
        inside = F.filter(boundaries, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        starts = F.concat(F.array(s["start"]), F.transform(inside, lambda b: b["end"]))
        ends = F.concat(F.transform(inside, lambda b: b["start"]), F.array(s["end"]))
        cut = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: z["a"] < z["b"])

        def trim(z: Column) -> Column:
            raw = F.substring(text, z["a"] + 1, z["b"] - z["a"])
            left = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
            core = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+", ""), r"(?U)\s+$", "")
            return F.struct((z["a"] + left).alias("start"), (z["a"] + left + F.length(core)).alias("end"), core.alias("text"))

        return F.filter(F.transform(cut, trim), lambda t: F.length(t["text"]) > 0)

    def project(s: Column) -> Column:
        parts = segments(s)
        canonical = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(s["metadata"], F.lit("canonical")), s["text"]), r"(?U)\s+", " "))
        old = F.map_filter(s["metadata"], lambda k, v: ~k.isin("canonical", "block_segment_index", "block_segment_count", "hard_boundary_projection"))
        made = F.transform(parts, lambda t, i: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), s["pii_type"].alias("pii_type"), t["text"].alias("text"), F.lit("entity_boundary_projection").alias("detector"),
            s["confidence"].alias("confidence"), s["priority"].alias("priority"),
            F.map_concat(old, F.create_map(F.lit("canonical"), canonical, F.lit("block_segment_index"), i.cast("string"), F.lit("block_segment_count"), F.size(parts).cast("string"), F.lit("hard_boundary_projection"), F.lit("true"))).alias("metadata"),
        )).cast(SPANS)
        return F.when(s["pii_type"].isin("PERSON", "COMPANY") & crosses(s, boundaries) & (F.size(parts) >= 2), made).otherwise(F.array(s))

    return F.flatten(F.transform(spans, project))
