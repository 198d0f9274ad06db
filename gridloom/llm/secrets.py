"""Secret scans with DataFrame functions only: three base patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# --- fixed values: the base patterns, their kinds in order, and the least lengths ---
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""((?i:{KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # all of AKIA[A-Z0-9]+ with 16 or more characters
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 8
# --- end of fixed values ---

#: Candidate strings of the entropy method; a window of so many characters slides over each.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{24,}", 20
#: Character classes, the first that fits holds: all of a candidate is of the class's characters and it has all of the class's kinds; least bits per character of its densest window.
CLASSES = (
    (r"^[0-9a-fA-F]+$", (r"[0-9]", r"[a-fA-F]"), 3.0),
    (r"^[A-Za-z0-9+/_=-]+$", (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.7),
    (r"^[A-Z0-9=]+$", (r"[0-9]", r"[A-Z]"), 3.4),
    (r"^[a-z0-9=]+$", (r"[0-9]", r"[a-z]"), 3.4),
    (r"^[A-Z0-9+/_=-]+$", (r"[0-9]", r"[A-Z]"), 3.8),
    (r"^[a-z0-9+/_=-]+$", (r"[0-9]", r"[a-z]"), 3.8),
)
#: Candidates that are no secrets: UUIDs, runs of one word or path, dates and versions; and what consists of placeholders from end to end.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?!.*[-_/]{2})[a-z](?:[a-z/_-]*[a-z])?[0-9]{0,4}$|^[0-9_-]+$"
PLACEHOLDERS = r"(?i)example|placeholder|changeme|redacted|0123456789|abcdefghijklmnopqrstuvwxyz|abcdefgh|abcdef|your|secret|token|key|api|here|[-_/+=x]+"
#: What a path's segment is, unless it is as long as a candidate: words and short numbers.
_NAMED = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)?[0-9]{0,4}"
SEGMENT, NAMED = r"[A-Za-z0-9+_=-]{24,}", rf"^{_NAMED}(?:[-_]+{_NAMED})*$"
_SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Characters of a piece in which windows are told apart, and of one in which spans are replaced.
PIECE, REDACTED = 64, 4096


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, step) -> Column:
    """Spans that step(state, item) gathers in state.out, while state.at runs on.

    Arrays are copied when they grow, so items are taken in about the root of their number of runs of as many each."""

    def runs(it: Column, n: Column) -> Column:
        def one(state: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(it, k * n + 1, n), F.struct(state["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
            return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

        last = ((F.greatest(F.size(it), F.lit(1)) - 1) / n).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), one, lambda s: F.flatten(s["out"]))

    return let(items, lambda it: let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(it).cast("double"))).cast("int")), lambda n: runs(it, n)))


def _found(text: Column, pattern: str, rank: int, keep=None, within=None) -> Column:
    """Spans of all leftmost non-overlapping matches that keep accepts, in code points.

    The pieces between matches and the matches themselves alternate; running lengths give the places. within: gives the
    spans inside of a match instead, or null for the match itself, before keep is asked."""
    def gaps(matches: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda a, x: F.struct(F.length(a).alias("gap"), x.alias("x")))

    def step(state: Column, y: Column) -> Column:
        start = state["at"] + y["gap"]
        end = start + F.length(y["x"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        out = F.concat(state["out"], span)
        out = out if keep is None else F.when(keep(y["x"]), out).otherwise(state["out"])
        if within is not None:
            test, inner = within(y["x"])
            moved = F.transform(inner, lambda s: F.struct((s["start"] + start).alias("start"), s["rank"].alias("rank"), (s["end"] + start).alias("end")))
            out = F.when(test, F.concat(state["out"], moved)).otherwise(out)
        return F.struct(end.alias("at"), out.alias("out"))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: scanned(gaps(m), step))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _plogp(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _pieces(x: Column) -> Column:
    """x in pieces of PIECE characters, each with as many of the next one's as its last windows reach."""

    def longer(cut: Column) -> Column:
        return F.zip_with(cut, F.concat(F.slice(cut, F.lit(2), F.size(cut)), F.array(F.lit(""))), lambda a, b: F.concat(a, F.substring(F.coalesce(b, F.lit("")), 1, WINDOW - 1)))

    return let(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), longer)


def _densest(x: Column) -> Column:
    """The highest Shannon entropy, in bits per character, of a window that slides over a piece; 0 if it is shorter.

    sum(c * log2 c) over the window's counts is kept; a character that leaves or enters changes one count by one."""

    def step(state: Column, i: Column) -> Column:
        def count(begin: Column, n: Column, of: Column) -> Column:
            return let(F.substring(x, begin, n), lambda part: F.length(part) - F.length(F.replace(part, of, F.lit(""))))

        enters, leaves = F.substring(x, i, F.lit(1)), F.substring(x, i - WINDOW, F.lit(1))
        gone = count(i - WINDOW, F.lit(WINDOW), leaves)
        kept = F.when(i > WINDOW, let(gone, lambda n: state["sum"] - _plogp(n) + _plogp(n - 1))).otherwise(state["sum"])
        first = F.greatest(F.lit(1), i - WINDOW + 1)
        now = let(count(first, i - first, enters), lambda n: kept - _plogp(n) + _plogp(n + 1))
        return let(now, lambda s: F.struct(s.alias("sum"), F.when(i >= WINDOW, F.greatest(state["best"], F.log2(F.lit(float(WINDOW))) - s / WINDOW)).otherwise(state["best"]).alias("best")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")), step, lambda s: s["best"])


def densest(x: Column) -> Column:
    """The highest entropy of a window that slides over x, in bits per character; 0 if x is shorter. Linear in the length of x."""
    return F.coalesce(F.array_max(F.transform(_pieces(x), _densest)), F.lit(0.0))


def _dense(x: Column) -> Column:
    """Whether a candidate is dense enough for its character class and not on the allow-list. The first dense piece decides."""
    least = F.lit(None).cast("double")
    for chars, needs, bits in reversed(CLASSES):
        of = x.rlike(chars)
        for n in needs:
            of = of & x.rlike(n)
        least = F.when(of, F.lit(bits)).otherwise(least)
    dense = let(least, lambda bits: bits.isNotNull() & F.exists(_pieces(x), lambda piece: _densest(piece) >= bits))
    return F.when(x.rlike(ALLOWED) | (F.regexp_replace(x, PLACEHOLDERS, "") == ""), F.lit(False)).otherwise(dense)


def _path(x: Column) -> Column:
    """Whether a candidate is a path: each segment is named or a candidate of its own. A key after a lone / is none."""
    return x.contains("/") & ~x.rlike("^/[^/]*$") & F.forall(F.split(x, "/"), lambda s: (F.length(s) >= 24) | s.rlike(NAMED))


def find_secrets(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """docs with base_col and spans_col: arrays of (start, rank, end), sorted; rank counts KINDS, places are code points.

    Base spans are what the patterns match; the entropy method adds candidates that no base span touches, of a path those of
    its segments. A null or empty text has none. Columns that are already named base_col or spans_col are replaced, all
    others stay; rows that repeat stay rows of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = _found(text, ASSIGN, 0, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2))
    added = fresh(docs, "_more")
    out = docs.withColumns({base_col: F.array_sort(base), added: _found(text, CANDIDATE, 3, _dense, lambda x: (_path(x), _found(x, SEGMENT, 3, _dense)))})
    more = F.filter(added, lambda m: ~F.exists(base_col, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn(spans_col, F.when(F.size(added) == 0, F.col(base_col)).otherwise(F.array_sort(F.concat(base_col, more)))).drop(added)


def rendered(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by [SECRET]; spans that overlap or touch are replaced as one. Null stays null.

    A text is taken in pieces, each with the spans that reach it; a span's mark stands in the piece where it begins."""
    base, spans = fresh(docs, "_base"), fresh(docs, "_spans")
    found = find_secrets(docs, text_col, base, spans)
    text = F.col(text_col)

    def cleaned(piece: Column, at: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            begin = F.greatest(state["at"], at)
            more = F.when((s["start"] > state["at"]) & (s["start"] >= at), F.concat(F.substring(piece, begin - at + 1, s["start"] - begin), F.lit("[SECRET]"))).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], more).alias("out"))

        mine = F.filter(spans, lambda s: (s["start"] < at + REDACTED) & (s["end"] >= at))
        return F.aggregate(mine, F.struct(F.lit(-1).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(piece, F.greatest(s["at"], at) - at + 1, F.length(piece))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REDACTED}}}"), F.lit(0))
    clean = F.array_join(F.transform(pieces, lambda piece, k: cleaned(piece, k * REDACTED)), "")
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(base, spans)
