"""Secret scans: fixed patterns plus sliding-window Shannon entropy.

Patterns (spans of the whole match, code points, end exclusive):
``assign`` a keyword, ``:`` or ``=`` and a value of 6 or more characters;
``access`` an access key id of 20 or more; ``hex`` a run of 24 or more.

Entropy.  Candidates are the runs of 20 or more of ``[A-Za-z0-9+/_=-]`` with a
digit, and those of 20 or more letters, 30 to 70 % of them upper case (names in
camel case have fewer).  Each is put in a character class -- ``hex``, ``alnum``
(lower case and digits), ``letters`` or ``mixed`` -- with its own window and
threshold, that of ``letters`` the highest.  A window of W
characters slides over the candidate; only the counts of the character that
leaves and the one that enters change, so with f(k) = k log2 k the sum of
f(count) is updated by two differences and the entropy is log2 W - sum / W.
The span reported runs from the first to the last window at or above the
threshold.  A candidate that overlaps a pattern's span is suppressed; pattern
spans always stay.  The allow list (placeholders, counting sequences, one
repeated character) is held against the parts between ``=`` and ``/``: what
follows the last part that matches is judged as a candidate of its own, so a
word in a key's name or path does not hide the value behind it.

Only DataFrame functions run.  Positions come from the lengths of the matches
and of the pieces between them.  Defined results: null and empty texts have no
span (``base_sha256`` of the empty string); repeated rows are scanned one by
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.scratch import let

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a match fails as a whole when its run is too short, so the length can be asked for here
HEX = "[0-9a-f]{24,}"
CANDIDATE = ("(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
             "|(?<![A-Za-z0-9+_-])[A-Za-z]{20,}(?![A-Za-z0-9+_-])")
LEAST = 20  # characters of a candidate
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_mixed", "entropy_letters"]
#: class -> (pattern of the whole candidate, window, bits)
CLASSES = {"entropy_hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", 20, 2.8), "entropy_alnum": ("^[0-9a-z]+$", 20, 3.4),
           "entropy_letters": ("^[A-Za-z]+$", 20, 3.9), "entropy_mixed": (".", 20, 3.6)}
ALLOW = ("(?i)example|sample|dummy|placeholder|change_?me|redacted|your[_-]|test[_-]?key"
         "|0123456789|123456789|abcdefghij|qwertyuiop|([^=/])\\1{7}")
ALLOWED = ALLOW.replace("(?i)", "(?i)^.*(?:") + ")[^=/]*[=/]*"  # up to the end of the last part that matches
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"  # of a candidate
PIECE = 256  # matches whose spans are placed together
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def spans_of(text: Column, regex: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, stop, value of ``group``)."""
    def walk(m, gaps, values):
        steps = F.zip_with(F.arrays_zip(m.alias("m"), values.alias("v")), F.slice(gaps, 1, F.size(m)),
                           lambda x, g: F.struct(x["v"].alias("v"), F.char_length(g).alias("gap"), F.char_length(x["m"]).alias("n")))
        return let(steps, lambda s: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / PIECE).cast("int")),
                                                    lambda i: placed(F.slice(s, i * PIECE + 1, PIECE))), shifted))

    def placed(part):
        """(end, out): the spans of some matches, counted from where they begin.  Lists stay short, so appending does."""
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(part, empty, lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"),
                (acc["at"] + x["gap"] + x["n"]).alias("stop"), x["v"].alias("value")))).alias("out")))

    def shifted(parts):
        start = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(start, 1, F.size(parts)), lambda p, at: F.transform(p["out"], lambda x: F.struct(
            (x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["stop"] + at).alias("stop"), x["value"].alias("value")))))

    found = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: let(
        F.split(text, regex, -1), lambda g: let(
            F.regexp_extract_all(text, F.lit(regex), F.lit(group)), lambda v: walk(m, g, v))))
    return F.when(F.regexp_like(text, F.lit(regex)), found).otherwise(F.array().cast(SPAN))


def _f(k: Column) -> Column:
    return F.when(k > 1, k * F.log2(k)).otherwise(F.lit(0.0))


def entropy_span(value: Column, width: int, bits: float) -> Column:
    """(first, stop) of the windows of ``width`` characters with ``bits`` of entropy or more, else null.
    The characters are numbered once; the counts of a window are an array that
    each step changes in the two places of the character that leaves and the one that enters."""
    def slide(codes):
        first = F.slice(codes, 1, width)
        counts = F.transform(F.array_repeat(F.lit(0), len(ALPHABET) + 1), lambda _, j: F.size(F.filter(first, lambda c: c == j)))
        return let(counts, lambda n: windows(codes, n))

    def windows(codes, counts):
        total = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + _f(k))
        limit = (F.log2(F.lit(width)) - bits) * width + 1e-9  # of the sum
        start = F.when(total <= limit, F.lit(0)).cast("int")

        def step(acc, i):
            out, new = F.get(codes, i - 1), F.get(codes, i + width - 1)
            k_out, k_in = F.get(acc["n"], out), F.get(acc["n"], new)
            s = F.when(out == new, acc["s"]).otherwise(acc["s"] - _f(k_out) + _f(k_out - 1) - _f(k_in) + _f(k_in + 1))
            n = F.when(out == new, acc["n"]).otherwise(F.transform(
                acc["n"], lambda k, j: k - F.when(j == out, 1).otherwise(0) + F.when(j == new, 1).otherwise(0)))
            hit = let(s, lambda x: F.struct(x.alias("s"), (x <= limit).alias("low")))
            return let(hit, lambda h: F.struct(
                h["s"].alias("s"), F.when(acc["a"].isNull() & h["low"], i).otherwise(acc["a"]).alias("a"),
                F.when(h["low"], i).otherwise(acc["b"]).alias("b"), n.alias("n")))

        more = F.when(F.size(codes) > width, F.sequence(F.lit(1), F.size(codes) - width)).otherwise(F.array().cast("array<int>"))
        begin = F.struct(total.alias("s"), start.alias("a"), start.alias("b"), counts.alias("n"))
        return F.aggregate(more, begin, step,
                           lambda acc: F.when(acc["a"].isNotNull(), F.struct(acc["a"].alias("a"), (acc["b"] + width).alias("b"))))
    return let(F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)), slide)


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans the entropy finds beyond ``base``."""
    def hit(x, kind, width, bits):
        return let(entropy_span(x["value"], width, bits), lambda e: F.when(e.isNotNull(), F.struct(
            (x["start"] + e["a"]).alias("start"), F.lit(kind).alias("kind"),
            (x["start"] + e["b"]).alias("stop"), F.lit("").alias("value"))))

    def judged(x):
        out = F.lit(None)
        for name, (pattern, width, bits) in reversed(CLASSES.items()):
            out = F.when(F.regexp_like(x["value"], F.lit(pattern)), hit(x, KINDS.index(name), width, bits)).otherwise(out)
        return out

    def fresh(x):
        return ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))

    def rest(x):
        return let(F.regexp_replace(x["value"], F.lit(ALLOWED), F.lit("")), lambda v: F.struct(
            (x["stop"] - F.char_length(v)).alias("start"), v.alias("value")))

    def likely(x):
        n = F.char_length(x["value"])
        upper = F.char_length(F.regexp_replace(x["value"], F.lit("[^A-Z]"), F.lit("")))
        letters = F.regexp_like(x["value"], F.lit(CLASSES["entropy_letters"][0])) & (10 * upper >= 3 * n) & (10 * upper <= 7 * n)
        return (n >= LEAST) & (F.regexp_like(x["value"], F.lit("[0-9]")) | letters)
    candidates = F.filter(F.transform(F.filter(spans_of(text, CANDIDATE, 3), fresh), rest), likely)
    return F.filter(F.transform(candidates, judged), lambda x: x.isNotNull())


def joined(spans: Column) -> Column:
    """kind:start:stop by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.sort_array(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): an array of (start, kind, stop, value) per row, kinds numbered as in KINDS;
    ``base`` holds the pattern spans alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(F.filter(spans_of(text, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= 6),
                    spans_of(text, ACCESS, 1), spans_of(text, HEX, 2))
    return (docs.select("doc_id", "text").withColumn("base", base)
            .select("doc_id", "base", let(F.col("base"), lambda b: entropy_spans(text, b)).alias("more")))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts by pattern, digest of the pattern spans, all spans."""
    base, more = F.col("base"), F.col("more")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return scan(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                             F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, more)).alias("spans"))
