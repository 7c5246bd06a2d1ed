"""Secret scanning with built-in column functions only.

Fixed patterns find assignments, access keys and hex runs. Beside them, runs of an alphabet (a
character class) are searched with a sliding window: the window's Shannon entropy is kept by
incremental counts, one character in and one out at each step, and every window at or above the
class's threshold is a find unless the run is allow-listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlode.llm.common import free_name

# The base patterns, in order of rank. The third is the least length of the match's
# group 2 (assign) or of the whole match.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
# Character classes: kind, run pattern, alphabet, window, least entropy in bits.
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    ("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", LOWER + UPPER + DIGIT + "+/_-", 24, 3.9),
    ("entropy_hex", r"[0-9A-Fa-f]{24,}", DIGIT + "abcdef" + "ABCDEF", 24, 3.0),
)
# Runs that look random but are no secrets: placeholders, ordered alphabets, UUIDs, file paths and names of words.
ALLOW = (
    r"(?i)example|placeholder|changeme|lorem|0123456789abcdef|abcdefghijklm|1234567890"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    # possessive loops: they can't be matched another way, and Java's others overflow the stack on long runs
    r"|^//|^[a-z]++(?:[/_+-]++[a-z]++)*+$|^(?:[a-z]{2,}+[/_-])++[a-z0-9]{1,12}$"
)
MASK = "[SECRET]"
RUN = 256  # matches whose places are summed together


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(sizes: Column) -> Column:
    """For each of ``sizes`` the sum of those before it. Runs of RUN are summed apart, so that no long array grows by one item at a time."""
    grown = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    begin = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: F.slice(sizes, k * RUN + 1, F.lit(RUN)))

    def chained(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n))
        firsts = F.aggregate(sums, begin(F.lit(0)), grown, lambda a: a["out"])
        return F.flatten(F.zip_with(parts, firsts, lambda p, at: F.aggregate(p, begin(at), grown, lambda a: a["out"])))

    return F.when(F.size(sizes) > 0, _bound(runs, chained)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of the leftmost non-overlapping matches; start in code points."""

    def placed(both: Column) -> Column:
        values, gaps = both["values"], both["gaps"]
        sizes = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.char_length(g) + F.char_length(v))
        return F.zip_with(values, F.zip_with(_before(sizes), gaps, lambda at, g: at + F.char_length(g)), lambda v, at: F.struct(at.alias("start"), v.alias("value")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("gaps"))
    found = F.filter(_bound(both, placed), lambda m: m["value"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def _span(start: Column, end: Column, rank: int, kind: str, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), value.alias("value"))


def _base(text: Column, rank: int) -> Column:
    kind, pattern, least = BASE[rank]
    length = (lambda v: F.char_length(F.regexp_extract(v, pattern, 2))) if kind == "assign" else F.char_length
    kept = F.filter(_matches(text, pattern), lambda m: length(m["value"]) >= least)
    return F.transform(kept, lambda m: _span(m["start"], m["start"] + F.char_length(m["value"]), rank, kind, m["value"]))


def _hot(value: Column, alphabet: str, window: int, bits: float) -> Column:
    """struct<first, last>: start of the first and end of the last window with enough entropy; 0, 0 if none.

    The entropy of counts c over a window of w characters is log2(w) - sum(c * log2(c)) / w. The sum
    changes in at most two terms when the window moves on by one character.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = (math.log2(window) - bits) * window + 1e-9
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    # bound once: an array named in the lambda would be built anew for every character
    steps = _bound(codes, lambda own: F.transform(own, lambda c, i: F.struct(i.alias("i"), c.alias("new"), F.when(i >= window, F.get(own, i - window)).otherwise(-1).alias("old"))))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        moved = x["new"] != x["old"]
        more, less = F.get(a["n"], x["new"]), F.get(a["n"], F.greatest(x["old"], F.lit(0)))
        s = a["s"] + F.when(moved, F.get(term, more + 1) - F.get(term, more)).otherwise(0.0) + F.when(moved & (x["old"] >= 0), F.get(term, less - 1) - F.get(term, less)).otherwise(0.0)
        n = F.when(moved, F.transform(a["n"], lambda v, k: v + F.when(k == x["new"], 1).when(k == x["old"], -1).otherwise(0))).otherwise(a["n"])
        hot = (x["i"] >= window - 1) & (s <= most)
        return F.struct(n.alias("n"), s.alias("s"), F.when(hot & (a["last"] == 0), x["i"] + 1 - window).otherwise(a["first"]).alias("first"), F.when(hot, x["i"] + 1).otherwise(a["last"]).alias("last"))

    return F.aggregate(steps, zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _entropic(text: Column, which: int) -> Column:
    kind, pattern, alphabet, window, bits = CLASSES[which]
    # no window has more entropy than the log2 of the run's distinct characters
    able = F.filter(_matches(text, pattern), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(ALLOW) & (F.size(F.array_distinct(F.split(m["value"], ""))) >= math.ceil(2**bits)))
    tried = F.transform(able, lambda m: F.struct(m["start"].alias("start"), m["value"].alias("value"), _hot(m["value"], alphabet, window, bits).alias("hot")))
    hot = F.filter(tried, lambda m: m["hot"]["last"] > 0)
    return F.transform(hot, lambda m: _span(m["start"] + m["hot"]["first"], m["start"] + m["hot"]["last"], len(BASE) + which, kind, F.substring(m["value"], m["hot"]["first"] + 1, m["hot"]["last"] - m["hot"]["first"])))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: array<struct<start, rank, end, kind, value>> by start, then rank.

    Starts and ends count code points, ends are exclusive. Finds of a character class that lie in a
    base find are left out. A null or empty text has an empty array, an empty table stays empty;
    all other columns, repeated rows and null ids pass unchanged (a column named ``out`` is replaced).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spans = docs.withColumn(out, F.array_sort(F.concat(*[_base(text, k) for k in range(len(BASE))])))
    more = F.concat(*[_entropic(text, k) for k in range(len(CLASSES))])
    new = F.filter(more, lambda m: ~F.exists(F.col(out), lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return spans.withColumn(out, F.array_sort(F.concat(F.col(out), new)))


def base_spans(secrets: Column) -> Column:
    return F.filter(secrets, lambda s: s["rank"] < len(BASE))


def count_of(secrets: Column | str, kind: str) -> Column:
    """How many finds are of ``kind``."""
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")  # a second parameter would be the index


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 4096  # code points of a text that are masked together


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every found secret replaced by ``mask``; overlapping finds give one mask.

    The text is cut into pieces of PIECE code points in one pass, finds are cut where pieces end, and each piece is masked by itself, so that no
    place of a long text is counted from its beginning. Null texts stay null, texts without finds stay as they are, all
    rows and columns stay; an empty table stays empty.
    """
    text = F.col(f"`{text_col}`")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(s: Column) -> Column:
        """A find by pieces: number of the piece, whether the find began before it, begin and end within it."""
        last = F.floor((s["end"] - 1) / PIECE).cast("int")
        first = F.floor(s["start"] / PIECE).cast("int")
        inside = lambda k: F.struct(k.alias("k"), F.greatest(s["start"] - k * PIECE, F.lit(0)).alias("a"), (k == first).alias("new"), F.least(s["end"] - k * PIECE, F.lit(PIECE)).alias("b"))
        return F.transform(F.sequence(first, last), inside)

    def masked(piece: Column, finds: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            more = F.concat(a["out"], F.array(F.substring(piece, a["at"] + 1, s["a"] - a["at"]), F.lit(mask)))
            return F.struct(F.greatest(a["at"], s["b"]).alias("at"), F.when(s["new"] & (s["a"] >= a["at"]), more).otherwise(a["out"]).alias("out"))

        return F.aggregate(finds, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(piece, a["at"] + 1, F.lit(PIECE))))

    def whole(x: Column) -> Column:
        def one(piece: Column, k: Column) -> Column:
            first = F.array_position(x["ks"], k)
            last = F.size(x["ks"]) + 1 - F.array_position(x["back"], k)
            return F.when(first == 0, piece).otherwise(masked(piece, F.slice(x["finds"], F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))))

        return F.array_join(F.transform(x["pieces"], one), "")

    def numbered(finds: Column) -> Column:
        ks = F.transform(finds, lambda f: f["k"])
        return F.struct(finds.alias("finds"), ks.alias("ks"), F.reverse(ks).alias("back"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))

    own = free_name(docs)
    new = _bound(_bound(F.array_sort(F.flatten(F.transform(F.col(own), cut))), numbered), whole)
    return find_secrets(docs, text_col, own).withColumn(text_col, F.when(F.size(own) > 0, new).otherwise(text)).drop(own)
