"""Secret scans in DataFrame functions alone: known forms by pattern, unknown ones by sliding-window Shannon entropy.

Candidate strings are pieces of at least ``WINDOW`` token characters. A window of ``WINDOW`` characters slides over each candidate;
it keeps the count of every character and the sum of c log2 c over the counts, and each step changes one count down and one up,
so a step costs the same whatever the window holds. Windows whose entropy reaches the bound of the candidate's character class
are flagged, and overlapping ones merge into a span. Candidates that match the allow list are left out. One projection over
each row: nothing is shuffled, and long candidates are cut into overlapping chunks.

Rows: a null text is empty and has no spans; repeated rows give equal rows; positions count code points, ends are exclusive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votelens.llm.common import id_and_text

#: Known forms: kind, gate (a cheap test that any match passes), pattern. They fix what counts as a match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_CHARS = 8

#: Candidates for the entropy scan: = and / end them, so a name or folder before a secret does not change its class. Pieces under
#: 20 characters between slashes stay together, as a secret may hold slashes. The look-behind keeps the search linear, and the
#: possessive loop needs no stack.
_PIECE = r"[A-Za-z0-9+_-]"
CANDIDATE = rf"(?<!{_PIECE}){_PIECE}{{20,}}|(?<!{_PIECE}){_PIECE}{{0,19}}(?:/{_PIECE}{{0,19}}(?!{_PIECE}))++"
WINDOW = 20
#: Steps between chunks of a long candidate.
CHUNK = 2048
#: Character classes, tried in this order, and the entropy in bits that makes a window of the class suspicious: what 95% of random
#: strings of 20 characters of the class reach (hex digits: 99%).
CLASSES = ((r"^[0-9a-fA-F]+$", 2.8), (r"^[a-z]+$|^[A-Z]+$", 3.38), (r"^[A-Za-z]+$", 3.68), (r"^[a-z0-9_-]+$|^[A-Z0-9_-]+$", 3.54), (r".", 3.78))
#: Candidates that are no secrets: plain numbers, UUIDs, dates and times, rulers, placeholders, paths of words.
ALLOWED = (r"^[0-9_=+/-]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)(?:example|placeholder|changeme|your[_-])[^/]*$",
           r"^(.)\1+$", r"^/?(?:[A-Za-z]{1,15}[/_-])++(?:[A-Za-z]{1,15}/?|(?<=/))$")

_FOUND = "array<struct<start:int,match:string>>"
_SPANS = "array<struct<a:int,b:int>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with the position of each: what lies between two matches is what splitting leaves."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found")),
        lambda s, x: F.struct((s["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
                              F.concat(s["found"], F.array(F.struct((s["at"] + F.length(x["p"])).alias("start"), x["m"].alias("match")))).alias("found")),
        lambda s: s["found"])


def gated(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), located(text, pattern)).otherwise(F.array().cast(_FOUND))


def _weight(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def _flagged(chunk: Column, bound: Column) -> Column:
    """Spans of ``chunk`` whose windows reach the entropy ``bound``."""
    def code(i: Column) -> Column:
        return F.ascii(F.substring(chunk, i, F.lit(1)))

    # one count goes down when a character leaves the window, one goes up when a character enters it
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.length(chunk)), lambda i: F.array(
        F.struct(F.when(i > WINDOW, code(i - WINDOW)).otherwise(F.lit(0)).alias("code"), F.when(i > WINDOW, F.lit(-1)).otherwise(F.lit(0)).alias("by"), F.lit(0).alias("end")),
        F.struct(code(i).alias("code"), F.lit(1).alias("by"), i.alias("end")))))

    def step(s: Column, x: Column) -> Column:
        c = F.get(s["counts"], x["code"])
        counts = F.concat(F.slice(s["counts"], F.lit(1), x["code"]), F.array(c + x["by"]), F.slice(s["counts"], x["code"] + 2, F.lit(128)))
        total = s["total"] - _weight(c) + _weight(c + x["by"])
        spans, a = s["spans"], x["end"] - WINDOW
        last = F.element_at(spans, -1)
        grown = (F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["b"] >= a),
                        F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(last["a"].alias("a"), x["end"].alias("b")))))
                 .otherwise(F.concat(spans, F.array(F.struct(a.alias("a"), x["end"].alias("b"))))))
        hot = (a >= 0) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= bound)
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(hot, grown).otherwise(spans).alias("spans"))

    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.array().cast(_SPANS).alias("spans"))
    return F.aggregate(steps, zero, step, lambda s: s["spans"])


def _bound(candidate: Column) -> Column:
    out = F.lit(99.0)
    for pattern, bits in reversed(CLASSES):
        out = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def entropy_spans(found: Column) -> Column:
    """array<struct<a, b>> in the text's code points, from candidates (start, match)."""
    def of_one(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(x["match"]) - WINDOW, F.lit(0)), F.lit(CHUNK)), lambda at: F.transform(
            _flagged(F.substring(x["match"], at + 1, F.lit(CHUNK + WINDOW - 1)), _bound(x["match"])),
            lambda s: F.struct((s["a"] + at + x["start"]).alias("a"), (s["b"] + at + x["start"]).alias("b"))))
        return F.flatten(chunks)

    def merge(spans: Column, x: Column) -> Column:
        last = F.try_element_at(spans, F.lit(-1))
        return (F.when((F.size(spans) > 0) & (last["b"] >= x["a"]), F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(last["a"].alias("a"), x["b"].alias("b")))))
                .otherwise(F.concat(spans, F.array(x))))

    allowed = lambda x: F.lit(False) if not ALLOWED else x["match"].rlike("|".join(f"(?:{p})" for p in ALLOWED))
    each = F.transform(F.filter(found, lambda x: (F.length(x["match"]) >= WINDOW) & ~allowed(x)), of_one)
    return F.aggregate(F.flatten(each), F.array().cast(_SPANS), merge)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array<struct<start, place, kind, end>> in order; kinds assign, access, hex and entropy."""
    text = F.col("text")
    values = id_and_text(docs).select(
        "doc_id", gated(text, ASSIGN).alias("assign"), gated(text, ACCESS).alias("access"), gated(text, HEX).alias("hex"), gated(text, CANDIDATE).alias("candidates"))

    def spans(found: Column, place: int, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")))

    assign = F.filter("assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_CHARS)
    entropy = F.transform(entropy_spans(F.col("candidates")), lambda s: F.struct(s["a"].alias("start"), F.lit(3).alias("place"), F.lit("entropy").alias("kind"), s["b"].alias("end")))
    every = F.concat(spans(assign, 0, "assign"), spans(F.col("access"), 1, "access"), spans(F.col("hex"), 2, "hex"), entropy)
    return values.select("doc_id", F.array_sort(every).alias("spans"))


def op2_secrets(docs: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return find_secrets(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda x: x["place"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
