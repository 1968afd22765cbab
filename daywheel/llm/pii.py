r"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score.

Only DataFrame functions: a pattern's hits and the pieces between them give the spans' offsets in code points. The
patterns are written so that each start is tried once per run of characters (`\G` or a look-behind) and repetitions are
possessive, and a hit's context comes from the pieces next to it, so that long runs of digits or letters need no stack
and time is linear in the text; offsets are running sums by doubling, n log n in the hits.

Kinds, in order: email, ip, card (Luhn), phone: the base; iban (mod 97), ssn and secret (keys in hexadecimal; both need
a context word) are added; these must not touch further characters of their kind (EDGES). A context word, alone or as a
plural, that lies whole within CONTEXT characters before or after a span raises its score; it is a word of its own, with
neither letter nor digit on either side ("key" in "api_key", not in "keyboard").

Defined results: null and empty texts have no spans; hits that fail their check are dropped without a retry inside them;
rows that repeat give a row each; an empty table gives an empty result; further columns pass through `spans`, which puts
its result in place of a column named pii.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
#: kind: pattern, a cheaper test that holds whenever the pattern matches something that can pass its check.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "secret": (r"[0-9a-f]{32,64}", r"[0-9a-f]{32}"),
}
#: Characters that must not stand next to a span.
EDGES = {"iban": "[A-Za-z0-9]", "ssn": "[0-9-]", "secret": "[A-Za-z0-9]"}
#: Score before and gain by a context word within CONTEXT characters of the span; spans under KEEP go, base ones never.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.9, 0.1), "ssn": (0.3, 0.5), "secret": (0.3, 0.5)}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|server|host|address|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|key|api|apikey|password|passwd",
}
#: Where a word of WORDS, or its plural, begins and ends.
BESIDE = r"[^\p{L}\p{N}]"
CONTEXT = 48
#: Characters that a match has at least.
SHORTEST = {"email": 5, "ip": 7, "card": 1, "phone": 3, "iban": 12, "ssn": 11, "secret": 32}
KEEP = 0.5


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn checksum."""

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, F.length(number) - i, F.lit(1))) - 48
        twice = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN (blanks removed) leaves 1 when its rearranged number is divided by 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def body(text: Column) -> Column:
        def step(rest: Column, i: Column) -> Column:
            c = F.ascii(F.substring(text, i, F.lit(1)))
            return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step) == 1

    return let(turned, body)


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.split(hit, r"\.")
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(parts, lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return let(digits(hit), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    if kind == "iban":
        return let(F.regexp_replace(hit, " ", ""), lambda a: F.when(F.length(a).between(15, 34), mod97(a)).otherwise(False))
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[a-f]")
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def running(sizes: Column) -> Column:
    """Running sums of a non-empty array of whole numbers: by the k-th turn each holds the sum of the 2 ** k numbers up to it."""

    def turn(sums: Column, k: Column) -> Column:
        return F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("bigint")))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes).cast("double"))).cast("int"))
    return F.aggregate(turns, sizes.cast("array<bigint>"), turn)


def kind_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order; start and end in code points, end exclusive."""
    pattern, test = PATTERNS[kind]
    score, gain = SCORES[kind]
    near = rf"{BESIDE}(?:{WORDS[kind]})s?{BESIDE}"
    # One character more shows whether a word goes on beyond the context.
    wide, reach = F.lit(CONTEXT + 1), CONTEXT // SHORTEST[kind] + 2

    def before(pieces: Column, hits: Column, i: Column) -> Column:
        """The CONTEXT + 1 characters before hit i; as many hits as may lie in them are enough."""
        own, first = F.get(pieces, i), F.greatest(i - reach, F.lit(0))
        joined = F.array_join(F.transform(F.slice(hits, first + 1, i - first), lambda h, j: F.concat(F.right(F.get(pieces, first + j), wide), h)), "")
        return F.when(F.length(own) > CONTEXT, F.right(own, wide)).otherwise(F.right(F.concat(joined, own), wide))

    def after(pieces: Column, hits: Column, i: Column) -> Column:
        own = F.get(pieces, i + 1)
        joined = F.array_join(F.transform(F.slice(hits, i + 2, F.lit(reach)), lambda h, j: F.concat(h, F.left(F.get(pieces, i + 2 + j), wide))), "")
        return F.when(F.length(own) > CONTEXT, F.left(own, wide)).otherwise(F.left(F.concat(own, joined), wide))

    def placed(both: Column, kept: Column) -> Column:
        pieces, hits = both["pieces"], both["hits"]
        ends = running(F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.length(h)))

        def scored(end: Column, x: Column, around: Column) -> Column:
            # The span's own end bounds a word, and a blank does where the text begins or ends.
            blank = lambda side: F.when(F.length(side) <= CONTEXT, F.lit(" ")).otherwise(F.lit(""))
            sides = F.concat(blank(around["b"]), around["b"], F.left(x["hit"], F.lit(1))), F.concat(F.right(x["hit"], F.lit(1)), around["a"], blank(around["a"]))
            words = F.translate(sides[0], UPPER, LOWER).rlike(near) | F.translate(sides[1], UPPER, LOWER).rlike(near)
            edge = F.right(around["b"], F.lit(1)).rlike(EDGES[kind]) | F.left(around["a"], F.lit(1)).rlike(EDGES[kind]) if kind in EDGES else F.lit(False)
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(x["hit"])).cast("int").alias("start"), end.cast("int").alias("end"), F.when(words, score + gain).otherwise(score).alias("score"), edge.alias("edge"))

        def one(at: Column, x: Column) -> Column:
            around = F.struct(before(pieces, hits, x["i"]).alias("b"), after(pieces, hits, x["i"]).alias("a"))
            return let(around, lambda c: scored(F.get(at, x["i"]), x, c))

        found = let(ends, lambda at: F.transform(kept, lambda x: one(at, x)))
        low = lambda x: x["edge"] | (x["score"] < (0.0 if kind in BASE else KEEP))
        return F.transform(F.filter(found, lambda x: ~low(x)), lambda x: F.struct(x["kind"], x["start"], x["end"], x["score"]))

    def checked(both: Column) -> Column:
        numbered = F.transform(both["hits"], lambda h, i: F.struct(h.alias("hit"), i.alias("i")))
        kept = F.filter(numbered, lambda x: confirmed(kind, x["hit"]))
        return let(kept, lambda k: F.when(F.size(k) > 0, placed(both, k)).otherwise(F.array().cast(SPAN)).cast(SPAN))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    some = F.contains(text, F.lit(test)) if len(test) == 1 else text.rlike(test)
    return F.when(some, let(both, checked)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def spans(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = BASE + ADDED) -> DataFrame:
    """docs with pii: array<struct<kind, start, end, score>>, by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii", F.concat(*[kind_spans(body, k) for k in kinds]))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scores(found: Column) -> Column:
    """The score of each span, with two digits, comma-joined."""
    return F.array_join(F.transform(found, lambda x: x["score"].cast("decimal(3,2)").cast("string")), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
