"""Personal data spans on built-in functions only.

Regular expressions propose spans, checksum validators confirm them, and context words near a span, before or after it,
raise its score. Email, address, card and phone spans that pass their validator always stay; the kinds added to them
need a score of `MIN_SCORE`. Positions count code points, the end is exclusive.

The patterns are possessive and start at most once in a run of characters, so that very long runs cost linear time
and no stack.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS, CONTEXT_GAIN, MIN_SCORE = 40, 0.3, 0.6
#: Spans of one kind with so few characters between them are a list, which shares its context.
LIST_GAP = 3
#: Neighbouring matches that can lie within CONTEXT_CHARS.
NEIGHBOURS = 4
#: Elements of a list that are put together at a time.
FOLD = 256
# Length of an account code by country, as the international registry gives it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_phone", "national_id")
_IBAN = "|".join(rf"(?:{'|'.join(of.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, of in IBAN_LENGTHS.items())
#: kind: (pattern, text every match has, score by itself, context words)
RULES = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", 0.6, r"\bip\b|address|host|server"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|payment|amex"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|fax|mobile|contact"),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", "", 0.9, "iban|account|bank"),
    "national_phone": (r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "", 0.4, r"phone|\btel\b|call|fax|mobile"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, r"\bssn\b|social security|tax id"),
}


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and digits) has remainder one when its first four signs go last."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(F.concat(F.lit("0"), F.substring(p, 1, 3)).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _near(kind: str, i: Column) -> Column:
    """Whether context words of the kind lie within CONTEXT_CHARS before or after match i."""
    m, g = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    if kind in ADDED:  # up to the neighbouring matches and beyond, as these kinds depend on it
        h, t, c = F.col(f"h_{kind}"), F.col(f"t_{kind}"), F.col(f"c_{kind}")
        before = [x for d in range(NEIGHBOURS, 0, -1) for x in (F.get(t, i - d), F.get(c, i - d).tail)] + [F.get(t, i)]
        after = [x for d in range(1, NEIGHBOURS + 1) for x in (F.get(h, i + d), F.get(c, i + d).head)]
    else:
        before, after = [F.get(m, i - 1), F.get(g, i)], [F.get(g, i + 1), F.get(m, i + 1)]
    whole = [F.concat(*[F.coalesce(x, F.lit("")) for x in side]) for side in (before, after)]
    around = F.concat_ws(" ", F.right(whole[0], F.lit(CONTEXT_CHARS)), F.left(whole[1], F.lit(CONTEXT_CHARS)))
    return F.lower(around).rlike(RULES[kind][3])


PLACES = "array<struct<start:int,end:int,near:boolean>>"


def _places(pieces: Column) -> Column:
    """Start, end and context of each of `pieces` (gap, length, near), in blocks, so that long lists are not copied for each
    element. A piece shortly behind one with context has context too."""

    def step(a: Column, x: Column) -> Column:
        start = a.at + x.gap
        near = x.near | (a.near & (x.gap <= LIST_GAP))
        place = F.struct(start.alias("start"), (start + x.length).alias("end"), near.alias("near"))
        return F.struct((start + x.length).alias("at"), near.alias("near"), F.array_append(a.own, place).alias("own"))

    def block(a: Column, b: Column) -> Column:
        begin = F.struct(a.at.alias("at"), a.near.alias("near"), F.array().cast(PLACES).alias("own"))
        return F.aggregate(F.slice(pieces, b * FOLD + 1, F.lit(FOLD)), begin, step, lambda x: F.struct(x.at.alias("at"), x.near.alias("near"), F.concat(a.own, x.own).alias("own")))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("near"), F.array().cast(PLACES).alias("own"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD).cast("int"))
    return F.when(F.size(pieces) > 0, F.aggregate(blocks, begin, block, lambda a: a.own)).otherwise(F.array().cast(PLACES))


def _spans(kind: str) -> Column:
    """Valid spans of one kind, by start: struct(kind, start, end, score, text)."""
    alone = RULES[kind][2]

    def span(x: Column, i: Column) -> Column:
        score = F.round(F.lit(alone) + F.when(x.near, CONTEXT_GAIN).otherwise(0.0), 2)
        return F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), score.alias("score"), F.get(f"m_{kind}", i).alias("text"))

    found = F.filter(F.transform(f"p_{kind}", span), lambda x: _valid(kind, x.text))
    return F.filter(found, lambda x: x.score >= MIN_SCORE) if kind in ADDED else found


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, spans.

    spans is an array of struct(kind, start, end, score, text) by kind (email, ip, card, phone, then the added kinds)
    and start. Base kinds match leftmost and without overlap, each kind by itself; a match that its validator refuses
    is dropped without another try. Added spans need context words within CONTEXT_CHARS before or after them, or before a
    list that they go on with, if their pattern alone scores too little; they never overlap a base span. Rows never move,
    so repeated rows and ids have the same spans each, ties cannot arise, and an empty table gives an empty result. A null or
    empty text has no spans.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, (pattern, needs, *_) in RULES.items():
        there = F.col("text").contains(needs) if needs else F.col("text").rlike("[0-9]{3}|[0-9][ -][0-9]")
        rows = rows.withColumn(f"m_{kind}", F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, (pattern, *_) in RULES.items():
        rows = rows.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern)).otherwise(none))
    own = [f"{x}_{kind}" for kind in RULES for x in "mg"]
    ends = []
    for kind in ADDED:  # the ends of gaps and matches are all that context needs
        ends += [
            F.transform(f"g_{kind}", lambda g: F.left(g, F.lit(CONTEXT_CHARS))).alias(f"h_{kind}"), F.transform(f"g_{kind}", lambda g: F.right(g, F.lit(CONTEXT_CHARS))).alias(f"t_{kind}"),
            F.transform(f"m_{kind}", lambda m: F.struct(F.left(m, F.lit(CONTEXT_CHARS)).alias("head"), F.right(m, F.lit(CONTEXT_CHARS)).alias("tail"))).alias(f"c_{kind}"),
        ]
    rows = rows.select("doc_id", *own, *ends)

    def pieces(kind: str) -> Column:
        each = lambda m, i: F.struct(F.length(F.get(f"g_{kind}", i)).alias("gap"), F.length(m).alias("length"), _near(kind, i).alias("near"))
        return F.transform(f"m_{kind}", each).alias(f"q_{kind}")

    found = [f"m_{kind}" for kind in RULES]
    rows = rows.select("doc_id", *found, *[pieces(kind) for kind in RULES])
    rows = rows.select("doc_id", *found, *[_places(F.col(f"q_{kind}")).alias(f"p_{kind}") for kind in RULES])
    rows = rows.select("doc_id", *[_spans(kind).alias(kind) for kind in RULES])
    base = rows.select("doc_id", F.concat(*BASE).alias("base"), F.concat(*ADDED).alias("added"))
    fresh = F.filter("added", lambda a: ~F.exists("base", lambda b: (a.start < b.end) & (b.start < a.end)))
    return base.select("doc_id", F.concat("base", fresh).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
