"""Personal data: patterns propose, checksums confirm, context adjusts (operator 3). Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns. Each is the contract's pattern with possessive
# repeats, and with a look-behind that lets a match start only where its run of
# characters does (or where the last match ended), so that texts without a
# match are read in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "local_phone": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
}
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "local_phone": "("}
BASE = ("email", "ip", "card", "phone")
# Score of a confirmed span, and what words nearby add or take.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.4}
CONTEXT = {
    "email": "(?i)mail|contact|write",
    "ip": "(?i)address|host|server|login",
    "card": "(?i)card|visa|master|pay",
    "phone": "(?i)phone|tel|call|mobile|fax",
    "iban": "(?i)iban|account|bank",
    "local_phone": "(?i)phone|tel|call|mobile|fax",
}
CONTEXT_CHARS = 40
CONTEXT_SCORE = 0.3
#: Kinds beside the base ones are kept from this score on.
THRESHOLD = 0.6

_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"


def _confirmed(kind: str, value: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(F.regexp_replace(value, " ", "")) == 1
    return F.lit(True)


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN, its first four characters moved behind the rest, letters as 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(moved, ""), lambda c: F.when(c == "", F.lit(None).cast("int")).otherwise(F.ascii(c)))
    return F.aggregate(
        codes,
        F.lit(0),
        lambda r, c: F.when(c.isNull(), r)
        .when(c >= 65, F.pmod(r * 100 + c - 55, F.lit(97)))
        .otherwise(F.pmod(r * 10 + c - 48, F.lit(97))),
    )


def _placed(kind: str, found: Column, gaps: Column) -> Column:
    """Structs (kind, start, end, value, score) of the confirmed matches; ``gaps`` is what lies between matches."""
    # Where each match ends: sums over all pieces before, by doubling, so a text of n spans takes n log n steps.
    ends = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.log2(F.size(found).cast("double"))).cast("int")),
        F.transform(found, lambda v, i: F.char_length(F.get(gaps, i)) + F.char_length(v)),
        lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))),
    )

    def place(one: Column, i: Column) -> Column:
        value, end = F.get(found, i), one
        near = F.concat(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)))
        return F.struct((end - F.char_length(value)).alias("start"), end.alias("end"), value.alias("value"), near.alias("near"))

    spans = F.transform(ends, place)
    good = F.filter(spans, lambda s: _confirmed(kind, s["value"]))
    scored = F.transform(
        good,
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.round(
                SCORES[kind]
                + F.when(s["near"].rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0)
                - (F.when(s["near"].rlike(r"\+[0-9]{1,3} ?\n"), 1.0).otherwise(0.0) if kind == "local_phone" else F.lit(0.0)),
                2,
            ).alias("score"),
        ),
    )
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= THRESHOLD)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: (kind, start, end, value, score) of every span, by kind and start.

    Patterns propose spans, leftmost and non-overlapping per kind; octet range,
    Luhn's check, digit counts and the mod-97 remainder confirm them, failing
    ones are dropped; words within 40 characters raise a score. The kinds email,
    ip, card and phone stay whatever their score; iban and local_phone need one
    of 0.6. Starts and ends count code points, ends are exclusive.

    Null text counts as empty and has no spans; a text of n spans takes n log n
    steps. Every row, repeated or with a
    null doc_id, gives a row. An empty table gives none. Other columns are not
    read, whatever their names.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    proposed = text
    for kind, pattern in PATTERNS.items():
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        asked = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike("[0-9]")
        proposed = proposed.withColumn(f"{kind}_hits", F.when(asked, hits).otherwise(none))
    parted = proposed.select(
        "doc_id",
        *[f"{kind}_hits" for kind in PATTERNS],
        *[
            F.when(F.size(f"{kind}_hits") > 0, F.split("text", pattern, -1)).otherwise(none).alias(f"{kind}_gaps")
            for kind, pattern in PATTERNS.items()
        ],
    )
    spans = [
        F.when(F.size(f"{kind}_hits") > 0, _placed(kind, F.col(f"{kind}_hits"), F.col(f"{kind}_gaps"))).otherwise(F.array()).cast(_SPAN)
        for kind in PATTERNS
    ]
    return parted.select("doc_id", F.concat(*spans).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans as text, and their number."""

    def line(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind))

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(kind).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
    )
