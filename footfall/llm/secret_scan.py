"""Secret scan: patterns, and sliding-window entropy per character class.

Every run of a character class that is long enough is a candidate. A window slides
over it; the counts of its characters change by one character out and one in, and
with them the sum of ``c * log2(c)`` from which the entropy follows, so a step costs
the same whatever the window, and a run costs its length. Windows that spell out an
alphabet are not suspect. The part of a run from its first to its last suspect window is
a secret unless the allow-list matches that part. Only DataFrame functions are used;
texts stay in their rows and nothing is shuffled.

Defined results: a null text is empty and holds nothing; spans are in code points,
ends exclusive; one place may carry spans of several kinds; repeated rows are
scanned each for itself; further columns, whatever their names, are ignored, and kept
by :func:`mask`; a very long text or run costs in proportion to its length.
"""

from __future__ import annotations

from functools import partial, reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.text import fresh_names, match_spans

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
BASE = KINDS[:3]
ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"
# A run that is long enough can be asked for at once: a shorter run never hides a longer match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

WINDOW = 20
# Class: characters of a run, its alphabet, and the entropy in bits from which a window is suspect.
CLASSES = {
    "entropy_hex": ("[0-9A-Fa-f]", "0123456789ABCDEFabcdef", 2.8),
    "entropy_base64": ("[A-Za-z0-9+/_=-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
}
# Suspect parts that match one of these as a whole are no secrets: no digit or only digits,
# and keys of documentation, which end in "example" or "examplekey" (the last windows of
# such a key may not be suspect).
ALLOWED = ("^[^0-9]+$", "^[0-9]+$", "(?i)exampl(e[a-z]{0,3})?[/+=_-]*$")
# Windows with this many steps to the next character are written-out alphabets.
NEXT_STEPS = 9


def _labelled(spans: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["value"].alias("value"))
    )


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three fixed patterns by kind."""
    assigns = F.filter(
        match_spans(text, ASSIGN + ASSIGN_VALUE),
        lambda s: F.length(F.regexp_extract(s["value"], f"^{ASSIGN}({ASSIGN_VALUE})$", 1)) >= 6,
    )
    found = {"assign": assigns, "access": match_spans(text, ACCESS), "hex": match_spans(text, HEX)}
    return {kind: _labelled(spans, kind) for kind, spans in found.items()}


def _step_terms() -> Column:
    """``c * log2(c)`` for every count that a window can have."""
    return F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 1)])


def _suspect_part(value: Column, alphabet: str, least: float) -> Column:
    """First start and last end of the suspect windows of a run, or nulls.

    The run is split into its characters once. A window moves on by the character that
    enters and the one that leaves, which lie side by side in a zipped array: every
    step looks at the counts of the alphabet and at nothing else.
    """
    none = F.lit(None).cast("int")
    terms, places = _step_terms(), F.lit(alphabet)
    letters = F.split(value, "")
    codes = F.transform(letters, lambda c: F.struct((F.instr(places, c) - 1).alias("place"), F.ascii(c).alias("code")))

    # Each character with the step that leads to it, then beside it what leaves the window.
    follows = F.zip_with(
        codes,
        F.concat(F.array(F.lit(None).cast("struct<place:int,code:int>")), F.slice(codes, F.lit(1), F.size(codes) - 1)),
        lambda c, before: F.struct(
            c["place"].alias("place"), F.coalesce((c["code"] == before["code"] + 1).cast("int"), F.lit(0)).alias("step")
        ),
    )
    gone = F.concat(
        F.array_repeat(F.lit(None).cast("struct<place:int,step:int>"), WINDOW), F.slice(follows, F.lit(1), F.size(follows) - WINDOW)
    )
    # The step to the first character of a window leads into it from outside.
    first_of = F.concat(
        F.array_repeat(F.lit(None).cast("struct<place:int,step:int>"), WINDOW - 1), F.slice(follows, F.lit(1), F.size(follows) - WINDOW + 1)
    )
    moves = F.zip_with(
        F.zip_with(follows, gone, lambda new, old: F.struct(new.alias("new"), old["place"].alias("old"))),
        first_of,
        lambda move, first: F.struct(move["new"].alias("new"), move["old"].alias("old"), F.coalesce(first["step"], F.lit(0)).alias("outside")),
    )

    def moved(counts: Column, x: Column) -> Column:
        return F.transform(counts, lambda c, k: c + F.when(k == x["new"]["place"], 1).otherwise(0) - F.when(k == x["old"], 1).otherwise(0))

    def added(counts: Column, x: Column) -> Column:
        fresh, left = F.get(counts, x["new"]["place"]), F.get(counts, x["old"])
        change = F.get(terms, fresh + 1) - F.get(terms, fresh)
        return F.when(x["old"].isNull(), change).when(x["old"] == x["new"]["place"], 0.0).otherwise(change + F.get(terms, left - 1) - F.get(terms, left))

    def slide(acc: Column, x: Column) -> Column:
        steps = acc["steps"] + x["new"]["step"] - x["outside"]
        total = acc["sum"] + added(acc["counts"], x)
        at = acc["at"] + 1
        # The sums below are worked out once, in the struct they are put into.
        state = F.struct(moved(acc["counts"], x).alias("counts"), total.alias("sum"), steps.alias("steps"), at.alias("at"), acc["first"].alias("first"), acc["last"].alias("last"))
        return F.get(F.transform(F.array(state), noted), F.lit(0))

    def noted(s: Column) -> Column:
        hit = (s["at"] >= WINDOW) & (log2(WINDOW) - s["sum"] / WINDOW >= least) & (s["steps"] < NEXT_STEPS)
        return F.struct(
            s["counts"].alias("counts"),
            s["sum"].alias("sum"),
            s["steps"].alias("steps"),
            s["at"].alias("at"),
            F.when(hit, F.coalesce(s["first"], s["at"] - WINDOW)).otherwise(s["first"]).alias("first"),
            F.when(hit, s["at"]).otherwise(s["last"]).alias("last"),
        )

    zero = F.lit(0)
    start = F.struct(
        F.array_repeat(zero, len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), zero.alias("steps"), zero.alias("at"),
        none.alias("first"), none.alias("last"),
    )
    return F.aggregate(moves, start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> dict[str, Column]:
    """Suspect parts of the runs of each character class that no allow-list pattern matches."""
    out = {}
    for kind, (letters, alphabet, least) in CLASSES.items():
        runs = match_spans(text, f"{letters}{{{WINDOW},}}")
        suspect = partial(_suspect_part, alphabet=alphabet, least=least)
        parts = F.transform(runs, lambda s: F.struct(s.alias("run"), suspect(s["value"]).alias("part")))
        found = F.transform(
            F.filter(parts, lambda p: p["part"]["first"].isNotNull()),
            lambda p: F.struct(
                (p["run"]["start"] + p["part"]["first"]).alias("start"),
                (p["run"]["start"] + p["part"]["last"]).alias("end"),
                F.substring(p["run"]["value"], p["part"]["first"] + 1, p["part"]["last"] - p["part"]["first"]).alias("value"),
            ),
        )
        passed = lambda s: reduce(lambda a, b: a | b, [s["value"].rlike(p) for p in allowed], F.lit(False))
        out[kind] = _labelled(F.filter(found, lambda s: ~passed(s)), kind)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All spans of each document, from ``doc_id, text``: the base spans as one array per
    kind, and ``base`` and ``found`` (base and entropy spans), each ``start, rank, end, value``."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, spans in {**base_spans(F.col("text")), **entropy_spans(F.col("text"), allowed)}.items():
        df = df.withColumn(kind, spans)
    return df.withColumn("base", F.concat(*BASE)).withColumn("found", F.concat(*KINDS))


def digest(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Counts, hash of the base spans, and all spans as text, one row per document."""
    return scan(docs, allowed).select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("entropy_hex") + F.size("entropy_base64")).cast("bigint").alias("n_entropy"),
    )


def mask(docs: DataFrame, by: str = "[secret]", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; other columns, and clean texts, stay as they are.

    Overlapping spans are merged first, so a secret that two kinds report is replaced once.
    """
    names = fresh_names(docs, ["spans", "merged"])
    text = F.coalesce(F.col("text"), F.lit(""))
    every = [*base_spans(text).values(), *entropy_spans(text, allowed).values()]
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # Cut points: the text between two merged spans, then the mark.
    merged = F.aggregate(
        F.array_sort(F.col(names["spans"])),
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                        F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    spans = F.col(names["merged"])
    pieces = F.transform(
        spans,
        lambda s, k: F.concat(
            F.substring(F.col("text"), (F.when(k == 0, F.lit(0)).otherwise(F.get(spans, k - 1)["end"]) + 1).cast("int"), (s["start"] - F.when(k == 0, F.lit(0)).otherwise(F.get(spans, k - 1)["end"])).cast("int")),
            F.lit(by),
        ),
    )
    rest = F.substring(F.col("text"), (F.get(spans, F.size(spans) - 1)["end"] + 1).cast("int"), F.lit(2**31 - 1))
    masked = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    df = docs.withColumn(names["spans"], F.concat(*every)).withColumn(names["merged"], merged)
    return df.withColumn("text", masked).select(*docs.columns)
