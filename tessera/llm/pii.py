"""Personal data in texts by weak supervision, in DataFrame functions.

Patterns propose candidate spans; labelers (structure, gazetteers, words around a span, what it touches) vote on each;
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind, and a
logistic classifier on the votes and on traits of the span is fitted to the posteriors it gives.  Both models are fitted on the driver from counts by vote pattern, of
which there is a fixed number whatever the corpus, and are applied as column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import held, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("local", "national", "iban", "person")
KINDS = (*BASE, *ADDED)
NEAR = 48

_LOCAL = "A-Za-z0-9._%+-"
_DOMAIN = "A-Za-z0-9-"
#: For each kind a cheap guard, which any text with a match has, and the pattern.  The patterns find the leftmost matches from left to right, and are written so
#: that no repeated group makes the matcher recurse and no run is scanned again from each of its characters.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_DOMAIN}]++(?=\.[{_DOMAIN}])[.{_DOMAIN}]+?(?=\.\.|\.?+(?![.{_DOMAIN}]))"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][0-9 -]{11}", r"(?<![0-9 -])[0-9][0-9 -]{11,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "local": (r"[0-9]{3}[.-][0-9]{4}", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "national": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    "person": (r"Mr|Ms|Dr|[Nn]ame|Herr|Frau|Mme|Señor", r"(?<=Mr\.? |Mrs\.? |Ms\.? |Dr\.? |[Nn]ame is |[Nn]ame: |Herr |Frau |Mme |Señora? )\p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?"),
}
#: Signs between digits stay; others become a sign of the same width, so that a card's digits are one run.
_LONE = "(?<![0-9])[ -]|[ -](?![0-9])"

# Gazetteers.
_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|be|us|ca"
_CALLING = r"\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|62"
_STATES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
_GIVEN = "Anna|Maria|John|James|Mary|Peter|Paul|Thomas|Michael|Sarah|Laura|Julia|Hans|Karl|Pierre|Jean|Marie|Sophie|Juan|José|Carmen|Luis|David|Robert|Linda|Emma"
_FOR = {
    "email": "mail|contact|write", "ip": "address|host|server|client|login|from", "card": "card|credit|visa|payment|pay",
    "phone": "phone|tel|call|mobile|fax|contact", "local": "phone|tel|call|mobile|fax|contact", "national": "ssn|social|security|identity|tax",
    "iban": "iban|account|bank|konto|compte|cuenta", "person": "mr|mrs|ms|dr|name|herr|frau|mme|señora?",
}
_AGAINST = r"version|release|isbn|issn|doi|serial|build|section|figure|table|order|item|page|license"


def _by_kind(of: dict[str, Column], other: Column | None = None) -> Column:
    chosen = None
    for kind, value in of.items():
        chosen = F.when(F.col("kind") == kind, value) if chosen is None else chosen.when(F.col("kind") == kind, value)
    return chosen if other is None else chosen.otherwise(other)


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _luhn() -> Column:
    """Whether the digits of a match pass the check sum."""
    return F.expr("""aggregate(sequence(1, length(digits)), 0, (s, i) -> s + if(i % 2 = 1,
        cast(substring(digits, length(digits) - i + 1, 1) as int),
        cast(substring(digits, length(digits) - i + 1, 1) as int) * 2 - if(substring(digits, length(digits) - i + 1, 1) >= '5', 9, 0))) % 10 = 0""")


def _mod97() -> Column:
    """Whether an account number's check digits fit: its first four signs put last, letters as 10 to 35, modulo 97."""
    return F.expr("""aggregate(sequence(1, length(match)), 0L, (s, i) -> (
        s * if(ascii(substring(concat(substring(match, 5), left(match, 4)), i, 1)) >= 65, 100, 10)
        + ascii(substring(concat(substring(match, 5), left(match, 4)), i, 1)) - if(ascii(substring(concat(substring(match, 5), left(match, 4)), i, 1)) >= 65, 55, 48)) % 97) = 1""")


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 0 against, 2 for no opinion."""
    return F.when(yes, 1).when(no, 0).otherwise(2)


def _in_context(match: Column, i: Column) -> Column:
    """A match with the length of what is between it and the last one, and its surroundings."""
    gap = F.col("f.pieces")[i]
    return F.struct(match.alias("match"), F.char_length(gap).alias("gap"), F.right(gap, F.lit(NEAR)).alias("before"), F.left(F.col("f.pieces")[i + 1], F.lit(NEAR)).alias("after"))


def candidates(base: DataFrame) -> DataFrame:
    """A row for each match in ``base(id, version, text)``: kind, start, stop, valid, votes, and what the classifier sees besides."""
    found = []
    for kind, (guard, pattern) in PATTERNS.items():
        text = F.regexp_replace("text", _LONE, "\x01") if kind == "card" else F.col("text")
        matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        found.append(F.when(F.col("text").rlike(guard) & text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), matches.alias("matches"), pieces.alias("pieces"))))
    rows = (
        base.select("id", "version", F.monotonically_increasing_id().alias("row"), F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
        .where(F.size("found") > 0)
        .select("id", "version", "row", F.explode("found").alias("f"))
        .select("id", "version", "row", F.col("f.kind").alias("kind"), F.posexplode(F.transform("f.matches", _in_context)).alias("i", "m"))
        .select("id", "version", "row", "kind", "i", "m.*")
    )
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    long = F.char_length("match")
    placed = held(rows).withColumn("stop", F.sum(F.col("gap") + long).over(upto)).withColumn("start", F.col("stop") - long)
    placed = placed.withColumn("digits", _digits()).withColumn("n_digits", F.char_length("digits"))
    parts_fit = F.col("match").rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    valid = {
        "email": F.lit(True), "ip": parts_fit, "card": F.col("n_digits").between(12, 19) & F.when(F.col("n_digits").between(12, 19), _luhn()).otherwise(False),
        "phone": F.col("n_digits").between(9, 15), "local": ~F.col("digits").rlike("^[01]"), "national": ~F.col("digits").rlike("^(?:000|666|9)"),
        "iban": F.when(F.col("kind") == "iban", _mod97()).otherwise(False), "person": F.col("match").contains(" "),
    }
    known = {
        "email": F.lower("match").rlike(rf"\.(?:{_DOMAINS})$"), "ip": ~F.col("match").rlike(r"^(?:0|127|255|22[4-9]|2[34][0-9])\."), "card": F.col("digits").rlike(f"^(?:{_ISSUERS})"),
        "phone": F.col("match").rlike(f"^{_CALLING}"), "local": F.col("digits").rlike("^[2-9][0-9]{2}[2-9]"), "national": F.col("digits").rlike("^[0-6]"),
        "iban": F.col("match").rlike(f"^(?:{_STATES})"), "person": F.col("match").rlike(f"^(?:{_GIVEN})(?: |$)"),
    }
    around = F.lower(F.concat_ws(" ", "before", "after"))
    for_it = _by_kind({kind: around.rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{Ll}}{{4}})") for kind, words in _FOR.items()})
    glued = F.col("before").rlike(r"[\p{L}\p{N}]$") | F.col("after").rlike(r"^[\p{L}\p{N}]")
    none = F.lit(False)
    return placed.withColumn("valid", _by_kind(valid)).select(
        "id", "version", "kind", "start", "stop", "valid", (F.col("n_digits") >= 10).cast("int").alias("many_digits"),
        F.least(F.lit(4), F.floor(F.char_length("match") / 6)).cast("int").alias("long"), F.col("before").rlike(r"[:=#]\s*$").cast("int").alias("led"),
        F.when(F.col("before").rlike(r"\n\s*$") | (F.trim("before") == ""), 0).when(F.col("before").rlike(r"[.!?]\s*$"), 1).otherwise(2).alias("opens"),
        _vote(F.col("valid"), ~F.col("valid")).alias("v_structure"), _vote(_by_kind(known), ~_by_kind(known)).alias("v_gazetteer"),
        _vote(for_it, none).alias("v_context"), _vote(none, around.rlike(rf"(?<!\p{{L}})(?:{_AGAINST})")).alias("v_counter"), _vote(~glued, glued).alias("v_edge"),
    )


#: Of a span and its surroundings, beside its kind and the votes: ten digits or more, its length in sixes, whether a colon,
#: an equals sign or a number sign leads to it, and whether it opens a line, opens a sentence or stands within one.
TRAITS = ("many_digits", "long", "led", "opens")
VOTES = ("v_structure", "v_gazetteer", "v_context", "v_counter", "v_edge")


def estimate(patterns: Sequence[Row], rounds: int = 50, weight: float = 10.0) -> list[float]:
    """The posterior of each pattern (its kind, votes and count ``n``) by expectation-maximisation.

    A labeler has for each kind and either class a distribution over for, against and no opinion, drawn towards its
    distribution over all kinds by ``weight`` votes, so that rare kinds borrow and frequent ones go by their own; each
    kind has a prior.  Starts from a majority vote and adds one count to every pooled cell, so nothing becomes certain.
    """
    posterior = []
    for p in patterns:
        given = [p[v] for v in VOTES if p[v] != 2]
        posterior.append((sum(given) + 0.5) / (len(given) + 1.0))
    kinds = sorted({p["kind"] for p in patterns})
    for _ in range(rounds):
        pooled = {v: [[1.0] * 3, [1.0] * 3] for v in VOTES}
        own = {(k, v): [[0.0] * 3, [0.0] * 3] for k in kinds for v in VOTES}
        prior = {k: [1.0, 1.0] for k in kinds}
        for p, q in zip(patterns, posterior):
            for of, share in enumerate((1 - q, q)):
                prior[p["kind"]][of] += share * p["n"]
                for v in VOTES:
                    pooled[v][of][p[v]] += share * p["n"]
                    own[p["kind"], v][of][p[v]] += share * p["n"]

        def log(kind: str, v: str, of: int, vote: int) -> float:
            row, every = own[kind, v][of], pooled[v][of]
            return math.log((row[vote] + weight * every[vote] / sum(every)) / (sum(row) + weight))

        posterior = []
        for p in patterns:
            odds = math.log(prior[p["kind"]][1] / prior[p["kind"]][0]) + sum(log(p["kind"], v, 1, p[v]) - log(p["kind"], v, 0, p[v]) for v in VOTES)
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return posterior


def features(p: Row) -> list[str]:
    return ["bias", f"kind={p['kind']}", *(f"{x}={p[x]}" for x in (*TRAITS, *VOTES))]


def fit(patterns: Sequence[Row], posterior: Sequence[float], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier on the features of a span, by gradient steps on the posteriors."""
    weights: dict[str, float] = {}
    total = sum(p["n"] for p in patterns) or 1
    for _ in range(rounds):
        step: dict[str, float] = {}
        for p, q in zip(patterns, posterior):
            names = features(p)
            score = sum(weights.get(x, 0.0) for x in names)
            error = (q - 1 / (1 + math.exp(-score))) * p["n"] / total
            for x in names:
                step[x] = step.get(x, 0.0) + error
        for x, d in step.items():
            weights[x] = weights.get(x, 0.0) * (1 - decay) + rate * d
    return weights


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``id, spans`` for each row, spans being an array of (kind, start, stop, score) by start and then kind.

    The kinds ``email, ip, card, phone`` are fixed patterns with fixed conditions; their spans are always given.  Spans
    of other kinds are added where the classifier gives ``least`` or more and no fixed one overlaps them.  Positions
    are code points, the stop exclusive.  A null or empty text has no spans; repeated rows have the same spans; null
    ids are kept; other columns aren't looked at; an empty table gives an empty one.

    Texts are read in place: only matches, with at most 48 characters of context to a side, are shuffled, and the
    candidates are written to the shared checkpoint folder.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"))
    proposed = held(candidates(base))
    patterns = proposed.groupBy("kind", *TRAITS, *VOTES).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *TRAITS, *VOTES).collect()
    weights = fit(patterns, estimate(patterns))
    total = F.lit(weights.get("bias", 0.0))
    for name in ("kind", *TRAITS, *VOTES):
        for key, weight in weights.items():
            if key.startswith(f"{name}="):
                total = total + F.when(F.col(name).cast("string") == key.split("=", 1)[1], F.lit(weight)).otherwise(0.0)
    fixed = F.col("kind").isin(*BASE) & F.col("valid")
    scored = proposed.withColumn("score", 1 / (1 + F.exp(-total))).withColumn("fixed", fixed).where(F.col("fixed") | ~F.col("kind").isin(*BASE) & (F.col("score") >= least))
    order = Window.partitionBy("id", "version").orderBy("start", "stop", "kind")
    past = F.max(F.when(F.col("fixed"), F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("fixed"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(past, F.lit(0)) <= F.col("start")) & (F.coalesce(coming, F.col("stop")) >= F.col("stop"))
    rank = _by_kind({kind: F.lit(k) for k, kind in enumerate(KINDS)})
    listed = (
        scored.withColumn("clear", clear).where(F.col("fixed") | F.col("clear"))
        .groupBy(F.col("id").alias("of_id"), F.col("version").alias("of_version"))
        .agg(F.sort_array(F.collect_set(F.struct(F.col("start"), rank.alias("rank"), "stop", "kind", "score"))).alias("found"))
    )
    return base.select("id", "version").join(listed, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_version")), "left").select(
        F.col("id").alias(id_col),
        F.coalesce(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["score"].alias("score"))), F.array().cast("array<struct<kind: string, start: bigint, stop: bigint, score: double>>")).alias("spans"),
    )
